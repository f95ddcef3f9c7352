"""Declared row shapes."""

from __future__ import annotations

RUN = ["case_id", "arm", "seed"]

PREDICTION = "struct<metric:string,comparator:string,value:double,upper:double,unit:string,condition:string>"
MEASUREMENT = "struct<value:double,experiment:string,detail:string>"
DRAFT = (
    "path string, line int, layer string, symbol string, mechanism string, severity string, "
    f"remediation string, arithmetic string, prediction {PREDICTION}"
)
FINDING = f"case_id string, arm string, seed int, ord bigint, {DRAFT}, measurement {MEASUREMENT}"
FILES = "repo_id string, path string, size bigint, is_symlink boolean, text string"
STEP = (
    "run_id string, seq bigint, at timestamp, agent string, action string, model_call boolean, "
    "detail string, response string, usage struct<input_tokens:bigint,output_tokens:bigint,usd:double>, "
    "retries int"
)
JOURNAL = (
    "event string, run_id string, model string, scope string, modules int, started_at string, "
    "finished_at string, read int, findings int, usd double, report string"
)
OPERATION = (
    "repo_id string, kind string, table string, columns array<string>, path string, line int, "
    "keywords map<string,string>"
)
SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2}
