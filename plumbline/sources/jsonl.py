"""Line-delimited run records: steps, journals, recordings and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import schemas
from plumbline.operators.gates import redact_secrets


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of lines that are whole JSON objects; torn, blank and other lines are left out."""
    declared = T._parse_datatype_string(schema)
    with_corrupt = T.StructType([*declared.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    whole = lines.filter(F.trim("value").startswith("{"))
    row = whole.select(F.from_json("value", with_corrupt, options).alias("r"))
    return row.filter("r is not null and r._corrupt is null").select("r.*").drop("_corrupt")


def scan_trajectory(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """``steps`` of every run under ``path``, up to each file's last whole line."""
    lines = (spark.readStream if stream else spark.read).text(path)
    return _parsed(lines, schemas.STEP)


def scan_journal(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(spark.read.text(path), schemas.JOURNAL)


CASE = (
    "id string, name string, repo_description string, notes string, "
    "experiment_conditions map<string,string>, defects array<struct<id:string,lab_topic:string,defect:string,"
    "locations:array<string>,symbols:array<string>,verification:string,expected_metric:string,"
    "unmeasurable_because:string,notes:string>>"
)


def scan_cases(spark: SparkSession, root: str, pattern: str = "case.json") -> tuple[DataFrame, DataFrame]:
    """(cases, defects) of every manifest below ``root``."""
    raw = (
        spark.read.schema(CASE)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .json(root)
        .filter("id is not null")
    )
    cases = raw.select(
        F.col("id").alias("case_id"), "name", "repo_description", "experiment_conditions", F.size("defects").alias("seeded")
    )
    defects = raw.select(F.col("id").alias("case_id"), F.explode("defects").alias("d")).select("case_id", "d.*")
    return cases, defects


RECORDING = (
    f"findings array<struct<{', '.join(f.replace(' ', ':', 1) for f in ['path string', 'line int', 'layer string', 'symbol string', 'mechanism string', 'severity string', 'remediation string', 'arithmetic string'])},"
    f"prediction:{schemas.PREDICTION}>>, specialists array<string>, reasoning string, "
    "observations array<struct<mechanism:string,consequence:string,findings:array<int>>>"
)


def scan_recordings(spark: SparkSession, directory: str, key_from: str = "file") -> DataFrame:
    """(key, kind, findings, specialists, reasoning, observations).

    The key is the file's name, or with ``key_from="folder"`` the ``key=`` folder it lies in.
    """
    raw = (
        spark.read.schema(RECORDING)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(directory)
        .select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_path").alias("_path"))
    )
    key = F.regexp_replace("_file", r"\.json$", "") if key_from == "file" else F.regexp_extract("_path", "/key=([^/]+)/", 1)
    kind = (
        F.when(F.col("findings").isNotNull(), "findings")
        .when(F.col("specialists").isNotNull(), "routing")
        .when(F.col("observations").isNotNull(), "observations")
    )
    return raw.select(key.alias("key"), kind.alias("kind"), *[c for c in raw.columns if c not in ("_file", "_path")]).filter(
        "kind is not null"
    )


def sink_steps(df: DataFrame, path: str, checkpoint: str | None = None):
    """Append redacted steps as JSON lines; a streaming frame needs a checkpoint and returns its query."""
    texts = [f.name for f in df.schema.fields if f.name in ("detail", "response", "prompt")]
    safe = redact_secrets(df, texts)
    if df.isStreaming:
        return (
            safe.writeStream.format("json")
            .option("checkpointLocation", checkpoint)
            .option("path", path)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
    safe.write.mode("append").json(path)
    return None
