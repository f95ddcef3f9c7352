"""Hand rows with the answer that must come out."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.functions import text as t
from plumbline.operators import claims, commands, cost, deployment, gates, grading, graph, imports, ranking, stats
from plumbline.schemas import FINDING
from plumbline.sources import declarations

P = ("latency", "at_least", 1000.0, None, "ms", "at load")


def finding(spark, *rows):
    """Rows of overrides on one plain finding."""
    base = dict(
        case_id="c", arm="a", seed=1, ord=0, path="app/db.py", line=3, layer="data", symbol="fetch",
        mechanism="one query per row is issued here", severity="high", remediation="batch", arithmetic="",
        prediction=None, measurement=None,
    )
    made = [{**base, "ord": i, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(m[k] for k in base) for m in made], FINDING)


def p(comparator, value, upper=None, unit="ms", metric="latency", condition="at load"):
    return (metric, comparator, value, upper, unit, condition)


def m(value, experiment="e"):
    return (value, experiment, "")


@pytest.mark.parametrize(
    ("prediction", "measured", "verdict"),
    [
        (p("at_least", 1000.0), m(1240.0), "hit"),
        (p("at_least", 1000.0), m(400.0), "miss"),
        (p("at_least", 1000.0), m(None), "broken"),
        (p("at_least", 1000.0), m(float("nan")), "broken"),
        (p("at_most", 2.0, unit="queries"), m(2.0), "hit"),
        (p("between", 8.0, 27.0, "x"), m(19.0), "hit"),
        (p("between", 8.0, 27.0, "x"), m(3.0), "miss"),
        (p("at_least", 1000.0), None, None),
    ],
)
def test_verdicts(spark, prediction, measured, verdict):
    row = gates.grade(finding(spark, {"prediction": prediction, "measurement": measured})).first()
    assert row.verdict == verdict
    assert row.is_falsifiable and row.was_tested == (verdict in ("hit", "miss"))


@pytest.mark.parametrize(
    ("prediction", "kept"),
    [
        (p("at_least", 0.0), False),
        (p("at_most", 1e12), False),
        (p("between", 0.001, 1e9), False),
        (p("between", 8.0, 27.0), True),
        (p("at_least", 0.000001), False),
        (p("at_least", 5.0, unit="widgets"), True),
        (p("between", 8.0, None), False),
        (p("between", 8.0, 7.0), False),
        (p("at_least", float("inf")), False),
        (p("at_least", 5.0, condition=""), False),
    ],
)
def test_gate(spark, prediction, kept):
    row = gates.falsifiability_gate(finding(spark, {"prediction": prediction})).first()
    assert (row.prediction is not None) == kept
    assert (row.reject_reason is None) == kept


def reports(spark):
    return spark.createDataFrame([("c", "a", 1, "mod", 3, 1, False, 0.5, 2.0)], "case_id string, arm string, seed int, model_id string, seeded int, found int, failed boolean, usd double, seconds double")


def test_precision_counts_what_was_dropped_elsewhere(spark):
    f = finding(spark, {"prediction": p("at_least", 1000.0)})
    rows = [("c", "a", 1, f"x{i}", "s", "r") for i in range(17)] + [("c", "a", 1, "app/db.py", "fetch", "r")]
    dropped = spark.createDataFrame(rows, "case_id string, arm string, seed int, path string, symbol string, reason string")
    row = grading.score_reports(f, dropped, reports(spark)).first()
    assert row.observations == 18 and row.dropped == 18 and row.falsifiable_precision == pytest.approx(1 / 18)


def test_nothing_found_has_no_rates(spark):
    f = finding(spark, {}).filter("false")
    dropped = f.select("case_id", "arm", "seed", "path", "symbol", F.lit("r").alias("reason"))
    row = grading.score_reports(f, dropped, reports(spark)).first()
    assert (row.falsifiable_precision, row.hit_rate, row.prediction_coverage) == (None, None, None)


def test_an_experiment_holds_only_if_every_claim_does(spark):
    hit, miss = m(1240.0), m(1240.0)
    f = finding(
        spark, {"prediction": p("at_least", 1000.0), "measurement": hit}, {"prediction": p("at_least", 1000.0), "measurement": hit},
        {"prediction": p("at_most", 1000.0), "measurement": miss},
    )
    assert grading.experiment_outcomes(gates.grade(f)).first()[3:] == (0, 1)


def test_rates_pool_and_are_withheld_under_five(spark):
    cols = [f.name for f in grading.score_reports(finding(spark, {}).filter("false"), finding(spark, {}).filter("false").select("case_id", "arm", "seed", "path", "symbol", F.lit("").alias("reason")), reports(spark)).schema]
    base = dict.fromkeys(cols, 0) | {"case_id": "c", "arm": "a", "seed": 1, "model_id": "m", "failed": False, "falsifiable_precision": None, "hit_rate": None, "prediction_coverage": None, "usd": 0.0, "seconds": 0.0}
    frame = lambda *rs: spark.createDataFrame([Row(**{**base, **r}) for r in rs], grading.score_reports(finding(spark, {}).filter("false"), finding(spark, {}).filter("false").select("case_id", "arm", "seed", "path", "symbol", F.lit("").alias("reason")), reports(spark)).schema)
    row = grading.aggregate_arm(frame({"falsifiable": 1, "observations": 1}, {"falsifiable": 1, "observations": 100})).first()
    assert row.falsifiable_precision == pytest.approx(2 / 101)
    four = grading.aggregate_arm(frame({"experiments": 4, "tested": 4, "hits": 2})).first()
    five = grading.aggregate_arm(frame({"experiments": 5, "tested": 5, "hits": 2})).first()
    assert four.hit_rate is None and five.hit_rate == pytest.approx(0.4)


@pytest.mark.parametrize(
    ("pair", "check"),
    [
        ((26, 37, 12, 25), lambda v: abs(v - 0.111) < 0.01),
        ((6, 11, 6, 11), lambda v: v == pytest.approx(1.0)),
        ((30, 30, 0, 30), lambda v: v < 0.001),
        ((0, 0, 3, 5), lambda v: v is None),
    ],
)
def test_fisher(spark, pair, check):
    rows = spark.createDataFrame([("k", *pair, True)], "k string, hits_a bigint, tested_a bigint, hits_b bigint, tested_b bigint, independent boolean")
    assert check(stats.fisher_exact(rows, ["k"]).first().p)


@pytest.mark.parametrize(
    ("a", "b", "check"),
    [
        ([1.0] * 6, [0.2] * 6, lambda v: v < 0.01),
        ([1.0] * 3, [0.2] * 3, lambda v: v == pytest.approx(0.1)),
        ([], [0.2], lambda v: v is None),
        ([1, 1, 0.8, 1, 0.8, 0.8, 0.6, 0.8], [0.8] * 8, lambda v: v > 0.5),
    ],
)
def test_permutation(spark, a, b, check):
    rows = spark.createDataFrame([("k", [float(x) for x in a], [float(x) for x in b])], "k string, a array<double>, b array<double>")
    assert check(stats.permutation_exact(rows, ["k"]).first().p)


def test_sampled_permutation_is_near_the_exact_one(spark):
    rows = [("k", "a", i, 1.0 if i % 3 else 0.5) for i in range(8)] + [("k", "b", 100 + i, 0.7 if i % 2 else 0.4) for i in range(8)]
    long = spark.createDataFrame(rows, "k string, side string, item bigint, value double")
    exact = stats.permutation_exact(spark.createDataFrame([("k", [r[3] for r in rows if r[1] == "a"], [r[3] for r in rows if r[1] == "b"])], "k string, a array<double>, b array<double>"), ["k"]).first().p
    assert abs(stats.permutation_sampled(long, ["k"], resamples=3000).first().p - exact) < 0.03


def test_sampled_permutation_in_blocks(spark, monkeypatch):
    """Many small blocks give the same distribution as one, reruns agree, and a side without values has no p."""
    rows = [(k, "a" if i % 2 else "b", i, (i * 37 % 101) / 100 + (0.04 if i % 2 else 0)) for k in ("one", "two") for i in range(400)]
    rows += [("none", "a", 1, 0.5), ("none", "b", 2, None)]
    long = spark.createDataFrame(rows, "k string, side string, item bigint, value double")

    def found():
        return {r.k: r.p for r in stats.permutation_sampled(long, ["k"], resamples=4000).collect()}

    def limit():
        a, b = ([v for k, s, _, v in rows if k == "one" and s == side] for side in "ab")
        mean = sum(a + b) / 400
        spread = sum((v - mean) ** 2 for v in a + b) / 399 * (1 / 200 + 1 / 200)
        return math.erfc(abs(sum(a) - sum(b)) / 200 / math.sqrt(2 * spread))

    whole = found()
    assert whole == found() and whole["none"] is None
    monkeypatch.setattr(stats, "PER_BLOCK", 9)
    blocks = found()
    for p in (whole["one"], whole["two"], blocks["one"], blocks["two"]):
        assert p == pytest.approx(limit(), abs=0.03)


def test_positions_without_a_window_over_a_report(spark):
    rows = [("big" if i % 10 else "small", (i * 7919) % 500, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, ord int").repartition(7)
    got = ranking.positions(df, ["k"], [F.desc("v"), F.asc("ord")]).collect()
    assert len(got) == 3000
    for k in ("big", "small"):
        want = sorted((-v, i) for x, v, i in rows if x == k)
        assert [(-r.v, r.ord) for r in sorted((r for r in got if r.k == k), key=lambda r: r.position)] == want
        assert sorted(r.position for r in got if r.k == k) == list(range(1, len(want) + 1))
    assert ranking.positions(df.limit(0), ["k"], [F.desc("v")]).count() == 0


def test_compose_files_need_the_yaml_module(monkeypatch):
    monkeypatch.setattr(declarations, "yaml", None)
    with pytest.raises(ModuleNotFoundError):
        declarations._load("services: {}")


def test_verdict_words(spark):
    rows = spark.createDataFrame([(0.9,), (0.1,), (0.01,), (None,)], "p double").select(stats.verdict(F.col("p")))
    assert [r[0] for r in rows.collect()] == ["no detectable difference", "suggestive, not significant", "significant", "not measured"]


@pytest.mark.parametrize(
    ("symbol", "said", "path", "found"),
    [
        ("pool_size", ("pool_size", "the pool is far too small here"), "app/db.py", True),
        ("pool_size", ("pool_size", "the pool is far too small here"), "app/other.py", False),
        ("pool_size", ("DATABASE_URL", "the pool is far too small here"), "app/db.py", False),
        ("pool_size", ("x", "the Pool_Size value is far too small"), "app/db.py", True),
        ("except", ("x", "an exception type is not declared here"), "app/db.py", False),
        ("leak", ("x", "it leaks a handle on error"), "app/db.py", True),
        ("retry", ("x", "it retries without any backoff at all"), "app/db.py", True),
        ("balance", ("x", "should load-balance across all the replicas"), "app/db.py", False),
        ("pool_size", ("pool_size", "."), "app/db.py", False),
    ],
)
def test_defect_matching(spark, symbol, said, path, found):
    f = finding(spark, {"symbol": said[0], "mechanism": said[1], "path": path})
    d = spark.createDataFrame([("c", "D1", ["app/db.py"], [symbol])], "case_id string, id string, locations array<string>, symbols array<string>")
    assert grading.match_defects(d, f, f.select("case_id", "arm", "seed").distinct()).first().found == found


def test_reconcile_merges_and_splits(spark):
    one = claims.reconcile(finding(spark, {"layer": "network", "severity": "low"}, {"layer": "failure", "mechanism": "other words entirely"})).collect()
    assert len(one) == 1 and one[0].layer == "failure+network" and one[0].severity == "high"
    assert one[0].mechanism == "one query per row is issued here other words entirely"
    three = claims.reconcile(finding(spark, {"prediction": p("at_most", 5.0, metric="m1")}, {"prediction": p("at_most", 5.0, metric="m2")}, {}))
    assert three.count() == 3
    alone = claims.reconcile(finding(spark, {"layer": "x" * 100})).first()
    assert alone.layer == "x" * 100


def test_prose_joins_after_the_predicted_drafts(spark):
    drafts = finding(spark, {"mechanism": "prose first"}, {"mechanism": "predicted second", "prediction": p("at_most", 5.0)})
    merged = claims.reconcile(drafts).collect()
    assert [m.mechanism for m in merged] == ["predicted second prose first"]


def test_a_large_pair_is_sampled(spark):
    rows = spark.createDataFrame(
        [("k", [1.0] * 10, [0.2] * 11), ("l", [1.0] * 12, [0.2] * 12), ("e", [], [0.1])], "k string, a array<double>, b array<double>"
    )
    got = {r.k: r.p for r in stats.permutation_p(rows, ["k"]).collect()}
    assert got["e"] is None and got["k"] < 0.001 and got["l"] < 0.001


def test_permutation_is_exact_for_any_right_side(spark):
    from itertools import combinations

    rows = [
        ("few", [0.9, 0.7, 0.65], [round(0.05 * k * k % 1, 3) for k in range(20)]),
        ("ten", [round(0.3 + 0.061 * k, 3) for k in range(10)], [round(0.05 * k, 3) for k in range(13)]),
        ("ties", [1.0, 0.5, 0.5, 0.75], [0.5] * 9 + [0.25] * 8),
        ("same", [0.5, 0.5], [0.5] * 4),
        ("odd", [1 / 3, -2 / 7, 1e-9], [2**0.5, 0.0, -0.0, 1 / 7, 2 / 3]),
        ("large", [3e9, 1.5], [2.25, 4e9, 7.0]),
        ("even", [1.0, 4.0], [2.0, 3.0, 2.5]),
    ]
    got = {r.k: r.p for r in stats.permutation_p(spark.createDataFrame(rows, "k string, a array<double>, b array<double>"), ["k"]).collect()}
    for k, a, b in rows:
        pool, n, m = a + b, len(a), len(b)
        seen, total = abs(sum(a) / n - sum(b) / m) - 1e-12, sum(pool)
        far = [abs(sum(c) / n - (total - sum(c)) / m) >= seen for c in combinations(pool, n)]
        assert got[k] == pytest.approx(sum(far) / len(far), abs=1e-12), k


def test_permutation_counts_sums_not_choices(spark):
    """Ten against two hundred different values: 4e15 relabellings, counted here by a table of (taken, sum)."""
    a, b = [250 + 7 * k for k in range(10)], list(range(1, 401, 2))
    pool, n, m = a + b, len(a), len(b)
    ways = [{0: 1}, *({} for _ in a)]
    for v in pool:
        for t in range(n - 1, -1, -1):
            for s, w in ways[t].items():
                ways[t + 1][s + v] = ways[t + 1].get(s + v, 0) + w
    seen, total = abs(sum(a) / n - sum(b) / m) - 1e-9, sum(pool)
    want = sum(w for s, w in ways[n].items() if abs(s / n - (total - s) / m) >= seen) / sum(ways[n].values())
    rows = [("wide", [v / 1000 for v in a], [v / 1000 for v in b])]
    got = stats.permutation_exact(spark.createDataFrame(rows, "k string, a array<double>, b array<double>"), ["k"]).first().p
    assert got == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize(("comparator", "kept"), [("at_most", 5.0), ("at_least", 10.0)])
def test_strictest(spark, comparator, kept):
    f = finding(spark, {"prediction": p(comparator, 10.0)}, {"prediction": p(comparator, 5.0)})
    assert claims.reconcile(f).first().prediction.value == kept


def test_an_invalid_band_is_not_the_narrowest(spark):
    f = finding(spark, {"prediction": p("between", 8.0, 7.0)}, {"prediction": p("between", 8.0, 20.0)})
    assert claims.reconcile(f).first().prediction.upper == 20.0


@pytest.mark.parametrize("files", [2, 3, 16])
def test_collapse(spark, files):
    said = "correlation identifiers are not propagated to the handler"
    kept, dropped = claims.collapse_repeats(finding(spark, *[{"path": f"r{i}.py", "mechanism": said} for i in range(files)]))
    assert kept.count() + dropped.count() == files
    if files < 3:
        assert dropped.count() == 0
        return
    row = kept.first()
    assert kept.count() == 1 and row.path == "r0.py" and f"Seen in {files} files" in row.mechanism
    assert row.mechanism.endswith("r1.py, r2.py" if files == 3 else "r1.py, r10.py, r11.py, r12.py, r13.py, ...")


def test_collapse_keeps_the_worst_and_leaves_short_sentences(spark):
    said = "correlation identifiers are not propagated to the handler"
    rows = [{"path": f"r{i}.py", "mechanism": said, "severity": "low"} for i in range(3)] + [{"path": "z.py", "mechanism": said, "severity": "high"}]
    kept, _ = claims.collapse_repeats(finding(spark, *rows, *[{"path": f"q{i}.py", "mechanism": "`x` 12"} for i in range(4)]))
    assert sorted(r.path for r in kept.collect()) == ["q0.py", "q1.py", "q2.py", "q3.py", "z.py"]


def test_pressures(spark):
    rows = claims.forecast_pressures(finding(spark, {})).collect()
    assert [(r.mechanism, r.band) for r in rows] == [("query amplification", "isolated")]
    three = claims.forecast_pressures(finding(spark, *[{"line": i} for i in range(3)], {"line": 0}, {"layer": "data+network"})).first()
    assert (three.band, three.independent_findings) == ("systemic", 3)


def test_index_claims(spark):
    ops = spark.createDataFrame([("r", "create_index", "orders", ["user_id", "created_at"], "m.py", 1, {})], schemas.OPERATION)
    said = ["filters orders on user_id, a column with no index", "filters orders on created_at, a column with no index"]
    f = finding(spark, *[{"mechanism": s} for s in said]).withColumn("repo_id", F.lit("r"))
    kept, gone = claims.withdraw_index_claims(f, claims.indexed_columns(ops))
    assert [r.ord for r in gone.collect()] == [0] and [r.ord for r in kept.collect()] == [1]


def test_severity_is_only_lowered_on_the_map(spark):
    mods = spark.createDataFrame([("r", "a.py", None), ("r", "b.py", 0), ("r", "c.py", 5)], "repo_id string, path string, depth int")
    f = finding(spark, *[{"path": x} for x in ("a.py", "b.py", "c.py", "unknown.py")]).withColumn("repo_id", F.lit("r"))
    got = {r.path: r.severity for r in gates.cap_severity(f, mods).collect()}
    assert got == {"a.py": "low", "b.py": "high", "c.py": "medium", "unknown.py": "high"}


def test_depth_walks_the_graph(spark):
    mods = spark.createDataFrame([("r", x) for x in "abcdef"], "repo_id string, path string").withColumn("depth", F.lit(None).cast("int"))
    edges = spark.createDataFrame([("r", *e) for e in ("ab", "bc", "ca", "ad", "dc", "ef")], "repo_id string, src string, dst string")
    start = mods.filter("path = 'a'")
    got = {r.path: r.depth for r in graph.request_depth(mods, edges, start).collect()}
    assert got == {"a": 0, "b": 1, "d": 1, "c": 2, "e": None, "f": None}
    assert all(r.depth is None for r in graph.request_depth(mods, edges, start.limit(0)).collect())


def test_a_package_init_wins_a_name(spark):
    paths = ["x/pkg/a.py", "y/pkg/a.py", "x/pkg/b/__init__.py", "y/pkg/b.py", "top.py"]
    files = spark.createDataFrame([("r", x) for x in paths], "repo_id string, path string")
    got = {r.name: r.path for r in imports.module_name_index(files).collect()}
    assert got["pkg.a"] == "x/pkg/a.py" and got["pkg.b"] == "x/pkg/b/__init__.py" and got["top"] == "top.py"


@pytest.mark.parametrize("small", [0, 10_000])
def test_budget_rounds_equal_the_plain_walk(spark, small):
    rows = [("r%d" % (i % 2), f"m{i:03d}", float((i * 37) % 101), (i * 7919) % 900 + (0 if i % 50 else -2000)) for i in range(120)]
    cand = spark.createDataFrame(rows, "repo_id string, path string, value double, micros bigint")
    got = {(r.repo_id, r.path) for r in cost.budget_selection(cand, 5000, small=small).filter("selected").collect()}
    want = set()
    for repo in ("r0", "r1"):
        left = 5000
        for _, path, _, micros in sorted((r for r in rows if r[0] == repo), key=lambda r: (r[2], r[1]), reverse=True):
            if micros <= 0 or micros <= left:
                want.add((repo, path))
                left -= max(micros, 0)
    assert got == want


def test_an_unpriced_model_is_an_error(spark):
    calls = spark.createDataFrame([("nobody", 1, 1)], "model string, input_tokens bigint, output_tokens bigint")
    with pytest.raises(Exception, match="no price for model nobody"):
        cost.price_calls(calls).collect()


def test_an_empty_scope_is_an_error(spark):
    files = spark.createDataFrame([("r", "a/b.py")], "repo_id string, path string")
    with pytest.raises(ValueError):
        gates.scope_filter(files, ["backend"])


@pytest.mark.parametrize(
    ("path", "test"), [("tests/a.py", True), ("a_test.go", True), ("app/contest/a.py", False), ("latest.py", False), ("x/api.spec.ts", True)]
)
def test_test_paths(spark, path, test):
    assert spark.createDataFrame([(path,)], "path string").select(t.is_test_path(F.col("path"))).first()[0] == test


def test_secret_names_and_redaction(spark):
    names = spark.createDataFrame([(".env.production",), (".env.example",), ("environment.py",), ("prod.env",)], "n string")
    assert [r[0] for r in names.select(t.is_live_secret(F.col("n"))).collect()] == [True, False, False, True]
    said = "a -----BEGIN RSA PRIVATE KEY-----\nxyz\n-----END RSA PRIVATE KEY----- b postgres://u:pw@h AKIA" + "A" * 16 + " " + "b" * 40
    row = spark.createDataFrame([(said,)], "s string").select(t.redact(F.col("s"))).first()[0]
    assert row == "a REDACTED b postgres://REDACTED@h REDACTED REDACTED"


@pytest.mark.parametrize(("value", "said"), [(8.0, "8"), (0.25, "0.25"), (1e9, "1e+09"), (3600000.0, "3.6e+06"), (1234.5, "1234.5"), (-2.0, "-2")])
def test_short_numbers(spark, value, said):
    assert spark.createDataFrame([(value,)], "v double").select(t.short_number(F.col("v"))).first()[0] == said


def test_logs_settle_on_the_last_number(spark):
    logs = spark.createDataFrame([(0, False, "setup 3\n51\n", ""), (1, False, "51", "boom"), (0, False, "done", ""), (0, True, "5", "")], "exit_code int, timed_out boolean, stdout string, stderr string")
    assert [r.value for r in commands.settle_logs(logs).collect()] == [51.0, None, None, None]
    tail = logs.select(commands.last_number(F.col("stdout"), whole_line=False)).first()[0]
    assert tail == 51.0


def test_connection_budget(spark):
    text = "services:\n  api:\n    build: .\n    command: gunicorn --workers 4\n    environment: {POOL_SIZE: 10, MAX_OVERFLOW: 5}\n    deploy: {replicas: 2}\n  db:\n    image: postgres:16\n"
    files = spark.createDataFrame([("r", "compose.yml", len(text), False, text)], schemas.FILES)
    row = deployment.connection_budget(declarations.compose_services(files)).first()
    assert "= 120 connections against a budget of 97, over by 23" in row.detail
    assert "3 workers, or a pool of 7" in row.remediation


def test_ledger_balances(spark):
    said = "correlation identifiers are not propagated to the handler"
    f = finding(spark, *[{"path": f"r{i}.py", "mechanism": said} for i in range(5)], {"prediction": p("at_least", 0.0)})
    kept, dropped = claims.collapse_repeats(f)
    ledger = ranking.dropped_ledger(collapsed=dropped)
    assert kept.count() + ledger.count() == f.count()
