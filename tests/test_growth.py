"""Plans that must not grow faster than their tables, and results where values are all alike."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumbline import dims
from plumbline.functions import text as t
from plumbline.operators import claims, gates, ranking, scan
from plumbline.plans import bindings, catalog, grading_queries
from plumbline.streaming import events as ev


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def base(spark, tmp_path):
    """A supplier of every sort of key beside parts that repeat, and the nation of all but one."""
    spark.createDataFrame([(0, "N")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    suppliers = [(k, 0) for k in (0, 1, 2, 5, None)] + [(5, 0), (7, None)]
    spark.createDataFrame(suppliers, "s_suppkey bigint, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    parts = [(k, "ECONOMY", 3, "a b", 9.0) for k in (-1, 0, 1, 2, 3, 5, 8, 11, 11, 17, None)]
    spark.createDataFrame(parts, "p_partkey bigint, p_type string, p_size int, p_name string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_defects_meet_their_parts_on_equal_keys(spark, base):
    flat = bindings.view(spark, base, "defects_flat")
    assert "NestedLoop" not in plan_of(flat) and "Cartesian" not in plan_of(flat)
    names = {n: spark.read.parquet(f"{base}/{n}.parquet") for n in ("supplier", "nation", "part")}
    want = spark.sql(bindings.VIEWS["defects_flat"], **names)
    assert sorted(map(str, flat.collect())) == sorted(map(str, want.collect())) and want.count() >= 12


def test_cited_positions_alone_are_repeated_over_the_salts(spark, monkeypatch):
    repeated = []

    def watched(big, small, on, how="inner", **more):
        repeated.append(small.count())
        return scan.spread_join(big, small, on, how, **more)

    monkeypatch.setattr(claims, "spread_join", watched)
    report = [("c", "a", 1)]
    ranked = spark.createDataFrame(
        [(*report[0], i, f"p{i}", 1, "s", f"l{i % 3}") for i in range(1, 101)],
        "case_id string, arm string, seed int, position bigint, path string, line int, symbol string, layer string",
    )
    seen = [(*report[0], "o1", "m", "c", [1, 2]), (*report[0], "o2", "m", "c", [2, 101]), (*report[0], "o3", "m", "c", None)]
    observations = spark.createDataFrame(
        seen, "case_id string, arm string, seed int, obs_id string, mechanism string, consequence string, cited array<int>"
    )
    kept, refused = claims.resolve_citations(observations, ranked)
    assert repeated == [2]
    assert [r.obs_id for r in kept.collect()] == ["o1"]
    why = {r.obs_id: r.why for r in refused.collect()}
    assert why["o2"].endswith("not on the list of 100 findings it was given") and "at least two" in why["o3"]


@pytest.mark.parametrize(
    ("rates", "gap", "limit"),
    [([("a", 0.5)] * 40 + [("b", 0.5)] * 30, 0.0, float("nan")), ([("a", 0.5)] * 3, None, None), ([("a", 0.5), ("b", None)], None, None)],
)
def test_the_limit_of_equal_or_one_sided_rates(spark, monkeypatch, rates, gap, limit):
    rows = [("all", side, i, value) for i, (side, value) in enumerate(rates)]
    frame = spark.createDataFrame(rows, "pair string, side string, item bigint, value double")
    monkeypatch.setattr(grading_queries, "all_recalls", lambda spark, sf: frame)
    catalog.load()
    row = entry.queries()["Q03b_sampled_beside_its_limit"](spark, "unread").first()
    assert row.gap == gap and str(row.limit_p) == str(limit) and row.near is True


def test_a_salt_reads_only_the_columns_named(spark):
    big = spark.range(50).select("id", F.lit("k").alias("k"), F.md5(F.col("id").cast("string")).alias("costly"))
    small = spark.createDataFrame([("k", 1)], "k string, v int")
    joined = scan.spread_join(big, small, ["k"], "left", by=["id"]).select("id", "v")
    assert joined.count() == 50 and "md5" not in plan_of(joined)
    assert "md5" in plan_of(scan.spread_join(big, small, ["k"], "left").select("id", "v"))


def test_scores_of_a_sweep_are_computed_once(spark):
    plans = []
    for name in ("A04_sweep_summary", "A16_arm_comparison"):
        plans.append(plan_of(entry.queries()[name](spark, "/root/testdata/sf0.001")))
    assert not any("lineitem" in p or "FileScan" in p for p in plans)


def test_spans_over_the_edges_of_batches(spark):
    rnd = random.Random(5)
    rows = [(f"r{i % 40}", rnd.choice("xy"), i // 40, rnd.randint(0, 500), rnd.choice([True, False, None])) for i in range(1200)]
    rows += [(None, "x", 1, 1, True), ("r1", None, 1, 1, True), ("r1", "x", None, 1, True)]
    df = spark.createDataFrame(rows, "run_id string, agent string, seq bigint, at bigint, is_start boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        few = sorted(map(str, ev.agent_spans(df, slice_rows=7).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spans = ev.agent_spans(df, slice_rows=1_000)
    assert few == sorted(map(str, spans.collect())) and len(few) > 400


def test_first_findings_are_the_listed_ones_and_shuffle_no_prose(spark, monkeypatch):
    cols = "repo_id string, path string, line int, symbol string, ord bigint, severity string, arithmetic string, mechanism string, prediction string"
    rows = [
        (f"r{i % 2}", f"p{i % 7}" if i % 5 else None, i % 3 or None, "s", i % 11 or None, ("high", "low", None)[i % 3], "", f"m{i}", "x" if i % 4 else None)
        for i in range(120)
    ]
    found = spark.createDataFrame(rows, cols)
    mods = spark.createDataFrame([("r0", "p1", 0, 3), ("r0", "p2", None, 9), ("r1", "p3", 2, 0)], "repo_id string, path string, depth int, fan_in int")
    written = []
    cut = ranking.cut_lineage
    monkeypatch.setattr(ranking, "cut_lineage", lambda df: written.append(plan_of(df)) or cut(df))
    got = ranking.first_findings(found, mods, 20)
    want = ranking.listed_and_rest(ranking.rank_findings(found, mods), ["repo_id"], ranking.finding_order(), 20)
    told = ["repo_id", "path", "line", "symbol", "ord", "score", "position", "rest"]
    assert sorted(map(str, got.select(told).collect())) == sorted(map(str, want.select(told).collect())) and got.count() == 40
    before_join = written[0].split("Exchange")[1:]
    assert not any("mechanism" in part.split("\n")[0] for part in before_join) and "BroadcastHashJoin" in plan_of(got)


def test_files_of_one_row_group_are_parsed_in_many_tasks(spark, base):
    found = bindings.source_files(spark, base)
    assert found.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert found.count() == 9  # the part of key -1 carries no template, that of no key none either


def test_only_constructs_named_again_are_written_for_the_merge(spark, monkeypatch):
    written = []

    def watched(df):
        written.append(df.count())
        return df

    monkeypatch.setattr(claims, "cut_lineage", watched)
    prediction = ("m", "at_most", 5.0, None, "ms", "at peak load")
    sites = [*((f"p{i}", f"s{i}") for i in range(60)), ("p0", "s0"), (None, "s0"), (None, "s0"), ("x", None)]
    rows = [("c", "a", 1, i, p, i, f"l{i}", s, f"word {i}", "low", "", "", prediction if i % 2 else None) for i, (p, s) in enumerate(sites)]
    drafts = spark.createDataFrame(
        rows, "case_id string, arm string, seed int, ord bigint, path string, line int, layer string, symbol string, mechanism string, "
        "severity string, remediation string, arithmetic string, prediction struct<metric:string,comparator:string,value:double,upper:double,unit:string,condition:string>"
    )
    few = sorted(map(str, claims.reconcile(drafts).collect()))
    assert written[1] == 4 and len(few) == 62
    written.clear()
    monkeypatch.setattr(claims, "REPEAT_BITS", 2)  # bits shared by constructs that have nothing in common
    assert sorted(map(str, claims.reconcile(drafts).collect())) == few and written[1] > 30


def test_drafts_are_normalised_by_code_that_the_jvm_compiles(spark):
    """HotSpot interprets methods beyond 8,000 bytes of bytecode for ever."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame = entry.queries()["F08_normalise_drafts"](spark, "/root/testdata/sf0.001")
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        said = frame._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", said)]
    assert len(sizes) > 2 and max(sizes) < 8000


@pytest.mark.parametrize("text", ["", "a" * 40, "a" * 41, "é" * 21, "é" * 40, "é" * 41, "a" * 39 + "é\U0001f600", None])
def test_long_text_is_cut_by_characters(spark, text):
    row = spark.createDataFrame([(text,)], "x string").select(t.fits(F.col("x"), 40).alias("a"), t.long_fits(F.col("x"), 40).alias("b")).first()
    assert row.b == row.a and (text is None or row.b == (text if len(text) <= 40 else text[:28] + t.CUT))


def test_sentences_are_spelled_alike_in_both_views(spark):
    parts = [(k, name, size) for k in (-1, *range(24)) for name, size in (("a b", 3), ("@N c", None), (None, 60))]
    rows = spark.createDataFrame(parts, "l_partkey bigint, p_name string, p_size int").selectExpr("*", "l_partkey AS p_partkey")
    assert rows.filter(f"NOT ({bindings.SENTENCE} <=> {bindings.SPARK_SENTENCE})").isEmpty()
    kinds = spark.createDataFrame([(k,) for k in ("ECONOMY", "PROMO", "STANDARD", "LARGE", "MEDIUM", "SMALL", "", None)], "p_type string")
    assert kinds.filter(f"NOT ({bindings.EXT.replace('{p}', '')} <=> {bindings.SPARK_EXT})").isEmpty()
    assert bindings.SPARK_SENTENCE in bindings.SPARK_VIEWS["findings_flat"] and bindings.SPARK_EXT in bindings.SPARK_VIEWS["findings_flat"]


def test_words_of_a_sentence_are_those_left_by_what_is_specific(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab zA9_./`,-é́ \n`_9.aZx   a") for _ in range(rng.randrange(40))) for _ in range(20_000)]
    texts += ["", None, "a " * 5_000, "ab_c a.b 9,9 " * 500, "`" * 9, "word " * 40 + "end", "İndex ſ K a"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    plain = F.regexp_replace(F.lower("x"), dims.SPECIFICS, " ")
    want = F.array_join(F.regexp_extract_all(plain, F.lit("([a-z]+)"), 1), " ")
    assert rows.filter(~want.eqNullSafe(t.plain_words(F.col("x")))).isEmpty()


DRAFTS = (
    "case_id string, arm string, seed int, repo_id string, ord bigint, path string, line int, layer string, symbol string, mechanism string, "
    "severity string, remediation string, arithmetic string, prediction struct<metric:string,comparator:string,value:double,upper:double,unit:string,condition:string>"
)
INDEXED = [("r0", "orders", "user_id"), ("r0", "bills", "user_id"), ("r1", "orders", "day"), (None, "orders", "user_id"), ("r1", None, "user_id")]


def odd_drafts(spark):
    """Sentences alike in few and many files, claims answered and not, keys that are null or come again beside other sentences."""
    rng, rows = random.Random(9), []
    said = [
        "the `{}` handler calls another service while it holds the lock",
        "one query per row is issued for {}_x by this very loop",
        "filters orders and bills on user_id, a column with no index",
        "filters orders on day without any index to help it",
        "without an index the table orders is read whole",
        "it is slow",
        "",
        None,
    ]
    for i in range(240):
        text = rng.choice(said)
        prediction = ("m", "at_least", rng.choice([-1.0, 5.0]), None, rng.choice(["ms", "", None]), "at peak load")
        rows.append(
            (
                rng.choice("ab"), "x", 1, rng.choice(["r0", "r1", "r1", None]), rng.choice([i, i, i % 9, None]),
                rng.choice([f"p{i % 7}", "p" * 4001, "p1", "", None]), i, rng.choice("kl"), rng.choice(["s", "s" * 500, None]),
                text and text.format(i), rng.choice(["high", "medium", "low", None]), "", "", rng.choice([None, prediction]),
            )
        )
    return spark.createDataFrame(rows, DRAFTS), spark.createDataFrame(INDEXED, "repo_id string, table string, column string")


@pytest.mark.parametrize("limits", [{}, {"REPEAT_BITS": 2}, {"MOST_SENT": 0}])
def test_marked_findings_leave_the_ledger_of_whole_ones(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(claims, name, value)
    keys = ["case_id", "arm", "seed", "repo_id"]
    drafts, indexed = odd_drafts(spark)
    of = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    kept, rejected = gates.normalise_drafts(drafts, keys=keys)
    kept, withdrawn = claims.withdraw_index_claims(kept, indexed)
    told = claims.mark_repeats(kept)
    dropped = told.filter("side = 'dropped'").select(*keys[:3], "path", "symbol", "reason")
    marked = claims.mark_sentences(claims.mark_index_claims(gates.mark_dropped(drafts, keys=keys), indexed))
    kept2, rejected2 = gates.normalise_drafts(marked, keys=keys)
    kept2, withdrawn2 = claims.withdraw_index_claims(kept2, indexed)
    kept2, dropped2 = claims.collapse_repeats(kept2)
    assert of(rejected2) == of(rejected) and of(withdrawn2) == of(withdrawn) and of(dropped2) == of(dropped)
    assert of(kept2) == of(told.filter("side = 'kept'").drop("side", "reason"))
    assert rejected.count() > 20 and withdrawn.count() > 20 and dropped.count() > 20


@pytest.fixture
def lines(spark, base):
    """Lines, parts, suppliers and orders enough for every stage of the ledger, lines with null keys among them."""
    rng = random.Random(3)
    put = lambda rows, cols, name: spark.createDataFrame(rows, cols).write.mode("overwrite").parquet(f"{base}/{name}.parquet")
    put([(k, rng.choice(["ECONOMY", "PROMO", None]), k % 60, f"a {k}", 9.0) for k in range(48)], "p_partkey bigint, p_type string, p_size int, p_name string, p_retailprice double", "part")
    put([(k, 0) for k in range(20)], "s_suppkey bigint, s_nationkey int", "supplier")
    made = [
        (rng.choice([i, i, None]), rng.randrange(48), rng.randrange(20), rng.randrange(1, 4), float(rng.randrange(1, 50)), 0.02, "F", rng.choice(["1994-01-02", "1994-05-06", None]))
        for i in range(900)
    ]
    spark.createDataFrame(made, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_discount double, l_linestatus string, d string").selectExpr(
        "*", "cast(d AS timestamp_ntz) AS l_shipdate"
    ).drop("d").write.parquet(f"{base}/lineitem.parquet")
    put([(k, k * 7) for k in range(3_000)], "o_orderkey bigint, o_custkey bigint", "orders")
    return base


@pytest.mark.parametrize("name", ["U02_dropped_ledger", "U02b_ledger_balance"])
def test_the_ledger_writes_its_drafts_once_and_without_prose(spark, monkeypatch, lines, name):
    tables, plans = [], []
    write = grading_queries.written
    monkeypatch.setattr(grading_queries, "written", lambda df, to: (tables.append((to, df.columns)), plans.append(plan_of(df)), write(df, to))[2])
    for key, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(key, value)
    try:
        result = entry.queries()[name](spark, lines)
        plan, rows = plan_of(result), result.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [to for to, _ in tables] == ["judged"] and not {"mechanism", "layer", "prediction"} & set(tables[0][1])
    # lines meet their parts in one shuffle each; the suppliers are sent to where they meet
    assert len(re.findall(r"Exchange hashpartitioning\(l_", plans[0])) == 1 and "SortMergeJoin [l_suppkey" not in plans[0]
    assert "l_shipdate" not in re.search(r"Exchange hashpartitioning\(l_partkey.*?(?=\n.*Project)", plans[0], re.S).group()
    if name == "U02_dropped_ledger":
        assert "Exchange hashpartitioning(l_" not in plan and {r.stage for r in rows} == {"rejected", "withdrawn", "collapsed"}
    else:
        assert len(re.findall(r"Exchange hashpartitioning\(l_", plan)) == 1  # what was given is counted apart
        assert all(r.balanced for r in rows) and sum(r.given for r in rows) == 900 and sum(r.withdrawn for r in rows) > 10 and sum(r.collapsed for r in rows) > 10
