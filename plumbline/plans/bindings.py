"""Bound views: the shared tables projected into the shapes the operators read.

Most views are one SQL text valid in Spark and in an ANSI engine alike, so the same projection feeds
the operator and its check. Placeholders in braces name tables or other views. Arrays travel as
comma-joined text and are split on the Spark side.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.scan import numbered
from plumbline.plans.source_set import TEMPLATES
from plumbline.schemas import MEASUREMENT

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def _case(expr: str, options: list[str]) -> str:
    """The option numbered by ``expr``, from one delimited text: far smaller code than a CASE arm each."""
    return f"split_part('{'|'.join(options)}', '|', cast({expr} AS int) + 1)"


EXT = "CASE {p}p_type WHEN 'ECONOMY' THEN '.py' WHEN 'PROMO' THEN '.ts' WHEN 'STANDARD' THEN '.go' WHEN 'LARGE' THEN '.rs' WHEN 'MEDIUM' THEN '.java' ELSE '.cpp' END"


def module_path(p: str = "") -> str:
    return (
        f"concat('pkg', cast({p}p_size % 7 AS string), '/', lower({p}p_type), '/m', cast({p}p_partkey AS string), "
        + EXT.replace("{p}", p)
        + ")"
    )


def shell(expr: str) -> str:
    """``<X:-1>`` spelled as a shell variable; braces would be read as view names."""
    return f"replace(replace({expr}, '<', concat('$', chr(123))), '>', chr(125))"


def repo_of(key: str) -> str:
    return f"concat('r', cast({key} % 4 AS string))"


NAME = "replace(p_name, ' ', '_')"
SENTENCES = [
    "concat('issues one query per row for ', {n}, ' while holding the session open')",
    "concat('the retry has no backoff so ', {n}, ' amplifies the load it meets')",
    "concat('the connection pool is smaller than the worker count that serves ', {n})",
    "concat('an exception is swallowed and ', {n}, ' returns an empty list')",
    "concat('the secret for ', {n}, ' is hardcoded in this module')",
    "concat('user input is concatenated into the statement that ', {n}, ' runs')",
    "concat({n}, ' is not idempotent and may be delivered twice under load')",
    "concat('the queue behind ', {n}, ' grows without backpressure from its consumer')",
    "concat('shared state in ', {n}, ' is updated without a lock by two threads')",
    "concat({n}, ' is slow')",
    "concat('correlation id is not propagated through the `', {n}, '` handler calls made today')",
    "concat('joins t', cast(p_size % 50 AS string), ' rows and filters on c', cast(p_partkey % 9 AS string), ', a column with no index, for ', {n})",
]
SENTENCE = "CASE l_partkey % 12 " + " ".join(f"WHEN {i} THEN {s.replace('{n}', NAME)}" for i, s in enumerate(SENTENCES)) + " END"
LAYER_NAMES = "concurrency network data distributed failure observability security craft serving data+network".split()
METRIC_NAMES = "queries_per_request http_req_duration_p99 retry_amplification queue_depth".split()
EVENT_CYCLE = (
    "review.started scout.started language.detected framework.detected service.detected structure.discovered "
    "model.built agent.started agent.handoff agent.finished research.started research.finished finding.detected "
    "context.updated coverage.computed prediction.generated review.completed review.failed debug.noise agent.paused"
).split()
MIGRATION_CYCLE = (
    "add_column drop_column alter_column create_index drop_index create_foreign_key create_table drop_table "
    "create_unique_constraint create_check_constraint"
).split()
COMMANDS = [
    "uvicorn app.main:app --workers 4 --backlog=64",
    "celery -A tasks.celery_app worker --concurrency=8 -Q mail",
    "gunicorn -w 3 wsgi:application --threads 2",
    "python -m jobs.sweeper",
    "node server/index.js --pool 5",
    "",
    "gunicorn app:api --workers <WORKERS:-6> --max_connections = 40",
    "celery beat -A tasks.celery_app",
]

VIEWS: dict[str, str] = {
    "findings_flat": f"""
SELECT n_name AS case_id,
  CASE WHEN l_linestatus = 'F' THEN 'baseline' ELSE 'pipeline' END AS arm,
  cast(year(l_shipdate) AS int) AS seed,
  ((l_orderkey * 8 + l_linenumber) * 200000 + l_partkey % 200000) * 1000 + l_suppkey % 1000 AS ord,
  {repo_of('l_partkey')} AS repo_id,
  {module_path()} AS path,
  cast(l_orderkey % 100 AS int) - 5 AS line,
  {_case('l_suppkey % 10', LAYER_NAMES)} AS layer,
  concat('fn_', cast(p_size AS string)) AS symbol,
  {SENTENCE} AS mechanism,
  CASE WHEN l_quantity > 33 THEN 'high' WHEN l_quantity > 16 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN l_orderkey % 17 = 0 THEN '' ELSE concat('bound ', {NAME}) END AS remediation,
  CASE WHEN l_linenumber % 2 = 0 THEN concat(cast(l_linenumber AS string), ' x ', cast(p_size AS string)) ELSE '' END AS arithmetic,
  CASE WHEN (l_partkey + l_orderkey) % 7 = 0 THEN 0 ELSE 1 END AS predicted,
  {_case('l_partkey % 4', METRIC_NAMES)} AS p_metric,
  {_case('l_linenumber % 3', ['at_least', 'at_most', 'between'])} AS p_comparator,
  l_quantity - 2 AS p_value,
  CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN l_quantity - 3 WHEN 2 THEN (l_quantity - 2) * 200 ELSE l_quantity + 8 END AS p_upper,
  {_case('l_partkey % 6', ['ms', 'queries', 'x', '%', ' MS ', 'widgets'])} AS p_unit,
  CASE WHEN l_orderkey % 13 = 0 THEN '' ELSE 'at peak load' END AS p_condition,
  CASE WHEN l_orderkey % 4 = 0 THEN 0 ELSE 1 END AS measured,
  CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE round(l_discount * 500, 0) END AS m_value,
  CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE concat(n_name, '/', {_case('l_partkey % 4', METRIC_NAMES)}, '/', cast(l_partkey % 3 AS string)) END AS m_experiment
FROM {{lineitem}} l JOIN {{part}} p ON l_partkey = p_partkey
  JOIN {{supplier}} s ON l_suppkey = s_suppkey JOIN {{nation}} n ON s_nationkey = n_nationkey
""",
    "modules_flat": f"""
SELECT {repo_of('p_partkey')} AS repo_id, p_partkey, {module_path()} AS path,
  cast(floor(p_retailprice) AS int) % 400 + p_size AS loc,
  concat_ws(',', CASE WHEN p_size = 1 THEN 'entrypoint' END,
    CASE WHEN p_size % 2 = 1 THEN 'concurrency' END,
    CASE WHEN cast(floor(p_size / 2) AS int) % 2 = 1 THEN 'network' END,
    CASE WHEN cast(floor(p_size / 4) AS int) % 2 = 1 THEN 'data' END,
    CASE WHEN cast(floor(p_size / 8) AS int) % 2 = 1 THEN 'distributed' END,
    CASE WHEN cast(floor(p_size / 16) AS int) % 2 = 1 AND p_partkey % 3 <> 0 THEN 'security' END) AS signals,
  CASE WHEN p_partkey % 3 = 0 THEN 'acme_sdk' ELSE '' END AS unmatched,
  {_case('p_partkey % 6', ['redis', 'psycopg', 'PyWidget_kit', 'jwt', 'kombu,redis', ''])} AS external
FROM {{part}}
""",
    "edges_flat": f"""
SELECT DISTINCT {repo_of('a.l_partkey')} AS repo_id, {module_path('pa.')} AS src, {module_path('pb.')} AS dst
FROM {{lineitem}} a JOIN {{lineitem}} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  JOIN {{part}} pa ON a.l_partkey = pa.p_partkey JOIN {{part}} pb ON b.l_partkey = pb.p_partkey
WHERE a.l_partkey % 4 = b.l_partkey % 4 AND a.l_partkey <> b.l_partkey
""",
    "commit_files": f"""
SELECT {repo_of('l_partkey')} AS repo_id, {module_path()} AS path, l_orderkey AS commit_id
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
""",
    "reads_flat": f"""
SELECT DISTINCT {repo_of('l_partkey')} AS repo_id, {module_path()} AS path
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity > 40
""",
    "defects_flat": f"""
SELECT n_name AS case_id, concat('D', cast(s_suppkey AS string)) AS id, {repo_of('p_partkey')} AS repo_id, {module_path()} AS path,
  concat({_case('s_suppkey % 6', ['retry', 'leak', 'queue', 'except', 'pool_size', 'statement'])}, ',fn_', cast(p_size AS string)) AS symbols,
  {_case('s_suppkey % 5', METRIC_NAMES + [''])} AS expected_metric
FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey
  JOIN {{part}} ON p_partkey = s_suppkey OR p_partkey = s_suppkey * 2 + 1 OR p_partkey = s_suppkey * 3 + 2
""",
    "files_flat": """
SELECT concat('d', lang) AS repo_id, doc_id,
  concat(
    CASE doc_id % 24 WHEN 0 THEN 'node_modules/x/build/' WHEN 1 THEN '.claude/worktrees/' WHEN 2 THEN 'lib/fixtures/'
      WHEN 3 THEN 'foo.egg-info/' WHEN 4 THEN 'api/generated/' WHEN 5 THEN 'tests/' WHEN 6 THEN 'app/contest/'
      WHEN 7 THEN 'src/vendor/deep/dist/' ELSE concat('src/', source, '/') END,
    CASE doc_id % 19 WHEN 0 THEN concat('.env.p', cast(doc_id AS string)) WHEN 1 THEN concat('a', cast(doc_id AS string), '.min.js')
      WHEN 2 THEN concat('m', cast(doc_id AS string), '_pb2.py') WHEN 3 THEN concat('n', cast(doc_id AS string), '_test.go')
      WHEN 4 THEN concat('latest', cast(doc_id AS string), '.TXT') WHEN 5 THEN concat('test_', cast(doc_id AS string), '.rs')
      WHEN 6 THEN concat('prod', cast(doc_id AS string), '.env') WHEN 7 THEN concat('c', cast(doc_id AS string), '.spec.ts')
      ELSE concat('doc', cast(doc_id AS string), '.py') END) AS path,
  n_chars * 16 AS size, doc_id % 29 = 0 AS is_symlink, text
FROM {documents}
""",
    "events_flat": f"""
SELECT concat('u', cast(user_id AS string)) AS run_id, event_id, ts,
  MILLIS(ts) - 1704067200000 - 900000 * (cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) % 2) AS offset_ms,
  cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS k, value,
  {_case('(event_id * 7 + cast(regexp_extract(props, ' + "'([0-9]+)'" + ', 1) AS bigint)) % 20', EVENT_CYCLE)} AS event
FROM {{events}}
""",
    "turns": """
SELECT conv_id, turn, concat('c', cast(conv_id AS string)) AS run_id, role, cast(length(text) AS bigint) AS chars,
  conv_id * 100000 + turn AS n
FROM {conversations}
""",
    "operations_flat": f"""
SELECT {repo_of('o_custkey')} AS repo_id, {_case('o_orderkey % 10', MIGRATION_CYCLE)} AS kind,
  concat('t', cast(o_custkey % 50 AS string)) AS tbl,
  CASE WHEN o_orderkey % 10 IN (0, 1, 3, 5) AND o_orderkey % 7 <> 0
    THEN concat('c', cast(o_custkey % 9 AS string), CASE WHEN o_orderkey % 3 = 0 THEN concat(',c', cast(o_orderkey % 11 AS string)) ELSE '' END)
    ELSE '' END AS cols,
  concat('migrations/m', cast(cast(floor(o_orderkey / 40) AS bigint) AS string), '.py') AS path,
  cast(o_orderkey % 40 AS int) + 1 AS line,
  CASE o_custkey % 4 WHEN 0 THEN 'nullable=False' WHEN 1 THEN 'nullable=False,server_default=0' WHEN 2 THEN 'postgresql_concurrently=True' ELSE 'nullable=True' END AS kw
FROM {{orders}}
""",
    "pins_flat": f"""
SELECT {repo_of('p_partkey')} AS repo_id, replace(concat(p_name, ' ', cast(p_size % 10 AS string)), ' ', '-') AS name,
  CASE WHEN min(p_partkey) % 5 = 0 THEN '' ELSE concat(cast(min(p_size) % 6 AS string), '.', cast(max(p_size) AS string), '.1') END AS version
FROM {{part}} GROUP BY 1, 2
""",
    "registry_flat": """
SELECT replace(concat(p_name, ' ', cast(p_size % 10 AS string)), ' ', '-') AS name,
  concat(cast(max(p_size) % 7 AS string), '.0.', cast(min(p_size) AS string)) AS latest,
  CASE WHEN min(p_partkey) % 2 = 0 THEN '2026-01-01' ELSE '' END AS released
FROM {part} WHERE p_size % 10 <> 7 GROUP BY 1
""",
    "services_flat": f"""
SELECT {repo_of('s_suppkey')} AS repo_id, 'docker-compose.yml' AS path, cast(s_suppkey AS int) AS ord,
  CASE WHEN s_suppkey % 9 = 0 THEN concat('-x', cast(s_suppkey AS string)) ELSE concat({_case('s_suppkey % 4', ['api', 'redis', 'pg', 'worker'])}, cast(s_suppkey AS string)) END AS name,
  cast(s_suppkey % 50 AS int) + 1 AS line,
  {_case('s_suppkey % 6', ['', 'redis:latest', 'registry.local:5000/postgres', 'nginx', 'app@sha256:aa', 'minio/minio:2024'])} AS image,
  {_case('s_suppkey % 5', ['', 'backend', 'pkg1', 'pkg2/economy', 'web'])} AS source_root,
  {shell(_case('s_suppkey % 8', COMMANDS))} AS command,
  {_case('s_suppkey % 3', ['8080:80', '', '9000'])} AS ports,
  {shell("CASE WHEN s_suppkey % 7 < 3 THEN concat('POOL_SIZE=', cast(s_suppkey % 12 AS string), ',MAX_OVERFLOW=5,WORKERS=<W:-4>') ELSE 'DEBUG=1' END")} AS env,
  s_suppkey % 11 < 4 AS has_memory_limit, s_suppkey % 13 < 5 AS has_healthcheck,
  CASE WHEN s_suppkey % 4 = 1 THEN cast(s_suppkey % 6 AS string) END AS replicas
FROM {{supplier}}
""",
    "logs_flat": f"""
SELECT {_case('l_partkey % 4', METRIC_NAMES)} AS metric, concat('case', cast(l_suppkey % 25 AS string)) AS case_id,
  CASE WHEN l_linestatus = 'F' THEN 'seeded' ELSE 'remediated' END AS variant,
  ((l_orderkey * 8 + l_linenumber) * 200000 + l_partkey % 200000) * 1000 + l_suppkey % 1000 AS ord,
  CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS exit_code, l_orderkey % 23 = 0 AS timed_out,
  cast(l_quantity AS int) AS q, l_partkey % 5 AS shape,
  CASE l_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'No module named ''jwt''' WHEN 2 THEN 'No module named ''app.db''' ELSE 'boom' END AS stderr
FROM {{lineitem}}
""",
    "source_parts": f"""
SELECT p_partkey, concat('s', cast(cast(floor(p_partkey / {len(TEMPLATES)}) AS bigint) AS string)) AS repo_id,
  cast(p_partkey % {len(TEMPLATES)} AS int) AS tid, cast(floor(p_partkey / {len(TEMPLATES)}) AS bigint) % 3 = 0 AS bare, {NAME} AS nm
FROM {{part}}
""",
}

#: The sentence as one text with a hole in it: a CASE arm each makes generated code too long for the JVM to compile.
SPARK_SENTENCE = (
    "replace(CASE WHEN l_partkey % 12 = 11 THEN " + SENTENCES[11].replace(", {n})", ")").replace("for ')", "for @N')")
    + " ELSE get(array(" + ", ".join(s.replace("{n}", "'@N'") for s in SENTENCES[:11]) + f"), cast(l_partkey % 12 AS int)) END, '@N', {NAME})"
)
SPARK_EXT = "coalesce(try_element_at(map('ECONOMY', '.py', 'PROMO', '.ts', 'STANDARD', '.go', 'LARGE', '.rs', 'MEDIUM', '.java'), p_type), '.cpp')"

#: Views that Spark reads in another spelling with the same rows: joined on an OR, every supplier would meet every part.
SPARK_VIEWS = {
    # the year is taken before the join with parts, so that no whole date is shuffled
    "findings_flat": VIEWS["findings_flat"]
    .replace(SENTENCE, SPARK_SENTENCE)
    .replace(EXT.replace("{p}", ""), SPARK_EXT)
    .replace("cast(year(l_shipdate) AS int)", "l_year")
    .replace("{lineitem} l", "(SELECT *, cast(year(l_shipdate) AS int) AS l_year FROM {lineitem}) l"),
    "defects_flat": VIEWS["defects_flat"].partition("\nFROM")[0]
    + """
FROM (SELECT *, explode(array_distinct(array(s_suppkey, s_suppkey * 2 + 1, s_suppkey * 3 + 2))) AS of_part FROM {supplier})
  JOIN {nation} ON s_nationkey = n_nationkey JOIN {part} ON p_partkey = of_part
"""
}


def _needs(sql: str) -> list[str]:
    return [n for n in [*TABLES, *VIEWS] if "{" + n + "}" in sql]


@cache
def _duck(name: str) -> str:
    sql = VIEWS[name].replace("MILLIS(ts)", "(epoch_us(ts) // 1000)")
    for n in _needs(sql):
        sql = sql.replace("{" + n + "}", n)
    return f"{name} AS ({sql.replace('{{', '{').replace('}}', '}').strip()})"


def ctes(*names: str) -> str:
    """The views and what they rest on, as the head of a WITH clause."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        for d in _needs(VIEWS[n]):
            if d in VIEWS:
                visit(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        visit(n)
    return ",\n".join(_duck(n) for n in ordered)


SPREAD_BYTES = 1 << 20
_PLANS: dict[tuple, DataFrame] = {}


def remembered(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Build the (lazy) frame once per application: views share plans, and none is analysed twice."""

    @wraps(fn)
    def run(spark: SparkSession, sf: str, *args):
        key = (spark.sparkContext.applicationId, id(spark), fn.__module__, fn.__name__, sf, *args)
        if key not in _PLANS:
            _PLANS[key] = fn(spark, sf, *args)
        return _PLANS[key]

    return run


@remembered
def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One shared table. A file too small to split would run everything after it in one task, so it
    is dealt out over the cores; tables with splits enough are read as they are.
    """
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SPREAD_BYTES and df.rdd.getNumPartitions() * 2 <= cores:
        return df.repartition(cores)
    return df


#: A table that a view joins last and to every row: sent to the rows, they need not be shuffled a second time, then with prose.
SENT = {"findings_flat": "supplier"}
SENT_ROWS = 500_000


@remembered
def sent(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One shared table, with a broadcast hint up to SENT_ROWS rows."""
    df = table(spark, sf, name)
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


@remembered
def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if name in TABLES:
        return table(spark, sf, name)
    # zone-free timestamps count from a zone-free epoch, so the session's time zone does not matter
    zero = "timestamp_ntz '1970-01-01 00:00:00'"
    sql = SPARK_VIEWS.get(name, VIEWS[name]).replace("MILLIS(ts)", f"(unix_millis(cast(ts AS timestamp)) - unix_millis(cast({zero} AS timestamp)))")
    return spark.sql(sql, **{n: sent(spark, sf, n) if n == SENT.get(name) else view(spark, sf, n) for n in _needs(VIEWS[name])})


# -- Spark shapes ----------------------------------------------------------------------------------


def _split(col: str):
    return F.when(F.col(col) == "", F.array().cast("array<string>")).otherwise(F.split(col, ","))


@remembered
def drafts(spark: SparkSession, sf: str) -> DataFrame:
    flat = view(spark, sf, "findings_flat")
    p = F.struct(*[F.col(f"p_{c}").alias(c) for c in ("metric", "comparator", "value", "upper", "unit", "condition")])
    return flat.withColumn("prediction", F.when(F.col("predicted") == 1, p)).drop(
        "predicted", "p_metric", "p_comparator", "p_value", "p_upper", "p_unit", "p_condition"
    )


@remembered
def findings(spark: SparkSession, sf: str) -> DataFrame:
    m = F.struct(F.col("m_value").alias("value"), F.col("m_experiment").alias("experiment"), F.lit("").alias("detail"))
    return (
        drafts(spark, sf)
        .withColumn("measurement", F.when(F.col("measured") == 1, m).cast(MEASUREMENT))
        .drop("measured", "m_value", "m_experiment")
    )


@remembered
def modules(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "modules_flat").select(
        "repo_id",
        "path",
        F.col("loc").cast("int").alias("loc"),
        _split("signals").alias("signals"),
        _split("unmatched").alias("unmatched_imports"),
        _split("external").alias("external"),
    )


@remembered
def defects(spark: SparkSession, sf: str) -> DataFrame:
    """Locations of one defect are gathered; a defect names three at most."""
    flat = view(spark, sf, "defects_flat")
    return flat.groupBy("case_id", "id", "expected_metric").agg(
        F.array_sort(F.collect_set("path")).alias("locations"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("symbols", ","))))).alias("symbols"),
    )


@remembered
def files(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "files_flat").drop("doc_id")


@remembered
def operations(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "operations_flat").select(
        "repo_id", "kind", F.col("tbl").alias("table"), _split("cols").alias("columns"), "path", "line",
        F.expr("str_to_map(kw, ',', '=')").alias("keywords"),
    )


@remembered
def services(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "services_flat").select(
        "repo_id", "path", "ord", "name", "line", "image", "source_root", "command", _split("ports").alias("ports"),
        F.lit(True).alias("ports_listed"), F.expr("str_to_map(env, ',', '=')").alias("environment"),
        "has_memory_limit", "has_healthcheck", "replicas",
    )


@remembered
def numbered_events(spark: SparkSession, sf: str) -> DataFrame:
    """``events_flat`` with seq 1..n per run, counted over daily slices."""
    flat = view(spark, sf, "events_flat")
    day = F.datediff("ts", F.lit("2024-01-01"))
    return numbered(flat, ["run_id"], [F.col("ts"), F.col("event_id")], day, "seq")


def event_payload():
    """The JSON each kind of event carries, built from its flat columns."""
    k, e = F.col("k").cast("string"), F.col("event")
    j = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    module = j('"src/m', (F.col("k") % 9).cast("string"), '.py"')
    return (
        F.when(e == "review.started", j('{"model":"model-', (F.col("k") % 3).cast("string"), '","root":"r"}'))
        .when(e == "structure.discovered", j('{"modules":', k, "}"))
        .when(e == "agent.started", j('{"agent":"analyst:data","layer":"data","module":', module, "}"))
        .when(e == "agent.finished", j('{"agent":"analyst:data","findings":2,"usage":{"usd":', F.col("value").cast("string"), "}}"))
        .when(
            e == "finding.detected",
            j('{"finding":{"path":', module, ',"line":', (F.col("k") % 2).cast("string"), ',"symbol":"fn","layer":"data","severity":"high"}}'),
        )
        .when(e == "context.updated", j('{"what":"store-', (F.col("k") % 3).cast("string"), '","count":', k, "}"))
        .when(
            e == "review.completed",
            j('{"report":{"usd":', F.col("value").cast("string"), ',"coverage":{"analysed":["a","b"]}}}'),
        )
        .when(e == "review.failed", j('{"detail":"stopped at ', k, '"}'))
        .when((e == "model.built") & (F.col("k") > 90), F.lit('{"layers": ['))
        .otherwise(F.lit("{}"))
    )


@remembered
def events(spark: SparkSession, sf: str) -> DataFrame:
    return numbered_events(spark, sf).select("run_id", "seq", "offset_ms", "event", event_payload().alias("data"))


@remembered
def source_files(spark: SparkSession, sf: str) -> DataFrame:
    """One small repository per run of parts: every template once, the part's name woven in."""
    rows = [(i, p, x) for i, (p, x) in enumerate(TEMPLATES)]
    shapes = F.broadcast(spark.createDataFrame(rows, "tid int, path string, text string"))
    # each part is a file to parse: a few row groups of short rows would keep that work in as many tasks
    parts = view(spark, sf, "source_parts").repartition(4 * spark.sparkContext.defaultParallelism)
    joined = parts.join(shapes, "tid")
    path = F.when(F.col("bare") & (F.col("path") == "docker-compose.yml"), F.lit("docs/notes.md")).otherwise(F.col("path"))
    text = F.replace("text", F.lit("@N"), F.col("nm"))
    return joined.select(
        "repo_id", path.alias("path"), F.length(text).cast("bigint").alias("size"), F.lit(False).alias("is_symlink"), text.alias("text")
    )
