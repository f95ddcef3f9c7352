"""Bound queries over run records: logs, events, journals, calls and their files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import dims, schemas
from plumbline.operators import commands, cost, deployment, gates, ranking
from plumbline.operators.grading import recall  # noqa: F401
from plumbline.plans import bindings as b
from plumbline.plans.catalog import query
from plumbline.plans.graph_queries import RANKED, coverage, mapped
from plumbline.plans.grading_queries import GATED
from plumbline.session import cut_lineage, shared_dir
from plumbline.sources import document, jsonl, tree
from plumbline.streaming import events as ev
from plumbline.streaming import live

EV = ("events_flat",)
EVENTS = """
e AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS seq FROM events_flat),
ok AS (SELECT * FROM e WHERE event NOT IN ('debug.noise', 'agent.paused') AND NOT (event = 'model.built' AND k > 90))"""


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder in the shared directory, one per run of a query."""
    return f"{shared_dir(spark)}/plumbline-{what}-{uuid.uuid4().hex}"


def one_file_each(rows: DataFrame, folder: str, by: str, kind: str) -> None:
    """The rows as files of ``kind`` (text, json), those of each value of ``by`` in a folder of their own."""
    local = tree.local_folder(folder)
    if local is None:  # the tasks rename their files themselves
        rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(by).format(kind).save(folder)
    elif kind == "json":
        whole = F.to_json(F.struct(*[c for c in rows.columns if c != by]))
        tree.write_files(rows.select(by, whole.alias("value")), local, by, "json")
    else:
        tree.write_files(rows, local, by, "txt")


@b.remembered
def typed(spark, sf) -> DataFrame:
    return ev.typed_events(b.events(spark, sf))[0]


@query("ST1_typed_events", EVENTS + """
SELECT run_id, seq, string_split(event, '.')[1] AS subject, string_split(event, '.')[2] AS verb, NULL AS reason,
  CASE WHEN event = 'agent.started' THEN 'src/m' || (k % 9) || '.py' END AS module, CASE WHEN event = 'agent.finished' THEN round(value, 6) END AS usd FROM ok
UNION ALL SELECT run_id, seq, NULL, NULL, CASE WHEN event = 'model.built' THEN 'payload is not JSON' ELSE 'unknown event' END, NULL, NULL FROM e
WHERE event IN ('debug.noise', 'agent.paused') OR (event = 'model.built' AND k > 90)
""", EV)
def _(spark, sf):
    good, bad = ev.typed_events(b.events(spark, sf))
    return good.select("run_id", "seq", "subject", "verb", "payload.module", F.col("payload.usage.usd").alias("usd")).unionByName(
        bad.select("run_id", "seq", "reason"), allowMissingColumns=True
    )


# -- steps -----------------------------------------------------------------------------------------


@b.remembered
def steps(spark, sf) -> DataFrame:
    """Recorded steps: who acted is the event's k, the module is the part carrying the user's number."""
    flat = b.numbered_events(spark, sf)
    mods = b.view(spark, sf, "modules_flat").select(F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("run_id"), "path")
    k = F.col("k") % 4
    q = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    chosen = F.lit('["concurrency"," DATA ","invented"]')
    return flat.join(mods, "run_id").select(
        "run_id",
        "seq",
        F.col("ts").cast("timestamp").alias("at"),
        F.when(k == 0, F.lit("triage")).when(k == 1, q("triage:", F.col("path"))).when(k == 2, F.lit("analyst:data")).otherwise(F.lit("scheduler")).alias("agent"),
        F.when(k == 2, F.lit("model_call")).otherwise(F.lit("skipped")).alias("action"),
        (k == 2).alias("model_call"),
        F.when(k == 0, q('{"path":"', F.col("path"), '","specialists":', chosen, ',"why":"one allowed"}')).otherwise(F.lit("{}")).alias("detail"),
        F.when(k == 1, q('{"specialists":', chosen, ',"reasoning":""}')).when(k == 2, F.lit('{"findings":[{"path":"a"},{"path":"b"}]}')).alias("response"),
        F.when(
            k == 2,
            F.struct(
                F.col("k").alias("input_tokens"), (F.col("k") * 2).alias("output_tokens"), F.col("value").alias("usd")
            ),
        ).alias("usage"),
        F.lit(0).alias("retries"),
    )


@query("ST2_narrate_steps", EVENTS + """,
s AS (SELECT e.run_id, seq, k % 4 AS who, m.path, list_contains(string_split(signals, ','), 'concurrency') AS c, list_contains(string_split(signals, ','), 'data') AS d
  FROM e JOIN modules_flat m ON e.run_id = 'u' || m.p_partkey)
SELECT run_id, seq, 'agent.handoff' AS event, 'analyst' AS agent, NULL AS layer, path, 'one allowed' AS why, NULL::BIGINT AS findings FROM s WHERE who = 0 AND (c OR d)
UNION ALL SELECT run_id, seq, 'agent.started', 'analyst:concurrency', 'concurrency', path, NULL, NULL FROM s WHERE who IN (0, 1) AND c
UNION ALL SELECT run_id, seq, 'agent.started', 'analyst:data', 'data', path, NULL, NULL FROM s WHERE who IN (0, 1) AND d
UNION ALL SELECT run_id, seq, 'agent.finished', 'analyst:data', NULL, NULL, NULL, 2 FROM s WHERE who = 2
""", (*EV, "modules_flat"))
def _(spark, sf):
    repos = b.view(spark, sf, "modules_flat").select(F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("run_id"), "repo_id")
    return ev.narrate(steps(spark, sf).join(repos, "run_id"), b.modules(spark, sf)).drop("pos")


STAGED = ", ".join(f"('{e}', {dims.STAGES.index(s) + 1})" for e, s in dims.STAGE_OF_EVENT.items())
STATE = EVENTS + f""",
sg(event, i) AS (VALUES {STAGED}),
st AS (SELECT ok.run_id, seq, ok.event, i FROM ok LEFT JOIN sg USING (event)),
stages AS (SELECT run_id, {', '.join(f"coalesce(arg_max(CASE WHEN event = 'review.completed' OR i > {n} THEN 'done' WHEN i = {n} THEN 'running' END, seq) FILTER (WHERE event = 'review.completed' OR i >= {n}), 'waiting') AS {s}" for n, s in enumerate(dims.STAGES, 1))} FROM st GROUP BY run_id),
touch AS (SELECT run_id, seq, 'src/m' || (k % 9) || '.py' AS path, event FROM ok WHERE event IN ('agent.started', 'finding.detected')),
ends AS (SELECT run_id, max(seq) AS ended FROM ok WHERE event = 'review.completed' GROUP BY ALL),
fs AS (SELECT t.run_id, path, min(seq) AS first_seq, CASE WHEN arg_max(event, seq) = 'finding.detected' THEN 'flagged' WHEN any_value(ended) > max(seq) THEN 'read' ELSE 'reading' END AS state
  FROM touch t LEFT JOIN ends USING (run_id) GROUP BY t.run_id, path)"""


RUN_STATE = STATE + """,
f AS (SELECT run_id, coalesce(arg_max('model-' || (k % 3), seq) FILTER (WHERE event = 'review.started'), '') AS model, coalesce(arg_max('stopped at ' || k, seq) FILTER (WHERE event = 'review.failed'), '') AS failed,
  coalesce(arg_max(k, seq) FILTER (WHERE event = 'structure.discovered'), 0) AS total, max(seq) FILTER (WHERE event = 'agent.started') AS st, max(seq) FILTER (WHERE event = 'review.completed') AS en FROM ok GROUP BY run_id),
c AS (SELECT run_id, count(*) FILTER (WHERE first_seq <= st) AS opened, count(*) FILTER (WHERE state = 'flagged') AS flagged FROM fs JOIN f USING (run_id) GROUP BY ALL)
SELECT s.*, model, failed, total, CASE WHEN en IS NOT NULL AND NOT coalesce(st > en, false) THEN 2 ELSE coalesce(opened, 0) END AS read, coalesce(flagged, 0) AS flagged
FROM stages s JOIN f USING (run_id) LEFT JOIN c USING (run_id)
"""
FILE_STATES = STATE + " SELECT run_id, path, state, first_seq FROM fs"


@query("ST3_live_run_state", RUN_STATE, EV)
def _(spark, sf):
    return ev.live_run_state(typed(spark, sf))


@query("ST3b_file_states", FILE_STATES, EV)
def _(spark, sf):
    return ev.file_states(typed(spark, sf))


def watched(spark, sf) -> DataFrame:
    """The events as a log of files, folded by a stream that drains it."""
    log, folder = scratch(spark, "event-log"), scratch(spark, "live")
    events = b.events(spark, sf)
    events.repartitionByRange("seq").write.parquet(log)
    stream = spark.readStream.schema(events.schema).option("maxBytesPerTrigger", 256 << 20).parquet(log)
    return live.latest(live.drain(live.live_runs(stream), folder))


@query("ST3c_streamed_run_state", RUN_STATE, EV)
def _(spark, sf):
    return live.run_states(watched(spark, sf))


@query("ST3d_streamed_file_states", FILE_STATES, EV)
def _(spark, sf):
    return live.file_states(watched(spark, sf))


@query("ST4_dedupe_findings", EVENTS + """
SELECT run_id, 'src/m' || (k % 9) || '.py' AS path, (k % 2) AS line, min(seq) AS seq FROM ok WHERE event = 'finding.detected' GROUP BY run_id, k % 9, k % 2
""", EV)
def _(spark, sf):
    return ev.dedupe_findings(typed(spark, sf)).select("run_id", "path", "line", "seq")


SPEND = EVENTS + """,
m AS (SELECT *, last_value(CASE WHEN event = 'review.started' THEN 'model-' || (k % 3) END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS model FROM ok)
SELECT run_id, coalesce(model, 'model') AS model, round(sum(value), 6) AS usd, count(*) AS calls FROM m WHERE event = 'agent.finished' GROUP BY ALL
UNION ALL SELECT run_id, 'total', round(coalesce(any_value(final), 0.0) + coalesce(sum(value) FILTER (WHERE event = 'agent.finished' AND (ended IS NULL OR seq > ended)), 0.0), 6), count(*) FILTER (WHERE event = 'agent.finished')
FROM ok LEFT JOIN (SELECT run_id, max(seq) AS ended, arg_max(value, seq) AS final FROM ok WHERE event = 'review.completed' GROUP BY run_id) USING (run_id) GROUP BY run_id
"""


@query("ST5b_streamed_spend", SPEND, EV)
def _(spark, sf):
    return live.spend(watched(spark, sf))


@query("ST5_live_spend", SPEND, EV)
def _(spark, sf):
    t = typed(spark, sf)
    return ev.live_spend(t).unionByName(ev.run_spend(t).withColumn("model", F.lit("total")))


@query("ST6_context_counters", EVENTS + " SELECT run_id, 'store-' || (k % 3) AS counter, arg_max(k, seq) AS value FROM ok WHERE event = 'context.updated' GROUP BY run_id, k % 3", EV)
def _(spark, sf):
    return ev.context_counters(typed(spark, sf))


@query("ST8_terminal_runs", EVENTS + """
SELECT run_id, bool_or(event = 'review.completed') AS completed, bool_or(event = 'review.failed') AS failed, NOT bool_or(event IN ('review.completed', 'review.failed')) AS open FROM ok GROUP BY ALL
""", EV)
def _(spark, sf):
    return ev.terminal_runs(typed(spark, sf))


@query("W06_sequence_check", EVENTS + """,
g AS (SELECT * FROM e WHERE k % 10 <> 0 UNION ALL SELECT * FROM e WHERE k % 10 = 1),
l AS (SELECT *, lag(offset_ms) OVER (PARTITION BY run_id ORDER BY seq, offset_ms) AS p FROM g)
SELECT run_id, count(*) AS events, max(seq) AS last_seq, max(seq) - count(DISTINCT seq) AS gaps, count(*) - count(DISTINCT seq) AS duplicates, count(*) FILTER (WHERE offset_ms < p) AS backward_steps,
  min(seq) = 1 AND max(seq) = count(*) AND count(DISTINCT seq) = count(*) AS in_order FROM l GROUP BY ALL
""", EV)
def _(spark, sf):
    """Some events are lost and some arrive twice."""
    e = b.numbered_events(spark, sf)
    kept = e.filter("k % 10 <> 0").unionByName(e.filter("k % 10 = 1"))
    return ev.sequence_check(kept)


@query("W07_agent_spans", EVENTS + """,
m AS (SELECT run_id, 'a' || (k % 3) AS agent, seq, offset_ms AS moment, event = 'agent.started' AS starts, row_number() OVER (PARTITION BY run_id, k % 3 ORDER BY seq) AS r FROM e),
walk(run_id, agent, r, seq, moment, opens, held) AS (
  SELECT run_id, agent, r, seq, moment, TRUE, CAST(1 AS BIGINT) FROM m WHERE r = 1
  UNION ALL SELECT m.run_id, m.agent, m.r, m.seq, m.moment, m.starts OR w.held = 0, CASE WHEN m.starts OR w.held = 0 THEN w.held + 1 ELSE w.held - 1 END
  FROM walk w JOIN m ON m.run_id = w.run_id AND m.agent = w.agent AND m.r = w.r + 1),
c AS (SELECT *, row_number() OVER (PARTITION BY run_id, agent, opens ORDER BY seq) AS n FROM walk)
SELECT o.run_id, o.agent, o.n, o.moment AS started_at, CASE WHEN x.moment IS NOT NULL THEN greatest(x.moment, o.moment) END AS ended_at
FROM c o LEFT JOIN c x ON x.run_id = o.run_id AND x.agent = o.agent AND x.n = o.n AND NOT x.opens WHERE o.opens
""", EV)
def _(spark, sf):
    """A first-in first-out walk; the SQL takes it mention by mention."""
    e = b.numbered_events(spark, sf)
    return ev.agent_spans(
        e.select("run_id", F.concat(F.lit("a"), (F.col("k") % 3).cast("string")).alias("agent"), "seq", F.col("offset_ms").alias("at"), (F.col("event") == "agent.started").alias("is_start"))
    )


@query("W09_recent_steps", EVENTS + " SELECT run_id, seq, event FROM e QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) <= 400", EV)
def _(spark, sf):
    return ranking.recent_steps(b.events(spark, sf)).select("run_id", "seq", "event")


# -- journals and calls ------------------------------------------------------------------------------


def journal(spark, sf) -> DataFrame:
    """First turns begin a run, assistant turns finish it."""
    t = b.view(spark, sf, "turns").filter("turn = 0 or role = 'assistant'")
    begin = F.col("turn") == 0
    stamp = F.concat(F.lit("2026-01-01 00:00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"))
    return t.select(
        "n",
        F.when(begin, "begin").otherwise("finish").alias("event"),
        "run_id",
        F.when(begin, F.col("role")).alias("model"),
        F.when(begin, F.lit("")).alias("scope"),
        F.when(begin, (F.col("chars") % 300).cast("int")).alias("modules"),
        F.when(begin, stamp).alias("started_at"),
        F.when(~begin, stamp).alias("finished_at"),
        F.when(~begin, (F.col("chars") % 100).cast("int")).alias("read"),
        F.when(~begin, (F.col("chars") % 7).cast("int")).alias("findings"),
        F.when(~begin, F.col("chars") / 1000.0).alias("usd"),
        F.when(~begin, F.lit("r.md")).alias("report"),
    )


HISTORY = """
b AS (SELECT * FROM turns WHERE turn = 0), f AS (SELECT run_id, arg_max(turn, n) AS turn, arg_max(chars, n) AS chars FROM turns WHERE turn > 0 AND role = 'assistant' GROUP BY ALL),
h AS (SELECT b.run_id, b.n AS begun, b.role AS model, b.chars % 300 AS modules, f.turn IS NULL AS interrupted, coalesce(f.chars % 100, 0) AS read, coalesce(f.chars % 7, 0) AS findings, coalesce(f.chars / 1000.0::DOUBLE, 0) AS usd,
  CASE WHEN f.turn IS NULL THEN '' ELSE '2026-01-01 00:00:' || lpad((f.turn % 60)::VARCHAR, 2, '0') END AS finished_at FROM b LEFT JOIN f USING (run_id))"""


@query("ST7_run_history", HISTORY + """
SELECT run_id, begun, model, modules, interrupted, read, findings, round(usd, 6) AS usd, finished_at, CASE WHEN interrupted THEN '2026-01-01 00:00:00  interrupted after 0 of ' || modules || ' modules, $0.0000 spent'
  ELSE '2026-01-01 00:00:00  read ' || read || ' of ' || modules || ' modules, ' || findings || ' findings, $' || printf('%.4f', usd) || ', r.md' END AS summary FROM h
""", ("turns",))
def _(spark, sf):
    runs = ev.run_history(journal(spark, sf))
    return runs.select("run_id", "begun", "model", "modules", "interrupted", "read", "findings", "usd", "finished_at", "summary")


@query("S04_scan_journal", HISTORY + " SELECT run_id, modules, interrupted, read, round(usd, 6) AS usd FROM h", ("turns",))
def _(spark, sf):
    """The journal written as lines, torn and foreign lines among them, read back and folded."""
    folder = scratch(spark, "journal")
    lines = journal(spark, sf)
    whole = lines.select(F.to_json(F.struct("n", *[c for c in lines.columns if c != "n"])).alias("value"))
    torn = lines.select(F.expr("explode(array('', '[1, 2]', concat('{\"event\": \"begin\", \"run_id\": \"', run_id)))").alias("value"))
    whole.unionByName(torn).write.text(folder)
    back = jsonl.scan_journal(spark, folder).withColumn(
        "n", F.when(F.col("event") == "begin", 0).otherwise(1 + F.substring("finished_at", 18, 2).cast("int"))
    )
    return ev.run_history(back).select("run_id", "modules", "interrupted", "read", "usd")


@query("S03_scan_trajectory", EVENTS + """
SELECT e.run_id, seq, CASE k % 4 WHEN 0 THEN 'triage' WHEN 1 THEN 'triage:' || m.path WHEN 2 THEN 'analyst:data' ELSE 'scheduler' END AS agent, k % 4 = 2 AS model_call, CASE WHEN k % 4 = 2 THEN round(value, 6) END AS usd
FROM e JOIN modules_flat m ON e.run_id = 'u' || m.p_partkey
""", (*EV, "modules_flat"))
def _(spark, sf):
    folder = scratch(spark, "steps")
    lines = steps(spark, sf).select(F.to_json(F.struct("*")).alias("value"))
    lines.unionByName(lines.select(F.substring("value", 1, 30).alias("value"))).write.text(folder)
    return jsonl.scan_trajectory(spark, folder).select("run_id", "seq", "agent", "model_call", "usage.usd")


@query("S10_sink_steps", EVENTS + """
SELECT e.run_id, seq, 'said REDACTED and left' AS detail FROM e JOIN modules_flat m ON e.run_id = 'u' || m.p_partkey
""", (*EV, "modules_flat"))
def _(spark, sf):
    folder = scratch(spark, "sink")
    told = steps(spark, sf).withColumn("detail", F.concat(F.lit("said api_key=k"), F.col("seq").cast("string"), F.lit(" and left")))
    jsonl.sink_steps(told, folder)
    return jsonl.scan_trajectory(spark, folder).select("run_id", "seq", "detail")


@query("S05_scan_cases", """
d AS (SELECT case_id, id, count(DISTINCT path) AS locations, any_value(expected_metric) AS expected_metric FROM defects_flat GROUP BY case_id, id)
SELECT case_id, id, locations, expected_metric, count(*) OVER (PARTITION BY case_id) AS seeded FROM d
""", ("defects_flat",))
def _(spark, sf):
    """One manifest per case, written and read back."""
    folder = scratch(spark, "cases")
    d = b.defects(spark, sf)
    one = F.struct(
        "id", F.lit("topic").alias("lab_topic"), F.lit("seeded").alias("defect"), "locations", "symbols", F.lit("probe").alias("verification"), "expected_metric"
    )
    # a manifest is one file: its defects are what one case seeds
    d.groupBy(F.col("case_id").alias("id"), F.col("case_id").alias("folder")).agg(F.collect_list(one).alias("defects")).withColumn(
        "name", F.col("id")
    ).write.partitionBy("folder").json(folder)
    cases, found = jsonl.scan_cases(spark, folder, "*.json")
    return found.join(cases.select("case_id", "seeded"), "case_id").select("case_id", "id", F.size("locations").alias("locations"), "expected_metric", "seeded")


@query("S06_scan_recordings", """
c AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY ALL)
SELECT 'k' || conv_id AS key, CASE conv_id % 3 WHEN 0 THEN 'findings' WHEN 1 THEN 'routing' ELSE 'observations' END AS kind, n AS items FROM c
""", ("turns",))
def _(spark, sf):
    folder = scratch(spark, "recordings")
    c = b.view(spark, sf, "turns").groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    many = lambda col: F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: col)
    shape = F.col("conv_id") % 3
    recordings = c.select(
        F.concat(F.lit("k"), F.col("conv_id").cast("string")).alias("key"),
        F.when(shape == 0, many(F.struct(F.lit("a.py").alias("path"), F.lit(1).alias("line")))).alias("findings"),
        F.when(shape == 1, many(F.lit("data"))).alias("specialists"),
        F.when(shape == 2, many(F.struct(F.lit("m").alias("mechanism"), F.array(F.lit(1)).alias("findings")))).alias("observations"),
    )
    # so few bytes of counts would be put together into one task, which then wrote every file
    one_file_each(recordings.repartition(2 * spark.sparkContext.defaultParallelism, "key"), folder, "key", "json")
    rows = jsonl.scan_recordings(spark, folder, key_from="folder")
    items = F.coalesce(F.when(F.col("kind") == "findings", F.size("findings")), F.when(F.col("kind") == "routing", F.size("specialists")), F.size("observations"))
    return rows.select("key", "kind", items.alias("items"))


@query("S01_scan_source_tree", "SELECT page_id::VARCHAR AS page, octet_length(encode(html)) + 1 AS size, md5(html || chr(10)) AS text FROM pages")
def _(spark, sf):
    """Every page written as a file of its own, and the tree read back."""
    folder = scratch(spark, "tree")
    one_file_each(b.table(spark, sf, "pages").select("page_id", F.col("html").alias("value")), folder, "page_id", "text")
    found = tree.scan_source_tree(spark, folder).filter("path like '%.txt'")
    return found.select(F.regexp_extract("path", "page_id=([0-9]+)", 1).alias("page"), "size", F.md5("text").alias("text"))


def calls(spark, sf) -> DataFrame:
    t = b.view(spark, sf, "turns")
    models = F.array(F.lit("gpt-4o"), F.lit("claude-haiku-4-5"), F.lit("openai/gpt-oss-20b"))
    return t.select(
        "run_id", F.element_at(models, ((F.col("conv_id") + F.col("turn")) % 3 + 1).cast("int")).alias("model"), F.col("role").alias("agent"),
        F.col("chars").alias("input_tokens"), F.floor(F.col("chars") / 2).alias("output_tokens"), "n",
    )


CALLS = """
c AS (SELECT run_id, n, role AS agent, ['gpt-4o', 'claude-haiku-4-5', 'openai/gpt-oss-20b'][((conv_id + turn) % 3 + 1)::INT] AS model, chars AS it, chars // 2 AS ot FROM turns),
p(model, i, o) AS (VALUES ('gpt-4o', 2.5, 10.0), ('claude-haiku-4-5', 1.0, 5.0), ('openai/gpt-oss-20b', 0.1, 0.5)),
pr AS (SELECT c.*, (it * i::DOUBLE + ot * o::DOUBLE) / 1000000 AS usd FROM c JOIN p USING (model))"""


@query("J14_price_calls", CALLS + " SELECT run_id, n, model, round(usd, 6) AS usd FROM pr", ("turns",))
def _(spark, sf):
    return cost.price_calls(calls(spark, sf)).select("run_id", "n", "model", "usd")


@query("A12_usage_by_run", CALLS + " SELECT run_id, model, agent, count(*) AS calls, sum(it)::BIGINT AS input_tokens, sum(ot)::BIGINT AS output_tokens, round(sum(usd), 6) AS usd FROM pr GROUP BY ALL", ("turns",))
def _(spark, sf):
    return cost.usage_by_run(cost.price_calls(calls(spark, sf)))


def questions(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Every turn asks; what the earlier half of each conversation asked is remembered."""
    t = b.table(spark, sf, "conversations").select(
        F.col("role").alias("model"), F.col("text").alias("source"), F.lit("data").alias("layer"), F.lit("python").alias("language"),
        F.concat(F.lit("p"), (F.col("turn") % 2).cast("string")).alias("prompt"), "conv_id", "turn",
    )
    memo = t.filter("turn < 2").withColumn("key", cost.question_key()).groupBy("key").agg(F.min("conv_id").cast("string").alias("answer"))
    return t, memo


MEMO = """
q AS (SELECT *, length(role) || ':' || role || length(text) || ':' || text || '4:data' || '6:python' || '2:p' || (turn % 2) AS k FROM conversations),
m AS (SELECT sha256(k) AS key, min(conv_id)::VARCHAR AS answer FROM q WHERE turn < 2 GROUP BY ALL),
r AS (SELECT conv_id, turn, sha256(k) AS key FROM q)"""


@query("J18_recall_answers", MEMO + " SELECT conv_id, turn, r.key, m.answer FROM r LEFT JOIN m USING (key)")
def _(spark, sf):
    hits, misses = cost.recall_answers(*questions(spark, sf))
    cols = ["conv_id", "turn", "key"]
    return hits.select(*cols, "answer").unionByName(misses.select(*cols), allowMissingColumns=True)


@query("A18_memo_hit_rate", MEMO + " SELECT 'p' || (turn % 2) AS store, count(m.key) AS hits, count(*) - count(m.key) AS misses, round(count(m.key) / count(*), 6) AS hit_rate FROM r LEFT JOIN m USING (key) GROUP BY ALL")
def _(spark, sf):
    hits, misses = cost.recall_answers(*questions(spark, sf))
    looked = hits.select(F.col("prompt").alias("store"), F.lit(True).alias("hit")).unionByName(misses.select(F.col("prompt").alias("store"), F.lit(False).alias("hit")))
    return cost.memo_stats(looked)


# -- logs --------------------------------------------------------------------------------------------------


@query("T11_settle_experiment_logs", """
s AS (SELECT *, CASE shape WHEN 0 THEN 'setup 3' || chr(10) || q || chr(10) WHEN 1 THEN 'done' WHEN 2 THEN q || '.5' || chr(10) || 'bye' WHEN 3 THEN 'nan' ELSE '' END AS stdout FROM logs_flat)
SELECT ord, CASE WHEN timed_out OR exit_code <> 0 THEN NULL WHEN shape = 0 THEN q::DOUBLE WHEN shape = 2 THEN q + 0.5::DOUBLE WHEN shape = 3 THEN 'nan'::DOUBLE END AS value,
  CASE WHEN timed_out THEN 'experiment timed out after 120s' WHEN exit_code <> 0 THEN 'experiment exited 1: ' || stderr WHEN shape IN (1, 4) THEN 'experiment printed no number on its last line' ELSE trim(stdout, chr(10)) END AS detail,
  CASE WHEN exit_code <> 0 THEN CASE WHEN stderr = '' THEN 'no error output, and no number printed' WHEN contains(stderr, 'app.db') THEN '`app.db` was not importable under python: run from the wrong path' WHEN contains(stderr, 'jwt') THEN '`jwt` is not installed in python' ELSE 'boom' END END AS diagnosis FROM s
""", ("logs_flat",))
def _(spark, sf):
    q = F.col("q").cast("string")
    shape = F.col("shape")
    stdout = (
        F.when(shape == 0, F.concat(F.lit("setup 3\n"), q, F.lit("\n"))).when(shape == 1, F.lit("done"))
        .when(shape == 2, F.concat(q, F.lit(".5\nbye"))).when(shape == 3, F.lit("nan")).otherwise(F.lit(""))
    )
    out = commands.settle_logs(b.view(spark, sf, "logs_flat").withColumn("stdout", stdout))
    return out.select("ord", "value", "detail", "diagnosis")


@query("T12_rate_limit_waits", """
t AS (SELECT run_id, chars, turn FROM turns)
SELECT run_id, count(*) AS n, count(*) FILTER (WHERE turn % 3 < 2) AS stated, round(coalesce(sum(CASE turn % 3 WHEN 0 THEN chars / 1000.0::DOUBLE WHEN 1 THEN chars + 0.5::DOUBLE END), 0), 6) AS wait_s FROM t WHERE chars % 5 <> 0 GROUP BY ALL
""", ("turns",))
def _(spark, sf):
    chars = F.col("chars").cast("string")
    said = (
        F.when(F.col("chars") % 5 == 0, F.lit("connection reset"))
        .when(F.col("turn") % 3 == 0, F.concat(F.lit("Error 429: please Try again in "), chars, F.lit("ms.")))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("Rate limit reached, try again in "), chars, F.lit(".5s")))
        .otherwise(F.lit("Too Many Requests"))
    )
    return commands.rate_limit_waits(b.view(spark, sf, "turns").select("run_id", said.alias("message")))


# -- the document -----------------------------------------------------------------------------------------------


@b.remembered
def sections(spark, sf) -> DataFrame:
    mods = cut_lineage(mapped(spark, sf))  # read five times below
    cover = coverage(spark, sf)
    reports = mods.groupBy("repo_id").agg((F.count(F.lit(1)) / 1000.0).alias("usd"), F.lit("budget exhausted").alias("stopped_because"))
    lost = mods.groupBy("repo_id").agg(F.count_if(F.col("depth").isNull()).alias("unreachable"))
    shares = cost.read_share(cover, mods, reports).join(lost, "repo_id")
    kept, dropped = gates.normalise_drafts(b.drafts(spark, sf), keys=["repo_id"])
    found = kept.withColumn("measurement", F.lit(None).cast(schemas.MEASUREMENT))
    schema = deployment.migration_rules(b.operations(spark, sf))
    none = schema.limit(0)
    services = b.services(spark, sf)
    return document.document_sections(shares, found, dropped, deployment.memory_limits(services), schema, none, services, modules=mods)


@query("S11_sink_review_document", GATED + "," + RANKED.strip() + """,
fresh AS (SELECT DISTINCT repo_id, path, tbl FROM operations_flat WHERE kind = 'create_table'), old AS (SELECT o.* FROM operations_flat o LEFT JOIN fresh f USING (repo_id, path, tbl) WHERE f.tbl IS NULL),
idx AS (SELECT DISTINCT repo_id, tbl, unnest(string_split(cols, ',')) AS c FROM operations_flat WHERE kind = 'create_index' AND cols <> ''),
fk AS (SELECT DISTINCT f.repo_id, path, line, f.tbl FROM (SELECT *, unnest(string_split(cols, ',')) AS c FROM operations_flat WHERE kind = 'create_foreign_key' AND cols <> '') f LEFT JOIN idx ON idx.repo_id = f.repo_id AND idx.tbl = f.tbl AND idx.c = f.c WHERE idx.c IS NULL),
sch AS (SELECT repo_id FROM old WHERE kind = 'add_column' AND kw = 'nullable=False' UNION ALL SELECT repo_id FROM old WHERE kind = 'create_index' AND kw <> 'postgresql_concurrently=True'
  UNION ALL SELECT repo_id FROM operations_flat WHERE kind = 'drop_column' UNION ALL SELECT repo_id FROM fk),
repos AS (SELECT repo_id, count(*) AS k FROM modules_flat GROUP BY ALL),
fc AS (SELECT repo_id, count(*) AS n FROM findings_flat GROUP BY ALL), gone AS (SELECT repo_id, count(*) AS n FROM judged WHERE reject_reason IS NOT NULL GROUP BY ALL),
sv AS (SELECT repo_id, count(*) AS n, count(*) FILTER (WHERE NOT has_memory_limit) AS bad FROM services_flat GROUP BY ALL), sc2 AS (SELECT repo_id, count(*) AS n FROM sch GROUP BY ALL)
SELECT repo_id, section::BIGINT AS section, n FROM (SELECT repo_id, 0 AS section, 1 AS n FROM repos UNION ALL SELECT repo_id, 1, 2 + coalesce(sv.n, 0) FROM repos LEFT JOIN sv USING (repo_id) UNION ALL SELECT repo_id, 2, 1 FROM repos
UNION ALL SELECT repo_id, 3, bad + 1 FROM sv WHERE bad > 0 UNION ALL SELECT repo_id, 4, 1 + coalesce(n, 0) FROM repos LEFT JOIN sc2 USING (repo_id) UNION ALL SELECT repo_id, 5, 1 FROM repos
UNION ALL SELECT repo_id, 7, 1 + least(n, 20) + (n > 20)::INT FROM fc UNION ALL SELECT repo_id, 9, n + 1 FROM gone UNION ALL SELECT repo_id, 10, 1 FROM repos)
""", ("modules_flat", "edges_flat", "findings_flat", "operations_flat", "services_flat"))
def _(spark, sf):
    """Rows of every section of each repository's document; the text itself is a unit test."""
    return sections(spark, sf).groupBy("repo_id", "section").agg(F.count("text").alias("n"))


@query("S11b_document_head", """
r AS (SELECT repo_id, count(*) AS k, count(*) / 1000.0::DOUBLE AS usd FROM modules_flat GROUP BY ALL),
n AS (SELECT repo_id, count(*) AS n FROM reads_flat GROUP BY ALL)
SELECT repo_id, '## What was actually read' || chr(10) || chr(10) || 'This review **read ' || coalesce(n, 0) || ' of ' || k || ' modules** (' || printf('%.1f', round(100.0::DOUBLE * coalesce(n, 0) / k, 1)) || '%), spent $' || printf('%.4f', usd) || ', and stopped because budget exhausted.' AS text
FROM r LEFT JOIN n USING (repo_id)
""", ("modules_flat", "reads_flat"))
def _(spark, sf):
    return sections(spark, sf).filter("section = 2").select("repo_id", "text")
