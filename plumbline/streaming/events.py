"""Run-event streams (ST1-ST8, W06, W07).

Event rows are ``(run_id, seq, offset_ms, event, data)``, ``data`` being JSON. The stateless operators
and the plain aggregations take batch or streaming frames alike; what a fold needs beyond that is
written once for a batch and, where it differs, once for a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import dims
from plumbline.operators.graph import allowed_layers
from plumbline.operators.scan import carried, running_sum, spread_join
from plumbline.session import cut_lineage

PAYLOAD = (
    "model string, root string, name string, scope string, language string, modules int, framework string, "
    "evidence string, service string, sourceRoot string, command string, capacity int, reachable int, "
    "agent string, layer string, module string, `from` string, `to` string, why string, findings int, "
    "subject string, source string, found boolean, what string, count bigint, detail string, "
    "finding struct<path:string,line:int,symbol:string,layer:string,severity:string>, "
    "usage struct<input_tokens:bigint,output_tokens:bigint,usd:double>, "
    "report struct<usd:double,coverage:struct<analysed:array<string>>>"
)
SLICE = 20_000
#: Slices of a run that one node of the tree of open spans composes.
FAN = 64


def rejection() -> Column:
    """Why an event (columns ``event`` and ``data``) is not admitted; null if it is."""
    known = F.col("event").isin(*dims.EVENT_NAMES)
    bad = F.get_json_object(F.coalesce("data", F.lit("{}")), "$").isNull()
    return F.when(~F.coalesce(known, F.lit(False)), F.lit("unknown event")).when(bad, F.lit("payload is not JSON"))


def typed_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(admitted with subject, verb and parsed payload; rejected with the reason)."""
    payload = F.from_json("data", PAYLOAD, {"mode": "PERMISSIVE"})
    marked = events.withColumn("reason", rejection())
    admitted = (
        marked.filter("reason is null")
        .drop("reason")
        .withColumn("subject", F.split("event", r"\.")[0])
        .withColumn("verb", F.split("event", r"\.")[1])
        .withColumn("payload", payload)
    )
    return admitted, marked.filter("reason is not null")


ANSWER = "specialists array<string>, reasoning string, findings array<string>, path string, why string"


def narrate(steps: DataFrame, modules: DataFrame) -> DataFrame:
    """Recorded steps as events, 0..n each: hand-off, one start per chosen layer, finish.

    ``modules(repo_id?, path, signals)`` is the static side that bounds what triage may choose. Where steps name their
    repository too, only its own modules count.
    """
    place = [c for c in ("repo_id", "path") if c == "path" or (c in steps.columns and c in modules.columns)]
    role = F.element_at(F.split("agent", ":", 2), 1)
    subject = F.coalesce(F.try_element_at(F.split("agent", ":", 2), F.lit(2)), F.lit(""))
    detail, answer = F.from_json("detail", ANSWER), F.from_json("response", ANSWER)
    skipped = F.col("agent") == "triage"
    chosen = (role == "triage") & (subject != "")
    named = F.when(skipped, detail["specialists"]).when(chosen, answer["specialists"])
    read = steps.select(
        *place[:-1],
        "run_id",
        "seq",
        "agent",
        F.when(skipped, detail["path"]).when(chosen, subject).alias("path"),
        F.transform(named, lambda n: F.lower(F.trim(n))).alias("_named"),
        F.coalesce(F.when(skipped, detail["why"]).when(chosen, answer["reasoning"]), F.lit("")).alias("_why"),
        ((role == "analyst") & (subject != "") & (F.col("action") == "model_call")).alias("_finished"),
        F.coalesce(F.size(answer["findings"]), F.lit(0)).alias("_findings"),
    )
    known = modules.select(*place, allowed_layers(F.col("signals")).alias("_allowed"))
    joined = read.join(known, place, "left")
    layers = F.filter(
        F.coalesce("_allowed", F.array().cast("array<string>")), lambda x: F.array_contains(F.col("_named"), x)
    )
    handoff = F.struct(
        F.lit("agent.handoff").alias("event"),
        F.lit("analyst").alias("subject_agent"),
        F.lit(None).cast("string").alias("layer"),
        F.col("_why").alias("why"),
        F.lit(None).cast("int").alias("findings"),
    )
    starts = F.transform(
        "_layers",
        lambda x: F.struct(
            F.lit("agent.started").alias("event"),
            F.concat(F.lit("analyst:"), x).alias("subject_agent"),
            x.alias("layer"),
            F.lit(None).cast("string").alias("why"),
            F.lit(None).cast("int").alias("findings"),
        ),
    )
    finish = F.struct(
        F.lit("agent.finished").alias("event"),
        F.col("agent").alias("subject_agent"),
        F.lit(None).cast("string").alias("layer"),
        F.lit(None).cast("string").alias("why"),
        F.col("_findings").alias("findings"),
    )
    said = F.when(F.col("_finished"), F.array(finish)).when(
        F.size("_layers") > 0, F.when(F.col("_why") != "", F.concat(F.array(handoff), starts)).otherwise(starts)
    )
    return (
        joined.withColumn("_layers", layers)
        .select("run_id", "seq", "path", F.posexplode(said).alias("pos", "e"))
        .select("run_id", "seq", "pos", "e.event", F.col("e.subject_agent").alias("agent"), "e.layer", "path", "e.why", "e.findings")
    )


# -- state of a run ---------------------------------------------------------------------------------


def stage_states(events: DataFrame) -> DataFrame:
    """Per run, each stage's state: the last event at or past a stage decides it. Update mode on a stream."""
    stages = F.array(*[F.lit(s) for s in dims.STAGES])
    reached = F.array_position(stages, dims.choose(F.col("event"), dims.STAGE_OF_EVENT)).cast("int")
    completed = F.col("event") == "review.completed"
    rows = events.withColumn("_at", reached).withColumn("_done", completed)
    out = []
    for i, stage in enumerate(dims.STAGES, 1):
        state = F.when(F.col("_done") | (F.col("_at") > i), F.lit("done")).when(F.col("_at") == i, F.lit("running"))
        last = F.max_by(state, F.when(state.isNotNull(), F.col("seq")))
        out.append(F.coalesce(last, F.lit("waiting")).alias(stage))
    return rows.groupBy("run_id").agg(*out)


def file_states(typed: DataFrame) -> DataFrame:
    """(run_id, path, state): reading, read or flagged; what was being read is read once the run completes."""
    started = F.col("event") == "agent.started"
    found = F.col("event") == "finding.detected"
    path = F.when(started, F.col("payload.module")).when(found, F.col("payload.finding.path"))
    per = (
        typed.withColumn("path", path)
        .filter("path is not null and path <> ''")
        .groupBy("run_id", "path")
        .agg(
            F.max("seq").alias("_last"),
            F.min("seq").alias("_first"),
            F.max_by(F.when(started, F.lit("reading")).otherwise(F.lit("flagged")), "seq").alias("_state"),
        )
    )
    ends = (
        typed.filter("event = 'review.completed'").groupBy("run_id").agg(F.max("seq").alias("_end"))
    )
    return (
        spread_join(per, ends, ["run_id"], "left")
        .withColumn(
            "state",
            F.when((F.col("_state") == "reading") & (F.col("_end") > F.col("_last")), F.lit("read")).otherwise(F.col("_state")),
        )
        .select("run_id", "path", "state", F.col("_first").alias("first_seq"))
    )


def live_run_state(typed: DataFrame) -> DataFrame:
    """One row per run: stages, model, failure, modules read of total. A stream: ``live``."""

    def last(value: Column, when: Column) -> Column:
        return F.max_by(value, F.when(when & value.isNotNull(), F.col("seq")))

    event = F.col("event")
    counted_by_report = (event == "review.completed") & F.col("payload.report.coverage.analysed").isNotNull()
    facts = typed.groupBy("run_id").agg(
        F.coalesce(last(F.col("payload.model"), (event == "review.started") & (F.col("payload.model") != "")), F.lit("")).alias("model"),
        F.coalesce(
            last(F.coalesce("payload.detail", F.lit("the run failed")), event == "review.failed"), F.lit("")
        ).alias("failed"),
        F.coalesce(last(F.col("payload.modules"), event == "structure.discovered"), F.lit(0)).alias("total"),
        F.max(F.when((event == "agent.started") & (F.col("payload.module") != ""), F.col("seq"))).alias("_started"),
        F.max(F.when(counted_by_report, F.col("seq"))).alias("_completed"),
        last(F.size("payload.report.coverage.analysed"), counted_by_report).alias("_analysed"),
    )
    files = file_states(typed)
    counted = (
        spread_join(files, facts.select("run_id", "_started"), ["run_id"])
        .groupBy("run_id")
        .agg(
            F.count_if(F.col("first_seq") <= F.col("_started")).alias("_opened"),
            F.count_if(F.col("state") == "flagged").alias("flagged"),
        )
    )
    opened = F.coalesce("_opened", F.lit(0))
    read = F.when(
        F.col("_analysed").isNotNull() & ~F.coalesce(F.col("_started") > F.col("_completed"), F.lit(False)), F.col("_analysed")
    ).otherwise(opened)
    return (
        facts.join(stage_states(typed), "run_id")
        .join(counted, "run_id", "left")
        .select("run_id", *dims.STAGES, "model", "failed", "total", read.alias("read"), F.coalesce("flagged", F.lit(0)).alias("flagged"))
    )


def dedupe_findings(typed: DataFrame, delay: str | None = None, time: str = "at") -> DataFrame:
    """A re-delivered finding once, by (run, path, line, symbol), the first kept.

    On a stream the state is bounded by ``delay`` on the ``time`` column; on a batch the earliest
    sequence number wins.
    """
    found = typed.filter("event = 'finding.detected'").select("*", "payload.finding.*")
    key = ["run_id", "path", "line", "symbol"]
    if typed.isStreaming:
        return found.withWatermark(time, delay or "1 hour").dropDuplicatesWithinWatermark(key)
    others = [c for c in found.columns if c not in key]
    return (
        found.groupBy(*key)
        .agg(F.min_by(F.struct(*others), "seq").alias("_f"))
        .select(*key, "_f.*")
        .select(*found.columns)
    )


def _slice() -> Column:
    return F.floor(F.col("seq") / SLICE)


def live_spend(typed: DataFrame) -> DataFrame:
    """(run_id, model, usd, calls): spend by the model current at each call, from one pass in order."""
    named = F.when(
        (F.col("event") == "review.started") & (F.coalesce("payload.model", F.lit("")) != ""), F.col("payload.model")
    )
    placed = carried(typed, ["run_id"], [F.col("seq")], _slice(), named, "_model", include_current=False)
    return (
        placed.filter("payload.usage.usd is not null")
        .groupBy("run_id", F.coalesce("_model", F.lit("model")).alias("model"))
        .agg(F.sum("payload.usage.usd").alias("usd"), F.count(F.lit(1)).alias("calls"))
    )


def run_spend(typed: DataFrame) -> DataFrame:
    """(run_id, usd, calls): the final report's total and what was spent after it, or all that was spent. A stream: ``live``."""
    usage = F.col("payload.usage.usd")
    reported = F.col("payload.report.usd")
    final = F.when((F.col("event") == "review.completed") & reported.isNotNull(), F.col("seq"))
    ends = typed.groupBy("run_id").agg(F.max(final).alias("_end"), F.max_by(reported, final).alias("_final"))
    after = F.col("_end").isNull() | (F.col("seq") > F.col("_end"))
    return typed.join(ends, "run_id").groupBy("run_id").agg(
        (F.coalesce(F.first("_final"), F.lit(0.0)) + F.coalesce(F.sum(F.when(after, usage)), F.lit(0.0))).alias("usd"),
        F.count(usage).alias("calls"),
    )


def context_counters(typed: DataFrame) -> DataFrame:
    """The last value of every counter of a run."""
    return (
        typed.filter("event = 'context.updated' and payload.what is not null")
        .groupBy("run_id", F.col("payload.what").alias("counter"))
        .agg(F.max_by(F.coalesce("payload.count", F.lit(0).cast("bigint")), "seq").alias("value"))
    )


def terminal_runs(events: DataFrame) -> DataFrame:
    """(run_id, completed, failed, open): which runs have ended, and which have not."""
    return (
        events.groupBy("run_id")
        .agg(
            F.bool_or(F.col("event") == "review.completed").alias("completed"),
            F.bool_or(F.col("event") == "review.failed").alias("failed"),
        )
        .withColumn("open", ~F.col("completed") & ~F.col("failed"))
    )


# -- history of runs -----------------------------------------------------------------------------------


def run_summary() -> Column:
    spent = F.concat(F.lit("$"), F.format_string("%.4f", "usd"))
    progress = F.concat(F.col("read").cast("string"), F.lit(" of "), F.col("modules").cast("string"), F.lit(" modules, "))
    report = F.when(F.col("report") != "", F.concat(F.lit(", "), F.col("report"))).otherwise(F.lit(""))
    return F.when(
        F.col("interrupted"),
        F.concat("started_at", F.lit("  interrupted after "), progress, spent, F.lit(" spent")),
    ).otherwise(
        F.concat(
            F.col("started_at"), F.lit("  read "), progress, F.col("findings").cast("string"), F.lit(" findings, "), spent, report
        )
    )


def run_history(records: DataFrame, order: str = "n") -> DataFrame:
    """Begin and finish folded into runs. ``order`` numbers the log lines; newest first is ``begun`` desc.

    A finish before any begin is ignored, a later finish overwrites, and a new begin starts over.
    """
    begin = F.col("event") == "begin"
    logged = records.filter(F.coalesce("run_id", F.lit("")) != "")
    begun = logged.filter(begin).groupBy("run_id").agg(
        F.max(order).alias("begun"),
        F.max_by(F.struct("model", "scope", "modules", "started_at"), order).alias("_b"),
    )
    closed = (
        spread_join(logged.filter(~begin), begun.select("run_id", "begun"), ["run_id"])
        .filter(F.col(order) > F.col("begun"))
        .groupBy("run_id")
        .agg(F.max_by(F.struct("finished_at", "read", "findings", "usd", "report"), order).alias("_f"))
    )
    runs = begun.join(closed, "run_id", "left").select(
        "run_id",
        "begun",
        *[F.coalesce(f"_b.{c}", F.lit("")).alias(c) for c in ("model", "scope", "started_at")],
        F.coalesce("_b.modules", F.lit(0)).alias("modules"),
        F.coalesce("_f.finished_at", F.lit("")).alias("finished_at"),
        F.coalesce("_f.read", F.lit(0)).alias("read"),
        F.coalesce("_f.findings", F.lit(0)).alias("findings"),
        F.coalesce("_f.usd", F.lit(0.0)).alias("usd"),
        F.coalesce("_f.report", F.lit("")).alias("report"),
    )
    return runs.withColumn("interrupted", F.col("finished_at") == "").withColumn("summary", run_summary())


def run_history_stream(records: DataFrame, time: str, patience: str) -> DataFrame:
    """Streaming twin: begins left-joined to their finish; without one inside ``patience`` a run is interrupted.

    Watermarks are ours: the batch log has no notion of late. Both sides carry ``time``.
    """
    begins = (
        records.filter("event = 'begin'")
        .withWatermark(time, patience)
        .select("run_id", "model", "scope", "modules", "started_at", F.col(time).alias("_begun"))
    )
    ends = (
        records.filter("event = 'finish'")
        .withWatermark(time, patience)
        .select(F.col("run_id").alias("_id"), "finished_at", "read", "findings", "usd", "report", F.col(time).alias("_ended"))
    )
    on = (F.col("run_id") == F.col("_id")) & (F.col("_ended") >= F.col("_begun")) & (
        F.col("_ended") <= F.col("_begun") + F.expr(f"interval {patience}")
    )
    return begins.join(ends, on, "left_outer").drop("_id").withColumn("interrupted", F.col("finished_at").isNull())


# -- order of a run --------------------------------------------------------------------------------------


def sequence_check(events: DataFrame) -> DataFrame:
    """Per run: is it numbered 1..n, how many numbers are missing or repeated, does time run backwards.

    Numbering comes from plain aggregates; only the clock needs the previous row, carried over slices.
    """
    before = carried(
        events, ["run_id"], [F.col("seq"), F.col("offset_ms")], _slice(), F.col("offset_ms"), "_before", include_current=False
    )
    per_number = before.groupBy("run_id", "seq").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("offset_ms") < F.col("_before")).alias("_back")
    )
    return (
        per_number.groupBy("run_id")
        .agg(
            F.sum("_n").alias("events"),
            F.max("seq").alias("last_seq"),
            F.min("seq").alias("_first"),
            F.count(F.lit(1)).alias("_distinct"),
            F.sum("_back").alias("backward_steps"),
        )
        .select(
            "run_id",
            "events",
            "last_seq",
            (F.col("last_seq") - F.col("_distinct")).alias("gaps"),
            (F.col("events") - F.col("_distinct")).alias("duplicates"),
            "backward_steps",
            ((F.col("_first") == 1) & (F.col("last_seq") == F.col("events")) & (F.col("_distinct") == F.col("events"))).alias("in_order"),
        )
    )


def _slice_effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How each slice changes the number of open spans: by ``shift`` from ``deep`` on, else by parity.

    Rows come sorted by slice and number, many slices to a batch; a slice may go on in the next one.
    """
    columns = ["run_id", "agent", "_slice", "shift", "deep", "even", "odd"]
    key, level, lowest, even, odd = None, 0, 0, 0, 1
    for pdf in batches:
        done = []
        for run, agent, cut, is_start in zip(pdf["run_id"], pdf["agent"], pdf["_slice"], pdf["is_start"], strict=True):
            if (run, agent, cut) != key:
                if key:
                    done.append((*key, level, -lowest, even, odd))
                key, level, lowest, even, odd = (run, agent, cut), 0, 0, 0, 1
            level += 1 if is_start else -1
            lowest = min(lowest, level)
            even, odd = (even + 1, odd + 1) if is_start else (abs(even - 1), abs(odd - 1))
        yield pd.DataFrame(done, columns=columns)
    if key:
        yield pd.DataFrame([(*key, level, -lowest, even, odd)], columns=columns)


def _mark_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Which mention opens a span and which closes one, given how many were open before its slice; rows sorted alike."""
    key, open_now = None, 0
    for pdf in batches:
        opens = []
        for run, agent, cut, before, is_start in zip(
            pdf["run_id"], pdf["agent"], pdf["_slice"], pdf["_open"], pdf["is_start"], strict=True
        ):
            if (run, agent, cut) != key:
                key, open_now = (run, agent, cut), before
            opening = bool(is_start) or open_now == 0
            opens.append(opening)
            open_now += 1 if opening else -1
        yield pdf.assign(opens=opens)[["run_id", "agent", "seq", "at", "opens"]]


def _moved(open_spans: Column, effect: Column) -> Column:
    """How many spans are open after a slice that ``open_spans`` were open before."""
    low = F.when(open_spans % 2 == 0, effect["even"]).otherwise(effect["odd"])
    return F.when(open_spans >= effect["deep"], open_spans + effect["shift"]).otherwise(low)


def _entering(effects: DataFrame) -> DataFrame:
    """(run_id, agent, _slice, _open): how many spans are open where each slice begins.

    Up the tree the effects of ``FAN`` neighbours at a time become one effect of the same four numbers: below ``deep`` only
    the parity of what was open counts, as counts of equal parity have met by then. Down the tree each node tells its
    neighbours what they begin with. A list holds ``FAN`` effects at most.
    """
    keys = ["run_id", "agent"]
    nodes, top, levels = effects.withColumnRenamed("_slice", "_node"), effects.agg(F.max("_slice")).first()[0] or 0, []
    whole = F.aggregate(
        "_parts",
        F.struct(*[F.lit(v).cast("bigint").alias(c) for c, v in (("shift", 0), ("deep", 0), ("even", 0), ("odd", 1))]),
        lambda acc, s: F.struct(
            (acc["shift"] + s["shift"]).alias("shift"),
            F.greatest(acc["deep"], s["deep"] - acc["shift"]).alias("deep"),
            _moved(acc["even"], s).alias("even"),
            _moved(acc["odd"], s).alias("odd"),
        ),
    )
    while not levels or top:
        parts = F.array_sort(F.collect_list(F.struct("_node", "shift", "deep", "even", "odd"))).alias("_parts")
        levels.append(cut_lineage(nodes.groupBy(*keys, F.floor(F.col("_node") / FAN).alias("_up")).agg(parts)))
        nodes = levels[-1].select(*keys, F.col("_up").alias("_node"), whole.alias("_w")).select(*keys, "_node", "_w.*")
        top //= FAN
    opened = levels[-1].select(*keys, F.col("_up").alias("_node"), F.lit(0).cast("bigint").alias("_open"))
    begins = F.aggregate(
        "_parts",
        F.struct(F.col("_open").alias("open"), F.array().cast("array<struct<_node:bigint,_open:bigint>>").alias("out")),
        lambda acc, s: F.struct(
            _moved(acc["open"], s).alias("open"),
            F.concat(acc["out"], F.array(F.struct(s["_node"].alias("_node"), acc["open"].alias("_open")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    for level in reversed(levels):
        told = level.join(opened.withColumnRenamed("_node", "_up"), [*keys, "_up"])
        opened = told.select(*keys, F.explode(begins).alias("_e")).select(*keys, "_e.*")
    return opened.withColumnRenamed("_node", "_slice")


def agent_spans(mentions: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """``mentions(run_id, agent, seq, at, is_start)`` to spans (run_id, agent, n, started_at, ended_at).

    A start opens a span; any other mention closes the oldest open one, or opens one where none is.
    The count of open spans moves as x -> x+1 or x -> |x-1|, so a slice of a run is summed up by four
    numbers, which a tree of ``FAN`` slices to a node composes and hands down again, and the n-th opening
    meets the n-th closing by an equi-join. No run is ever held by one task, nor its list of slices by one row.
    """
    # a mention of no run, agent or number meets no slice below
    sliced = mentions.withColumn("_slice", F.floor(F.col("seq") / slice_rows)).dropna(subset=["run_id", "agent", "_slice"])
    whole = ["run_id", "agent", "_slice"]

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition(*whole).sortWithinPartitions(*whole, "seq")

    effect = "run_id string, agent string, _slice bigint, shift bigint, deep bigint, even bigint, odd bigint"
    effects = in_order(sliced.select(*whole, "seq", "is_start")).mapInPandas(_slice_effects, effect)
    opened = _entering(cut_lineage(effects))
    # both sides of the pairing read this, so the walk is written once instead of run twice
    marked = cut_lineage(
        in_order(sliced.join(opened, whole).select(*whole, "seq", "at", "_open", "is_start")).mapInPandas(
            _mark_slices, "run_id string, agent string, seq bigint, at bigint, opens boolean"
        )
    )
    keys = ["run_id", "agent"]
    cut = F.floor(F.col("seq") / slice_rows)
    counted = running_sum(marked, [*keys, "opens"], [F.col("seq")], cut, F.lit(1).cast("bigint"), "n")
    closing = counted.filter("not opens").select(*keys, "n", F.col("at").alias("_end"))
    return (
        counted.filter("opens")
        .join(closing, [*keys, "n"], "left")
        .select(
            *keys,
            "n",
            F.col("at").alias("started_at"),
            F.greatest("_end", F.when(F.col("_end").isNotNull(), F.col("at"))).alias("ended_at"),
        )
    )
