"""Money, memory and what fits a budget."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import dims
from plumbline.operators.grading import ratio
from plumbline.operators.scan import spread_join
from plumbline.session import cut_lineage

MICRO = 1_000_000
PROMPT_CHARS = 120_000
BLOCK_MARKS = 13  # heading, fences and newlines around one file
BLOCK_OVERHEAD = 16  # what the selection reserves for them


def price_calls(calls: DataFrame, pricing: DataFrame | None = None) -> DataFrame:
    """``calls`` plus usd. A model without a price is an error, never free."""
    table = dims.prices(calls.sparkSession) if pricing is None else pricing
    if pricing is None:
        table = F.broadcast(table)
    priced = calls.join(table, "model", "left")
    usd = (F.col("input_tokens") * F.col("usd_in") + F.col("output_tokens") * F.col("usd_out")) / MICRO
    refused = F.raise_error(F.concat(F.lit("no price for model "), F.coalesce("model", F.lit("null")))).cast("double")
    return priced.withColumn("usd", F.when(F.col("usd_in").isNotNull(), usd).otherwise(refused)).drop("usd_in", "usd_out")


def usage_by_run(calls: DataFrame) -> DataFrame:
    return calls.groupBy("run_id", "model", "agent").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("usd").alias("usd"),
    )


def content_key(*parts: Column) -> Column:
    """sha256 over the parts, each preceded by its length so that no two lists collide."""
    framed = [F.concat(F.length(F.coalesce(p, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p, F.lit(""))) for p in parts]
    return F.sha2(F.concat(*framed), 256)


def question_key() -> Column:
    return content_key(*[F.col(c) for c in ("model", "source", "layer", "language", "prompt")])


def recording_key() -> Column:
    """The second keying: the response schema is part of the question; 32 hex digits."""
    return F.substring(content_key(*[F.col(c) for c in ("model", "prompt", "schema_id", "schema")]), 1, 32)


def recall_answers(questions: DataFrame, memo: DataFrame, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits with their answers, misses). ``memo`` is (key, answer), one row per key."""
    keyed = questions.withColumn("key", question_key() if key is None else key)
    joined = spread_join(keyed, memo.select("key", "answer", F.lit(True).alias("_known")), ["key"], "left")
    return joined.filter("_known").drop("_known"), joined.filter("_known is null").drop("_known", "answer")


def memo_stats(lookups: DataFrame) -> DataFrame:
    """``lookups(store, hit)`` to hits, misses and their share."""
    return lookups.groupBy("store").agg(
        F.count_if("hit").alias("hits"),
        F.count_if(~F.col("hit")).alias("misses"),
        ratio(F.count_if("hit"), F.count(F.lit(1))).alias("hit_rate"),
    )


def read_share(coverage: DataFrame, modules: DataFrame, reports: DataFrame) -> DataFrame:
    """Per repository: read of mapped, percent to one decimal, spend and why it stopped."""
    read = coverage.filter("status = 'analysed'").groupBy("repo_id").agg(F.count(F.lit(1)).alias("read"))
    mapped = modules.groupBy("repo_id").agg(F.count(F.lit(1)).alias("modules"))
    percent = F.when(F.col("modules") > 0, F.round(100.0 * F.col("read") / F.col("modules"), 1)).otherwise(0.0)
    return (
        reports.join(mapped, "repo_id", "left")
        .join(read, "repo_id", "left")
        .na.fill(0, ["modules", "read"])
        .withColumn("percent", percent)
        .select("repo_id", "read", "modules", "percent", "usd", F.coalesce("stopped_because", F.lit("unknown")).alias("stopped_because"))
    )


def apportion(batches: DataFrame) -> DataFrame:
    """``batches(batch_id, batch_usd, path, failed)``: each module's even share in micro-dollars, and whether it was read."""
    sizes = batches.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        spread_join(batches, sizes, ["batch_id"])
        .withColumn("micros", F.round(F.col("batch_usd") * MICRO / F.col("_n"), 0).cast("bigint"))
        .withColumn("read", ~F.coalesce("failed", F.lit(False)))
        .drop("_n")
    )


# -- one prompt ---------------------------------------------------------------------------------


def pack_prompt(modules: DataFrame, context: DataFrame, budget: int = PROMPT_CHARS) -> DataFrame:
    """``modules(repo_id, path, fan_in, n_signals, chars)`` plus status and reason.

    Context goes first, then modules by fan-in, signals and path until the budget. Every module costs
    at least its marks and one path character, so only the first ``budget / 14`` of a repository can
    matter: the running sum sees that head and the cut-off is compared with every other row.
    """
    most = budget // (BLOCK_MARKS + 1) + 2
    label = len("### ") + len("  (deployment configuration, not source)\n```\n") + len("\n```")
    used = context.groupBy("repo_id").agg(
        F.sum(F.length("name") + F.length("text") + F.lit(label)).alias("_context")
    )
    order = [F.desc("fan_in"), F.desc("n_signals"), F.asc("path")]
    head = modules.withColumn("_r", F.row_number().over(Window.partitionBy("repo_id").orderBy(*order))).filter(
        F.col("_r") <= most
    )
    cost = F.col("chars") + F.length("path") + BLOCK_MARKS
    before = Window.partitionBy("repo_id").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        head.join(used, "repo_id", "left")
        .withColumn("_used", F.coalesce("_context", F.lit(0)) + F.coalesce(F.sum(cost).over(before), F.lit(0)))
        .withColumn("_left", F.lit(budget) - F.col("_used"))
    )
    full = F.col("_left") <= BLOCK_OVERHEAD
    overflows = F.col("chars") > F.col("_left") - BLOCK_OVERHEAD - F.length("path")
    rank = F.struct((-F.col("fan_in")).alias("f"), (-F.col("n_signals")).alias("s"), F.col("path").alias("p"))
    cut = (
        placed.filter(full | overflows)
        .groupBy("repo_id")
        .agg(F.min(F.struct(rank.alias("k"), full.alias("full"))).alias("_cut"))
    )
    return (
        spread_join(modules, cut, ["repo_id"], "left")
        .withColumn(
            "status",
            F.when(F.col("_cut").isNull() | (rank < F.col("_cut.k")), F.lit("included"))
            .when((rank == F.col("_cut.k")) & ~F.col("_cut.full"), F.lit("truncated"))
            .otherwise(F.lit("skipped")),
        )
        .withColumn(
            "reason",
            F.when(F.col("status") == "truncated", F.lit("truncated to fit one prompt")).when(
                F.col("status") == "skipped", F.lit("did not fit in one prompt")
            ),
        )
        .drop("_cut")
    )


# -- a budget over modules --------------------------------------------------------------------------


def estimate_micros(loc: Column, observed_usd: Column, usd_per_1k: float = 0.02, calls: int = 1) -> Column:
    expected = F.greatest(loc / 1000.0 * usd_per_1k, F.coalesce(observed_usd, F.lit(0.0)))
    return F.round(expected * calls * MICRO, 0).cast("bigint")


def observed_cost(costs: DataFrame) -> DataFrame:
    """(repo_id, observed): mean paid cost, once three modules agree. ``costs`` is (repo_id, usd)."""
    paid = costs.filter("usd > 0").groupBy("repo_id").agg(F.count(F.lit(1)).alias("_n"), F.avg("usd").alias("_mean"))
    return paid.select("repo_id", F.when(F.col("_n") >= 3, F.col("_mean")).alias("observed"))


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    ordered = pdf.sort_values(["value", "path"], ascending=[False, False])
    left, taken = int(ordered["left"].iloc[0]), []
    for cost in ordered["micros"]:
        fits = cost <= left
        taken.append(fits)
        left -= int(cost) if fits else 0
    return ordered.assign(taken=taken)[["repo_id", "path", "taken"]]


def budget_selection(candidates: DataFrame, budget_micros: int, small: int = 20_000) -> DataFrame:
    """``candidates(repo_id, path, value, micros)`` plus ``selected``: greedy by value, skip what does not fit.

    Each round takes, in every repository at once, the longest prefix that fits and then drops what
    can no longer fit; both are exact steps of the one-by-one walk, because the money left only
    shrinks. Only the first ``left / cheapest + 1`` rows can be in a prefix, so no window holds more
    than the budget can buy. Once every repository has at most ``small`` open rows the walk is
    finished per repository.
    """
    free = candidates.filter("micros <= 0").select("repo_id", "path")
    open_rows = cut_lineage(
        candidates.filter(F.col("micros") > 0).select(
            "repo_id", "path", "value", "micros", F.lit(budget_micros).cast("bigint").alias("left")
        ).filter("micros <= left")
    )
    taken: list[DataFrame] = [free]
    while True:
        per = open_rows.groupBy("repo_id").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.col("left")).alias("left"), F.min("micros").alias("cheapest")
        )
        top = per.agg(F.max("n"), F.max(F.expr("left div cheapest")) + 1).first()
        if top[0] is None:
            break
        if top[0] <= small:
            walked = open_rows.groupBy("repo_id").applyInPandas(_greedy, "repo_id string, path string, taken boolean")
            taken.append(walked.filter("taken").select("repo_id", "path"))
            break
        order = Window.partitionBy("repo_id").orderBy(F.desc("value"), F.desc("path"))
        head = open_rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= int(top[1]) + 1)
        running = head.withColumn(
            "_sum", F.sum("micros").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        )
        prefix = cut_lineage(running.withColumn("_fits", F.col("_sum") <= F.col("left")))
        spent = prefix.filter("_fits").groupBy("repo_id").agg(F.sum("micros").alias("_spent"))
        bought = prefix.filter("_fits").select("repo_id", "path")
        taken.append(bought)
        # the first row that did not fit is dropped too: less money is left than it costs
        open_rows = cut_lineage(
            spread_join(open_rows, spent, ["repo_id"], "left")
            .join(bought, ["repo_id", "path"], "left_anti")
            .withColumn("left", F.col("left") - F.coalesce("_spent", F.lit(0)))
            .drop("_spent")
            .filter("micros <= left")
        )
    chosen = taken[0]
    for part in taken[1:]:
        chosen = chosen.unionByName(part)
    return candidates.join(chosen.withColumn("_s", F.lit(True)), ["repo_id", "path"], "left").withColumn(
        "selected", F.coalesce("_s", F.lit(False))
    ).drop("_s")
