"""Orders, heads and unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import dims
from plumbline.operators.gates import severity_rank, why_unread
from plumbline.operators.scan import numbered
from plumbline.session import cut_lineage


def finding_evidence() -> Column:
    """What a finding's own columns multiply its score by."""
    return F.when(F.col("prediction").isNotNull(), 4.0).otherwise(1.0) * F.when(
        F.trim(F.coalesce("arithmetic", F.lit(""))) != "", 1.5
    ).otherwise(1.0)


def finding_score(evidence: Column, weight: Column, depth: Column, fan_in: Column) -> Column:
    reach = F.when(depth.isNull(), 0.2).otherwise(F.pow(F.lit(0.7), depth.cast("double")))
    blast = 1.0 + F.coalesce(fan_in, F.lit(0)) / 10.0
    return evidence * reach * blast + weight


def severity_weight() -> Column:
    return F.when(F.col("severity") == "high", 1.0).when(F.col("severity") == "medium", 0.5).otherwise(0.0)


def rank_findings(findings: DataFrame, modules: DataFrame) -> DataFrame:
    """``findings`` with a score; order with ``finding_order()``. Modules are unique per path.

    What findings alone decide is two numbers before the join, so an order without the prose shuffles no predictions.
    """
    own = findings.withColumn("_evidence", finding_evidence()).withColumn("_weight", severity_weight())
    joined = own.join(modules.select("repo_id", "path", "depth", "fan_in"), ["repo_id", "path"], "left")
    score = finding_score(F.col("_evidence"), F.col("_weight"), F.col("depth"), F.col("fan_in"))
    return joined.withColumn("score", score).drop("depth", "fan_in", "_evidence", "_weight")


def finding_order() -> list[Column]:
    return [F.desc("score"), F.asc("path"), F.asc("line"), F.asc("symbol"), F.asc("ord")]


def rank_for_reader(findings: DataFrame) -> DataFrame:
    settled = F.col("prediction").isNotNull() & F.col("measurement.value").isNotNull()
    return findings.withColumn("settled", settled).withColumn("level", 2 - severity_rank(F.col("severity")))


def reader_order() -> list[Column]:
    return [F.asc("level"), F.desc("settled"), F.asc("path"), F.asc("line"), F.asc("ord")]


def positions(ranked: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "position") -> DataFrame:
    """Every row with its place 1..n among those of its key, where one key may hold most rows.

    Rows are dealt out in ranges of key and order, so a large key lies in many tasks one after the other; a row's place is its
    place in the task and what the tasks before hold of its key. The ranges are written once, as both are read from them.
    """
    ranged = ranked.repartitionByRange(*[F.asc(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    return numbered(cut_lineage(ranged), keys, order, F.col("_part"), out).drop("_part")


def listed_and_rest(ranked: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key with a position, and how many rank below them."""
    total = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return _first(ranked, keys, order, n).join(total, list(keys)).withColumn("rest", F.greatest(F.col("_n") - n, F.lit(0))).drop("_n")


def _first(ranked: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return ranked.withColumn("position", place).filter(F.col("position") <= n)


MOST_SENT = 100_000


def first_findings(findings: DataFrame, modules: DataFrame, n: int) -> DataFrame:
    """``listed_and_rest`` of the ranked findings of each repository, where no other row's prose is shuffled or sorted.

    The order is taken over its own columns first. Findings that share path, line, symbol and ord with one of the first
    ``n`` are then read whole, scored and ordered again: those are all of the first and whatever ties with them.
    """
    ranked = rank_findings(findings, modules)
    total = ranked.groupBy("repo_id").agg(F.count(F.lit(1)).alias("_n"))
    at = ["repo_id", "path", "line", "symbol", "ord"]
    heads = cut_lineage(_first(ranked, ["repo_id"], finding_order(), n).select(*[F.col(c).alias(f"_{c}") for c in at]).distinct())
    few = F.broadcast(heads) if heads.count() <= MOST_SENT else heads
    whole = findings.join(few, [findings[c].eqNullSafe(F.col(f"_{c}")) for c in at], "left_semi")
    head = _first(rank_findings(whole, modules), ["repo_id"], finding_order(), n)
    return head.join(total, "repo_id").withColumn("rest", F.greatest(F.col("_n") - n, F.lit(0))).drop("_n")


def cap_per_kind(artifacts: DataFrame, most: int = 25) -> tuple[DataFrame, DataFrame]:
    """(the first of each kind by depth then path, totals before the cap)."""
    depth = F.size(F.split("path", "/")) - 1
    order = Window.partitionBy("repo_id", "kind").orderBy(depth, "path")
    head = artifacts.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= most)
    totals = artifacts.groupBy("repo_id", "kind").agg(F.count(F.lit(1)).alias("total"))
    return head, totals


def recent_steps(steps: DataFrame, n: int = 400) -> DataFrame:
    """The last ``n`` steps of each run; the head is taken on the map side before the shuffle."""
    latest = Window.partitionBy("run_id").orderBy(F.desc("seq"))
    return steps.withColumn("_r", F.row_number().over(latest)).filter(F.col("_r") <= n).drop("_r")


def order_rule_findings(rule_findings: DataFrame) -> DataFrame:
    return rule_findings.orderBy("repo_id", "path", "line", "rule")


# -- unions ----------------------------------------------------------------------------------------


def rules_as_findings(rule_findings: DataFrame, source: str) -> DataFrame:
    return rule_findings.select(
        "repo_id",
        F.lit(source).alias("source"),
        "path",
        F.col("line").cast("int").alias("line"),
        F.lit("").alias("layer"),
        F.col("rule").alias("symbol"),
        F.lit("medium").alias("severity"),
        F.col("detail").alias("mechanism"),
        "remediation",
    )


def every_finding(deployment: DataFrame, code: DataFrame, schema: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Rule hits and reviewed findings in one shape."""
    return (
        rules_as_findings(deployment, "deployment")
        .unionByName(code.withColumn("source", F.lit("code")), allowMissingColumns=True)
        .unionByName(rules_as_findings(schema, "schema"), allowMissingColumns=True)
        .unionByName(rules_as_findings(dependencies, "dependencies"), allowMissingColumns=True)
    )


def dropped_ledger(**parts: DataFrame) -> DataFrame:
    """Every removed finding with the pass that removed it. Keyword names become ``stage``."""
    frames = [df.withColumn("stage", F.lit(stage)) for stage, df in parts.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def coverage_ledger(
    modules: DataFrame, unparsed: DataFrame, skipped: DataFrame, analysed: DataFrame, failed: DataFrame
) -> DataFrame:
    """(repo_id, path, status, reason): the most specific reason wins; read paths are listed as such."""
    unread = modules.join(
        analysed.select("repo_id", "path").unionByName(failed.select("repo_id", "path")),
        ["repo_id", "path"],
        "left_anti",
    ).select("repo_id", "path", why_unread(F.col("signals"), F.col("unmatched_imports")).alias("reason"))
    tagged = (
        unparsed.select("repo_id", "path", F.lit("unparsed").alias("reason"), F.lit(0).alias("rank"))
        .unionByName(skipped.select("repo_id", "path", "reason", F.lit(1).alias("rank")))
        .unionByName(unread.select("repo_id", "path", "reason", F.lit(2).alias("rank")))
        .unionByName(failed.select("repo_id", "path", "reason", F.lit(3).alias("rank")))
    )
    left_out = tagged.groupBy("repo_id", "path").agg(F.max_by("reason", "rank").alias("reason"))
    return left_out.select("repo_id", "path", F.lit("skipped").alias("status"), "reason").unionByName(
        analysed.select("repo_id", "path", F.lit("analysed").alias("status"), F.lit(None).cast("string").alias("reason")).distinct()
    )


def artifact_order(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in dims.ARTIFACT_KINDS]), kind)
