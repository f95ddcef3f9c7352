"""Scoring reports against ground truth and pooling arms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import dims
from plumbline.functions import text as t
from plumbline.operators.gates import grade
from plumbline.operators.scan import spread_join
from plumbline.schemas import RUN

MIN_EXPERIMENTS = 5


def ratio(top: Column, bottom: Column) -> Column:
    """Null over an empty denominator, never zero."""
    return F.try_divide(top.cast("double"), F.nullif(bottom, F.lit(0)).cast("double"))


def experiment_unit() -> Column:
    """What settled a finding: its experiment, or (metric, condition, value) where none is named."""
    p = F.col("prediction")
    named = F.nullif(F.col("measurement.experiment"), F.lit(""))
    unnamed = named.isNull()
    return F.struct(
        named.alias("experiment"),
        F.when(unnamed, p["metric"]).alias("metric"),
        F.when(unnamed, p["condition"]).alias("condition"),
        F.when(unnamed, p["value"]).alias("value"),
    )


def experiment_outcomes(graded: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """(keys, hits, runs): one unit per experiment, a hit only when every claim it settled held."""
    per_unit = (
        graded.filter("was_tested")
        .groupBy(*keys, experiment_unit().alias("_unit"))
        .agg(F.bool_and(F.col("verdict") == "hit").alias("_held"))
    )
    return per_unit.groupBy(*keys).agg(F.count_if("_held").alias("hits"), F.count(F.lit(1)).alias("runs"))


def score_reports(
    findings: DataFrame, dropped: DataFrame, reports: DataFrame, keys: Sequence[str] = RUN
) -> DataFrame:
    """One row per report. ``reports`` carries keys, model_id, seeded, found, failed, usd, seconds.

    Findings and drops go through one pass: each row counts once for its construct and, if tested,
    once for its experiment, and both are reduced on the map side. A drop whose construct was kept
    then shows as a construct with findings, so no join is needed to leave it out.
    """
    keys = list(keys)
    one = F.lit(1).cast("bigint")
    none = F.lit(0).cast("bigint")
    site = F.struct("path", "symbol")
    rows = grade(findings).select(
        *keys,
        site.alias("_site"),
        F.when(F.col("was_tested"), experiment_unit()).alias("_unit"),
        one.alias("n"),
        F.col("is_falsifiable").cast("bigint").alias("falsifiable"),
        F.col("was_tested").cast("bigint").alias("tested_findings"),
        F.coalesce(F.col("verdict") == "broken", F.lit(False)).cast("bigint").alias("broken"),
        (F.col("verdict") == "hit").alias("held"),
        none.alias("dropped"),
    )
    gone = dropped.select(
        *keys,
        site.alias("_site"),
        *[none.alias(c) for c in ("n", "falsifiable", "tested_findings", "broken")],
        one.alias("dropped"),
    )
    counts = ["n", "falsifiable", "tested_findings", "broken", "dropped"]
    ways = F.array(
        F.struct(F.col("_site").alias("site"), F.when(F.lit(False), F.col("_unit")).alias("unit")),
        F.struct(F.when(F.lit(False), F.col("_site")).alias("site"), F.col("_unit").alias("unit")),
    )
    per = (
        rows.unionByName(gone, allowMissingColumns=True)
        .withColumn("_way", F.explode(ways))
        .filter("_way.site is not null or _way.unit is not null")
        .groupBy(*keys, "_way")
        .agg(*[F.sum(c).alias(c) for c in counts], F.bool_and("held").alias("held"))
    )
    at_site = F.col("_way.site").isNotNull()
    totals = per.groupBy(*keys).agg(
        *[F.sum(F.when(at_site, F.col(c)).otherwise(0)).alias(c) for c in counts],
        F.sum(F.when(at_site & (F.col("n") == 0), F.col("dropped")).otherwise(0)).alias("discarded"),
        F.count_if(~at_site).alias("runs"),
        F.count_if(~at_site & F.col("held")).alias("hits"),
    )
    joined = reports.join(totals, keys, "left").na.fill(0, [*counts, "discarded", "runs", "hits"])
    seen = F.col("n") + F.col("discarded")
    return joined.select(
        *keys,
        "model_id",
        "seeded",
        "found",
        "failed",
        F.col("n").alias("total_findings"),
        "tested_findings",
        seen.alias("observations"),
        "falsifiable",
        F.col("runs").alias("tested"),
        F.col("runs").alias("experiments"),
        "hits",
        "broken",
        "dropped",
        ratio(F.col("falsifiable"), seen).alias("falsifiable_precision"),
        ratio(F.col("hits"), F.col("runs")).alias("hit_rate"),
        ratio(F.col("tested_findings"), F.col("falsifiable")).alias("prediction_coverage"),
        "usd",
        "seconds",
    )


def aggregate_arm(scores: DataFrame, by: Sequence[str] = ("arm",)) -> DataFrame:
    """Pooled counts and ratios of sums; the hit rate is withheld under five experiments."""

    def total(c: str) -> Column:
        return F.sum(c).alias(c)

    pooled = scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"),
        F.array_join(F.array_sort(F.collect_set("model_id")), ",").alias("model_ids"),
        *[
            total(c)
            for c in (
                "seeded",
                "found",
                "total_findings",
                "tested_findings",
                "observations",
                "falsifiable",
                "tested",
                "experiments",
                "hits",
                "broken",
                "dropped",
                "usd",
                "seconds",
            )
        ],
        F.count_if("failed").alias("failed"),
        F.min("falsifiable_precision").alias("per_case_low"),
        F.max("falsifiable_precision").alias("per_case_high"),
    )
    return (
        pooled.withColumn("detection_rate", ratio(F.col("found"), F.col("seeded")))
        .withColumn("falsifiable_precision", ratio(F.col("falsifiable"), F.col("observations")))
        .withColumn(
            "hit_rate",
            F.when(F.col("experiments") >= MIN_EXPERIMENTS, ratio(F.col("hits"), F.col("tested"))),
        )
        .withColumn("prediction_coverage", ratio(F.col("tested_findings"), F.col("falsifiable")))
    )


def sweep_summary(scores: DataFrame, independent: bool = True) -> DataFrame:
    """One row per arm over its repeats. Repeats that were one recording pool only the first seed."""
    per_seed = aggregate_arm(scores, ["arm", "seed"])
    over = per_seed.groupBy("arm").agg(
        F.count(F.lit(1)).alias("seeds"),
        F.sum("failed").alias("failed"),
        F.sum("cases").alias("_runs"),
        F.avg("detection_rate").alias("_recall_mean"),
        F.min("detection_rate").alias("_recall_low"),
        F.max("detection_rate").alias("_recall_high"),
        # one element per repeat: bounded by the number of seeds run
        F.array_sort(F.collect_list(F.when(F.col("detection_rate").isNotNull(), F.struct("seed", "detection_rate")))).alias("_recalls"),
        F.avg("falsifiable_precision").alias("precision_mean"),
        F.avg("usd").alias("_usd"),
        F.avg("seconds").alias("_seconds"),
        F.min_by("usd", "seed").alias("_usd_first"),
        F.min_by("seconds", "seed").alias("_seconds_first"),
        F.min("seed").alias("_first"),
    )
    counted = scores
    if not independent:
        counted = scores.join(over.select("arm", F.col("_first").alias("seed")), ["arm", "seed"], "left_semi")
    pooled = aggregate_arm(counted).select(
        "arm",
        "hits",
        "tested",
        "experiments",
        "hit_rate",
        "broken",
        F.col("prediction_coverage").alias("coverage_mean"),
    )
    done = F.col("failed") < F.col("_runs")
    return over.join(pooled, "arm").select(
        "arm",
        "seeds",
        "failed",
        F.lit(independent).alias("independent"),
        F.when(done, F.col("_recall_mean")).alias("recall_mean"),
        F.when(done, F.col("_recall_low")).alias("recall_low"),
        F.when(done, F.col("_recall_high")).alias("recall_high"),
        F.transform("_recalls", lambda r: r["detection_rate"]).alias("recalls"),
        "hits",
        "tested",
        "experiments",
        "hit_rate",
        "precision_mean",
        "coverage_mean",
        "broken",
        (F.col("_usd") if independent else F.col("_usd_first")).alias("usd_mean"),
        (F.col("_seconds") if independent else F.col("_seconds_first")).alias("seconds_mean"),
    )


METRIC_ROWS = (
    ("seeded recall (mean)", "recall_mean", "%.3f"),
    ("range low", "recall_low", "%.3f"),
    ("range high", "recall_high", "%.3f"),
    ("falsifiable precision", "precision_mean", "%.3f"),
    ("hit rate", "hit_rate", "%.3f"),
    ("hits", "hits", "%d"),
    ("tested", "tested", "%d"),
    ("experiments", "experiments", "%d"),
    ("prediction coverage", "coverage_mean", "%.3f"),
    ("broken", "broken", "%d"),
    ("cost usd", "usd_mean", "%.5f"),
    ("seconds", "seconds_mean", "%.1f"),
)


def _even(value: Column, fmt: str) -> Column:
    """Ties to the even digit before printing, as the printed tables round."""
    return value if fmt == "%d" else F.bround(value, int(fmt[2]))


def arm_comparison(sweeps: DataFrame, arms: Sequence[str]) -> DataFrame:
    """Metric rows by arm columns, ``n/a`` where there is no number."""
    cells = [
        F.struct(
            F.lit(i).alias("ord"),
            F.lit(label).alias("metric"),
            F.coalesce(
                F.when(F.col(c).isNotNull(), F.format_string(fmt, _even(F.col(c), fmt))), F.lit("n/a")
            ).alias("said"),
        )
        for i, (label, c, fmt) in enumerate(METRIC_ROWS)
    ]
    long = sweeps.select("arm", F.explode(F.array(*cells)).alias("cell")).select("arm", "cell.*")
    return long.groupBy("ord", "metric").pivot("arm", list(arms)).agg(F.first("said"))


# -- ground truth ---------------------------------------------------------------------------


def symbol_pattern(symbol: Column) -> Column:
    """Whole word, hyphen and underscore counted as letters, with English endings allowed."""
    quoted = F.regexp_replace(symbol, r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\$1")
    short = F.regexp_replace(F.regexp_replace(symbol, "y$", ""), r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\$1")
    forms = F.concat(
        quoted,
        F.lit("(?:s|es|ed|d|ing)?"),
        F.when(symbol.endswith("y"), F.concat(F.lit("|"), short, F.lit("(?:ies|ied)"))).otherwise(F.lit("")),
    )
    return F.concat(F.lit(r"(?iU)(?<![\w-])(?:"), forms, F.lit(r")(?![\w-])"))


def match_defects(defects: DataFrame, findings: DataFrame, runs: DataFrame) -> DataFrame:
    """(case, arm, seed, id, found) for every seeded defect of every report in ``runs``.

    Equal text at one path is kept once before the join; the seeded side is spread over salts.
    """
    wanted = (
        defects.select("case_id", "id", F.explode("locations").alias("path"), "symbols")
        .withColumn("symbol", F.explode("symbols"))
        .select("case_id", "id", "path", symbol_pattern(F.col("symbol")).alias("pattern"))
        .distinct()
    )
    said = (
        findings.filter(t.word_count(F.col("mechanism")) >= 5)
        .select(*RUN, "path", F.concat_ws(" ", "symbol", "mechanism").alias("text"))
        .distinct()
    )
    hits = (
        spread_join(said, wanted, ["case_id", "path"])
        .filter(F.expr("text rlike pattern"))
        .select(*RUN, "id")
        .distinct()
        .withColumn("_found", F.lit(True))
    )
    return (
        runs.select(*RUN)
        .join(defects.select("case_id", "id"), "case_id")
        .join(hits, [*RUN, "id"], "left")
        .select(*RUN, "id", F.coalesce("_found", F.lit(False)).alias("found"))
    )


def recall(matched: DataFrame) -> DataFrame:
    return matched.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("seeded"),
        F.count_if("found").alias("found"),
        F.avg(F.col("found").cast("double")).alias("recall"),
    )


def attach_measurements(findings: DataFrame, measurements: DataFrame, defects: DataFrame) -> DataFrame:
    """A metric's one measurement goes to every finding predicting it in the files its defect names."""
    places = (
        defects.filter(F.coalesce("expected_metric", F.lit("")) != "")
        .select("case_id", F.col("expected_metric").alias("_metric"), F.explode("locations").alias("path"))
        .distinct()
    )
    settled = places.join(
        measurements.select("case_id", F.col("metric").alias("_metric"), F.col("measurement").alias("_m")),
        ["case_id", "_metric"],
        "left",
    )
    asked = findings.withColumn("_metric", F.col("prediction.metric"))
    return (
        spread_join(asked, settled, ["case_id", "_metric", "path"], "left", by=["ord"])
        .withColumn("measurement", F.col("_m"))
        .drop("_metric", "_m")
    )


def discrimination(measurements: DataFrame) -> DataFrame:
    """Experiments that read the same on seeded and remediated code, or differ between repeats."""

    def side(variant: str, fn) -> Column:
        return fn(F.when(F.col("variant") == variant, F.col("value")))

    per = measurements.groupBy("case_id", "metric").agg(
        side("seeded", F.min).alias("seeded_low"),
        side("seeded", F.max).alias("seeded_high"),
        side("remediated", F.min).alias("remediated_low"),
        side("remediated", F.max).alias("remediated_high"),
    )
    repeatable = (F.col("seeded_low") == F.col("seeded_high")) & (
        F.col("remediated_low") == F.col("remediated_high")
    )
    apart = (F.col("seeded_high") != F.col("remediated_high")) | (
        F.col("seeded_low") != F.col("remediated_low")
    )
    return per.select(
        "case_id",
        "metric",
        "seeded_low",
        "seeded_high",
        "remediated_low",
        "remediated_high",
        F.coalesce(apart, F.lit(False)).alias("discriminates"),
        F.coalesce(repeatable, F.lit(False)).alias("repeatable"),
    )


# -- coverage of the framework ------------------------------------------------------------------


def layer_coverage(
    modules: DataFrame, read: DataFrame, findings: DataFrame, routed: DataFrame | None = None
) -> DataFrame:
    """Per repository and specialist: where its concern appears, where it was read, what it said."""
    spark = modules.sparkSession
    owners = F.broadcast(dims.layers(spark))
    raised = (
        modules.select("repo_id", "path", F.explode("signals").alias("signal"))
        .join(owners, "signal")
        .select("repo_id", "path", "layer")
        .distinct()
    )
    marked = raised.join(
        read.select("repo_id", "path").distinct().withColumn("_read", F.lit(True)), ["repo_id", "path"], "left"
    )
    if routed is not None:
        asked = routed.select("repo_id", "path", F.lower(F.trim("layer")).alias("layer")).distinct()
        marked = marked.join(asked.withColumn("_asked", F.lit(True)), ["repo_id", "path", "layer"], "left")
    else:
        marked = marked.withColumn("_asked", F.lit(True))
    counted = marked.groupBy("repo_id", "layer").agg(
        F.count(F.lit(1)).alias("appears_in"),
        F.count_if(F.coalesce(F.col("_read") & F.col("_asked"), F.lit(False))).alias("reviewed"),
    )
    said = findings.groupBy("repo_id", F.lower(F.trim("layer")).alias("layer")).agg(
        F.count(F.lit(1)).alias("findings")
    )
    names = [name for name, _ in dims.LAYERS]
    frame = (
        modules.select("repo_id")
        .union(findings.select("repo_id"))
        .distinct()
        .withColumn("layer", F.explode(F.array(*[F.lit(n) for n in names])))
    )
    rows = (
        frame.join(counted, ["repo_id", "layer"], "left")
        .join(said, ["repo_id", "layer"], "left")
        .na.fill(0, ["appears_in", "reviewed", "findings"])
        .withColumn("share", ratio(F.col("reviewed"), F.col("appears_in")))
    )
    loose = (
        said.filter(~F.col("layer").isin(*names))
        .groupBy("repo_id")
        .agg(F.sum("findings").alias("findings"))
        .withColumn("layer", F.lit("unattributed"))
    )
    basis = "signalled" if routed is None else "routed"
    return rows.withColumn("basis", F.lit(basis)).unionByName(loose, allowMissingColumns=True)


def headline(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    def of(level: str) -> Column:
        return F.count_if(F.col("severity") == level).alias(level)

    settled = F.col("prediction").isNotNull() & F.col("measurement.value").isNotNull()
    return findings.groupBy(*by).agg(
        of("high"), of("medium"), of("low"), F.count(F.lit(1)).alias("total"), F.count_if(settled).alias("measured")
    )
