"""Filters, gates and verdicts over files, drafts and findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import dims
from plumbline.functions import text as t
from plumbline.schemas import PREDICTION, RUN


def severity_rank(col: Column) -> Column:
    return F.when(col == "high", 2).when(col == "medium", 1).otherwise(0)


# -- files ---------------------------------------------------------------------------------


def in_scope(path: Column, scopes: Sequence[str]) -> Column:
    """Equal to, or below, one of the scope directories. No scope admits everything."""
    wanted = [s.strip("/") for s in scopes if s.strip("/")]
    if not wanted:
        return F.lit(True)
    hit = F.lit(False)
    for scope in wanted:
        hit = hit | (path == scope) | path.startswith(scope + "/")
    return hit


def classify_exclusions(files: DataFrame, scopes: Sequence[str] = ()) -> DataFrame:
    """``files`` plus (category, reason); both null for a file that enters the map."""
    parts = F.split(F.col("path"), "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    named = dims.lookup(dims.EXCLUDED_DIRS)

    def verdict(part: Column) -> Column:
        """category|reason key for one directory, null where it excludes nothing."""
        why = F.try_element_at(named, part)
        return (
            F.when(why.isNotNull(), F.struct(part.alias("c"), why.alias("r")))
            .when(
                part.startswith(".") & ~part.isin(".", ".."), F.struct(part.alias("c"), F.lit("state").alias("r"))
            )
            .when(part.endswith(".egg-info"), F.struct(F.lit("egg-info").alias("c"), F.lit("build").alias("r")))
            .when(
                part.isin(*dims.GENERATED_DIRS),
                F.struct(F.lit("generated").alias("c"), F.lit("generated").alias("r")),
            )
            .when(
                part.isin(*dims.FIXTURE_DIRS),
                F.struct(F.lit("fixtures").alias("c"), F.lit("fixtures").alias("r")),
            )
        )

    outermost = F.try_element_at(
        F.filter(F.transform(folders, verdict), lambda v: v.isNotNull()), F.lit(1)
    )
    name = t.basename(F.col("path"))

    def ends(suffixes: Sequence[str]) -> Column:
        hit = F.lit(False)
        for s in suffixes:
            hit = hit | name.endswith(s)
        return hit

    def pair(category: str) -> Column:
        return F.struct(F.lit(category).alias("c"), F.lit(category).alias("r"))

    answer = (
        F.when(t.is_live_secret(name), pair("secrets"))
        .when(~in_scope(F.col("path"), scopes), pair("out_of_scope"))
        .when(outermost.isNotNull(), outermost)
        .when(ends(dims.MINIFIED_SUFFIXES), pair("minified"))
        .when(ends(dims.GENERATED_SUFFIXES), pair("generated"))
        .when(~t.suffix(F.col("path")).isin(*dims.EXTENSIONS), pair("unsupported"))
    )
    return (
        files.withColumn("_x", answer)
        .withColumn("category", F.col("_x.c"))
        .withColumn("reason", dims.choose(F.col("_x.r"), dims.EXCLUSION_REASONS))
        .drop("_x")
    )


def refuse_secret_files(files: DataFrame) -> DataFrame:
    name = t.basename(F.col("path"))
    return files.withColumn("is_secret", t.is_live_secret(name)).withColumn(
        "is_credential", t.is_live_credential(name)
    )


def flag_tests(files: DataFrame) -> DataFrame:
    return files.withColumn("is_test", t.is_test_path(F.col("path")))


def scope_filter(files: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """Files in scope. A scope that matches nothing is an error rather than an empty success."""
    kept = files.filter(in_scope(F.col("path"), scopes))
    if [s for s in scopes if s.strip("/")] and kept.isEmpty():
        raise ValueError(f"scope {list(scopes)} matched no files; an empty review is not a clean one")
    return kept


def refuse_files(files: DataFrame) -> DataFrame:
    """``files`` plus why each will not be read; null means it will be."""
    reason = (
        F.when(
            t.is_live_secret(t.basename(F.col("path"))), F.lit("holds live credentials and is never read")
        )
        .when(F.col("is_symlink"), F.lit("symlink"))
        .when(F.col("size") > dims.MAX_SOURCE_BYTES, F.lit("larger than the source size cap"))
    )
    return files.withColumn("refusal", reason)


def redact_secrets(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: t.redact(F.col(c)) for c in cols})


# -- predictions ----------------------------------------------------------------------------


def with_rejection(drafts: DataFrame) -> DataFrame:
    """``drafts`` plus ``reject_reason``: why no measurement could refute the prediction; null when one can."""
    return _judged(drafts).drop("_rejected")


def _judged(drafts: DataFrame) -> DataFrame:
    """``drafts`` plus ``reject_reason`` and ``_rejected``, which says without composing it whether there is one.

    Bounds come from a broadcast join with the table of units (13 fixed rows). A join also keeps the
    optimiser from inlining the lookup into every later use of the verdict.
    """
    units = F.broadcast(dims.units(drafts.sparkSession))
    unit = F.lower(F.trim(F.col("prediction.unit")))
    bounded = drafts.withColumn("_unit_key", unit).join(units, "_unit_key", "left")
    low, high = dims.UNKNOWN_UNIT
    bound = {
        "low": F.coalesce("_low", F.lit(low)),
        "high": F.coalesce("_high", F.lit(high)),
        "low_text": F.coalesce("_low_text", F.lit(f"{low:g}")),
        "high_text": F.coalesce("_high_text", F.lit(f"{high:g}")),
    }
    p = F.col("prediction")
    fields, shapes = _field_faults(p), _shape_faults(p, bound)
    some = reduce(or_, [fault for fault, _ in fields])
    for comparator, faults in shapes.items():
        some = some | ((p["comparator"] == comparator) & reduce(or_, [fault for fault, _ in faults]))

    def first_of(errors: Column) -> Column:
        case = F.when(errors != "", errors)
        for comparator, faults in shapes.items():
            case = case.when(p["comparator"] == comparator, reduce(lambda c, f: c.when(*f), faults[1:], F.when(*faults[0])))
        return case

    # Bound by a lambda, the errors are made once. It also keeps the texts out of the one method that generated code makes of
    # the joins and all that follows: beyond 8,000 bytes of bytecode the JVM interprets that method and never compiles it.
    errors = F.concat_ws("; ", *[F.when(fault, F.lit(text)) for fault, text in fields])
    reason = F.get(F.transform(F.array(errors), first_of), F.lit(0))
    return bounded.select(
        *drafts.columns,
        F.when(p.isNotNull(), reason).alias("reject_reason"),
        F.coalesce(p.isNotNull() & some, F.lit(False)).alias("_rejected"),
    )


def _field_faults(p: Column) -> list[tuple[Column, str]]:
    """(fault, text) of every field; all that hold are named."""

    def blank(c: str) -> tuple[Column, str]:
        return F.coalesce(p[c], F.lit("")) == "", f"{c}: String should have at least 1 character"

    def unusable(c: str) -> tuple[Column, str]:
        return F.abs(p[c]) >= float("inf"), f"{c}: Input should be a finite number"  # NaN is above infinity

    return [blank("metric"), unusable("value"), unusable("upper"), blank("unit"), blank("condition")]


def _shape_faults(p: Column, bound: dict[str, Column]) -> dict[str, list[tuple[Column, Column]]]:
    """(fault, text) by comparator; the first that holds is named."""
    value, upper, unit = p["value"], p["upper"], p["unit"]

    def vacuous(relation: str, text: Column) -> Column:
        return F.format_string(f"vacuous: {relation}, so this threshold excludes nothing", unit, text)

    return {
        "at_least": [(value <= bound["low"], vacuous("essentially every measurement in %s is at least %s", bound["low_text"]))],
        "at_most": [(value >= bound["high"], vacuous("no realisable measurement in %s exceeds %s", bound["high_text"]))],
        "between": [
            (upper.isNull(), F.lit("comparator BETWEEN requires an upper bound")),
            (value <= 0, F.lit("vacuous: a band starting at or below zero excludes nothing")),
            (upper > value * dims.WIDEST_BAND, F.lit("vacuous: a band spanning more than 100x admits almost every outcome")),
            (upper <= value, F.lit("upper bound must exceed the lower bound, or nothing can Hit")),
        ],
    }


def _gated(drafts: DataFrame) -> DataFrame:
    judged = _judged(drafts)
    kept = F.when(~F.col("_rejected"), F.col("prediction"))
    if drafts.schema["prediction"].dataType.simpleString() != PREDICTION:
        kept = kept.cast(PREDICTION)
    return judged.withColumn("prediction", kept)


def falsifiability_gate(drafts: DataFrame) -> DataFrame:
    """``drafts`` with ``reject_reason`` and the prediction nulled where it was rejected."""
    return _gated(drafts).drop("_rejected")


def _filled(drafts: DataFrame, locations: DataFrame | None) -> DataFrame:
    gated = _gated(drafts)
    if locations is not None:
        on = [c for c in ("repo_id", "path", "symbol") if c in locations.columns]
        gated = gated.join(locations, on, "left")
    else:
        gated = gated.withColumn("located", F.lit(None).cast("int"))
    empty = {c: "unknown" for c in ("path", "layer", "symbol")} | {c: "not stated" for c in ("mechanism", "remediation")}
    return gated.withColumns({c: t.blank_to(F.col(c), default) for c, default in empty.items()})


def _finding(keys: Sequence[str]) -> list[Column]:
    return [
        *map(F.col, keys),
        F.col("ord"),
        t.fits(F.col("path"), 4000).alias("path"),
        F.coalesce("located", F.greatest(F.col("line"), F.lit(0))).alias("line"),
        t.fits(F.col("layer"), 120).alias("layer"),
        t.fits(F.col("symbol"), 480).alias("symbol"),
        t.long_fits(F.col("mechanism"), 4000).alias("mechanism"),
        F.col("severity"),
        t.fits(F.col("remediation"), 4000).alias("remediation"),
        t.fits(F.coalesce("arithmetic", F.lit("")), 4000).alias("arithmetic"),
        F.col("prediction"),
    ]


DROPPED_MARKS = ["_rejected", "_reason", "_long_path", "_long_symbol"]


def mark_dropped(drafts: DataFrame, locations: DataFrame | None = None, keys: Sequence[str] = RUN) -> DataFrame:
    """Both sides of ``normalise_drafts`` in one row: the finding, and what its rejected prediction leaves, as marks.

    Written once, the rows are parted by ``normalise_drafts`` without the drafts being read for each side. Path and symbol
    are marked only where the finding has them cut.
    """

    def uncut(c: str, limit: int) -> Column:
        return F.when(F.col("_rejected") & (F.length(c) > limit), F.col(c))

    marks = [F.col("_rejected"), F.when(F.col("_rejected"), F.col("reject_reason")), uncut("path", 4000), uncut("symbol", 480)]
    return _filled(drafts, locations).select(*_finding(keys), *[m.alias(c) for c, m in zip(DROPPED_MARKS, marks, strict=True)])


def normalise_drafts(
    drafts: DataFrame, locations: DataFrame | None = None, keys: Sequence[str] = RUN
) -> tuple[DataFrame, DataFrame]:
    """(findings, dropped): the gate applied, blanks filled, long text cut, lines confirmed.

    ``locations`` is (path, symbol, located) from the definition lookup; null leaves the stated line. Rows of
    ``mark_dropped`` are only parted.
    """
    if "_rejected" in drafts.columns:
        whole = [F.coalesce(f"_long_{c}", c).alias(c) for c in ("path", "symbol")]
        dropped = drafts.filter("_rejected").select(*keys, *whole, F.col("_reason").alias("reason"))
        return drafts.drop(*DROPPED_MARKS), dropped
    filled = _filled(drafts, locations)
    dropped = filled.filter("_rejected").select(*keys, "path", "symbol", F.col("reject_reason").alias("reason"))
    return filled.select(*_finding(keys)), dropped


def grade(findings: DataFrame) -> DataFrame:
    """``findings`` plus verdict (hit, miss, broken or null), is_falsifiable and was_tested."""
    p, m = F.col("prediction"), F.col("measurement")
    value = m["value"]
    hit = (
        F.when(p["comparator"] == "at_least", value >= p["value"])
        .when(p["comparator"] == "at_most", value <= p["value"])
        .when(p["comparator"] == "between", value.between(p["value"], p["upper"]))
    )
    no_number = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    verdict = F.when(p.isNull() | m.isNull(), F.lit(None).cast("string")).otherwise(
        F.when(no_number, F.lit("broken")).when(hit, F.lit("hit")).otherwise(F.lit("miss"))
    )
    return (
        findings.withColumn("verdict", verdict)
        .withColumn("is_falsifiable", p.isNotNull())
        .withColumn("was_tested", F.coalesce(F.col("verdict").isin("hit", "miss"), F.lit(False)))
    )


def cap_severity(findings: DataFrame, modules: DataFrame) -> DataFrame:
    """Lower, never raise: unreachable code to low, four or more hops away to medium.

    Modules are unique per (repo_id, path), so the repository flag rides on the same join.
    """
    has_entry = modules.groupBy("repo_id").agg(F.bool_or(F.col("depth").isNotNull()).alias("_has_entry"))
    known = modules.select("repo_id", "path", "depth", F.lit(True).alias("_known")).join(has_entry, "repo_id")
    joined = findings.join(known, ["repo_id", "path"], "left")
    depth = F.col("depth")
    ceiling = F.when(depth.isNull(), F.lit("low")).when(depth >= 4, F.lit("medium"))
    why = F.when(depth.isNull(), F.lit("no entrypoint reaches this module")).otherwise(
        F.concat(depth.cast("string"), F.lit(" hops from the nearest entrypoint"))
    )
    lowered = (
        F.coalesce(F.col("_known") & F.col("_has_entry"), F.lit(False))
        & ceiling.isNotNull()
        & (severity_rank(F.col("severity")) > severity_rank(ceiling))
    )
    return (
        joined.withColumn("_lowered", F.coalesce(lowered, F.lit(False)))
        .withColumn(
            "mechanism",
            F.when(
                F.col("_lowered"),
                F.concat(F.col("mechanism"), F.lit(" (Severity lowered: "), why, F.lit(".)")),
            ).otherwise(F.col("mechanism")),
        )
        .withColumn("severity", F.when(F.col("_lowered"), ceiling).otherwise(F.col("severity")))
        .drop("_known", "_has_entry", "_lowered", "depth")
    )


def why_unread(signals: Column, unmatched: Column) -> Column:
    return (
        F.when(F.size(signals) > 0, F.lit("budget"))
        .when(F.size(unmatched) > 0, F.lit("no detector matched its imports"))
        .otherwise(F.lit("no signal"))
    )


def why_skipped(modules: DataFrame, read: DataFrame) -> DataFrame:
    """(repo_id, path, reason) of every module no review read."""
    return modules.join(read.select("repo_id", "path"), ["repo_id", "path"], "left_anti").select(
        "repo_id", "path", why_unread(F.col("signals"), F.col("unmatched_imports")).alias("reason")
    )
