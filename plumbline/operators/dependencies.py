"""Pins against the registry, and where to read about the gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import dims
from plumbline.operators.scan import spread_join


def _major(version: Column) -> Column:
    return F.regexp_extract(version, r"^(\d+)", 1).try_cast("bigint")


def dependency_audit(pins: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rule findings, coverage per repository). A pin with no registry answer is unknown, not current."""
    answer = registry.select("name", "latest", "released", F.lit(True).alias("_known"))
    joined = spread_join(pins, answer, ["name"], "left").withColumn("_pinned", F.coalesce("version", F.lit("")) != "")
    behind = F.greatest(F.lit(0).cast("bigint"), _major(F.col("latest")) - _major(F.col("version")))
    judged = joined.withColumn("_behind", F.coalesce(behind, F.lit(0).cast("bigint"))).withColumn(
        "rule",
        F.when(~F.col("_pinned"), F.lit("dependency-unpinned")).when(
            F.coalesce("_known", F.lit(False)) & (F.col("_behind") >= 1), F.lit("dependency-major-versions-behind")
        ),
    )
    name = F.concat(F.lit("`"), F.col("name"), F.lit("`"))
    plural = F.when(F.col("_behind") == 1, F.lit("major version")).otherwise(
        F.concat(F.col("_behind").cast("string"), F.lit(" major versions"))
    )
    detail = F.when(
        ~F.col("_pinned"),
        F.concat(
            name,
            F.lit(" is declared with no version"),
            F.coalesce(F.concat(F.lit("; the registry ships "), F.col("latest")), F.lit("")),
        ),
    ).otherwise(
        F.concat(
            name,
            F.lit(" is pinned at "),
            F.col("version"),
            F.lit(" and the registry ships "),
            F.col("latest"),
            F.lit(", released "),
            F.coalesce(F.nullif("released", F.lit("")), F.lit("recently")),
            F.lit(": "),
            plural,
            F.lit(" behind"),
        )
    )
    fix = (
        F.when(F.col("_pinned"), F.concat(F.lit("Read the changelog of "), F.col("name"), F.lit(" before upgrading")))
        .when(F.col("latest").isNotNull(), F.concat(F.lit("Pin it: "), F.col("name"), F.lit("=="), F.col("latest")))
        .otherwise(F.concat(F.lit("Pin "), F.col("name"), F.lit(" to the installed version")))
    )
    findings = judged.filter("rule is not null").select(
        "repo_id", "rule", F.lit("requirements").alias("path"), F.lit(1).alias("line"), detail.alias("detail"), fix.alias("remediation")
    )
    unreachable = F.col("_known").isNull() & F.col("_pinned")
    coverage = judged.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("declared"),
        F.count_if(unreachable).alias("unreachable"),
        F.count_if(~unreachable).alias("checked"),
    )
    return findings, coverage


def describe_versions(external: DataFrame, pins: DataFrame, registry: DataFrame) -> DataFrame:
    """(repo_id, path, name, line): what the repository declares and what is current, per imported package."""
    key = F.coalesce(
        dims.choose(F.col("name"), dims.DISTRIBUTION_OF), F.replace(F.lower("name"), F.lit("_"), F.lit("-"))
    )
    asked = external.select("repo_id", "name").distinct().withColumn("_key", key)
    declared = asked.join(
        pins.select("repo_id", F.col("name").alias("_key"), F.coalesce("version", F.lit("")).alias("_v"), F.lit(True).alias("_declared")),
        ["repo_id", "_key"],
        "left",
    )
    facts = registry.select(F.col("name").alias("_key"), F.coalesce("latest", F.lit("")).alias("_latest"))
    joined = spread_join(declared, facts, ["_key"], "left")
    v, latest = F.col("_v"), F.coalesce("_latest", F.lit(""))
    said = (
        F.when(
            F.col("_declared").isNull(),
            F.lit("not declared in this repository's dependencies, so its version is unknown here"),
        )
        .when((v != "") & (latest != "") & (v != latest), F.concat(v, F.lit(" installed, "), latest, F.lit(" current")))
        .when((v != "") & (v == F.col("_latest")), F.concat(v, F.lit(", current")))
        .when(v != "", F.concat(v, F.lit(" installed")))
        .when(latest != "", F.concat(F.lit("not pinned, "), latest, F.lit(" current")))
        .otherwise(F.lit("version not declared anywhere in this repository"))
    )
    lines = joined.select(
        "repo_id", "name", F.concat(F.lit("- `"), F.col("name"), F.lit("`: "), said).alias("line")
    )
    return spread_join(external.select("repo_id", "path", "name").distinct(), lines, ["repo_id", "name"]).select(
        "repo_id", "path", "name", "line"
    )


def version_block(described: DataFrame) -> DataFrame:
    """One text per module: its lines in name order. A module's imports bound the array."""
    pairs = F.array_sort(F.collect_list(F.struct("name", "line")))
    return described.groupBy("repo_id", "path").agg(
        F.array_join(F.transform(pairs, lambda p: p["line"]), "\n").alias("lines")
    )


def rank_notes(results: DataFrame, most: int = 3) -> DataFrame:
    """``results(repo_id, package, title, url)`` to the best ``most`` pages of each package."""
    low = F.lower("url")
    stem = F.replace(F.lower("package"), F.lit("_"), F.lit("-"))
    short = F.regexp_replace(stem, "-py$", "")
    hosts = F.lit(False)
    for host in dims.RELEASE_HOSTS:
        hosts = hosts | low.contains(host)
    said = F.lower(F.concat_ws(" ", "url", "title"))

    def bounded(name: Column) -> Column:
        quoted = F.regexp_replace(name, r"([\\.\[\]{}()*+?^$|#])", r"\\$1")
        return F.concat(F.lit("(?<![a-z0-9])"), quoted, F.lit("(?![a-z0-9])"))

    mentioned = (short != "") & (F.regexp_like(said, bounded(stem)) | F.regexp_like(said, bounded(short)))
    owned = F.arrays_overlap(F.filter(F.split(low, "/"), lambda p: p != ""), F.array(stem, short))
    score = 2 * hosts.cast("int") + 3 * mentioned.cast("int") + 5 * owned.cast("int")
    order = Window.partitionBy("repo_id", "package").orderBy(F.desc("score"), "url", "title")
    return (
        results.filter(F.col("url").startswith("http"))
        .select("repo_id", "package", "title", "url", score.alias("score"))
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= most)
    )
