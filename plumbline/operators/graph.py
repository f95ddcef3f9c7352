"""The module graph and what is read off it."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import dims
from plumbline.functions import text as t
from plumbline.operators.grading import ratio
from plumbline.operators.scan import spread_join
from plumbline.session import cut_lineage


def fan_in(modules: DataFrame, edges: DataFrame) -> DataFrame:
    counts = (
        edges.select("repo_id", "src", "dst")
        .distinct()
        .groupBy("repo_id", F.col("dst").alias("path"))
        .agg(F.count(F.lit(1)).cast("int").alias("fan_in"))
    )
    return modules.drop("fan_in").join(counts, ["repo_id", "path"], "left").na.fill(0, ["fan_in"])


def request_depth(modules: DataFrame, edges: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """Hops from the nearest entrypoint, null where none reaches.

    One distributed hop per loop turn: the frontier joins the edges and drops what was seen. Each
    frontier is written once (reliable checkpoint), so plans stay flat and survive a lost executor.
    The driver learns only whether a frontier is empty.
    """
    paths = modules.select("repo_id", "path").distinct()
    # the edges are held once: every hop reads them, none recomputes them
    graph = cut_lineage(
        edges.select("repo_id", F.col("src").alias("path"), "dst")
        .distinct()
        .join(paths.withColumnRenamed("path", "dst"), ["repo_id", "dst"], "left_semi")
    )
    frontier = cut_lineage(
        entrypoints.select("repo_id", "path").distinct().join(paths, ["repo_id", "path"], "left_semi")
    )
    layers = [frontier.withColumn("depth", F.lit(0))]
    seen = frontier
    for hop in count(1):
        reached = (
            graph.join(frontier, ["repo_id", "path"], "left_semi")
            .select("repo_id", F.col("dst").alias("path"))
            .distinct()
            .join(seen, ["repo_id", "path"], "left_anti")
        )
        frontier = cut_lineage(reached)
        if frontier.isEmpty():
            break
        layers.append(frontier.withColumn("depth", F.lit(hop)))
        seen = cut_lineage(seen.unionByName(frontier)) if hop % 8 == 0 else seen.unionByName(frontier)
    depths = layers[0]
    for layer in layers[1:]:
        depths = depths.unionByName(layer)
    return modules.drop("depth").join(depths, ["repo_id", "path"], "left")


def entrypoints_of(modules: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Modules with an entrypoint signal, or whose path minus extension a service declares."""
    signalled = modules.filter(F.array_contains("signals", "entrypoint")).select("repo_id", "path")
    if declared is None:
        return signalled
    named = (
        modules.select("repo_id", "path", t.without_extension(F.col("path")).alias("ref"))
        .join(declared.select("repo_id", F.trim(F.col("ref"), F.lit("/")).alias("ref")), ["repo_id", "ref"], "left_semi")
        .select("repo_id", "path")
    )
    return signalled.unionByName(named).distinct()


def _reachable_repos(modules: DataFrame) -> DataFrame:
    return modules.filter("depth is not null").select("repo_id").distinct()


def unreachable_modules(modules: DataFrame) -> DataFrame:
    """Modules no entrypoint reaches, in repositories where something is reached."""
    return (
        modules.filter("depth is null")
        .join(_reachable_repos(modules), "repo_id", "left_semi")
        .select("repo_id", "path")
    )


def request_tiers(modules: DataFrame) -> DataFrame:
    """(repo_id, depth, modules, path), one row per reached module: a tier is never gathered in one row."""
    reached = modules.filter("depth is not null").select("repo_id", "depth", "path")
    sizes = reached.groupBy("repo_id", "depth").agg(F.count(F.lit(1)).alias("modules"))
    return spread_join(reached, sizes, ["repo_id", "depth"]).select("repo_id", "depth", "modules", "path")


def suspect_neighbours(edges: DataFrame, findings: DataFrame) -> DataFrame:
    """(repo_id, path, boost) from the findings in the modules each module imports."""
    found = findings.groupBy("repo_id", F.col("path").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    distinct = edges.select("repo_id", "src", "dst").distinct()
    return (
        spread_join(distinct, found, ["repo_id", "dst"])
        .groupBy("repo_id", F.col("src").alias("path"))
        .agg((1.0 + 0.5 * F.sum("n")).alias("boost"))
    )


def module_value(modules: DataFrame, boosts: DataFrame | None = None) -> DataFrame:
    """Expected yield of reading a module; order by value, then path, both descending."""
    m = modules
    if boosts is not None:
        m = m.join(boosts, ["repo_id", "path"], "left")
    else:
        m = m.withColumn("boost", F.lit(None).cast("double"))
    reach = F.when(F.col("depth").isNull(), 0.25).otherwise(F.pow(F.lit(0.6), F.col("depth").cast("double")))
    entry = F.when(F.array_contains("signals", "entrypoint"), 2.0).otherwise(1.0)
    value = (
        (1.0 + F.col("fan_in"))
        * F.size("signals")
        * (1.0 + 0.1 * F.coalesce("churn", F.lit(0)))
        * entry
        * reach
        * F.coalesce("boost", F.lit(1.0))
        / F.sqrt(F.greatest("loc", F.lit(1)).cast("double"))
    )
    return m.withColumn("value", value).drop("boost")


def package_of(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(1)))), "/")


def package_rollup(modules: DataFrame, findings: DataFrame, most: int = 14) -> DataFrame:
    """The widest packages of each repository: modules, findings and hops from an entrypoint."""
    found = findings.filter("path <> ''").groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("_f"))
    grouped = (
        modules.join(found, ["repo_id", "path"], "left")
        .groupBy("repo_id", package_of(F.col("path")).alias("package"))
        .agg(
            F.count(F.lit(1)).alias("modules"),
            F.coalesce(F.sum("_f"), F.lit(0)).alias("findings"),
            (F.min("depth") + 1).alias("depth"),
        )
    )
    order = Window.partitionBy("repo_id").orderBy(F.desc("findings"), F.desc("modules"), "package")
    return (
        grouped.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= most)
        .withColumn("label", t.basename(F.col("package")))
    )


def service_package_edges(services: DataFrame, packages: DataFrame) -> DataFrame:
    """Up to two serving services by the four shallowest packages of the same repository."""
    serving = F.size("ports") > 0
    per_repo = services.groupBy("repo_id").agg(F.bool_or(serving).alias("_any"))
    chosen = services.join(per_repo, "repo_id").filter(~F.col("_any") | serving)
    first = Window.partitionBy("repo_id").orderBy("ord", "name")
    two = chosen.withColumn("_r", F.row_number().over(first)).filter("_r <= 2")
    near = Window.partitionBy("repo_id").orderBy(
        F.coalesce(F.nullif("depth", F.lit(0)), F.lit(99)), F.desc("modules"), "position"
    )
    four = packages.withColumn("_r", F.row_number().over(near)).filter("_r <= 4")
    return two.select("repo_id", F.concat(F.lit("svc:"), "name").alias("source")).join(
        four.select("repo_id", F.concat(F.lit("code:"), "package").alias("target")), "repo_id"
    ).withColumn("why", F.lit("a request reaches this package"))


def package_store_edges(packages: DataFrame, external: DataFrame, backing: DataFrame) -> DataFrame:
    """Package to store, only where a module under it imports a client of that store.

    Clients join on their name first; what is left meets the at most 14 packages of its repository.
    """
    names = F.create_map(*[x for k, v in dims.STORE_CLIENTS.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    clients = backing.select(
        "repo_id",
        F.col("name").alias("store"),
        F.explode(F.coalesce(F.try_element_at(names, F.col("name")), F.array("name"))).alias("name"),
    ).distinct()
    users = spread_join(external, clients, ["repo_id", "name"]).select("repo_id", "path", "store").distinct()
    return (
        spread_join(users, packages.select("repo_id", "package"), ["repo_id"])
        .filter(F.col("path").startswith(F.col("package")))
        .select(
            "repo_id",
            F.concat(F.lit("code:"), "package").alias("source"),
            F.concat(F.lit("store:"), "store").alias("target"),
            F.concat(F.lit("imports a "), "store", F.lit(" client")).alias("why"),
        )
        .distinct()
    )


def allowed_layers(signals: Column) -> Column:
    """Specialists these signals justify, in declaration order."""
    table = F.array(
        *[
            F.struct(F.lit(name).alias("layer"), F.array(*[F.lit(s) for s in owned]).alias("signals"))
            for name, owned in dims.LAYERS
        ]
    )
    return F.transform(
        F.filter(table, lambda x: F.arrays_overlap(x["signals"], signals)), lambda x: x["layer"]
    )


def choose_specialists(modules: DataFrame, choices: DataFrame) -> DataFrame:
    """(repo_id, path, allowed, layers, unread). ``choices`` is (repo_id, path, names); it narrows only."""
    named = F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.lower(F.trim(n)))
    joined = modules.select("repo_id", "path", allowed_layers(F.col("signals")).alias("allowed")).join(
        choices.select("repo_id", "path", "names"), ["repo_id", "path"], "left"
    )
    layers = F.when(F.size("allowed") <= 1, F.col("allowed")).otherwise(
        F.filter("allowed", lambda x: F.array_contains(named, x))
    )
    return joined.select("repo_id", "path", "allowed", layers.alias("layers")).withColumn(
        "unread", (F.size("allowed") > 0) & (F.size("layers") == 0)
    )


# -- counts ----------------------------------------------------------------------------------------


def exclusion_tally(classified: DataFrame) -> DataFrame:
    return (
        classified.filter("category is not null")
        .groupBy("repo_id", "category", "reason")
        .agg(F.count(F.lit(1)).alias("files"))
    )


def churn(commit_files: DataFrame) -> DataFrame:
    named = commit_files.filter(F.trim("path") != "")
    return named.groupBy("repo_id", F.trim("path").alias("path")).agg(F.count(F.lit(1)).alias("churn"))


def language_concern_counts(modules: DataFrame, unparsed: DataFrame) -> DataFrame:
    """(repo_id, kind, name, modules, lines): languages, concerns and totals of the map."""
    language = dims.choose(t.suffix(F.col("path")), dims.EXTENSIONS)
    languages = modules.groupBy("repo_id", F.lit("language").alias("kind"), language.alias("name")).agg(
        F.count(F.lit(1)).alias("modules"), F.sum("loc").alias("lines")
    )
    concerns = (
        modules.select("repo_id", F.explode("signals").alias("name"))
        .groupBy("repo_id", F.lit("concern").alias("kind"), "name")
        .agg(F.count(F.lit(1)).alias("modules"), F.lit(None).cast("bigint").alias("lines"))
    )
    reached = (
        modules.groupBy("repo_id")
        .agg(
            F.count_if(F.col("depth").isNotNull()).alias("reachable"),
            F.count(F.lit(1)).alias("mapped"),
        )
        .join(unparsed.groupBy("repo_id").agg(F.count(F.lit(1)).alias("unparsed")), "repo_id", "left")
        .na.fill(0, ["unparsed"])
        .withColumn("unreachable", F.when(F.col("reachable") > 0, F.col("mapped") - F.col("reachable")).otherwise(0))
        .select(
            "repo_id",
            F.lit("total").alias("kind"),
            F.expr("stack(3, 'reachable', reachable, 'unreachable', unreachable, 'unparsed', unparsed) as (name, modules)"),
        )
        .withColumn("lines", F.lit(None).cast("bigint"))
    )
    return languages.unionByName(concerns).unionByName(reached)


def not_read_breakdown(coverage: DataFrame, modules: DataFrame, most: int = 6) -> DataFrame:
    """(repo_id, kind, label, n, share): three populations, then the commonest skip reasons."""
    mapped = modules.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("mapped"),
        F.count_if(F.col("depth").isNull()).alias("_none"),
        F.count_if(F.col("depth").isNotNull()).alias("_some"),
    )
    # the ledger is counted once, by reason; both sides below read the counts
    counted = cut_lineage(coverage.groupBy("repo_id", "status", F.col("reason").alias("label")).agg(F.count(F.lit(1)).alias("n")))
    read = counted.filter("status = 'analysed'").groupBy("repo_id").agg(F.sum("n").alias("read"))
    facts = (
        mapped.join(read, "repo_id", "left")
        .na.fill(0, ["read"])
        .withColumn("not_read", F.greatest(F.col("mapped") - F.col("read"), F.lit(0)))
        .withColumn("unreached", F.when(F.col("_some") > 0, F.col("_none")).otherwise(0))
    )
    populations = facts.select(
        "repo_id",
        "mapped",
        F.expr(
            "stack(3, 'read by a specialist', read, 'mapped, not read', not_read, 'no request reaches', unreached)"
            " as (label, n)"
        ),
    ).select("repo_id", F.lit("population").alias("kind"), "label", "n", ratio(F.col("n"), F.col("mapped")).alias("share"))
    reasons = (
        counted.filter("status = 'skipped'")
        .select("repo_id", "label", "n")
        .withColumn("_r", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("n"), "label")))
        .filter(F.col("_r") <= most)
        .select("repo_id", F.lit("reason").alias("kind"), "label", "n", F.lit(None).cast("double").alias("share"))
    )
    return populations.unionByName(reasons)


FILE_STATES = ("unread", "read", "reading", "flagged")


def directory_rollup(modules: DataFrame, file_states: DataFrame) -> DataFrame:
    """(repo_id, directory, modules, state): a directory is as read as the most-read thing beneath it."""
    states = F.array(*[F.lit(s) for s in FILE_STATES])
    ranked = modules.select("repo_id", "path").join(file_states, ["repo_id", "path"], "left").withColumn(
        "_rank", F.coalesce(F.array_position(states, F.col("state")), F.lit(1))
    )
    parts = F.split("path", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )
    return (
        ranked.filter(F.size(parts) > 1)
        .select("repo_id", "_rank", F.explode(above).alias("directory"))
        .groupBy("repo_id", "directory")
        .agg(F.count(F.lit(1)).alias("modules"), F.max("_rank").alias("_rank"))
        .select("repo_id", "directory", "modules", F.element_at(states, F.col("_rank").cast("int")).alias("state"))
    )
