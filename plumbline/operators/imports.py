"""From imported names to edges of the module graph, and to concerns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import dims
from plumbline.functions import text as t
from plumbline.operators.scan import spread_join


def _segments(path: Column) -> Column:
    """Path segments of the dotted name; ``__init__`` names its folder."""
    parts = F.split(t.without_extension(path), "/")
    return F.when(F.element_at(parts, -1) == "__init__", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def package_depths(files: DataFrame) -> DataFrame:
    """(repo_id, path, _root): how many leading folders lie outside the file's package."""
    python = files.filter(F.col("path").endswith(".py")).select("repo_id", "path")
    packages = (
        python.filter(t.basename(F.col("path")) == "__init__.py")
        .select("repo_id", t.directory(F.col("path")).alias("_dir"))
        .withColumn("_is_package", F.lit(True))
    )
    folders = F.split(t.directory(F.col("path")), "/")
    depth = F.when(t.directory(F.col("path")) == "", 0).otherwise(F.size(folders))
    above = python.withColumn("_depth", depth).withColumn(
        "_level", F.explode_outer(F.when(F.col("_depth") > 0, F.sequence(F.lit(1), F.col("_depth"))))
    )
    above = above.withColumn("_dir", F.array_join(F.slice(folders, F.lit(1), F.coalesce("_level", F.lit(0))), "/"))
    # the innermost folder that is not a package ends the package
    return (
        spread_join(above, packages, ["repo_id", "_dir"], "left")
        .groupBy("repo_id", "path")
        .agg(F.coalesce(F.max(F.when(F.col("_is_package").isNull(), F.col("_level"))), F.lit(0)).alias("_root"))
    )


def packages_of(files: DataFrame) -> DataFrame:
    """(repo_id, path, package) a relative import inside the file is resolved against."""
    roots = package_depths(files)
    inside = F.slice(_segments(F.col("path")), F.col("_root") + 1, F.greatest(F.size(_segments(F.col("path"))) - F.col("_root"), F.lit(0)))
    own = t.basename(F.col("path")) == "__init__.py"
    package = F.when(own, inside).otherwise(F.slice(inside, F.lit(1), F.greatest(F.size(inside) - 1, F.lit(0))))
    return roots.select("repo_id", "path", F.array_join(package, ".").alias("package"))


def module_name_index(files: DataFrame) -> DataFrame:
    """(repo_id, name, path): one path per importable dotted name.

    Names are the whole dotted path, the one inside its package, and every suffix of two segments or
    more. A package ``__init__`` wins a collision (the last of several), otherwise the first path.
    """
    parts = _segments(F.col("path"))
    n = F.size(parts)
    starts = F.array_distinct(
        F.concat(
            F.array(F.lit(0), F.col("_root")),
            F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>")),
        )
    )
    names = (
        package_depths(files)
        .filter(n > 0)
        .withColumn("_start", F.explode(starts))
        .filter(F.col("_start") < n)
        .withColumn("name", F.array_join(F.slice(parts, F.col("_start") + 1, n), "."))
        .filter(F.col("name") != "")
    )
    order = F.split("path", "/")
    is_init = t.basename(F.col("path")) == "__init__.py"
    return names.groupBy("repo_id", "name").agg(
        F.coalesce(F.max_by("path", F.when(is_init, order)), F.min_by("path", order)).alias("path")
    )


def resolve_names(names: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct (repo_id, name) with the path of its longest indexed prefix, where there is one."""
    wanted = names.select("repo_id", "name").distinct()
    parts = F.split("name", r"\.")
    prefixes = wanted.withColumn("_n", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn(
        "_prefix", F.array_join(F.slice(parts, F.lit(1), F.col("_n")), ".")
    )
    target = index.select("repo_id", F.col("name").alias("_prefix"), F.col("path").alias("target"))
    return (
        prefixes.join(target, ["repo_id", "_prefix"])
        .groupBy("repo_id", "name")
        .agg(F.max_by("target", "_n").alias("target"))
    )


def _edges(asked: DataFrame, resolved: DataFrame) -> DataFrame:
    return (
        spread_join(asked, resolved, ["repo_id", "name"])
        .select("repo_id", F.col("path").alias("src"), F.col("target").alias("dst"))
        .filter("src <> dst")
        .distinct()
    )


def resolve_imports(imports: DataFrame, index: DataFrame) -> DataFrame:
    """Edges of dotted imports. ``imports`` is (repo_id, path, name)."""
    dotted = imports.filter(~F.col("name").startswith("."))
    return _edges(dotted, resolve_names(dotted, index))


def normalised(path: Column) -> Column:
    """``a/./b/../c`` -> ``a/c``; a step above the root keeps its ``..``."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        top = F.try_element_at(acc, F.lit(-1))
        pops = (part == "..") & top.isNotNull() & (top != "..")
        return (
            F.when((part == "") | (part == "."), acc)
            .when(pops, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(part)))
        )

    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


def resolve_relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of ``./x`` specifiers: the written extension is dropped, then twelve candidates are tried."""
    relative = imports.filter(F.col("name").startswith("."))
    target = normalised(F.concat_ws("/", t.directory(F.col("path")), F.col("name")))
    script = "|".join(s.replace(".", r"\.") for s in dims.SCRIPT_SUFFIXES)
    base = F.regexp_replace(target, rf"(?<=[^/])(?:{script})$", "")
    candidates = F.array(
        *[F.concat(F.col("_base"), F.lit(s)) for s in dims.SCRIPT_SUFFIXES],
        *[F.concat(F.col("_base"), F.lit("/index" + s)) for s in dims.SCRIPT_SUFFIXES],
    )
    tried = relative.withColumn("_base", base).select(
        "repo_id", F.col("path").alias("src"), "name", F.posexplode(candidates).alias("_rank", "path")
    )
    known = files.select("repo_id", "path").distinct()
    return (
        spread_join(tried, known, ["repo_id", "path"])
        .groupBy("repo_id", "src", "name")
        .agg(F.min_by("path", "_rank").alias("dst"))
        .select("repo_id", "src", "dst")
        .filter("src <> dst")
        .distinct()
    )


def resolve_strings(strings: DataFrame, index: DataFrame) -> DataFrame:
    """Edges of string constants naming a module; the whole name or nothing."""
    named = strings.select("repo_id", "name").distinct()
    exact = named.join(index.withColumnRenamed("path", "target"), ["repo_id", "name"])
    return _edges(strings, exact)


def import_edges(parsed: DataFrame, files: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """The whole import graph: dotted, relative and string edges, distinct, no self-edges."""
    index = module_name_index(files) if index is None else index
    imports = parsed.select("repo_id", "path", F.explode("imports").alias("name"))
    strings = parsed.select("repo_id", "path", F.explode("named_in_strings").alias("name"))
    return (
        resolve_imports(imports, index)
        .unionByName(resolve_relative(imports, files))
        .unionByName(resolve_strings(strings, index))
        .distinct()
    )


def _leading(name: Column) -> Column:
    """The name itself and everything before each of its separators."""
    cuts = F.filter(
        F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))),
        lambda i: F.substr(name, i, F.lit(1)).isin("/", ".") | (F.substr(name, i, F.lit(2)) == "::"),
    )
    heads = F.transform(cuts, lambda i: F.substr(name, F.lit(1), i - 1))
    return F.array_distinct(F.concat(heads, F.array(name)))


def route_signals(imports: DataFrame, detected: DataFrame | None = None) -> DataFrame:
    """Distinct (repo_id, path, signal). ``imports`` is (repo_id, path, language, name).

    Python matches the top-level name, the others any leading segment run, so both are equi-joins
    against a table of a few hundred fixed rows.
    """
    concerns = F.broadcast(dims.concerns(imports.sparkSession).withColumnRenamed("name", "_lead"))
    lead = F.when(
        F.col("language") == "python", F.array(F.element_at(F.split("name", r"\."), 1))
    ).otherwise(_leading(F.col("name")))
    routed = (
        imports.withColumn("_lead", F.explode(lead))
        .join(concerns, ["language", "_lead"])
        .select("repo_id", "path", "signal")
    )
    if detected is not None:
        routed = routed.unionByName(detected.select("repo_id", "path", "signal"))
    return routed.distinct()


def unmatched_imports(imports: DataFrame, index: DataFrame) -> DataFrame:
    """(repo_id, path, name) no detector knows and no module of the repository answers to."""
    concerns = dims.concerns(imports.sparkSession).select("language", F.col("name").alias("_lead")).distinct()
    own = F.when(F.col("language") == "python", F.element_at(F.split("name", r"\."), 1)).otherwise(F.col("name"))
    named = imports.select("repo_id", "path", "language", own.alias("name")).distinct()
    lead = F.when(F.col("language") == "python", F.array("name")).otherwise(_leading(F.col("name")))
    matched = (
        named.withColumn("_lead", F.explode(lead))
        .join(F.broadcast(concerns), ["language", "_lead"])
        .select("repo_id", "path", "name")
        .distinct()
    )
    open_names = named.filter(
        ~((F.col("language") == "python") & F.col("name").isin(*dims.INERT_IMPORTS))
    ).join(matched, ["repo_id", "path", "name"], "left_anti")
    answered = resolve_names(open_names, index).select("repo_id", "name")
    return open_names.join(answered, ["repo_id", "name"], "left_anti").select("repo_id", "path", "name").distinct()


def external_packages(parsed: DataFrame, index: DataFrame) -> DataFrame:
    """(repo_id, path, name) imported from outside the standard library and the repository."""
    named = parsed.select("repo_id", "path", F.explode("third_party").alias("name")).distinct()
    answered = resolve_names(named, index).select("repo_id", "name")
    return named.join(answered, ["repo_id", "name"], "left_anti").select("repo_id", "path", "name")
