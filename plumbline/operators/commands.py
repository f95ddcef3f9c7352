"""What start commands, experiment logs and provider errors say."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import dims
from plumbline.operators.scan import spread_join


def _tokens(command: Column) -> Column:
    return F.filter(F.split(F.coalesce(command, F.lit("")), r"\s+"), lambda w: w != "")


def _pairs(words: Column) -> Column:
    """(word, next) for every word; next is null at the end."""
    return F.transform(
        words, lambda w, i: F.struct(w.alias("w"), F.try_element_at(words, (i + 2).cast("int")).alias("next"))
    )


def declared_concurrency(command: Column) -> Column:
    """The integer a concurrency flag declares, or null: unknown is not one."""
    pairs = _pairs(_tokens(command))
    stated = F.transform(
        F.filter(pairs, lambda p: F.element_at(F.split(p["w"], "="), 1).isin(*dims.CONCURRENCY_FLAGS)),
        lambda p: F.coalesce(F.nullif(F.regexp_extract(p["w"], r"=(.*)$", 1), F.lit("")), p["next"]),
    )
    numbers = F.filter(stated, lambda s: s.rlike(r"^\d+$") & (s.try_cast("bigint") > 0))
    return F.try_element_at(numbers, F.lit(1)).try_cast("bigint")


def ceilings(command: Column, flags: Sequence[str], bare: bool) -> Column:
    """Capacity flags as written, joined by spaces. ``bare`` keeps one with no value."""
    pairs = _pairs(_tokens(command))
    named = F.filter(pairs, lambda p: F.element_at(F.split(p["w"], "="), 1).isin(*flags))
    kept = F.transform(
        named,
        lambda p: F.when(p["w"].contains("=") | p["next"].isNull(), p["w"]).otherwise(
            F.concat(p["w"], F.lit(" "), p["next"])
        ),
    )
    if not bare:
        kept = F.transform(
            F.filter(named, lambda p: p["w"].contains("=") | p["next"].isNotNull()),
            lambda p: F.when(p["w"].contains("="), p["w"]).otherwise(F.concat(p["w"], F.lit(" "), p["next"])),
        )
    return F.array_join(kept, " ")


def role(command: Column, ports: Column) -> Column:
    """What a service runs, short enough to tell six workers apart."""
    words = _tokens(command)
    program = F.try_element_at(words, F.lit(1))
    port = F.try_element_at(F.regexp_extract_all(F.try_element_at(ports, F.lit(1)), F.lit(r"(\d+)"), 1), F.lit(-1))
    queue = F.try_element_at(
        F.filter(_pairs(words), lambda p: p["w"].isin("-Q", "--queues") & p["next"].isNotNull()), F.lit(1)
    )["next"]
    celery = (
        F.when(F.array_contains(words, "beat"), F.lit("celery beat"))
        .when(F.array_contains(words, "flower"), F.lit("celery flower"))
        .when(queue.isNotNull(), F.concat(F.lit("celery worker -Q "), queue))
        .otherwise(F.lit("celery worker"))
    )
    target = F.try_element_at(
        F.filter(
            F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))),
            lambda w: w.contains(":") & ~w.startswith("-"),
        ),
        F.lit(1),
    )
    return (
        F.when(program.isNull(), F.coalesce(F.concat(F.lit("serves :"), port), F.lit("")))
        .when(program == "celery", celery)
        .when(program.isin(*dims.SERVER_RUNNERS), F.trim(F.concat_ws(" ", program, target)))
        .otherwise(program)
    )


def _first_positional(words: Column) -> Column:
    """The first word that is neither a flag nor the value of one."""
    start = F.struct(F.lit(False).alias("skip"), F.lit(None).cast("string").alias("hit"))

    def step(acc: Column, w: Column) -> Column:
        flag = w.startswith("-")
        return F.struct(
            (~acc["skip"] & flag & ~w.contains("=")).alias("skip"),
            F.when(acc["hit"].isNull() & ~acc["skip"] & ~flag, w).otherwise(acc["hit"]).alias("hit"),
        )

    return F.aggregate(words, start, step, lambda acc: acc["hit"])


def started_module(command: Column) -> Column:
    """Path stem of the module a command starts, or null."""
    words = _tokens(command)
    runner = F.element_at(F.split(F.try_element_at(words, F.lit(1)), "/"), -1)
    rest = F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))
    after = lambda flag: F.try_element_at(
        F.filter(_pairs(words), lambda p: p["w"] == flag), F.lit(1)
    )["next"]
    positional = _first_positional(rest)
    script = F.regexp_replace(positional, r"\.(?:py|js|mjs|ts|go|rb)$", "")
    scripted = F.when(
        (F.try_element_at(rest, F.lit(1)) == "-m") & (F.size(rest) > 1), F.try_element_at(rest, F.lit(2))
    ).otherwise(script)
    ref = (
        F.when(runner == "celery", after("-A"))
        .when(runner == "flask", after("--app"))
        .when(runner.isin(*dims.SERVER_RUNNERS), positional)
        .when(runner.startswith("python") | runner.isin("node", "ruby", "deno", "bun"), scripted)
    )
    stem = F.trim(F.replace(F.element_at(F.split(ref, ":"), 1), F.lit("."), F.lit("/")), F.lit("/"))
    return F.nullif(stem, F.lit(""))


def image_kind(name: Column, image: Column) -> Column:
    said = F.lower(F.concat(name, F.lit(" "), F.coalesce(image, F.lit(""))))
    kind = None
    for names, label in dims.IMAGE_KINDS:
        hit = said.rlike("|".join(names.split()))
        kind = F.when(hit, F.lit(label)) if kind is None else kind.when(hit, F.lit(label))
    return kind.otherwise(F.lit("unknown"))


def service_capacity(services: DataFrame) -> DataFrame:
    command = F.col("command")
    return (
        services.withColumn("capacity", declared_concurrency(command))
        .withColumn("ceiling", ceilings(command, dims.DIAGRAM_CEILINGS, bare=False))
        .withColumn("capacity_flags", ceilings(command, dims.SHOWN_CEILINGS, bare=True))
        .withColumn("runs", role(command, F.col("ports")))
        .withColumn("entrypoint", started_module(command))
        .withColumn("kind", image_kind(F.col("name"), F.col("image")))
    )


def declared_entrypoints(services: DataFrame) -> DataFrame:
    """(repo_id, ref): the module each service starts, under the folder it is built from."""
    ref = started_module(F.col("command"))
    rooted = F.when(F.coalesce("source_root", F.lit("")) == "", ref).otherwise(F.concat("source_root", F.lit("/"), ref))
    return services.select("repo_id", rooted.alias("ref")).filter("ref is not null").distinct()


def service_for_scope(services: DataFrame, scopes: DataFrame) -> DataFrame:
    """(repo_id, scope, service, refused). ``scopes`` is (repo_id, scope); the scope's own prefixes are the key."""
    clean = F.trim(F.col("scope"), F.lit("/"))
    parts = F.split(clean, "/")
    roots = F.concat(
        F.array(F.lit("")),
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")),
    )
    asked = scopes.select("repo_id", "scope", F.explode(F.array_distinct(roots)).alias("root"))
    built = services.select(
        "repo_id", "name", "ord", (F.size("ports") > 0).alias("serving"), F.trim(F.coalesce("source_root", F.lit("")), F.lit("/")).alias("root")
    )
    plain = F.col("name").rlike(r"^[A-Za-z0-9._][A-Za-z0-9._-]*$")
    best = spread_join(built, asked, ["repo_id", "root"]).groupBy("repo_id", "scope").agg(
        F.bool_or("serving").alias("_any"),
        F.min_by("name", F.when(plain & F.col("serving"), F.struct("ord", "name"))).alias("_serving"),
        F.min_by("name", F.when(plain, F.struct("ord", "name"))).alias("_plain"),
        F.min_by("name", F.when(F.col("serving"), F.struct("ord", "name"))).alias("_first_serving"),
        F.min_by("name", F.struct("ord", "name")).alias("_first"),
    )
    chosen = F.when(F.col("_any"), F.col("_serving")).otherwise(F.col("_plain"))
    refused = F.when(F.col("_any"), F.col("_first_serving")).otherwise(F.col("_first"))
    return (
        scopes.join(best, ["repo_id", "scope"], "left")
        .withColumn("service", F.coalesce(chosen, F.lit("")))
        .withColumn("refused", F.when(chosen.isNull(), F.coalesce(refused, F.lit(""))).otherwise(F.lit("")))
        .select("repo_id", "scope", "service", "refused")
    )


# -- experiment logs ---------------------------------------------------------------------------------

WHOLE_LINE = r"(?i)^[+-]?(?:(?:\d+(?:\.\d*)?|\.\d+)(?:e[+-]?\d+)?|nan|inf|infinity)$"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def last_number(stdout: Column, whole_line: bool = True) -> Column:
    """The last line that is a number, or (``whole_line=False``) the last number on the last line with one."""
    lines = F.transform(F.split(stdout, r"\r?\n"), _stripped)
    if whole_line:
        said = F.try_element_at(F.filter(lines, lambda x: x.rlike(WHOLE_LINE)), F.lit(-1))
        return said.try_cast("double")
    found = F.filter(
        F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(r"(-?\d+(?:\.\d+)?)"), 1)), lambda a: F.size(a) > 0
    )
    return F.try_element_at(F.try_element_at(found, F.lit(-1)), F.lit(-1)).try_cast("double")


def tail(text: Column, lines: int = 2) -> Column:
    parts = F.split(_stripped(text), r"\r?\n")
    return F.array_join(F.slice(parts, -F.least(F.size(parts), F.lit(lines)), F.lit(lines)), " / ")


def diagnose(stderr: Column, interpreter: Column) -> Column:
    """Why an experiment produced no measurement, as something a reader can act on."""
    module = F.regexp_extract(stderr, r"No module named ['\"]([\w.]+)['\"]", 1)
    return (
        F.when(_stripped(stderr) == "", F.lit("no error output, and no number printed"))
        .when(stderr.rlike(r"(?m)^\s*SyntaxError:"), F.concat(F.lit("the generated script does not parse: "), tail(stderr)))
        .when(
            module.contains("."),
            F.concat(F.lit("`"), module, F.lit("` was not importable under "), interpreter, F.lit(": run from the wrong path")),
        )
        .when(module != "", F.concat(F.lit("`"), module, F.lit("` is not installed in "), interpreter))
        .otherwise(tail(stderr))
    )


def settle_logs(logs: DataFrame, timeout: int = 120) -> DataFrame:
    """``logs(exit_code, timed_out, stdout, stderr)`` plus (value, detail) of what each run measured."""
    value = last_number(F.col("stdout"))
    clean = ~F.col("timed_out") & (F.col("exit_code") == 0)
    out = _stripped(F.col("stdout"))
    detail = (
        F.when(F.col("timed_out"), F.lit(f"experiment timed out after {timeout}s"))
        .when(
            F.col("exit_code") != 0,
            F.concat(
                F.lit("experiment exited "),
                F.col("exit_code").cast("string"),
                F.lit(": "),
                F.substring(_stripped(F.col("stderr")), 1, 200),
            ),
        )
        .when(value.isNull(), F.lit("experiment printed no number on its last line"))
        .otherwise(F.when(F.length(out) > 200, F.right(out, F.lit(200))).otherwise(out))
    )
    return (
        logs.withColumn("value", F.when(clean, value))
        .withColumn("detail", detail)
        .withColumn("diagnosis", F.when(F.col("exit_code") != 0, diagnose(F.col("stderr"), F.lit("python"))))
    )


# -- provider errors -----------------------------------------------------------------------------------


def is_rate_limit(message: Column) -> Column:
    return F.lower(message).rlike("|".join(dims.RATE_LIMIT_MARKERS))


def requested_wait(message: Column) -> Column:
    """Seconds the provider asked for, or null."""
    pattern = r"(?i)try again in\s*([0-9.]+)\s*(ms|s)\b"
    amount = F.regexp_extract(message, pattern, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(message, pattern, 2))
    return F.when(unit == "ms", amount / 1000.0).when(unit == "s", amount)


def rate_limit_waits(errors: DataFrame) -> DataFrame:
    """``errors(run_id, message)`` to waits per run."""
    limited = errors.filter(is_rate_limit(F.col("message"))).withColumn("wait", requested_wait(F.col("message")))
    return limited.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("wait").alias("stated"),
        F.coalesce(F.sum("wait"), F.lit(0.0)).alias("wait_s"),
    )
