"""Rules over deployment declarations and migrations.

Every rule yields ``rule_findings(repo_id, rule, path, line, detail, remediation)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import dims
from plumbline.functions import text as t
from plumbline.operators.claims import indexed_columns  # noqa: F401  (re-exported: the leading-column set)

RESERVED_CONNECTIONS = 3
DEFAULT_CONNECTIONS = 100
HOST_CPUS = 8


def _finding(rule: str, path: Column, line: Column, detail: Column, fix: Column) -> list[Column]:
    return [
        F.col("repo_id"),
        F.lit(rule).alias("rule"),
        path.alias("path"),
        line.cast("int").alias("line"),
        detail.alias("detail"),
        fix.alias("remediation"),
    ]


def _say(*parts: str | Column) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


# -- migrations ------------------------------------------------------------------------------


def _existing_tables(operations: DataFrame, kind: str) -> DataFrame:
    """Operations of one kind on tables the same migration did not create."""
    fresh = operations.filter("kind = 'create_table'").select("repo_id", "path", "table").distinct()
    return operations.filter(F.col("kind") == kind).join(fresh, ["repo_id", "path", "table"], "left_anti")


def not_null_without_default(operations: DataFrame) -> DataFrame:
    hit = (F.try_element_at("keywords", F.lit("nullable")) == "False") & ~F.exists(
        F.map_keys("keywords"), lambda k: k.contains("default")
    )
    return _existing_tables(operations, "add_column").filter(hit).select(
        *_finding(
            "not-null-without-default",
            F.col("path"),
            F.col("line"),
            _say("NOT NULL column added to `", F.col("table"), "`, a table that already has rows, with no default"),
            F.lit("Add it nullable, backfill, then set NOT NULL; or declare a server_default"),
        )
    )


def index_blocks_writes(operations: DataFrame) -> DataFrame:
    concurrently = F.coalesce(F.try_element_at("keywords", F.lit("postgresql_concurrently")), F.lit(""))
    return _existing_tables(operations, "create_index").filter(~concurrently.contains("True")).select(
        *_finding(
            "index-blocks-writes",
            F.col("path"),
            F.col("line"),
            _say("index on `", F.col("table"), "` built without CONCURRENTLY blocks writes until it is done"),
            F.lit("Set postgresql_concurrently=True and run the migration outside a transaction"),
        )
    )


def column_dropped(operations: DataFrame) -> DataFrame:
    column = F.coalesce(F.try_element_at("columns", F.lit(1)), F.lit("a column"))
    return operations.filter("kind = 'drop_column'").select(
        *_finding(
            "column-dropped-in-one-step",
            F.col("path"),
            F.col("line"),
            _say("`", F.col("table"), ".", column, "` is dropped while the previous release still selects it"),
            F.lit("Stop reading it, deploy, and drop it in a later migration"),
        )
    )


def foreign_key_without_index(operations: DataFrame) -> DataFrame:
    """The first foreign-key column that no index in the whole history contains."""
    indexed = (
        operations.filter("kind = 'create_index'")
        .select("repo_id", "table", F.explode("columns").alias("column"))
        .distinct()
    )
    keys = operations.filter("kind = 'create_foreign_key'").select(
        "repo_id", "path", "line", "table", F.posexplode("columns").alias("pos", "column")
    )
    missing = (
        keys.join(indexed, ["repo_id", "table", "column"], "left_anti")
        .groupBy("repo_id", "path", "line", "table")
        .agg(F.min_by("column", "pos").alias("column"))
    )
    named = _say(F.col("table"), ".", F.col("column"))
    return missing.select(
        *_finding(
            "foreign-key-without-index",
            F.col("path"),
            F.col("line"),
            _say("`", named, "` references another table without an index; deleting a parent scans this one"),
            _say("Create an index on `", named, "`"),
        )
    )


def migration_rules(operations: DataFrame) -> DataFrame:
    return (
        not_null_without_default(operations)
        .unionByName(index_blocks_writes(operations))
        .unionByName(foreign_key_without_index(operations))
        .unionByName(column_dropped(operations))
    )


# -- Dockerfiles --------------------------------------------------------------------------------

INSTRUCTION = "struct<keyword:string,argument:string,line:int>"


def instructions(text: Column) -> Column:
    """Array of (keyword, argument, line), continuations joined, folded inside the row."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    numbered = F.transform(lines, lambda x, i: F.struct(x.alias("said"), (i + 1).alias("n")))
    start = F.struct(
        F.array().cast(f"array<{INSTRUCTION}>").alias("done"), F.lit("").alias("held"), F.lit(0).alias("at")
    )

    def step(acc: Column, x: Column) -> Column:
        line, held = x["said"], acc["held"]
        at = F.when(held == "", x["n"]).otherwise(acc["at"])
        whole = F.trim(F.concat(held, line))
        keyword = F.upper(F.element_at(F.split(whole, " "), 1))
        argument = F.trim(F.regexp_replace(whole, r"^\S*", ""))
        one = F.struct(keyword.alias("keyword"), argument.alias("argument"), at.cast("int").alias("line"))
        skip = line.startswith("#") | ((line == "") & (held == ""))
        carries = line.endswith("\\")
        return F.struct(
            F.when(skip | carries | (whole == ""), acc["done"])
            .otherwise(F.concat(acc["done"], F.array(one)))
            .alias("done"),
            F.when(skip, held)
            .when(carries, F.concat(held, F.regexp_replace(line, r"\\$", ""), F.lit(" ")))
            .otherwise(F.lit(""))
            .alias("held"),
            F.when(skip, acc["at"]).otherwise(at).cast("int").alias("at"),
        )

    return F.aggregate(numbered, start, step, lambda acc: acc["done"])


def dockerfiles(files: DataFrame) -> DataFrame:
    """(repo_id, path, steps, stage): all instructions, and those of the image that ships."""
    low = F.lower(t.basename(F.col("path")))
    found = files.filter(
        (low.startswith("dockerfile") | low.endswith(".dockerfile"))
        & ~t.is_live_credential(t.basename(F.col("path")))
        & (F.col("size") <= dims.MAX_ARTIFACT_BYTES)
    ).select("repo_id", "path", instructions(F.col("text")).alias("steps"))
    last = F.array_max(F.transform(F.filter("steps", lambda s: s["keyword"] == "FROM"), lambda s: s["line"]))
    return found.filter(F.size("steps") > 0).withColumn(
        "stage",
        F.when(last.isNotNull(), F.filter("steps", lambda s: s["line"] >= last)).otherwise(
            F.array().cast(f"array<{INSTRUCTION}>")
        ),
    )


def runs_as_root(docker: DataFrame) -> DataFrame:
    def leaves_root(s: Column) -> Column:
        user = F.trim(F.element_at(F.split(s["argument"], ":"), 1))
        return (s["keyword"] == "USER") & (user != "") & ~user.isin("root", "0")

    return docker.filter((F.size("stage") > 0) & ~F.exists("stage", leaves_root)).select(
        *_finding(
            "container-runs-as-root",
            F.col("path"),
            F.col("stage")[0]["line"],
            F.lit("the shipped stage sets no USER, so its processes run as uid 0"),
            F.lit("Create a system user and switch to it with USER before the CMD"),
        )
    )


def is_mutable_tag(reference: Column) -> Column:
    last = F.element_at(F.split(reference, "/"), -1)
    loose = ~last.contains(":") | (F.element_at(F.split(last, ":"), -1) == "latest")
    return (reference != "") & ~reference.contains("$") & (reference != "scratch") & loose


def _expanded(value: Column, defaults: Column) -> Column:
    """Build arguments replaced by their declared defaults, in one pass over the names known so far."""
    mark = "\u0001"

    def one(acc: Column, d: Column) -> Column:
        pattern = _say(r"\$\{", d["k"], r"(?::?-[^}]*)?\}|\$", d["k"], r"(?![A-Za-z0-9_])")
        plain = F.replace(F.replace(d["v"], F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit(mark))
        return F.regexp_replace(acc, pattern, plain)

    known = F.aggregate(F.reverse(defaults), value, one)
    rest = F.regexp_replace(known, r"\$\{[A-Za-z_]\w*(?::?-([^}]*))?\}|\$[A-Za-z_]\w*", "$1")
    return F.replace(rest, F.lit(mark), F.lit("$"))


def _loose_bases(steps: Column) -> Column:
    """(line, image) of every FROM whose image can move; aliases of earlier stages are not images."""
    start = F.struct(
        F.array().cast("array<struct<k:string,v:string>>").alias("args"),
        F.array().cast("array<string>").alias("aliases"),
        F.array().cast("array<struct<line:int,image:string>>").alias("hits"),
    )

    def step(acc: Column, s: Column) -> Column:
        tokens = F.filter(F.split(s["argument"], r"\s+"), lambda x: (x != "") & ~x.startswith("--"))
        image = _expanded(F.coalesce(F.try_element_at(tokens, F.lit(1)), F.lit("")), acc["args"])
        alias = F.when(
            (F.size(tokens) >= 3) & (F.upper(F.try_element_at(tokens, F.lit(-2))) == "AS"),
            F.element_at(tokens, -1),
        )
        is_from = s["keyword"] == "FROM"
        declares = (s["keyword"] == "ARG") & s["argument"].rlike(r"^\s*[A-Za-z_]\w*\s*=")
        arg = F.struct(
            F.regexp_extract(s["argument"], r"^\s*(\w+)", 1).alias("k"),
            F.trim(F.regexp_replace(s["argument"], r"^[^=]*=", "")).alias("v"),
        )
        hit = F.struct(s["line"].alias("line"), image.alias("image"))
        loose = is_from & ~F.array_contains(acc["aliases"], image) & is_mutable_tag(image)
        return F.struct(
            F.when(declares, F.concat(acc["args"], F.array(arg))).otherwise(acc["args"]).alias("args"),
            F.when(is_from & alias.isNotNull(), F.concat(acc["aliases"], F.array(alias)))
            .otherwise(acc["aliases"])
            .alias("aliases"),
            F.when(loose, F.concat(acc["hits"], F.array(hit))).otherwise(acc["hits"]).alias("hits"),
        )

    return F.aggregate(steps, start, step, lambda acc: acc["hits"])


def mutable_tags(docker: DataFrame, services: DataFrame) -> DataFrame:
    bases = docker.select("repo_id", "path", F.explode(_loose_bases(F.col("steps"))).alias("h")).select(
        "repo_id", "path", "h.line", "h.image"
    )
    images = services.filter(is_mutable_tag(F.coalesce("image", F.lit("")))).select("repo_id", "path", "line", "image")
    shown = F.when(F.element_at(F.split("image", "/"), -1).contains(":"), F.col("image")).otherwise(
        _say(F.col("image"), " (no tag, so :latest)")
    )
    return bases.unionByName(images).select(
        *_finding(
            "latest-tag",
            F.col("path"),
            F.col("line"),
            _say("`", shown, "` can resolve to another digest tomorrow, so one commit is two builds"),
            _say("Pin `", F.col("image"), "` by digest"),
        )
    )


def healthchecks(docker: DataFrame, services: DataFrame) -> DataFrame:
    """Images with no probe where no compose file declares them, and services with ports and none."""
    alone = docker.join(services.select("repo_id").distinct(), "repo_id", "left_anti").filter(
        ~F.exists("steps", lambda s: s["keyword"] == "HEALTHCHECK")
    )
    entry = F.filter("stage", lambda s: s["keyword"].isin("CMD", "ENTRYPOINT"))
    anchor = F.coalesce(
        F.try_element_at(entry, F.lit(-1))["line"], F.try_element_at("stage", F.lit(1))["line"], F.lit(1)
    )
    exposed = F.try_element_at(F.filter("steps", lambda s: s["keyword"] == "EXPOSE"), F.lit(1))["argument"]
    port = F.coalesce(F.nullif(F.trim(F.element_at(F.split(exposed, "/"), 1)), F.lit("")), F.lit("<port>"))
    images = alone.select(
        *_finding(
            "no-healthcheck",
            F.col("path"),
            anchor,
            F.lit("no HEALTHCHECK, so a wedged process and a busy one look the same"),
            _say("Add a HEALTHCHECK that calls http://localhost:", port, "/healthz on a route touching its dependency"),
        )
    )
    probes = services.filter((F.size("ports") > 0) & F.col("ports_listed") & ~F.col("has_healthcheck")).select(
        *_finding(
            "no-healthcheck",
            F.col("path"),
            F.col("line"),
            _say("`", F.col("name"), "` publishes ports and declares no healthcheck"),
            _say("Add a healthcheck to `", F.col("name"), "` that touches the dependency it needs"),
        )
    )
    return images.unionByName(probes)


def host_cpu_call(command: Column) -> Column:
    """The first listed call in the command that reads the host's CPU count, else null."""
    calls = F.array(*[F.lit(c) for c in dims.HOST_CPU_CALLS])
    return F.try_element_at(F.filter(calls, lambda c: F.contains(command, c)), F.lit(1))


def quota_blind(commands: DataFrame) -> DataFrame:
    """``commands(repo_id, path, line, command)``: workers counted from the host, not the quota."""
    doubled = F.col("command").rlike(r"2\s*\*")
    workers = F.when(doubled, 2 * HOST_CPUS + 1).otherwise(HOST_CPUS)
    sums = F.when(doubled, F.lit(f"2 * {HOST_CPUS} + 1 = {2 * HOST_CPUS + 1}")).otherwise(F.lit(str(HOST_CPUS)))
    return (
        commands.withColumn("_call", host_cpu_call(F.col("command")))
        .filter(F.col("_call").isNotNull())
        .select(
            *_finding(
                "workers-ignore-the-cpu-quota",
                F.col("path"),
                F.col("line"),
                _say("`", F.col("_call"), f"` reads the host's CPUs: on {HOST_CPUS} cores ", sums, " workers share the quota"),
                F.lit("Take the worker count from the deployment that sets the CPU limit"),
            ),
            workers.alias("workers"),
        )
    )


def commands_of(docker: DataFrame, services: DataFrame, files: DataFrame) -> DataFrame:
    """Every declared start command: shipped image, compose service, Procfile line."""
    entry = F.filter("stage", lambda s: s["keyword"].isin("CMD", "ENTRYPOINT"))
    images = docker.select("repo_id", "path", F.explode(entry).alias("s")).select(
        "repo_id", "path", "s.line", F.col("s.argument").alias("command")
    )
    procs = (
        files.filter(F.lower(t.basename(F.col("path"))) == "procfile")
        .select("repo_id", "path", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "said"))
        .filter(F.col("said").contains(":") & ~F.trim("said").startswith("#"))
        .select(
            "repo_id", "path", (F.col("pos") + 1).alias("line"), F.regexp_replace("said", r"^[^:]*:", "").alias("command")
        )
    )
    return images.unionByName(services.select("repo_id", "path", "line", "command")).unionByName(procs)


# -- compose services -----------------------------------------------------------------------------


def memory_limits(services: DataFrame) -> DataFrame:
    return services.filter(~F.col("has_memory_limit")).select(
        *_finding(
            "no-memory-limit",
            F.col("path"),
            F.col("line"),
            _say("`", F.col("name"), "` has no memory limit, so the host runs out before it is stopped"),
            _say("Add mem_limit to `", F.col("name"), "`, sized from its peak resident memory"),
        )
    )


def settled_integer(said: Column) -> Column:
    """The number a declaration settles on: digits, or the default of a shell variable; else null."""
    whole = F.trim(said)
    fallback = F.trim(F.regexp_extract(whole, r"\$\{[A-Za-z_][A-Za-z0-9_]*:?-([^}]*)\}", 1))
    return F.when(whole.rlike(r"^\d+$"), whole.cast("bigint")).when(
        fallback.rlike(r"^\d+$"), fallback.cast("bigint")
    )


def _first_integer(environment: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[settled_integer(F.try_element_at(environment, F.lit(k))) for k in keys])


def connection_budget(services: DataFrame) -> DataFrame:
    """replicas x workers x (pool + overflow) against the database's connections, all declared."""
    limits = services.groupBy("repo_id", "path").agg(
        F.min_by(
            F.regexp_extract("command", r"max_connections\s*=\s*(\d+)", 1).try_cast("bigint"),
            F.when(F.col("command").rlike(r"max_connections\s*=\s*\d+"), F.col("ord")),
        ).alias("_declared"),
        F.bool_or(F.coalesce("image", F.lit("")).rlike("|".join(dims.DATABASE_IMAGES))).alias("_database"),
    )
    flag = F.regexp_extract("command", r"(?:^|\s)(?:--workers|--concurrency|-w)[=\s]+(\S+)", 1)
    env = F.col("environment")
    sized = (
        services.join(limits, ["repo_id", "path"])
        .filter("_database")
        .withColumn("workers", F.coalesce(settled_integer(flag), _first_integer(env, dims.WORKER_KEYS)))
        .withColumn("pool", _first_integer(env, dims.POOL_KEYS))
        .withColumn("overflow", F.coalesce(_first_integer(env, dims.OVERFLOW_KEYS), F.lit(0)))
        .withColumn("replicas", F.coalesce(F.nullif(settled_integer(F.col("replicas")), F.lit(0)), F.lit(1)))
        .filter("workers is not null and pool is not null")
        .withColumn("limit", F.coalesce("_declared", F.lit(DEFAULT_CONNECTIONS)))
        .withColumn("budget", F.col("limit") - RESERVED_CONNECTIONS)
        .withColumn("worst", F.expr("replicas * workers * (pool + overflow)"))
        .filter("worst > budget")
        .withColumn("fits_workers", F.expr("budget div greatest(1, replicas * (pool + overflow))"))
        .withColumn("fits_pool", F.expr("greatest(0, budget div greatest(1, replicas * workers) - overflow)"))
    )
    return sized.select(
        *_finding(
            "quota-without-replicas-arithmetic",
            F.col("path"),
            F.col("line"),
            _say(
                "`", F.col("name"), "` opens ", F.col("replicas"), " replicas x ", F.col("workers"), " workers x (",
                F.col("pool"), " pool + ", F.col("overflow"), " overflow) = ", F.col("worst"),
                " connections against a budget of ", F.col("budget"), ", over by ", F.col("worst") - F.col("budget"),
            ),
            _say(
                "At ", F.col("replicas"), " replicas that is ", F.col("fits_workers"), " workers, or a pool of ",
                F.col("fits_pool"), " at ", F.col("workers"), " workers",
            ),
        )
    )


# -- workflows ------------------------------------------------------------------------------------------


def ci_gates(steps: DataFrame) -> DataFrame:
    """``steps(repo_id, path, triggers, trigger_line, ord, run, soft, soft_line, run_line)``.

    One finding per workflow: never on a pull request, else allowed to fail, else exit code discarded.
    """
    runs_tests = F.lower("run").rlike("|".join(dims.GATE_TEST_COMMANDS))
    swallowed = F.lit(False)
    for marker in dims.SWALLOWED_EXITS:
        swallowed = swallowed | F.col("run").contains(marker)
    per = (
        steps.filter(runs_tests)
        .groupBy("repo_id", "path")
        .agg(
            F.first("triggers").alias("triggers"),
            F.first("trigger_line").alias("trigger_line"),
            F.bool_or("soft").alias("soft"),
            F.min("soft_line").alias("soft_line"),
            F.bool_or(swallowed).alias("swallowed"),
            F.min_by(F.struct("run", "run_line"), F.when(swallowed, F.col("ord"))).alias("lost"),
        )
    )
    gated = F.arrays_overlap("triggers", F.array(*[F.lit(x) for x in dims.GATING_TRIGGERS]))
    listed = F.coalesce(F.nullif(F.array_join(F.array_sort(F.array_distinct("triggers")), ", "), F.lit("")), F.lit("nothing"))
    case = (
        F.when(~F.coalesce(gated, F.lit(False)), F.lit("trigger"))
        .when(F.col("soft"), F.lit("soft"))
        .when(F.col("swallowed"), F.lit("swallowed"))
    )
    return (
        per.withColumn("_case", case)
        .filter(F.col("_case").isNotNull())
        .select(
            *_finding(
                "ci-does-not-gate",
                F.col("path"),
                F.when(F.col("_case") == "trigger", F.col("trigger_line"))
                .when(F.col("_case") == "soft", F.col("soft_line"))
                .otherwise(F.col("lost.run_line")),
                F.when(F.col("_case") == "trigger", _say("the tests run on ", listed, " and never on a pull request"))
                .when(F.col("_case") == "soft", F.lit("the test step carries continue-on-error, so a red suite is green"))
                .otherwise(_say("the test command `", F.trim("lost.run"), "` discards its own exit code")),
                F.when(F.col("_case") == "trigger", F.lit("Add pull_request to the triggers and require the job"))
                .when(F.col("_case") == "soft", F.lit("Remove continue-on-error from the test step"))
                .otherwise(F.lit("Let the runner see the exit code of the test command")),
            )
        )
    )


# -- manifests ------------------------------------------------------------------------------------------------


def lockfile_missing(files: DataFrame) -> DataFrame:
    """Manifests with none of their lockfiles in the same directory."""
    name = t.basename(F.col("path"))
    locks = F.create_map(
        *[x for k, v in dims.LOCK_REQUIRED.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))]
    )
    manifests = files.filter(name.isin(*dims.LOCK_REQUIRED)).select(
        "repo_id", "path", name.alias("name"), F.try_element_at(locks, name).alias("locks")
    )
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    expected = manifests.select("repo_id", "path", folder.alias("_dir"), F.explode("locks").alias("_lock")).select(
        "repo_id", F.col("path").alias("_manifest"), F.concat("_dir", "_lock").alias("path")
    )
    locked = (
        expected.join(files.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
        .select("repo_id", F.col("_manifest").alias("path"))
        .distinct()
    )
    command = F.coalesce(
        _say("Run `", dims.choose(F.col("name"), dims.LOCK_COMMAND), "`"),
        _say("Generate ", F.col("locks")[0]),
    )
    return manifests.join(locked, ["repo_id", "path"], "left_anti").select(
        *_finding(
            "lockfile-missing",
            F.col("path"),
            F.lit(1),
            _say("`", F.col("name"), "` has no ", F.col("locks")[0], " beside it, so each build resolves again"),
            _say(command, ", commit it and install from it"),
        )
    )


def tests_gate(artifacts: DataFrame) -> DataFrame:
    """(repo_id, gated): some workflow with a pull-request trigger runs the tests."""
    facts = F.col("facts")
    hit = (
        (F.col("kind") == "ci")
        & F.coalesce(F.try_element_at(facts, F.lit("triggers")), F.lit("")).contains("pull_request")
        & F.try_element_at(facts, F.lit("tests")).isNotNull()
    )
    return artifacts.groupBy("repo_id").agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("gated"))
