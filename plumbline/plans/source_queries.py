"""Bound queries over files: sources, classification, detectors, imports, deployment rules, packages.

The small repositories of ``source_set`` repeat over the parts; what each template must yield is
listed here by hand as (template, ...) rows and joined to the parts that carry it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import dims
from plumbline.operators import claims, commands, dependencies, deployment, detectors, gates, graph, imports, ranking
from plumbline.plans import bindings as b
from plumbline.plans.catalog import query
from plumbline.plans.source_set import TEMPLATES
from plumbline.session import cut_lineage
from plumbline.sources import declarations, tree

SRC = ("source_parts",)


def _q(x) -> str:
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def values(name: str, cols: str, rows: list[tuple]) -> str:
    """A CTE of hand-written rows; ``@N`` is filled from the part that carries the template."""
    return f"{name}({cols}) AS (VALUES {', '.join('(' + ', '.join(map(_q, r)) + ')' for r in rows)})"


PATHS = values("tpl", "tid, tpath, ttext", [(i, p, t) for i, (p, t) in enumerate(TEMPLATES)]) + """,
src AS (SELECT s.repo_id, s.tid, s.nm, s.bare, CASE WHEN bare AND tpath = 'docker-compose.yml' THEN 'docs/notes.md' ELSE tpath END AS path, replace(ttext, '@N', nm) AS text
  FROM source_parts s JOIN tpl USING (tid))"""


def expected(cols: str, rows: list[tuple], select: str) -> str:
    """SQL of the hand-written rows ``e`` joined to the files ``src`` that carry their template."""
    return PATHS + ",\n" + values("e", "tid, " + cols, rows) + f"\nSELECT {select} FROM src JOIN e USING (tid)"


def files(spark, sf) -> DataFrame:
    return b.source_files(spark, sf)


def sorted_pairs(m: str):
    entries = F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(entries), ";")


# -- files of the documents view --------------------------------------------------------------------

_DIRS = ", ".join(f"({_q(d)}, {_q(w)})" for d, w in dims.EXCLUDED_DIRS.items())
_WHY = ", ".join(f"({_q(k)}, {_q(v)})" for k, v in dims.EXCLUSION_REASONS.items())
CLASSIFIED = rf"""
dirs(d, w) AS (VALUES {_DIRS}), why(w, reason) AS (VALUES {_WHY}),
parts AS (SELECT repo_id, path, unnest(string_split(path, '/')[:-2]) AS part, generate_subscripts(string_split(path, '/')[:-2], 1) AS pos FROM files_flat),
tagged AS (SELECT p.repo_id, p.path, pos, CASE WHEN dirs.d IS NOT NULL THEN part WHEN part LIKE '.%' THEN part WHEN part LIKE '%.egg-info' THEN 'egg-info'
    WHEN part IN ('generated', '__generated__', '.generated') THEN 'generated' WHEN part IN ('fixtures', '__fixtures__', 'testdata', '__snapshots__', 'cassettes') THEN 'fixtures' END AS category,
  CASE WHEN dirs.d IS NOT NULL THEN dirs.w WHEN part LIKE '.%' THEN 'state' WHEN part LIKE '%.egg-info' THEN 'build' WHEN part = 'generated' THEN 'generated' ELSE 'fixtures' END AS w
  FROM parts p LEFT JOIN dirs ON dirs.d = part),
outer_dir AS (SELECT repo_id, path, arg_min(category, pos) AS category, arg_min(w, pos) AS w FROM tagged WHERE category IS NOT NULL GROUP BY ALL),
named AS (SELECT *, string_split(path, '/')[-1] AS name FROM files_flat),
cls AS (SELECT n.repo_id, n.path, n.is_symlink, n.size, CASE WHEN name LIKE '.env.%' OR name LIKE '%.env' THEN 'secrets' WHEN o.path IS NOT NULL THEN o.category
    WHEN name LIKE '%.min.js' THEN 'minified' WHEN name LIKE '%\_pb2.py' ESCAPE '\' THEN 'generated' WHEN lower(regexp_extract(name, '[.][^.]+$')) NOT IN ('.py', '.ts', '.rs', '.go', '.js') THEN 'unsupported' END AS category,
  CASE WHEN name LIKE '.env.%' OR name LIKE '%.env' THEN 'secrets' WHEN o.path IS NOT NULL THEN o.w WHEN name LIKE '%.min.js' THEN 'minified' WHEN name LIKE '%\_pb2.py' ESCAPE '\' THEN 'generated' ELSE 'unsupported' END AS w
  FROM named n LEFT JOIN outer_dir o USING (repo_id, path))"""


@query("F01_classify_exclusions", CLASSIFIED + " SELECT repo_id, path, category, CASE WHEN category IS NOT NULL THEN reason END AS reason FROM cls LEFT JOIN why USING (w)", ("files_flat",))
def _(spark, sf):
    return gates.classify_exclusions(b.files(spark, sf)).select("repo_id", "path", "category", "reason")


@query("A07_exclusion_tally", CLASSIFIED + " SELECT repo_id, category, reason, count(*) AS files FROM cls JOIN why USING (w) WHERE category IS NOT NULL GROUP BY ALL", ("files_flat",))
def _(spark, sf):
    return graph.exclusion_tally(gates.classify_exclusions(b.files(spark, sf)))


@query("F02_refuse_secret_files", """
n AS (SELECT repo_id, path, string_split(path, '/')[-1] AS name FROM files_flat)
SELECT repo_id, path, name NOT IN ('.env.example', '.env.sample') AND (name IN ('.env', '.envrc') OR starts_with(name, '.env.') OR ends_with(name, '.env')) AS is_secret,
  starts_with(lower(name), '.env') AND lower(name) NOT IN ('.env.example', '.env.sample', '.env.template', '.env.dist') AS is_credential FROM n
""", ("files_flat",))
def _(spark, sf):
    return gates.refuse_secret_files(b.files(spark, sf)).select("repo_id", "path", "is_secret", "is_credential")


@query("F03_flag_tests", """
n AS (SELECT repo_id, path, regexp_replace(string_split(path, '/')[-1], '(.)[.][^.]+$', '\\1') AS stem FROM files_flat)
SELECT repo_id, path, len(list_intersect(string_split(path, '/')[:-2], ['tests', 'test', 'testing', 'spec', 'specs', '__tests__'])) > 0
  OR starts_with(stem, 'test_') OR starts_with(stem, 'conftest') OR ends_with(stem, '_test') OR ends_with(stem, '.test') OR ends_with(stem, '.spec') OR ends_with(stem, '_spec') AS is_test FROM n
""".replace("\\\\", "\\"), ("files_flat",))
def _(spark, sf):
    return gates.flag_tests(b.files(spark, sf)).select("repo_id", "path", "is_test")


@query("F04_scope_filter", "SELECT repo_id, path FROM files_flat WHERE path LIKE 'src/src1/%' OR path LIKE 'app/%' OR path LIKE 'tests/%'", ("files_flat",))
def _(spark, sf):
    return gates.scope_filter(b.files(spark, sf), ["src/src1", "app/", "tests"]).select("repo_id", "path")


@query("F05_refuse_files", """
n AS (SELECT *, string_split(path, '/')[-1] AS name FROM files_flat)
SELECT repo_id, path, CASE WHEN starts_with(name, '.env.') OR ends_with(name, '.env') THEN 'holds live credentials and is never read' WHEN is_symlink THEN 'symlink' WHEN size > 262144 THEN 'larger than the source size cap' END AS refusal FROM n
""", ("files_flat",))
def _(spark, sf):
    return gates.refuse_files(b.files(spark, sf)).select("repo_id", "path", "refusal")


# lookarounds spelled as captured neighbours, applied twice where two matches may share one
_RE = [
    (r"(?s)-----BEGIN[A-Z ]*PRIVATE KEY-----.*?-----END[A-Z ]*PRIVATE KEY-----", "REDACTED"),
    (r"gsk_[A-Za-z0-9\-_]{20,}|sk-[A-Za-z0-9\-_]{20,}|gh[opsu]_[A-Za-z0-9\-_]{20,}|github_pat_[A-Za-z0-9\-_]{20,}|xox[baprs]-[A-Za-z0-9\-]{10,}|AKIA[0-9A-Z]{16}|AIza[A-Za-z0-9\-_]{30,}|eyJ[A-Za-z0-9\-_]{10,}\.[A-Za-z0-9\-_]{10,}\.[A-Za-z0-9\-_]{10,}", "REDACTED"),
    (r"(://)[^:@/\s]+:[^@/\s]+(@)", r"\1REDACTED\2"),
    (r"(?i:password|secret|passwd|api[_-]?key|access[_-]?token)\s*[=:]\s*\S+", "REDACTED"),
    (r"(^|[^A-Za-z0-9/+=])[A-Za-z0-9/+=]{40}([^A-Za-z0-9/+=]|$)", r"\1REDACTED\2"),
    (r"(^|[^A-Za-z0-9/+=])[A-Za-z0-9/+=]{40}([^A-Za-z0-9/+=]|$)", r"\1REDACTED\2"),
]
_REDACTED = reduce(lambda acc, r: f"regexp_replace({acc}, {_q(r[0])}, {_q(r[1])}, 'g')", _RE, "said")


@query("F06_redact_secrets", f"""
t AS (SELECT doc_id, text || ' at postgres://u' || doc_id || ':p' || doc_id || '@db/x api_key: k' || doc_id || ' sk-' || repeat('a_', 12) || doc_id AS said FROM documents)
SELECT doc_id, md5({_REDACTED}) AS said FROM t
""")
def _(spark, sf):
    """Whole texts, each with three more credentials appended."""
    d = F.col("doc_id").cast("string")
    said = F.concat(
        "text", F.lit(" at postgres://u"), d, F.lit(":p"), d, F.lit("@db/x api_key: k"), d, F.lit(" sk-" + "a_" * 12), d
    )
    docs = b.table(spark, sf, "documents").select("doc_id", said.alias("said"))
    return gates.redact_secrets(docs, ["said"]).select("doc_id", F.md5("said").alias("said"))


# -- detectors ------------------------------------------------------------------------------------------


def _signal(rows: list[tuple[int, str]]) -> str:
    return expected("signal", rows, "repo_id, path, signal")


IMPORTED = {
    1: "app,app.db,app.tasks,app.tasks.jobs,fastapi,fastapi.FastAPI,logging,requests",
    2: "redis,sqlalchemy",
    4: "app.db,app.db.Store,celery",
    5: "acme_sdk,numpy",
    7: "os",
    8: "./db.js,axios",
    9: "./util,fs",
    11: "../src/util/index",
    12: "database/sql,net/http",
    13: "fmt",
    14: "std::sync,tokio::spawn",
    15: "std::collections::HashMap",
    16: "java.sql,java.util.concurrent.Executor",
    17: "java.util.List",
    18: "local/@N.h,thread",
    19: "cstring",
    34: "alembic,alembic.op,sqlalchemy",
    35: "alembic,alembic.op",
}
SOURCES = {
    i: dims.EXTENSIONS["." + p.rsplit(".", 1)[-1]] for i, (p, _) in enumerate(TEMPLATES) if "." + p.rsplit(".", 1)[-1] in dims.EXTENSIONS
}
PARSED_ROWS = [
    (
        i,
        lang,
        sum(1 for line in TEMPLATES[i][1].split("\n") if line.strip()),
        IMPORTED.get(i, ""),
        "app.tasks.jobs,not.a.module" if i == 5 else "",
    )
    for i, lang in SOURCES.items()
    if i != 6
]


def parsed(spark, sf):
    f = files(spark, sf)
    return detectors.extract_imports(f, imports.packages_of(f))


@query("T01_extract_imports", expected("language, loc, names, strings", PARSED_ROWS, "repo_id, path, language, loc::BIGINT AS loc, replace(names, '@N', nm) AS imports, strings AS named_in_strings")
       + " UNION ALL SELECT repo_id, path, 'unparsed', NULL, NULL, NULL FROM src WHERE tid = 6", SRC)
def _(spark, sf):
    good, bad = parsed(spark, sf)
    rows = good.select("repo_id", "path", "language", "loc", "imports", "named_in_strings")
    return rows.unionByName(bad.drop("reason").withColumn("language", F.lit("unparsed")), allowMissingColumns=True)


@query("T02_detect_swallowed_errors", _signal([(i, "craft") for i in (4, 8, 12, 14, 16, 18)]), SRC)
def _(spark, sf):
    return detectors.detect_swallowed_errors(files(spark, sf))


@query("T03_detect_woven_queries", _signal([(i, s) for i in (2, 9) for s in ("data", "security")]), SRC)
def _(spark, sf):
    return detectors.detect_woven_queries(files(spark, sf))


@query("T04_detect_blocking_calls", _signal([(9, "concurrency")]), SRC)
def _(spark, sf):
    return detectors.detect_blocking_calls(files(spark, sf))


@query("T05_detect_global_network", _signal([(8, "network")]), SRC)
def _(spark, sf):
    return detectors.detect_global_network(files(spark, sf))


@query("T06_detect_concurrency", _signal([(i, "concurrency") for i in (4, 12, 14, 16, 18)]), SRC)
def _(spark, sf):
    return detectors.detect_concurrency(files(spark, sf))


@query("T07_detect_defeated_guarantees", _signal([(i, "security") for i in (14, 16, 18)]), SRC)
def _(spark, sf):
    return detectors.detect_defeated_guarantees(files(spark, sf))


DEFINED = [
    (1, "", "Handler", 7), (1, "Handler", "get", 8), (1, "", "get", 11), (1, "", "only_@N", 14),
    (2, "", "Store", 4), (2, "Store", "fetch", 5), (2, "Store", "close", 8), (4, "", "run_@N", 6),
    (7, "", "go_@N", 3), (7, "", "say", 11), (8, "", "Client", 3), (8, "Client", "load", 4), (9, "", "q", 3),
    (10, "", "x", 1), (11, "", "y", 2), (12, "", "Worker", 8), (12, "", "Run_@N", 10), (13, "", "Quiet", 6),
    (14, "", "Pool_@N", 4), (14, "", "open", 6), (15, "", "ok", 3), (16, "", "Pool", 5), (16, "Pool", "take", 6),
    (17, "", "Quiet", 4), (17, "Quiet", "find", 5), (18, "", "Copier", 4), (18, "", "run", 7), (19, "", "put", 3),
    (34, "", "upgrade", 4), (34, "", "downgrade", 10), (35, "", "upgrade", 3),
]


@query("T08_extract_definitions", expected("scope, name, line", DEFINED, "repo_id, path, scope, replace(name, '@N', nm) AS name, line::BIGINT AS line"), SRC)
def _(spark, sf):
    return detectors.extract_definitions(files(spark, sf))


ASKED = [
    (1, "get", None), (1, "Handler.get", 8), (1, "Handler", 7), (1, "nowhere", None), (2, "fetch", 5), (2, "Store.fetch", 5),
    (2, "Other.fetch", None), (8, "Client::load()", 4), (16, "take(x)", 6), (19, "put", 3),
]


@query("J06_locate_symbols", expected("symbol, located", [a for a in ASKED if a[2]], "repo_id, path, symbol, located::BIGINT AS located"), SRC)
def _(spark, sf):
    f = files(spark, sf)
    asked = F.array(*[F.struct(F.lit(TEMPLATES[i][0]).alias("p"), F.lit(s).alias("symbol")) for i, s, _ in ASKED])
    found = f.select("repo_id", "path", F.explode(asked).alias("a")).filter("path = a.p").select("repo_id", "path", "a.symbol")
    return claims.locate_symbols(found, detectors.extract_definitions(f))


# -- imports ------------------------------------------------------------------------------------------------

NAMED = [
    (0, "app"), (1, "app.main"), (2, "app.db"), (3, "app.tasks"), (4, "app.tasks.jobs"), (4, "tasks.jobs"), (5, "app.settings"),
    (6, "app.broken"), (7, "app.narrow"), (34, "alembic.versions.a1"), (34, "versions.a1"), (34, "a1"), (35, "migrations.m2"),
    (35, "m2"), (40, "gunicorn.conf"),
]


@query("W03_module_name_index", expected("name", NAMED, "repo_id, name, path"), SRC)
def _(spark, sf):
    return imports.module_name_index(files(spark, sf))


def _edge_sql(rows: list[tuple[int, int]]) -> str:
    return PATHS + ",\n" + values("e", "a, z", rows) + "\nSELECT s.repo_id, s.path AS src, t.path AS dst FROM e JOIN src s ON s.tid = a JOIN src t ON t.tid = z AND t.repo_id = s.repo_id"


DOTTED, BESIDE, SPOKEN = [(1, 2), (1, 0), (1, 4), (1, 3), (4, 2)], [(8, 9), (9, 10), (11, 10)], [(5, 4)]


def _asked(spark, sf, column="imports"):
    return parsed(spark, sf)[0].select("repo_id", "path", "language", F.explode(column).alias("name"))


@query("J01_resolve_imports", _edge_sql(DOTTED), SRC)
def _(spark, sf):
    return imports.resolve_imports(_asked(spark, sf), imports.module_name_index(files(spark, sf)))


@query("J02_resolve_relative_imports", _edge_sql(BESIDE), SRC)
def _(spark, sf):
    return imports.resolve_relative(_asked(spark, sf), files(spark, sf))


@query("J03_resolve_string_imports", _edge_sql(DOTTED + BESIDE + SPOKEN), SRC)
def _(spark, sf):
    """String edges together with the dotted and relative ones: the whole import graph."""
    return imports.import_edges(parsed(spark, sf)[0], files(spark, sf))


ROUTED = [
    (1, "observability"), (1, "network"), (1, "entrypoint"), (2, "data"), (2, "distributed"), (4, "distributed"), (4, "failure"),
    (7, "security"), (34, "data"), (8, "network"), (12, "data"), (12, "network"), (14, "concurrency"), (16, "concurrency"),
    (16, "data"), (18, "concurrency"),
]
SEEN = [
    (i, "craft") for i in (4, 8, 12, 14, 16, 18)
] + [(i, s) for i in (2, 9) for s in ("data", "security")] + [(9, "concurrency")] + [(i, "concurrency") for i in (4, 12)] + [(i, "security") for i in (14, 16, 18)]


@query("J04_route_signals", expected("signal", sorted(set(ROUTED + SEEN)), "repo_id, path, signal"), SRC)
def _(spark, sf):
    """Concerns by import, with those the source itself shows."""
    return imports.route_signals(_asked(spark, sf), detectors.detect_all(files(spark, sf)))


OPEN = [
    (5, "acme_sdk"), (34, "alembic"), (35, "alembic"), (8, "./db.js"), (9, "./util"), (9, "fs"), (11, "../src/util/index"), (13, "fmt"),
    (15, "std::collections::HashMap"), (17, "java.util.List"), (18, "local/@N.h"), (19, "cstring"),
]
EXTERNAL = [
    (1, "fastapi"), (1, "requests"), (2, "sqlalchemy"), (2, "redis"), (4, "celery"), (5, "numpy"), (5, "acme_sdk"), (34, "alembic"),
    (34, "sqlalchemy"), (35, "alembic"),
]


@query("J05_unmatched_and_external", expected("kind, name", [(i, "unmatched", n) for i, n in OPEN] + [(i, "external", n) for i, n in EXTERNAL], "repo_id, path, kind, replace(name, '@N', nm) AS name"), SRC)
def _(spark, sf):
    index = imports.module_name_index(files(spark, sf))
    unmatched = imports.unmatched_imports(_asked(spark, sf), index).withColumn("kind", F.lit("unmatched"))
    external = imports.external_packages(parsed(spark, sf)[0], index).withColumn("kind", F.lit("external"))
    return unmatched.unionByName(external)


# -- declarations -----------------------------------------------------------------------------------------------


@query("S12_scan_context_files", PATHS + f"""
SELECT repo_id, path AS name, substr(text, 1, 4000) AS text FROM src WHERE path IN ({', '.join(map(_q, dims.CONTEXT_FILES))})
""", SRC)
def _(spark, sf):
    return tree.context_files(files(spark, sf))


STATED = [
    (20, "dockerfile", "base_image=python;copies=. /app", "USER,HEALTHCHECK"),
    (21, "dockerfile", "base_image=registry.local:5000/@N;healthcheck=CMD curl localhost;user=app:app", ""),
    (22, "compose", "read_by=scan_services", ""),
    (23, "procfile", "web=gunicorn app --workers $(nproc);worker=celery -A app", ""),
    (24, "ci", "tests=pytest -q;triggers=push", "pull_request"),
    (25, "ci", "tests=npm test;triggers=pull_request", ""),
    (26, "ci", "tests=pytest || true;triggers=pull_request", ""),
    (27, "ci", "tests=make check;triggers=pull_request, push", ""),
    (28, "manifest", "ecosystem=javascript", "lockfile"),
    (29, "manifest", "ecosystem=python;lockfile=uv.lock", ""),
    (30, "lockfile", "ecosystem=python", ""),
    (31, "manifest", "ecosystem=python", ""),
    (33, "manifest", "ecosystem=python", "lockfile"),
    (36, "kubernetes", "kind=Deployment;limits=app: memory=1Gi;name=@N;probes=liveness;replicas=3", "resources.requests,readinessProbe"),
    (36, "kubernetes", "kind=Service;name=front", ""),
    (37, "webserver", "keepalive_timeout=5s, 9s;worker_processes=4", ""),
    (39, "env-example", "variables=API_KEY, SENTRY_DSN, DEBUG, @N", ""),
    (40, "webserver", "timeout=30;workers=3", ""),
    (41, "terraform", "", ""),
    (43, "manifest", "ecosystem=go", "lockfile"),
]


@query("S02_scan_artifacts", expected("kind, facts, absent", STATED, "repo_id, kind, path, replace(facts, '@N', nm) AS facts, absent") + " WHERE NOT (tid = 22 AND bare)", SRC)
def _(spark, sf):
    return declarations.scan_artifacts(files(spark, sf)).withColumn("facts", sorted_pairs("facts"))


PINNED = [
    ("sqlalchemy", "2.1.0"), ("redis", "5.2"), ("@N", "1.2.3"), ("unpinned-one", ""), ("pytest", ""), ("httpx", ""), ("ruff", "0.5.0"),
]


@query("S07_scan_requirements", expected("name, version", [(31, n, v) for n, v in PINNED], "repo_id, replace(replace(name, '@N', nm), '_', '-') AS name, version"), SRC)
def _(spark, sf):
    return declarations.scan_requirements(files(spark, sf))


OPERATED = [
    (34, "create_table", "fresh_@N", "", 5, ""), (34, "add_column", "fresh_@N", "a", 6, "nullable=False"),
    (34, "add_column", "users", "b", 7, "nullable=False"), (34, "create_index", "users", "b,c", 8, "postgresql_concurrently=True"),
    (35, "create_foreign_key", "orders", "user_id,b", 4, ""), (35, "drop_column", "orders", "@N", 5, ""), (35, "create_index", "orders", "b", 6, ""),
]


@query("S08_scan_migrations", expected("kind, tbl, cols, line, kw", OPERATED, "repo_id, kind, replace(tbl, '@N', nm) AS \"table\", replace(cols, '@N', nm) AS columns, path, line::BIGINT AS line, kw AS keywords"), SRC)
def _(spark, sf):
    return declarations.scan_migrations(files(spark, sf)).withColumn("keywords", sorted_pairs("keywords"))


SERVED = [
    (22, "service", "api", "backend", 2, "gunicorn app --workers 4"), (22, "service", "worker", "", 14, "celery -A app.tasks.jobs worker --concurrency=4 -Q @N"),
    (22, "backing", "db", "", 19, ""), (22, "backing", "cache", "", 21, ""), (22, "external", "volume:data", None, None, None),
]


@query("S09_scan_services", expected("kind, name, source_root, line, command", SERVED, "repo_id, kind, name, source_root, line::BIGINT AS line, replace(command, '@N', nm) AS command") + " WHERE NOT bare", SRC)
def _(spark, sf):
    services, backing, external = declarations.scan_services(files(spark, sf))
    cols = ["repo_id", "name", "source_root", "line", "command"]
    return (
        services.select(*cols, F.lit("service").alias("kind"))
        .unionByName(backing.select(*cols, F.lit("backing").alias("kind")))
        .unionByName(external.withColumn("kind", F.lit("external")), allowMissingColumns=True)
    )


# -- deployment rules ------------------------------------------------------------------------------------------------

HIT = ["repo_id", "rule", "path", "line"]


@b.remembered
def docker(spark, sf):
    return deployment.dockerfiles(files(spark, sf))


@b.remembered
def composed(spark, sf):
    return declarations.compose_services(files(spark, sf))


def rule_sql(rule: str, rows: list[tuple[int, int]], where: str = "NOT (tid = 22 AND bare)") -> str:
    return expected("line", rows, f"repo_id, '{rule}' AS rule, path, line::BIGINT AS line") + f" WHERE {where}"


RULES = {
    "container-runs-as-root": [(20, 2)],
    "latest-tag": [(20, 2), (21, 5), (22, 19), (22, 21)],
    "no-healthcheck": [(20, 7), (22, 2)],
    "workers-ignore-the-cpu-quota": [(20, 7), (21, 8), (23, 2)],
    "no-memory-limit": [(22, 2), (22, 19), (22, 21)],
    "quota-without-replicas-arithmetic": [(22, 2)],
    "ci-does-not-gate": [(24, 2), (25, 6), (26, 7)],
    "lockfile-missing": [(28, 1), (33, 1), (43, 1)],
}
PROBED = "(tid = 22 AND NOT bare) OR (tid = 20 AND bare)"


@query("F15_rule_runs_as_root", rule_sql("container-runs-as-root", RULES["container-runs-as-root"]), SRC)
def _(spark, sf):
    return deployment.runs_as_root(docker(spark, sf)).select(*HIT)


@query("F16_rule_mutable_tag", rule_sql("latest-tag", RULES["latest-tag"]), SRC)
def _(spark, sf):
    return deployment.mutable_tags(docker(spark, sf), composed(spark, sf)).select(*HIT)


@query("F17_rule_no_healthcheck", rule_sql("no-healthcheck", RULES["no-healthcheck"], PROBED), SRC)
def _(spark, sf):
    return deployment.healthchecks(docker(spark, sf), composed(spark, sf)).select(*HIT)


@query("F18_rule_worker_count_ignores_quota", expected("line, workers", [(20, 7, 17), (21, 8, 8), (23, 2, 8)], "repo_id, 'workers-ignore-the-cpu-quota' AS rule, path, line::BIGINT AS line, workers::BIGINT AS workers"), SRC)
def _(spark, sf):
    called = deployment.commands_of(docker(spark, sf), composed(spark, sf), files(spark, sf))
    return deployment.quota_blind(called).select(*HIT, "workers")


@query("F19_rule_no_memory_limit", rule_sql("no-memory-limit", RULES["no-memory-limit"]), SRC)
def _(spark, sf):
    return deployment.memory_limits(composed(spark, sf)).select(*HIT)


@query("F20_rule_connection_budget", """
env AS (SELECT *, regexp_extract(env, 'POOL_SIZE=([0-9]+)', 1) AS pl,
  CASE WHEN regexp_matches(command, '--workers [0-9]+|--concurrency=[0-9]+|-w [0-9]+') THEN regexp_extract(command, '(--workers |--concurrency=|-w )([0-9]+)', 2)
    WHEN contains(command, 'WORKERS:-6') THEN '6' WHEN contains(env, 'WORKERS') THEN '4' END AS wk FROM services_flat),
lim AS (SELECT repo_id, path, bool_or(contains(image, 'postgres')) AS db, bool_or(contains(command, 'max_connections')) AS decl FROM services_flat GROUP BY ALL),
s AS (SELECT e.*, CASE WHEN decl THEN 40 ELSE 100 END - 3 AS budget, coalesce(nullif(replicas::INT, 0), 1) AS reps, wk::INT AS w, pl::INT AS p FROM env e JOIN lim USING (repo_id, path) WHERE db AND pl <> '' AND wk IS NOT NULL)
SELECT repo_id, path, line::BIGINT AS line, '`' || name || '` opens ' || reps || ' replicas x ' || w || ' workers x (' || p || ' pool + 5 overflow) = ' || reps * w * (p + 5) || ' connections against a budget of ' || budget || ', over by ' || (reps * w * (p + 5) - budget) AS detail,
  'At ' || reps || ' replicas that is ' || budget // greatest(1, reps * (p + 5)) || ' workers, or a pool of ' || greatest(0, budget // greatest(1, reps * w) - 5) || ' at ' || w || ' workers' AS remediation
FROM s WHERE reps * w * (p + 5) > budget
""", ("services_flat",))
def _(spark, sf):
    return deployment.connection_budget(b.services(spark, sf)).select("repo_id", "path", "line", "detail", "remediation")


@query("F21_rule_ci_does_not_gate", rule_sql("ci-does-not-gate", RULES["ci-does-not-gate"]), SRC)
def _(spark, sf):
    return deployment.ci_gates(declarations.workflow_steps(files(spark, sf))).select(*HIT)


@query("J09_rule_lockfile_missing", rule_sql("lockfile-missing", RULES["lockfile-missing"]), SRC)
def _(spark, sf):
    return deployment.lockfile_missing(files(spark, sf)).select(*HIT)


def all_deployment(spark, sf) -> DataFrame:
    # several rules read what is parsed: written once, not parsed for each
    f, d, s = files(spark, sf), cut_lineage(docker(spark, sf)), cut_lineage(composed(spark, sf))
    called = deployment.quota_blind(deployment.commands_of(d, s, f)).drop("workers")
    return reduce(
        DataFrame.unionByName,
        [
            deployment.runs_as_root(d), deployment.mutable_tags(d, s), deployment.healthchecks(d, s), called, deployment.memory_limits(s),
            deployment.connection_budget(s), deployment.ci_gates(declarations.workflow_steps(f)), deployment.lockfile_missing(f),
        ],
    )


_ALL = [(t, rule, line) for rule, rows in RULES.items() for t, line in rows]
_KEEP = " WHERE NOT (tid = 22 AND bare) AND (rule <> 'no-healthcheck' OR " + PROBED + ")"


@query("O06_order_rule_findings", expected("rule, line", _ALL, "repo_id, rule, path, line::BIGINT AS line") + _KEEP, SRC)
def _(spark, sf):
    # an order by range reads its rows twice, once for the bounds
    return ranking.order_rule_findings(cut_lineage(all_deployment(spark, sf))).select(*HIT)


@query("U01_every_finding", PATHS + ",\n" + values("e", "tid, rule, line", _ALL) + f""",
f(tid, rule) AS (VALUES (34, 'not-null-without-default'), (35, 'index-blocks-writes'), (35, 'foreign-key-without-index'), (35, 'column-dropped-in-one-step')),
dep AS (SELECT repo_id, count(*) AS n FROM src JOIN e USING (tid){_KEEP} GROUP BY ALL)
SELECT repo_id, 'deployment' AS source, 'medium' AS severity, n FROM dep
UNION ALL SELECT repo_id, 'schema', 'medium', count(*) FROM src JOIN f USING (tid) GROUP BY repo_id
UNION ALL SELECT repo_id, 'dependencies', 'medium', 4 FROM src WHERE tid = 31
UNION ALL SELECT repo_id, 'code', severity, count(*) FROM findings_flat GROUP BY ALL
""".replace("f(tid, rule) AS (VALUES", "fr(tid, rule) AS (VALUES").replace("JOIN f USING", "JOIN fr USING"), ("source_parts", "findings_flat"))
def _(spark, sf):
    """Counts per source of everything found: rules, schema, packages and reviewed code."""
    pins = declarations.scan_requirements(files(spark, sf))
    registry = b.view(spark, sf, "registry_flat").select(F.lit("redis").alias("name"), F.lit("8.1.0").alias("latest"), F.lit("").alias("released")).distinct()
    packages, _ = dependencies.dependency_audit(pins, registry)
    schema = deployment.migration_rules(declarations.scan_migrations(files(spark, sf)))
    every = ranking.every_finding(all_deployment(spark, sf), b.findings(spark, sf), schema, packages)
    return every.groupBy("repo_id", "source", "severity").agg(F.count(F.lit(1)).alias("n"))


# -- migrations ---------------------------------------------------------------------------------------------------------

OPS = ("operations_flat",)
_FRESH = "fresh AS (SELECT DISTINCT repo_id, path, tbl FROM operations_flat WHERE kind = 'create_table'), old AS (SELECT o.* FROM operations_flat o LEFT JOIN fresh f USING (repo_id, path, tbl) WHERE f.tbl IS NULL)"


@query("F12_rule_not_null_without_default", _FRESH + " SELECT repo_id, 'not-null-without-default' AS rule, path, line::BIGINT AS line FROM old WHERE kind = 'add_column' AND kw = 'nullable=False'", OPS)
def _(spark, sf):
    return deployment.not_null_without_default(b.operations(spark, sf)).select(*HIT)


@query("F13_rule_index_blocks_writes", _FRESH + " SELECT repo_id, 'index-blocks-writes' AS rule, path, line::BIGINT AS line FROM old WHERE kind = 'create_index' AND NOT contains(kw, 'postgresql_concurrently=True')", OPS)
def _(spark, sf):
    return deployment.index_blocks_writes(b.operations(spark, sf)).select(*HIT)


@query("F14_rule_column_dropped", "SELECT repo_id, 'column-dropped-in-one-step' AS rule, path, line::BIGINT AS line FROM operations_flat WHERE kind = 'drop_column'", OPS)
def _(spark, sf):
    return deployment.column_dropped(b.operations(spark, sf)).select(*HIT)


@query("J08_rule_foreign_key_without_index", """
idx AS (SELECT DISTINCT repo_id, tbl, unnest(string_split(cols, ',')) AS c FROM operations_flat WHERE kind = 'create_index' AND cols <> ''),
fk AS (SELECT repo_id, path, line, tbl, unnest(string_split(cols, ',')) AS c, generate_subscripts(string_split(cols, ','), 1) AS pos FROM operations_flat WHERE kind = 'create_foreign_key' AND cols <> '')
SELECT fk.repo_id, path, line::BIGINT AS line, 'Create an index on `' || fk.tbl || '.' || arg_min(fk.c, pos) || '`' AS remediation FROM fk LEFT JOIN idx ON idx.repo_id = fk.repo_id AND idx.tbl = fk.tbl AND idx.c = fk.c
WHERE idx.c IS NULL GROUP BY fk.repo_id, path, line, fk.tbl
""", OPS)
def _(spark, sf):
    return deployment.foreign_key_without_index(b.operations(spark, sf)).select("repo_id", "path", "line", "remediation")


# -- packages ---------------------------------------------------------------------------------------------------------------

PKG = ("pins_flat", "registry_flat")
_AUDIT = """
j AS (SELECT p.*, r.latest, r.released, greatest(0, string_split(r.latest, '.')[1]::BIGINT - nullif(string_split(p.version, '.')[1], '')::BIGINT) AS behind FROM pins_flat p LEFT JOIN registry_flat r USING (name))"""


@query("J10_dependency_audit", _AUDIT + """
SELECT repo_id, name AS subject, CASE WHEN version = '' THEN 'dependency-unpinned' ELSE 'dependency-major-versions-behind' END AS rule, NULL::BIGINT AS n FROM j WHERE version = '' OR behind >= 1
UNION ALL SELECT repo_id, 'declared', 'coverage', count(*) FROM j GROUP BY repo_id
UNION ALL SELECT repo_id, 'unreachable', 'coverage', count(*) FILTER (WHERE version <> '' AND latest IS NULL) FROM j GROUP BY repo_id
UNION ALL SELECT repo_id, 'checked', 'coverage', count(*) FILTER (WHERE NOT (version <> '' AND latest IS NULL)) FROM j GROUP BY repo_id
""", PKG)
def _(spark, sf):
    found, coverage = dependencies.dependency_audit(b.view(spark, sf, "pins_flat"), b.view(spark, sf, "registry_flat"))
    named = found.select("repo_id", F.regexp_extract("detail", "`([^`]*)`", 1).alias("subject"), "rule", F.lit(None).cast("bigint").alias("n"))
    counts = coverage.select(
        "repo_id", F.lit("coverage").alias("rule"),
        F.expr("stack(3, 'declared', declared, 'unreachable', unreachable, 'checked', checked) as (subject, n)"),
    )
    return named.unionByName(counts)


@query("J11_describe_versions", """
ext AS (SELECT DISTINCT repo_id, path, unnest(string_split(external, ',')) AS name FROM modules_flat WHERE external <> ''),
wide AS (SELECT repo_id, path, name FROM ext UNION SELECT repo_id, path, 'old_' || (loc % 10) FROM modules_flat UNION SELECT repo_id, path, replace(p, '-', '_') FROM modules_flat JOIN (SELECT min(name) AS p, repo_id FROM pins_flat GROUP BY repo_id, version) USING (repo_id)),
k AS (SELECT *, CASE name WHEN 'jwt' THEN 'pyjwt' WHEN 'redis' THEN 'redis' ELSE replace(lower(name), '_', '-') END AS key FROM wide),
s AS (SELECT k.repo_id, path, k.name, p.name IS NOT NULL AS decl, coalesce(p.version, '') AS v, coalesce(r.latest, '') AS l FROM k LEFT JOIN pins_flat p ON p.repo_id = k.repo_id AND p.name = key LEFT JOIN registry_flat r ON r.name = key)
SELECT repo_id, path, md5(string_agg('- `' || name || '`: ' || CASE WHEN NOT decl THEN 'not declared in this repository''s dependencies, so its version is unknown here' WHEN v <> '' AND l <> '' AND v <> l THEN v || ' installed, ' || l || ' current'
  WHEN v <> '' AND v = l THEN v || ', current' WHEN v <> '' THEN v || ' installed' WHEN l <> '' THEN 'not pinned, ' || l || ' current' ELSE 'version not declared anywhere in this repository' END, chr(10) ORDER BY name)) AS lines FROM s GROUP BY ALL
""", (*PKG, "modules_flat"))
def _(spark, sf):
    mods = b.view(spark, sf, "modules_flat")
    pins = b.view(spark, sf, "pins_flat")
    firsts = pins.groupBy("repo_id", "version").agg(F.min("name").alias("p"))
    external = (
        b.modules(spark, sf).select("repo_id", "path", F.explode("external").alias("name"))
        .union(mods.select("repo_id", "path", F.concat(F.lit("old_"), (F.col("loc") % 10).cast("string"))))
        .union(mods.join(firsts, "repo_id").select("repo_id", "path", F.replace("p", F.lit("-"), F.lit("_"))))
    )
    lines = dependencies.version_block(dependencies.describe_versions(external, pins, b.view(spark, sf, "registry_flat")))
    return lines.withColumn("lines", F.md5("lines"))


@query("O05_rank_changelog_notes", """
p AS (SELECT page_id, url, 'page ' || page_id AS title, CASE page_id % 3 WHEN 0 THEN regexp_extract(url, '//(m[.]|www[.])?([a-z]+)[.]', 2) WHEN 1 THEN 'en' ELSE 'lib_' || (page_id % 7) || '-py' END AS package FROM pages),
n AS (SELECT *, replace(lower(package), '_', '-') AS stem, regexp_replace(replace(lower(package), '_', '-'), '-py$', '') AS short FROM p),
s AS (SELECT package, title, url, 2 * (regexp_matches(lower(url), 'github[.]com|gitlab[.]com|readthedocs[.]io|docs[.]python[.]org|pypi[.]org|changelog[.]md'))::INT
  + 3 * (short <> '' AND (regexp_matches(lower(url || ' ' || title), '(^|[^a-z0-9])' || stem || '($|[^a-z0-9])') OR regexp_matches(lower(url || ' ' || title), '(^|[^a-z0-9])' || short || '($|[^a-z0-9])')))::INT
  + 5 * (list_contains(string_split(lower(url), '/'), stem) OR list_contains(string_split(lower(url), '/'), short))::INT AS score FROM n WHERE starts_with(url, 'http'))
SELECT package, title, url, score::BIGINT AS score, row_number() OVER (PARTITION BY package ORDER BY score DESC, url, title) AS position FROM s QUALIFY position <= 3
""")
def _(spark, sf):
    page = F.col("page_id")
    package = (
        F.when(page % 3 == 0, F.regexp_extract("url", r"//(m[.]|www[.])?([a-z]+)[.]", 2))
        .when(page % 3 == 1, F.lit("en"))
        .otherwise(F.concat(F.lit("lib_"), (page % 7).cast("string"), F.lit("-py")))
    )
    results = b.table(spark, sf, "pages").select(
        F.lit("r").alias("repo_id"), package.alias("package"), F.concat(F.lit("page "), page.cast("string")).alias("title"), "url"
    )
    return dependencies.rank_notes(results).drop("repo_id")


# -- services and artefacts ------------------------------------------------------------------------------------------------------

_CAPACITY = [
    (0, 4, "--workers 4", "--workers 4 --backlog=64", "uvicorn app.main:app", "app/main"),
    (1, 8, "--concurrency=8", "--concurrency=8", "celery worker -Q mail", "tasks/celery_app"),
    (2, 3, "--threads 2", "--threads 2", "gunicorn wsgi:application", "wsgi"),
    (3, None, "", "", "python", "jobs/sweeper"),
    (4, None, "--pool 5", "--pool 5", "node", "server/index"),
    (5, None, "", "", None, None),
    (6, None, "--workers ${WORKERS:-6}", "--workers ${WORKERS:-6}", "gunicorn app:api", "app"),
    (7, None, "", "", "celery beat", "tasks/celery_app"),
]


@query("T10_service_capacity", values("cap", "i, capacity, ceiling, flags, runs, entry", _CAPACITY) + """
SELECT repo_id, name, capacity::BIGINT AS capacity, ceiling, flags AS capacity_flags, coalesce(runs, CASE ports WHEN '8080:80' THEN 'serves :80' WHEN '9000' THEN 'serves :9000' ELSE '' END) AS runs, entry AS entrypoint,
  CASE WHEN contains(name || ' ' || image, 'postgres') THEN 'database' WHEN contains(name || ' ' || image, 'redis') THEN 'cache or queue' WHEN contains(image, 'minio') THEN 'object store' WHEN contains(image, 'nginx') THEN 'reverse proxy' ELSE 'unknown' END AS kind
FROM services_flat JOIN cap ON i = ord % 8
""", ("services_flat",))
def _(spark, sf):
    out = commands.service_capacity(b.services(spark, sf))
    return out.select("repo_id", "name", "capacity", "ceiling", "capacity_flags", "runs", "entrypoint", "kind")


@query("J20_service_for_scope", """
sc AS (SELECT DISTINCT repo_id, unnest(['backend/src', 'pkg2', 'pkg2/economy/x', 'web', 'backend-tools']) AS scope FROM services_flat),
c AS (SELECT sc.repo_id, scope, name, ord, ports <> '' AS serving FROM sc JOIN services_flat s ON s.repo_id = sc.repo_id AND (source_root = '' OR scope = source_root OR starts_with(scope, source_root || '/'))),
f AS (SELECT *, bool_or(serving) OVER (PARTITION BY repo_id, scope) AS anys FROM c),
o AS (SELECT repo_id, scope, arg_min(name, ord) FILTER (WHERE regexp_matches(name, '^[A-Za-z0-9._]')) AS ok, arg_min(name, ord) AS first FROM f WHERE serving OR NOT anys GROUP BY ALL)
SELECT sc.repo_id, sc.scope, coalesce(ok, '') AS service, CASE WHEN ok IS NULL THEN coalesce(first, '') ELSE '' END AS refused FROM sc LEFT JOIN o USING (repo_id, scope)
""", ("services_flat",))
def _(spark, sf):
    s = b.services(spark, sf)
    wanted = F.array(*[F.lit(x) for x in ("backend/src", "pkg2", "pkg2/economy/x", "web", "backend-tools")])
    scopes = s.select("repo_id").distinct().withColumn("scope", F.explode(wanted))
    return commands.service_for_scope(s, scopes)


ARTS = f"""
arts AS (SELECT 'o' || (o_custkey % 7) AS repo_id, [{', '.join(map(_q, dims.ARTIFACT_KINDS))}][(o_orderkey % 10 + 1)::INT] AS kind,
  repeat('d/', (o_custkey % 4)::INT) || 'f' || o_orderkey AS path, o_orderstatus, o_orderpriority FROM orders)"""


def artifacts(spark, sf):
    o = b.table(spark, sf, "orders")
    kinds = F.array(*[F.lit(k) for k in dims.ARTIFACT_KINDS])
    return o.select(
        F.concat(F.lit("o"), (F.col("o_custkey") % 7).cast("string")).alias("repo_id"),
        F.element_at(kinds, (F.col("o_orderkey") % 10 + 1).cast("int")).alias("kind"),
        F.concat(F.expr("repeat('d/', cast(o_custkey % 4 as int))"), F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"),
        F.map_filter(
            F.create_map(
                F.lit("triggers"), F.when(F.col("o_orderstatus") == "F", "push, pull_request").otherwise("push"),
                F.lit("tests"), F.when(F.col("o_orderpriority") == "1-URGENT", "pytest"),
            ),
            lambda k, v: v.isNotNull(),
        ).alias("facts"),
    )


@query("W08_cap_per_kind", ARTS + """,
r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, kind ORDER BY len(string_split(path, '/')), path) AS position, count(*) OVER (PARTITION BY repo_id, kind) AS total FROM arts)
SELECT repo_id, kind, path, position, total FROM r WHERE position <= 25
""")
def _(spark, sf):
    head, totals = ranking.cap_per_kind(artifacts(spark, sf))
    return head.join(totals, ["repo_id", "kind"]).select("repo_id", "kind", "path", "position", "total")


@query("A13_tests_gate_the_merge", ARTS + " SELECT repo_id, bool_or(kind = 'ci' AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS gated FROM arts GROUP BY ALL")
def _(spark, sf):
    return deployment.tests_gate(artifacts(spark, sf))
