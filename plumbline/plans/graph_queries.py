"""Bound queries over modules, edges, budgets and the findings attached to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import dims
from plumbline.operators import commands, cost, gates, grading, graph, ranking
from plumbline.plans import bindings as b
from plumbline.plans.catalog import query
from plumbline.session import cut_lineage

MAP = ("modules_flat", "edges_flat")
FIND = ("modules_flat", "edges_flat", "findings_flat")

# -- the map, in SQL -------------------------------------------------------------------------------

DEPTH = """
sig AS (SELECT *, CASE WHEN signals = '' THEN [] ELSE string_split(signals, ',') END AS sigs FROM modules_flat),
hops(repo_id, path, d) AS (
  SELECT repo_id, path, 0 FROM sig WHERE list_contains(sigs, 'entrypoint')
  UNION
  SELECT e.repo_id, e.dst, h.d + 1 FROM hops h JOIN edges_flat e ON e.repo_id = h.repo_id AND e.src = h.path WHERE h.d < 40),
depths AS (SELECT repo_id, path, min(d) AS depth FROM hops GROUP BY ALL),
fan AS (SELECT repo_id, dst AS path, count(*) AS fan_in FROM edges_flat GROUP BY ALL),
churned AS (SELECT {churn}),
mods AS (SELECT s.repo_id, s.p_partkey, s.path, s.loc, s.sigs, s.unmatched, s.external, d.depth, coalesce(f.fan_in, 0) AS fan_in
  FROM sig s LEFT JOIN depths d USING (repo_id, path) LEFT JOIN fan f USING (repo_id, path))""".replace("churned AS (SELECT {churn}),\n", "")
LANG = "CASE regexp_extract(path, '[.]([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'java' THEN 'java' ELSE 'cpp' END"


@b.remembered
def edges_once(spark: SparkSession, sf: str) -> DataFrame:
    """The edges, written once for depth, fan-in and neighbours."""
    return cut_lineage(b.view(spark, sf, "edges_flat"))


@b.remembered
def mapped(spark: SparkSession, sf: str) -> DataFrame:
    """Modules with fan-in and depth."""
    mods, edges = b.modules(spark, sf), edges_once(spark, sf)
    deep = graph.request_depth(mods, edges, graph.entrypoints_of(mods))
    return graph.fan_in(deep, edges)


def reads(spark, sf):
    return b.view(spark, sf, "reads_flat")


@query("G01_fan_in", DEPTH + " SELECT repo_id, path, fan_in FROM mods", MAP)
def _(spark, sf):
    return graph.fan_in(b.modules(spark, sf), b.view(spark, sf, "edges_flat")).select("repo_id", "path", "fan_in")


@query("G02_request_depth", DEPTH + " SELECT repo_id, path, depth::BIGINT AS depth FROM mods", MAP)
def _(spark, sf):
    mods = b.modules(spark, sf)
    return graph.request_depth(mods, b.view(spark, sf, "edges_flat"), graph.entrypoints_of(mods)).select("repo_id", "path", "depth")


@query("G03_unreachable_modules", DEPTH + " SELECT repo_id, path FROM mods WHERE depth IS NULL AND repo_id IN (SELECT repo_id FROM mods WHERE depth IS NOT NULL)", MAP)
def _(spark, sf):
    return graph.unreachable_modules(mapped(spark, sf))


@query("G04_request_tiers", DEPTH + " SELECT repo_id, depth::BIGINT AS depth, count(*) OVER (PARTITION BY repo_id, depth) AS modules, path FROM mods WHERE depth IS NOT NULL", MAP)
def _(spark, sf):
    return graph.request_tiers(mapped(spark, sf))


BOOST = """
found AS (SELECT repo_id, path AS dst, count(*) AS n FROM findings_flat GROUP BY ALL),
boosts AS (SELECT e.repo_id, e.src AS path, 1 + 0.5 * sum(n)::DOUBLE AS boost FROM edges_flat e JOIN found USING (repo_id, dst) GROUP BY ALL)"""


@query("G05_suspect_neighbours", BOOST + " SELECT repo_id, path, round(boost, 6) AS boost FROM boosts", ("edges_flat", "findings_flat"))
def _(spark, sf):
    return graph.suspect_neighbours(b.view(spark, sf, "edges_flat"), b.view(spark, sf, "findings_flat"))


ROLLUP = DEPTH + """,
fc AS (SELECT repo_id, path, count(*) AS f FROM findings_flat GROUP BY ALL),
grp AS (SELECT m.repo_id, array_to_string(string_split(path, '/')[1:least(2, greatest(len(string_split(path, '/')) - 1, 1))], '/') AS package, count(*) AS modules,
    coalesce(sum(f), 0)::BIGINT AS findings, (min(depth) + 1)::BIGINT AS depth FROM mods m LEFT JOIN fc USING (repo_id, path) GROUP BY ALL),
packs AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY findings DESC, modules DESC, package) AS position FROM grp QUALIFY position <= 14)"""


@b.remembered
def packages(spark, sf):
    return graph.package_rollup(mapped(spark, sf), b.view(spark, sf, "findings_flat"))


@query("G06_package_rollup", ROLLUP + " SELECT repo_id, package, modules, findings, depth, position, string_split(package, '/')[-1] AS label FROM packs", FIND)
def _(spark, sf):
    return packages(spark, sf)


@query("G07_service_package_edges", ROLLUP + """,
two AS (SELECT repo_id, name FROM (SELECT *, bool_or(ports <> '') OVER (PARTITION BY repo_id) AS anyp FROM services_flat) WHERE NOT anyp OR ports <> '' QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY ord, name) <= 2),
four AS (SELECT repo_id, package FROM packs QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY coalesce(nullif(depth, 0), 99), modules DESC, position) <= 4)
SELECT repo_id, 'svc:' || name AS source, 'code:' || package AS target, 'a request reaches this package' AS why FROM two JOIN four USING (repo_id)
""", (*FIND, "services_flat"))
def _(spark, sf):
    return graph.service_package_edges(b.services(spark, sf), packages(spark, sf))


_CLIENTS = ", ".join(f"('{s}', '{c}')" for s, cs in dims.STORE_CLIENTS.items() for c in cs)


@query("J16_package_store_edges", ROLLUP + f""",
cl(store, lib) AS (VALUES {_CLIENTS}),
back AS (SELECT DISTINCT repo_id, CASE ord % 4 WHEN 1 THEN 'redis' WHEN 2 THEN 'postgres' ELSE 'rabbitmq' END AS store FROM services_flat WHERE image <> ''),
ext AS (SELECT DISTINCT repo_id, path, unnest(string_split(external, ',')) AS lib FROM modules_flat WHERE external <> '')
SELECT DISTINCT p.repo_id, 'code:' || package AS source, 'store:' || b.store AS target, 'imports a ' || b.store || ' client' AS why
FROM back b JOIN cl USING (store) JOIN ext e ON e.repo_id = b.repo_id AND e.lib = cl.lib JOIN packs p ON p.repo_id = b.repo_id AND starts_with(e.path, p.package)
""", (*FIND, "services_flat"))
def _(spark, sf):
    kind = F.when(F.col("ord") % 4 == 1, "redis").when(F.col("ord") % 4 == 2, "postgres").otherwise("rabbitmq")
    backing = b.services(spark, sf).filter("image <> ''").select("repo_id", kind.alias("name")).distinct()
    external = b.modules(spark, sf).select("repo_id", "path", F.explode("external").alias("name"))
    return graph.package_store_edges(packages(spark, sf), external, backing)


@query("J17_choose_specialists", """
lay(i, layer, sig) AS (VALUES (0,'concurrency','concurrency'),(1,'network','network'),(1,'network','entrypoint'),(2,'data','data'),(3,'distributed','distributed'),(4,'failure','failure'),(5,'observability','observability'),(6,'security','security'),(7,'craft','craft'),(8,'serving','serving')),
al AS (SELECT DISTINCT repo_id, path, i, layer FROM modules_flat JOIN lay ON list_contains(string_split(signals, ','), sig)),
ch AS (SELECT DISTINCT repo_id, path, layer FROM findings_flat WHERE severity = 'high'),
n AS (SELECT repo_id, path, count(*) AS k FROM al GROUP BY ALL),
pick AS (SELECT al.* FROM al JOIN n USING (repo_id, path) LEFT JOIN ch ON ch.repo_id = al.repo_id AND ch.path = al.path AND ch.layer = al.layer WHERE k = 1 OR ch.layer IS NOT NULL)
SELECT m.repo_id, m.path, coalesce((SELECT string_agg(layer, ',' ORDER BY i) FROM al WHERE al.repo_id = m.repo_id AND al.path = m.path), '') AS allowed,
  coalesce((SELECT string_agg(layer, ',' ORDER BY i) FROM pick WHERE pick.repo_id = m.repo_id AND pick.path = m.path), '') AS layers,
  EXISTS (SELECT 1 FROM al WHERE al.repo_id = m.repo_id AND al.path = m.path) AND NOT EXISTS (SELECT 1 FROM pick WHERE pick.repo_id = m.repo_id AND pick.path = m.path) AS unread
FROM modules_flat m
""", ("modules_flat", "findings_flat"))
def _(spark, sf):
    """Layers that said something severe about a module stand for the router's answer."""
    said = b.view(spark, sf, "findings_flat").filter("severity = 'high'")
    choices = said.groupBy("repo_id", "path").agg(F.collect_set(F.concat(F.lit(" "), F.upper("layer"))).alias("names"))
    return graph.choose_specialists(b.modules(spark, sf), choices)


@query("F11_why_skipped", """
SELECT m.repo_id, m.path, CASE WHEN signals <> '' THEN 'budget' WHEN unmatched <> '' THEN 'no detector matched its imports' ELSE 'no signal' END AS reason
FROM modules_flat m LEFT JOIN reads_flat r USING (repo_id, path) WHERE r.path IS NULL
""", ("modules_flat", "reads_flat"))
def _(spark, sf):
    return gates.why_skipped(b.modules(spark, sf), reads(spark, sf))


@query("F10_cap_severity", DEPTH + """,
ent AS (SELECT repo_id, bool_or(depth IS NOT NULL) AS has FROM mods GROUP BY ALL),
c AS (SELECT f.repo_id, f.ord, f.severity, f.mechanism, m.depth, CASE WHEN has AND m.depth IS NULL THEN 'low' WHEN has AND m.depth >= 4 THEN 'medium' END AS cap
  FROM findings_flat f LEFT JOIN mods m USING (repo_id, path) LEFT JOIN ent ON ent.repo_id = m.repo_id),
l AS (SELECT *, coalesce((CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) > (CASE cap WHEN 'medium' THEN 1 WHEN 'low' THEN 0 END), false) AS low FROM c)
SELECT repo_id, ord, CASE WHEN low THEN cap ELSE severity END AS severity,
  CASE WHEN low THEN mechanism || ' (Severity lowered: ' || CASE WHEN depth IS NULL THEN 'no entrypoint reaches this module' ELSE depth || ' hops from the nearest entrypoint' END || '.)' ELSE mechanism END AS mechanism FROM l
""", FIND)
def _(spark, sf):
    return gates.cap_severity(b.drafts(spark, sf), mapped(spark, sf)).select("repo_id", "ord", "severity", "mechanism")


RANKED = DEPTH + """,
sc AS (SELECT f.repo_id, f.ord, f.path, f.line, f.symbol, (CASE WHEN predicted = 1 THEN 4.0 ELSE 1.0 END) * (CASE WHEN trim(arithmetic) <> '' THEN 1.5 ELSE 1.0 END)
  * (CASE WHEN m.depth IS NULL THEN 0.2 ELSE pow(0.7, m.depth) END) * (1.0 + coalesce(m.fan_in, 0) / 10.0) + (CASE severity WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.5 ELSE 0.0 END) AS score
  FROM findings_flat f LEFT JOIN mods m USING (repo_id, path))"""


@query("O01_rank_findings", RANKED + " SELECT repo_id, ord, path, round(score, 6) AS score FROM sc", FIND)
def _(spark, sf):
    return ranking.rank_findings(b.drafts(spark, sf), mapped(spark, sf)).select("repo_id", "ord", "path", "score")


@query("O04_listed_and_rest", RANKED + """
SELECT repo_id, ord, path, row_number() OVER (PARTITION BY repo_id ORDER BY round(score, 9) DESC, path, line, symbol, ord) AS position,
  greatest(count(*) OVER (PARTITION BY repo_id) - 20, 0) AS rest FROM sc QUALIFY position <= 20
""", FIND)
def _(spark, sf):
    ranked = ranking.rank_findings(b.drafts(spark, sf), mapped(spark, sf)).withColumn("score", F.round("score", 9))
    head = ranking.listed_and_rest(ranked, ["repo_id"], ranking.finding_order(), 20)
    return head.select("repo_id", "ord", "path", "position", "rest")


VALUED = DEPTH + "," + BOOST + """,
ch AS (SELECT repo_id, path, count(*) AS churn FROM commit_files GROUP BY ALL),
vals AS (SELECT m.repo_id, m.path, m.loc, len(m.sigs) AS ns, (1.0 + fan_in) * len(m.sigs) * (1.0 + 0.1 * coalesce(churn, 0)) * (CASE WHEN list_contains(m.sigs, 'entrypoint') THEN 2.0 ELSE 1.0 END)
  * (CASE WHEN depth IS NULL THEN 0.25 ELSE pow(0.6, depth) END) * coalesce(boost, 1.0) / sqrt(greatest(m.loc, 1)) AS value
  FROM mods m LEFT JOIN ch USING (repo_id, path) LEFT JOIN boosts USING (repo_id, path))"""
VIEWS_V = ("modules_flat", "edges_flat", "findings_flat", "commit_files")


@b.remembered
def valued(spark, sf):
    churn = graph.churn(b.view(spark, sf, "commit_files"))
    mods = mapped(spark, sf).join(churn, ["repo_id", "path"], "left")
    boosts = graph.suspect_neighbours(edges_once(spark, sf), b.view(spark, sf, "findings_flat"))
    return graph.module_value(mods, boosts)


@query("O03_module_value", VALUED + " SELECT repo_id, path, round(value, 4) AS value FROM vals", VIEWS_V)
def _(spark, sf):
    return valued(spark, sf).select("repo_id", "path", F.round("value", 4).alias("value"))


@query("W05_budget_selection", VALUED + """,
cand AS (SELECT repo_id, path, round(value, 4) AS value, CAST(round(loc / 1000.0::DOUBLE * 0.02 * 1000000) AS BIGINT) AS micros, row_number() OVER (PARTITION BY repo_id ORDER BY round(value, 4) DESC, path DESC) AS rn FROM vals WHERE ns > 0),
walk(repo_id, rn, remaining, path, sel) AS (
  SELECT repo_id, 0::BIGINT, 100000::BIGINT, NULL::VARCHAR, false FROM (SELECT DISTINCT repo_id FROM cand)
  UNION ALL
  SELECT c.repo_id, c.rn, CASE WHEN c.micros <= w.remaining THEN w.remaining - c.micros ELSE w.remaining END, c.path, c.micros <= w.remaining
  FROM walk w JOIN cand c ON c.repo_id = w.repo_id AND c.rn = w.rn + 1)
SELECT w.repo_id, w.path, c.micros, sel AS selected FROM walk w JOIN cand c USING (repo_id, path) WHERE w.path IS NOT NULL
""", VIEWS_V)
def _(spark, sf):
    """Ten cents per repository."""
    cand = valued(spark, sf).filter(F.size("signals") > 0).select(
        "repo_id", "path", F.round("value", 4).alias("value"), cost.estimate_micros(F.col("loc"), F.lit(None).cast("double")).alias("micros")
    )
    # several rounds read the candidates: written once, not recomputed
    picked = cost.budget_selection(cut_lineage(cand), 100_000)
    return picked.select("repo_id", "path", "micros", "selected")


@query("W04_pack_prompt", DEPTH + """,
ctx AS (SELECT repo_id, count(*) * 900 AS used FROM services_flat GROUP BY ALL),
o AS (SELECT repo_id, path, loc * 30 AS chars, row_number() OVER (PARTITION BY repo_id ORDER BY fan_in DESC, len(sigs) DESC, path) AS rn FROM mods),
r AS (SELECT o.*, 120000 - coalesce(used, 0) - coalesce(sum(chars + length(path) + 13) OVER (PARTITION BY repo_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rem FROM o LEFT JOIN ctx USING (repo_id)),
cut AS (SELECT repo_id, min(rn) AS c FROM r WHERE rem <= 16 OR chars > rem - 16 - length(path) GROUP BY ALL),
s AS (SELECT r.*, CASE WHEN c IS NULL OR rn < c THEN 'included' WHEN rn = c AND rem > 16 THEN 'truncated' ELSE 'skipped' END AS status FROM r LEFT JOIN cut USING (repo_id))
SELECT repo_id, path, chars::BIGINT AS chars, status, CASE status WHEN 'truncated' THEN 'truncated to fit one prompt' WHEN 'skipped' THEN 'did not fit in one prompt' END AS reason FROM s
""", (*MAP, "services_flat"))
def _(spark, sf):
    mods = mapped(spark, sf).select("repo_id", "path", "fan_in", F.size("signals").alias("n_signals"), (F.col("loc") * 30).alias("chars"))
    label = 4 + 45 + 4
    context = b.services(spark, sf).select("repo_id", F.lit("c").alias("name"), F.expr(f"repeat('x', {900 - label - 1})").alias("text"))
    return cost.pack_prompt(mods, context).select("repo_id", "path", "chars", "status", "reason")


@query("A08_churn", "SELECT repo_id, path, count(*) AS churn FROM commit_files GROUP BY ALL", ("commit_files",))
def _(spark, sf):
    return graph.churn(b.view(spark, sf, "commit_files"))


@query("A09_language_and_concern_counts", DEPTH + f""",
un AS (SELECT repo_id, count(*) AS n FROM modules_flat WHERE unmatched <> '' AND loc % 7 = 0 GROUP BY ALL),
t AS (SELECT repo_id, count(*) FILTER (WHERE depth IS NOT NULL) AS r, count(*) AS k FROM mods GROUP BY ALL)
SELECT repo_id, 'language' AS kind, {LANG} AS name, count(*) AS modules, sum(loc)::BIGINT AS lines FROM mods GROUP BY ALL
UNION ALL SELECT repo_id, 'concern', s, count(*), NULL FROM (SELECT repo_id, unnest(sigs) AS s FROM mods) GROUP BY ALL
UNION ALL SELECT repo_id, 'total', 'reachable', r, NULL FROM t
UNION ALL SELECT repo_id, 'total', 'unreachable', CASE WHEN r > 0 THEN k - r ELSE 0 END, NULL FROM t
UNION ALL SELECT t.repo_id, 'total', 'unparsed', coalesce(n, 0), NULL FROM t LEFT JOIN un USING (repo_id)
""", MAP)
def _(spark, sf):
    unparsed = b.modules(spark, sf).filter((F.size("unmatched_imports") > 0) & (F.col("loc") % 7 == 0)).select("repo_id", "path")
    return graph.language_concern_counts(mapped(spark, sf), unparsed)


COVER = """
bad AS (SELECT repo_id, path FROM modules_flat WHERE loc % 13 = 0 AND (repo_id, path) NOT IN (SELECT (repo_id, path) FROM reads_flat)),
led AS (
  SELECT repo_id, path, 'unparsed' AS reason, 0 AS rk FROM modules_flat WHERE loc % 17 = 0
  UNION ALL SELECT repo_id, path, 'symlink', 1 FROM modules_flat WHERE loc % 19 = 0
  UNION ALL SELECT repo_id, path, CASE WHEN signals <> '' THEN 'budget' WHEN unmatched <> '' THEN 'no detector matched its imports' ELSE 'no signal' END, 2
    FROM modules_flat m WHERE (repo_id, path) NOT IN (SELECT (repo_id, path) FROM reads_flat) AND (repo_id, path) NOT IN (SELECT (repo_id, path) FROM bad)
  UNION ALL SELECT repo_id, path, 'no specialist could read it', 3 FROM bad),
cov AS (SELECT repo_id, path, 'skipped' AS status, arg_max(reason, rk) AS reason FROM led GROUP BY repo_id, path
  UNION ALL SELECT DISTINCT repo_id, path, 'analysed', NULL FROM reads_flat)"""


@b.remembered
def coverage(spark, sf):
    mods, read = b.modules(spark, sf), reads(spark, sf)
    failed = mods.filter("loc % 13 = 0").join(read, ["repo_id", "path"], "left_anti").select("repo_id", "path", F.lit("no specialist could read it").alias("reason"))
    unparsed = mods.filter("loc % 17 = 0").select("repo_id", "path")
    skipped = mods.filter("loc % 19 = 0").select("repo_id", "path", F.lit("symlink").alias("reason"))
    return ranking.coverage_ledger(mods, unparsed, skipped, read, failed)


@query("U03_coverage_ledger", COVER + " SELECT * FROM cov", ("modules_flat", "reads_flat"))
def _(spark, sf):
    return coverage(spark, sf)


@query("A20_not_read_breakdown", DEPTH + "," + COVER + """,
t AS (SELECT repo_id, count(*) AS k, count(*) FILTER (WHERE depth IS NULL) AS no, count(*) FILTER (WHERE depth IS NOT NULL) AS yes FROM mods GROUP BY ALL),
r AS (SELECT repo_id, count(*) FILTER (WHERE status = 'analysed') AS n FROM cov GROUP BY ALL),
p AS (SELECT t.*, coalesce(r.n, 0) AS rd FROM t LEFT JOIN r USING (repo_id)),
w AS (SELECT repo_id, reason, count(*) AS n FROM cov WHERE status = 'skipped' GROUP BY ALL)
SELECT repo_id, 'population' AS kind, 'read by a specialist' AS label, rd AS n, round(rd / k, 6) AS share FROM p
UNION ALL SELECT repo_id, 'population', 'mapped, not read', greatest(k - rd, 0), round(greatest(k - rd, 0) / k, 6) FROM p
UNION ALL SELECT repo_id, 'population', 'no request reaches', CASE WHEN yes > 0 THEN no ELSE 0 END, round(CASE WHEN yes > 0 THEN no ELSE 0 END / k, 6) FROM p
UNION ALL (SELECT repo_id, 'reason', reason, n, NULL FROM w QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, reason) <= 6)
""", (*MAP, "reads_flat"))
def _(spark, sf):
    return graph.not_read_breakdown(coverage(spark, sf), mapped(spark, sf))


@query("A15_read_share", COVER + """,
r AS (SELECT repo_id, count(*) FILTER (WHERE status = 'analysed') AS n FROM cov GROUP BY ALL),
m AS (SELECT repo_id, count(*) AS k, (count(*) / 1000.0)::DOUBLE AS usd FROM modules_flat GROUP BY ALL)
SELECT repo_id, coalesce(n, 0) AS read, k AS modules, CASE WHEN k > 0 THEN round(100.0::DOUBLE * coalesce(n, 0) / k, 1) ELSE 0.0 END AS percent, round(usd, 6) AS usd, 'budget exhausted' AS stopped_because FROM m LEFT JOIN r USING (repo_id)
""", ("modules_flat", "reads_flat"))
def _(spark, sf):
    mods = b.modules(spark, sf)
    reports = mods.groupBy("repo_id").agg((F.count(F.lit(1)) / 1000.0).alias("usd"), F.lit("budget exhausted").alias("stopped_because"))
    return cost.read_share(coverage(spark, sf), mods, reports)


@query("A21_directory_rollup", """
st AS (SELECT m.repo_id, m.path, CASE WHEN f.path IS NOT NULL THEN 4 WHEN r.path IS NOT NULL THEN 2 WHEN loc % 5 = 0 THEN 3 ELSE 1 END AS rk FROM modules_flat m
  LEFT JOIN (SELECT DISTINCT repo_id, path FROM findings_flat WHERE severity = 'high' AND seed > 2001) f USING (repo_id, path) LEFT JOIN reads_flat r USING (repo_id, path)),
ex AS (SELECT repo_id, rk, string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')))) AS i FROM st)
SELECT repo_id, array_to_string(parts[1:i], '/') AS directory, count(*) AS modules, ['unread', 'read', 'reading', 'flagged'][max(rk)] AS state FROM ex GROUP BY ALL
""", ("modules_flat", "findings_flat", "reads_flat"))
def _(spark, sf):
    mods = b.modules(spark, sf)
    flagged = b.view(spark, sf, "findings_flat").filter("severity = 'high' and seed > 2001").select("repo_id", "path", F.lit("flagged").alias("state"))
    states = (
        flagged.unionByName(reads(spark, sf).withColumn("state", F.lit("read")))
        .unionByName(mods.filter("loc % 5 = 0").select("repo_id", "path", F.lit("reading").alias("state")))
        .withColumn("r", F.when(F.col("state") == "flagged", 3).when(F.col("state") == "read", 2).otherwise(1))
        .groupBy("repo_id", "path")
        .agg(F.max_by("state", "r").alias("state"))
    )
    return graph.directory_rollup(mods, states)


@query("A05_layer_coverage", """
lay(layer, sig) AS (VALUES ('concurrency','concurrency'),('network','network'),('network','entrypoint'),('data','data'),('distributed','distributed'),('failure','failure'),('observability','observability'),('security','security'),('craft','craft'),('serving','serving')),
raised AS (SELECT DISTINCT repo_id, path, layer FROM modules_flat JOIN lay ON list_contains(string_split(signals, ','), sig)),
cnt AS (SELECT repo_id, layer, count(*) AS a, count(r.path) AS v FROM raised LEFT JOIN reads_flat r USING (repo_id, path) GROUP BY ALL),
pub AS (SELECT repo_id, layer, count(*) AS n FROM findings_flat GROUP BY ALL),
frame AS (SELECT repo_id, layer FROM (SELECT DISTINCT repo_id FROM modules_flat) CROSS JOIN (SELECT DISTINCT layer FROM lay))
SELECT repo_id, layer, coalesce(a, 0) AS appears_in, coalesce(v, 0) AS reviewed, coalesce(n, 0) AS findings, round(v / nullif(a, 0), 6) AS share, 'signalled' AS basis
FROM frame LEFT JOIN cnt USING (repo_id, layer) LEFT JOIN pub USING (repo_id, layer)
UNION ALL SELECT repo_id, 'unattributed', NULL, NULL, sum(n)::BIGINT, NULL, NULL FROM pub WHERE layer NOT IN (SELECT layer FROM lay) GROUP BY repo_id
""", ("modules_flat", "findings_flat", "reads_flat"))
def _(spark, sf):
    return grading.layer_coverage(b.modules(spark, sf), reads(spark, sf), b.view(spark, sf, "findings_flat"))


@query("A19_apportion_batch_cost", """
ba AS (SELECT o_orderkey, round(o_totalprice / 1000000, 6) AS usd FROM orders),
li AS (SELECT l_orderkey, path, bool_or(l_linenumber = 3) AS bad FROM lineitem JOIN modules_flat ON l_partkey = p_partkey GROUP BY ALL)
SELECT l_orderkey AS batch_id, path, CAST(round(usd * 1000000 / count(*) OVER (PARTITION BY l_orderkey)) AS BIGINT) AS micros, NOT bad AS read FROM li JOIN ba ON l_orderkey = o_orderkey
""", ("modules_flat",))
def _(spark, sf):
    """An order is a batch, its parts the modules read together, line 3 the one that failed."""
    paths = b.view(spark, sf, "modules_flat").select("p_partkey", "path")
    lines = b.table(spark, sf, "lineitem").join(paths, F.col("l_partkey") == F.col("p_partkey"))
    rows = lines.groupBy("l_orderkey", "path").agg(F.bool_or(F.col("l_linenumber") == 3).alias("failed"))
    batches = rows.join(b.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("batch_id"), F.round(F.col("o_totalprice") / 1_000_000, 6).alias("batch_usd"), "path", "failed"
    )
    return cost.apportion(batches).select("batch_id", "path", "micros", "read")


@query("J19_declared_entrypoints", """
refs AS (SELECT DISTINCT repo_id, 'pkg' || (s_suppkey % 7) || '/economy/m' || s_suppkey AS ref FROM (SELECT 'r' || (s_suppkey % 4) AS repo_id, s_suppkey FROM supplier))
SELECT m.repo_id, m.path FROM modules_flat m WHERE list_contains(string_split(signals, ','), 'entrypoint') OR (repo_id, regexp_replace(path, '[.][a-z]+$', '')) IN (SELECT (repo_id, ref) FROM refs)
""", ("modules_flat",))
def _(spark, sf):
    """Each supplier starts the module that carries its number, from the folder it is built in."""
    k = F.col("s_suppkey")
    started = b.table(spark, sf, "supplier").select(
        F.concat(F.lit("r"), (k % 4).cast("string")).alias("repo_id"),
        F.concat(F.lit("pkg"), (k % 7).cast("string"), F.lit("/economy")).alias("source_root"),
        F.concat(F.lit("celery -A m"), k.cast("string"), F.lit(" worker")).alias("command"),
    )
    return graph.entrypoints_of(b.modules(spark, sf), commands.declared_entrypoints(started))
