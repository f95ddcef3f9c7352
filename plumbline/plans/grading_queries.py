"""Bound queries over findings: gates, grading, claims, orders, statistics."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import dims
from plumbline.functions.text import short_number
from plumbline.operators import claims, gates, grading, ranking, stats
from plumbline.plans import bindings as b
from plumbline.plans.catalog import query
from plumbline.schemas import RUN
from plumbline.session import cut_lineage, written

FLAT = ("findings_flat",)
PRED = ["prediction.metric", "prediction.comparator", "prediction.value", "prediction.upper", "prediction.unit"]

# -- the gate, in SQL ---------------------------------------------------------------------------

_UNITS = ", ".join(
    f"('{u}', {lo!r}::DOUBLE, {hi!r}::DOUBLE, '{lo:g}', '{hi:g}')" for u, (lo, hi) in dims.UNIT_RANGES.items()
)
GATED = f"""
units(u, lo, hi, lo_t, hi_t) AS (VALUES {_UNITS}),
judged AS (
  SELECT f.*, CASE
    WHEN predicted = 0 THEN NULL
    WHEN p_condition = '' THEN 'condition: String should have at least 1 character'
    WHEN p_comparator = 'at_least' AND p_value <= coalesce(lo, 0) THEN 'vacuous: essentially every measurement in ' || p_unit || ' is at least ' || coalesce(lo_t, '0') || ', so this threshold excludes nothing'
    WHEN p_comparator = 'at_most' AND p_value >= coalesce(hi, 1e9) THEN 'vacuous: no realisable measurement in ' || p_unit || ' exceeds ' || coalesce(hi_t, '1e+09') || ', so this threshold excludes nothing'
    WHEN p_comparator = 'between' AND p_upper IS NOT NULL AND p_value <= 0 THEN 'vacuous: a band starting at or below zero excludes nothing'
    WHEN p_comparator = 'between' AND p_upper / p_value > 100 THEN 'vacuous: a band spanning more than 100x admits almost every outcome'
    WHEN p_comparator = 'between' AND p_upper IS NULL THEN 'comparator BETWEEN requires an upper bound'
    WHEN p_comparator = 'between' AND p_upper <= p_value THEN 'upper bound must exceed the lower bound, or nothing can Hit'
  END AS reject_reason
  FROM findings_flat f LEFT JOIN units ON u = lower(trim(p_unit)))"""
# findings whose prediction survived the gate, with a verdict
GRADED = (
    GATED
    + """,
graded AS (
  SELECT *, predicted = 1 AND reject_reason IS NULL AS fals,
    CASE WHEN predicted = 0 OR reject_reason IS NOT NULL OR measured = 0 THEN NULL
      WHEN m_value IS NULL THEN 'broken'
      WHEN (p_comparator = 'at_least' AND m_value >= p_value) OR (p_comparator = 'at_most' AND m_value <= p_value)
        OR (p_comparator = 'between' AND m_value BETWEEN p_value AND p_upper) THEN 'hit'
      ELSE 'miss' END AS verdict
  FROM judged)"""
)


@b.remembered
def gated_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings whose predictions passed the gate, the rejection kept beside them."""
    return gates.falsifiability_gate(b.findings(spark, sf))


@b.remembered
def dropped_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rejected predictions, and unpredicted high findings taken back, as the dropped side of a report."""
    gated = gated_findings(spark, sf)
    taken = gated.filter("reject_reason is not null").select(*RUN, "path", "symbol", F.col("reject_reason").alias("reason"))
    return taken.unionByName(
        gated.filter("prediction is null and severity = 'high'").select(
            *RUN, "path", F.concat(F.lit("old_"), "symbol").alias("symbol"), F.lit("withdrawn").alias("reason")
        )
    )


@b.remembered
def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One row per review: its model, ground truth, cost and whether it failed."""
    flat = b.view(spark, sf, "findings_flat")
    base = flat.groupBy(*RUN).agg(
        F.min("layer").alias("_l"), F.max("ord").alias("_o"), F.countDistinct("symbol").alias("_s"), F.min("p_value").alias("_v")
    )
    return base.select(
        *RUN,
        F.concat(F.lit("model-"), (F.col("_o") % 3).cast("string")).alias("model_id"),
        (F.col("_s") % 7 + 3).alias("seeded"),
        (F.col("_s") % 4).alias("found"),
        (F.col("_o") % 11 == 0).alias("failed"),
        (F.col("_s") / 1000.0).alias("usd"),
        (F.col("_s") * 1.5).alias("seconds"),
    )


REPORTS = """
reports AS (
  SELECT case_id, arm, seed, 'model-' || (max(ord) % 3) AS model_id, count(DISTINCT symbol) % 7 + 3 AS seeded,
    count(DISTINCT symbol) % 4 AS found, max(ord) % 11 = 0 AS failed, count(DISTINCT symbol) / 1000.0::DOUBLE AS usd,
    count(DISTINCT symbol) * 1.5::DOUBLE AS seconds
  FROM findings_flat GROUP BY ALL)"""

SCORED = (
    GRADED
    + ","
    + REPORTS
    + """,
drops AS (
  SELECT case_id, arm, seed, path, symbol FROM graded WHERE reject_reason IS NOT NULL
  UNION ALL SELECT case_id, arm, seed, path, 'old_' || symbol FROM graded WHERE NOT fals AND severity = 'high'),
dropsum AS (
  SELECT d.case_id, d.arm, d.seed, count(*) AS dropped, count(*) FILTER (WHERE k.path IS NULL) AS discarded
  FROM drops d LEFT JOIN (SELECT DISTINCT case_id, arm, seed, path, symbol FROM graded) k USING (case_id, arm, seed, path, symbol)
  GROUP BY ALL),
totals AS (
  SELECT case_id, arm, seed, count(*) AS total_findings, count(*) FILTER (WHERE fals) AS falsifiable,
    count(*) FILTER (WHERE verdict IN ('hit', 'miss')) AS tested_findings, count(*) FILTER (WHERE verdict = 'broken') AS broken
  FROM graded GROUP BY ALL),
units_run AS (
  SELECT case_id, arm, seed, CASE WHEN m_experiment <> '' THEN 'e:' || m_experiment ELSE 'p:' || p_metric || '|' || p_condition || '|' || p_value END AS u,
    bool_and(verdict = 'hit') AS held
  FROM graded WHERE verdict IN ('hit', 'miss') GROUP BY ALL),
runs AS (SELECT case_id, arm, seed, count(*) AS runs, count(*) FILTER (WHERE held) AS hits FROM units_run GROUP BY ALL),
scores AS (
  SELECT r.case_id, r.arm, r.seed, model_id, seeded, found, failed, coalesce(total_findings, 0) AS total_findings,
    coalesce(tested_findings, 0) AS tested_findings, coalesce(total_findings, 0) + coalesce(discarded, 0) AS observations,
    coalesce(falsifiable, 0) AS falsifiable, coalesce(runs, 0) AS tested, coalesce(runs, 0) AS experiments, coalesce(hits, 0) AS hits,
    coalesce(broken, 0) AS broken, coalesce(dropped, 0) AS dropped,
    falsifiable / nullif(coalesce(total_findings, 0) + coalesce(discarded, 0), 0) AS falsifiable_precision,
    hits / nullif(runs, 0) AS hit_rate, tested_findings / nullif(falsifiable, 0) AS prediction_coverage, usd, seconds
  FROM reports r LEFT JOIN totals USING (case_id, arm, seed) LEFT JOIN dropsum USING (case_id, arm, seed) LEFT JOIN runs USING (case_id, arm, seed))"""
)


@b.remembered
def scores(spark: SparkSession, sf: str) -> DataFrame:
    return grading.score_reports(gated_findings(spark, sf), dropped_rows(spark, sf), report_rows(spark, sf))


def scores_once(spark: SparkSession, sf: str) -> DataFrame:
    """The scores, one row per report, written once for what reads them more than once."""
    return cut_lineage(scores(spark, sf))


ARM_SQL = """
    count(*) AS cases, array_to_string(list_sort(list(DISTINCT model_id)), ',') AS model_ids, sum(seeded)::BIGINT AS seeded, sum(found)::BIGINT AS found,
    sum(total_findings)::BIGINT AS total_findings, sum(tested_findings)::BIGINT AS tested_findings, sum(observations)::BIGINT AS observations,
    sum(falsifiable)::BIGINT AS falsifiable, sum(tested)::BIGINT AS tested, sum(experiments)::BIGINT AS experiments, sum(hits)::BIGINT AS hits,
    sum(broken)::BIGINT AS broken, sum(dropped)::BIGINT AS dropped, round(sum(usd), 6) AS usd, round(sum(seconds), 6) AS seconds,
    count(*) FILTER (WHERE failed) AS failed, round(min(falsifiable_precision), 6) AS per_case_low, round(max(falsifiable_precision), 6) AS per_case_high,
    round(sum(found) / nullif(sum(seeded), 0), 6) AS detection_rate, round(sum(falsifiable) / nullif(sum(observations), 0), 6) AS falsifiable_precision,
    CASE WHEN sum(experiments) >= 5 THEN round(sum(hits) / nullif(sum(tested), 0), 6) END AS hit_rate,
    round(sum(tested_findings) / nullif(sum(falsifiable), 0), 6) AS prediction_coverage"""


@query("F09_grade_predictions", GRADED + """
SELECT case_id, arm, seed::BIGINT AS seed, ord, verdict, fals AS is_falsifiable, coalesce(verdict IN ('hit', 'miss'), false) AS was_tested FROM graded
""", FLAT)
def _(spark, sf):
    return gates.grade(gated_findings(spark, sf)).select(*RUN, "ord", "verdict", "is_falsifiable", "was_tested")


@query("A02_experiment_outcomes", SCORED + " SELECT case_id, arm, seed::BIGINT AS seed, hits, runs FROM runs", FLAT)
def _(spark, sf):
    return grading.experiment_outcomes(gates.grade(gated_findings(spark, sf)))


@query("A01_score_reports", SCORED + """
SELECT * REPLACE (seed::BIGINT AS seed, round(falsifiable_precision, 6) AS falsifiable_precision, round(hit_rate, 6) AS hit_rate,
  round(prediction_coverage, 6) AS prediction_coverage, round(usd, 6) AS usd, round(seconds, 6) AS seconds) FROM scores
""", FLAT)
def _(spark, sf):
    return scores(spark, sf)


@query("A03_aggregate_arm", SCORED + f" SELECT arm, {ARM_SQL} FROM scores GROUP BY arm", FLAT)
def _(spark, sf):
    return grading.aggregate_arm(scores(spark, sf))


SWEEP = SCORED + f""",
per_seed AS (SELECT arm, seed, {ARM_SQL.replace('round(', '(').replace(', 6)', ')')} FROM scores GROUP BY arm, seed),
pooled AS (SELECT arm, {ARM_SQL.replace('round(', '(').replace(', 6)', ')')} FROM scores GROUP BY arm),
sweeps AS (
  SELECT s.arm, count(*) AS seeds, sum(s.failed)::BIGINT AS failed, true AS independent,
    CASE WHEN sum(s.failed) < sum(s.cases) THEN avg(s.detection_rate) END AS recall_mean,
    CASE WHEN sum(s.failed) < sum(s.cases) THEN min(s.detection_rate) END AS recall_low,
    CASE WHEN sum(s.failed) < sum(s.cases) THEN max(s.detection_rate) END AS recall_high,
    list(s.detection_rate ORDER BY s.seed) FILTER (WHERE s.detection_rate IS NOT NULL) AS recalls,
    any_value(p.hits) AS hits, any_value(p.tested) AS tested, any_value(p.experiments) AS experiments, any_value(p.hit_rate) AS hit_rate,
    avg(s.falsifiable_precision) AS precision_mean, any_value(p.prediction_coverage) AS coverage_mean, any_value(p.broken) AS broken,
    avg(s.usd) AS usd_mean, avg(s.seconds) AS seconds_mean
  FROM per_seed s JOIN pooled p USING (arm) GROUP BY s.arm)"""


@query("A04_sweep_summary", SWEEP + """
SELECT arm, seeds, failed, independent, round(recall_mean, 6) AS recall_mean, round(recall_low, 6) AS recall_low, round(recall_high, 6) AS recall_high,
  len(recalls)::BIGINT AS n_recalls, round(list_sum(recalls), 6) AS recall_sum, hits, tested, experiments, round(hit_rate, 6) AS hit_rate,
  round(precision_mean, 6) AS precision_mean, round(coverage_mean, 6) AS coverage_mean, broken, round(usd_mean, 6) AS usd_mean, round(seconds_mean, 6) AS seconds_mean
FROM sweeps
""", FLAT)
def _(spark, sf):
    s = grading.sweep_summary(scores_once(spark, sf))
    total = F.aggregate("recalls", F.lit(0.0), lambda a, x: a + x)
    return s.withColumn("n_recalls", F.size("recalls")).withColumn("recall_sum", total).drop("recalls")


@query("A16_arm_comparison", SWEEP + """,
cells AS (SELECT arm, unnest([
  {'ord': 0, 'metric': 'seeded recall (mean)', 'said': printf('%.3f', round(recall_mean, 3))}, {'ord': 1, 'metric': 'range low', 'said': printf('%.3f', recall_low)},
  {'ord': 2, 'metric': 'range high', 'said': printf('%.3f', recall_high)}, {'ord': 3, 'metric': 'falsifiable precision', 'said': printf('%.3f', precision_mean)},
  {'ord': 4, 'metric': 'hit rate', 'said': printf('%.3f', hit_rate)}, {'ord': 5, 'metric': 'hits', 'said': hits::VARCHAR},
  {'ord': 6, 'metric': 'tested', 'said': tested::VARCHAR}, {'ord': 7, 'metric': 'experiments', 'said': experiments::VARCHAR},
  {'ord': 8, 'metric': 'prediction coverage', 'said': printf('%.3f', coverage_mean)}, {'ord': 9, 'metric': 'broken', 'said': broken::VARCHAR},
  {'ord': 10, 'metric': 'cost usd', 'said': printf('%.5f', usd_mean)}, {'ord': 11, 'metric': 'seconds', 'said': printf('%.1f', seconds_mean)}], recursive := true) FROM sweeps)
SELECT ord::BIGINT AS ord, metric, coalesce(max(said) FILTER (WHERE arm = 'baseline'), 'n/a') AS baseline, coalesce(max(said) FILTER (WHERE arm = 'pipeline'), 'n/a') AS pipeline
FROM cells GROUP BY ord, metric
""", FLAT)
def _(spark, sf):
    return grading.arm_comparison(grading.sweep_summary(scores_once(spark, sf)), ["baseline", "pipeline"])


@query("F07_falsifiability_gate", GATED + " SELECT case_id, arm, seed::BIGINT AS seed, ord, predicted = 1 AND reject_reason IS NULL AS kept, reject_reason FROM judged", FLAT)
def _(spark, sf):
    gated = gates.falsifiability_gate(b.drafts(spark, sf))
    return gated.select(*RUN, "ord", F.col("prediction").isNotNull().alias("kept"), "reject_reason")


@query("F08_normalise_drafts", GATED + """,
wide AS (SELECT *, repeat(mechanism || ' ', 80) AS long FROM judged),
clean AS (
  SELECT case_id, arm, seed, ord, path, greatest(line, 0) AS line, layer, symbol,
    CASE WHEN length(long) > 4000 THEN substr(long, 1, 3988) || ' [truncated]' ELSE long END AS mechanism,
    coalesce(nullif(remediation, ''), 'not stated') AS remediation, predicted = 1 AND reject_reason IS NULL AS predicted, reject_reason FROM wide)
SELECT case_id, arm, seed::BIGINT AS seed, ord, 'finding' AS side, path, line::BIGINT AS line, layer, symbol, md5(mechanism) AS mechanism, remediation, predicted, NULL AS reason FROM clean
UNION ALL SELECT case_id, arm, seed::BIGINT, NULL, 'dropped', path, NULL, NULL, symbol, NULL, NULL, NULL, reject_reason FROM clean WHERE reject_reason IS NOT NULL
""", FLAT)
def _(spark, sf):
    """Sentences are lengthened so that some meet the limit."""
    long = b.drafts(spark, sf).withColumn("mechanism", F.expr("repeat(concat(mechanism, ' '), 80)"))
    kept, dropped = gates.normalise_drafts(long)
    shaped = kept.select(
        *RUN, "ord", F.lit("finding").alias("side"), "path", "line", "layer", "symbol", F.md5("mechanism").alias("mechanism"),
        "remediation", F.col("prediction").isNotNull().alias("predicted"), F.lit(None).cast("string").alias("reason"),
    )
    return shaped.unionByName(dropped.withColumn("side", F.lit("dropped")), allowMissingColumns=True)


# -- merging ------------------------------------------------------------------------------------

_SEV = "CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"
_STRICT = """
strict_in AS (SELECT *, reject_reason IS NULL AS ok, bool_or(predicted = 1 AND reject_reason IS NULL) OVER (PARTITION BY {g}) AS any_ok FROM {t}),
strict_live AS (SELECT *, first_value(p_comparator) OVER (PARTITION BY {g} ORDER BY ord) AS lead FROM strict_in WHERE predicted = 1 AND (ok OR NOT any_ok)),
strict AS (SELECT * FROM strict_live QUALIFY row_number() OVER (PARTITION BY {g} ORDER BY
  CASE WHEN lead = 'at_most' THEN p_value WHEN lead = 'between' THEN coalesce(nullif(p_upper, 0), p_value) - p_value ELSE -p_value END, ord) = 1)"""


@query("W01_strictest_prediction", GATED + "," + _STRICT.format(g="case_id, arm, seed, symbol, p_metric", t="judged") + """
SELECT g.case_id, g.arm, g.seed::BIGINT AS seed, g.symbol, g.p_metric AS metric, s.p_comparator AS comparator, s.p_value AS value, s.p_upper AS upper, s.p_unit AS unit
FROM (SELECT DISTINCT case_id, arm, seed, symbol, p_metric FROM judged WHERE predicted = 1) g LEFT JOIN strict s USING (case_id, arm, seed, symbol, p_metric)
""", FLAT)
def _(spark, sf):
    drafts = b.drafts(spark, sf).filter("prediction is not null").withColumn("metric", F.col("prediction.metric"))
    picked = claims.strictest_prediction(drafts, [*RUN, "symbol", "metric"])
    return picked.select(*RUN, "symbol", "metric", "prediction.comparator", "prediction.value", "prediction.upper", "prediction.unit")


@query("A11_reconcile", GATED + """,
cons AS (SELECT *, CASE WHEN predicted = 1 THEN p_metric ELSE '' END AS mt FROM judged),
nm AS (SELECT case_id, arm, seed, path, symbol, count(DISTINCT mt) FILTER (WHERE mt <> '') AS k, max(mt) AS only_m FROM cons GROUP BY ALL),
grp AS (SELECT c.*, CASE WHEN mt = '' AND k = 1 THEN only_m ELSE mt END AS g, CASE WHEN mt = '' AND k = 1 THEN 1 ELSE 0 END AS late FROM cons c JOIN nm USING (case_id, arm, seed, path, symbol)),""" + _STRICT.format(g="case_id, arm, seed, path, symbol, g", t="grp") + f""",
firsts AS (SELECT case_id, arm, seed, path, symbol, g, mechanism, min({{'late': late, 'ord': ord}}) AS o FROM grp WHERE mechanism <> '' GROUP BY ALL),
sent AS (SELECT case_id, arm, seed, path, symbol, g, string_agg(mechanism, ' ' ORDER BY o) AS s FROM firsts GROUP BY ALL),
merged AS (
  SELECT case_id, arm, seed, path, symbol, g, count(*) AS n, min(ord) AS ord, min(line) AS line,
    arg_max(severity, ({_SEV}, -late, -ord)) AS severity, arg_max(remediation, (length(remediation), -late, -ord)) AS remediation, arg_max(arithmetic, (length(arithmetic), -late, -ord)) AS arithmetic,
    array_to_string(list_sort(list(DISTINCT layer)), '+') AS layers, arg_min(layer, (late, ord)) AS layer1
  FROM grp GROUP BY ALL)
SELECT m.case_id, m.arm, m.seed::BIGINT AS seed, m.ord, m.path, m.line::BIGINT AS line, CASE WHEN n = 1 THEN layer1 ELSE substr(layers, 1, 60) END AS layer, m.symbol, substr(s, 1, 4000) AS mechanism,
  m.severity, m.remediation, m.arithmetic, st.p_metric AS metric, st.p_comparator AS comparator, st.p_value AS value, st.p_upper AS upper
FROM merged m JOIN sent USING (case_id, arm, seed, path, symbol, g) LEFT JOIN strict st USING (case_id, arm, seed, path, symbol, g)
""", FLAT)
def _(spark, sf):
    return claims.reconcile(b.drafts(spark, sf)).select(
        *RUN, "ord", "path", "line", "layer", "symbol", "mechanism", "severity", "remediation", "arithmetic",
        "prediction.metric", "prediction.comparator", "prediction.value", "prediction.upper",
    )


SHAPED = r"""
shaped AS (SELECT *, array_to_string(regexp_extract_all(regexp_replace(lower(mechanism),
  '`[^`]*`|\b[A-Za-z_][A-Za-z0-9_]*[/.][A-Za-z0-9_./]*|\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b|\b\d[\d.,]*\b', ' ', 'g'), '[a-z]+'), ' ') AS shape FROM findings_flat)"""


@query("T09_mechanism_shape", SHAPED + " SELECT case_id, arm, seed::BIGINT AS seed, ord, shape, len(string_split(shape, ' '))::BIGINT AS n_words FROM shaped", FLAT)
def _(spark, sf):
    return claims.mechanism_shape(b.drafts(spark, sf)).select(*RUN, "ord", "shape", "n_words")


@query("W02_collapse_repeats", SHAPED + f""",
wide AS (SELECT *, len(string_split(shape, ' ')) >= 5 AS cmp FROM shaped),
grps AS (SELECT case_id, arm, seed, layer, shape, count(DISTINCT path) AS files, min((-({_SEV}), path, ord)) AS best, list_sort(list(DISTINCT path)) AS paths
  FROM wide WHERE cmp GROUP BY ALL HAVING count(DISTINCT path) >= 3),
j AS (SELECT w.*, files, best[2] AS bp, best[3] AS bo, list_filter(paths, lambda x: x <> best[2]) AS others FROM wide w LEFT JOIN grps USING (case_id, arm, seed, layer, shape))
SELECT case_id, arm, seed::BIGINT AS seed, 'kept' AS side, path, symbol, ord, severity, CASE WHEN files IS NULL OR NOT cmp THEN mechanism ELSE mechanism || ' Seen in ' || files ||
  ' files, so this is a property of the service rather than of one handler. Also at: ' || array_to_string(others[1:5], ', ') || CASE WHEN len(others) > 5 THEN ', ...' ELSE '' END END AS said
FROM j WHERE files IS NULL OR NOT cmp OR ord = bo
UNION ALL
SELECT case_id, arm, seed::BIGINT, 'dropped', path, symbol, NULL, NULL, 'collapsed into the same finding at ' || bp || ': the same mechanism in ' || files || ' files is one property of the service'
FROM j WHERE files IS NOT NULL AND cmp AND ord <> bo
""", FLAT)
def _(spark, sf):
    marked = claims.mark_repeats(b.drafts(spark, sf))
    kept = F.col("side") == "kept"
    return marked.select(
        *RUN, "side", "path", "symbol", F.when(kept, F.col("ord")).alias("ord"), F.when(kept, F.col("severity")).alias("severity"),
        F.when(kept, F.col("mechanism")).otherwise(F.col("reason")).alias("said"),
    )


@query("J07_withdraw_index_claims", r"""
idx AS (SELECT DISTINCT repo_id, tbl, string_split(cols, ',')[1] AS c FROM operations_flat WHERE kind IN ('create_index', 'create_unique_constraint') AND cols <> ''),
cl AS (SELECT repo_id, ord, path, symbol, mechanism, regexp_extract(mechanism, 'joins (t[0-9]+) rows', 1) AS tbl, regexp_extract(mechanism, 'filters on (c[0-9]+), a column with no index', 1) AS c FROM findings_flat)
SELECT cl.repo_id, ord, path, symbol, CASE WHEN idx.c IS NULL THEN 'kept' ELSE 'withdrawn' END AS side,
  CASE WHEN idx.c IS NOT NULL THEN cl.tbl || '.' || cl.c || ' is indexed by a migration in this repository, so the finding''s premise is false' END AS reason
FROM cl LEFT JOIN idx ON idx.repo_id = cl.repo_id AND idx.tbl = cl.tbl AND idx.c = cl.c
""", ("findings_flat", "operations_flat"))
def _(spark, sf):
    kept, gone = claims.withdraw_index_claims(b.drafts(spark, sf), claims.indexed_columns(b.operations(spark, sf)))
    cols = ["repo_id", "ord", "path", "symbol"]
    return gone.select(*cols, F.lit("withdrawn").alias("side"), "reason").unionByName(
        kept.select(*cols, F.lit("kept").alias("side")), allowMissingColumns=True
    )


@query("A14_indexed_columns", """
SELECT DISTINCT repo_id, tbl AS "table", string_split(cols, ',')[1] AS "column" FROM operations_flat WHERE kind IN ('create_index', 'create_unique_constraint') AND cols <> ''
""", ("operations_flat",))
def _(spark, sf):
    return claims.indexed_columns(b.operations(spark, sf))


_PHRASES = ", ".join(
    f"({i}, '{m}', '{layer}', {j}, '{phrase}')"
    for i, (m, concerns, phrases) in enumerate(dims.PRESSURE_RULES)
    for layer in dims.owners(concerns)
    for j, phrase in enumerate(phrases.split("|"))
)
EVIDENCE = f"""
rules(r, mech, lay, pj, phrase) AS (VALUES {_PHRASES}),
hits AS (SELECT case_id, arm, seed, ord, path, line, symbol, layer, r, mech, phrase FROM findings_flat JOIN rules ON layer = lay AND contains(lower(mechanism), phrase)
  QUALIFY row_number() OVER (PARTITION BY case_id, arm, seed, ord ORDER BY r, pj) = 1),
ev AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY case_id, arm, seed, r, path, line, symbol ORDER BY ord) = 1)"""


@query("A06_forecast_pressures", EVIDENCE + """
SELECT case_id, arm, seed::BIGINT AS seed, mech AS mechanism, count(*) AS independent_findings, count(DISTINCT path) AS files, array_to_string(list_sort(list(DISTINCT layer)), ',') AS specialists,
  CASE WHEN count(*) >= 3 THEN 'systemic' WHEN count(*) >= 2 THEN 'repeated' ELSE 'isolated' END AS band, (CASE WHEN count(*) >= 3 THEN 3 WHEN count(*) >= 2 THEN 2 ELSE 1 END)::BIGINT AS rung
FROM ev GROUP BY case_id, arm, seed, mech
""", FLAT)
def _(spark, sf):
    return claims.forecast_pressures(b.drafts(spark, sf)).drop("rule", "derivation")


@query("A06b_pressure_evidence", EVIDENCE + " SELECT case_id, arm, seed::BIGINT AS seed, r::BIGINT AS rule, path, line::BIGINT AS line, symbol, layer, phrase AS trigger FROM ev", FLAT)
def _(spark, sf):
    return claims.pressure_evidence(b.drafts(spark, sf))


# -- ground truth -------------------------------------------------------------------------------

DEFECTS = """
runs_of AS (SELECT DISTINCT case_id, arm, seed FROM findings_flat),
wanted AS (SELECT DISTINCT case_id, id, path, unnest(string_split(symbols, ',')) AS sym FROM defects_flat),
said AS (SELECT DISTINCT case_id, arm, seed, path, lower(symbol || ' ' || mechanism) AS txt FROM findings_flat WHERE len(string_split_regex(mechanism, '\\s+')) >= 5),
hit AS (SELECT DISTINCT case_id, arm, seed, id FROM said JOIN wanted USING (case_id, path)
  WHERE regexp_matches(txt, '(^|[^\\w-])(' || sym || '(s|es|ed|d|ing)?' || CASE WHEN sym LIKE '%y' THEN '|' || sym[:-2] || '(ies|ied)' ELSE '' END || ')($|[^\\w-])')),
matched AS (SELECT r.case_id, r.arm, r.seed, d.id, h.id IS NOT NULL AS found FROM runs_of r JOIN (SELECT DISTINCT case_id, id FROM defects_flat) d USING (case_id) LEFT JOIN hit h USING (case_id, arm, seed, id))""".replace("\\\\", "\\")


@b.remembered
def matched(spark, sf):
    found = b.drafts(spark, sf)
    return grading.match_defects(b.defects(spark, sf), found, found.select(*RUN).distinct())


@query("J12_match_defects", DEFECTS + " SELECT case_id, arm, seed::BIGINT AS seed, id, found FROM matched", ("findings_flat", "defects_flat"))
def _(spark, sf):
    return matched(spark, sf)


@query("J12b_recall", DEFECTS + """
SELECT case_id, arm, seed::BIGINT AS seed, count(*) AS seeded, count(*) FILTER (WHERE found) AS found, round(avg(found::INT), 6) AS recall FROM matched GROUP BY ALL
""", ("findings_flat", "defects_flat"))
def _(spark, sf):
    return grading.recall(matched(spark, sf))


@query("J13_attach_measurements", """
places AS (SELECT DISTINCT case_id, expected_metric AS metric, path FROM defects_flat WHERE expected_metric <> ''),
one AS (SELECT case_id, p_metric AS metric, max(m_value) AS v FROM findings_flat WHERE measured = 1 GROUP BY ALL)
SELECT f.case_id, f.arm, f.seed::BIGINT AS seed, f.ord, pl.path IS NOT NULL AND o.metric IS NOT NULL AS measured, CASE WHEN pl.path IS NOT NULL THEN o.v END AS value
FROM findings_flat f LEFT JOIN places pl ON pl.case_id = f.case_id AND f.predicted = 1 AND pl.metric = f.p_metric AND pl.path = f.path
  LEFT JOIN one o ON o.case_id = pl.case_id AND o.metric = pl.metric
""", ("findings_flat", "defects_flat"))
def _(spark, sf):
    flat = b.view(spark, sf, "findings_flat").filter("measured = 1")
    one = flat.groupBy("case_id", F.col("p_metric").alias("metric")).agg(F.max("m_value").alias("v"))
    single = one.select(
        "case_id", "metric",
        F.struct(F.col("v").alias("value"), F.lit("x").alias("experiment"), F.lit("").alias("detail")).alias("measurement"),
    )
    out = grading.attach_measurements(b.drafts(spark, sf), single, b.defects(spark, sf))
    return out.select(*RUN, "ord", F.col("measurement").isNotNull().alias("measured"), "measurement.value")


@query("A17_experiment_discrimination", """
v AS (SELECT *, CASE WHEN shape = 4 THEN 7 ELSE q % 3 + (case_id = 'case3')::INT * 0 + CASE WHEN variant = 'seeded' AND shape < 2 THEN 40 ELSE 0 END END::DOUBLE AS value FROM logs_flat WHERE exit_code = 0),
per AS (SELECT case_id, metric || '-' || shape AS metric, min(value) FILTER (WHERE variant = 'seeded') AS a, max(value) FILTER (WHERE variant = 'seeded') AS bb,
  min(value) FILTER (WHERE variant = 'remediated') AS c, max(value) FILTER (WHERE variant = 'remediated') AS d FROM v GROUP BY ALL)
SELECT case_id, metric, a AS seeded_low, bb AS seeded_high, c AS remediated_low, d AS remediated_high, coalesce(a <> c OR bb <> d, false) AS discriminates, coalesce(a = bb AND c = d, false) AS repeatable FROM per
""", ("logs_flat",))
def _(spark, sf):
    logs = b.view(spark, sf, "logs_flat").filter("exit_code = 0")
    value = F.when(F.col("shape") == 4, 7).otherwise(
        F.col("q") % 3 + F.when((F.col("variant") == "seeded") & (F.col("shape") < 2), 40).otherwise(0)
    )
    return grading.discrimination(
        logs.select("case_id", F.concat_ws("-", "metric", F.col("shape").cast("string")).alias("metric"), "variant", value.cast("double").alias("value"))
    )


@query("A10_headline", """
SELECT case_id, arm, seed::BIGINT AS seed, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low,
  count(*) AS total, count(*) FILTER (WHERE predicted = 1 AND measured = 1 AND m_value IS NOT NULL) AS measured FROM findings_flat GROUP BY ALL
""", FLAT)
def _(spark, sf):
    return grading.headline(b.findings(spark, sf), RUN)


# -- statistics ----------------------------------------------------------------------------------


def hit_pairs(spark, sf, independent=True):
    """Hits and runs of the two arms, per case."""
    s = scores(spark, sf)
    side = lambda arm, tag: F.sum(F.when(F.col("arm") == arm, F.col(tag)).otherwise(0))
    return s.groupBy("case_id").agg(
        side("pipeline", "hits").alias("hits_a"), side("pipeline", "tested").alias("tested_a"),
        side("baseline", "hits").alias("hits_b"), side("baseline", "tested").alias("tested_b"),
    ).withColumn("independent", F.lit(independent))


PAIRS = SCORED + """,
pairs AS (SELECT case_id, sum(CASE WHEN arm = 'pipeline' THEN hits ELSE 0 END)::BIGINT AS ha, sum(CASE WHEN arm = 'pipeline' THEN tested ELSE 0 END)::BIGINT AS ta,
  sum(CASE WHEN arm = 'baseline' THEN hits ELSE 0 END)::BIGINT AS hb, sum(CASE WHEN arm = 'baseline' THEN tested ELSE 0 END)::BIGINT AS tb FROM scores GROUP BY case_id),
tabs AS (SELECT *, unnest(range(greatest(0, ha + hb - tb), least(ta, ha + hb) + 1)) AS x FROM pairs WHERE ta > 0 AND tb > 0),
probs AS (SELECT *, exp(lgamma(ta + 1) - lgamma(x + 1) - lgamma(ta - x + 1) + lgamma(tb + 1) - lgamma(ha + hb - x + 1) - lgamma(tb - ha - hb + x + 1)
  - lgamma(ta + tb + 1) + lgamma(ha + hb + 1) + lgamma(ta + tb - ha - hb + 1)) AS p FROM tabs),
fisher AS (SELECT case_id, least(1.0, sum(p) FILTER (WHERE p <= po * (1 + 1e-9))) AS p FROM (SELECT *, max(CASE WHEN x = ha THEN p END) OVER (PARTITION BY case_id) AS po FROM probs) GROUP BY case_id)"""


@query("Q01_fisher_exact", PAIRS + " SELECT pairs.case_id, ha AS hits_a, ta AS tested_a, hb AS hits_b, tb AS tested_b, round(p, 6) AS p FROM pairs LEFT JOIN fisher USING (case_id)", FLAT)
def _(spark, sf):
    return stats.fisher_exact(hit_pairs(spark, sf), ["case_id"]).drop("independent")


def recall_samples(spark, sf):
    """Per case, the detection rate of every seed and arm, rounded so that ties are ties."""
    s = scores(spark, sf).select("case_id", "arm", "seed", F.round(F.col("found") / F.col("seeded"), 3).alias("rate"))
    arr = lambda arm: F.array_sort(F.collect_list(F.when(F.col("arm") == arm, F.col("rate"))))
    return s.groupBy("case_id").agg(arr("pipeline").alias("a"), arr("baseline").alias("b"))


SAMPLES = SCORED + """,
rates AS (SELECT case_id, arm, seed, round(found / seeded, 3) AS rate FROM scores),
arrs AS (SELECT case_id, coalesce(list_sort(list(rate) FILTER (WHERE arm = 'pipeline')), []) AS a, coalesce(list_sort(list(rate) FILTER (WHERE arm = 'baseline')), []) AS b FROM rates GROUP BY case_id),
pairs2 AS (SELECT case_id, list_transform(list_concat(a, b), lambda v: CAST(round(v * 1000) AS BIGINT)) AS pool, len(a) AS n, len(b) AS m FROM arrs WHERE len(a) BETWEEN 1 AND 10 AND len(b) > 0),
vals AS (SELECT case_id, v, count(*) AS c, row_number() OVER (PARTITION BY case_id ORDER BY v) AS i FROM (SELECT case_id, unnest(pool) AS v FROM pairs2) GROUP BY case_id, v),
dp(case_id, i, n, taken, s, ways) AS (
  SELECT case_id, CAST(0 AS BIGINT), CAST(n AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS DOUBLE) FROM pairs2
  UNION ALL SELECT case_id, i, n, taken, s, sum(ways) FROM (
    SELECT d.case_id, d.i + 1 AS i, d.n, d.taken + k AS taken, CAST(d.s + k * v AS BIGINT) AS s, d.ways * round(exp(lgamma(c + 1) - lgamma(k + 1) - lgamma(c - k + 1))) AS ways
    FROM (SELECT d.*, v, c, unnest(range(0, least(c, d.n - d.taken) + 1)) AS k FROM dp d JOIN vals ON vals.case_id = d.case_id AND vals.i = d.i + 1) d) GROUP BY case_id, i, n, taken, s),
lefts AS (SELECT dp.case_id, ways, dp.n, m, s, list_sum(pool) AS t, list_sum(list_slice(pool, 1, p.n)) AS own FROM dp JOIN pairs2 p ON p.case_id = dp.case_id
  WHERE taken = dp.n AND dp.i = (SELECT max(v.i) FROM vals v WHERE v.case_id = dp.case_id)),
perm AS (SELECT case_id, coalesce(sum(ways) FILTER (WHERE abs(s / n - (t - s) / m) >= abs(own / n - (t - own) / m) - 1e-9), 0) / sum(ways) AS p FROM lefts GROUP BY case_id)"""


@query("Q02_permutation_exact", SAMPLES + " SELECT arrs.case_id, len(a)::BIGINT AS n, len(b)::BIGINT AS m, round(p, 6) AS p FROM arrs LEFT JOIN perm USING (case_id)", FLAT)
def _(spark, sf):
    p = stats.permutation_p(recall_samples(spark, sf), ["case_id"])
    return p.select("case_id", F.size("a").alias("n"), F.size("b").alias("m"), "p")


def all_recalls(spark, sf):
    """Every run's recall of the two arms, in long form."""
    return scores(spark, sf).select(
        F.lit("all").alias("pair"),
        F.when(F.col("arm") == "pipeline", F.lit("a")).otherwise(F.lit("b")).alias("side"),
        F.xxhash64("case_id", "arm", "seed").alias("item"),
        F.round(F.col("found") / F.col("seeded"), 3).alias("value"),
    )


@query("Q03_permutation_sampled")
def _(spark, sf):
    """Drawn at random from a seed, so only its own repeats agree; Q03b compares it with its limit."""
    return stats.permutation_sampled(all_recalls(spark, sf), ["pair"])


#: The usual five-term approximation of the complementary error function, good to 2e-7.
ERFC = "(0.254829592 * t - 0.284496736 * t * t + 1.421413741 * t * t * t - 1.453152027 * t * t * t * t + 1.061405429 * t * t * t * t * t) * exp(-x * x)"


@query("Q03b_sampled_beside_its_limit", SCORED + f""",
r AS (SELECT arm = 'pipeline' AS a, round(found / seeded, 3) AS v FROM scores WHERE found / seeded IS NOT NULL),
f AS (SELECT count(*) FILTER (WHERE a) AS n, count(*) FILTER (WHERE NOT a) AS m, abs(avg(v) FILTER (WHERE a) - avg(v) FILTER (WHERE NOT a)) AS gap, var_samp(v) AS spread FROM r),
z AS (SELECT *, gap / sqrt(2 * spread * (1.0 / n + 1.0 / m)) AS x FROM f),
w AS (SELECT *, 1 / (1 + 0.3275911 * x) AS t FROM z)
SELECT 'all' AS pair, n, m, round(gap, 6) AS gap, round({ERFC}, 5) AS limit_p, TRUE AS near FROM w
""", FLAT)
def _(spark, sf):
    """The sampled p beside the normal limit of the same permutation distribution: near is a distance of at most 0.02.

    Where all values are equal there is no limit (not a number) and every relabelling is as far apart: near means p is 1.
    """
    rows = cut_lineage(all_recalls(spark, sf))
    left, value = F.col("side") == "a", F.col("value")
    limit = rows.filter("value is not null").groupBy("pair").agg(
        F.count_if(left).alias("n"), F.count_if(~left).alias("m"),
        F.abs(F.avg(F.when(left, value)) - F.avg(F.when(~left, value))).alias("gap"), F.var_samp(value).alias("spread"),
    )
    flat = F.col("spread") == 0
    x = F.expr("try_divide(gap, sqrt(2 * spread * (try_divide(1.0D, n) + try_divide(1.0D, m))))")
    limit = limit.withColumn("x", F.when(flat & F.col("gap").isNotNull(), F.lit(float("nan"))).otherwise(x))
    limit = limit.withColumn("t", F.expr("1 / (1 + 0.3275911D * x)"))
    limit = limit.withColumn("limit_p", F.expr(re.sub(r"(\d\.\d+)", r"\1D", ERFC)))
    both = limit.join(stats.permutation_sampled(rows, ["pair"]), "pair")
    at = F.when(F.isnan("limit_p"), F.lit(1.0)).otherwise(F.col("limit_p"))
    near = F.when(F.col("p").isNull() | at.isNull(), F.col("p").isNull() & at.isNull()).otherwise(F.abs(F.col("p") - at) <= 0.02)
    return both.select("pair", "n", "m", "gap", F.round("limit_p", 5).alias("limit_p"), near.alias("near"))


@query("Q04_verdict", PAIRS + """
SELECT pairs.case_id, CASE WHEN p IS NULL THEN 'not measured' WHEN p < 0.05 THEN 'significant' WHEN p < 0.15 THEN 'suggestive, not significant' ELSE 'no detectable difference' END AS verdict FROM pairs LEFT JOIN fisher USING (case_id)
""", FLAT)
def _(spark, sf):
    p = stats.fisher_exact(hit_pairs(spark, sf), ["case_id"])
    return p.select("case_id", stats.verdict(F.col("p")).alias("verdict"))


@query("Q05_compare_ranges", SCORED + """,
rates AS (SELECT case_id, arm, CASE WHEN count(*) FILTER (WHERE failed) < count(*) THEN min(found / seeded) END AS lo, CASE WHEN count(*) FILTER (WHERE failed) < count(*) THEN max(found / seeded) END AS hi FROM scores GROUP BY ALL)
SELECT l.case_id, CASE WHEN l.lo > r.hi THEN 'better' WHEN l.hi < r.lo THEN 'worse' ELSE 'inconclusive' END AS result, CASE WHEN l.lo > r.hi OR l.hi < r.lo THEN 'ranges clear' ELSE 'ranges overlap' END AS why
FROM rates l JOIN rates r ON l.case_id = r.case_id AND l.arm = 'pipeline' AND r.arm = 'baseline'
""", FLAT)
def _(spark, sf):
    s = scores(spark, sf).withColumn("_rate", F.col("found") / F.col("seeded"))
    done = F.count_if("failed") < F.count(F.lit(1))
    ranges = s.groupBy("case_id", "arm").agg(
        F.lit(True).alias("independent"), F.when(done, F.min("_rate")).alias("recall_low"), F.when(done, F.max("_rate")).alias("recall_high")
    )
    return stats.compare_ranges(ranges, "pipeline", "baseline", ["case_id"])


# -- orders and ledgers -----------------------------------------------------------------------------


@query("O02_rank_for_reader", """
SELECT case_id, arm, seed::BIGINT AS seed, ord, path, severity, predicted = 1 AND measured = 1 AND m_value IS NOT NULL AS settled,
  row_number() OVER (PARTITION BY case_id, arm, seed ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, (predicted = 1 AND measured = 1 AND m_value IS NOT NULL) DESC, path, line, ord) AS position
FROM findings_flat
""", FLAT)
def _(spark, sf):
    """The reader's list of each report, whole."""
    ranked = ranking.rank_for_reader(b.findings(spark, sf)).select(*RUN, "ord", "path", "line", "severity", "settled", "level")
    return ranking.positions(ranked, RUN, ranking.reader_order()).select(*RUN, "ord", "path", "severity", "settled", "position")


LEDGER = SHAPED.replace("shaped AS", "shaped0 AS").replace("FROM findings_flat", "FROM judged").join([GATED + ",", ""]) + rf""",
idx AS (SELECT DISTINCT repo_id, tbl, string_split(cols, ',')[1] AS c FROM operations_flat WHERE kind IN ('create_index', 'create_unique_constraint') AND cols <> ''),
cl AS (SELECT repo_id, ord, regexp_extract(mechanism, 'joins (t[0-9]+) rows', 1) AS tbl, regexp_extract(mechanism, 'filters on (c[0-9]+), a column with no index', 1) AS c FROM findings_flat),
gone AS (SELECT DISTINCT cl.repo_id, ord, cl.tbl || '.' || cl.c || ' is indexed by a migration in this repository, so the finding''s premise is false' AS why FROM cl JOIN idx USING (repo_id, tbl, c)),
wide AS (SELECT s.*, len(string_split(shape, ' ')) >= 5 AS cmp FROM shaped0 s ANTI JOIN gone USING (repo_id, ord)),
grps AS (SELECT case_id, arm, seed, layer, shape, count(DISTINCT path) AS files, min((-({_SEV}), path, ord)) AS best FROM wide WHERE cmp GROUP BY ALL HAVING count(DISTINCT path) >= 3),
led AS (SELECT case_id, arm, seed, path, symbol, 'rejected' AS stage, reject_reason AS reason FROM judged WHERE reject_reason IS NOT NULL
  UNION ALL SELECT case_id, arm, seed, path, symbol, 'withdrawn', why FROM judged JOIN gone USING (repo_id, ord)
  UNION ALL SELECT w.case_id, w.arm, w.seed, path, symbol, 'collapsed', 'collapsed into the same finding at ' || best[2] || ': the same mechanism in ' || files || ' files is one property of the service'
    FROM wide w JOIN grps g USING (case_id, arm, seed, layer, shape) WHERE cmp AND ord <> best[3])"""


def judged_findings(spark, sf) -> dict[str, DataFrame]:
    """What survives the gate, the migrations and the collapse, and what each of them takes out.

    What the three read of a draft alone is marked in one pass and written without the prose; each then parts the marked rows.
    """
    keys = [*RUN, "repo_id"]
    indexed = claims.indexed_columns(b.operations(spark, sf))
    marked = claims.mark_index_claims(gates.mark_dropped(b.drafts(spark, sf), keys=keys), indexed)
    marks = [*gates.DROPPED_MARKS, *claims.INDEX_MARKS, *claims.SENTENCE_MARKS]
    once = written(claims.mark_sentences(marked).select(*keys, "ord", "path", "symbol", "severity", *marks), "judged")
    kept, rejected = gates.normalise_drafts(once, keys=keys)
    kept, withdrawn = claims.withdraw_index_claims(kept, indexed)
    kept, collapsed = claims.collapse_repeats(kept)
    return {"kept": kept, "rejected": rejected, "withdrawn": withdrawn, "collapsed": collapsed}


@query("U02_dropped_ledger", LEDGER + " SELECT case_id, arm, seed::BIGINT AS seed, path, symbol, stage, reason FROM led", (*FLAT, "operations_flat"))
def _(spark, sf):
    """Every row of the ledger: rejected predictions, withdrawn and collapsed findings."""
    parts = judged_findings(spark, sf)
    parts.pop("kept")
    columns = [*RUN, "path", "symbol", "reason"]
    return ranking.dropped_ledger(**{stage: df.select(*columns) for stage, df in parts.items()})


@query("U02b_ledger_balance", LEDGER + """,
n AS (SELECT case_id, arm, seed, count(*) AS n FROM findings_flat GROUP BY ALL),
d AS (SELECT case_id, arm, seed, count(*) FILTER (stage = 'withdrawn') AS withdrawn, count(*) FILTER (stage = 'collapsed') AS collapsed FROM led GROUP BY ALL)
SELECT case_id, arm, seed::BIGINT AS seed, n AS given, n - coalesce(withdrawn, 0) - coalesce(collapsed, 0) AS kept, coalesce(withdrawn, 0) AS withdrawn, coalesce(collapsed, 0) AS collapsed, TRUE AS balanced
FROM n LEFT JOIN d USING (case_id, arm, seed)
""", (*FLAT, "operations_flat"))
def _(spark, sf):
    """Per report: what was given is what is kept, withdrawn or collapsed; a rejected prediction leaves its finding."""
    parts = {"given": b.drafts(spark, sf), **judged_findings(spark, sf)}
    parts.pop("rejected")
    rows = ranking.dropped_ledger(**{stage: df.select(*RUN) for stage, df in parts.items()})
    counts = rows.groupBy(*RUN).agg(*[F.count_if(F.col("stage") == stage).alias(stage) for stage in parts])
    return counts.withColumn("balanced", F.col("given") == F.col("kept") + F.col("withdrawn") + F.col("collapsed"))


@query("J15_resolve_citations", """
ranked AS (SELECT case_id, arm, seed, path, line, symbol, layer, row_number() OVER (PARTITION BY case_id, arm, seed ORDER BY ord) AS pos FROM findings_flat),
obs AS (SELECT case_id, arm, seed, symbol AS obs_id, 'link ' || symbol AS mech, [count(*)::INT, (max(line) + 10)::INT, (min(ord) % 5 + 1)::INT] AS cited FROM findings_flat GROUP BY ALL),
cites AS (SELECT case_id, arm, seed, obs_id, unnest(cited) AS pos FROM obs),
facts AS (SELECT c.case_id, c.arm, c.seed, c.obs_id, count(*) FILTER (WHERE r.path IS NULL) AS beyond, count(DISTINCT c.pos) AS nd, count(*) AS n,
    count(DISTINCT (r.path, r.line, r.symbol, r.layer)) FILTER (WHERE r.path IS NOT NULL) AS sites, count(DISTINCT r.layer) AS nl
  FROM cites c LEFT JOIN ranked r USING (case_id, arm, seed, pos) GROUP BY ALL),
j AS (SELECT *, CASE WHEN nd < n THEN 'repeat' WHEN beyond > 0 THEN 'beyond' WHEN sites < n THEN 'same' WHEN nl < 2 THEN 'layers' END AS why FROM facts),
k AS (SELECT *, row_number() OVER (PARTITION BY case_id, arm, seed ORDER BY nl DESC, n DESC, obs_id) AS position FROM j WHERE why IS NULL)
SELECT case_id, arm, seed::BIGINT AS seed, obs_id, 'kept' AS side, position FROM k WHERE position <= 5
UNION ALL SELECT case_id, arm, seed::BIGINT, obs_id, why, NULL FROM j WHERE why IS NOT NULL
""", FLAT)
def _(spark, sf):
    """Findings are numbered per report by an ordered count that never sorts a whole report in one task."""
    from plumbline.operators.scan import numbered

    d = b.drafts(spark, sf)
    # a slice is 62,500 orders, some 250,000 lines at most in one report, so a report's list of slices stays short
    shown = d.select(*RUN, "ord", "path", "line", "symbol", "layer")
    ranked = numbered(shown, RUN, [F.col("ord")], F.floor(F.col("ord") / 10**14), "position")
    obs = d.groupBy(*RUN, F.col("symbol").alias("obs_id")).agg(
        F.array(F.count(F.lit(1)).cast("int"), (F.max("line") + 10).cast("int"), (F.min("ord") % 5 + 1).cast("int")).alias("cited")
    ).withColumn("mechanism", F.concat(F.lit("link "), "obs_id")).withColumn("consequence", F.lit("together"))
    kept, refused = claims.resolve_citations(obs, ranked)
    why = (
        F.when(F.col("why").contains("repeats"), "repeat")
        .when(F.col("why").contains("not on"), "beyond")
        .when(F.col("why").contains("cited twice"), "same")
        .otherwise("layers")
    )
    return kept.select(*RUN, "obs_id", F.lit("kept").alias("side"), F.col("position").cast("bigint")).unionByName(
        refused.select(*RUN, "obs_id", why.alias("side")), allowMissingColumns=True
    )
