"""Passes over findings: merge, collapse, withdraw, group and connect."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import dims
from plumbline.functions import text as t
from plumbline.operators.gates import severity_rank, with_rejection
from plumbline.operators.scan import spread_join
from plumbline.schemas import RUN
from plumbline.session import cut_lineage, written

SYSTEMIC_FILES = 3
ENOUGH_WORDS = 5
REPEAT_BITS = 1 << 26
MOST_SENT = 100_000  # rows of a table that a broadcast hint is given
MOST_TABLES = 1_000  # tables of one repository that index a column of one name, to be searched row by row


def mechanism_shape(findings: DataFrame) -> DataFrame:
    shape = t.mechanism_shape(F.col("mechanism"))
    return findings.withColumn("shape", shape).withColumn("n_words", t.word_count(F.col("shape")))


# -- merging drafts ---------------------------------------------------------------------------


def strictest(p: Column, order: Column) -> list[Column]:
    """Aggregates that pick the most informative prediction of a group; read with ``strictest_of``.

    Rows come from ``with_rejection``. All are mergeable maxima, so a hot construct is reduced before
    it is shuffled.
    """
    ok = F.col("reject_reason").isNull()
    width = F.coalesce(F.nullif(p["upper"], F.lit(0.0)), p["value"]) - p["value"]
    out = []
    for tag, chosen in (("valid", p.isNotNull() & ok), ("any", p.isNotNull())):
        kept = F.when(chosen, p)
        out += [
            F.min_by(p["comparator"], F.when(chosen, order)).alias(f"_{tag}_first"),
            F.min_by(kept, F.when(chosen, F.struct(p["value"].alias("v"), order.alias("o")))).alias(f"_{tag}_low"),
            F.min_by(kept, F.when(chosen, F.struct((-p["value"]).alias("v"), order.alias("o")))).alias(
                f"_{tag}_high"
            ),
            F.min_by(kept, F.when(chosen, F.struct(width.alias("v"), order.alias("o")))).alias(f"_{tag}_narrow"),
        ]
    return out


STRICTEST_PARTS = [f"_{t}_{k}" for t in ("valid", "any") for k in ("first", "low", "high", "narrow")]


def strictest_of() -> Column:
    def pick(tag: str) -> Column:
        return (
            F.when(F.col(f"_{tag}_first") == "at_most", F.col(f"_{tag}_low"))
            .when(F.col(f"_{tag}_first") == "between", F.col(f"_{tag}_narrow"))
            .otherwise(F.col(f"_{tag}_high"))
        )

    return F.when(F.col("_valid_first").isNotNull(), pick("valid")).otherwise(pick("any"))


def strictest_prediction(drafts: DataFrame, by: Sequence[str]) -> DataFrame:
    """One prediction per group: larger for at_least, smaller for at_most, narrowest for between."""
    return (
        with_rejection(drafts)
        .groupBy(*by)
        .agg(*strictest(F.col("prediction"), F.col("ord")))
        .withColumn("prediction", strictest_of())
        .drop(*STRICTEST_PARTS)
    )


def reconcile(drafts: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """One finding per construct and predicted metric, keeping the strongest part of each draft.

    A construct surely named once passes through where it is read: only a hash of it is shuffled, and the hashes that
    occur again come back as a broadcast bitmap. The rest, written once, is merged; a construct that only shares its
    bit with another is merged with nothing.
    """
    keys = list(keys)
    site = [*keys, "path", "symbol"]
    marked = _with_bit(drafts, repeated_bits(drafts, site), site, "_repeats")
    columns = [*keys, "ord", "path", "line", "layer", "symbol", "mechanism", "severity", "remediation", "arithmetic", "prediction"]
    alone = marked.filter("not _repeats").select(*columns)
    shared = cut_lineage(marked.filter("_repeats").select(*columns, _digest(*site).alias("_site")))
    return alone.unionByName(_merge(shared, keys))


def _place(cols: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(REPEAT_BITS).cast("bigint"))


def _with_bit(df: DataFrame, bits: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """``df`` plus whether the bitmap of ``repeated_bits`` has the bit of its values of ``cols``."""
    marked = df.withColumn("_at", _place(cols)).join(F.broadcast(bits), F.expr("shiftright(_at, 6) = _word"), "left")
    return marked.withColumn(out, F.expr("coalesce(getbit(_bits, cast(_at & 63 AS int)) = 1, false)")).drop("_at", "_word", "_bits")


def repeated_bits(df: DataFrame, cols: Sequence[str], least: int = 2) -> DataFrame:
    """(_word, _bits): a bitmap with the bit of every value of ``cols`` that ``least`` or more rows have; at most a million words.

    A bit that is not set belongs to values of fewer rows each. One that is set may also belong to such a value, so 40 bits
    of the hash do, and less is shuffled.
    """
    hashed = F.xxhash64(*cols).bitwiseAND(F.lit((1 << 40) - 1)).alias("_hash")
    twice = df.groupBy(hashed).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") >= least)
    placed = twice.select(F.pmod("_hash", F.lit(REPEAT_BITS).cast("bigint")).alias("_at"))
    bit = F.expr("shiftleft(1L, cast(_at & 63 AS int))")
    return cut_lineage(placed.groupBy(F.expr("shiftright(_at, 6)").alias("_word")).agg(F.bit_or(bit).alias("_bits")))


def _digest(*cols: str | Column) -> Column:
    """One short key for a list of columns; 128 bits, and sorts on its first bytes."""
    return F.md5(_text_of(*cols))


def _text_of(*cols: str | Column) -> Column:
    named = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.concat_ws("\u001f", *[F.coalesce(c.cast("string"), F.lit("\u001e")) for c in named])


def _merge(drafts: DataFrame, keys: list[str]) -> DataFrame:
    site = ["_site"]
    drafts = drafts.withColumn("_metric", F.coalesce(F.col("prediction.metric"), F.lit("")))
    metrics = (
        drafts.filter("_metric <> ''")
        .groupBy("_site")
        .agg(F.min("_metric").alias("_only"), F.max("_metric").alias("_other"))
        .filter("_only = _other")
        .drop("_other")
    )
    placed = spread_join(drafts, metrics, site, "left").withColumn(
        "_group", F.when(F.col("_metric") == "", F.coalesce("_only", F.lit(""))).otherwise(F.col("_metric"))
    )
    # prose that joins the drafts of the only metric comes after them
    placed = placed.withColumn("_late", ((F.col("_metric") == "") & (F.col("_group") != "")).cast("int"))
    group = [*site, "_group"]
    order = F.struct("_late", "ord")
    latest = (-F.col("_late"), -F.col("ord"))

    def longest(c: str) -> Column:
        return F.max_by(c, F.struct(F.length(F.coalesce(c, F.lit(""))), *latest)).alias(c)

    merged = with_rejection(placed).groupBy(*group).agg(
        F.count(F.lit(1)).alias("_size"),
        *[F.first(c).alias(c) for c in (*keys, "path", "symbol")],
        F.min("ord").alias("ord"),
        F.min("line").alias("line"),
        F.max_by("severity", F.struct(severity_rank(F.col("severity")), *latest)).alias("severity"),
        longest("remediation"),
        longest("arithmetic"),
        F.min_by("mechanism", order).alias("_first_mechanism"),
        F.min_by("layer", order).alias("_first_layer"),
        *strictest(F.col("prediction"), F.col("ord")),
    )
    # Each distinct sentence needs at least two of 4,000 characters, each layer at least one of 60,
    # so these heads are whole for the result and bounded whatever the group holds.
    sentences = _head(
        placed.filter(F.coalesce("mechanism", F.lit("")) != "")
        .groupBy(*group, "mechanism")
        .agg(F.min(order).alias("_o")),
        group,
        F.col("_o"),
        2001,
        "mechanism",
        " ",
        "_sentences",
    )
    layers = _head(
        placed.select(*group, "layer").distinct(), group, F.col("layer"), 61, "layer", "+", "_layers"
    )
    alone = F.col("_size") == 1
    return (
        merged.join(sentences, group, "left")
        .join(layers, group, "left")
        .select(
            *keys,
            "ord",
            "path",
            "line",
            F.when(alone, F.col("_first_layer")).otherwise(F.substring("_layers", 1, 60)).alias("layer"),
            "symbol",
            F.when(alone, F.col("_first_mechanism"))
            .otherwise(F.substring(F.coalesce("_sentences", F.lit("")), 1, 4000))
            .alias("mechanism"),
            "severity",
            "remediation",
            "arithmetic",
            strictest_of().alias("prediction"),
        )
    )


def _head(
    df: DataFrame, group: list[str], order: Column, most: int, col: str, glue: str, out: str
) -> DataFrame:
    """The first ``most`` values of each group, joined in order."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(order))).filter(
        F.col("_r") <= most
    )
    pairs = F.array_sort(F.collect_list(F.struct("_r", F.col(col).alias("v"))))
    return ranked.groupBy(*group).agg(F.array_join(F.transform(pairs, lambda x: x["v"]), glue).alias(out))


# -- collapsing repeats -------------------------------------------------------------------------


SENTENCE_MARKS = ["_same", "_also"]


def mark_sentences(findings: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """``findings`` plus 128 bits for report, layer and what the sentence says, the first half null for too little to compare.

    They are two whole numbers, as these sort and group faster than any text. The second is never null, so that no join filters
    on it: what a filter tests is worked out there once more.
    """
    # bound by a lambda, the words are taken out of a sentence once; named as a column, each use would do it again
    enough = F.transform(
        F.array(t.plain_words(F.col("mechanism"))), lambda said: F.when(F.substring_index(said, " ", ENOUGH_WORDS - 1) != said, said)
    )
    digest = F.md5(F.concat(_text_of(*keys, "layer"), F.lit("\u001f"), F.get(enough, F.lit(0))))
    first, second = (F.conv(F.substring("_digest", at, 16), 16, -10).cast("bigint") for at in (1, 17))
    marks = [first.alias("_same"), F.coalesce(second, F.lit(0).cast("bigint")).alias("_also")]
    return findings.withColumn("_digest", digest).select(*findings.columns, *marks)


def _orders(col: Column) -> list[Column]:
    """The order of a row under its severity, a column each: whole numbers only, so their minimum is a hash aggregate."""
    level = severity_rank(F.col("severity"))
    return [F.when(level == n, col).alias(f"_o{n}") for n in (2, 1, 0)]


def _best_of_files(orders: DataFrame) -> DataFrame:
    """(_same, _also, path, _best) of the earliest orders of each sentence in each file."""
    return orders.select(
        *SENTENCE_MARKS,
        "path",
        F.struct(
            F.when(F.col("_o2").isNotNull(), -2).when(F.col("_o1").isNotNull(), -1).otherwise(0).alias("s"),
            F.col("path").alias("p"),
            F.coalesce("_o2", "_o1", "_o0").alias("o"),
        ).alias("_best"),
    )


def _first_paths(per_file: DataFrame) -> DataFrame:
    """Seven earliest paths are enough to name five others and to know there are more."""
    order = Window.partitionBy(*SENTENCE_MARKS).orderBy("path")
    return (
        per_file.withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= 7)
        .groupBy(*SENTENCE_MARKS)
        .agg(F.array_sort(F.collect_list(F.struct("path", "_best"))).alias("_paths"))
    )


def _systemic(per_file: DataFrame) -> DataFrame:
    return (
        per_file.groupBy(*SENTENCE_MARKS)
        .agg(F.count(F.lit(1)).alias("_files"), F.min("_best").alias("_best"))
        .filter(F.col("_files") >= SYSTEMIC_FILES)
    )


def mark_repeats(findings: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """``findings`` with ``side`` (kept or dropped) and ``reason``, survivors naming where else they were seen.

    One sentence about three or more files becomes one finding: the worst, earliest one.
    """
    shaped = mark_sentences(findings, keys)
    # null for too little to compare joins nothing; both branches read the same columns of per_file, so its shuffle is written
    # once and read twice
    per_file = _best_of_files(_earliest(shaped))
    systemic = _systemic(per_file).join(_first_paths(per_file), SENTENCE_MARKS)
    return _told(spread_join(shaped, systemic, SENTENCE_MARKS, "left", by=["ord", "path"]), findings.columns)


def _told(joined: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns``, ``side`` and ``reason`` of findings beside what is known of their sentence, if it is systemic."""
    merged = F.col("_files").isNotNull()
    survivor = merged & (F.col("ord") == F.col("_best.o"))
    files = F.col("_files").cast("string")
    reason = F.concat(
        F.lit("collapsed into the same finding at "),
        F.col("_best.p"),
        F.lit(": the same mechanism in "),
        files,
        F.lit(" files is one property of the service"),
    )
    dropped = merged & ~survivor
    sided = joined.withColumn("side", F.when(dropped, F.lit("dropped")).otherwise(F.lit("kept"))).withColumn(
        "reason", F.when(dropped, reason)
    )
    if "mechanism" not in columns:
        return sided.select(*columns, "side", "reason")
    others = F.filter(F.transform("_paths", lambda x: x["path"]), lambda p: p != F.col("_best.p"))
    shown = F.concat(
        F.array_join(F.slice(others, 1, 5), ", "),
        F.when(F.col("_files") - 1 > 5, F.lit(", ...")).otherwise(F.lit("")),
    )
    seen = F.concat(
        F.col("mechanism"),
        F.lit(" Seen in "),
        files,
        F.lit(" files, so this is a property of the service rather than of one handler. Also at: "),
        shown,
    )
    return sided.withColumn("mechanism", F.when(survivor, seen).otherwise(F.col("mechanism"))).select(*columns, "side", "reason")


def collapse_repeats(findings: DataFrame, keys: Sequence[str] = RUN) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of ``mark_repeats``, where both are read and the rows are many.

    Rows that ``mark_sentences`` has not marked are marked and written once. Bitmaps then tell which sentences have rows
    enough and which of those come again in one file: the others are counted where they are read, and no row is shuffled
    but to sum up a sentence. Findings without ``mechanism`` are kept without a word on where else they were seen.
    """
    shaped = findings if "_same" in findings.columns else written(mark_sentences(findings, keys), "sentences")
    columns = [c for c in shaped.columns if c not in SENTENCE_MARKS]
    enough = repeated_bits(shaped.filter("_same is not null"), SENTENCE_MARKS, SYSTEMIC_FILES)
    parted = _with_bit(shaped, enough, SENTENCE_MARKS, "_enough").withColumn("_enough", F.expr("_enough and _same is not null"))
    several = parted.filter("_enough").drop("_enough")
    per_file = _best_of_files(_file_orders(several))
    systemic = written(_systemic(per_file), "systemic")
    few = systemic.count() <= MOST_SENT

    def beside(known: DataFrame, how: str) -> DataFrame:
        if few:
            return several.join(F.broadcast(known), SENTENCE_MARKS, how)
        return spread_join(several, known, SENTENCE_MARKS, how, by=["ord", "path"])

    dropped = _told(beside(systemic, "inner"), [*keys, "path", "symbol"]).filter("side = 'dropped'").drop("side")
    known = systemic.join(_first_paths(per_file), SENTENCE_MARKS) if "mechanism" in columns else systemic
    kept = _told(beside(known, "left"), columns).filter("side = 'kept'").drop("side", "reason")
    return parted.filter("not _enough").select(*columns).unionByName(kept), dropped


def _file_orders(told: DataFrame) -> DataFrame:
    """The earliest orders of each sentence in each file; a row that is surely alone there is one as it stands."""
    site = [*SENTENCE_MARKS, "path"]
    parted = _with_bit(told, repeated_bits(told, site), site, "_again")
    alone = parted.filter("not _again").select(*site, *_orders(F.col("ord")))
    return alone.unionByName(_earliest(parted.filter("_again")))


def _earliest(told: DataFrame) -> DataFrame:
    site = [*SENTENCE_MARKS, "path"]
    return told.select(*site, *_orders(F.col("ord"))).groupBy(*site).agg(*[F.min(f"_o{n}").alias(f"_o{n}") for n in (2, 1, 0)])


# -- claims the repository answers -----------------------------------------------------------------


def indexed_columns(operations: DataFrame) -> DataFrame:
    """Distinct (repo_id, table, column) an index or unique constraint leads with."""
    return (
        operations.filter(
            F.col("kind").isin("create_index", "create_unique_constraint") & (F.size("columns") > 0)
        )
        .select("repo_id", "table", F.col("columns")[0].alias("column"))
        .distinct()
    )


INDEX_MARKS = ["_table", "_column"]


def _claim() -> Column:
    """(column, words) of a sentence that claims a missing index on a column: null for any other."""
    # an offset is not at hand in SQL regex, so the clause before the first claim is matched directly
    before = F.regexp_extract("mechanism", r"(?is)^(.*?)" + dims.NO_INDEX_CLAIM.replace("(?i)", ""), 1)
    words = F.transform(
        F.regexp_extract_all(before, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), 1), lambda w: F.lower(w)
    )
    real = F.filter(words, lambda w: ~w.isin(*dims.NOT_A_COLUMN))
    named = F.transform(F.regexp_extract_all("mechanism", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), 1), lambda w: F.lower(w))
    said = F.struct(F.try_element_at(real, F.lit(-1)).alias("column"), F.array_distinct(named).alias("words"))
    # few sentences name an index at all, and only those are worth a pattern
    return F.when(F.contains(F.lower("mechanism"), F.lit("index")) & F.col("mechanism").rlike(dims.NO_INDEX_CLAIM), said)


def _settled(findings: DataFrame, indexed: DataFrame) -> DataFrame:
    """(repo_id, ord, _table, _column) of the claims that an index answers. Only claiming sentences are exploded into words."""
    claims = findings.select("repo_id", "ord", _claim().alias("_claim")).filter("_claim.column is not null")
    named = claims.select("repo_id", "ord", "_claim.column", F.explode("_claim.words").alias("table"))
    met = spread_join(named, indexed, ["repo_id", "table", "column"])
    return _first_answer(met.withColumnsRenamed({"table": "_table", "column": "_column"}))


def _first_answer(answers: DataFrame) -> DataFrame:
    first = answers.groupBy("repo_id", "ord").agg(F.min(F.struct(*INDEX_MARKS)).alias("_first"))
    return first.select("repo_id", "ord", *[f"_first.{c}" for c in INDEX_MARKS])


def mark_index_claims(findings: DataFrame, indexed: DataFrame) -> DataFrame:
    """``findings`` plus (_table, _column) of the index that answers a row's own claim; a null ``_table`` where none does.

    Up to MOST_SENT indexed columns are sent to where the sentences are read, as one list of tables for each name of a column.
    """
    indexed = written(indexed, "indexed")
    lists = indexed.groupBy("repo_id", "column").agg(F.count(F.lit(1)).alias("n"))
    total, longest = lists.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if total > MOST_SENT or longest > MOST_TABLES:
        return findings.join(_settled(findings, indexed), ["repo_id", "ord"], "left").select(*findings.columns, *INDEX_MARKS)
    known = indexed.groupBy(F.col("repo_id").alias("_repo"), F.col("column").alias("_of")).agg(F.collect_set("table").alias("_tables"))
    claiming = findings.withColumn("_claim", _claim())
    answered = claiming.join(F.broadcast(known), (claiming["repo_id"] == known["_repo"]) & (F.col("_claim.column") == known["_of"]), "left")
    table = F.when(F.col("ord").isNotNull(), F.array_min(F.array_intersect("_claim.words", "_tables")))
    return answered.select(*findings.columns, table.alias("_table"), F.col("_claim.column").alias("_column"))


def _settled_together(marked: DataFrame) -> DataFrame:
    """Rows of ``mark_index_claims`` where those of one (repo_id, ord) share the claim that was answered.

    Only rows that may share their key with an answered claim are looked through for keys that come again, and only those meet
    others of their key; a row surely alone keeps its own mark.
    """
    key = ["repo_id", "ord"]
    answered = repeated_bits(marked.filter("_table is not null"), key, least=1)
    near = _with_bit(marked, answered, key, "_near").filter("_near")
    parted = _with_bit(marked, repeated_bits(near, key), key, "_again")
    again = written(parted.filter("_again").drop("_again"), "claims")
    met = again.drop(*INDEX_MARKS).join(_first_answer(again.filter("_table is not null")), key, "left")
    return parted.filter("not _again").drop("_again").unionByName(met)


def withdraw_index_claims(findings: DataFrame, indexed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, withdrawn): claims of a missing index on a column the migrations index.

    Rows are identified by (repo_id, ord). Rows of ``mark_index_claims`` are not read for their sentences again.
    """
    columns = [c for c in findings.columns if c not in INDEX_MARKS]
    if set(INDEX_MARKS) <= set(findings.columns):
        marked = _settled_together(findings)
    else:
        marked = findings.join(_settled(findings, indexed), ["repo_id", "ord"], "left")
    kept = marked.filter(F.col("_table").isNull()).select(*columns)
    withdrawn = marked.filter(F.col("_table").isNotNull()).select(
        *[c for c in columns if c not in SENTENCE_MARKS],
        F.concat(
            F.col("_table"),
            F.lit("."),
            F.col("_column"),
            F.lit(" is indexed by a migration in this repository, so the finding's premise is false"),
        ).alias("reason"),
    )
    return kept, withdrawn


def split_symbol(symbol: Column) -> tuple[Column, Column]:
    """(qualifier, name) of ``A.b``, ``pkg::thing`` or a call spelling."""
    cleaned = F.trim(F.element_at(F.split(F.replace(F.trim(symbol), F.lit("::"), F.lit(".")), r"\("), 1))
    name = F.trim(F.element_at(F.split(cleaned, r"\."), -1))
    parts = F.split(cleaned, r"\.")
    qualifier = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(""))
    return qualifier, name


def locate_symbols(findings: DataFrame, definitions: DataFrame) -> DataFrame:
    """Distinct (repo_id, path, symbol, located): the defining line, only where it is unambiguous."""
    qualifier, name = split_symbol(F.col("symbol"))
    asked = (
        findings.select("repo_id", "path", "symbol")
        .distinct()
        .withColumn("_scope", qualifier)
        .withColumn("name", name)
        .filter(F.col("name") != "")
    )
    per_name = definitions.groupBy("repo_id", "path", "name").agg(
        F.count_distinct("line").alias("_lines"), F.min("line").alias("_line")
    )
    per_scope = definitions.groupBy("repo_id", "path", "name", F.col("scope").alias("_scope")).agg(
        F.count(F.lit(1)).alias("_hits"), F.min("line").alias("_scoped")
    )
    located = F.when(
        F.col("_scope") != "", F.when(F.col("_hits") == 1, F.col("_scoped"))
    ).otherwise(F.when(F.col("_lines") == 1, F.col("_line")))
    return (
        asked.join(per_name, ["repo_id", "path", "name"], "left")
        .join(per_scope, ["repo_id", "path", "name", "_scope"], "left")
        .select("repo_id", "path", "symbol", located.alias("located"))
        .filter(F.col("located").isNotNull())
    )


# -- pressures ---------------------------------------------------------------------------------------


def _pressure_rule(layer: Column, said: Column) -> Column:
    """Number of the first rule that accepts a sentence of a layer, as one chain of pattern tests."""
    chain = None
    for i, (_, concerns, phrases) in enumerate(dims.PRESSURE_RULES):
        any_phrase = "|".join(re.escape(p) for p in phrases.split("|"))
        test = layer.isin(*dims.owners(concerns)) & said.rlike(any_phrase)
        chain = F.when(test, i) if chain is None else chain.when(test, i)
    return chain


def pressure_evidence(findings: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """One row per (keys, rule, site): the first finding there that some rule accepts.

    The rules are literals inside the row, so nothing is joined or multiplied.
    """
    keys = list(keys)
    phrases = F.array(*[F.array(*[F.lit(p) for p in ps.split("|")]) for _, _, ps in dims.PRESSURE_RULES])
    trigger = F.try_element_at(
        F.filter(F.element_at(phrases, F.col("rule") + 1), lambda p: F.contains(F.lower("mechanism"), p)), F.lit(1)
    )
    return (
        findings.withColumn("rule", _pressure_rule(F.lower(F.trim("layer")), F.lower("mechanism")))
        .filter("rule is not null")
        .groupBy(*keys, "rule", "path", "line", "symbol")
        .agg(F.min_by(F.struct("layer", "mechanism"), "ord").alias("_e"))
        .select(*keys, "rule", "path", "line", "symbol", "_e.layer", "_e.mechanism")
        .withColumn("trigger", trigger)
        .drop("mechanism")
    )


def _listed(items: Column, conjunction: str) -> Column:
    n = F.size(items)
    return F.when(n < 2, F.array_join(items, "")).otherwise(
        F.concat(
            F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(f" {conjunction} "), F.element_at(items, -1)
        )
    )


def forecast_pressures(findings: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Mechanisms under pressure, with counts, band and how the number came about."""
    keys = list(keys)
    evidence = pressure_evidence(findings, keys)
    per_file = evidence.groupBy(*keys, "rule", "path").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("layer").alias("layers")
    )
    grouped = per_file.groupBy(*keys, "rule").agg(
        F.sum("n").alias("independent_findings"),
        F.count(F.lit(1)).alias("files"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("layers")))).alias("specialists"),
    )
    n = F.col("independent_findings")
    rung = F.when(n >= SYSTEMIC_FILES, 3).when(n >= 2, 2).otherwise(1)
    names = F.array(*[F.lit(m) for m, _, _ in dims.PRESSURE_RULES])
    statements = F.array(
        *[
            F.lit(
                f"a {dims.listed(dims.owners(c), 'or')} specialist named one of: {', '.join(p.split('|'))}"
            )
            for _, c, p in dims.PRESSURE_RULES
        ]
    )

    def counted(k: Column, noun: str) -> Column:
        return F.concat(k.cast("string"), F.lit(f" {noun}"), F.when(k == 1, F.lit("")).otherwise(F.lit("s")))

    derivation = F.concat(
        counted(n, "finding"),
        F.lit(" from the "),
        _listed(F.col("specialists"), "and"),
        F.when(F.size("specialists") == 1, F.lit(" specialist")).otherwise(F.lit(" specialists")),
        F.lit(" across "),
        counted(F.col("files"), "file"),
        F.lit(", counted; an ordinal reading, not a measurement"),
    )
    return grouped.select(
        *keys,
        F.element_at(names, F.col("rule") + 1).alias("mechanism"),
        n,
        "files",
        "specialists",
        F.element_at(F.array(F.lit("isolated"), F.lit("repeated"), F.lit("systemic")), rung).alias("band"),
        rung.alias("rung"),
        F.element_at(statements, F.col("rule") + 1).alias("rule"),
        derivation.alias("derivation"),
    )


def pressure_order() -> list[Column]:
    return [F.desc("independent_findings"), F.desc(F.size("specialists")), F.asc("mechanism")]


# -- observations over several findings -------------------------------------------------------------------

MOST_OBSERVATIONS = 5


def resolve_citations(
    observations: DataFrame, ranked: DataFrame, keys: Sequence[str] = RUN
) -> tuple[DataFrame, DataFrame]:
    """(kept, refused). ``observations``: keys, obs_id, mechanism, consequence, cited array<int>.

    ``ranked``: keys, position (1..n among citable findings), path, line, symbol, layer.
    """
    keys = list(keys)
    row = [*keys, "obs_id"]
    listed = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_listed"))
    cites = observations.select(*row, F.explode_outer("cited").alias("position")).filter("position is not null")
    asked = cites.distinct()
    # the list is long and few of its positions are cited: only those are repeated over the salts
    named = ranked.select(*keys, "position", "path", "line", "symbol", "layer").join(
        asked.select(*keys, "position"), [*keys, "position"], "left_semi"
    )
    found = spread_join(asked, named, [*keys, "position"], "left")
    facts = found.groupBy(*row).agg(
        F.count("path").alias("_found"),
        # citations of one observation: what one answer names, not what the table holds
        F.array_sort(F.collect_set(F.when(F.col("path").isNull(), F.col("position")))).alias("_beyond"),
        F.count_distinct("path", "line", "symbol", "layer").alias("_sites"),
        F.array_sort(F.collect_set("layer")).alias("specialists"),
    )
    joined = (
        observations.join(facts, row, "left")
        .join(listed, keys, "left")
        .withColumn("_listed", F.coalesce("_listed", F.lit(0)))
    )
    numbers = F.array_join(F.col("cited").cast("array<string>"), ", ")
    beyond = F.array_join(F.col("_beyond").cast("array<string>"), ", ")
    why = (
        F.when(
            F.size(F.array_distinct("cited")) != F.size("cited"),
            F.concat(F.lit("cited ["), numbers, F.lit("], in which a finding repeats")),
        )
        .when(
            F.size("_beyond") > 0,
            F.concat(
                F.lit("cited ["),
                beyond,
                F.lit("], which "),
                F.when(F.size("_beyond") == 1, F.lit("is")).otherwise(F.lit("are")),
                F.lit(" not on the list of "),
                F.col("_listed").cast("string"),
                F.lit(" findings it was given"),
            ),
        )
        .when(F.coalesce("_found", F.lit(0)) < 2, F.lit("an observation needs at least two findings"))
        .when(F.col("_sites") < F.col("_found"), F.lit("one finding cited twice is one finding"))
        .when(F.size("specialists") < 2, F.lit("an observation needs at least 2 different specialists"))
    )
    judged = joined.withColumn("why", why)
    refused = judged.filter(F.col("why").isNotNull()).select(
        *row, t.fits(t.blank_to(F.col("mechanism"), "(nothing stated)"), 200).alias("said"), "why"
    )
    order = Window.partitionBy(*keys).orderBy(
        F.desc(F.size("specialists")), F.desc("_found"), "mechanism", "obs_id"
    )
    kept = (
        judged.filter(F.col("why").isNull())
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= MOST_OBSERVATIONS)
        .select(
            *row,
            "position",
            t.fits(F.col("mechanism"), 4000).alias("mechanism"),
            t.fits(F.col("consequence"), 4000).alias("consequence"),
            F.col("_found").alias("citations"),
            "specialists",
        )
    )
    return kept, refused
