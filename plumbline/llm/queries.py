"""The text operators bound to the shared tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    byte_bpe,
    chat,
    decontaminate,
    fill_middle,
    fingerprints,
    language,
    mixing,
    near_duplicates,
    quality,
    secret_scan,
    spelling,
    substrings,
    token_counts,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's sketch against its edited text and the next document."""
    return fingerprints.fingerprint_versions(table(spark, sf_dir, "documents"))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document under the public byte-level vocabulary."""
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query
def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in each document, counted and digested."""
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    kinds = [k for k, _ in secret_scan.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def counted(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(counted, kinds), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole copies of documents drawn towards each source's target."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a window like a benchmark item, with the item and the best similarity."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left once every window of 35 words that stands elsewhere too is taken out."""
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document, learned from the labels outside one fold of five."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learned outside one fold of three."""
    return language.predict_language(table(spark, sf_dir, "documents"))


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by four-word shingle sets of similarity 0.8 or more."""
    return near_duplicates.near_duplicate_groups(table(spark, sf_dir, "documents"), words=4, percent=80)


@query
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a reply tree of one branch, formatted, and read back from the output."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = [(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    rows = given.unionByName(spark.createDataFrame(marked, given.schema))
    return chat.digests(chat.format_trees(chat.replies_in_order(rows, "conv_id", "turn", "role", "text")))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of seven letters or more with the more frequent word each is a variant of."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document rearranged for filling in its middle, digested with the text read back from it."""
    formed = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return formed.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


@query
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document encoded by the public merge ranks and decoded again, both digested."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode_texts(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.digests(encoded, ranks)


ORACLES["op10_chat_formatting"] = r"""
WITH given AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'),
    '([<\[])(\|(?:turn|says|done|im_start|im_end|endoftext|startoftext|eot_id)\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2', 'g') AS body
  FROM given)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(body) + 24) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

ORACLES["op6_substring_dedup"] = r"""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
starts AS (
  SELECT doc_id, unnest(range(1, len(ws) - 33)) AS pos, ws FROM split WHERE len(ws) >= 35),
windows AS (SELECT doc_id, pos, list_slice(ws, pos, pos + 34) AS seq FROM starts),
twice AS (SELECT seq FROM windows GROUP BY seq HAVING count(*) > 1),
hit AS (SELECT w.doc_id, w.pos FROM windows w JOIN twice t ON w.seq = t.seq),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS place FROM hit),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS place, unnest(ws) AS word FROM split WHERE len(ws) > 0),
kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.place) AS kept, count(*) AS n
  FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.place = g.place WHERE g.place IS NULL GROUP BY w.doc_id)
SELECT s.doc_id, len(s.ws) AS n_words, len(s.ws) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM split s LEFT JOIN kept k USING (doc_id)
"""

ORACLES["op9_near_duplicates"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(list_slice(ws, i, i + 3), ' '))) END AS s
  FROM split),
keyed AS (SELECT doc_id, list_sort(s) AS s FROM sets),
classes AS (SELECT min(doc_id) AS id, s, len(s) AS n FROM keyed GROUP BY s),
items AS (SELECT id, n, unnest(s) AS x FROM classes),
pairs AS (SELECT a.id AS a, b.id AS b, a.n + b.n AS n, count(*) AS shared
  FROM items a JOIN items b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2, 3),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 80 * (n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, root) AS (SELECT id, id FROM classes UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.id),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT k.doc_id, CAST(len(k.s) AS BIGINT) AS n_shingles,
  CASE WHEN len(k.s) = 0 THEN k.doc_id ELSE r.root END AS component_id,
  k.doc_id = CASE WHEN len(k.s) = 0 THEN k.doc_id ELSE r.root END AS kept
FROM keyed k JOIN classes c ON c.s = k.s JOIN roots r ON r.id = c.id
"""

ORACLES["op11_spelling_variants"] = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS said
  FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
steps AS (SELECT run, n, flatten(list_transform(regexp_extract_all(hex(encode(said)), '..'),
    lambda b: [CAST('0x' || b AS BIGINT), 0, 0, 0, 0, 0, 0, 0])) AS bits FROM counted),
checked AS (SELECT run, n, xor(4294967295, list_reduce(bits,
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), CAST(4294967295 AS BIGINT))) AS h FROM steps),
cut AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM checked),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words),
holes AS (SELECT DISTINCT word, n, p, substr(word, 1, p - 1) AS before, substr(word, p + 1) AS after FROM places),
shorter AS (SELECT DISTINCT word, n, before || after AS other FROM holes),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM holes a JOIN holes b
    ON a.p = b.p AND a.before = b.before AND a.after = b.after AND a.word <> b.word
  UNION ALL SELECT s.word, s.n, w.word, w.n FROM shorter s JOIN words w ON w.word = s.other
  UNION ALL SELECT w.word, w.n, s.word, s.n FROM shorter s JOIN words w ON w.word = s.other),
sums AS (SELECT word, count(*) AS n_near FROM near GROUP BY word),
best AS (SELECT word, other, other_n FROM near WHERE other_n >= 10 * n
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) = 1),
walk AS (
  SELECT word, word AS here, 0 AS depth FROM words
  UNION ALL SELECT k.word, b.other, k.depth + 1 FROM walk k JOIN best b ON b.word = k.here),
roots AS (SELECT word, arg_max(here, depth) AS root FROM walk GROUP BY word)
SELECT w.word, b.other AS form, r.root, w.n, coalesce(s.n_near, 0) AS n_near, b.other_n AS form_n
FROM words w JOIN roots r USING (word) LEFT JOIN sums s USING (word) LEFT JOIN best b USING (word)
"""

ORACLES["op12_fill_in_middle"] = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
drawn AS (SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a,
    CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
        OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (SELECT doc_id, text, n, form, array_to_string(list_slice(u, 1, least(a, b)), '') AS pre,
    array_to_string(list_slice(u, least(a, b) + 1, greatest(a, b)), '') AS mid,
    array_to_string(list_slice(u, greatest(a, b) + 1, n), '') AS suf FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
