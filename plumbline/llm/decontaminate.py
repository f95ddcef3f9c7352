"""Benchmark items inside documents: SimHash of item-sized windows, a multi-index of Hamming blocks, exact similarity of counts.

Everything is a DataFrame operation: no Python runs on the executors.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import row_key, unused, written

#: Fingerprints of 64 bits in eight blocks; two within RADIUS differ by NEAR bits at most in one block.
BLOCKS, WIDTH, NEAR = 8, 8, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
#: A benchmark of more shingles than this is joined by shuffle; a row takes some 40 bytes.
MOST_BROADCAST = 1_000_000
#: Kept off a bound before it is rounded up, so that a similarity of just the least one is within it.
SLACK = 1e-9


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(hashes: Column, words: int) -> Column:
    """A hash of each run of ``words`` words; none where there are fewer."""
    last = F.size(hashes) - words
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(words)]))


def simhashes(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, print) from rows (keys, words): each bit is the sign of the vote of all words, each as often as it stands."""
    votes = rows.select(*keys, F.explode("words").alias("w")).groupBy(*keys)
    ones = votes.agg(
        F.count("*").alias("votes"), *[F.sum(F.shiftrightunsigned("w", b).bitwiseAND(F.lit(1).cast("bigint"))).alias(f"b{b}") for b in range(64)]
    )
    sign = F.lit(0).cast("bigint")
    for b in range(64):
        one = F.lit(1 << b if b < 63 else -(1 << 63)).cast("bigint")
        sign = sign.bitwiseOR(F.when(F.col(f"b{b}") * 2 > F.col("votes"), one).otherwise(F.lit(0).cast("bigint")))
    return ones.select(*keys, sign.alias("print"))


def blocks_of(fingerprint: Column) -> Column:
    """The blocks of a fingerprint as (block, value)."""
    low = F.lit((1 << WIDTH) - 1).cast("bigint")
    parts = [F.shiftrightunsigned(fingerprint, k * WIDTH).bitwiseAND(low).cast("int") for k in range(BLOCKS)]
    return F.array(*[F.struct(F.lit(k).alias("block"), x.alias("value")) for k, x in enumerate(parts)])


def dense_starts(hits: Column, n: Column, length: Column, words: int, similarity: float) -> Column:
    """Every word at which a window of ``length`` begins that holds enough of ``hits``, in ascending order.

    ``hits`` are the sorted places of a text of ``n`` words whose shingles stand in some item of that length. Two runs of x
    and y shingles are alike only if they share s(x+y)/(1+s) of them, so no window with fewer hits can be. Each stretch of
    that many successive hits names the starts from which it is covered and the stretch before is not.
    """
    own = length - (words - 1)
    there = F.least(n, length) - (words - 1)
    needed = F.ceil((there + own) * similarity / (1 + similarity) - SLACK).cast("int")
    more = F.size(hits) - needed
    at = F.when(more >= 0, F.sequence(F.lit(0), more)).otherwise(F.array().cast("array<int>"))

    def span(i: Column) -> Column:
        fresh = F.when(i > 0, F.get(hits, i - 1) + 1).otherwise(F.lit(0))
        first = F.greatest(F.get(hits, i + needed - 1) - there + 1, fresh, F.lit(0))
        return F.struct(first.alias("first"), F.least(F.get(hits, i), n - F.least(n, length)).alias("last"))

    spans = F.filter(F.transform(at, span), lambda x: x["first"] <= x["last"])
    return F.flatten(F.transform(spans, lambda x: F.sequence(x["first"], x["last"])))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    words: int = 5,
    similarity: float = 0.8,
) -> DataFrame:
    """Rows (id, item, similarity, start): the documents that hold a window of an item's length like that item.

    The similarity of two runs of words is the sum of the smaller counts over the sum of the larger counts of their
    ``words``-word shingles. ``start`` is the word at which the most similar window begins.

    1. Windows of each item length begin at every word from which enough shingles of items of that length are met, in
       whatever order and from whichever items; no window at the similarity has fewer (``dense_starts``).
    2. Distinct windows get a SimHash of their words. The index holds the blocks of every item's SimHash with all changes
       of up to ``NEAR`` bits, so that each item within ``RADIUS`` bits meets the window in one block at least.
    3. Pairs within the radius are compared exactly.

    Steps 1 and 3 lose nothing. In step 2 two runs at the similarity differ by a tenth of their words or less, which turns
    9 of 64 bits on average and more than ``RADIUS`` about five times in a million pairs; words that repeat much within an item
    can make that more.

    Words are lower-cased runs of letters and digits. A null or blank text holds nothing and is never found; an item of fewer
    than ``words`` words is one shingle, found where its words follow each other; a document shorter than an item is one
    window. Each distinct item text is searched by itself: a (document, item) pair has one row, for the best of the texts
    under that item id, and null ids are reported as null. Texts under one id are searched each by itself and give one row
    for the best. Other columns are not read; empty tables give no rows.
    """
    named = benchmark.select(F.col(item_col).alias("item_id"), word_hashes(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    named = named.withColumns({"length": F.size("words"), "item": F.md5(F.array_join("words", " ").cast("binary"))})
    named = written(named.dropDuplicates(["item_id", "item"]), "items")
    every = named.select("item", "length", "words").dropDuplicates(["item"])
    items = every.where(F.col("length") >= words)
    texts = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), word_hashes(F.col(text_col)).alias("words"))

    spots = items.select("length", F.explode(shingles(F.col("words"), words)).alias("shingle")).distinct()
    small = spots.count() + named.count() <= MOST_BROADCAST
    if small:
        spots = F.broadcast(spots)
    met = (
        texts.select("key", F.size("words").alias("n"), F.posexplode(shingles(F.col("words"), words)).alias("at", "shingle"))
        .join(spots, "shingle")
        .groupBy("key", "n", "length")
        .agg(F.sort_array(F.collect_set("at")).alias("hits"))
    )
    starts = dense_starts(F.col("hits"), F.col("n"), F.col("length"), words, similarity)
    windows = met.select("key", "length", starts.alias("starts")).where(F.size("starts") > 0)
    windows = written(windows.withColumnRenamed("key", "window_key"), "windows")

    cut = F.slice(F.col("words"), F.col("start") + 1, F.col("length"))
    seen = texts.join(windows, F.col("key") == F.col("window_key")).select("id", "length", "words", F.explode("starts").alias("start"))
    seen = seen.select("id", "length", "start", cut.alias("words"))
    seen = written(
        seen.withColumns({"k": F.xxhash64("words"), "j": F.xxhash64(F.lit(5), F.col("words"))}), "windows-seen"
    )
    runs = written(seen.select("k", "j", "length", "words").dropDuplicates(["k", "j", "length"]), "runs")

    changes = [sum(1 << b for b in bits) for n in range(NEAR + 1) for bits in combinations(range(WIDTH), n)]
    index = simhashes(items, "item", "length").select("item", "length", F.col("print").alias("item_print"), F.explode(blocks_of(F.col("print"))).alias("x"))
    index = index.select("item", "length", "item_print", "x.*", F.explode(F.array(*map(F.lit, changes))).alias("change"))
    index = index.withColumn("value", F.col("value").bitwiseXOR(F.col("change"))).drop("change")
    probes = simhashes(runs, "k", "j", "length").withColumn("x", F.explode(blocks_of(F.col("print"))))
    probes = probes.select("k", "j", "length", "print", "x.*")
    apart = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    near = probes.join(index, ["length", "block", "value"]).where(apart <= RADIUS).select("k", "j", "item", "length").distinct()

    own = F.col("length") - (words - 1)
    listed = items.select("item", "length", F.explode(shingles(F.col("words"), words)).alias("shingle"))
    listed = written(listed.groupBy("item", "length", "shingle").agg(F.count("*").alias("there")), "listed")
    if small:
        listed = F.broadcast(listed)
    said = near.join(runs, ["k", "j", "length"])
    counts = said.select("k", "j", "length", "item", F.size("words").alias("n"), F.explode(shingles(F.col("words"), words)).alias("shingle"))
    counts = counts.groupBy("k", "j", "length", "item", "n", "shingle").agg(F.count("*").alias("here"))
    common = counts.join(listed, ["item", "length", "shingle"]).groupBy("k", "j", "length", "item", "n")
    both = common.agg(F.sum(F.least("here", "there")).alias("both"))
    total = F.col("n") - (words - 1) + own - F.col("both")
    alike = both.withColumn("similarity", F.col("both") / total).where(F.col("similarity") >= similarity)

    found = seen.select("id", "k", "j", "length", "start").join(alike.drop("n", "both"), ["k", "j", "length"])
    found = found.select("id", "item", "similarity", "start")
    for length in sorted(x.length for x in every.where(F.col("length") < words).select("length").distinct().collect()):
        brief = every.where(F.col("length") == length).select("item", shingles(F.col("words"), length)[0].alias("shingle"))
        said = texts.select("id", F.posexplode(shingles(F.col("words"), length)).alias("start", "shingle"))
        said = said.join(F.broadcast(brief) if small else brief, "shingle").groupBy("id", "item").agg(F.min("start").alias("start"))
        found = found.unionByName(said.select("id", "item", F.lit(1.0).alias("similarity"), "start"))
    names = named.select("item", "item_id")
    found = found.join(F.broadcast(names) if small else names, "item").select("id", "item_id", "similarity", "start")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("best")
    return found.groupBy("id", "item_id").agg(best).select(
        F.col("id").alias(id_col),
        F.col("item_id").alias(item_col),
        F.col("best.similarity").alias("similarity"),
        (-F.col("best.s")).cast("long").alias("start"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` in which no benchmark item is found; each row answers for its own text only."""
    key = unused(docs, "row_key")
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    found = find_leaks(keyed, benchmark, key, text_col).select(key).distinct()
    return keyed.join(found, key, "left_anti").select(*docs.columns)
