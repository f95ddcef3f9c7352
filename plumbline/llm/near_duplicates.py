"""Near-duplicate groups: fast similarity sketches, banding, and exact links on whole shingle sets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import pieces_of, row_key, written
from plumbline.llm.components import components
from plumbline.llm.substrings import _MULTIPLIERS, _Codes, window_hashes

#: Bands of a sketch and coordinates of a band: a pair at similarity 0.8 misses every band once in two million times.
BANDS, ROWS = 48, 6
#: Shingles one verifying task takes at most on each side; a larger candidate group is dealt into parts, pair by pair.
PART = 1_000_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_set(text: str | None, words: int, codes: _Codes) -> np.ndarray:
    """The distinct hashed shingles of a text, A-Z lower-cased; a shorter text is one shingle, an empty one has none."""
    seq = (text or "").encode().translate(_LOWER).split()
    if not seq:
        return np.zeros(0, np.uint64)
    coded = np.fromiter(map(codes.__getitem__, seq), np.uint64, len(seq))
    return np.unique(window_hashes(coded, min(words, len(seq)), _MULTIPLIERS[0]))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def similarity_sketch(items: np.ndarray, bins: int) -> np.ndarray:
    """One value for each bin, equal in two sets with the chance of their similarity.

    In round i every item falls into one hashed bin with the value i plus a hashed fraction; a bin keeps its least value.
    After ``bins`` rounds, round ``bins`` + k puts every item into bin k, so every bin fills. Rounds are run in blocks: a later
    one never changes a bin that an earlier one filled.
    """
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(bins, full, np.uint64)
    done, block = 0, max(1, int(1.2 * bins * np.log(bins) / len(items)))
    while done < bins and (out == full).any():
        rounds = np.arange(done, min(bins, done + block), dtype=np.uint64)
        hashed = _mixed(items[None, :] + _mixed(rounds + np.uint64(1))[:, None])
        value = (rounds[:, None] << np.uint64(50)) | (hashed >> np.uint64(14))
        np.minimum.at(out, (hashed % np.uint64(bins)).astype(np.int64).ravel(), value.ravel())
        done += len(rounds)
        block = max(1, block // 2)
    for k in np.flatnonzero(out == full):
        hashed = _mixed(items + _mixed(np.array([bins + k + 1], np.uint64)))
        out[k] = (np.uint64(bins + k) << np.uint64(50)) | (hashed >> np.uint64(14)).min()
    return out


def band_keys(items: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, its number included."""
    sketch = _mixed(similarity_sketch(items, BANDS * ROWS)).reshape(BANDS, ROWS)
    with np.errstate(over="ignore"):
        weights = _mixed(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
        return _mixed((sketch * weights).sum(axis=1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def set_identity(items: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over the set, which together stand for it."""
    with np.errstate(over="ignore"):
        one, two = _mixed(items).sum(dtype=np.uint64), _mixed(items ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def shingle_facts(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Rows (id, n, h, g, bands): size and identity of each set, and the keys of its bands (none for an empty set)."""
    shape = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("n", T.LongType()),
            T.StructField("h", T.LongType()),
            T.StructField("g", T.LongType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches):
        import pyarrow as pa

        for piece in pieces_of(batches, text_col, 8_000_000):
            codes, rows = _Codes(), []
            for text in piece.column(text_col).to_pylist():
                items = shingle_set(text, words, codes)
                rows.append((len(items), *set_identity(items), band_keys(items).tolist() if len(items) else []))
            n, h, g, bands = zip(*rows, strict=True)
            yield from pa.table(
                {
                    "id": piece.column(id_col),
                    "n": pa.array(n, pa.int64()),
                    "h": pa.array(h, pa.int64()),
                    "g": pa.array(g, pa.int64()),
                    "bands": pa.array(bands, pa.list_(pa.int64())),
                }
            ).to_batches()

    return docs.select(id_col, text_col).mapInArrow(run, shape)


def linked_within(ids: list, sets: list[np.ndarray], percent: int) -> list[tuple]:
    """Edges (id, id) of a forest that spans all links among the sets, each confirmed on the whole sets.

    Walks from set to set. Sets not reached yet are indexed by shingle; the index is made anew whenever half of them are
    reached, so that a large group of copies costs few looks at each.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    dense = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    waiting, edges = np.ones(len(sets), bool), []
    left = indexed = 0
    postings = starts = None
    for root in range(len(sets)):
        if not waiting[root]:
            continue
        waiting[root] = False
        todo = [root]
        while todo:
            x = todo.pop()
            left = int(waiting.sum())
            if not left:
                break
            if postings is None or 2 * left < indexed:
                held = waiting[owner]
                order = np.argsort(dense[held], kind="stable")
                postings = owner[held][order]
                starts = np.searchsorted(dense[held][order], np.arange(dense.max() + 2))
                indexed = left
            own = dense[ends[x] - sizes[x] : ends[x]]
            low, count = starts[own], starts[own + 1] - starts[own]
            at = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            both = np.bincount(postings[at], minlength=len(sets))
            hit = np.flatnonzero(waiting & (both > 0) & (100 * both >= percent * (sizes + sizes[x] - both)))
            waiting[hit] = False
            edges += [(ids[x], ids[y]) for y in hit]
            todo += hit.tolist()
    return edges


def near_duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """Rows (id, n_shingles, component_id, kept), one for each row of ``docs``.

    Two documents are linked if their sets of ``words``-word shingles share at least ``percent`` hundredths of all their
    shingles; ``component_id`` is the smallest id that links lead to, and ``kept`` tells that it is the row's own.

    Equal sets are one class from the start, so a thousand copies cost as much as one. Classes that agree in a band are
    candidates; each bucket joins its members to its smallest class only, and the groups that come of this are walked on
    whole sets, which finds every link within them, and with it any pair that met in some bucket. A group of more than
    ``PART`` shingles is dealt into parts and walked for each two parts.

    A null or blank text has an empty set and links to nothing, not even to another one. Repeated rows are equal sets. A
    null id links to nothing and is its own group. Other columns are not read; an empty table gives no rows.
    """
    facts = written(shingle_facts(docs, id_col, text_col, words), "shingle-facts")
    linkable = facts.where("n > 0 and id is not null")
    classes = linkable.groupBy("h", "g").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")
    met = classes.select("rep", F.explode("bands").alias("band"))
    hubs = met.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("m")).where("m > 1").drop("m")
    stars = met.join(hubs, "band").where("rep != hub").select("rep", "hub").distinct()
    groups = components(stars, "rep", "hub")

    sized = groups.join(classes.select(F.col("rep").alias("node"), "n", "h", "g"), "node")
    weight = sized.groupBy("root").agg(F.ceil(F.sum("n") / PART).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: k != part)
    alone = F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high")))
    met_with = F.transform(others, lambda k: F.struct(F.least(k, part).alias("low"), F.greatest(k, part).alias("high")))
    members = (
        sized.join(weight.withColumnRenamed("root", "r"), F.col("root") == F.col("r"))
        .withColumn("meets", F.when(F.col("parts") == 1, alone).otherwise(met_with))
        .select(F.col("node").alias("rep"), "root", "h", "g", F.explode("meets").alias("meet"))
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    candidates = texts.join(members, F.col("id") == F.col("rep")).select("rep", "h", "g", "root", "meet", "text")
    id_type = docs.schema[id_col].dataType
    edge = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)])

    def verify(key, pdf):
        import pandas as pd

        codes, sets = _Codes(), {}
        for rep, h, g, text in zip(pdf["rep"], pdf["h"], pdf["g"], pdf["text"], strict=True):
            items = shingle_set(text, words, codes)
            if set_identity(items) == (h, g):
                sets[h, g] = rep, items
        ids, items = [rep for rep, _ in sets.values()], [s for _, s in sets.values()]
        return pd.DataFrame(linked_within(ids, items, percent) if len(ids) > 1 else [], columns=["a", "b"])

    edges = candidates.groupBy("root", "meet").applyInPandas(verify, edge)
    roots = components(edges, "a", "b").withColumnRenamed("node", "rep")
    known = classes.select("h", "g", "rep").join(roots, "rep", "left").select("h", "g", F.coalesce("root", "rep").alias("root"))
    known = known.withColumnsRenamed({"h": "h1", "g": "g1"})
    same = (F.col("h") == F.col("h1")) & (F.col("g") == F.col("g1")) & (F.col("n") > 0) & F.col("id").isNotNull()
    found = facts.drop("bands").join(known, same, "left")
    component = F.coalesce("root", "id")
    return found.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one document of each group: that with the smallest id, and one row of it.

    Groups are made of (id, text) pairs, so two texts under one id are two documents. A row of a null id is in no group and
    stays, whatever its text; so does one row of each id and text that has no shingle.
    """
    keyed = docs.withColumn("_row_key", row_key(id_col, text_col))
    named = keyed.where(F.col(id_col).isNotNull())
    groups = near_duplicate_groups(named, "_row_key", text_col, words, percent).distinct()
    groups = groups.select(F.col("_row_key").alias("_key"), "n_shingles", "component_id")
    ids = named.select("_row_key", F.col(id_col).alias("_id")).distinct()
    linked = groups.where("n_shingles > 0").join(ids, F.col("_key") == F.col("_row_key"))
    first = linked.groupBy("component_id").agg(F.min(F.struct("_id", "_key")).alias("first")).select(F.col("first._key").alias("_key"))
    kept = written(first.unionByName(groups.where("n_shingles = 0").select("_key")), "kept")
    rows = named.join(kept, F.col("_row_key") == F.col("_key"), "left_semi").dropDuplicates(["_row_key"])
    return rows.unionByName(keyed.where(F.col(id_col).isNull())).drop("_row_key")
