"""Removal of word windows that stand elsewhere too: a count-min sketch picks windows to count, which are counted exactly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import bucketed, words_of, written

#: Fixed values of our own: odd multipliers of the two rolling hashes.
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Sketch cells for each byte of text (a word and its space have about six), and the cells of one block of the sketch.
CELLS_PER_BYTE, BLOCK_BITS = 1, 21


class _Codes(dict):
    """Word to 64-bit code; forgets nothing within a group of documents, which is small."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


def window_hashes(words: np.ndarray, window: int, multiplier: np.uint64) -> np.ndarray:
    """A 64-bit hash of each run of ``window`` word codes: sums of code times power, doubled up in log2 steps."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total, power, span, done, rest = words * multiplier, multiplier, 1, None, window
        offset = 0
        # Runs of 1, 2, 4, ... words; those in the binary form of ``window`` are put end to end.
        while rest:
            if rest & 1:
                part = total[offset : offset + n]
                done = part.copy() if done is None else done * _power(multiplier, span) + part
                offset += span
            rest >>= 1
            if rest:
                total = total[: len(total) - span] * _power(multiplier, span) + total[span:]
                span *= 2
        done ^= done >> np.uint64(29)
        done *= np.uint64(0xBF58476D1CE4E5B9)
        return done ^ (done >> np.uint64(32))


def _power(base: np.uint64, exponent: int) -> np.uint64:
    return np.uint64(pow(int(base), exponent, 1 << 64))


def _hashed(texts: list, window: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, two hashes of every window of all texts end to end, and where each text's windows begin."""
    codes, split, hashes, begins = _Codes(), [], [], [0]
    for text in texts:
        words = words_of(text)
        split.append(words)
        if len(words) >= window:
            seq = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
            hashes.append(np.stack([window_hashes(seq, window, m) for m in _MULTIPLIERS], axis=1))
        begins.append(begins[-1] + max(0, len(words) - window + 1))
    return split, np.concatenate(hashes) if hashes else np.zeros((0, 2), np.uint64), np.array(begins)


def _cells(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """The sketch cell of each window; the sketch has ``blocks`` blocks of 2 ** BLOCK_BITS cells."""
    return ((hashes >> np.uint64(11)) % np.uint64(blocks << BLOCK_BITS)).astype(np.int64)


def _packed(numbers: np.ndarray) -> bytes:
    """Ascending numbers below 2 ** BLOCK_BITS as differences, compressed."""
    import zstandard

    gaps = np.diff(numbers, prepend=0).astype(np.uint32)
    small = np.minimum(gaps, 255).astype(np.uint8)
    return zstandard.compress(np.uint32(len(gaps)).tobytes() + small.tobytes() + gaps[gaps >= 255].tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw[:4], np.uint32)[0])
    gaps = np.frombuffer(raw[4 : 4 + n], np.uint8).astype(np.int64)
    gaps[gaps == 255] = np.frombuffer(raw[4 + n :], np.uint32)
    return np.cumsum(gaps)


def _split_by_block(group: int, places: np.ndarray, blocks: int, row) -> list[tuple]:
    """One row per block that holds any of the ascending places."""
    edges = np.searchsorted(places, np.arange(blocks + 1))
    return [(group, int(b), *row(edges[b], edges[b + 1])) for b in np.flatnonzero(np.diff(edges))]


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def _answered(places: np.ndarray, answers, blocks: int) -> np.ndarray:
    """The blocks' answers put back beside a group's ascending places."""
    edges, out = np.searchsorted(places, np.arange(blocks + 1)), np.zeros(len(places), bool)
    for block, bits in zip(answers["block"], answers["bits"], strict=True):
        out[edges[block] : edges[block + 1]] = _flags(bits, edges[block + 1] - edges[block])
    return out


def _cells_of(hashes: np.ndarray, copies: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A group's distinct cells, whether each counts two or more already, and each window's place in them."""
    cells, place = np.unique(_cells(hashes[:, 0], blocks), return_inverse=True)
    return cells, np.bincount(place, copies, len(cells)) > 1, place


def _candidates_of(hashes: np.ndarray, copies: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows among the hot ones by both hashes, whether each counts two or more, and each hot one's place."""
    own = hashes[hot]
    order = np.lexsort((own[:, 1], own[:, 0]))
    ranked = own[order]
    new = np.ones(len(own), bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    place = np.empty(len(own), np.int64)
    place[order] = np.cumsum(new) - 1
    distinct = ranked[new]
    return distinct, np.bincount(place, copies[hot], len(distinct)) > 1, place


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, group_bytes: int = 6_000_000
) -> DataFrame:
    """Rows (id, n_words, n_removed, kept), one for each row of ``docs``; ``kept`` is the remaining words joined by a space.

    A word goes if a window of ``window`` words over it has the same words as a window that starts anywhere else, in
    any row, as the input stands.

    1. Equal texts become one row with their number. These rows are dealt into groups of about ``group_bytes``. Each group
       counts its own windows and sends the cells they fall in to the sketch's blocks, marked where it counts two or more.
    2. The groups' sketches are added up block by block: a cell is hot if it counts two or more. Equal windows share a cell,
       so a window whose cell is not hot is certain to be single. The sketch has a cell for every byte of text, so it
       grows with the input while a block keeps its size. Each group learns which of its cells are hot.
    3. Windows in hot cells are counted exactly, by two 64-bit hashes of their words, in blocks of the first hash; each group
       learns which of its windows are repeated and takes their words out.

    A null or blank text has no words; texts shorter than a window lose none. Repeated rows repeat their windows and so lose
    them. Null ids keep their own rows; other columns are not read; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(31), text).alias("g")
    )
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    blocks = max(1, -(-size * CELLS_PER_BYTE // (1 << BLOCK_BITS)))
    texts = rows.groupBy("h", "g").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    dealt = bucketed(texts.withColumn("grp", F.pmod("h", F.lit(groups)).cast("long")), "grp", groups, "texts")
    cut = _without_repeats(dealt, window, blocks)
    ids = rows.select("id", F.col("h").alias("h1"), F.col("g").alias("g1"))
    joined = ids.join(cut, (F.col("h1") == F.col("h")) & (F.col("g1") == F.col("g")))
    return joined.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept")


def _without_repeats(dealt: DataFrame, window: int, blocks: int) -> DataFrame:
    width, spread = 1 << BLOCK_BITS, "grp long, block long, "

    def read(pdf):
        split, hashes, begins = _hashed(pdf["text"].tolist(), window)
        return split, hashes, begins, np.repeat(pdf["copies"].to_numpy(np.int64), np.diff(begins))

    def block_of(distinct: np.ndarray) -> np.ndarray:
        """Blocks of the exact count are ranges of the first hash."""
        return ((distinct[:, 0] >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)

    def sketch(key, pdf):
        import pandas as pd

        _, hashes, _, copies = read(pdf)
        cells, many, _ = _cells_of(hashes, copies, blocks)
        rows = _split_by_block(
            key[0],
            cells >> BLOCK_BITS,
            blocks,
            lambda a, b: (_packed(cells[a:b] & (width - 1)), _bits(many[a:b])),
        )
        return pd.DataFrame(rows, columns=["grp", "block", "cells", "many"])

    def merge(key, pdf):
        import pandas as pd

        own = [_unpacked(x) for x in pdf["cells"]]
        seen = np.zeros(width, np.uint8)
        for cells, marks in zip(own, pdf["many"], strict=True):
            seen[cells] = np.minimum(seen[cells] + 1 + _flags(marks, len(cells)), 2)
        return pd.DataFrame({"grp": pdf["grp"], "block": pdf["block"], "bits": [_bits(seen[c] > 1) for c in own], "exact": False})

    answer = spread + "bits binary, exact boolean"
    sketches = dealt.groupBy("grp").applyInPandas(sketch, spread + "cells binary, many binary")
    hot = written(sketches.groupBy("block").applyInPandas(merge, answer), "hot-cells")

    def gather(key, left, right):
        import pandas as pd

        if not len(left):
            return pd.DataFrame([], columns=["grp", "block", "one", "two", "many"])
        _, hashes, _, copies = read(left)
        cells, _, place = _cells_of(hashes, copies, blocks)
        distinct, many, _ = _candidates_of(hashes, copies, _answered(cells >> BLOCK_BITS, right, blocks)[place])
        rows = _split_by_block(
            key[0],
            block_of(distinct),
            blocks,
            lambda a, b: (distinct[a:b, 0].tobytes(), distinct[a:b, 1].astype(np.uint32).tobytes(), _bits(many[a:b])),
        )
        return pd.DataFrame(rows, columns=["grp", "block", "one", "two", "many"])

    def count(key, pdf):
        import pandas as pd

        one = [np.frombuffer(x, np.uint64) for x in pdf["one"]]
        sizes = [len(x) for x in one]
        times = np.concatenate([_flags(m, n) for m, n in zip(pdf["many"], sizes, strict=True)]) + 1
        one, two = np.concatenate(one), np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["two"]])
        order = np.lexsort((two, one))
        new = np.ones(len(one), bool)
        new[1:] = (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)
        run = np.empty(len(one), np.int64)
        run[order] = np.cumsum(new) - 1
        repeated = np.bincount(run, times)[run] > 1
        bits = [_bits(x) for x in np.split(repeated, np.cumsum(sizes)[:-1])]
        return pd.DataFrame({"grp": pdf["grp"], "block": pdf["block"], "bits": bits, "exact": True})

    asked = dealt.groupBy("grp").cogroup(hot.groupBy("grp"))
    asked = asked.applyInPandas(gather, spread + "one binary, two binary, many binary")
    repeats = written(asked.groupBy("block").applyInPandas(count, answer), "repeats")

    def cut(key, left, right):
        import pandas as pd

        columns = ["h", "g", "n_words", "n_removed", "kept"]
        if not len(left):
            return pd.DataFrame([], columns=columns)
        split, hashes, begins, copies = read(left)
        cells, _, place = _cells_of(hashes, copies, blocks)
        hot_ones = _answered(cells >> BLOCK_BITS, right[~right["exact"]], blocks)[place]
        distinct, _, among = _candidates_of(hashes, copies, hot_ones)
        twice = np.zeros(len(hashes), bool)
        twice[hot_ones] = _answered(block_of(distinct), right[right["exact"]], blocks)[among]
        rows = []
        for k, words in enumerate(split):
            kept, starts = words, np.flatnonzero(twice[begins[k] : begins[k + 1]])
            if len(starts):
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, starts, 1)
                np.add.at(depth, starts + window, -1)
                kept = [w for w, d in zip(words, np.cumsum(depth).tolist(), strict=False) if not d]
            rows.append((left["h"].iat[k], left["g"].iat[k], len(words), len(words) - len(kept), b" ".join(kept).decode()))
        return pd.DataFrame(rows, columns=columns)

    both = dealt.groupBy("grp").cogroup(hot.unionByName(repeats).groupBy("grp"))
    return both.applyInPandas(cut, "h long, g long, n_words long, n_removed long, kept string")
