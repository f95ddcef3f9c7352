"""Byte-level BPE: texts to ids by pre-tokenising overlapping chunks that are stitched, and ids back to bytes."""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import pieces_of, written

#: A boundary so near to the end of a chunk may move when more text follows: a contraction is three characters long.
UNSURE = 3


def _classes() -> tuple[str, str, str]:
    """Letters, numbers and white space as the library's own pattern engine has them, each as ranges of a bracket class."""
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
    found = []
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        probe = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        codes = [ord(c) for c in bytes(probe.encode_ordinary(every)).decode()]  # only what the pattern matches comes back
        ranges, first = [], codes[0]
        for code, following in zip(codes, [*codes[1:], None], strict=True):
            if following != code + 1:
                ranges.append(f"\\U{first:08x}-\\U{code:08x}")
                first = following
        found.append("".join(ranges))
    return tuple(found)


@lru_cache(maxsize=1)
def cutter(pattern: str):
    """A function from a text to the list of its pre-tokens, once in a Python worker.

    The library's classes are spelled out for Python's own engine, whose tables are of another Unicode version; an ASCII
    text meets only the ASCII part of them.
    """
    import re

    def spelled(letters: str, numbers: str, spaces: str):
        inside = {"\\p{L}": letters, "\\p{N}": numbers, "\\s": spaces}
        out, depth, k = [], 0, 0
        while k < len(pattern):
            token = next((c for c in (*inside, "\\S") if pattern.startswith(c, k)), pattern[k])
            depth += (token == "[") - (token == "]")
            if token == "\\S":
                out.append(f"[^{spaces}]")
            else:
                out.append(inside.get(token, token) if depth or token not in inside else f"[{inside[token]}]")
            k += len(token)
        return re.compile("".join(out))

    ascii_only, full = spelled("A-Za-z", "0-9", "\\t-\\r "), spelled(*_classes())
    return lambda text: (ascii_only if text.isascii() else full).findall(text)


@lru_cache(maxsize=1)
def read_ranks(lines: bytes) -> dict[bytes, int]:
    """The merge ranks of a rank file: lines of a piece in base 64 and its rank."""
    return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines.splitlines() if line)}


@lru_cache(maxsize=1)
def _encoder(lines: bytes, most_held: int = 50_000_000):
    """A function from pre-tokens to their ids, joined; ids of pre-tokens are kept until these hold about ``most_held`` bytes."""
    from itertools import chain

    import numpy as np
    import tiktoken

    whole = tiktoken.Encoding("whole", pat_str="(?s:.+)", mergeable_ranks=read_ranks(lines), special_tokens={})
    known: dict[str, list[int]] = {}
    held = 0

    def encode(pieces: list[str]):
        nonlocal held
        out = []
        for k in range(0, len(pieces), 100_000):
            some = pieces[k : k + 100_000]
            if held > most_held:
                known.clear()
                held = 0
            for piece in set(some).difference(known):
                ids = known[piece] = whole.encode_ordinary(piece)
                held += 200 + len(piece) + 8 * len(ids)
            out.append(np.fromiter(chain.from_iterable(map(known.__getitem__, some)), "i4"))
        return np.concatenate(out) if out else np.zeros(0, "i4")

    return encode


def _lists(rows: list, kind):
    """Arrow lists of 32-bit numbers from arrays or lists of numbers."""
    import numpy as np
    import pyarrow as pa

    sizes = np.fromiter((len(x) for x in rows), "i8", len(rows))
    flat = np.concatenate([np.asarray(x, "i4") for x in rows]) if rows else np.zeros(0, "i4")
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()), type=kind)


IDS = T.ArrayType(T.IntegerType(), False)


def chunks_of(docs: DataFrame, id_col: str, text_col: str, chunk_chars: int, overlap: int) -> DataFrame:
    """Rows (row, id, k, start, last, text): chunks that begin ``chunk_chars`` apart and share ``overlap`` with the next."""
    shape = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("k", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("last", T.BooleanType()),
            T.StructField("text", T.StringType()),
        ]
    )

    def run(batches):
        import pyarrow as pa

        for piece in pieces_of(batches, "text", 4_000_000):
            columns = (piece.column(c) for c in ("row", "id", "text"))
            for row, key, text in zip(*columns, strict=True):
                row, text = row.as_py(), text.as_py() or ""
                starts = range(0, max(1, len(text) - overlap), chunk_chars)
                for held in (starts[i : i + 64] for i in range(0, len(starts), 64)):
                    n = len(held)
                    first = held[0] // chunk_chars
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row] * n, pa.int64()),
                            pa.array([key.as_py()] * n, piece.schema.field("id").type),
                            pa.array(range(first, first + n), pa.int32()),
                            pa.array(held, pa.int64()),
                            pa.array([s == starts[-1] for s in held], pa.bool_()),
                            pa.array([text[s : s + chunk_chars + overlap] for s in held], pa.string()),
                        ],
                        names=shape.names,
                    )

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return numbered.mapInArrow(run, shape)


def with_ends(chunks: DataFrame, pattern: str) -> DataFrame:
    """Each chunk with its size and the places (within it) where its own pre-tokens end, but for those that more text could move."""
    shape = T.StructType([*chunks.schema.fields, T.StructField("size", T.IntegerType()), T.StructField("ends", IDS)])

    def run(batches):
        from itertools import accumulate

        import pyarrow as pa

        cut = cutter(pattern)
        for piece in pieces_of(batches, "text", 4_000_000):
            found, texts = [], piece.column("text").to_pylist()
            for text, last in zip(texts, piece.column("last").to_pylist(), strict=True):
                sure = len(text) if last else len(text) - UNSURE
                found.append([e for e in accumulate(map(len, cut(text))) if e <= sure])
            sized = piece.append_column("size", pa.array(map(len, texts), pa.int32()))
            yield from sized.append_column("ends", _lists(found, pa.list_(pa.int32()))).to_batches()

    return chunks.mapInArrow(run, shape)


def stitches(chunks: DataFrame, overlap: int) -> DataFrame:
    """Rows (row, k, island, from, to, stuck): which part of a chunk's pre-tokens counts.

    A chunk's scan and the next one's run alike from the first place of their overlap that is a boundary of both, as what a
    scan finds depends only on the text that follows. Where the overlap has no such place the chunk is ``stuck`` to the next
    one, and both belong to one ``island``. Only places within overlaps are read here, never texts.
    """
    from pyspark.sql import Window

    narrow = chunks.select(
        "row",
        "k",
        "last",
        "size",
        F.concat(F.array(F.lit(0)), F.filter("ends", lambda e: e <= overlap)).alias("head"),
        F.filter("ends", lambda e: e >= F.col("size") - overlap).alias("tail"),
    )
    order = Window.partitionBy("row").orderBy("k")
    there = narrow.select(
        "row",
        "k",
        "last",
        "size",
        F.lead("head").over(order).alias("head"),
        F.transform("tail", lambda e: e - (F.col("size") - overlap)).alias("tail"),
    )
    met = there.withColumn("met", F.array_min(F.array_intersect("tail", "head")))
    stuck = ~F.col("last") & F.col("met").isNull()
    return (
        met.withColumn("stuck", stuck)
        .withColumn("from", F.coalesce(F.lag("met").over(order), F.lit(0)))
        .withColumn("to", F.when(F.col("last"), F.col("size")).otherwise(F.col("size") - overlap + F.col("met")))
        .withColumn("begins", F.when(F.lag("stuck").over(order), 0).otherwise(1))
        .withColumn("island", F.sum("begins").over(order))
        .select("row", "k", "island", "from", "to", "stuck")
    )


def glued(chunks: DataFrame, places: DataFrame, overlap: int) -> DataFrame:
    """Chunks of which those that are stuck together are one, with the places of the first."""
    parts = F.array_sort(F.collect_list(F.struct("k", "id", "start", "last", "text")))
    met = chunks.drop("size", "ends").join(places.select("row", "k", "island"), ["row", "k"]).groupBy("row", "island").agg(parts.alias("parts"))
    whole = F.transform("parts", lambda p, i: F.when(i == 0, p["text"]).otherwise(F.substring(p["text"], overlap + 1, F.length(p["text"]))))
    first, last = F.element_at("parts", 1), F.element_at("parts", -1)
    return met.select(
        "row",
        first["id"].alias("id"),
        first["k"].alias("k"),
        first["start"].alias("start"),
        last["last"].alias("last"),
        F.array_join(whole, "").alias("text"),
    )


def stitched(docs: DataFrame, pattern: str, id_col: str, text_col: str, chunk_chars: int, overlap: int) -> DataFrame:
    """Rows (row, id, k, text, ends, from, to): chunks of texts whose kept parts join without a gap.

    Chunks are dealt out and pre-tokenised on their own. Those that do not meet their neighbour within the overlap are glued
    to it and scanned again, until all meet: a pre-token longer than the overlap ends up inside one chunk, and only the texts
    that hold one go through another round.
    """
    cut = chunks_of(docs, id_col, text_col, chunk_chars, overlap).repartition("row", "k")
    chunks, done = written(with_ends(cut, pattern), "chunks"), None
    while True:
        places = written(stitches(chunks, overlap), "stitches")
        stuck = places.where("stuck").select("row").distinct()
        met = chunks.join(places.drop("island", "stuck"), ["row", "k"])
        if places.where("stuck").isEmpty():
            return met if done is None else done.unionByName(met)
        met = met.join(stuck, "row", "left_anti")
        done = met if done is None else done.unionByName(met)
        again = chunks.join(stuck, "row", "left_semi"), places.join(stuck, "row", "left_semi")
        chunks = written(with_ends(glued(*again, overlap), pattern), "chunks")


def encode_texts(
    docs: DataFrame,
    ranks_file: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = 32_768,
    overlap: int = 512,
    chunk_bytes: int = 4_000_000,
) -> DataFrame:
    """Rows (id, ids), one for each row of ``docs``: the ids of its text under a byte-level vocabulary.

    Each match of ``pattern`` is encoded on its own by the ranks in ``ranks_file``. A text of up to ``chunk_chars`` code points
    is one chunk and encoded where it is read; the chunks of longer ones are dealt out, pre-tokenised on their own, stitched
    where the boundaries of two overlapping chunks meet, and the pieces between are encoded; only the ids of a text come
    together again. A null or empty text has no ids. Repeated rows and repeated or null ids each keep their own row; other
    columns are not read; an empty table gives no rows. The rank file is read on the driver and sent to the tasks.
    """
    if not UNSURE < overlap or not 2 * overlap <= chunk_chars:
        raise ValueError("an overlap holds more than three code points and at most half a chunk")
    shared = docs.sparkSession.sparkContext.broadcast(Path(ranks_file).read_bytes())
    shape = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", IDS)])

    def whole(batches):
        import pyarrow as pa

        cut, encode = cutter(pattern), _encoder(shared.value)
        for piece in pieces_of(batches, text_col, chunk_bytes):
            ids = [encode(cut(text or "")) for text in piece.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0).combine_chunks(), _lists(ids, pa.list_(pa.int32()))], names=shape.names)

    def parts(batches):
        import pyarrow as pa

        encode = _encoder(shared.value)
        for piece in pieces_of(batches, "text", chunk_bytes):
            columns = (piece.column(c).to_pylist() for c in ("text", "ends", "from", "to"))
            ids = []
            for text, ends, first, to in zip(*columns, strict=True):
                cuts = [first, *(e for e in ends if first < e <= to)]
                ids.append(encode([text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]))
            kept = [piece.column(c).combine_chunks() for c in ("row", "id", "k")]
            yield pa.RecordBatch.from_arrays([*kept, _lists(ids, pa.list_(pa.int32()))], names=["row", "id", "k", "ids"])

    size = F.coalesce(F.length(text_col), F.lit(0))
    given = docs.select(id_col, text_col)
    short = given.where(size <= chunk_chars).mapInArrow(whole, shape)
    met = stitched(given.where(size > chunk_chars), pattern, id_col, text_col, chunk_chars, overlap)
    in_parts = T.StructType([*(met.schema[c] for c in ("row", "id", "k")), T.StructField("ids", IDS)])
    joined = F.array_sort(F.collect_list(F.struct("k", "id", "ids")))
    long = (
        met.select("row", "id", "k", "text", "ends", "from", "to")
        .mapInArrow(parts, in_parts)
        .groupBy("row")
        .agg(joined.alias("parts"))
        .select(F.element_at("parts", 1)["id"].alias(id_col), F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
    )
    return short.unionByName(long)


def _slices(column, most: int = 65_536):
    """For each list of an Arrow list column, its numbers in slices; null has none."""
    for k in range(len(column)):
        ids = column[k].values
        ids = [] if ids is None else ids.to_numpy()
        yield (ids[i : i + most].tolist() for i in range(0, len(ids), most))


def decode_ids(encoded: DataFrame, ranks_file: str, ids_col: str = "ids") -> DataFrame:
    """The rows with ``decoded`` (binary) beside them, or in the place of a column of that name: the bytes of the ids, joined.

    Null ids give null; no ids give no bytes; an id outside the vocabulary is an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(Path(ranks_file).read_bytes())
    given = encoded.drop("decoded")
    shape = T.StructType([*given.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        raw = {rank: piece for piece, rank in read_ranks(shared.value).items()}
        for batch in batches:
            column = batch.column(ids_col)
            decoded = [b"".join(raw[i] for part in parts for i in part) for parts in _slices(column)]
            decoded = [x if there else None for x, there in zip(decoded, column.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=shape.names)

    return given.mapInArrow(run, shape)


def digests(encoded: DataFrame, ranks_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256): ids in decimal joined by a space, and the bytes they decode to.

    Both are digested slice by slice, so no text of the ids is held whole. Null ids count as none.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(Path(ranks_file).read_bytes())
    shape = T.StructType(
        [
            T.StructField(id_col, encoded.schema[id_col].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def run(batches):
        from hashlib import sha256

        import pyarrow as pa

        raw = {rank: piece for piece, rank in read_ranks(shared.value).items()}
        decimal = {rank: b"%d" % rank for rank in raw}
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for parts in _slices(batch.column(ids_col)):
                n, ids, decoded = 0, sha256(), sha256()
                for part in parts:
                    ids.update((b" " if n else b"") + b" ".join(map(decimal.__getitem__, part)))
                    decoded.update(b"".join(map(raw.__getitem__, part)))
                    n += len(part)
                counts.append(n)
                of_ids.append(ids.hexdigest())
                of_bytes.append(decoded.hexdigest())
            columns = [batch.column(id_col), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=shape.names)

    return encoded.select(id_col, ids_col).mapInArrow(run, shape)
