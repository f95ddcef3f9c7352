"""Token counts of documents by counting each distinct pre-token once."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import pieces_of, written

#: Fixed value: how the byte-level vocabulary cuts a text before it merges bytes.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for ASCII texts, in the syntax of the faster standard module.
ASCII_PRE_TOKEN = PRE_TOKEN.replace("[^\\s\\p{L}\\p{N}]", "[^\\sA-Za-z0-9]").replace("\\p{L}", "[A-Za-z]").replace("\\p{N}", "[0-9]")
#: Characters whose class both Unicode tables in use agree on; a text with any other is cut by the library itself.
AGREED = "\\x00-\\u052f\\u2010-\\u2060\\u20a0-\\u20bf\\u2100-\\u23ff\\u2500-\\u27bf\\u3000-\\u30ff\\u4e00-\\u9fa5\\uac00-\\ud7a3"


@lru_cache(maxsize=1)
def _library(vocabulary: str):
    """The library's tokenizer, once in a Python worker; a task has one core, so the library starts no threads of its own."""
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    library = Tokenizer.from_str(vocabulary)
    library.no_truncation()
    library.no_padding()
    return library


@lru_cache(maxsize=1)
def _cutter(vocabulary: str):
    """A function from a text to its pre-tokens, added special strings whole, as the library cuts it."""
    import json
    import re

    import regex

    library = _library(vocabulary)
    specials = sorted((x["content"] for x in json.loads(vocabulary).get("added_tokens") or []), key=len, reverse=True)
    mark = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
    pattern, odd = regex.compile(PRE_TOKEN), regex.compile(f"[^{AGREED}]")
    ascii_pattern = re.compile(ASCII_PRE_TOKEN, re.ASCII)

    def plain(text: str) -> list[str]:
        if text.isascii():
            return ascii_pattern.findall(text)
        if odd.search(text):
            return [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        return pattern.findall(text)

    def cut(text: str) -> list[str]:
        if mark is None or not mark.search(text):
            return plain(text)
        out: list[str] = []
        for k, part in enumerate(mark.split(text)):
            out += [part] if k % 2 else plain(part) if part else []
        return out

    return cut


def distinct_pre_tokens(docs: DataFrame, vocabulary: str, text_col: str, chunk_bytes: int, most_held: int = 200_000) -> DataFrame:
    """Rows (pre_token, times, pieces), one for each distinct pre-token, its pieces counted once.

    A task adds up its pre-tokens and gives them out whenever ``most_held`` distinct ones are held.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def add_up(batches):
        import pyarrow as pa

        cut, held = _cutter(shared.value), Counter()

        def given():
            yield pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["pre_token", "times"]
            )
            held.clear()

        for piece in pieces_of(batches, text_col, chunk_bytes):
            for text in piece.column(text_col).to_pylist():
                held.update(cut(text or ""))
                if len(held) > most_held:
                    yield from given()
        yield from given()

    def count_pieces(batches):
        import pyarrow as pa

        library = _library(shared.value)
        for batch in batches:
            found = library.encode_batch(batch.column("pre_token").to_pylist(), add_special_tokens=False)
            pieces = pa.array(map(len, found), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pieces], names=["pre_token", "times", "pieces"])

    added = docs.select(text_col).mapInArrow(add_up, "pre_token string, times long")
    added = added.groupBy("pre_token").agg(F.sum("times").alias("times"))
    return added.mapInArrow(count_pieces, "pre_token string, times long, pieces long")


def frequencies(docs: DataFrame, vocabulary: str, frequent: dict[str, int], id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """Rows (doc, pre_token, n, id, n_bytes): a document's pre-tokens outside ``frequent`` with their frequencies.

    One row more for each document has no pre-token: it gives id, size and the pieces of its frequent pre-tokens. ``doc``
    numbers the rows of the table.
    """
    shape = T.StructType(
        [
            T.StructField("doc", T.LongType()),
            T.StructField("pre_token", T.StringType()),
            T.StructField("n", T.LongType()),
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("n_bytes", T.LongType()),
        ]
    )
    context = docs.sparkSession.sparkContext
    shared, pieces_of_frequent = context.broadcast(vocabulary), context.broadcast(frequent)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        cut, known, arrow = _cutter(shared.value), pieces_of_frequent.value.get, to_arrow_schema(shape)

        def rows(*columns):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        doc = TaskContext.get().partitionId() << 40
        for piece in pieces_of(batches, text_col, chunk_bytes):
            first, sums, sizes = doc, [], []
            at, rare, times = [], [], []
            for text in piece.column(text_col).to_pylist():
                text, total = text or "", 0
                for token, n in Counter(cut(text)).items():
                    pieces = known(token)
                    if pieces is None:
                        at.append(doc)
                        rare.append(token)
                        times.append(n)
                    else:
                        total += n * pieces
                sums.append(total)
                sizes.append(len(text.encode()))
                doc += 1
            none = [None] * len(sums)
            yield rows(range(first, doc), none, sums, piece.column(id_col).to_pylist(), sizes)
            for k in range(0, len(at), 50_000):
                part = slice(k, k + 50_000)
                none = [None] * len(at[part])
                yield rows(at[part], rare[part], times[part], none, none)

    return docs.select(id_col, text_col).mapInArrow(run, shape)


def token_counts(
    docs: DataFrame,
    vocabulary_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
    chunk_bytes: int = 4_000_000,
    most_frequent: int = 1_000_000,
) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit), one for each row of ``docs``.

    The pieces of each distinct pre-token are counted once, joined to the pre-token frequencies of the documents, and
    summed; no id of a token is kept. Pre-tokens that are at least one in ``most_frequent`` of all occurrences, of which
    there cannot be more than ``most_frequent``, go to the tasks and are joined there; the others are joined by a shuffle,
    in which no key can be hot. A null text counts as empty (0 bytes, 0 tokens). Repeated rows and repeated or null ids
    each keep their own row; other columns are not read; an empty table gives no rows. ``vocabulary_file`` is a byte-level
    vocabulary of the ``tokenizers`` library, read on the driver and sent to the tasks.
    """
    vocabulary = Path(vocabulary_file).read_text(encoding="utf-8")
    pieces = written(distinct_pre_tokens(docs, vocabulary, text_col, chunk_bytes), "pre-tokens")
    total = pieces.agg(F.sum("times")).first()[0] or 0
    often = F.col("times") * most_frequent >= total
    known = pieces.where(often).select("pre_token", "pieces").toArrow()
    frequent = dict(zip(known.column("pre_token").to_pylist(), known.column("pieces").to_pylist(), strict=True))
    counted = written(frequencies(docs, vocabulary, frequent, id_col, text_col, chunk_bytes), "frequencies")
    rare = (
        counted.where(F.col("pre_token").isNotNull())
        .select("doc", "pre_token", "n")
        .join(pieces.where(~often).select("pre_token", "pieces"), "pre_token")
        .select("doc", (F.col("n") * F.col("pieces")).alias("n"))
    )
    return (
        counted.where(F.col("pre_token").isNull())
        .select("doc", "n", "id", "n_bytes")
        .unionByName(rare, allowMissingColumns=True)
        .groupBy("doc")
        .agg(F.max("id").alias(id_col), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
        .select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
