"""Small helpers the text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import shared_dir, written  # noqa: F401  (the text operators take it from here)

#: Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; ``bytes.split`` parts exactly at the white space that ``WORD`` excludes."""
    return (text or "").encode().split()


def remainder_of(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits that stand for an id and a text together; a null is none of the other values."""
    known = F.col(id_col).cast("string")
    return F.md5(F.concat_ws(":", F.coalesce(F.length(known), F.lit(-1)), known, F.col(text_col)).cast("binary"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as make it none of the columns."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """The rows as a table in the shared folder, bucketed by ``key``, so that groups by it are read without a shuffle."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    buckets = max(1, min(buckets, 50_000))
    dealt = df.repartition(buckets, key).write.bucketBy(buckets, key).option("compression", "zstd")
    dealt.option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def pieces_of(batches: Iterator, text_col: str, most: int) -> Iterator:
    """Arrow batches cut so that each holds about ``most`` bytes of text (one longer text stays whole)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        table = pa.table(batch) if not isinstance(batch, pa.Table) else batch
        sizes = pc.fill_null(pc.binary_length(table.column(text_col)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield table.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield table.slice(start)
