"""Ordered computations that survive a hot key.

A plain ``OVER (PARTITION BY run ORDER BY seq)`` puts one run into one task. Here every run is first
cut into slices that follow the order (``slice_by`` must not decrease along ``order_by``). Totals or
last values of a slice are computed per slice, carried over the short list of slices, and added back,
so no task ever holds more than one slice of one run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 50_000


def spread_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", salts: int = 16, by: Sequence[str] | None = None
) -> DataFrame:
    """Join where one key of ``big`` may hold a third of its rows.

    ``small`` is repeated once per salt and ``big`` is spread over the salts, so a hot key is shared
    by ``salts`` tasks whatever adaptive settings the session has. The salt is a hash of the row, so a
    task that is run again deals its rows out the same way. ``by`` names the columns to hash where a few tell rows
    apart: a hash of all computes every column, also those that nothing reads later.
    """
    keys = list(on)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*[big[c] for c in by or _hashable(big)]), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def _hashable(df: DataFrame) -> list[str]:
    simple = ("map",)
    return [f.name for f in df.schema.fields if not f.dataType.simpleString().startswith(simple)]


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[Column],
    slice_by: Column,
    value: Column,
    out: str,
) -> DataFrame:
    """``df`` plus the inclusive running sum of ``value`` per ``keys`` along ``order_by``."""
    keys = list(keys)
    sliced = df.withColumn("_slice", slice_by).withColumn("_v", value)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order_by)
    local = sliced.withColumn(
        "_local", F.sum("_v").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.sum("_v").alias("_total"))
        .withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    return (
        local.join(offsets, [*keys, "_slice"], "left")
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .drop("_v", "_local", "_offset", "_slice")
    )


def numbered(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], slice_by: Column, out: str
) -> DataFrame:
    """Row number 1..n per ``keys``, without sorting a whole key in one task."""
    return running_sum(df, keys, order_by, slice_by, F.lit(1).cast("bigint"), out)


def carried(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[Column],
    slice_by: Column,
    value: Column,
    out: str,
    include_current: bool = True,
) -> DataFrame:
    """Last non-null ``value`` at or before (or strictly before) each row of its key."""
    keys = list(keys)
    sliced = df.withColumn("_slice", slice_by).withColumn("_v", value)
    frame_end = Window.currentRow if include_current else -1
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order_by)
    local = sliced.withColumn(
        "_local",
        F.last("_v", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, frame_end)),
    )
    order_key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order_by)])
    ends = sliced.groupBy(*keys, "_slice").agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), order_key)).alias("_end")
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    entering = ends.withColumn("_entering", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    return (
        local.join(entering, [*keys, "_slice"], "left")
        .withColumn(out, F.coalesce("_local", "_entering"))
        .drop("_v", "_local", "_entering", "_slice")
    )
