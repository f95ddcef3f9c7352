"""Whole documents drawn so that each source comes near its target, by pivotal rounding in a reduction tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, written

#: Items of one bucket of the tree, on average; the buckets of one level are the items of the next.
FAN = 64
#: Copies of one row that one task numbers at a time.
CHUNK = 4096


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Rows (source, source_size, target): the shared total by weight, each at most ``cap`` times its source's size.

    A source is full when its weight's part would pass its cap. Sources fill in the order of cap by weight, so the level
    at which none is above follows from running sums over the list of sources, without rounds.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = listed.withColumn(
        "weight",
        F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(ordered) - 1) % len(weights) + 1),
    ).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(after)
    levelled = weighed.withColumn("level", level).withColumn("turn", F.row_number().over(filling))
    fits = F.when(F.col("most") >= F.col("level") * F.col("weight"), F.struct("turn", "level"))
    return levelled.withColumn("level", F.min(fits).over(whole)["level"]).select(
        "source",
        F.col("source_size"),
        F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"),
    )


def _chance(*parts: Column) -> Column:
    """A fixed pseudo-random number from 0 to below 1."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def _numbered(counted: DataFrame) -> DataFrame:
    """Rows (id, source, size, copy) from rows (id, source, size, n): n of each, numbered from 0; many copies in parts."""
    same = ("id", "source", "size")
    few = counted.where(F.col("n") <= CHUNK).select(*same, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("copy"))
    last = F.floor((F.col("n") - 1) / CHUNK)
    parts = counted.where(F.col("n") > CHUNK).select(*same, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part"))
    first = F.col("part") * CHUNK
    copies = F.sequence(first, F.least(F.col("n"), first + CHUNK) - 1)
    return few.unionByName(parts.repartition(*same, "part").select(*same, F.explode(copies).alias("copy")))


def _paired(items: Column, seed: int, level: int) -> Column:
    """One fold over a bucket: (what is settled, the one item still fractional)."""
    item = "struct<id:string,size:bigint,copy:bigint,p:double>"
    zero = F.struct(
        F.expr("cast(array() as array<struct<id:string,size:bigint,extra:bigint>>)").alias("settled"),
        F.expr(f"cast(null as {item})").alias("open"),
    )

    def settle(x: Column, extra: int) -> Column:
        return F.array(F.struct(x["id"].alias("id"), x["size"].alias("size"), F.lit(extra).cast("bigint").alias("extra")))

    def left(x: Column, p: Column) -> Column:
        return F.struct(x["id"].alias("id"), x["size"].alias("size"), x["copy"].alias("copy"), p.alias("p"))

    def state(acc: Column, done: Column, rest: Column) -> Column:
        return F.struct(F.concat(acc["settled"], done).alias("settled"), rest.alias("open"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["open"]
        both = a["p"] + x["p"]
        u = _chance(F.lit(seed), F.lit(level), a["id"], x["id"], a["size"], x["size"], a["copy"], x["copy"])
        below = F.when(u * both < x["p"], state(acc, settle(a, 0), left(x, both))).otherwise(
            state(acc, settle(x, 0), left(a, both))
        )
        above = F.when(u * (2 - both) < 1 - x["p"], state(acc, settle(a, 1), left(x, both - 1))).otherwise(
            state(acc, settle(x, 1), left(a, both - 1))
        )
        first = F.struct(acc["settled"].alias("settled"), left(x, x["p"]).alias("open"))
        return F.when(a.isNull(), first).when(both < 1, below).otherwise(above)

    return F.aggregate(items, zero, step)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """Rows (id, size, source_size, target, copies, taken), one for each row of ``docs``.

    Every document of a source is wanted target / source_size times. The whole part is taken outright. The fraction is
    rounded by the pivotal method: two fractions meet, one takes mass from the other at random until one is 0 or 1, and
    the other goes on; the expected copies of each document stay as wanted and their number in the source stays fixed.
    Buckets of like size are folded first, what each leaves over is folded 64 buckets at a time, and the size classes of
    a source last, so that no task holds a source and the words taken stray by about one document. Rows of one id, source
    and size are counted and then numbered, so that they lie in as many buckets as any others.

    A null or empty text has size 0 and is taken 0 times; a null source is a source of its own, last in order. Repeated
    rows are separate documents. Reruns agree. Other columns are not read; an empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType
    sizes = docs.select(
        F.col(id_col).cast("string").alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    counted = written(sizes.groupBy("id", "source", "size").agg(F.count("*").alias("n")), "sizes")
    summed = counted.select("source", (F.col("size") * F.col("n")).alias("size"))
    rated = source_targets(summed, weights, share, cap).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )
    size_class = F.floor(F.log2(F.col("size").cast("double")) * 4).cast("int")
    size_class = F.when(F.col("size") > 0, size_class).otherwise(-1)
    classed = _numbered(counted).withColumn("class", size_class)
    classes = (
        counted.groupBy("source", size_class.alias("class"))
        .agg(F.ceil(F.sum("n") / FAN).cast("long").alias("buckets"))
        .withColumnRenamed("source", "s")
        .join(rated, F.col("s").eqNullSafe(F.col("source")))
        .drop("source")
        .withColumnRenamed("class", "c")
    )
    classes = written(classes, "classes")
    rows = classed.join(classes, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))).select(
        "id",
        "source",
        "size",
        "copy",
        "class",
        "source_size",
        "target",
        F.floor("rate").cast("long").alias("whole"),
        (F.col("rate") - F.floor("rate")).alias("p"),
        F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.col("size"), F.col("copy")), F.col("buckets")).alias("bucket"),
    )
    about = ("source", "source_size", "target", "whole")
    open_rows = (F.col("size") > 0) & (F.col("p") > 0)
    closed = rows.where(~open_rows).select("id", "size", "source_size", "target", F.col("whole").alias("copies"))
    items = rows.where(open_rows).select(
        *about, "class", "bucket", F.struct("id", "size", "copy", "p").alias("item"), F.xxhash64("id", "size", "copy").alias("by")
    )
    most = classes.agg(F.max("buckets")).first()[0] or 0
    levels = 1
    while FAN ** (levels - 1) < most:
        levels += 1
    settled = []
    for level in range(levels + 1):
        last = level == levels
        keys = [*about] if last else [*about, "class", "bucket"]
        folded = items.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("by", "item"))).alias("items"))
        folded = folded.withColumn("fold", _paired(F.transform("items", lambda x: x["item"]), seed, level)).drop("items")
        folded = written(folded, f"rounded-{level}")
        settled.append(folded.select(*about, F.explode("fold.settled").alias("x")))
        if last:
            end = F.col("fold.open")
            chosen = (_chance(F.lit(seed), end["id"], end["size"], end["copy"]) < end["p"]).cast("bigint")
            settled.append(
                folded.where(end.isNotNull()).select(
                    *about, F.struct(end["id"].alias("id"), end["size"].alias("size"), chosen.alias("extra")).alias("x")
                )
            )
        else:
            items = folded.where(F.col("fold.open").isNotNull()).select(
                *about,
                "class",
                F.shiftright("bucket", 6).alias("bucket"),
                F.col("fold.open").alias("item"),
                (F.col("class") * F.lit(1 << 40) + F.col("bucket")).cast("long").alias("by"),
            )
    out = closed
    for part in settled:
        out = out.unionByName(
            part.select(
                F.col("x.id").alias("id"),
                F.col("x.size").alias("size"),
                "source_size",
                "target",
                (F.col("whole") + F.col("x.extra")).alias("copies"),
            )
        )
    return out.select(
        F.col("id").cast(id_type).alias(id_col),
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )
