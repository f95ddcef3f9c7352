"""Exact tests and what may be said about them (Q01-Q05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.grading import ratio
from plumbline.operators.scan import running_sum, spread_join
from plumbline.session import cut_lineage

MAX_EXACT = 10
RESAMPLES = 20_000
STEP = 10_000
#: Distinct values a round of the exact test takes of each half.
PER_ROUND = 4
#: Distinct values of a block and draws of a chunk in the sampled test.
PER_BLOCK, DRAWS = 4_000, 500


def fisher_exact(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``pairs``: keys, hits_a, tested_a, hits_b, tested_b, independent. Adds two-sided ``p``.

    Each table of a pair is one row. Its probability over the one before it is a ratio of four counts,
    and all of them add up to one, so a running sum of logarithms stands in for the factorials.
    """
    # a row per pair, read four times below: written once, so what counted the hits runs once
    pairs = cut_lineage(pairs)
    drawn = F.col("hits_a") + F.col("hits_b")
    low = F.greatest(F.lit(0).cast("bigint"), drawn - F.col("tested_b"))
    high = F.least("tested_a", drawn)
    usable = (F.col("tested_a") > 0) & (F.col("tested_b") > 0) & F.col("independent")
    # exploded in two steps so that no row ever carries an array as long as a hit count
    tables = (
        pairs.filter(usable)
        .withColumn("_low", low)
        .withColumn("_high", high)
        .withColumn("_from", F.explode(F.expr(f"sequence(_low, _high, {STEP}L)")))
        .withColumn("x", F.explode(F.expr(f"sequence(_from, least(_from + {STEP - 1}L, _high))")))
    )
    x = F.col("x")
    ratio_up = (F.col("tested_a") - x + 1) * (drawn - x + 1) / (x * (F.col("tested_b") - drawn + x))
    step = F.when(x == F.col("_low"), F.lit(0.0)).otherwise(F.ln(ratio_up))
    weighted = running_sum(
        tables.select(*keys, "x", "hits_a", step.alias("_step")), keys, [F.col("x")], F.floor(x / STEP), F.col("_step"), "_log"
    )
    peaks = weighted.groupBy(*keys).agg(
        F.max("_log").alias("_peak"), F.max(F.when(F.col("x") == F.col("hits_a"), F.col("_log"))).alias("_seen")
    )
    weight = F.exp(F.col("_log") - F.col("_peak"))
    p = (
        spread_join(weighted, peaks, keys)
        .groupBy(*keys)
        .agg(
            F.least(
                F.lit(1.0), F.sum(F.when(F.col("_log") <= F.col("_seen") + 1e-9, weight).otherwise(0.0)) / F.sum(weight)
            ).alias("p")
        )
    )
    return pairs.join(p, keys, "left")


def _left_sums(samples: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(facts of each pair in whole units; rows (keys, half, taken, left, ways) that count the left sides by their sum).

    A unit is a power of ten of at most 1e-14 of what the values add up to, so that values of a few digits are whole and equal
    sums equal. The distinct values of a pair are dealt to two
    halves; a round takes the next ``PER_ROUND`` values of each, lists how often each is drawn, and adds up what has drawn the
    same number and sum so far. The rows are as many as there are different sums, not as many as there are choices.
    """
    facts = samples.withColumn("_pool", F.concat("a", "b")).select(
        *keys,
        "_pool",
        F.size("a").cast("long").alias("_n"),
        F.size("b").cast("long").alias("_m"),
        _sum(F.transform("_pool", F.abs)).alias("_peak"),
    )
    facts = facts.withColumn("_scale", F.pow(F.lit(10.0), F.least(F.lit(15.0), F.floor(14 - F.log10(F.greatest("_peak", F.lit(1e-15)))))))
    units = F.transform("_pool", lambda v: F.round(v * F.col("_scale")).cast("long"))
    facts = facts.withColumn("_pool", units)
    facts = facts.withColumns(
        {
            "_total": F.aggregate("_pool", F.lit(0).cast("long"), lambda x, v: x + v),
            "_own": F.aggregate(F.slice("_pool", F.lit(1), F.col("_n").cast("int")), F.lit(0).cast("long"), lambda x, v: x + v),
            "_width": F.greatest(F.lit(1), F.ceil(F.col("_peak") * F.col("_scale") / 64)).cast("long"),
        }
    )
    listed = facts.select(*keys, F.explode("_pool").alias("v")).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    sorted_values = listed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("v", "c"))).alias("_values"))
    blocks = (
        sorted_values.select(*keys, F.posexplode("_values").alias("_at", "_value"))
        .groupBy(*keys, (F.col("_at") % 2).alias("_half"), F.floor(F.col("_at") / (2 * PER_ROUND)).alias("_round"))
        .agg(F.collect_list("_value").alias("_block"))
    )
    facts, blocks = cut_lineage(facts.drop("_pool")), cut_lineage(blocks)
    states = facts.select(
        *keys, "_n", F.explode(F.array(F.lit(0), F.lit(1))).alias("_half"),
        F.lit(0).cast("long").alias("_taken"), F.lit(0).cast("long").alias("_left"), F.lit(1.0).alias("_ways"),
    )
    rounds = blocks.agg(F.max("_round")).first()[0]
    for k in range(0 if rounds is None else rounds + 1):
        states = spread_join(states, blocks.where(F.col("_round") == k).drop("_round"), [*keys, "_half"], "left")
        for i in range(PER_ROUND):
            value = F.get("_block", F.lit(i))
            states = states.withColumn("_c", F.coalesce(value["c"], F.lit(0).cast("long")))
            states = states.withColumn("_took", F.explode(F.sequence(F.lit(0).cast("long"), F.least("_c", F.col("_n") - F.col("_taken")))))
            ways = F.expr("aggregate(if(_took > 0, sequence(1L, _took), array()), 1D, (w, i) -> w * (_c - _took + i) / i)")
            states = states.withColumns(
                {
                    "_left": F.col("_left") + F.col("_took") * F.coalesce(value["v"], F.lit(0).cast("long")),
                    "_ways": F.col("_ways") * ways,
                    "_taken": F.col("_taken") + F.col("_took"),
                }
            )
        states = states.groupBy(*keys, "_n", "_half", "_taken", "_left").agg(F.sum("_ways").alias("_ways"))
        if k % 4 == 3:
            states = cut_lineage(states)
    return facts, states


def permutation_exact(samples: DataFrame, keys: list[str]) -> DataFrame:
    """``samples``: keys, a array<double>, b array<double>, at most ``MAX_EXACT`` values in ``a`` and any number in ``b``.

    Relabellings are counted by their left sum (``_left_sums``); gaps count as equal within 1e-12 or ten units. A relabelling is as far apart as the pair if its left sum is
    at most one bound or at least another, so a running count over the sums of one half answers every row of the other half.
    Pairs with more values in ``a`` are left to ``permutation_sampled``.
    """
    samples = cut_lineage(samples)
    size = F.size("a")
    facts, states = _left_sums(samples.filter((size > 0) & (size <= MAX_EXACT) & (F.size("b") > 0)), keys)
    n, m, total = F.col("_n"), F.col("_m"), F.col("_total")
    apart = F.abs(F.col("_own") / n - (total - F.col("_own")) / m) - F.greatest(1e-12 * F.col("_scale"), F.lit(10.0))
    per = F.lit(1.0) / n + F.lit(1.0) / m
    facts = facts.withColumns(
        {
            "_apart": apart,
            "_low": F.floor((total / m - apart) / per).cast("long"),
            "_high": F.ceil((total / m + apart) / per).cast("long"),
        }
    )
    states = cut_lineage(states)
    bounds = facts.select(*keys, "_low", "_high", "_width")
    one, other = (spread_join(states.where(F.col("_half") == half), bounds, keys) for half in (0, 1))
    left, most = F.col("_left"), F.lit(2**62)

    def asked(place: Column, order: int, sign: int) -> Column:
        return F.struct(place.alias("_place"), F.lit(order).alias("_order"), (F.col("_ways") * sign).alias("_weight"), F.lit(0.0).alias("_ways"))

    questions = F.array(asked(F.col("_low") - left, 2, 1), asked(F.col("_high") - left, 0, -1), asked(most, 3, 1))
    asking = one.select(*keys, (n - F.col("_taken")).alias("_need"), "_width", F.explode(questions).alias("_q")).select(*keys, "_need", "_width", "_q.*")
    counted = other.select(
        *keys, F.col("_taken").alias("_need"), "_width", left.alias("_place"), F.lit(1).alias("_order"), F.lit(0.0).alias("_weight"), "_ways"
    )
    rows = asking.unionByName(counted)
    place = F.floor(F.col("_place") / F.col("_width"))
    summed = running_sum(rows, [*keys, "_need"], [F.col("_place"), F.col("_order")], place, F.col("_ways"), "_upto")
    share = F.col("_weight") * F.col("_upto")
    far = summed.groupBy(*keys).agg(ratio(F.sum(share), F.sum(F.when(F.col("_order") == 3, share))).alias("_far"))
    p = facts.select(*keys, "_apart").join(far, keys).select(
        *keys, F.when(F.col("_apart") <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_far"))).alias("p")
    )
    return samples.join(p, keys, "left")


def permutation_sampled(samples: DataFrame, keys: list[str], resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """Seeded resampling above the exact size: in ``resamples`` draws, how often the sides are as far apart as they are.

    ``samples``: keys, side ('a' or 'b'), item bigint (not read), value double. Long form, so no pair is gathered. Equal values
    are one with a count, and the distinct values of a pair lie in blocks of about ``PER_BLOCK``. A draw is made in two steps
    that together are one hypergeometric draw: how many of each block go left, then which values of the block they are. Only
    a block's left sum leaves a task. Generators are seeded by pair, block and draw, so a rerun on any cluster agrees. Gaps
    are compared in whole units (``_left_sums``).
    """
    known = samples.filter("value is not null")
    left = F.col("side") == "a"
    facts = known.groupBy(*keys).agg(
        F.count_if(left).alias("_n"), F.count_if(~left).alias("_m"), F.sum(F.abs("value")).alias("_peak")
    )
    facts = facts.withColumn("_scale", F.pow(F.lit(10.0), F.least(F.lit(15.0), F.floor(14 - F.log10(F.greatest("_peak", F.lit(1e-15)))))))
    counted = spread_join(known, facts.select(*keys, "_scale"), keys).groupBy(
        *keys, F.round(F.col("value") * F.col("_scale")).cast("long").alias("_v")
    ).agg(F.count(F.lit(1)).alias("_c"), F.count_if(left).alias("_own"))
    counted = cut_lineage(counted)
    totals = counted.groupBy(*keys).agg(
        F.sum(F.col("_v") * F.col("_c")).alias("_total"),
        F.sum(F.col("_v") * F.col("_own")).alias("_left"),
        F.ceil(F.count(F.lit(1)) / PER_BLOCK).cast("int").alias("_blocks"),
    )
    facts = cut_lineage(facts.join(totals, keys).filter((F.col("_n") > 0) & (F.col("_m") > 0)))
    hashed = F.pmod(F.xxhash64("_v"), F.col("_blocks")).cast("int")
    blocks = (
        spread_join(counted, facts.select(*keys, "_blocks"), keys)
        .groupBy(*keys, hashed.alias("_block"))
        .agg(F.sum("_c").alias("_size"), F.sort_array(F.collect_list(F.struct("_v", "_c"))).alias("_values"))
    )
    blocks = cut_lineage(blocks)
    sizes = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_block", "_size"))).alias("_sizes"))
    chunks = F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // DRAWS)))
    planned = facts.select(*keys, "_n", F.xxhash64(*keys).alias("_pair")).join(sizes, keys).withColumn("_chunk", chunks)

    def generator(*parts: int):
        import numpy as np

        return np.random.default_rng([seed, *(p % 2**64 for p in parts)])

    def divide(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k, row in enumerate(batch.to_pylist()):
                draws = min(DRAWS, resamples - row["_chunk"] * DRAWS)
                held = np.array([x["_size"] for x in row["_sizes"]], "i8")
                taken = generator(row["_pair"], row["_chunk"]).multivariate_hypergeometric(held, row["_n"], size=draws, method="marginals")
                number = len(held)
                columns = [batch.column(c).take(pa.array([k] * number)) for c in (*keys, "_pair", "_chunk")]
                of = pa.array([x["_block"] for x in row["_sizes"]], pa.int32())
                yield pa.RecordBatch.from_arrays([*columns, of, pa.array(list(taken.T), pa.list_(pa.int64()))], names=[*keys, "_pair", "_chunk", "_block", "_taken"])

    def choose(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k, row in enumerate(batch.to_pylist()):
                values, often = (np.array([x[c] for x in row["_values"]], "i8") for c in ("_v", "_c"))
                chance, taken = generator(row["_pair"], row["_chunk"], row["_block"]), np.array(row["_taken"])
                sums = np.empty(len(taken), "i8")
                for n in np.unique(taken):
                    at = np.flatnonzero(taken == n)
                    sums[at] = chance.multivariate_hypergeometric(often, n, size=len(at), method="marginals") @ values
                columns = [batch.column(c).take(pa.array([k] * len(sums))) for c in keys]
                draw = pa.array(row["_chunk"] * DRAWS + np.arange(len(sums)))
                yield pa.RecordBatch.from_arrays([*columns, draw, pa.array(sums)], names=[*keys, "_draw", "_sum"])

    named = [samples.schema[c] for c in keys]
    shared = T.StructType([*named, *T.StructType.fromDDL("_pair long, _chunk int, _block int, _taken array<long>").fields])
    summed = T.StructType([*named, *T.StructType.fromDDL("_draw long, _sum long").fields])
    divided = planned.mapInArrow(divide, shared)
    drawn = divided.join(blocks.drop("_size"), [*keys, "_block"]).select(*keys, "_pair", "_chunk", "_block", "_taken", "_values")
    drawn = drawn.repartition(*keys, "_chunk", "_block").mapInArrow(choose, summed)
    sums = drawn.groupBy(*keys, "_draw").agg(F.sum("_sum").alias("_sum"))
    n, m, total = F.col("_n"), F.col("_m"), F.col("_total")
    seen = F.abs(F.col("_left") / n - (total - F.col("_left")) / m) - F.greatest(1e-12 * F.col("_scale"), F.lit(10.0))
    far = F.abs(F.col("_sum") / n - (total - F.col("_sum")) / m) >= F.col("_seen")
    asked = facts.withColumn("_seen", seen).select(*keys, "_n", "_m", "_total", "_seen")
    p = spread_join(sums, asked, keys).groupBy(*keys).agg(ratio(F.count_if(far), F.count(F.lit(1))).alias("p"))
    return samples.select(*keys).distinct().join(p, keys, "left")


def permutation_p(samples: DataFrame, keys: list[str]) -> DataFrame:
    """A p-value for every pair with values on both sides: exact for up to ``MAX_EXACT`` values on the left, else sampled."""
    exact = permutation_exact(samples, keys)
    rest = exact.filter("p is null and size(a) > 0 and size(b) > 0")
    sides = [rest.select(*keys, F.lit(side).alias("side"), F.posexplode(side).alias("at", "value")) for side in ("a", "b")]
    items = sides[0].unionByName(sides[1]).withColumn("item", F.col("at") * 2 + (F.col("side") == "b").cast("int"))
    sampled = permutation_sampled(items.select(*keys, "side", F.col("item").cast("bigint").alias("item"), "value"), keys)
    found = exact.join(sampled.withColumnRenamed("p", "_sampled"), keys, "left")
    return found.withColumn("p", F.coalesce("p", "_sampled")).drop("_sampled")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def verdict(p: Column) -> Column:
    return (
        F.when(p.isNull(), F.lit("not measured"))
        .when(p < 0.05, F.lit("significant"))
        .when(p < 0.15, F.lit("suggestive, not significant"))
        .otherwise(F.lit("no detectable difference"))
    )


def compare_ranges(sweeps: DataFrame, left: str, right: str, keys: list[str] | None = None) -> DataFrame:
    """Whether one arm's whole range clears the other's, and why the answer is what it is."""
    keys = keys or []
    cols = [*keys, "independent", "recall_low", "recall_high"]

    def side(arm: str, tag: str) -> DataFrame:
        return sweeps.filter(F.col("arm") == arm).select(
            *keys, F.lit(1).alias("_k"), *[F.col(c).alias(f"{tag}_{c}") for c in cols if c not in keys]
        )

    both = side(left, "l").join(side(right, "r"), [*keys, "_k"])
    independent = F.col("l_independent") & F.col("r_independent")
    missing = (
        F.col("l_recall_low").isNull()
        | F.col("l_recall_high").isNull()
        | F.col("r_recall_low").isNull()
        | F.col("r_recall_high").isNull()
    )
    result = (
        F.when(~independent | missing, F.lit("inconclusive"))
        .when(F.col("l_recall_low") > F.col("r_recall_high"), F.lit("better"))
        .when(F.col("l_recall_high") < F.col("r_recall_low"), F.lit("worse"))
        .otherwise(F.lit("inconclusive"))
    )
    why = (
        F.when(~independent, F.lit("repeats not independent"))
        .when(result == "inconclusive", F.lit("ranges overlap"))
        .otherwise(F.lit("ranges clear"))
    )
    return both.select(*keys, result.alias("result"), why.alias("why"))
