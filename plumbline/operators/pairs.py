"""Statistics of all pairs of a group's values without making the pairs.

How many pairs lie less than t apart is a sum of ranks: each value less t counts the values up to it. Values are sorted
once and cut into blocks; blocks less t count other blocks as a whole, or are looked up in the few that they meet. Levels
of the differences come from such counts, which close in on a few pairs; only those are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from ..sources.tables import written
from .quantiles import order_statistics
from .resampling import numbered

#: Thresholds per round, pairs of a group that are made at the end, and the width, as a share of the spread, that needs no other round.
SECTIONS, MOST_PAIRS, LEAST_WIDTH = 16, 100_000, 1e-12

#: Blocks that values are cut into, and the least and the most different values of one.
BLOCKS, LEAST_BLOCK, MOST_BLOCK = 64, 1 << 13, 1 << 18


def valued(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(*by, v, m): the different values of a group and how often each stands there; nulls are left out."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("m"))


def blocked(values: DataFrame, *by: str) -> DataFrame:
    """(*by, id, lo, hi, n, v, upto): values (by, v, m) sorted in ranges and cut into blocks of at most MOST_BLOCK: their
    values in order, and how many of the block's rows lie before each and before the end. A written table."""
    size = min(max(values.count() // BLOCKS, LEAST_BLOCK), MOST_BLOCK)
    kinds = StructType([f for f in values.select(*by).schema] + [StructField("id", LongType()), StructField("lo", DoubleType()), StructField("hi", DoubleType()), StructField("n", LongType()), StructField("v", ArrayType(DoubleType())), StructField("upto", ArrayType(LongType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at, held = TaskContext.get().partitionId() << 32, 0, None

        def block(x: pd.DataFrame) -> pd.DataFrame:
            nonlocal at
            v, m = x["v"].to_numpy(), x["m"].to_numpy()
            at += 1
            row = {**{k: [x[k].iloc[0]] for k in by}, "id": [part + at], "lo": [v[0]], "hi": [v[-1]], "n": [m.sum()], "v": [v], "upto": [np.concatenate([[0], np.cumsum(m)])]}
            return pd.DataFrame(row)

        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            new = np.zeros(len(held), bool)
            for k in by:
                c = held[k]
                new |= ((c != c.shift()) & ~(c.isna() & c.shift().isna())).to_numpy()
            new[:1] = True
            edges = [*np.flatnonzero(new), len(held)]
            for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
                last = i == len(edges) - 2
                while hi - lo >= size or hi > lo and not last:
                    yield block(held.iloc[lo : min(lo + size, hi)])
                    lo = min(lo + size, hi)
            held = held.iloc[lo:]
        if held is not None and len(held):
            yield block(held)

    x = values.select(*by, "v", "m").repartitionByRange(*by, "v").sortWithinPartitions(*by, "v")
    return written(x.mapInPandas(run, kinds), "blocks")


def pairs_below(values: DataFrame, thresholds: DataFrame, *by: str, blocks: DataFrame | None = None) -> DataFrame:
    """(*by, k, below): unordered pairs of a group whose values are less than t apart. values: by, v, m; thresholds: by,
    k, t; groups without values are left out. No by: one group. blocks: blocked(values, *by), if it is at hand.

    A block less t lies beyond other blocks as a whole, or is looked up in the few that it meets.
    """
    by = list(by)
    if not by:
        one = pairs_below(values.withColumn("_one", F.lit(0)), thresholds.withColumn("_one", F.lit(0)), "_one")
        return one.drop("_one")
    blocks = blocked(values, *by) if blocks is None else blocks
    thresholds = thresholds.select(*by, F.col("k").cast("string").alias("k"), F.col("t").cast("double").alias("t"))
    ends = lambda side: blocks.select(*by, *[F.col(c).alias(f"{c}_{side}") for c in ("id", "lo", "hi", "n")])
    met = ends("a").join(thresholds.where("t > 0"), by).join(ends("b"), by).where(F.col("lo_b") <= F.col("hi_a") - F.col("t"))  # blocks are few
    met = written(met.withColumn("whole", F.col("hi_b") <= F.col("lo_a") - F.col("t")), "met")
    whole = met.where("whole").select(*by, "k", (F.col("n_a").cast("decimal(38,0)") * F.col("n_b")).cast("decimal(38,0)").alias("apart"))
    some = met.where("not whole").groupBy(*by, "id_a", "id_b").agg(F.collect_list("k").alias("k"), F.collect_list("t").alias("t"))
    some = some.join(blocks.select(*by, F.col("id").alias("id_a"), F.col("v").alias("va"), F.col("upto").alias("ua")), [*by, "id_a"])
    some = some.join(blocks.select(*by, F.col("id").alias("id_b"), F.col("v").alias("vb"), F.col("upto").alias("ub")), [*by, "id_b"])
    kinds = StructType([f for f in values.select(*by).schema] + [StructField("k", StringType()), StructField("apart", LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                m, t = np.diff(r["ua"]), np.asarray(r["t"])
                apart = [int(m @ r["ub"][np.searchsorted(r["vb"], r["va"] - x, side="right")]) for x in t]
                yield pd.DataFrame({**{k: [r[k]] * len(t) for k in by}, "k": list(r["k"]), "apart": apart})

    looked = some.repartition(4 * values.sparkSession.sparkContext.defaultParallelism, *by, "id_a", "id_b").mapInPandas(run, kinds)
    apart = whole.unionByName(looked.withColumn("apart", F.col("apart").cast("decimal(38,0)"))).groupBy(*by, "k").agg(F.sum("apart").alias("apart"))
    sizes = blocks.groupBy(*by).agg(F.sum("n").cast("decimal(38,0)").alias("n"))
    below = F.expr("n * (n - 1) div 2").cast("decimal(38,0)") - F.coalesce("apart", F.lit(0))
    found = thresholds.join(sizes, by).join(apart, [*by, "k"], "left")
    return found.select(*by, "k", F.when(F.col("t") > 0, below).otherwise(0).cast("long").alias("below"))


def pair_moments(values: DataFrame, *by: str) -> DataFrame:
    """(*by, pairs, sq, spread): the number of pairs, the sum of their squared differences, in closed form about the
    mean, and the largest difference."""
    mean = values.groupBy(*by).agg((F.sum(F.col("v") * F.col("m")) / F.sum("m")).alias("_mean"))
    x = values.join(mean, list(by)) if by else values.crossJoin(F.broadcast(mean))
    d, m = F.col("v") - F.col("_mean"), F.col("m")
    n, s, ss = F.sum(m), F.sum(d * m), F.sum(d * d * m)
    return x.groupBy(*by).agg((n.cast("decimal(38,0)") * (n - 1) / 2).cast("long").alias("pairs"), (n * ss - s * s).alias("sq"), (F.max("v") - F.min("v")).alias("spread"))


def signed_sum(df: DataFrame, value: str, order: str, *by: str) -> DataFrame:
    """(*by, total): the sum over all pairs of the earlier value less the later one. The i-th of n (from 0) is added in
    n - 1 - i pairs and taken off in i. Rows are numbered by a sort in ranges."""
    x = numbered(df.select(*by, F.col(order).alias("cluster"), F.col(value).alias("v")), *by)
    return x.groupBy(*by).agg(F.sum(F.col("v") * (F.col("g") - 1 - 2 * F.col("ix"))).alias("total"))


def _made(values: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    """(by, v, c): differences at least lo and below hi, and how many pairs have each. Values meet by cells as wide as
    the bracket, of which a value needs three."""
    width = F.greatest(F.col("hi") - F.col("lo"), F.col("spread") * LEAST_WIDTH)
    x = values.join(brackets.select(*by, "lo", "hi", "spread"), by).withColumn("_w", width)
    at = lambda c: F.floor(c / F.col("_w")).cast("decimal(38,0)")
    low = x.select(*by, F.col("v").alias("a"), F.col("m").alias("ma"), at(F.col("v")).alias("cell"))
    cell = at(F.col("v") - F.col("hi"))
    high = x.select(*by, F.col("v").alias("b"), F.col("m").alias("mb"), "lo", "hi", F.explode(F.array(*[cell + i for i in range(3)])).alias("cell"))
    d = F.col("b") - F.col("a")
    met = high.join(low, [*by, "cell"]).where((F.col("b") >= F.col("a")) & (d >= F.col("lo")) & (d < F.col("hi")))
    c = F.when(F.col("a") == F.col("b"), F.expr("ma * (ma - 1) div 2")).otherwise(F.col("ma") * F.col("mb"))
    return met.groupBy(*by, d.alias("v")).agg(F.sum(c).alias("c")).where("c > 0")


def pair_levels(values: DataFrame, level: float, *by: str, most: int | None = None) -> DataFrame:
    """(*by, q): the exact quantile at level of the absolute differences of all pairs, interpolated between neighbours.

    Groups of fewer than two values are left out. most: MOST_PAIRS, for tests.
    """
    by, most = list(by), most or MOST_PAIRS
    if not by:
        return pair_levels(values.withColumn("_one", F.lit(0)), level, "_one", most=most).drop("_one")
    spot = (F.col("pairs") - 1) * F.lit(float(level))
    at = pair_moments(values, *by).where("pairs > 0").select(*by, "pairs", "spread", F.floor(spot).alias("low"), F.least(F.floor(spot) + 1, F.col("pairs") - 1).alias("high"), (spot - F.floor(spot)).alias("part"))
    # below lo lie `under` pairs, low at most; below hi lie `over`, more than high
    at = written(at.select("*", F.lit(0.0).alias("lo"), (F.col("spread") * 2 + 1).alias("hi"), F.lit(0).cast("long").alias("under"), F.col("pairs").alias("over")), "levels")
    wide = (F.col("over") - F.col("under") > most) & (F.col("hi") - F.col("lo") > F.col("spread") * LEAST_WIDTH)
    blocks = blocked(values, *by)
    while at.where(wide).limit(1).count():
        cuts = F.transform(F.sequence(F.lit(1), F.lit(SECTIONS - 1)), lambda i: F.struct(i.alias("k"), (F.col("lo") + (F.col("hi") - F.col("lo")) * i / SECTIONS).alias("t")))
        open_ = at.where(wide).select(*by, F.inline(cuts))
        counted = pairs_below(values, open_, *by, blocks=blocks).join(open_.withColumn("k", F.col("k").cast("string")), [*by, "k"])
        x = counted.join(at.select(*by, "low", "high"), by)
        ends = x.groupBy(*by).agg(F.max(F.when(F.col("below") <= F.col("low"), F.struct("t", "below"))).alias("a"), F.min(F.when(F.col("below") > F.col("high"), F.struct("t", "below"))).alias("b"))
        x = at.join(ends, by, "left")
        at = written(x.select(*by, "pairs", "spread", "low", "high", "part", F.coalesce("a.t", "lo").alias("lo"), F.coalesce("b.t", "hi").alias("hi"), F.coalesce("a.below", "under").alias("under"), F.coalesce("b.below", "over").alias("over")), "levels")
    made = written(_made(values, at, by), "pairs")
    places = at.select(*by, F.explode(F.array(F.col("low") - F.col("under"), F.col("high") - F.col("under"))).alias("place")).distinct()
    found = written(order_statistics(made, places, by), "order")
    pick = lambda c: found.select(*by, (F.col("place")).alias(f"_{c}"), F.col("v").alias(c))
    x = at.withColumn("_x", F.col("low") - F.col("under")).withColumn("_y", F.col("high") - F.col("under")).join(pick("x"), [*by, "_x"]).join(pick("y"), [*by, "_y"])
    return x.select(*by, (F.col("x") + F.col("part") * (F.col("y") - F.col("x"))).alias("q"))


def pooled_level(values: DataFrame, level: float, *by: str, most: int | None = None) -> float | None:
    """The exact quantile at level of the absolute differences of all pairs of all groups; None without pairs."""
    most = most or MOST_PAIRS
    m = pair_moments(values, *by).agg(F.sum("pairs"), F.max("spread")).first()
    if not m[0]:
        return None
    n, spread, spark = m[0], m[1], values.sparkSession
    spot = (n - 1) * level
    low, high = int(spot), min(int(spot) + 1, n - 1)
    lo, hi, under, over = 0.0, spread * 2 + 1, 0, n
    groups = values.select(*by).distinct()
    blocks = blocked(values, *by) if by else None
    while over - under > most and hi - lo > spread * LEAST_WIDTH:
        cuts = [(i, lo + (hi - lo) * i / SECTIONS) for i in range(1, SECTIONS)]
        asked = groups.crossJoin(F.broadcast(spark.createDataFrame(cuts, "k int, t double")))  # a few literals
        found = {int(r["k"]): int(r["n"]) for r in pairs_below(values, asked, *by, blocks=blocks).groupBy("k").agg(F.sum("below").alias("n")).collect()}
        for i, t in cuts:
            if found[i] <= low:
                lo, under = t, found[i]
        for i, t in reversed(cuts):
            if found[i] > high:
                hi, over = t, found[i]
    brackets = groups.select(*by, F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(spread).alias("spread"))
    made = written(_made(values, brackets, list(by)).groupBy("v").agg(F.sum("c").alias("c")), "pairs")
    places = spark.createDataFrame(sorted({(low - under,), (high - under,)}), "place long")
    at = {r["place"]: r["v"] for r in order_statistics(made, places, []).collect()}
    x, y = at[low - under], at[high - under]
    return x + (spot - low) * (y - x)
