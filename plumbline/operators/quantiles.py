"""Exact quantiles of any number of values, for many groups and levels at once.

Every wanted place in order starts with its group's whole range. Values in a range are counted between approximate cut
points (a mergeable sketch), each place moves to the cell that holds it, and this is repeated until ranges hold few
different values. Only these are sorted, range by range. Each round is an aggregate over the values that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: Different values of a range that are sorted at once, and cells that a range is cut into.
MOST_SORTED, CELLS = 100_000, 256


def _in_ranges(values: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """values (by, v, c) with their ranges (by, lo, hi); ranges of a group share at most their ends."""
    named = ranges.select(*[F.col(k).alias(f"_{k}") for k in by], "lo", "hi")
    near = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    for k in by:
        near = near & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return values.join(F.broadcast(named) if not by else named, near).drop(*[f"_{k}" for k in by])


def _same(by: list[str], *more: str) -> Column:
    on = F.lit(True)
    for k in (*by, *more):
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return on


def order_statistics(values: DataFrame, places: DataFrame, by: list[str], most: int | None = None) -> DataFrame:
    """(*by, place, v): the value at each place (from 0) of its group's order. values: by, v, c (v stands c times);
    places: by, place."""
    most = most or MOST_SORTED
    whole = values.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("kinds"))
    at = places.alias("a").join(whole.alias("b"), _same(by)).select("a.*", "b.lo", "b.hi", F.lit(0).cast("long").alias("below"), "b.kinds")
    at = written(at, "places")
    while (at.where("lo < hi").agg(F.max("kinds")).first()[0] or 0) > most:
        crowded = at.where((F.col("lo") < F.col("hi")) & (F.col("kinds") > most))
        inside = _in_ranges(values, crowded.select(*by, "lo", "hi").distinct(), by)
        cuts = F.percentile_approx("v", F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)]), F.lit(10 * CELLS))
        grid = inside.groupBy(*by, "lo", "hi").agg(F.array_distinct(F.concat(F.array(F.col("lo")), cuts, F.array(F.col("hi")))).alias("cuts"))
        grid = written(grid, "grid")
        # a cell runs from one cut point, which it holds, to before the next; the last value is a cell of its own
        cell = F.size(F.filter("cuts", lambda x: x <= F.col("v")))
        met = inside.alias("a").join(grid.alias("b"), _same(by, "lo", "hi")).select(*[f"a.{k}" for k in by], "a.lo", "a.hi", "a.v", "a.c", cell.alias("cell"))
        cells = met.groupBy(*by, "lo", "hi", "cell").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("kinds"), F.min("v").alias("first"), F.max("v").alias("last"))
        w = Window.partitionBy(*by, "lo", "hi").orderBy("cell")  # CELLS + 1 rows
        cells = cells.withColumn("upto", F.sum("n").over(w))
        near = _same(by, "lo", "hi") & (F.col("a.place") - F.col("a.below") >= F.col("b.upto") - F.col("b.n")) & (F.col("a.place") - F.col("a.below") < F.col("b.upto"))
        moved = crowded.alias("a").join(cells.alias("b"), near).select(*[f"a.{k}" for k in by], "a.place", F.col("b.first").alias("lo"), F.col("b.last").alias("hi"), (F.col("a.below") + F.col("b.upto") - F.col("b.n")).alias("below"), "b.kinds")
        at = written(at.where((F.col("lo") == F.col("hi")) | (F.col("kinds") <= most)).unionByName(moved), "places")
    ranges = at.where("lo < hi").select(*by, "lo", "hi", "below").distinct()
    few = _in_ranges(values, ranges.select(*by, "lo", "hi"), by)
    w = Window.partitionBy(*by, "lo", "hi").orderBy("v")  # MOST_SORTED rows
    few = few.withColumn("upto", F.sum("c").over(w))
    near = _same(by, "lo", "hi") & (F.col("a.place") - F.col("a.below") >= F.col("b.upto") - F.col("b.c")) & (F.col("a.place") - F.col("a.below") < F.col("b.upto"))
    found = at.where("lo < hi").alias("a").join(few.alias("b"), near).select(*[f"a.{k}" for k in by], "a.place", "b.v")
    return found.unionByName(at.where("lo = hi").select(*by, "place", F.col("lo").alias("v")))


def quantiles(df: DataFrame, value: str, levels: list[float], *by: str, weight: str | None = None, most: int | None = None) -> DataFrame:
    """(*by, n, q): q holds the exact quantiles at levels, interpolated between neighbours; n the values that count.

    Null values don't count; a group without values is left out. weight: how often a row counts, once if not given.
    most: MOST_SORTED, for tests.
    """
    by = list(by)
    c = F.col(weight) if weight else F.lit(1)
    values = df.where(F.col(value).isNotNull() & (c > 0)).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.sum(c).cast("long").alias("c"))
    values = written(values, "values")
    sizes = values.groupBy(*by).agg(F.sum("c").alias("n"))
    spot = lambda q: (F.col("n") - 1) * F.lit(float(q))
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(spot(q)).alias("low"), F.least(F.floor(spot(q)) + 1, F.col("n") - 1).alias("high"), (spot(q) - F.floor(spot(q))).alias("part")) for i, q in enumerate(levels)])
    wanted = written(sizes.where("n > 0").select(*by, "n", F.inline(each)), "wanted")
    places = wanted.select(*by, F.explode(F.array("low", "high")).alias("place")).distinct()
    at = written(order_statistics(values, places, by, most), "order")
    low = wanted.alias("a").join(at.alias("b"), _same(by) & (F.col("a.low") == F.col("b.place"))).select("a.*", F.col("b.v").alias("x"))
    both = low.alias("a").join(at.alias("b"), _same(by) & (F.col("a.high") == F.col("b.place"))).select("a.*", F.col("b.v").alias("y"))
    q = F.col("x") + F.col("part") * (F.col("y") - F.col("x"))
    return both.groupBy(*by, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", q.alias("q")))), lambda s: s["q"]).alias("q"))
