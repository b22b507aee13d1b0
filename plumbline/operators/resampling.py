"""Cluster-aware inference as DataFrame programs.

All mean-type statistics need only the sum and the number of rows of each (contrast, cluster), so rows are
aggregated to those first, and only then multiplied by draws. Draws come from a hash, so results depend neither on
partitioning nor on order. They are made in blocks inside tasks (`draws`), so that no row of (draw, cluster) is
shuffled. What reaches one task or the driver is bounded by the number of draws, of contrasts or of stated buckets, or
by `draws.MOST_UNITS` numbers of a group.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hashed
from ..sources.tables import written
from . import draws as D


def cluster_sums(df: DataFrame, cluster: str, value: str, *by: str) -> DataFrame:
    """(*by, cluster, s, n): the partial aggregate that every resampler reads."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.col(cluster).alias("cluster")).agg(F.sum(value).cast("double").alias("s"), F.count(F.lit(1)).alias("n"))


def _beside(df: DataFrame, totals: DataFrame, *by: str) -> DataFrame:
    """df with the totals of its group: one row of totals if there is no by."""
    return df.join(totals, [*by]) if by else df.crossJoin(F.broadcast(totals))


def cr0(sums: DataFrame, *by: str) -> DataFrame:
    """(*by, n, clusters, mean, se): the mean and its cluster-robust standard error."""
    x = _beside(sums, sums.groupBy(*by).agg((F.sum("s") / F.sum("n")).alias("mean")), *by)
    r = F.col("s") - F.col("n") * F.col("mean")
    return x.groupBy(*by).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("clusters"), F.max("mean").alias("mean"), (F.sqrt(F.sum(r * r)) / F.sum("n")).alias("se"))


def numbered(sums: DataFrame, *by: str) -> DataFrame:
    """sums with ix (from 0, by cluster, in each group) and g, the group's number of clusters.

    A sort in ranges, and the counts of the ranges, number the rows; no group is one task's work.
    """
    x = written(sums.orderBy(*by, "cluster").withColumn("_at", F.monotonically_increasing_id()), "ordered")
    counts = x.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("low")).orderBy("part").collect()  # one row per partition
    before, starts = 0, []
    for r in counts:
        starts.append((r["part"], before - r["low"]))
        before += r["n"]
    shift = F.broadcast(sums.sparkSession.createDataFrame(starts, "part long, shift long"))
    x = x.join(shift, F.shiftright("_at", 33) == F.col("part")).withColumn("_at", F.col("_at") + F.col("shift")).drop("part", "shift")
    x = _beside(x, x.groupBy(*by).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("g")), *by)
    return x.withColumn("ix", (F.col("_at") - F.col("_first")).cast("int")).drop("_at", "_first")


def _largest(df: DataFrame, *by: str) -> int:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def bootstrap_means(sums: DataFrame, draws: int, seed: int, *by: str) -> DataFrame:
    """(*by, b, m): means of clusters drawn with replacement, all rows of a cluster together.

    Slot j of draw b takes the cluster whose place in order is the hash of (seed, b, j) modulo their number.
    """
    sums = written(sums, "sums")
    if _largest(sums, *by) > D.MOST_UNITS:
        return _bootstrap_means_of_many(numbered(sums, *by), draws, seed, *by)
    c = F.col("c")
    groups = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("cluster", "s", "n"))).alias("c")).select(*by, c["s"].alias("s"), c["n"].alias("n"))

    def one(r: dict, b: int) -> list[tuple]:
        picked = D.hashes(f"{seed}:{b}:", _numbers(len(r["s"]))) % len(r["s"])
        return [(float(r["s"][picked].sum() / r["n"][picked].sum()),)]

    return D.per_draw(groups, draws, one, "m double", list(by))


@functools.lru_cache(2)
def _numbers(n: int) -> list[bytes]:
    return [str(j).encode() for j in range(n)]


def _bootstrap_means_of_many(n: DataFrame, draws: int, seed: int, *by: str) -> DataFrame:
    """bootstrap_means of numbered sums whose groups are too large for arrays: every cluster's row stands for one slot
    of each draw, so the slots are made where the clusters are."""
    slots = n.select(*by, "g", F.col("ix").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b"))
    picked = slots.select(*by, "b", (hashed(F.lit(seed), F.col("b"), F.col("j")) % F.col("g")).cast("int").alias("ix"))
    return picked.join(n.select(*by, "ix", "s", "n"), [*by, "ix"]).groupBy(*by, "b").agg((F.sum("s") / F.sum("n")).alias("m"))


def bootstrap_medians(counts: DataFrame, draws: int, seed: int) -> DataFrame:
    """(b, m): medians of clusters drawn with replacement. counts: cluster, v and c, how often the cluster has v.

    Values are counted in their clusters, and a draw weighs the counts, so no draw holds its rows.
    """
    counts = written(counts.select("cluster", F.col("v").cast("double").alias("v"), "c"), "counts")
    clusters = numbered(counts.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")))
    rows = counts.join(clusters.select("cluster", "ix", "g"), "cluster")
    if counts.count() > D.MOST_UNITS:
        slots = clusters.select("g", F.col("ix").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b"))
        w = slots.select("b", (hashed(F.lit(seed), F.col("b"), F.col("j")) % F.col("g")).cast("int").alias("ix")).groupBy("b", "ix").agg(F.count(F.lit(1)).alias("w"))
        x = w.join(rows, "ix").groupBy("b", "v").agg(F.sum(F.col("w") * F.col("c")).alias("n"))
        return x.groupBy("b").agg(F.percentile("v", 0.5, F.col("n")).alias("m"))
    c = F.col("c")
    group = rows.agg(F.array_sort(F.collect_list(F.struct("v", "ix", "c"))).alias("c"), F.max("g").alias("g")).select("g", c["v"].alias("v"), c["ix"].alias("ix"), c["c"].alias("c"))

    def one(r: dict, b: int) -> list[tuple]:
        times = np.bincount(D.hashes(f"{seed}:{b}:", _numbers(r["g"])) % r["g"], minlength=r["g"])
        upto = np.cumsum(times[r["ix"]] * r["c"])
        middle = [r["v"][np.searchsorted(upto, k)] for k in ((upto[-1] + 1) // 2, upto[-1] // 2 + 1)]
        return [(float(sum(middle)) / 2,)]

    return D.per_draw(group, draws, one, "m double", [])


def percentile_interval(means: DataFrame, level: float, *by: str) -> DataFrame:
    a = (1 - level) / 2
    return means.groupBy(*by).agg(F.percentile("m", a).alias("lo"), F.percentile("m", 1 - a).alias("hi"))


def bca_levels(share: float, accel: float, clusters: int, level: float) -> tuple[float | None, float, float]:
    """(z0, lower, upper): the levels of the draws' percentiles that bound the interval; plain ones where BCa is undefined."""
    a, nd = (1 - level) / 2, NormalDist()
    if not 0 < share < 1 or clusters < 3:
        return None, a, 1 - a
    z0 = nd.inv_cdf(share)
    below = [1 - accel * (z0 + z) for z in map(nd.inv_cdf, (a, 1 - a))]
    if min(map(abs, below)) < 1e-12:
        return z0, a, 1 - a
    return z0, *(nd.cdf(z0 + (z0 + z) / d) for z, d in zip(map(nd.inv_cdf, (a, 1 - a)), below))


def bca_interval(sums: DataFrame, draws: int, seed: int, level: float = 0.95, *by: str) -> DataFrame:
    """(*by, mean, z0, accel, lo, hi): bias-corrected and accelerated intervals of the mean.

    The percentile interval where that is undefined (fewer than three clusters, all draws on one side); the mean
    itself where all draws are equal. The acceleration comes from leaving out each cluster in turn, in closed form.
    """
    sums = written(sums, "sums")
    totals = sums.groupBy(*by).agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("clusters"))
    mean = F.col("all_s") / F.col("all_n")
    left = _beside(sums, totals, *by).where("all_n > n").withColumn("u", (F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n")) - mean)
    jack = left.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum("u").alias("u1"), F.sum(F.pow("u", F.lit(2))).alias("u2"), F.sum(F.pow("u", F.lit(3))).alias("u3"))
    means = bootstrap_means(sums, draws, seed, *by).groupBy(*by).agg(F.array_sort(F.collect_list("m")).alias("draws"))  # `draws` numbers a group

    @F.pandas_udf("struct<z0: double, accel: double, lo: double, hi: double>")
    def interval(d: pd.Series, obs: pd.Series, g: pd.Series, k: pd.Series, u1: pd.Series, u2: pd.Series, u3: pd.Series) -> pd.DataFrame:
        rows = []
        for x, o, clusters, n_, a1, a2, a3 in zip(d, obs, g, k, u1, u2, u3):
            x, accel = np.asarray(x), 0.0
            if n_ and n_ > 0:
                m = a1 / n_
                square, cube = a2 - n_ * m * m, n_ * m**3 - 3 * m * m * a1 + 3 * m * a2 - a3
                accel = cube / (6 * square**1.5) if square > 0 else 0.0
            z0, low, high = bca_levels(float((x < o).mean()), accel, int(clusters), level)
            lo, hi = (o, o) if np.allclose(x, x[0]) else np.percentile(x, [100 * low, 100 * high])
            rows.append((z0, accel, float(lo), float(hi)))
        return pd.DataFrame(rows, columns=["z0", "accel", "lo", "hi"])

    if by:
        x = totals.join(means, [*by]).join(jack, [*by], "left")
    else:
        x = totals.crossJoin(means).crossJoin(jack)  # one row each
    x = x.withColumn("mean", mean).withColumn("i", interval("draws", "mean", "clusters", "k", "u1", "u2", "u3"))
    return x.select(*by, "mean", "i.z0", "i.accel", "i.lo", "i.hi")


def _beyond(drawn: np.ndarray, observed: float, two_sided: bool) -> float:
    """p from studentised draws."""
    far = np.abs(drawn) >= abs(observed) - 1e-12 if two_sided else drawn >= observed - 1e-12
    return float((far.sum() + 1) / (len(drawn) + 1))


def _studentised(se_: np.ndarray, en: np.ndarray, ee: float | np.ndarray, nn: float | np.ndarray, total: float | np.ndarray) -> np.ndarray:
    """t of draws from their sums of e and of e n, and from the sums of e^2 and n^2, which signs leave as they are."""
    m = se_ / total
    sd = np.sqrt(np.maximum(0.0, ee - 2 * m * en + m * m * nn)) / total
    return np.divide(m, sd, out=np.zeros_like(m), where=sd > 0)


def wild_p(sums: DataFrame, draws: int, seed: int, two_sided: bool = True) -> DataFrame:
    """One row (mean, t, p): wild cluster bootstrap of mean zero, with Rademacher signs; none without clusters."""
    sums = written(sums, "sums")
    c = cr0(sums).first()
    if c is None or c["mean"] is None:
        return sums.sparkSession.createDataFrame([], "mean double, t double, p double")
    mean, total = c["mean"], float(c["n"])

    def part(b: pd.DataFrame) -> np.ndarray:
        r, n = b["s"].to_numpy() - b["n"].to_numpy() * mean, b["n"].to_numpy().astype(float)
        return np.concatenate([D.signs(seed, draws, b["cluster"]) @ np.stack([r, r * n], 1), [[r @ r, n @ n]]])

    x = D.summed_rows(D.dealt(sums.select("cluster", "s", "n"), "cluster"), part, draws + 1, 2)
    t = mean / c["se"] if c["se"] > 0 else 0.0
    p = _beyond(_studentised(x[:-1, 0], x[:-1, 1], x[-1, 0], x[-1, 1], total), t, two_sided)
    return sums.sparkSession.createDataFrame([(mean, float(t), p)], "mean double, t double, p double")


def wild_tests(sums: DataFrame, contrast: str, draws: int, seed: int) -> DataFrame:
    """(contrast, mean, clusters, t, p): wild_p of every contrast, two-sided; a cluster's sign is one for all of them."""
    sums = written(sums, "sums")
    base = sorted(cr0(sums, contrast).collect(), key=lambda r: r[contrast])  # a row per contrast
    kind, places, k = sums.schema[contrast].dataType.simpleString(), {r[contrast]: i for i, r in enumerate(base)}, len(base)
    schema = f"{contrast} {kind}, mean double, clusters long, t double, p double"
    if not k:
        return sums.sparkSession.createDataFrame([], schema)
    mean = np.array([r["mean"] for r in base])

    def part(b: pd.DataFrame) -> np.ndarray:
        e, n = np.zeros((len(b), k)), np.zeros((len(b), k))
        for i, of in enumerate(b["of"]):
            for x in of:
                at = places[x[contrast]]
                e[i, at], n[i, at] = x["s"] - x["n"] * mean[at], x["n"]
        fixed = np.stack([np.concatenate([(e * e).sum(0), (n * n).sum(0)])])
        return np.concatenate([D.signs(seed, draws, b["cluster"]) @ np.concatenate([e, e * n], 1), fixed])

    x = D.summed_rows(D.dealt(sums, "cluster").groupBy("cluster").agg(F.collect_list(F.struct(contrast, "s", "n")).alias("of")), part, draws + 1, 2 * k)
    t_b = _studentised(x[:-1, :k], x[:-1, k:], x[-1, :k], x[-1, k:], np.array([float(r["n"]) for r in base]))
    rows = [(r[contrast], float(r["mean"]), int(r["clusters"]), t := float(r["mean"] / r["se"]) if r["se"] > 0 else 0.0, _beyond(t_b[:, i], t, True)) for i, r in enumerate(base)]
    return sums.sparkSession.createDataFrame(rows, schema)


def binomial_tail(k: int, n: int) -> float:
    """P(X >= k) of n fair coins, as a regularised incomplete beta function by its continued fraction."""
    if k <= 0:
        return 1.0
    if k > n:
        return 0.0
    a, b = float(k), float(n - k + 1)
    if a < b:  # the fraction converges on the other side
        return 1.0 - binomial_tail(n - k + 1, n)
    x, tiny = 0.5, 1e-300
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a + b) * math.log(x)) / a
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, front * f)


def _sign_p(two_sided: bool):
    @F.pandas_udf("double")
    def p(wins: pd.Series, n: pd.Series) -> pd.Series:
        if two_sided:
            return pd.Series([min(1.0, 2 * binomial_tail(max(w, m - w), m)) if m else 1.0 for w, m in zip(wins, n)], dtype=float)
        return pd.Series([binomial_tail(w, m) if m else 1.0 for w, m in zip(wins, n)], dtype=float)

    return p


def sign_test(df: DataFrame, value: str, *by: str, two_sided: bool = True, also: Sequence[Column] = ()) -> DataFrame:
    """(*by, wins, n, p): exact binomial test on non-zero values, two-sided or of more wins than losses; 1 if there are none.
    also: aggregates that come along, so that rows are read once."""
    x = df.groupBy(*by).agg(*also, F.coalesce(F.sum((F.col(value) > 0).cast("long")), F.lit(0)).alias("wins"), F.coalesce(F.sum((F.col(value) != 0).cast("long")), F.lit(0)).alias("n"))
    return x.withColumn("p", _sign_p(two_sided)("wins", "n"))


def signed_rank_p(n: int, w: float, z: float, ties: bool, two_sided: bool) -> float:
    """p of the signed-rank sum w of n values: exact for 50 values or fewer without ties, else from the normal score z."""
    if not n:
        return 1.0
    if n <= 50 and not ties:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[: len(ways) - r]
        ways /= 2.0**n
        upper, lower = ways[int(w) :].sum(), ways[: int(w) + 1].sum()
        return float(min(1.0, 2 * min(upper, lower)) if two_sided else upper)
    tail = lambda t: 0.5 * math.erfc(t / math.sqrt(2))
    return 2 * tail(abs(z)) if two_sided else tail(z)


def wilcoxon(df: DataFrame, value: str, *by: str, two_sided: bool = True) -> DataFrame:
    """(*by, n, w, z, p): signed-rank statistic of non-zero values with average ranks, its normal score, and p.

    Sizes are counted, and counted again in buckets of their logarithms: ranks are sums over buckets of bounded
    number and over the sizes of one bucket.
    """
    x = df.where(F.col(value) != 0).groupBy(*by, F.abs(value).cast("double").alias("size")).agg(F.count(F.lit(1)).alias("ties"), F.sum((F.col(value) > 0).cast("long")).alias("up"))
    x = x.withColumn("bucket", F.floor(F.log2("size") * 64))
    buckets = x.groupBy(*by, "bucket").agg(F.sum("ties").alias("in_bucket"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    buckets = buckets.withColumn("before", F.sum("in_bucket").over(w.orderBy("bucket")) - F.col("in_bucket"))
    inside = Window.partitionBy(*by, "bucket").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("upto", F.sum("ties").over(inside)).join(buckets, [*by, "bucket"])
    x = x.withColumn("rank", F.col("before") + F.col("upto") - (F.col("ties") - 1) / 2.0)
    n, t = F.sum("ties"), F.sum(F.pow("ties", F.lit(3)) - F.col("ties"))
    z = (F.sum(F.col("up") * F.col("rank")) - n * (n + 1) / 4.0) / F.sqrt(n * (n + 1.0) * (2 * n + 1) / 24.0 - t / 48.0)
    x = x.groupBy(*by).agg(n.alias("n"), F.sum(F.col("up") * F.col("rank")).alias("w"), z.alias("z"), (F.max("ties") > 1).alias("tied"))

    @F.pandas_udf("double")
    def p(n: pd.Series, w: pd.Series, z: pd.Series, tied: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_p(int(a), b, c, bool(t), two_sided) if a and a > 0 else 1.0 for a, b, c, t in zip(n, w, z, tied)], dtype=float)

    return x.withColumn("p", p("n", "w", "z", "tied")).drop("tied")


def benjamini_hochberg(df: DataFrame, p: str, tie: str, buckets: int = 65_536) -> DataFrame:
    """df (one row per test) with q, which depends on p alone. tie: not looked at, equal ones share their q.

    Different p are counted, ranked over buckets of p and inside one bucket, and the least ratios run back likewise.
    The tests are written first: a p that is a mean would differ in its last bit when it is read again, and miss its q.
    """
    df = written(df, "tests")
    k = df.groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.floor(F.col("_p") * buckets))
    w = Window.partitionBy(F.lit(0)).orderBy("_b")
    bucket = k.groupBy("_b").agg(F.sum("_n").alias("_all")).withColumn("_before", F.sum("_all").over(w) - F.col("_all"))  # `buckets` rows at most
    m = df.agg(F.count(p).alias("_m"))
    inside = Window.partitionBy("_b").orderBy("_p")
    k = k.join(bucket, "_b").crossJoin(F.broadcast(m)).withColumn("_r", F.col("_p") * F.col("_m") / (F.col("_before") + F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0))))
    k = k.withColumn("_low", F.min("_r").over(inside.rowsBetween(0, Window.unboundedFollowing)))
    later = k.groupBy("_b").agg(F.min("_r").alias("_least")).withColumn("_later", F.min("_least").over(w.rowsBetween(1, Window.unboundedFollowing)))
    q = k.join(later, "_b").select("_p", F.least(F.lit(1.0), "_low", "_later").alias("q"))
    return df.join(q, df[p] == q["_p"], "left").drop("_p")


def westfall_young(sums: DataFrame, contrast: str, draws: int, seed: int, families: list[list] | None = None) -> DataFrame:
    """(contrast, t, p, p_single): step-down max-T over contrasts; every draw flips a cluster's sign in all of them
    together. p_single is each contrast's own p, of no family. families: contrasts that are adjusted together, if not
    all of them; their clusters' signs are drawn once.

    A cluster's sums of all contrasts stand in one row, so its sign is drawn once; flipping leaves squares as they
    are, so a draw needs two sums for each contrast, and these are added up in each task.
    """
    sums = written(sums, "sums")
    fixed = sums.groupBy(contrast).agg(F.sum(F.col("s") * F.col("s")).alias("ee"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    base = cr0(sums, contrast).select(contrast, F.col("n").alias("total"), F.when(F.col("se") > 0, F.col("mean") / F.col("se")).otherwise(0.0).alias("t"))
    ranked = sorted(base.join(fixed, contrast).collect(), key=lambda r: (-abs(r["t"]), r[contrast]))  # a row per contrast
    kind, places = sums.schema[contrast].dataType.simpleString(), {r[contrast]: i for i, r in enumerate(ranked)}
    k = len(ranked)
    if not k:
        return sums.sparkSession.createDataFrame([], f"{contrast} {kind}, t double, p double, p_single double")

    def part(b: pd.DataFrame) -> np.ndarray:
        s, n = np.zeros((len(b), k)), np.zeros((len(b), k))
        for i, of in enumerate(b["of"]):
            for x in of:
                s[i, places[x[contrast]]], n[i, places[x[contrast]]] = x["s"], x["n"]
        return D.signs(seed, draws, b["cluster"]) @ np.concatenate([s, s * n], 1)

    of = D.dealt(sums, "cluster").groupBy("cluster").agg(F.collect_list(F.struct(contrast, "s", "n")).alias("of"))
    x = D.summed_rows(of, part, draws, 2 * k)
    column = lambda c: np.array([r[c] for r in ranked], float)
    t = np.abs(_studentised(x[:, :k], x[:, k:], column("ee"), column("nn"), column("total")))
    rows = _stepped_down([(r[contrast], r["t"]) for r in ranked], t, families or [list(places)])
    return sums.sparkSession.createDataFrame(rows, f"{contrast} {kind}, t double, p double, p_single double")


def _stepped_down(ranked: list[tuple], t: np.ndarray, families: list[list]) -> list[tuple]:
    """(name, t, p, p_single) from (name, t) by falling size and the draws' sizes of t, a column for each of them."""
    rows = []
    for family in families:
        at = [i for i, r in enumerate(ranked) if r[0] in family]
        top = np.maximum.accumulate(t[:, at][:, ::-1], axis=1)[:, ::-1]  # the largest from each rank inwards
        p = np.maximum.accumulate([_beyond(top[:, m], ranked[i][1], True) for m, i in enumerate(at)]) if at else []
        rows += [(ranked[i][0], float(ranked[i][1]), float(min(1.0, q)), _beyond(t[:, i], ranked[i][1], True)) for i, q in zip(at, p)]
    return rows


def westfall_young_rows(sums: DataFrame, names: list[str], draws: int, seed: int, families: list[list]) -> DataFrame:
    """westfall_young (name, t, p, p_single) of contrasts that have one row of every cluster. sums: cluster and s, an
    array with a number for each of names; it is shuffled as it stands, with no row per contrast."""
    sums, k = written(D.dealt(sums, "cluster"), "sums"), len(names)
    of = lambda b: np.stack(b["s"].to_list())

    def total(b: pd.DataFrame) -> np.ndarray:
        s = of(b)
        return np.stack([s.sum(0), (s * s).sum(0), np.full(k, float(len(s)))])

    total_s, ee, n = D.summed_rows(sums, total, 3, k)
    out = "name string, t double, p double, p_single double"
    if not n[0]:
        return sums.sparkSession.createDataFrame([], out)
    mean = total_s / n
    se = np.sqrt(D.summed_rows(sums, lambda b: ((of(b) - mean) ** 2).sum(0)[None], 1, k)[0]) / n
    t = np.divide(mean, se, out=np.zeros(k), where=se > 0)
    x = D.summed_rows(D.dealt(sums, "cluster"), lambda b: D.signs(seed, draws, b["cluster"]) @ of(b), draws, k)
    t_b = np.abs(_studentised(x, x, ee, n, n))
    order = sorted(range(k), key=lambda i: (-abs(t[i]), names[i]))
    return sums.sparkSession.createDataFrame(_stepped_down([(names[i], t[i]) for i in order], t_b[:, order], families), out)


def paired_contrast(x: DataFrame, draws: int, seed: int, *by: str, two_sided: bool = True) -> DataFrame:
    """One row for each contrast (by), from rows (*by, cluster, delta, and truncated if known).

    The sign test speaks for the direction and the mean for the size; both intervals are BCa over clusters, those of
    the win rate with draws of their own. p_adjusted is null until the family is known.
    """
    x = written(x.select(*by, "cluster", "delta", *[c for c in x.columns if c == "truncated"]), "deltas")
    deltas = cluster_sums(x, "cluster", "delta", *by)
    wins = cluster_sums(x.withColumn("won", (F.col("delta") > 0).cast("double")), "cluster", "won", *by)
    truncated = F.sum(F.col("truncated").cast("long")) if "truncated" in x.columns else F.lit(0).cast("long")
    parts = [
        cr0(deltas, *by).select(*by, F.col("n").alias("n_items"), F.col("clusters").alias("n_clusters"), F.col("mean").alias("mean_delta"), F.col("se").alias("cluster_se"), F.when(F.col("se") > 0, F.col("mean") / F.col("se")).otherwise(0.0).alias("t_stat")),
        x.groupBy(*by).agg(F.coalesce(F.stddev_samp("delta"), F.lit(0.0)).alias("sd_delta"), truncated.alias("n_truncated")),
        bca_interval(deltas, draws, seed, 0.95, *by).select(*by, F.col("lo").alias("ci_low"), F.col("hi").alias("ci_high")),
        bca_interval(wins, draws, seed + 1, 0.95, *by).select(*by, F.col("lo").alias("win_ci_low"), F.col("hi").alias("win_ci_high")),
        sign_test(x, "delta", *by, two_sided=two_sided).select(*by, F.coalesce(F.col("wins") / F.nullif("n", F.lit(0)), F.lit(0.5)).alias("win_rate"), F.col("p").alias("p_sign")),
        wilcoxon(x, "delta", *by, two_sided=two_sided).select(*by, F.col("p").alias("p_wilcoxon")),
    ]
    out = parts[0]
    for y in parts[1:]:
        out = out.join(y, [*by], "left") if by else out.crossJoin(y)  # one row each
    return out.withColumn("p_wilcoxon", F.coalesce("p_wilcoxon", F.lit(1.0))).withColumn("two_sided", F.lit(two_sided)).withColumn("p_adjusted", F.lit(None).cast("double"))


def adjust_family(rows: DataFrame, name: str, sums: DataFrame | None = None, draws: int = 2_000, seed: int = 0, p: str = "p_sign") -> DataFrame:
    """rows (one per contrast of a family) with p_adjusted: Westfall-Young where the deltas' cluster sums are at hand, else Benjamini-Hochberg."""
    rows = rows.drop("p_adjusted")
    if sums is None:
        return benjamini_hochberg(rows, p, name).withColumnRenamed("q", "p_adjusted")
    return rows.join(westfall_young(sums, name, draws, seed).select(name, F.col("p").alias("p_adjusted")), name)


def centred(df: DataFrame, value: str, *template: str) -> DataFrame:
    """df with centred: the value less its template's mean. The means are aggregated first, so that rows needn't meet."""
    means = df.groupBy(*template).agg(F.avg(value).alias("_mean"))
    return df.join(means, [*template]).withColumn("centred", F.col(value) - F.col("_mean")).drop("_mean")


def _gap_test(null: DataFrame, observed: DataFrame, draws: int, *by: str) -> DataFrame:
    """null: *by, b, gap_b; observed: *by, gap, one row of each."""
    both = null.join(F.broadcast(observed), [*by]) if by else null.crossJoin(F.broadcast(observed))
    return both.groupBy(*observed.columns).agg(((F.sum((F.col("gap_b") >= F.col("gap") - 1e-12).cast("long")) + 1) / F.lit(draws + 1.0)).alias("p"), F.avg("gap_b").alias("null_mean"), F.percentile("gap_b", 0.95).alias("null_p95"))


def omnibus(names: DataFrame, draws: int, seed: int, *by: str) -> DataFrame:
    """(*by, gap, p): is the largest gap between group means more than chance? names: *by, name, grp, stratum, m. One
    row if there is no by, else one for each of its values (without null), which are tested apart.

    A draw deals the groups of a stratum out to its names in hash order.
    """
    names = written(names.select(*by, "name", "grp", "stratum", "m"), "names")
    means = names.groupBy(*by, "grp").agg(F.avg("m").alias("g"))
    observed = means.groupBy(*by).agg((F.max("g") - F.min("g")).alias("gap"))
    if _largest(names, *by, "stratum") > D.MOST_UNITS:
        slots = names.withColumn("slot", F.row_number().over(Window.partitionBy(*by, "stratum").orderBy("grp", "name"))).select(*by, "stratum", "slot", "grp")
        dealt = names.select(*by, "stratum", "name", "m", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b"))
        dealt = dealt.withColumn("slot", F.row_number().over(Window.partitionBy(*by, "b", "stratum").orderBy(hashed(F.lit(seed), F.col("b"), F.col("name")), "name")))
        sums = dealt.join(slots, [*by, "stratum", "slot"]).groupBy(*by, "b", "grp").agg(F.sum("m").alias("s"), F.count("m").alias("n"))
    else:
        listed = lambda order: F.array_sort(F.collect_list(F.struct(*order))).alias(f"by_{order[0]}")
        x = names.groupBy(*by, "stratum").agg(listed(["grp", "name"]), listed(["name", "m"])).select(*by, "stratum", F.col("by_grp")["grp"].alias("grp"), F.col("by_name")["name"].alias("name"), F.col("by_name")["m"].alias("m"))

        def one(r: dict, b: int) -> list[tuple]:
            m = r["m"][np.argsort(D.hashes(f"{seed}:{b}:", D.encoded(r["name"])), kind="stable")]
            kinds, at = np.unique(r["grp"], return_inverse=True)
            return list(zip(kinds.tolist(), np.bincount(at, m).tolist(), np.bincount(at).tolist()))

        sums = D.per_draw(x, draws, one, f"grp {dict(names.dtypes)['grp']}, s double, n long", [*by, "stratum"])
    null = sums.groupBy(*by, "b", "grp").agg((F.sum("s") / F.sum("n")).alias("g")).groupBy(*by, "b").agg((F.max("g") - F.min("g")).alias("gap_b"))
    return _gap_test(null, observed, draws, *by)


def within_template(cells: DataFrame, draws: int, seed: int) -> DataFrame:
    """One row (gap, p, null_p95, n_levels, n_templates): is the largest gap between level means more than chance?

    cells: template, level, score, each level once or never in a template; levels are few. Scores are centred in their
    template, and a draw deals each template's scores out to its levels anew, in hash order.
    """
    cells = written(cells.select("template", "level", "score"), "cells")
    x = centred(cells, "score", "template")
    gap = (F.max("m") - F.min("m"))
    observed = x.groupBy("level").agg(F.avg("centred").alias("m")).agg(gap.alias("gap"), F.count(F.lit(1)).alias("n_levels"))
    levels = {r[0]: i for i, r in enumerate(cells.select("level").distinct().collect())}
    c = F.col("c")
    of = D.dealt(x, "template").groupBy("template").agg(F.array_sort(F.collect_list(F.struct("level", "centred"))).alias("c")).select("template", c["level"].alias("level"), c["centred"].alias("centred"))

    def part(block: pd.DataFrame) -> np.ndarray:
        out = np.zeros((draws, 2 * len(levels)))
        for template, level, v in zip(D.encoded(block["template"]), block["level"], block["centred"]):
            at, keys = np.array([levels[k] for k in level]), [template + b":" + k for k in D.encoded(level)]
            for b in range(draws):
                out[b, at] += v[np.argsort(D.hashes(f"{seed}:{b}:", keys), kind="stable")]
            out[:, at + len(levels)] += 1
        return out

    sums = D.summed_rows(of, part, draws, 2 * len(levels))
    means = sums[:, : len(levels)] / sums[:, len(levels) :]
    null = cells.sparkSession.createDataFrame([(b, float(m.max() - m.min())) for b, m in enumerate(means)], "b int, gap_b double")  # a row per draw
    return _gap_test(null, observed, draws).drop("null_mean").crossJoin(cells.agg(F.countDistinct("template").alias("n_templates")))


def half_split(names: DataFrame, draws: int, seed: int) -> DataFrame:
    """One row (mean_gap, p95, n): gaps between random halves of groups of four names or more."""
    names = written(names.select("grp", "name", "m"), "names")
    sizes = names.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).where("size >= 4")
    if _largest(names, "grp") > D.MOST_UNITS:
        x = names.join(sizes, "grp").select("grp", "name", "m", "size", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b"))
        x = x.withColumn("rank", F.row_number().over(Window.partitionBy("b", "grp").orderBy(hashed(F.lit(seed), F.col("b"), F.col("name")), "name")))
        first = F.col("rank") <= F.floor(F.col("size") / 2)
        gaps = x.groupBy("b", "grp").agg(F.abs(F.avg(F.when(first, F.col("m"))) - F.avg(F.when(~first, F.col("m")))).alias("gap"))
    else:
        c = F.col("c")
        x = names.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("name", "m"))).alias("c")).where(F.size("c") >= 4).select("grp", c["name"].alias("name"), c["m"].alias("m"))

        def one(r: dict, b: int) -> list[tuple]:
            m, half = r["m"][np.argsort(D.hashes(f"{seed}:{b}:", D.encoded(r["name"])), kind="stable")], len(r["m"]) // 2
            return [(float(abs(m[:half].mean() - m[half:].mean())),)]

        gaps = D.per_draw(x, draws, one, "gap double", ["grp"])
    return gaps.agg(F.avg("gap").alias("mean_gap"), F.percentile("gap", 0.95).alias("p95"), F.count(F.lit(1)).alias("n"))
