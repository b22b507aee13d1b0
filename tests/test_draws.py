"""Draws made in blocks: the same as those that are shuffled, and no rows of (draw, cluster)."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import draws, resampling


def panel(spark, clusters=23, groups=2):
    rng = np.random.default_rng(3)
    rows = [(f"g{g}", c, float(x)) for g in range(groups) for c in range(clusters + g) for x in rng.normal(0.2, 1, 1 + c % 4)]
    return resampling.cluster_sums(spark.createDataFrame(rows, "name string, cluster long, delta double"), "cluster", "delta", "name")


def test_hashes_are_those_of_the_engine(spark):
    from plumbline.functions.text import hashed

    want = [r[0] for r in spark.range(40).select(hashed(F.lit(7), F.lit(3), F.col("id"))).collect()]
    assert draws.hashes("7:3:", draws.encoded(range(40))).tolist() == want
    assert draws.signs(7, 5, ["a", "b"])[3, 1] == (1 if int(hashlib.sha256(b"7:3:b").hexdigest()[:8], 16) % 2 == 0 else -1)


@pytest.mark.parametrize("by", [(), ("name",)])
def test_arrays_and_shuffles_draw_alike(spark, monkeypatch, by):
    sums = panel(spark, groups=2 if by else 1).drop(*([] if by else ["name"]))
    rows = lambda: sorted((tuple(r[c] for c in by), r["b"], round(r["m"], 9)) for r in resampling.bootstrap_means(sums, 40, 5, *by).collect())
    small = rows()
    monkeypatch.setattr(draws, "MOST_UNITS", 0)
    assert small == rows() and len(small) == 40 * (2 if by else 1)


def test_medians_and_deals_alike(spark, monkeypatch):
    counts = spark.createDataFrame([(c, v, 1 + (c * v) % 5) for c in range(9) for v in range(c, c + 12)], "cluster long, v long, c long")
    names = spark.createDataFrame([(i, i % 4, i % 2, float((i * 37) % 11)) for i in range(50)], "name long, grp long, stratum long, m double")

    def all_of():
        medians = sorted((r["b"], r["m"]) for r in resampling.bootstrap_medians(counts, 30, 3).collect())
        return medians, [round(x, 9) for f in (resampling.omnibus, resampling.half_split) for x in f(names, 60, 3).first()]

    small = all_of()
    monkeypatch.setattr(draws, "MOST_UNITS", 0)
    assert all_of() == small
    for b, m in small[0][:5]:
        picked = [int(hashlib.sha256(f"3:{b}:{j}".encode()).hexdigest()[:8], 16) % 9 for j in range(9)]
        assert m == np.median([v for c in picked for v in range(c, c + 12) for _ in range(1 + (c * v) % 5)])


def test_partial_sums_move_a_row_per_draw_and_task(spark):
    """What is shuffled doesn't grow with the clusters."""
    sums = resampling.cluster_sums(spark.range(5_000).select((F.col("id") % 1250).alias("cluster"), F.rand(3).alias("delta")), "cluster", "delta")
    one = resampling.wild_p(sums, 50, 3).first()
    assert 0 < one["p"] <= 1 and one["t"] > 10
    empty = sums.limit(0)
    assert resampling.wild_p(empty, 50, 3).count() == 0
    assert resampling.westfall_young(empty.withColumn("name", F.lit("x")), "name", 50, 3).count() == 0
