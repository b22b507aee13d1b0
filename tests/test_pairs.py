"""All pairs against numpy, on continuous and tied values, and the growth of the work."""

import numpy as np
import pytest

from plumbline.operators import pairs


def values(spark, kinds=("even", "tied", "heavy", "two")):
    rng = np.random.default_rng(5)
    of = {"even": rng.random(160), "tied": rng.integers(0, 7, 140) * 0.25, "heavy": np.exp(rng.normal(0, 4, 120)), "two": np.array([1.0, 4.0]), "alone": np.array([3.0])}
    rows = [(g, float(x)) for g in (*kinds, "alone") for x in of[g]] + [("even", None)]
    frame = spark.createDataFrame(rows, "g string, x double").repartition(4)
    return of, pairs.valued(frame, "x", "g")


def differences(x):
    return np.abs(x[:, None] - x[None, :])[np.triu_indices(len(x), 1)]


def test_pairs_below_thresholds(spark):
    of, v = values(spark)
    t = [(g, k, x) for g in of for k, x in enumerate([0.0, 0.1, 0.25000001, 3.0000001, 1e9])]
    got = {(r["g"], int(r["k"])): r["below"] for r in pairs.pairs_below(v, spark.createDataFrame(t, "g string, k int, t double"), "g").collect()}
    assert got == {(g, k): int((differences(of[g]) < x).sum()) for g, k, x in t}


@pytest.mark.parametrize("most", [None, 30])
def test_levels_and_moments(spark, most):
    of, v = values(spark)
    got = {r["g"]: r["q"] for r in pairs.pair_levels(v, 0.95, "g", most=most).collect()}
    assert got == pytest.approx({g: np.quantile(differences(x), 0.95) for g, x in of.items() if g != "alone"})
    for r in pairs.pair_moments(v, "g").collect():
        d = differences(of[r["g"]])
        assert (r["pairs"], r["sq"]) == (len(d), pytest.approx((d**2).sum(), rel=1e-9, abs=1e-9))


def test_work_grows_with_the_values_not_with_the_pairs(spark):
    """Rows that are merged: values and asked points, whatever the number of pairs."""
    for n in (500, 2000):
        x = pairs.valued(spark.createDataFrame([(float(i * i % 7919),) for i in range(n)], "x double"), "x")
        t = spark.createDataFrame([("a", 5.0), ("b", 500.0)], "k string, t double")
        own = x.withColumn("_one", pairs.F.lit(0))
        asked = own.join(t.withColumn("_one", pairs.F.lit(0)), "_one").count()
        assert asked == 2 * x.count() <= 2 * n
        d = differences(np.array([float(i * i % 7919) for i in range(n)]))
        assert {r["k"]: r["below"] for r in pairs.pairs_below(x, t).collect()} == {"a": int((d < 5).sum()), "b": int((d < 500).sum())}


@pytest.mark.parametrize("most", [None, 50])
def test_a_level_over_all_groups(spark, most):
    of, v = values(spark)
    every = np.concatenate([differences(x) for x in of.values()])
    for level in (0.5, 0.95):
        assert pairs.pooled_level(v, level, "g", most=most) == pytest.approx(np.quantile(every, level))
    assert pairs.pooled_level(v.where("g = 'alone'"), 0.5, "g") is None


def test_pairs_are_counted_in_blocks(spark, monkeypatch):
    """Many small blocks, equal values over their ends and several groups give what all pairs give."""
    import numpy as np

    monkeypatch.setattr(pairs, "LEAST_BLOCK", 7)
    monkeypatch.setattr(pairs, "MOST_BLOCK", 7)
    rng = np.random.default_rng(11)
    of = {"a": rng.integers(0, 40, 300) / 8, "b": rng.normal(size=90), "c": np.array([2.0])}
    v = pairs.valued(spark.createDataFrame([(g, float(x)) for g, xs in of.items() for x in xs], "g string, x double"), "x", "g")
    blocks = pairs.blocked(v, "g")
    assert blocks.selectExpr("max(size(v))").first()[0] <= 7 and blocks.selectExpr("sum(n)").first()[0] == sum(map(len, of.values()))
    ts = [0.0, 0.125, 0.5, 1.0, 3.3, 99.0]
    got = pairs.pairs_below(v, spark.createDataFrame([(g, k, t) for g in of for k, t in enumerate(ts)], "g string, k int, t double"), "g", blocks=blocks).collect()
    want = {(g, str(k)): int((np.abs(xs[:, None] - xs[None])[np.triu_indices(len(xs), 1)] < t).sum()) for g, xs in of.items() for k, t in enumerate(ts)}
    assert {(r["g"], r["k"]): r["below"] for r in got} == want
