"""Exact quantiles against numpy, for ranges that must be narrowed several times."""

import numpy as np
import pytest

from plumbline.operators.quantiles import quantiles


@pytest.mark.parametrize("most", [None, 700, 3])
def test_quantiles_of_many_groups(spark, most):
    rng = np.random.default_rng(1)
    groups = {"normal": rng.normal(0, 1, 3000), "heavy": np.exp(rng.normal(0, 8, 2000)), "ties": rng.integers(0, 5, 4000).astype(float), "one": np.array([7.0]), "same": np.full(900, -2.5), None: rng.random(50)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("one", None), ("empty", None)]
    levels = [0.0, 0.05, 0.25, 0.5, 0.9, 0.95, 1.0]
    got = {r["g"]: r for r in quantiles(spark.createDataFrame(rows, "g string, x double").repartition(5), "x", levels, "g", most=most).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert got[g]["n"] == len(v) and got[g]["q"] == pytest.approx(np.quantile(v, levels), rel=1e-12), g


def test_weights_and_no_groups(spark):
    rows = [(float(v), c) for v, c in zip([3, 1, 2, 9], [2, 1, 0, 4])]
    got = quantiles(spark.createDataFrame(rows, "x double, c long"), "x", [0.25, 0.5], weight="c").first()
    assert got["q"] == pytest.approx(np.quantile([1, 3, 3, 9, 9, 9, 9], [0.25, 0.5]))
    assert quantiles(spark.createDataFrame([], "x double"), "x", [0.5]).count() == 0
