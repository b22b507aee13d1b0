"""Temperatures, examples, matching, the search's fields, and a rehearsal against a real run."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import calibration, findings, topk
from plumbline.plans import scan
from plumbline.sources.versions import scores

from .conftest import DATA


def test_temperature_is_the_least_loss(spark):
    rng = np.random.default_rng(2)
    for true in (0.4, 3.0):
        gap = rng.normal(1, 2, 4000) * true
        gap = np.where(rng.random(4000) < 1 / (1 + np.exp(-np.abs(gap) / true)), np.abs(gap), -np.abs(gap))
        got = calibration.fitted_temperature(spark.createDataFrame([(float(g),) for g in gap], "gap double")).first()
        loss = lambda x: np.log1p(np.exp(-np.clip(gap / math.exp(x), -50, 50))).mean()
        grid = np.linspace(math.log(got["temperature"]) - 0.01, math.log(got["temperature"]) + 0.01, 401)
        assert got["temperature"] == pytest.approx(true, rel=0.15)
        assert abs(min(grid, key=loss) - math.log(got["temperature"])) < 1e-4 and got["log_loss"] <= min(map(loss, grid)) + 1e-12
        assert got["n_pairs"] == 4000 and got["accuracy"] == pytest.approx((gap > 0).mean())
    assert calibration.fitted_temperature(spark.createDataFrame([], "gap double")).count() == 0
    assert calibration.fitted_temperature(spark.createDataFrame([(5.0,)], "gap double")).first()["temperature"] == pytest.approx(0.05)


def test_diverse_top_equals_windows(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), int(t), i, float(s)) for i, (g, t, s) in enumerate(zip(rng.integers(0, 3, 300), rng.integers(0, 4, 300), rng.integers(0, 20, 300)))]
    rows += [(0, 1, 900, None)]
    got = topk.diverse_top(spark.createDataFrame(rows, "g int, kind int, id int, score double").repartition(5), ["g"], "kind", "score", "id", 6, rank="kind").collect()
    for g in range(3):
        mine, first = sorted((r for r in rows if r[0] == g and r[3] is not None), key=lambda r: (-r[3], r[2])), []
        for kind in range(4):
            first += [r for r in mine if r[1] == kind][:1]
        want = (first + [r for r in mine if r not in first])[:6]
        assert [r["id"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["place"])] == [r[2] for r in want]


def test_matches_are_used_once(spark):
    a = spark.createDataFrame([("x", "a", 1.0), ("x", "b", 1.0), ("x", "c", 1.0), ("x", "d", 2.0), ("y", "a", 1.0), ("y", "n", None)], "g string, name string, effect double")
    b = spark.createDataFrame([("x", "p", 1.0 + 1e-12, 7), ("x", "q", 1.0, 8), ("x", "r", 2.0 + 1e-6, 9), ("y", "s", 1.0, 3)], "g string, name string, effect double, n int")
    got = {(r["g"], r["name"]): r["match"] and r["match"]["name"] for r in findings.matched_once(a, b, ["g"], "effect", "name").collect()}
    assert {got["x", "a"], got["x", "b"]} == {"p", "q"} and got["x", "c"] is None and got["x", "d"] is None and got["y", "a"] == "s" and got["y", "n"] is None


def test_search_reports_held_out_numbers(spark):
    got = {k: v.collect() for k, v in scan.searched(spark, DATA, 2, 2).items()}
    best, = got["best"]
    assert [r["depth"] for r in got["history"]] == [1, 2] and got["history"][0]["n_candidates"] == 6
    assert best["stack"] == got["stacks"][0]["stack"] == got["history"][-1]["best_stack"] and best["dev_lift"] == got["history"][-1]["best_dev_lift"]
    assert best["ci_low"] <= best["heldout_lift"] <= best["ci_high"] and best["asr_p25"] >= best["asr_p50"] >= best["asr_p90"]
    held = {r["item_id"] for r in scan.attack_bases(spark, DATA).where("not dev").collect()}
    assert best["n_heldout"] == 3 * len(held) and {r["item_id"] for r in got["examples"]} <= held
    lifts = sorted((r for r in got["examples"] if r["list"] == "lift"), key=lambda r: r["place"])
    assert len(lifts) == 10 and [r["lift"] for r in lifts] == sorted((r["lift"] for r in lifts), reverse=True)
    baseline = spark.createDataFrame([(0.5,)], "baseline double")
    f = scan.search_finding(scan.searched(spark, DATA, 1, 1)["best"], baseline).first()
    assert f["kind"] == "beam_search" and f["p_raw"] in (0.0, 1.0)


def test_a_rehearsal_asks_for_what_a_real_scan_scores(spark, tmp_path):
    cache = scores(spark, str(tmp_path / "scores"))
    probes = ("identity", "style", "reward_hacking")
    some = scan.keyed(scan.requests(spark, DATA, ())[0][1]).select("key", F.lit(0.0).alias("score")).limit(50)
    cache.append(some.dropDuplicates(["key"]))
    said = {r["step"]: r["to_score"] for r in scan.rehearse(spark, DATA, cache.read(), probes=probes).collect()}
    assert said == {r["step"]: r["scored"] for r in scan.score_requests(spark, DATA, cache, probes).collect()}
    assert said["identity"] == 0 < said["noise_floor"] < said["style"] and said["calibration"] == 0
    again = {r["step"]: r["to_score"] for r in scan.rehearse(spark, DATA, cache.read(), "standard", probes).collect()}
    assert again == {k: None if k == "reward_hacking" else 0 for k in said}


def test_a_scan_overwrites_nothing_that_it_cannot_read(spark, tmp_path):
    path = tmp_path / "quick" / "calibration_gaps"
    path.mkdir(parents=True)
    (path / "_SUCCESS").write_text("")
    (path / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        scan.run_scan(spark, DATA, str(tmp_path), probes=())
    assert (path / "part-0.parquet").read_text() == "not parquet"
