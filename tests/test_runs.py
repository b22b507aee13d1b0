"""Runs saved, read back and brought to today's terms; what a prompt looks like to a model."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import stimuli
from plumbline.functions.scoring import cache_key
from plumbline.plans import runs as whole
from plumbline.sources import runs

from .conftest import DATA


def finding(category, kind, effect, asr=None, **more):
    f = {"category": category, "title": f"{category} {kind}", "effect": effect, "noise_percentile": 50.0, "p_adjusted": 0.001, "p_raw": 0.001, "confirmed": False, "valence": "vulnerability", "band": "Low", "n_items": 10, "systematic_bar": 0.5}
    return f | {"detail": {"kind": kind, "module": category}} | ({"asr": {"p50": asr, "p25": 0.9}} if asr is not None else {}) | more


def test_old_files_in_todays_terms(spark, tmp_path):
    old = {
        "meta": {"model_id": "m", "probes": ["style", "injection"], "steps": ["noise_floor", "injection"], "platform": "x"}, "injection": {"summary": {"baseline_asr": {"p50": 0.4, "p90": 0.1}}},
        "findings": [finding("injection", "key_contrast", 3.0), finding("injection", "best_affix", 3.0, 0.4), finding("injection", "beam_search", 3.0, 0.41), finding("style", "length_adjusted", 1.2), finding("style", "main", 0.1, p_adjusted=None, p_raw=0.5)],
        "severity": {"style": {"category": "style", "band": "High"}},
    }
    (tmp_path / "m__quick__seed0.json").write_text(json.dumps(old, indent=1))
    (tmp_path / "bare.json").write_text("{}")
    (tmp_path / "none.json").write_text('{"meta": {"model_id": "n"}, "findings": []}')
    read = runs.read_runs(spark, str(tmp_path))
    assert {r["run"] for r in read.collect()} == {"m__quick__seed0.json", "bare.json", "none.json"}
    x = {(r["category"], r["kind"]): r for r in runs.migrated(read).collect()}
    assert {k: r["valence"] for k, r in x.items() if k[0] == "reward_hacking"} == {("reward_hacking", "key_contrast"): "informational", ("reward_hacking", "best_affix"): "informational", ("reward_hacking", "beam_search"): "vulnerability"}
    assert x["style", "length_adjusted"]["band"] == "Moderate" and x["style", "main"]["band"] == "Unconfirmed" and not x["style", "main"]["confirmed"]
    r = x["reward_hacking", "key_contrast"]
    assert r["probes"] == ["style", "reward_hacking"] and r["steps"] == ["noise_floor", "reward_hacking"] and r["module"] == "reward_hacking"
    tiles = {r["category"]: r for r in runs.severities(runs.migrated(read)).collect()}
    assert len(tiles) == 4 and tiles["style"]["band"] == "Moderate" and tiles["style"]["n_contrasts"] == 2 and tiles["identity"]["band"] == "None detected"
    assert tiles["reward_hacking"]["n_vulnerabilities"] == 1 and tiles["reward_hacking"]["band"] == "High"


def test_broken_files_raise(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"findings": [')
    with pytest.raises(Exception):
        runs.read_runs(spark, str(tmp_path)).collect()


def test_an_exported_run_reads_as_it_was(spark, tmp_path):
    path = whole.export_run(spark, DATA, str(tmp_path), "lab/length", probes=("style",))
    assert path.endswith("/runs/lab__length__quick__seed0.json")
    r, = runs.read_runs(spark, f"{tmp_path}/runs").collect()
    assert r["run"] == "lab__length__quick__seed0.json" and r["meta"]["results_path"] == path and r["meta"]["probes"] == ["style"] and r["meta"]["steps"] == ["noise_floor", "calibration", "style"]
    assert r["noise_floor"]["sd"] > 0 and r["noise_floor"]["pairs"] > 0 and r["sanity_check"]["margin"] == pytest.approx(r["sanity_check"]["helpful_score"] - r["sanity_check"]["rude_score"])
    assert set(r["severity"]) == {"identity", "sycophancy", "style", "reward_hacking"} and {f["category"] for f in r["findings"]} == {"style"}
    again = {t["category"]: t.asDict() for t in runs.severities(runs.migrated(runs.read_runs(spark, f"{tmp_path}/runs"))).drop("run").collect()}
    assert again == {k: v.asDict() for k, v in r["severity"].items()}
    assert whole.export_run(spark, DATA, str(tmp_path), "lab/length", probes=("style",)) == path


def test_prompts_by_model(spark):
    x = spark.createDataFrame([("q", "hh-model"), ("q", "other"), ("q", None), (None, "hh-model")], "q string, m string")
    got = [r[0] for r in x.select(stimuli.prompted(F.col("q"), F.col("m"), {"hh-model": "hh"})).collect()]
    assert got == ["\n\nHuman: q \n\nAssistant:", "q", "q", None]
    keys = x.limit(1).select(*[cache_key(F.col("q"), F.lit("a"), form=f).alias(f) for f in ("bare", "hh")]).first()
    assert keys["bare"] != keys["hh"]
