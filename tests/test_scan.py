"""Corpora from small files, saved runs, missing preferences, and a whole scan."""

import json

import pytest

from plumbline.functions.scoring import cache_key
from plumbline.plans import scan
from plumbline.sources import corpora
from plumbline.sources.tables import answers
from pyspark.sql import functions as F

from .conftest import DATA


def saved(tmp_path, name, value):
    (tmp_path / name).write_text(json.dumps(value))
    return str(tmp_path / name)


def test_identity_and_descriptor_arms(spark, tmp_path):
    t = [{"id": "t1", "domain": "d", "distribution": "ood", "question": "Is {name} {desc}?", "response": "{name} is, {name}."}]
    path = saved(tmp_path, "i.json", {"name_groups": {"a": ["Ann", "Al"], "b": ["Bo"]}, "templates": t, "descriptor_axes": {"age": ["old", "young"]}, "descriptor_templates": t})
    got = {(r["grp"], r["name"]): (r["question"], r["text"]) for r in corpora.identity_arms(spark, path).collect()}
    assert got["b", "Bo"] == ("Is Bo {desc}?", "Bo is, Bo.") and len(got) == 3
    assert sorted(r["question"] for r in corpora.descriptor_arms(spark, path).collect()) == ["Is {name} old?", "Is {name} young?"]
    n = {(r["corpus"], r["collection"]): r["n"] for r in corpora.inventory(spark, {"identity": (path, corpora.IDENTITY)}).collect()}
    assert n["identity", "name_groups"] == 2 and n["identity", "templates"] == 1


def test_sycophancy_arms(spark, tmp_path):
    path = saved(tmp_path, "s.json", {"scenarios": [{"id": "s1", "topic": "x", "prompts": {"neutral": "n", "emotional": "e"}, "responses": {"agrees_warm": "1", "corrects_blunt": "2"}}]})
    got = corpora.sycophancy_arms(spark, path).collect()
    assert len(got) == 4 and {(r["agrees"], r["tone"]) for r in got} == {(True, "warm"), (False, "blunt")}


def test_attacks_and_questions(spark, tmp_path):
    lib = {"affixes": [{"id": "a", "family": "authority", "text": "x", "positions": ["prefix", "suffix"]}, {"id": "n", "family": "neutral_control", "text": "y", "positions": ["prefix", "suffix"]}, {"id": "b", "family": "authority", "text": "z", "positions": ["prefix"]}], "bases": [{"id": "b1", "type": "rude", "text": "r1"}, {"id": "b2", "type": "rude", "text": "r2"}, {"id": "b3", "type": "offtopic", "text": "o"}]}
    path = saved(tmp_path, "a.json", lib)
    assert corpora.attack_affixes(spark, path).count() == 5
    assert sorted((r["affix_id"], r["position"]) for r in corpora.attack_affixes(spark, path, ["a", "n"]).collect()) == [("a", "suffix"), ("n", "prefix"), ("n", "suffix")]
    q = corpora.style_questions(spark, saved(tmp_path, "q.json", {"questions": [{"id": "q1", "question": "?", "neutral_answer": "N.", "paraphrases": ["P."], "elaboration": "E. F.", "wrong_answer": "W", "poor_answer": "O"}, {"id": "q2", "neutral_answer": "M."}]}))
    assert {r["id"]: r["references"] for r in q.collect()} == {"q1": ["N.", "P.", "N. E. F."], "q2": ["M.", "M."]}
    got = sorted((r["question_id"], r["base_id"]) for r in corpora.attack_bases(spark, path, q, reduced=True).collect())
    assert got == sorted((i, b) for i in ("q1", "q2") for b in ("b1", "b3", "wrong", "poor"))


def test_reduced_grid_keeps_what_the_analysis_needs(spark, tmp_path):
    a = lambda i, f, *ps: {"id": i, "family": f, "text": i, "positions": list(ps)}
    both = ("prefix", "suffix")
    lib = {"affixes": [a("x1", "special_token", *both), a("x2", "special_token", "suffix"), a("n", "neutral_control", *both), a("other", "authority", *both), a("official", "authority", *both), a("new1", "new_family", "prefix"), a("new2", "new_family", *both)], "bases": []}
    got = sorted((r["affix_id"], r["position"]) for r in corpora.attack_affixes(spark, saved(tmp_path, "a.json", lib), reduced=True).collect())
    assert got == [("n", "prefix"), ("n", "suffix"), ("new1", "prefix"), ("official", "suffix"), ("x1", "suffix"), ("x2", "suffix")]
    q = corpora.style_questions(spark, saved(tmp_path, "q.json", {"questions": [{"id": "q1", "neutral_answer": "N.", "wrong_answer": "W", "poor_answer": "O"}]}))
    assert [r["base_id"] for r in corpora.attack_bases(spark, saved(tmp_path, "a.json", lib), q, own_only=True).collect()] == ["wrong", "poor"]


def test_saved_runs_and_missing_preferences(spark, tmp_path):
    saved(tmp_path, "b.json", {})
    saved(tmp_path, "a.json", {})
    saved(tmp_path, "c.txt", {})
    assert [r["path"].rsplit("/", 1)[1] for r in corpora.saved_runs(spark, str(tmp_path)).collect()] == ["a.json", "b.json"]
    found, note = corpora.preferences(spark, str(tmp_path / "none"))
    assert found.count() == 0 and "unavailable" in note


def test_scan_goes_on_where_it_was(spark, tmp_path):
    got = scan.run_scan(spark, DATA, str(tmp_path), probes=("style", "sycophancy"))
    assert set(got) == {"style_contrasts", "sycophancy_premiums", "calibration_gaps", "findings"}
    rows = got["style_contrasts"].collect()
    assert len(rows) == 3 and all(r["ci_low"] <= r["mean_delta"] <= r["ci_high"] and 0 < r["p_adjusted"] <= 1 for r in rows)
    assert {r["two_sided"] for r in got["sycophancy_premiums"].collect()} == {False}
    again = scan.run_scan(spark, DATA, str(tmp_path), probes=("style", "sycophancy"))
    assert {r["name"]: r["ci_low"] for r in again["style_contrasts"].collect()} == {r["name"]: r["ci_low"] for r in rows}
    with pytest.raises(ValueError):
        scan.steps(probes=("other",))


def test_stacks_are_scored_again_on_held_out_items(spark):
    got = scan.searched(spark, DATA, 2, 2)["stacks"].collect()
    assert len(got) == 2 and all(r["n"] > 0 and r["heldout_lift"] is not None for r in got)


def test_rehearsal_counts_what_the_cache_lacks(spark):
    keys = answers(spark, DATA).select(cache_key(F.col("question"), F.col("answer")).alias("key")).distinct()
    got = {r["step"]: (r["texts"], r["to_score"]) for r in scan.rehearse(spark, DATA, keys.limit(10), "standard").collect()}
    n = keys.count()
    assert got["noise_floor"] == (n, n - 10) and got["identity"] == (n, 0) and got["reward_hacking"][1] is None
