"""Properties that the analyses must have, on planted data."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import scoring, stimuli
from plumbline.functions.text import sentences
from plumbline.operators import beam, findings, regression, resampling
from plumbline.streaming.scoring import score_stream


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def clustered(spark, mean=0.0, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(g, float(mean + u + rng.normal(0, 0.1))) for g, u in enumerate(rng.normal(0, 1, 40)) for _ in range(5)]
    return frame(spark, rows, "cluster int, delta double")


def test_cluster_error_is_wider_than_row_error(spark):
    x = clustered(spark)
    c = resampling.cr0(resampling.cluster_sums(x, "cluster", "delta")).first()
    row = x.agg(F.stddev_samp("delta")).first()[0] / np.sqrt(200)
    assert c["clusters"] == 40 and c["se"] > 1.5 * row


def test_singletons_give_the_population_error(spark):
    x = frame(spark, [(i, float(i % 7)) for i in range(50)], "cluster int, delta double")
    c = resampling.cr0(resampling.cluster_sums(x, "cluster", "delta")).first()
    v = np.array([i % 7 for i in range(50)], float)
    assert c["se"] == pytest.approx(v.std() / np.sqrt(50))


def test_wild_p_sees_a_planted_mean_and_not_its_absence(spark):
    p = [resampling.wild_p(resampling.cluster_sums(clustered(spark, m), "cluster", "delta"), 199, 5).first()["p"] for m in (0.0, 2.0)]
    assert p[1] <= 0.01 < p[0]


def test_intervals_hold_the_mean(spark):
    s = resampling.cluster_sums(clustered(spark, 1.0), "cluster", "delta")
    r = resampling.bca_interval(s, 300, 3).first()
    assert r["lo"] < r["mean"] < r["hi"]


def test_step_down_p_is_monotone_in_t(spark):
    rows = [(c, g, float(m + e)) for c, m in (("a", 0.0), ("b", 0.5), ("c", 3.0)) for g, e in enumerate(np.random.default_rng(2).normal(0, 1, 30))]
    s = resampling.cluster_sums(frame(spark, rows, "contrast string, cluster int, delta double"), "cluster", "delta", "contrast")
    got = sorted(resampling.westfall_young(s, "contrast", 199, 7).collect(), key=lambda r: -abs(r["t"]))
    assert [r["p"] for r in got] == sorted(r["p"] for r in got) and got[0]["contrast"] == "c"


def test_benjamini_hochberg(spark):
    got = {r["k"]: r["q"] for r in resampling.benjamini_hochberg(frame(spark, [("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "k string, p double"), "p", "k").collect()}
    assert got == pytest.approx({"a": 0.04, "b": 4 / 75, "c": 4 / 75, "d": 0.5})


def test_fixed_effects_absorb_shifts_and_cr2_exceeds_cr0(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(x), float(500 * (g % 3) + 0.2 * x + rng.normal(0, 0.5))) for g in range(20) for x in rng.uniform(0, 50, 12)]
    fit = regression.fit_fe(frame(spark, rows, "g int, x double, y double"), "y", ["x"], "g")
    t = fit.terms.first()
    assert t["coef"] == pytest.approx(0.2, abs=0.02) and t["se"] > t["se_cr0"] > 0
    # the sandwich, from full matrices
    x, y, g = (np.array([r[i] for r in rows]) for i in (1, 2, 0))
    x, y = (v - np.array([v[g == k].mean() for k in g]) for v in (x, y))
    e, a = y - x * (x @ y) / (x @ x), 1 / (x @ x)
    cr2 = 0.0
    for k in range(20):
        xk, h = x[g == k], np.outer(x[g == k], x[g == k]) * a
        w, v = np.linalg.eigh(np.eye(len(xk)) - h)
        cr2 += (xk @ (v @ np.diag(1 / np.sqrt(np.maximum(w, 1e-8))) @ v.T) @ e[g == k]) ** 2
    assert t["se"] == pytest.approx(np.sqrt(cr2) * a, rel=1e-6)
    assert regression.wild_tests(fit, 99, 3).first()["p"] <= 0.02


def test_spline_is_linear_beyond_the_outer_knots(spark):
    z = regression.with_spline(frame(spark, [(float(i),) for i in range(101)], "x double"), "x").orderBy("x").toPandas()["z1"].to_numpy()
    assert np.allclose(z[:10], 0) and np.allclose(np.diff(z[91:], 2), 0, atol=1e-9)


@pytest.mark.parametrize("text", ["One. Two! Three?", "", "no stop", "A.  B.\nC"])
def test_sentences(spark, text):
    import re

    got = frame(spark, [(text,)], "t string").select(sentences(F.col("t"))).first()[0]
    assert got == [x for x in re.split(r"(?<=[.!?])\s+", text.strip()) if x]


def test_transforms(spark):
    t = frame(spark, [("One is here. Two is there. Three.",)], "a string").withColumn("s", sentences(F.col("a")))
    got = lambda n, d: t.select(stimuli.variant(n, d, F.col("a"), F.col("s"), F.col("s"))).first()[0]
    assert got("punctuation", 2) == "One is here!! Two is there!! Three."
    assert got("bullets", 1) == "One is here.\n- Two is there.\n- Three."
    assert got("hedging", 1) == "I think one is here. Two is there. Three."
    assert got("emoji", 4).count("😀") == 1 and got("emoji", 4).startswith("One is here. 😀 ✨ Two")
    assert got("buzzwords", 4).startswith("Critically, fundamentally, one is here.")


def test_transcripts(spark):
    cases = ["\n\nHuman: hi\n there \n\nAssistant: yes ", "Human: q\n\nAssistant: a", "no marks", "\n\nHuman: \n\nAssistant: a", "\n\nHuman: a\n\nAssistant: b\n\nHuman: c\n\nAssistant: d"]
    p, r = stimuli.parse_transcript(F.col("t"))
    got = [tuple(x) for x in frame(spark, [(c,) for c in cases], "t string").select(p, r).collect()]
    assert got == [("hi there", "yes"), ("q", "a"), (None, None), (None, None), ("c", "d")]


def test_unknown_scoring_rule_raises():
    with pytest.raises(ValueError):
        scoring.score(None, None, rule="other")


def test_bands_fail_closed(spark):
    rows = [("a", 5.0, 1.0, 0.01, None), ("b", 5.0, None, 0.01, None), ("c", 5.0, 1.0, 0.01, 0.2), ("d", -1.5, 1.0, 0.04, None), ("e", 1.0, 0.0, 0.01, None)]
    got = {r["k"]: (r["band"], r["material"]) for r in findings.judged(frame(spark, rows, "k string, effect double, systematic_bar double, p_raw double, p_adjusted double")).collect()}
    assert got == {"a": ("High", True), "b": ("Unknown", False), "c": ("Unconfirmed", False), "d": ("Low", True), "e": ("Unknown", False)}


def test_beam_finds_a_planted_stack(spark):
    probes = frame(spark, [("base one",), ("base two words",)], "base string")
    moves = [("x", " star", "suffix"), ("y", " nothing", "suffix"), ("z", "moon ", "prefix")]
    score = lambda c: F.contains(c, F.lit("star")).cast("double") * 2 + F.contains(c, F.lit("moon")).cast("double")
    best, lift = beam.beam_search(probes, moves, score, depth=2, width=2)[0]
    assert {m[0] for m in best} == {"x", "z"} and lift == 3.0


def test_stream_scores_each_text_once(spark, tmp_path):
    schema = "question string, answer string"
    for i, rows in enumerate(([("q", "a b"), ("q", "a b")], [("q", "a b"), ("q", "c")])):
        frame(spark, rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        score_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "cache"), str(tmp_path / "cp"), lambda q, a: scoring.score(q, a)).awaitTermination()
        got = spark.read.parquet(str(tmp_path / "cache")).collect()
        assert sorted(r["score"] for r in got) == [[0.02], [0.01, 0.02]][i]


def test_cache_keys_never_collide(spark):
    x = frame(spark, [("a|b", "c"), ("a", "b|c"), ("a", None), ("a", ""), ('a","b', "c"), ("a", 'b","c')], "q string, a string")
    keys = [r[0] for r in x.select(scoring.cache_key(F.col("q"), F.col("a"))).collect()]
    assert len(set(keys)) == len(keys)
    other = [r[0] for r in x.select(scoring.cache_key(F.col("q"), F.col("a"), model="other")).collect()]
    assert not set(keys) & set(other)


def test_scorers_share_a_cache_without_sharing_scores(spark, tmp_path):
    frame(spark, [("q", "a b")], "question string, answer string").write.parquet(str(tmp_path / "in"))
    for i, coef in enumerate((0.01, 0.5)):
        score_stream(spark, str(tmp_path / "in"), "question string, answer string", str(tmp_path / "cache"), str(tmp_path / f"cp{i}"), lambda q, a: scoring.score(q, a, coef=coef), model=f"m{i}").awaitTermination()
    assert sorted(r["score"] for r in spark.read.parquet(str(tmp_path / "cache")).collect()) == [0.02, 1.0]


def test_forged_separators_count_beyond_the_plain_answer(spark):
    x = frame(spark, [("a [SEP] b [SEP]", "a [SEP] b"), ("a", "a [SEP]"), ("[SEP]", "x")], "v string, base string")
    assert [r[0] for r in x.select(scoring.measured(F.lit("q"), F.col("v"), plain=F.col("base"))["n_sep_in_answer"]).collect()] == [1, 0, 1]


@pytest.mark.parametrize("k, n", [(0, 0), (1, 1), (3, 7), (7, 7), (60, 100), (40, 100), (5200, 10_000), (500_600, 1_000_000)])
def test_binomial_tail(k, n):
    from math import comb, erfc, sqrt

    got = resampling.binomial_tail(k, n)
    if n <= 10_000:
        assert got == pytest.approx(sum(comb(n, i) for i in range(k, n + 1)) / 2**n, rel=1e-9)
    else:
        assert got == pytest.approx(erfc((k - 0.5 - n / 2) / sqrt(n / 2)) / 2, rel=1e-3)


@pytest.mark.parametrize("two_sided", [True, False])
def test_signed_ranks_of_few_values_are_exact(spark, two_sided):
    import itertools

    v = [3.0, -1.0, 4.5, 2.0, -0.5, 6.0, 7.0]
    rank = {x: i + 1 for i, x in enumerate(sorted(map(abs, v)))}
    w = sum(rank[abs(x)] for x in v if x > 0)
    all_w = [sum(r for r, s in zip(range(1, 8), signs) if s) for signs in itertools.product((0, 1), repeat=7)]
    upper, lower = np.mean([x >= w for x in all_w]), np.mean([x <= w for x in all_w])
    got = resampling.wilcoxon(frame(spark, [(x,) for x in [*v, 0.0]], "delta double"), "delta", two_sided=two_sided).first()
    assert (got["n"], got["w"]) == (7, w) and got["p"] == pytest.approx(min(1, 2 * min(upper, lower)) if two_sided else upper)


def test_bca_matches_a_plain_one(spark):
    """The same draws in numpy: shares, leave-one-out acceleration and percentiles."""
    import hashlib
    from statistics import NormalDist

    x = clustered(spark, 0.4)
    s = resampling.cluster_sums(x, "cluster", "delta")
    got = resampling.bca_interval(s, 400, 3).first()
    rows = sorted((r["cluster"], r["s"], r["n"]) for r in s.collect())
    a, n, g = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), len(rows)
    pick = np.array([[int(hashlib.sha256(f"3:{b}:{j}".encode()).hexdigest()[:8], 16) % g for j in range(g)] for b in range(400)])
    draws, obs = a[pick].sum(1) / n[pick].sum(1), a.sum() / n.sum()
    jack = (a.sum() - a) / (n.sum() - n)
    d = jack.mean() - jack
    accel, nd = (d**3).sum() / (6 * (d**2).sum() ** 1.5), NormalDist()
    z0 = nd.inv_cdf((draws < obs).mean())
    level = lambda q: 100 * nd.cdf(z0 + (z0 + nd.inv_cdf(q)) / (1 - accel * (z0 + nd.inv_cdf(q))))
    assert (got["z0"], got["accel"]) == pytest.approx((z0, accel)) and (got["lo"], got["hi"]) == pytest.approx((np.percentile(draws, level(0.025)), np.percentile(draws, level(0.975))))


def test_contrasts_by_name_equal_each_alone_and_degenerate_ones_are_defined(spark):
    rng = np.random.default_rng(9)
    rows = [(k, g, float(rng.normal(m, 1))) for k, m in (("a", 0.0), ("b", 1.0)) for g in range(12) for _ in range(3)] + [("zero", g, 0.0) for g in range(4)] + [("one", 0, 1.5), ("one", 0, 2.5)]
    x = frame(spark, rows, "name string, cluster int, delta double")
    got = {r["name"]: r.asDict() for r in resampling.paired_contrast(x, 200, 5, "name").collect()}
    alone = resampling.paired_contrast(x.where("name = 'b'").drop("name"), 200, 5).first().asDict()
    assert {k: v for k, v in got["b"].items() if k != "name"} == pytest.approx(alone)
    assert got["b"]["ci_low"] < got["b"]["mean_delta"] < got["b"]["ci_high"] and got["b"]["p_sign"] < 0.01 < got["a"]["p_sign"]
    assert (got["zero"]["p_sign"], got["zero"]["p_wilcoxon"], got["zero"]["win_rate"], got["zero"]["ci_low"]) == (1.0, 1.0, 0.5, 0.0)
    assert (got["one"]["ci_low"], got["one"]["ci_high"], got["one"]["n_clusters"]) == (2.0, 2.0, 1)


def test_within_template_sees_a_planted_level(spark):
    rng = np.random.default_rng(10)
    cells = lambda shift: frame(spark, [(t, l, float(5 * t + rng.normal() + shift * (l == 2))) for t in range(12) for l in range(5)], "template int, level int, score double")
    p = [resampling.within_template(cells(s), 199, 3).first()["p"] for s in (0.0, 3.0)]
    assert p[1] <= 0.01 < p[0]


def test_nfkd_and_word_diff(spark):
    import unicodedata

    from plumbline.plans.joins import word_diff

    texts = ["ﬁ Ⅷ ²", "é é", "", "plain", None, "ａｂｃ　x", "①½™"]
    got = [r[0] for r in frame(spark, [(t,) for t in texts], "t string").select(stimuli.nfkd("t")).collect()]
    assert got == [None if t is None else unicodedata.normalize("NFKD", t) for t in texts]
    pairs = [("a b c", "a x c"), ("a b", "a b"), ("", "new <b>"), ("a & b", ""), (None, "x"), ("one two", "one two three")]
    got = [r[0] for r in frame(spark, pairs, "a string, b string").select(word_diff("a", "b")).collect()]
    assert got == ["a <del>b</del> <ins>x</ins> c", "a b", "<ins>new &lt;b&gt;</ins>", "<del>a &amp; b</del>", "<ins>x</ins>", "one two <ins>three</ins>"]


def panel_rows(seed=11, clusters=12, each=8):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(clusters):
        for _ in range(each):
            x, z = rng.uniform(0, 50), rng.normal()
            rows.append((g, float(x), float(z), float(3 * g + 0.1 * x + rng.normal(0, 2) * (1 + g / 4))))
    return rows


def test_wild_regression_matches_refits(spark):
    """The same signs, every draw refitted from full matrices: p and the interval of every coefficient."""
    rows, draws = panel_rows(), 300
    fit = regression.fit_fe(frame(spark, rows, "g int, x double, z double, y double"), "y", ["x", "z"], "g")
    got = {r["term"]: r for r in regression.wild_tests(fit, draws, 5).collect()}
    g, x, y = np.array([r[0] for r in rows]), np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows])
    for k in set(g):
        x[g == k] -= x[g == k].mean(0)
        y[g == k] -= y[g == k].mean()
    inverse = np.linalg.inv(x.T @ x)
    assert fit.r2 == pytest.approx(1 - ((y - x @ inverse @ x.T @ y) ** 2).sum() / (y @ y)) and (fit.n_obs, fit.n_clusters) == (len(rows), len(set(g)))
    bit = lambda k, d: int(hashlib.sha256(f"5:{d // 256}:{k}".encode()).hexdigest(), 16) >> (255 - d % 256) & 1
    signs = {k: [1 - 2 * bit(k, d) for d in range(draws)] for k in set(g)}
    for j, name in enumerate(("x", "z")):
        other = 1 - j
        b = np.zeros(2)
        b[other] = (x[:, other] @ y) / (x[:, other] @ x[:, other])
        u, hits, drawn = y - x @ b, 0, []
        for d in range(draws):
            star = x @ b + u * np.array([signs[k][d] for k in g])
            beta = inverse @ (x.T @ star)
            e = star - x @ beta
            meat = sum(np.outer(v, v) for v in (x[g == k].T @ e[g == k] for k in set(g)))
            hits += abs(beta[j]) / np.sqrt((inverse @ meat @ inverse)[j, j]) >= abs(got[name]["t"]) - 1e-9
            drawn.append(beta[j])
        assert got[name]["p"] == pytest.approx((1 + hits) / (draws + 1))
        spread = np.percentile(np.array(drawn) - np.mean(drawn), [2.5, 97.5])
        assert (got[name]["ci_low"], got[name]["ci_high"]) == pytest.approx(tuple(got[name]["coef"] + spread))


def test_string_clusters_and_what_they_add_to_a_coefficient(spark):
    rows = [(f"c{g}", *r) for g, *r in panel_rows()]
    fit = regression.fit_fe(frame(spark, rows, "g string, x double, z double, y double"), "y", ["x", "z"], "g")
    assert 0 < regression.wild_tests(fit, 50, 5).where("term = 'z'").first()["p"] <= 1
    sums = {r["name"]: r for r in regression.coefficient_sums(fit, ["x", "z"]).groupBy("name").agg(F.sum("s").alias("s"), F.count("s").alias("n")).collect()}
    assert [sums[t]["s"] for t in ("x", "z")] == pytest.approx(fit.beta) and sums["x"]["n"] == 12


def test_knots_fall_back_to_three(spark):
    rows = [(1.0,)] * 70 + [(float(x),) for x in range(2, 32)]
    assert regression.knots(frame(spark, rows, "x double"), "x", (0.05, 0.35, 0.65)) == sorted(set(np.quantile([r[0] for r in rows], [0.1, 0.5, 0.9])))
    assert regression.with_spline(frame(spark, [(1.0,)] * 9, "x double"), "x").columns == ["x"]


def test_length_curve_is_the_spline_itself(spark):
    rows = panel_rows(12)
    df = regression.with_spline(frame(spark, rows, "g int, x double, z double, y double"), "x")
    fit = regression.fit_fe(df, "y", ["x", "z1"], "g")
    curve = regression.length_curve(df, fit, "x").collect()
    x = np.array([r[1] for r in rows])
    a, b, c = np.quantile(x, [0.1, 0.5, 0.9])
    cube = lambda v, t: np.maximum(v - t, 0) ** 3
    f = lambda v: fit.beta[0] * v + fit.beta[1] * (cube(v, a) - cube(v, b) * (c - a) / (c - b) + cube(v, c) * (b - a) / (c - b)) / (c - a) ** 2
    grid, h = np.linspace(x.min(), x.max(), 40), max(1.0, (x.max() - x.min()) / 200)
    assert np.allclose([r["tokens"] for r in curve], grid) and np.allclose([r["reward"] for r in curve], f(grid) - f(grid[0]))
    assert np.allclose([r["slope_per_100"] for r in curve], (f(grid + h) - f(grid - h)) / (2 * h) * 100)


def test_benjamini_hochberg_of_p_that_differ_when_read_again(spark):
    import random

    p = F.udf(lambda i: random.random(), "double").asNondeterministic()
    got = resampling.benjamini_hochberg(spark.range(200).withColumn("p", p("id")), "p", "id").collect()
    assert len(got) == 200
    assert all(r["q"] is not None and r["q"] >= r["p"] for r in got)


def test_deals_of_few_templates_are_many_tasks(spark, monkeypatch):
    parts, plain = [], resampling.D.summed_rows
    monkeypatch.setattr(resampling.D, "summed_rows", lambda df, *a: parts.append(df.rdd.getNumPartitions()) or plain(df, *a))
    cells = frame(spark, [(t, k, float((t * 5 + k * 3) % 7)) for t in range(40) for k in range(4)], "template int, level int, score double")
    assert resampling.within_template(cells, 20, 1).first()["n_templates"] == 40
    assert parts[0] > 1
