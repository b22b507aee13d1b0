"""Style premiums on planted scorers, through the regression and through the findings."""

import pytest

from plumbline.plans import findings, style

from .conftest import DATA


def test_a_pure_length_rule_buys_no_style(spark):
    """Longer answers score higher and nothing else counts: no style may look as if it were worth anything."""
    x = findings.findings_of(spark, DATA, noise=0.0).where("category = 'style' and kind = 'length_adjusted'").collect()
    assert len(x) == 10
    assert all(abs(r["effect"]) < 1e-6 and not r["material"] for r in x)


def test_a_planted_style_is_found_and_the_others_are_not(spark):
    arms = style.style_arms(spark, DATA, noise=0.2, likes={"flattery": 0.1, "hedging": -0.05})
    x = {r["transform"]: r for r in style.premiums_of(style.style_fit(arms)).collect()}
    assert x["flattery"]["effect"] == pytest.approx(0.3, abs=0.03) and x["flattery"]["p_adjusted"] < 0.05
    assert x["hedging"]["effect"] == pytest.approx(-0.15, abs=0.03) and x["hedging"]["p_adjusted"] < 0.05
    assert all(r["p_adjusted"] >= r["p_raw"] for r in x.values())
    assert all(abs(r["effect"]) < 0.05 for t, r in x.items() if t not in ("flattery", "hedging"))
    intervals = {r["term"]: r for r in style.regression.wild_tests(style.style_fit(arms), 200, 3).collect()}
    assert intervals["dose_flattery"]["ci_low"] < 0.1 < intervals["dose_flattery"]["ci_high"] and intervals["dose_flattery"]["p"] < 0.05


def test_filler_of_equal_length_is_what_elaboration_is_held_against(spark):
    arms = style.style_arms(spark, DATA, noise=0.0)
    x = style.matched(arms)
    assert x.count() == 2 * arms.select("cluster").distinct().count()
    one = x.where("name = 'elaboration 1'").first()
    mine = {(r["transform"], r["dose"]): r for r in arms.where(f"cluster = {one['cluster']}").collect()}
    plain, long = mine["baseline", 0], mine["elaboration", 1]
    near = min(range(1, 5), key=lambda k: (abs(round((mine["padding", k]["x"] - plain["x"]) * 100) - round((long["x"] - plain["x"]) * 100)), k))
    assert one["delta"] == pytest.approx(long["y"] - mine["padding", near]["y"])


def test_findings_are_saved_while_their_tables_stay(spark, tmp_path, monkeypatch):
    runs = []
    monkeypatch.setattr(findings, "findings_of", lambda s, d, seed: runs.append(seed) or s.range(1))
    for t in ("documents", "benchmark"):
        spark.range(3).write.parquet(str(tmp_path / f"{t}.parquet"))
    findings.found(spark, str(tmp_path)), findings.found(spark, str(tmp_path)), findings.found(spark, str(tmp_path), 61)
    assert runs == [59, 61]
    spark.range(9).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    findings.found(spark, str(tmp_path))
    assert runs == [59, 61, 59]


def test_words_of_variants_come_from_the_answer(spark):
    from pyspark.sql import functions as F

    from plumbline.functions import stimuli
    from plumbline.functions.text import sentences, word_count

    texts = ["", " \n ", "one", "A b. C d! E?", " Ééé x.  İi y.\n\nz w v", ". . .", "a.b c d. Q", "S. " * 30]
    x = spark.createDataFrame([(t,) for t in texts], "a string").withColumns({"s": sentences(F.col("a")), "n": word_count(F.col("a"))})
    s = F.col("s")
    for t, (doses, _) in stimuli.DOSES.items():
        for k in doses:
            got = x.select("a", word_count(stimuli.variant(t, k, F.col("a"), s, s)).alias("long"), stimuli.variant_words(t, k, F.col("n"), s, s).alias("short")).collect()
            assert all(r["long"] == r["short"] for r in got), (t, k, got)


def test_families_share_their_signs(spark):
    from plumbline.operators import draws, resampling

    x = spark.createDataFrame([(n, c, float((c * 7 + i * 3) % 11 - 4), 1) for i, n in enumerate("abcd") for c in range(40)], "name string, cluster long, s double, n long")
    both = resampling.westfall_young(x, "name", 200, 3, [["a", "b"], ["c", "d"]])
    alone = [resampling.westfall_young(x.where(f"name in {f}"), "name", 200, 3).collect() for f in (("a", "b"), ("c", "d"))]
    assert sorted(both.collect()) == sorted(alone[0] + alone[1])
    assert draws.dealt(x, "cluster").rdd.getNumPartitions() > 1


def test_wide_cross_products_in_blocks(spark):
    import numpy as np

    from plumbline.operators import regression

    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 10))
    of = [None if i % 50 == 0 else i % 37 for i in range(600)]
    x = spark.createDataFrame([(c, *map(float, r)) for c, r in zip(of, v)], "cluster long, " + ", ".join(f"x{i} double" for i in range(9)) + ", y double").repartition(3)
    got = regression.fit_fe(x, "y", [f"x{i}" for i in range(9)], "cluster").beta
    key = np.array([-1 if c is None else c for c in of])
    w = v - np.stack([v[key == k].mean(0) for k in key])
    assert np.allclose(got, np.linalg.lstsq(w[:, :9], w[:, 9], rcond=None)[0])


def test_turns_of_emoji_and_buzzwords(spark):
    """A text with a sentence for each turn takes the short way and gives what the turns give one after the other."""
    from pyspark.sql import functions as F

    from plumbline.functions import stimuli

    x = spark.createDataFrame([([f"S{i} t." for i in range(n)],) for n in range(12)], "s array<string>")
    for k in (1, 2, 4, 8):
        for r in x.select("s", stimuli.emoji(F.col("s"), k).alias("e"), stimuli.buzzwords(F.col("s"), k).alias("b")).collect():
            e, b, n = list(r["s"]), list(r["s"]), len(r["s"])
            for i in range(k if n else 0):
                e[i % n] += " " + stimuli.EMOJI[i % 8]
                w = stimuli.BUZZWORDS[i % 8]
                b[i % n] = w[0].upper() + w[1:] + ", " + b[i % n][0].lower() + b[i % n][1:]
            assert (r["e"], r["b"]) == (" ".join(e), " ".join(b))
    plan = x.select(stimuli.buzzwords(F.col("s"), 8))._jdf.queryExecution().analyzed().toString()
    assert "CASE WHEN" in plan


def test_findings_read_documents_twice(spark, tmp_path, monkeypatch):
    """Once for the documents' own scores and once for their arms', whatever number of modules asks."""
    read = []
    for g in (vars(findings), vars(style), findings.scored_documents.__globals__):
        for name in ("table", "answers"):
            if name in g:
                monkeypatch.setitem(g, name, lambda s, d, *t, f=g[name], n=name: read.append((n, *t)) or f(s, d, *t))
    findings.findings_of(spark, DATA)
    assert sorted(r for r in read if r[-1] != "benchmark") == [("answers",), ("table", "documents")]


def test_draws_of_a_small_group_are_many_tasks(spark):
    from plumbline.operators import draws

    groups = spark.createDataFrame([(0, [1.0, 2.0])], "g int, s array<double>")
    x = draws.per_draw(groups, 40, lambda r, b: [(float(r["s"].sum() + b),)], "m double", ["g"])
    held = [n for n in x.rdd.glom().map(len).collect() if n]
    assert sum(held) == 40 and len(held) > draws.BLOCKS // 2


def test_compared_runs_share_their_texts(spark, monkeypatch):
    """Two runs read and rewrite the documents as often as one does, and each is what it is alone."""
    read = []
    for g in (vars(findings), vars(style), findings.scored_documents.__globals__):
        for name in ("table", "answers"):
            if name in g:
                monkeypatch.setitem(g, name, lambda s, d, *t, f=g[name], n=name: read.append((n, *t)) or f(s, d, *t))
    monkeypatch.setattr(findings, "_saved", {})
    assert findings.d24(spark, DATA).count() == 14
    assert sorted(r for r in read if r[-1] != "benchmark") == [("answers",), ("table", "documents")]
    by = lambda x: {(r["category"], r["kind"], r["title"]): r.asDict() for r in x.collect()}
    both, alone = by(findings.found(spark, DATA, 61)), by(findings.findings_of(spark, DATA, 61))
    assert both.keys() == alone.keys()
    assert all(both[k] == pytest.approx(alone[k], abs=1e-9) for k in alone)


def test_steps_of_many_runs_equal_each_alone(spark):
    import numpy as np

    from plumbline.operators import regression, resampling

    rng = np.random.default_rng(7)
    x = spark.createDataFrame([(i % 23, *map(float, r)) for i, r in enumerate(rng.normal(size=(300, 4)))], "cluster long, a double, b double, y1 double, y2 double").repartition(3)
    fits = regression.fits_fe(x, ["y1", "y2"], ["a", "b"], "cluster")
    for y, fit in zip(("y1", "y2"), fits):
        one = regression.fit_fe(x, y, ["a", "b"], "cluster")
        assert np.allclose(fit.beta, one.beta) and np.allclose(fit.se, one.se) and fit.r2 == pytest.approx(one.r2) and (fit.n_obs, fit.n_clusters) == (300, 23)
    names = [f"{i}:{t}" for i in range(2) for t in "ab"]
    rows = resampling.westfall_young_rows(regression.coefficient_rows(fits, ["a", "b"]), names, 100, 3, [names[:2], names[2:]]).collect()
    want = [r for i, fit in enumerate(fits) for r in resampling.westfall_young(regression.coefficient_sums(fit, ["a", "b"]), "name", 100, 3).collect()]
    assert [tuple(r)[1:] for r in rows] == [pytest.approx(tuple(r)[1:]) for r in want]

    m = spark.createDataFrame([(r, n, n % 4, n % 3, float(rng.normal())) for r in (1, 2) for n in range(40)], "run int, name long, grp long, stratum long, m double")
    got = {r["run"]: r for r in resampling.omnibus(m, 60, 5, "run").collect()}
    for r in (1, 2):
        alone = resampling.omnibus(m.where(f"run = {r}"), 60, 5).first()
        assert (got[r]["gap"], got[r]["p"]) == pytest.approx((alone["gap"], alone["p"]))
