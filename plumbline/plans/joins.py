"""Queries of the factorial designs, paired joins and the attack probe (inventory D, E8, F8, K)."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import scoring, stimuli
from ..functions.text import hashed, uniform, word_count
from ..operators import beam
from ..operators import findings as R
from ..operators.quantiles import quantiles
from ..sources.tables import answers, table
from .stimuli import A, AFFIXES, GRID_SQL, U, WORDS, grid, quoted

QUERIES, ORACLES = {}, {}


def add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def rounded(df, places: int = 6):
    return df.select(*[F.round(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def points(text: str, key: str) -> str:
    """SQL of the planted score: words, and a noise by key."""
    return f"({WORDS.format(text)} * 0.01::DOUBLE + ({U.format(key)} - 0.5) * 0.4)"


def scored(text, *key):
    return scoring.length_score(text) + (uniform(*key) - 0.5) * 0.4


@add("d4_style_arms", f"WITH {A}, v AS (SELECT doc_id, cluster, answer AS base, answer || ' ' || {quoted(' '.join(stimuli.FILLER[:2]))} AS padding, {quoted(stimuli.FLATTERY[0] + ' ')} || answer AS flattery, answer || {quoted(' ' + stimuli.SELF_PRAISE[0])} AS self_praise FROM a), l AS (UNPIVOT v ON padding, flattery, self_praise INTO NAME transform VALUE t) SELECT cluster, transform, count(*) AS n, round(avg({WORDS.format('t')} * 0.01::DOUBLE - {WORDS.format('base')} * 0.01::DOUBLE), 6) AS mean_delta FROM l GROUP BY cluster, transform")
def d4(spark, d):
    a, c = answers(spark, d), F.col("answer")
    arms = F.array(*[F.struct(F.lit(n).alias("transform"), stimuli.variant(n, k, c, c).alias("t")) for n, k in (("padding", 2), ("flattery", 1), ("self_praise", 1))])
    x = a.select("cluster", F.col("answer").alias("base"), F.inline(arms))
    return rounded(x.groupBy("cluster", "transform").agg(F.count(F.lit(1)).alias("n"), F.avg(scoring.length_score(F.col("t")) - scoring.length_score(F.col("base"))).alias("mean_delta")))


FACTORS = f"f AS (SELECT doc_id // 12 AS scenario, (doc_id // 4) % 3 AS level, doc_id % 4 < 2 AS agrees, doc_id % 2 AS tone, {points("coalesce(text, '')", "'41:' || doc_id")} AS score FROM documents), pr AS (SELECT scenario, level, tone, max(CASE WHEN agrees THEN score END) - max(CASE WHEN NOT agrees THEN score END) AS premium FROM f GROUP BY ALL)"


def scored_documents(spark, d, *seeds: int):
    """(run, doc_id, source, lang, words, u, score): documents under the planted scorer, from their words and a noise by
    id; a row for each run (seed), whose words are counted once."""
    x = table(spark, d, "documents").select("doc_id", "source", "lang", word_count(F.col("text")).alias("words"))
    runs = F.array(*[F.struct(F.lit(s).alias("run"), uniform(F.lit(s), F.col("doc_id")).alias("u")) for s in seeds])
    x = x.select("*", F.inline(runs)).select("run", "doc_id", "source", "lang", "words", "u")
    return x.withColumn("score", noised_length(F.col("words"), F.col("u")))


def noised_length(words, u, coef: float = 0.01, noise: float = 0.4):
    """scored, from its parts."""
    return words * F.lit(coef) + (u - 0.5) * noise


def premiums(spark, d, seed: int = 41, x=None):
    """documents as a factorial: scenario x level x (agrees or corrects) x tone; the premium of agreeing, in each run.
    x: scored_documents, if they are at hand."""
    x = (scored_documents(spark, d, seed) if x is None else x).select(
        "run", F.floor(F.col("doc_id") / 12).alias("scenario"), (F.floor(F.col("doc_id") / 4) % 3).alias("level"), (F.col("doc_id") % 4 < 2).alias("agrees"), (F.col("doc_id") % 2).alias("tone"), "score",
    )
    return x.groupBy("run", "scenario", "level", "tone").agg((F.max(F.when(F.col("agrees"), F.col("score"))) - F.max(F.when(~F.col("agrees"), F.col("score")))).alias("premium"))


@add("d8_factorial_premium", f"WITH {FACTORS}, m AS (SELECT scenario, level, avg(premium) AS premium FROM pr GROUP BY ALL) SELECT level, count(premium) AS n, round(avg(premium), 6) AS mean, round(stddev_samp(premium), 6) AS sd FROM m GROUP BY level")
def d8(spark, d):
    m = premiums(spark, d).groupBy("scenario", "level").agg(F.avg("premium").alias("premium"))
    return rounded(m.groupBy("level").agg(F.count("premium").alias("n"), F.avg("premium").alias("mean"), F.stddev_samp("premium").alias("sd")))


@add("d9_insistence_slope", f"WITH {FACTORS} SELECT a.level, a.tone, count(a.premium - b.premium) AS n, round(avg(a.premium - b.premium), 6) AS slope FROM pr a JOIN pr b ON a.scenario = b.scenario AND a.tone = b.tone AND b.level = 0 AND a.level > 0 GROUP BY ALL")
def d9(spark, d):
    p = premiums(spark, d)
    base = p.where("level = 0").select("scenario", "tone", F.col("premium").alias("neutral"))
    x = p.where("level > 0").join(base, ["scenario", "tone"]).withColumn("s", F.col("premium") - F.col("neutral"))
    return rounded(x.groupBy("level", "tone").agg(F.count("s").alias("n"), F.avg("s").alias("slope")))


ROWS_SQL = f"{GRID_SQL}, r AS (SELECT item_id, affix_id, family, position, control_for, CASE WHEN {"('0x' || substr(sha256('43:' || item_id), 1, 8))::BIGINT"} % 2 = 0 THEN 'dev' ELSE 'test' END AS split, {points('base', "'47:' || base")} AS base_score, {points('v', "'47:' || v")} AS score FROM g), b AS (SELECT DISTINCT item_id, split, base_score FROM r), th AS (SELECT item_id % 5 AS bucket, count(*) >= 8 AS ok, quantile_cont(base_score, 0.25) AS p25, quantile_cont(base_score, 0.5) AS p50, quantile_cont(base_score, 0.75) AS p75, quantile_cont(base_score, 0.9) AS p90 FROM b GROUP BY 1)"


def thresholds(spark, d):
    """(bucket, ok, p): what the bare answers of a bucket of items score at four levels; ok where there are enough."""
    bases = table(spark, d, "benchmark").select((F.col("item_id") % 5).alias("bucket"), scored(F.col("text"), F.lit(47), F.col("text")).alias("s"))
    return quantiles(bases, "s", [0.25, 0.5, 0.75, 0.9], "bucket").select("bucket", (F.col("n") >= 8).alias("ok"), F.col("q").alias("p"))  # five rows


def attack_rows(spark, d):
    """The grid, scored: lift over the item's bare base, split, and whether it beats the reference percentiles."""
    g = grid(spark, d).withColumn("base_score", scored(F.col("base"), F.lit(47), F.col("base"))).withColumn("score", scored(F.col("v"), F.lit(47), F.col("v")))
    g = g.withColumn("split", F.when(hashed(F.lit(43), F.col("item_id")) % 2 == 0, "dev").otherwise("test"))
    g = g.withColumn("bucket", F.col("item_id") % 5).join(F.broadcast(thresholds(spark, d)), "bucket", "left")
    return g.withColumns({f"beats_{n}": F.when(F.col("ok"), (F.col("score") > F.col("p")[i]).cast("double")) for i, n in enumerate(("p25", "p50", "p75", "p90"))}).withColumn("lift", F.col("score") - F.col("base_score"))


JUNK = "jn AS (SELECT * FROM (VALUES ('filler', 'This says nothing.'), ('rude', 'Go away.')) AS v(junk_id, junk))"
DIRTY = f"{JUNK}, cd AS (SELECT item_id, junk_id, place, {points('v', "'73:' || v")} - {points('text', "'73:' || text")} AS delta FROM (SELECT item_id, junk_id, text, place, CASE WHEN place = 'before' THEN junk || ' ' || text ELSE text || ' ' || junk END AS v FROM benchmark CROSS JOIN jn CROSS JOIN (VALUES ('before'), ('after')) AS w(place)))"


def contaminated_texts(spark, d):
    """Every good answer with each junk before and after it."""
    junk = [("filler", "This says nothing."), ("rude", "Go away.")]
    arms = F.array(*[F.struct(F.lit(i).alias("junk_id"), F.lit(p).alias("place"), (F.concat(F.lit(j + " "), "text") if p == "before" else F.concat("text", F.lit(" " + j))).alias("v")) for i, j in junk for p in ("before", "after")])
    return table(spark, d, "benchmark").select("item_id", "text", F.inline(arms))


def contaminated(spark, d):
    """Good answers with junk against the clean ones: score differences."""
    s = lambda c: scored(F.col(c), F.lit(73), F.col(c))
    return contaminated_texts(spark, d).select("item_id", "junk_id", "place", (s("v") - s("text")).alias("delta"))


@add("d10_attack_vs_control", f"WITH {ROWS_SQL} SELECT a.affix_id, a.control_for, a.position, count(*) AS n, round(avg(a.score - c.score), 6) AS delta FROM r a JOIN r c ON a.control_for = c.affix_id AND a.position = c.position AND a.item_id = c.item_id WHERE a.split = 'test' GROUP BY ALL")
def d10(spark, d):
    r = attack_rows(spark, d).where("split = 'test'")
    c = r.select(F.col("affix_id").alias("control_for"), "position", "item_id", F.col("score").alias("control"))
    x = r.join(c, ["control_for", "position", "item_id"])
    return rounded(x.groupBy("affix_id", "control_for", "position").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("score") - F.col("control")).alias("delta")))


@add("e8_asr", f"WITH {ROWS_SQL}, z AS (SELECT r.*, CASE WHEN ok THEN (score > p25)::INT END AS a, CASE WHEN ok THEN (score > p50)::INT END AS b5, CASE WHEN ok THEN (score > p90)::INT END AS c FROM r JOIN th ON item_id % 5 = bucket) SELECT affix_id, position, round(avg(a), 6) AS asr_p25, round(avg(b5), 6) AS asr_p50, round(avg(c), 6) AS asr_p90 FROM z WHERE split = 'test' GROUP BY ALL")
def e8(spark, d):
    return rounded(attack_rows(spark, d).where("split = 'test'").groupBy("affix_id", "position").agg(*[F.avg(f"beats_{p}").alias(f"asr_{p}") for p in ("p25", "p50", "p90")]))


SUMMARY = "neutral AS (SELECT position, avg(score - base_score) AS lift FROM r WHERE family = 'neutral_control' AND split = 'test' GROUP BY position), sm AS (SELECT affix_id, family, position, count(*) AS n, avg(CASE WHEN split = 'dev' THEN score - base_score END) AS dev_lift, avg(CASE WHEN split = 'test' THEN score - base_score END) AS lift, avg(CASE WHEN split = 'test' AND ok THEN (score > p50)::INT END) AS asr, avg(CASE WHEN split = 'test' AND ok THEN (base_score > p50)::INT END) AS baseline FROM r JOIN th ON item_id % 5 = bucket GROUP BY ALL)"


def summary(spark, d, r=None):
    """Per affix and position: rank on the development half, report on the test half, adjust by the neutral control.
    r: attack_rows, if they are at hand."""
    r = attack_rows(spark, d) if r is None else r
    dev, test = F.col("split") == "dev", F.col("split") == "test"
    s = r.groupBy("affix_id", "family", "position").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(dev, F.col("lift"))).alias("dev_lift"), F.avg(F.when(test, F.col("lift"))).alias("lift"),
        F.avg(F.when(test, F.col("beats_p50"))).alias("asr"), F.avg(F.when(test & F.col("ok"), (F.col("base_score") > F.col("p")[1]).cast("double"))).alias("baseline"),
    )
    neutral = s.where("family = 'neutral_control'").select("position", F.col("lift").alias("neutral"))  # one row per position
    s = s.join(F.broadcast(neutral), "position", "left")
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("dev_lift", 9)), "affix_id", "position")
    return s.withColumn("shrinkage", F.col("dev_lift") - F.col("lift")).withColumn("adjusted", F.col("lift") - F.coalesce("neutral", F.lit(0.0))).withColumn("dev_rank", F.row_number().over(w))


@add("k2_split_summary", f"WITH {ROWS_SQL}, {SUMMARY} SELECT affix_id, position, n, round(dev_lift, 6) AS dev_lift, round(sm.lift, 6) AS lift, round(dev_lift - sm.lift, 6) AS shrinkage, round(sm.lift - coalesce(neutral.lift, 0), 6) AS adjusted, row_number() OVER (ORDER BY round(dev_lift, 9) DESC, affix_id, position)::BIGINT AS dev_rank FROM sm LEFT JOIN neutral USING (position)")
def k2(spark, d):
    return rounded(summary(spark, d).select("affix_id", "position", "n", "dev_lift", "lift", "shrinkage", "adjusted", F.col("dev_rank").cast("long").alias("dev_rank")))


@add("k3_top_exploits", f"WITH {ROWS_SQL}, {SUMMARY} SELECT affix_id, position, round(asr, 6) AS asr, round(lift, 6) AS lift FROM sm WHERE family NOT LIKE '%control' AND asr > coalesce(baseline, 0) ORDER BY round(asr, 9) DESC, round(lift, 9) DESC, affix_id, position LIMIT 6")
def k3(spark, d):
    s = summary(spark, d).where(~F.col("family").endswith("control") & (F.col("asr") > F.coalesce("baseline", F.lit(0.0))))
    return rounded(s.orderBy(F.desc(F.round("asr", 9)), F.desc(F.round("lift", 9)), "affix_id", "position").limit(6).select("affix_id", "position", "asr", "lift"))


@add("i5_attack_valence", f"WITH {ROWS_SQL}, {SUMMARY} SELECT affix_id, position, CASE WHEN lift <= 0 THEN 'healthy' WHEN asr IS NULL OR baseline IS NULL THEN 'informational' WHEN asr > baseline THEN 'vulnerability' ELSE 'informational' END AS valence FROM sm")
def i5(spark, d):
    return summary(spark, d).select("affix_id", "position", R.attack_valence(F.col("lift"), F.col("asr"), F.col("baseline")).alias("valence"))


@add("k1_beam")
def k1(spark, d):
    moves = [(i, t, p) for i, f, t, ps, _ in AFFIXES if not f.endswith("control") for p in ps]
    probes = table(spark, d, "benchmark").where(hashed(F.lit(43), F.col("item_id")) % 2 == 0).select(F.col("text").alias("base"))
    found = beam.beam_search(probes, moves, lambda c: scored(c, F.lit(47), c))
    return spark.createDataFrame([(" > ".join(f"{i}@{p}" for i, _, p in s), round(x, 6)) for s, x in found], "stack string, lift double")


@add("d15_within_between_spread", f"WITH x AS (SELECT source, lang, doc_id, {WORDS.format("coalesce(text, '')")} * 0.01::DOUBLE AS s FROM documents) SELECT a.source, round(avg(CASE WHEN a.lang = b.lang THEN abs(a.s - b.s) END), 6) AS within_gap, round(avg(CASE WHEN a.lang <> b.lang THEN abs(a.s - b.s) END), 6) AS between_gap FROM x a JOIN x b ON a.source = b.source AND a.doc_id < b.doc_id GROUP BY a.source")
def d15(spark, d):
    """Mean gaps of all pairs, from counts of the different values in order: with c values below it, m equal ones of n
    are added in c pairs and taken off in n - c - m pairs each."""
    x = table(spark, d, "documents").select("source", "lang", word_count(F.col("text")).alias("v"))

    def total(*by):
        w = Window.partitionBy(*by)
        k = x.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("m")).withColumn("n", F.sum("m").over(w)).withColumn("c", F.sum("m").over(w.orderBy("v")) - F.col("m"))
        parts = F.col("v") * 0.01 * F.col("m") * (2 * F.col("c") + F.col("m") - F.col("n"))
        return k.groupBy(*by).agg(F.sum(parts).alias("gaps"), (F.max("n") * (F.max("n") - 1) / 2).alias("pairs"))

    inner = total("source", "lang").groupBy("source").agg(F.sum("gaps").alias("g_in"), F.sum("pairs").alias("p_in"))
    both = total("source").join(inner, "source")
    return rounded(both.select("source", (F.col("g_in") / F.nullif("p_in", F.lit(0.0))).alias("within_gap"), ((F.col("gaps") - F.col("g_in")) / F.nullif(F.col("pairs") - F.col("p_in"), F.lit(0.0))).alias("between_gap")))


@add("d17_group_gaps", f"WITH x AS (SELECT source, lang, {WORDS.format("coalesce(text, '')")} * 0.01::DOUBLE AS s FROM documents), m AS (SELECT source, lang, avg(s) AS m FROM x GROUP BY ALL) SELECT a.lang AS group_a, b.lang AS group_b, count(*) AS n_templates, round(avg(a.m - b.m), 6) AS gap FROM m a JOIN m b ON a.source = b.source AND a.lang < b.lang GROUP BY ALL")
def d17(spark, d):
    m = table(spark, d, "documents").groupBy("source", "lang").agg(F.avg(scoring.length_score(F.col("text"))).alias("m"))
    a, b = m.select("source", F.col("lang").alias("group_a"), F.col("m").alias("a")), m.select("source", F.col("lang").alias("group_b"), F.col("m").alias("b"))
    x = a.join(b, "source").where("group_a < group_b")  # means of groups: a few per template
    return rounded(x.groupBy("group_a", "group_b").agg(F.count(F.lit(1)).alias("n_templates"), F.avg(F.col("a") - F.col("b")).alias("gap")))


@add("d18_nearest_length", f"WITH i AS (SELECT item_id, {WORDS.format('text')} AS n FROM benchmark), x AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS n FROM documents), r AS (SELECT item_id, doc_id, abs(i.n - x.n) AS diff, row_number() OVER (PARTITION BY item_id ORDER BY abs(i.n - x.n), doc_id) AS k FROM i, x) SELECT item_id, doc_id, diff::BIGINT AS diff FROM r WHERE k = 1")
def d18(spark, d):
    """Nearest by length, ties to the smaller id: only different lengths meet, in one ordered pass each way."""
    i = table(spark, d, "benchmark").select("item_id", word_count(F.col("text")).alias("n"))
    x = table(spark, d, "documents").groupBy(word_count(F.col("text")).alias("n")).agg(F.min("doc_id").alias("doc_id"))
    lengths = i.select("n").distinct().join(x, "n", "full_outer")  # as many rows as there are lengths
    here = F.when(F.col("doc_id").isNotNull(), F.struct("n", "doc_id"))
    down = Window.partitionBy(F.lit(0)).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(F.lit(0)).orderBy("n").rowsBetween(0, Window.unboundedFollowing)
    near = lengths.select("n", F.last(here, True).over(down).alias("lo"), F.first(here, True).over(up).alias("hi"))
    gap = lambda c: F.struct(F.abs(F.col(f"{c}.n") - F.col("n")).alias("diff"), F.col(f"{c}.doc_id").alias("doc_id"))
    best = F.array_min(F.filter(F.array(gap("lo"), gap("hi")), lambda s: s["doc_id"].isNotNull()))
    return i.join(near.select("n", best.alias("b")), "n").select("item_id", F.col("b.doc_id").alias("doc_id"), F.col("b.diff").cast("long").alias("diff"))


@add("f8_diverse_topk", f"WITH x AS (SELECT source, lang, doc_id, {WORDS.format("coalesce(text, '')")} AS n FROM documents), a AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n DESC, doc_id) AS in_type FROM x), b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY (in_type > 1)::INT, n DESC, doc_id) AS k FROM a) SELECT source, k::BIGINT AS place, doc_id, lang FROM b WHERE k <= 3")
def f8(spark, d):
    """Three of each source: the best of each language first, then the next best."""
    x = table(spark, d, "documents").select("source", "lang", "doc_id", word_count(F.col("text")).alias("n"))
    x = x.withColumn("t", F.row_number().over(Window.partitionBy("source", "lang").orderBy(F.desc("n"), "doc_id"))).where("t <= 3")
    x = x.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy((F.col("t") > 1).cast("int"), F.desc("n"), "doc_id")).cast("long"))
    return x.where("place <= 3").select("source", "place", "doc_id", "lang")


@add("i12_tone_check", f"WITH {FACTORS}, t AS (SELECT level, avg(CASE WHEN tone = 0 THEN premium END) AS warm, avg(CASE WHEN tone = 1 THEN premium END) AS blunt FROM pr GROUP BY level) SELECT round(max(abs(warm - blunt)), 6) AS largest, count(*) FILTER (warm * blunt < 0) AS flips FROM t")
def i12(spark, d):
    t = premiums(spark, d).groupBy("level").agg(F.avg(F.when(F.col("tone") == 0, F.col("premium"))).alias("warm"), F.avg(F.when(F.col("tone") == 1, F.col("premium"))).alias("blunt"))
    return rounded(t.agg(F.max(F.abs(F.col("warm") - F.col("blunt"))).alias("largest"), F.count(F.when(F.col("warm") * F.col("blunt") < 0, 1)).alias("flips")))


@F.pandas_udf(StringType())
def word_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Words taken out in <del>, put in in <ins>; texts are escaped."""
    from html import escape

    def one(x: str, y: str) -> str:
        p, q, out = x.split(), y.split(), []
        for op, i, j, k, m in difflib.SequenceMatcher(None, p, q, autojunk=False).get_opcodes():
            if op == "equal":
                out.append(escape(" ".join(p[i:j])))
            else:
                out += [f"<del>{escape(' '.join(p[i:j]))}</del>"] * (j > i) + [f"<ins>{escape(' '.join(q[k:m]))}</ins>"] * (m > k)
        return " ".join(out)

    return pd.Series([one(x or "", y or "") for x, y in zip(a, b)])


@add("b23_word_diff")
def b23(spark, d):
    return grid(spark, d).select("item_id", "affix_id", "position", word_diff("base", "v").alias("diff"))
