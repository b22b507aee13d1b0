"""Queries of the yardsticks and the inference core (inventory E, F, G)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring, stimuli
from ..functions.text import hashed, uniform, word_count
from ..operators import regression, resampling as R
from ..operators.quantiles import quantiles
from ..sources.tables import answers, table
from .stimuli import A, U, WORDS, quoted

QUERIES, ORACLES = {}, {}
#: Draws of the bootstraps, of the permutations and half splits, and of the regression's bootstrap: the least of the usual presets.
BOOT, PERM, REG = 1_000, 2_000, 200


def add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def rounded(df, places: int = 6):
    return df.select(*[F.round(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def deltas(spark, d):
    """lineitem as a panel of deltas: cluster (supplier), contrast and delta."""
    x = table(spark, d, "lineitem")
    return x.select(F.col("l_suppkey").alias("cluster"), F.concat("l_returnflag", "l_linestatus").alias("contrast"), ((F.col("l_discount") - F.col("l_tax")) * 100).alias("delta"))


D = "d AS (SELECT l_suppkey AS cluster, l_returnflag || l_linestatus AS contrast, (l_discount - l_tax) * 100 AS delta FROM lineitem), c AS (SELECT cluster, sum(delta) AS s, count(*) AS n FROM d GROUP BY cluster), i AS (SELECT *, row_number() OVER (ORDER BY cluster) - 1 AS ix, count(*) OVER () AS g FROM c)"
HASH = "('0x' || substr(sha256({0}), 1, 8))::BIGINT"
MEAN = "(SELECT sum(s) / sum(n) FROM c)"


@add("g1_cr0", f"WITH {D} SELECT sum(n)::BIGINT AS n, count(*) AS clusters, round(any_value({MEAN}), 6) AS mean, round(sqrt(sum((s - n * {MEAN}) ** 2)) / sum(n), 6) AS se FROM c")
def g1(spark, d):
    return rounded(R.cr0(R.cluster_sums(deltas(spark, d), "cluster", "delta")))


def boot_sql(name: str, source: str, seed: int) -> str:
    """Draws of clusters (source: ix, g, s, n) by their hashes: name (b, m)."""
    return f"{name} AS (SELECT b, sum(s) / sum(n) AS m FROM (SELECT b, {HASH.format(f"'{seed}:' || b || ':' || j")} % g AS ix FROM range({BOOT}) x(b), (SELECT ix AS j, g FROM {source})) JOIN {source} USING (ix) GROUP BY b)"


# the normal distribution by its series, and its inverse by Newton's steps
PHI = "(0.5::DOUBLE + exp(-({0}) * ({0}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 90), lambda k: CASE WHEN ({0}) = 0 THEN 0 ELSE sign({0}) * exp((2 * k + 1) * ln(abs({0})) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1)) END)))"
PPF = "list_reduce(list_transform(range(0, 40), lambda i: 0.0::DOUBLE), lambda z, i: z - (" + PHI.format("z") + " - ({0})) / (exp(-z * z / 2) / sqrt(2 * pi())))"


def bca_sql(name: str, source: str, draws: str) -> str:
    """BCa bounds from clusters and draws: name (mean, z0, accel, lo, hi)."""
    z = lambda p: PPF.format(p)
    return f"""{name}_t AS (SELECT sum(s) AS s, sum(n) AS n, count(*) AS g FROM {source}), {name}_j AS (SELECT (t.s - c.s) / (t.n - c.n) AS j FROM {source} c, {name}_t t WHERE t.n > c.n), {name}_c AS (SELECT avg(j) AS c FROM {name}_j),
{name}_a AS (SELECT CASE WHEN sum((c - j) ** 2) > 0 THEN sum((c - j) ** 3) / (6 * sum((c - j) ** 2) ** 1.5) ELSE 0 END AS accel FROM {name}_j, {name}_c), {name}_p AS (SELECT avg((d.m < t.s / t.n)::INT) AS share FROM {draws} d, {name}_t t),
{name}_z AS (SELECT CASE WHEN share > 0 AND share < 1 AND g >= 3 THEN {z("share")} END AS z0, accel, s / n AS mean FROM {name}_p, {name}_a, {name}_t),
{name}_l AS (SELECT *, CASE WHEN z0 IS NULL THEN 0.025 ELSE {PHI.format(f"(z0 + (z0 + {z('0.025::DOUBLE')}) / (1 - accel * (z0 + {z('0.025::DOUBLE')})))")} END AS low, CASE WHEN z0 IS NULL THEN 0.975 ELSE {PHI.format(f"(z0 + (z0 + {z('0.975::DOUBLE')}) / (1 - accel * (z0 + {z('0.975::DOUBLE')})))")} END AS high FROM {name}_z),
{name}_s AS (SELECT list_sort(list(m)) AS d FROM {draws}),
{name} AS (SELECT mean, z0, accel, d[floor((len(d) - 1) * low)::INT + 1] + ((len(d) - 1) * low - floor((len(d) - 1) * low)) * (d[least(len(d), floor((len(d) - 1) * low)::INT + 2)] - d[floor((len(d) - 1) * low)::INT + 1]) AS lo,
d[floor((len(d) - 1) * high)::INT + 1] + ((len(d) - 1) * high - floor((len(d) - 1) * high)) * (d[least(len(d), floor((len(d) - 1) * high)::INT + 2)] - d[floor((len(d) - 1) * high)::INT + 1]) AS hi FROM {name}_l, {name}_s)"""


@add("g2_bootstrap_ci", f"WITH {D}, {boot_sql('bt', 'i', 11)} SELECT round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM bt")
def g2(spark, d):
    return rounded(R.percentile_interval(R.bootstrap_means(R.cluster_sums(deltas(spark, d), "cluster", "delta"), BOOT, 11), 0.95))


@add("g4_bca", f"WITH {D}, {boot_sql('bt', 'i', 11)}, {bca_sql('q', 'i', 'bt')} SELECT round(mean, 6) AS mean, round(z0, 6) AS z0, round(accel, 6) AS accel, round(lo, 6) AS lo, round(hi, 6) AS hi FROM q")
def g4(spark, d):
    return rounded(R.bca_interval(R.cluster_sums(deltas(spark, d), "cluster", "delta"), BOOT, 11))


@add("g6_wild_p", f"""WITH {D}, r AS (SELECT cluster, n, s, s - n * {MEAN} AS r, {MEAN} AS mean, (SELECT sum(n) FROM c) AS total FROM c),
w AS (SELECT b, cluster, n, CASE WHEN {HASH.format("'13:' || b || ':' || cluster")} % 2 = 0 THEN r ELSE -r END AS e, total FROM range({BOOT}) x(b), r),
m AS (SELECT b, sum(e) / any_value(total) AS m FROM w GROUP BY b), t AS (SELECT b, any_value(m) / (sqrt(sum((e - n * m) ** 2)) / any_value(total)) AS t FROM w JOIN m USING (b) GROUP BY b),
o AS (SELECT any_value(mean) AS mean, any_value(mean) / (sqrt(sum(r * r)) / any_value(total)) AS t FROM r)
SELECT round(o.mean, 6) AS mean, round(o.t, 6) AS t, round((1 + count(*) FILTER (abs(t.t) >= abs(o.t) - 1e-12)) / {BOOT + 1}.0::DOUBLE, 6) AS p FROM t, o GROUP BY o.mean, o.t""")
def g6(spark, d):
    return rounded(R.wild_p(R.cluster_sums(deltas(spark, d), "cluster", "delta"), BOOT, 13))


@add("g7_sign_test", """WITH x AS (SELECT c_mktsegment, count(*) FILTER (c_acctbal > 4500) AS wins, count(*) FILTER (c_acctbal <> 4500) AS n FROM customer GROUP BY 1)
SELECT c_mktsegment, wins, n, round(least(1.0, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM range(0, 100000) r(i) WHERE i BETWEEN greatest(wins, n - wins) AND n)), 6) AS p FROM x""")
def g7(spark, d):
    x = table(spark, d, "customer").select("c_mktsegment", (F.col("c_acctbal") - 4500).alias("delta"))
    return rounded(R.sign_test(x, "delta", "c_mktsegment"))


@add("g8_wilcoxon", """WITH x AS (SELECT c_mktsegment, c_acctbal - 4500 AS v, abs(c_acctbal - 4500) AS a FROM customer WHERE c_acctbal <> 4500),
k AS (SELECT *, rank() OVER (PARTITION BY c_mktsegment ORDER BY a) + (count(*) OVER (PARTITION BY c_mktsegment, a) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY c_mktsegment, a) AS t FROM x)
SELECT c_mktsegment, count(*) AS n, round(sum(CASE WHEN v > 0 THEN r ELSE 0 END)::DOUBLE, 6) AS w,
round(((sum(CASE WHEN v > 0 THEN r ELSE 0 END) - count(*) * (count(*) + 1) / 4.0) / sqrt(count(*) * (count(*) + 1.0) * (2 * count(*) + 1) / 24.0 - sum(t * t - 1) / 48.0))::DOUBLE, 6) AS z FROM k GROUP BY c_mktsegment""")
def g8(spark, d):
    x = table(spark, d, "customer").select("c_mktsegment", (F.col("c_acctbal") - 4500).alias("delta"))
    return rounded(R.wilcoxon(x, "delta", "c_mktsegment").drop("p"))


PADDED = f"{A}, v AS (SELECT doc_id, cluster, question, answer, answer || ' ' || {quoted(' '.join(stimuli.FILLER[:2]))} AS padded FROM a), sc AS (SELECT cluster, ({WORDS.format('padded')} * 0.01::DOUBLE + ({U.format("'7:' || question || ':' || padded")} - 0.5) * 0.4) - ({WORDS.format('answer')} * 0.01::DOUBLE + ({U.format("'7:' || question || ':' || answer")} - 0.5) * 0.4) AS delta FROM v)"


#: One-sided sign test and the signed ranks of x (delta): sg (wins, n, p_sign), wx (p_wilcoxon).
SIGNS = """sg AS (SELECT wins, n, CASE WHEN n = 0 THEN 1 ELSE least(1.0, {side} * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM range(0, 200000) r(i) WHERE i BETWEEN {least} AND n)) END AS p_sign FROM (SELECT count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta <> 0) AS n FROM {x})),
wk AS (SELECT delta AS v, rank() OVER (ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY abs(delta)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY abs(delta)) AS t FROM {x} WHERE delta <> 0),
wz AS (SELECT ((sum(CASE WHEN v > 0 THEN r ELSE 0 END) - count(*) * (count(*) + 1) / 4.0) / sqrt(count(*) * (count(*) + 1.0) * (2 * count(*) + 1) / 24.0 - sum(t * t - 1) / 48.0))::DOUBLE AS z FROM wk)"""


@add("g9_paired_contrast", f"""WITH {PADDED}, c AS (SELECT cluster, sum(delta) AS s, count(*) AS n, sum((delta > 0)::INT)::DOUBLE AS won FROM sc GROUP BY cluster), m AS (SELECT sum(s) / sum(n) AS mean, sum(n) AS total FROM c),
q AS (SELECT any_value(total)::BIGINT AS n_items, count(*) AS n_clusters, any_value(mean) AS mean_delta, sqrt(sum((s - n * mean) ** 2)) / any_value(total) AS cluster_se FROM c, m),
i AS (SELECT s, n, row_number() OVER (ORDER BY cluster) - 1 AS ix, count(*) OVER () AS g FROM c), iw AS (SELECT won AS s, n, row_number() OVER (ORDER BY cluster) - 1 AS ix, count(*) OVER () AS g FROM c),
{boot_sql('bt', 'i', 5)}, {bca_sql('bd', 'i', 'bt')}, {boot_sql('bw', 'iw', 6)}, {bca_sql('bx', 'iw', 'bw')}, {SIGNS.format(x='sc', side=2, least='greatest(wins, n - wins)')}, w AS (SELECT stddev_samp(delta) AS sd FROM sc)
SELECT 'padding_d2' AS name, 'style' AS family, n_items, n_clusters, round(mean_delta, 6) AS mean_delta, round(sd, 6) AS sd_delta, round(bd.lo, 5) AS ci_low, round(bd.hi, 5) AS ci_high, round(wins::DOUBLE / sg.n, 6) AS win_rate,
CASE WHEN (SELECT max(m) - min(m) FROM bw) < 1e-8 THEN round(bx.mean, 5) ELSE round(bx.lo, 5) END AS win_ci_low, CASE WHEN (SELECT max(m) - min(m) FROM bw) < 1e-8 THEN round(bx.mean, 5) ELSE round(bx.hi, 5) END AS win_ci_high,
round(p_sign, 6) AS p_sign, round(2 * (1 - {PHI.format('least(abs(z), 9)')}), 6) AS p_wilcoxon, round(cluster_se, 6) AS cluster_se, round(mean_delta / cluster_se, 4) AS t_stat, true AS two_sided, 0::BIGINT AS n_truncated, NULL::DOUBLE AS p_adjusted FROM q, w, sg, wz, bd, bx""")
def g9(spark, d):
    """documents, their padded variants, both scored; one paired contrast clustered by source."""
    a = answers(spark, d)
    v = a.select("cluster", "question", "answer", stimuli.padding(F.col("answer"), 2).alias("padded"))
    s = lambda c: scoring.score(F.col("question"), F.col(c), size=0.2)
    x = v.select("cluster", (s("padded") - s("answer")).alias("delta"))
    out = R.paired_contrast(x, BOOT, 5)
    bounds = ("ci_low", "ci_high", "win_ci_low", "win_ci_high")
    out = out.withColumns({c: F.round(c, 4 if c == "t_stat" else 5 if c in bounds else 6) for c, t in out.dtypes if t == "double"})
    return out.select(F.lit("padding_d2").alias("name"), F.lit("style").alias("family"), *out.columns)


@add("g11_westfall_young", f"""WITH {D}, k AS (SELECT contrast, cluster, sum(delta) AS s, count(*) AS n FROM d GROUP BY ALL), m AS (SELECT contrast, sum(s) / sum(n) AS mean, sum(n) AS total FROM k GROUP BY contrast),
o AS (SELECT contrast, any_value(mean) / (sqrt(sum((s - n * mean) ** 2)) / any_value(total)) AS t, any_value(total) AS total FROM k JOIN m USING (contrast) GROUP BY contrast), r AS (SELECT *, row_number() OVER (ORDER BY abs(t) DESC, contrast) AS rank FROM o),
w AS (SELECT b, contrast, n, CASE WHEN {HASH.format("'17:' || b || ':' || cluster")} % 2 = 0 THEN s ELSE -s END AS e FROM range({PERM}) x(b), k), wm AS (SELECT b, contrast, sum(e) / sum(n) AS m FROM w GROUP BY ALL),
tb AS (SELECT b, contrast, abs(any_value(m) / (sqrt(sum((e - n * m) ** 2)) / sum(n))) AS tb FROM w JOIN wm USING (b, contrast) GROUP BY ALL),
tops AS (SELECT contrast, rank, t, max(tb) OVER (PARTITION BY b ORDER BY rank DESC) AS top FROM tb JOIN r USING (contrast)), p AS (SELECT contrast, rank, t, (1 + count(*) FILTER (top >= abs(t) - 1e-12)) / {PERM + 1}.0::DOUBLE AS p FROM tops GROUP BY ALL)
SELECT contrast, round(t, 6) AS t, round(least(1.0, max(p) OVER (ORDER BY rank)), 6) AS p FROM p""")
def g11(spark, d):
    return rounded(R.westfall_young(R.cluster_sums(deltas(spark, d), "cluster", "delta", "contrast"), "contrast", PERM, 17).drop("p_single"))


@add("f3_bh", """WITH p AS (SELECT l_suppkey, abs(sin(l_suppkey)) * avg(l_discount) AS p FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, l_suppkey) AS k, count(*) OVER () AS m FROM p)
SELECT l_suppkey, round(p, 8) AS p, round(least(1.0, min(p * m / k) OVER (ORDER BY k DESC)), 8) AS q FROM r""")
def f3(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("a")).select("l_suppkey", (F.abs(F.sin("l_suppkey")) * F.col("a")).alias("p"))
    return rounded(R.benjamini_hochberg(p, "p", "l_suppkey"), 8)


@add("e7_win_rate", f"WITH {D} SELECT contrast, round(coalesce(count(*) FILTER (delta > 0)::DOUBLE / nullif(count(*) FILTER (delta <> 0), 0), 0.5), 6) AS win_rate FROM d GROUP BY contrast")
def e7(spark, d):
    n = F.sum((F.col("delta") != 0).cast("long"))
    return deltas(spark, d).groupBy("contrast").agg(F.round(F.coalesce(F.sum((F.col("delta") > 0).cast("long")) / F.nullif(n, F.lit(0)), F.lit(0.5)), 6).alias("win_rate"))


NAMES = f"x AS (SELECT source, doc_id // 20 AS name, {WORDS.format("coalesce(text, '')")} * 0.01::DOUBLE AS score FROM documents), n AS (SELECT name, name % 4 AS grp, name % 2 AS stratum, avg(score - m) AS m FROM (SELECT *, avg(score) OVER (PARTITION BY source) AS m FROM x) GROUP BY name)"


def names(spark, d):
    """documents as names (doc_id over 20) in groups and strata, with their mean score, centred within their source."""
    x = table(spark, d, "documents").select("source", F.floor(F.col("doc_id") / 20).alias("name"), scoring.length_score(F.col("text")).alias("score"))
    x = R.centred(x, "score", "source")
    return x.groupBy("name").agg(F.avg("centred").alias("m")).select("name", (F.col("name") % 4).alias("grp"), (F.col("name") % 2).alias("stratum"), "m")


@add("f1_template_centred", f"WITH {NAMES} SELECT grp, round(avg(m), 6) AS group_mean, count(*) AS names FROM n GROUP BY grp")
def f1(spark, d):
    return rounded(names(spark, d).groupBy("grp").agg(F.avg("m").alias("group_mean"), F.count(F.lit(1)).alias("names")))


def _omnibus_sql(stratum: str) -> str:
    return f"""WITH {NAMES}, z AS (SELECT name, grp, {stratum} AS stratum, m FROM n), g AS (SELECT grp, avg(m) AS g FROM z GROUP BY grp), o AS (SELECT max(g) - min(g) AS gap FROM g),
sl AS (SELECT stratum, row_number() OVER (PARTITION BY stratum ORDER BY grp, name) AS slot, grp FROM z),
dl AS (SELECT b, stratum, m, row_number() OVER (PARTITION BY b, stratum ORDER BY {HASH.format("'19:' || b || ':' || name")}, name) AS slot FROM range({PERM}) x(b), z),
nu AS (SELECT b, max(g) - min(g) AS gap_b FROM (SELECT b, grp, avg(m) AS g FROM dl JOIN sl USING (stratum, slot) GROUP BY ALL) GROUP BY b)
SELECT round(gap, 6) AS gap, round((1 + count(*) FILTER (gap_b >= gap - 1e-12)) / {PERM + 1}.0::DOUBLE, 6) AS p, round(avg(gap_b), 6) AS null_mean, round(quantile_cont(gap_b, 0.95), 6) AS null_p95 FROM nu, o GROUP BY gap"""


@add("g13_omnibus", _omnibus_sql("stratum"))
def g13(spark, d):
    return rounded(R.omnibus(names(spark, d), PERM, 19))


@add("g14_within_template", f"""WITH {NAMES}, z AS (SELECT name // 8 AS template, name % 8 AS level, m - avg(m) OVER (PARTITION BY name // 8) AS c FROM n), o AS (SELECT max(m) - min(m) AS gap, count(*) AS n_levels FROM (SELECT level, avg(c) AS m FROM z GROUP BY level)),
sl AS (SELECT template, level, row_number() OVER (PARTITION BY template ORDER BY level) AS slot FROM z), dl AS (SELECT b, template, c, row_number() OVER (PARTITION BY b, template ORDER BY {HASH.format("'19:' || b || ':' || template || ':' || level")}, level) AS slot FROM range({PERM}) x(b), z),
nu AS (SELECT b, max(m) - min(m) AS gap_b FROM (SELECT b, level, avg(c) AS m FROM dl JOIN sl USING (template, slot) GROUP BY ALL) GROUP BY b)
SELECT round(gap, 6) AS gap, n_levels, round((1 + count(*) FILTER (gap_b >= gap - 1e-12)) / {PERM + 1}.0::DOUBLE, 6) AS p, round(quantile_cont(gap_b, 0.95), 6) AS null_p95, (SELECT count(DISTINCT template) FROM z) AS n_templates FROM nu, o GROUP BY gap, n_levels""")
def g14(spark, d):
    """Eight levels (names over eight) of each template: are some scored higher?"""
    x = names(spark, d).select(F.floor(F.col("name") / 8).alias("template"), (F.col("name") % 8).alias("level"), F.col("m").alias("score"))
    return rounded(R.within_template(x, PERM, 19))


@add("g15_half_split", f"""WITH {NAMES}, z AS (SELECT *, count(*) OVER (PARTITION BY grp) AS size FROM n),
r AS (SELECT b, grp, m, size, row_number() OVER (PARTITION BY b, grp ORDER BY {HASH.format("'23:' || b || ':' || name")}, name) AS rank FROM range({PERM}) x(b), z WHERE size >= 4),
h AS (SELECT b, grp, abs(avg(m) FILTER (rank <= size // 2) - avg(m) FILTER (rank > size // 2)) AS gap FROM r GROUP BY ALL)
SELECT round(avg(gap), 6) AS mean_gap, round(quantile_cont(gap, 0.95), 6) AS p95, count(*) AS n FROM h""")
def g15(spark, d):
    return rounded(R.half_split(names(spark, d), PERM, 23))


@add("g25_split", f"SELECT doc_id, CASE WHEN ntile(2) OVER (ORDER BY {HASH.format("'29:' || doc_id")}, doc_id) = 1 THEN 'dev' ELSE 'test' END AS split FROM documents")
def g25(spark, d):
    """The median of the hashes splits the items: counts by their upper 16 bits find its bucket, and only that is sorted."""
    x = table(spark, d, "documents").select("doc_id", hashed(F.lit(29), F.col("doc_id")).alias("h"))
    counts = sorted((r["k"], r["n"]) for r in x.groupBy(F.shiftright("h", 16).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect())  # 65,536 rows at most
    left, first = (sum(n for _, n in counts) + 1) // 2, F.lit(True)
    for k, n in counts:
        if left <= n:
            edge = x.where(F.shiftright("h", 16) == k).orderBy("h", "doc_id").limit(left).orderBy(F.desc("h"), F.desc("doc_id")).first()
            first = (F.col("h") < edge["h"]) | (F.col("h") == edge["h"]) & (F.col("doc_id") <= edge["doc_id"])
            break
        left -= n
    return x.select("doc_id", F.when(first, "dev").otherwise("test").alias("split"))


ALL_PAIRS = f"s AS (SELECT doc_id, source, {WORDS.format("coalesce(text, '')")} * 0.01::DOUBLE AS score, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents), w AS (SELECT a.source, a.score - b.score AS delta FROM s a JOIN s b ON a.source = b.source AND a.i < b.i)"


def value_pairs(spark, d, salts: int = 32):
    """(source, d, gap, c): of all pairs of a source, how many (c) have two given word counts, d and gap (scored) apart.

    Pairs are made of the different word counts only, and a source's are dealt by them, so that it is not one task's work.
    """
    x = table(spark, d, "documents").where("source is not null").groupBy("source", word_count(F.col("text")).alias("v")).agg(F.count(F.lit(1)).alias("m"))
    a = x.select("source", F.pmod(F.xxhash64("v"), F.lit(salts)).alias("salt"), F.col("v").alias("u"), F.col("m").alias("k"))
    b = x.select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), "v", "m")
    c = F.when(F.col("u") == F.col("v"), F.expr("m * (m - 1) div 2")).otherwise(F.col("k") * F.col("m"))
    return a.join(b, ["source", "salt"]).where("u >= v").select("source", (F.col("u") - F.col("v")).alias("d"), (F.col("u") * 0.01 - F.col("v") * 0.01).alias("gap"), c.alias("c")).where("c > 0")


@add("d14_pairwise_paraphrase", f"WITH {ALL_PAIRS} SELECT source, count(*) AS pairs, round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS sd, round(quantile_cont(abs(delta), 0.95), 6) AS p95 FROM w GROUP BY source")
@add("d14_all_pairs", f"WITH {ALL_PAIRS} SELECT source, count(*) AS pairs, round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS sd, round(quantile_cont(abs(delta), 0.95), 6) AS p95 FROM w GROUP BY source")
def d14_all(spark, d):
    """Statistics of all pairs, earlier less later id. The i-th of n is added in n - i pairs and taken off in i - 1;
    ids are ranked in blocks of 2,000, whose counts give the ranks before them."""
    x = table(spark, d, "documents").select("source", "doc_id", F.floor(F.col("doc_id") / 2000).alias("block"), word_count(F.col("text")).alias("v"))
    ranked = x.withColumn("i", F.row_number().over(Window.partitionBy("source", "block").orderBy("doc_id")))
    blocks = ranked.groupBy("source", "block").agg(F.count(F.lit(1)).alias("m"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("i")).alias("si"))
    w = Window.partitionBy("source")
    blocks = blocks.withColumn("n", F.sum("m").over(w)).withColumn("before", F.sum("m").over(w.orderBy("block")) - F.col("m"))
    part = F.col("s") * (F.col("n") + 1 - 2 * F.col("before")) - 2 * F.col("si")
    sums = blocks.groupBy("source").agg((F.sum(part.cast("double")) * 0.01).alias("total"))
    gaps_of = value_pairs(spark, d).groupBy("source", "d").agg(F.sum("c").alias("c")).groupBy("source").agg(
        F.sum("c").alias("pairs"), (F.sum(F.col("c") * (F.col("d") * 0.01) ** 2)).alias("sq"), F.percentile(F.col("d") * 0.01, 0.95, F.col("c")).alias("p95")
    )
    mean = F.col("total") / F.col("pairs")
    sd = F.when(F.col("pairs") > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("sq") - F.col("pairs") * mean * mean) / (F.col("pairs") - 1)))
    return rounded(gaps_of.join(sums, "source").select("source", "pairs", mean.alias("mean"), sd.alias("sd"), "p95"))


@add("e13_noise_percentile", f"WITH {ALL_PAIRS}, e AS (SELECT source, avg(score) - (SELECT avg(score) FROM s) AS effect FROM s GROUP BY source) SELECT e.source, round(effect, 6) AS effect, round(avg((abs(w.delta) < abs(effect))::INT) * 100, 4) AS percentile, abs(effect) > (SELECT quantile_cont(abs(delta), 0.95) FROM w) AS beyond FROM e, w GROUP BY e.source, effect")
@add("e13_all_pairs", f"WITH {ALL_PAIRS}, e AS (SELECT source, avg(score) - (SELECT avg(score) FROM s) AS effect FROM s GROUP BY source) SELECT e.source, round(effect, 6) AS effect, round(avg((abs(w.delta) < abs(effect))::INT) * 100, 4) AS percentile, abs(effect) > (SELECT quantile_cont(abs(delta), 0.95) FROM w) AS beyond FROM e, w GROUP BY e.source, effect")
def e13_all(spark, d):
    x = table(spark, d, "documents").select("source", scoring.length_score(F.col("text")).alias("score"))
    e = x.groupBy("source").agg(F.avg("score").alias("m")).crossJoin(x.agg(F.avg("score").alias("all"))).select(F.col("source").alias("of"), (F.col("m") - F.col("all")).alias("effect"))
    w = value_pairs(spark, d).groupBy("d").agg(F.sum("c").alias("c")).withColumn("gap", F.col("d") * 0.01)
    counted = w.crossJoin(F.broadcast(e)).groupBy("of", "effect").agg((F.sum(F.when(F.col("gap") < F.abs("effect"), F.col("c")).otherwise(0)) / F.sum("c") * 100).alias("percentile"))
    bar = w.agg(F.percentile("gap", 0.95, F.col("c")).alias("bar"))
    return counted.crossJoin(bar).select(F.col("of").alias("source"), F.round("effect", 6).alias("effect"), F.round("percentile", 4).alias("percentile"), (F.abs("effect") > F.col("bar")).alias("beyond"))


@add("e18_histogram", f"WITH {ALL_PAIRS}, m AS (SELECT max(abs(delta)) AS top FROM w) SELECT least(23, floor(abs(delta) / top * 24))::BIGINT AS bin, count(*) AS n FROM w, m GROUP BY 1")
@add("e18_all_pairs", f"WITH {ALL_PAIRS}, m AS (SELECT max(abs(delta)) AS top FROM w) SELECT least(23, floor(abs(delta) / top * 24))::BIGINT AS bin, count(*) AS n FROM w, m GROUP BY 1")
def e18_all(spark, d):
    w = value_pairs(spark, d)
    x = w.crossJoin(w.agg(F.max("gap").alias("top")))
    return x.groupBy(F.least(F.lit(23), F.floor(F.col("gap") / F.col("top") * 24)).cast("long").alias("bin")).agg(F.sum("c").alias("n"))


GAPS = f"sc AS (SELECT doc_id, lang, quality, {WORDS.format("coalesce(text, '')")} * 0.01::DOUBLE + ({U.format("'31:' || doc_id")} - 0.5) * 4 AS score FROM documents JOIN labels USING (doc_id)), rk AS (SELECT *, row_number() OVER (PARTITION BY lang, quality ORDER BY doc_id) AS k FROM sc), gp AS (SELECT a.lang, a.k, a.score - b.score AS gap FROM rk a JOIN rk b ON a.lang = b.lang AND a.k = b.k AND a.quality = 1 AND b.quality = 0)"


def gaps(spark, d, seed: int = 31):
    """Preference gaps: the k-th good and the k-th poor document of a language, scored.

    Documents are ranked in blocks of 2,000 ids; the counts of the blocks before give the rest of the rank.
    """
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    x = x.select("doc_id", F.floor(F.col("doc_id") / 2000).alias("block"), "lang", "quality", (scoring.length_score(F.col("text")) + (uniform(F.lit(seed), F.col("doc_id")) - 0.5) * 4).alias("score"))
    counts = x.groupBy("lang", "quality", "block").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("lang", "quality", "block", (F.sum("n").over(Window.partitionBy("lang", "quality").orderBy("block")) - F.col("n")).alias("before"))
    x = x.withColumn("k", F.row_number().over(Window.partitionBy("lang", "quality", "block").orderBy("doc_id"))).join(counts, ["lang", "quality", "block"]).withColumn("k", F.col("k") + F.col("before"))
    good, poor = x.where("quality = 1").select("lang", "k", F.col("score").alias("a")), x.where("quality = 0").select("lang", "k", F.col("score").alias("b"))
    return good.join(poor, ["lang", "k"]).select("lang", "k", (F.col("a") - F.col("b")).alias("gap"))


@add("e17_reliability", f"""WITH {GAPS}, c AS (SELECT 1 / (1 + exp(-abs(gap) / 3)) AS p, gap > 0 AS won FROM gp), e AS (SELECT list_distinct([quantile_cont(p, k / 8.0) FOR k IN range(0, 9)]) AS dummy FROM (SELECT 1 AS p) t),
q AS (SELECT list_sort(list_distinct([quantile_cont(p, 0.0), quantile_cont(p, 0.125), quantile_cont(p, 0.25), quantile_cont(p, 0.375), quantile_cont(p, 0.5), quantile_cont(p, 0.625), quantile_cont(p, 0.75), quantile_cont(p, 0.875), quantile_cont(p, 1.0)])) AS edges FROM c),
b AS (SELECT p, won, least(len(list_filter(edges, lambda x: x <= p)), len(edges) - 1) AS bin FROM c, q)
SELECT bin::BIGINT AS bin, round(avg(p), 6) AS predicted, round(avg(won::INT), 6) AS observed, count(*) AS n FROM b GROUP BY bin HAVING count(*) >= 5""".replace(", e AS (SELECT list_distinct([quantile_cont(p, k / 8.0) FOR k IN range(0, 9)]) AS dummy FROM (SELECT 1 AS p) t)", ""))
def e17(spark, d):
    c = gaps(spark, d).select((1 / (1 + F.exp(-F.abs("gap") / 3))).alias("p"), (F.col("gap") > 0).alias("won"))
    edges = quantiles(c, "p", [k / 8 for k in range(9)]).select(F.array_sort(F.array_distinct("q")).alias("edges"))
    b = c.crossJoin(F.broadcast(edges)).withColumn("bin", F.least(F.size(F.filter("edges", lambda x: x <= F.col("p"))), F.size("edges") - 1).cast("long"))
    return rounded(b.groupBy("bin").agg(F.avg("p").alias("predicted"), F.avg(F.col("won").cast("int")).alias("observed"), F.count(F.lit(1)).alias("n")).where("n >= 5"))


@add("g22_temperature", f"""WITH {GAPS}, t AS (SELECT k, exp(ln(0.05) + (ln(100) - ln(0.05)) * k / 200.0) AS t FROM range(0, 201) r(k)), l AS (SELECT t.k AS k, t, avg(ln(1 + exp(-least(50, greatest(-50, gap / t))))) AS nll FROM gp, t GROUP BY t.k, t)
SELECT round(arg_min(t, row(round(nll, 9), k)), 6) AS temperature, round(min(nll), 6) AS log_loss, (SELECT count(*) FROM gp) AS n_pairs, (SELECT round(avg((gap > 0)::INT), 6) FROM gp) AS accuracy FROM l""")
def g22(spark, d):
    import math

    g = gaps(spark, d)
    grid = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(math.exp(math.log(0.05) + (math.log(100) - math.log(0.05)) * k / 200.0)).alias("t")) for k in range(201)])
    nll = g.select("gap", F.inline(grid)).groupBy("k", "t").agg(F.avg(F.log(1 + F.exp(-F.least(F.lit(50.0), F.greatest(F.lit(-50.0), F.col("gap") / F.col("t")))))).alias("nll"))
    best = nll.agg(F.min_by("t", F.struct(F.round("nll", 9), "k")).alias("temperature"), F.min("nll").alias("log_loss"))
    return rounded(best.crossJoin(g.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg((F.col("gap") > 0).cast("int")).alias("accuracy"))))


PANEL = "p AS (SELECT l_suppkey AS cluster, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem)"
KNOTS = "k AS (SELECT quantile_cont(x, 0.1) AS a, quantile_cont(x, 0.5) AS b, quantile_cont(x, 0.9) AS c FROM p)"
BASIS = "s AS (SELECT cluster, x, y, (greatest(x - a, 0) ** 3 - greatest(x - b, 0) ** 3 * (c - a) / (c - b) + greatest(x - c, 0) ** 3 * (b - a) / (c - b)) / (c - a) ** 2 AS z FROM p, k)"


def panel(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("cluster"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))


@add("g16_rcs_basis", f"WITH {PANEL}, {KNOTS}, {BASIS} SELECT cluster, count(*) AS n, round(avg(z), 6) AS mean_z, round(max(z), 6) AS max_z, round(avg(x * z), 4) AS mean_xz FROM s GROUP BY cluster")
def g16(spark, d):
    s = regression.with_spline(panel(spark, d), "x")
    return s.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("z1"), 6).alias("mean_z"), F.round(F.max("z1"), 6).alias("max_z"), F.round(F.avg(F.col("x") * F.col("z1")), 4).alias("mean_xz"))


@add("g18_fe_ols", f"""WITH {PANEL}, {KNOTS}, {BASIS}, c AS (SELECT x - avg(x) OVER w AS x, z - avg(z) OVER w AS z, y - avg(y) OVER w AS y FROM s WINDOW w AS (PARTITION BY cluster)),
m AS (SELECT sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz, sum(x * y) AS xy, sum(z * y) AS zy FROM c)
SELECT 'x' AS term, round((xy * zz - zy * xz) / (xx * zz - xz * xz), 5) AS coef FROM m UNION ALL SELECT 'z1', round((zy * xx - xy * xz) / (xx * zz - xz * xz), 5) FROM m""")
def g18(spark, d):
    fit = regression.fit_fe(regression.with_spline(panel(spark, d), "x"), "y", ["x", "z1"], "cluster")
    return fit.terms.select("term", F.round("coef", 5).alias("coef"))


@add("g19_cr2")
def g19(spark, d):
    return rounded(regression.fit_fe(regression.with_spline(panel(spark, d), "x"), "y", ["x", "z1"], "cluster").terms, 5)


@add("g20_wild_reg")
def g20(spark, d):
    return rounded(regression.wild_tests(regression.fit_fe(regression.with_spline(panel(spark, d), "x"), "y", ["x", "z1"], "cluster"), REG, 37), 5)


@add("g21_length_curve")
def g21(spark, d):
    x = regression.with_spline(panel(spark, d), "x")
    return rounded(regression.length_curve(x, regression.fit_fe(x, "y", ["x", "z1"], "cluster"), "x"), 5)
