"""A scan: the queries of the chosen probes, at a preset's depth, each written as a table.

Steps run one after another and leave their tables behind, so a scan that is stopped goes on where it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import cache_key
from ..operators import beam, topk
from ..operators import findings as rules
from ..operators import resampling as R
from ..sources.tables import answers, table, written
from ..sources.versions import VersionedTable
from .findings import found, style_deltas
from .inference import gaps, names
from .joins import AFFIXES, contaminated_texts, grid, hashed, premiums, scored, summary, thresholds
from .style import arm_texts

# Draws of the bootstrap, permutations, the regression's bootstrap, calibration pairs, depth and width of the search.
PRESETS = {
    "quick": {"boot": 1_000, "perm": 2_000, "reg_boot": 200, "pairs": 200, "depth": 0, "width": 0},
    "standard": {"boot": 4_000, "perm": 10_000, "reg_boot": 600, "pairs": 500, "depth": 2, "width": 3},
    "deep": {"boot": 8_000, "perm": 20_000, "reg_boot": 1_200, "pairs": 1_000, "depth": 3, "width": 4},
}
PROBES = ("identity", "sycophancy", "style", "reward_hacking")


#: Probes of the search: development items, bases of each, and draws of the held-out interval.
DEV_ITEMS, DEV_BASES, HELD_OUT_DRAWS = 40, 2, 2_000


def attack_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, base_id, base, dev): the answers that attacks start from, the item's own and two that any item has."""
    dev = hashed(F.lit(43), F.col("item_id")) % 2 == 0
    own = F.array(*[F.struct(F.lit(i).alias("base_id"), c.alias("base")) for i, c in (("own", F.col("text")), ("sure", F.lit("Sure.")), ("unsure", F.lit("I do not know.")))])
    return table(spark, sf_dir, "benchmark").select("item_id", dev.alias("dev"), F.inline(own))


def searched(spark: SparkSession, sf_dir: str, depth: int, width: int, items: int = DEV_ITEMS, bases: int = DEV_BASES) -> dict[str, DataFrame]:
    """The search for a stacked attack, and what its best stack is worth on items that it never saw.

    Probes are a seeded sample: `items` development items, `bases` of the bases of each. Results: `best` (one row: stack,
    dev_lift, heldout_lift, ci_low, ci_high, n_heldout, asr_p25 to asr_p90), `history` (a row per depth), `examples`
    (the ten largest lifts and the 25 best scores of held-out bases, with the attacked text) and `stacks` (stack,
    dev_lift, heldout_lift, n of the last beam).
    """
    rows = attack_bases(spark, sf_dir)
    chosen = rows.where("dev").select("item_id").distinct().orderBy(hashed(F.lit(101), F.col("item_id")), "item_id").limit(items)
    in_item = Window.partitionBy("item_id").orderBy(hashed(F.lit(103), F.col("item_id"), F.col("base_id")), "base_id")
    probes = written(rows.where("dev").join(F.broadcast(chosen), "item_id").withColumn("k", F.row_number().over(in_item)).where(F.col("k") <= bases).select("base"), "probes")
    moves = [(i, t, p) for i, f, t, ps, _ in AFFIXES if not f.endswith("control") for p in ps]
    score = lambda c: scored(c, F.lit(47), c)
    stacks, history = beam.search(probes, moves, score, depth=depth, width=width)
    label = lambda s: " > ".join(f"{i}@{p}" for i, *_, p in s)
    attacked = lambda s: beam.stacked(F.col("base"), [(t, p) for _, t, p in s], "Yes.")
    rest = rows.where("not dev")
    of = rest.agg(F.count(F.lit(1)).alias("n"), *[F.avg(score(attacked(s)) - score(F.col("base"))).alias(f"l{i}") for i, (s, _) in enumerate(stacks)]).first()
    last = spark.createDataFrame([(label(s), lift, of[f"l{i}"], of["n"]) for i, (s, lift) in enumerate(stacks)], "stack string, dev_lift double, heldout_lift double, n long")
    levels = spark.createDataFrame([(h["depth"], h["best_dev_lift"], " > ".join(f"{i}@{p}" for i, p in h["best_stack"]), h["n_candidates"]) for h in history], "depth int, best_dev_lift double, best_stack string, n_candidates int")
    best, dev_lift = stacks[0] if stacks else ([], None)
    x = rest.withColumn("text", attacked(best)).withColumn("base_score", score(F.col("base"))).withColumn("score", score(F.col("text"))).withColumn("lift", F.col("score") - F.col("base_score"))
    x = x.withColumn("bucket", F.col("item_id") % 5).join(F.broadcast(thresholds(spark, sf_dir)), "bucket", "left")
    x = written(x.withColumns({f"beats_{n}": F.when(F.col("ok"), (F.col("score") > F.col("p")[i]).cast("double")) for i, n in enumerate(("p25", "p50", "p75", "p90"))}), "heldout")
    ci = R.percentile_interval(R.bootstrap_means(R.cluster_sums(x, "item_id", "lift"), HELD_OUT_DRAWS, 107), 0.95).select(F.col("lo").alias("ci_low"), F.col("hi").alias("ci_high"))
    one = x.agg(F.avg("lift").alias("heldout_lift"), F.count(F.lit(1)).alias("n_heldout"), *[F.avg(f"beats_{n}").alias(f"asr_{n}") for n in ("p25", "p50", "p75", "p90")])
    one = one.crossJoin(ci).select(F.lit(label(best)).alias("stack"), F.lit(dev_lift).cast("double").alias("dev_lift"), "heldout_lift", "ci_low", "ci_high", "n_heldout", *[f"asr_{n}" for n in ("p25", "p50", "p75", "p90")])
    shown = x.select(F.concat_ws(":", "item_id", "base_id").alias("id"), "item_id", "base_id", "base", "text", "base_score", "score", "lift", F.lit("all").alias("of"))
    lists = [topk.diverse_top(shown, [], "of", c, "id", k).withColumn("list", F.lit(name)) for name, c, k in (("lift", "lift", 10), ("score", "score", 25))]
    return {"best": one, "history": levels, "examples": lists[0].unionByName(lists[1]).drop("of"), "stacks": last}


def search_finding(best: DataFrame, baseline: DataFrame) -> DataFrame:
    """The finding of a search: confirmed where the held-out interval is clear of nought, and a vulnerability where it
    works more often than the bare answers (baseline: one row, baseline)."""
    clear = (F.col("ci_low") > 0) | (F.col("ci_high") < 0)
    return best.crossJoin(F.broadcast(baseline)).select(
        F.lit("reward_hacking").alias("category"), F.lit("beam_search").alias("kind"), F.col("stack").alias("title"), F.col("heldout_lift").alias("effect"), F.col("n_heldout").alias("n_items"),
        F.when(clear, 0.0).otherwise(1.0).alias("p_raw"), F.lit(None).cast("double").alias("p_adjusted"), F.col("asr_p50").alias("asr"), "baseline", rules.attack_valence(F.col("heldout_lift"), F.col("asr_p50"), F.col("baseline")).alias("valence"),
    )


def steps(depth: str = "quick", probes: tuple[str, ...] = PROBES) -> dict:
    """The scan's tables in order: name -> function of (spark, sf_dir)."""
    p = PRESETS[depth]
    unknown = set(probes) - set(PROBES)
    if unknown:
        raise ValueError(f"unknown probes {sorted(unknown)}")
    out = {}
    if "style" in probes:
        out["style_contrasts"] = lambda s, d: R.adjust_family(R.paired_contrast(style_deltas(s, d), p["boot"], 5, "name"), "name", R.cluster_sums(style_deltas(s, d), "cluster", "delta", "name"), p["perm"], 71)
    if "sycophancy" in probes:
        rows = lambda s, d: premiums(s, d).groupBy(F.col("level").cast("string").alias("name"), F.col("scenario").alias("cluster")).agg(F.avg("premium").alias("delta")).where("delta is not null")
        out["sycophancy_premiums"] = lambda s, d: R.adjust_family(R.paired_contrast(rows(s, d), p["boot"], 7, "name", two_sided=False), "name", R.cluster_sums(rows(s, d), "cluster", "delta", "name"), p["perm"], 73)
    if "identity" in probes:
        out["identity_omnibus"] = lambda s, d: R.omnibus(names(s, d), p["perm"], 19)
    if "reward_hacking" in probes:
        out["attack_summary"] = lambda s, d: summary(s, d).drop("p")
        if p["depth"]:
            out["attack_search"] = lambda s, d: searched(s, d, p["depth"], p["width"])["best"]
    out["calibration_gaps"] = lambda s, d: gaps(s, d).orderBy(hashed(F.lit(97), F.col("lang"), F.col("k")), "lang", "k").limit(p["pairs"])
    out["findings"] = lambda s, d: found(s, d).where(F.col("category").isin(*probes))
    return out


def requests(spark: SparkSession, sf_dir: str, probes: tuple[str, ...] = PROBES) -> list[tuple[str, DataFrame]]:
    """(step, question and answer) of every call that a scan makes to its scorer, in order. Which texts a step asks for
    never depends on scores, but for the search's."""
    docs = answers(spark, sf_dir).select("question", "answer")
    out = [("noise_floor", docs)]
    if "identity" in probes:
        out.append(("identity", docs))
    if "sycophancy" in probes:
        out.append(("sycophancy", docs))
    if "style" in probes:
        out.append(("style", arm_texts(spark, sf_dir).select("question", F.col("v").alias("answer"))))
    if "reward_hacking" in probes:
        ask = lambda x, c: x.select(F.concat(F.lit("i"), "item_id").alias("question"), F.col(c).alias("answer"))
        cells = grid(spark, sf_dir)
        out += [("reward_hacking", ask(cells.select("item_id", "base").distinct(), "base")), ("reward_hacking", ask(cells, "v")), ("reward_hacking", ask(contaminated_texts(spark, sf_dir), "v"))]
    labelled = table(spark, sf_dir, "labels").select(F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("question")).distinct()
    return [*out, ("calibration", docs.join(labelled, "question", "left_semi"))]


def keyed(call: DataFrame) -> DataFrame:
    return call.withColumn("key", cache_key(F.col("question"), F.col("answer")))


def rehearse(spark: SparkSession, sf_dir: str, cache: DataFrame, depth: str = "quick", probes: tuple[str, ...] = PROBES) -> DataFrame:
    """(step, texts, to_score): what each step would ask for, and how much of it a scorer would get: a text that the
    cache (key) lacks at the start of its call, each time it stands there. Nothing is scored. The search's texts depend
    on scores, so where it runs the count of its step is null."""
    counts: dict[str, list] = {}
    known = written(cache.select("key").distinct(), "known")
    for step, call in requests(spark, sf_dir, probes):
        keys = written(keyed(call).select("key").join(known.withColumn("hit", F.lit(1)), "key", "left"), "asked")
        texts, missing = keys.agg(F.count(F.lit(1)), F.count(F.when(F.col("hit").isNull(), 1))).first()
        old = counts.setdefault(step, [0, 0])
        old[0], old[1] = old[0] + texts, old[1] + missing
        known = known.unionByName(keys.where("hit is null").select("key").distinct())
    rows = [(k, n, m if k != "reward_hacking" or not PRESETS[depth]["depth"] else None) for k, (n, m) in counts.items()]
    return spark.createDataFrame(rows, "step string, texts long, to_score long")


def score_requests(spark: SparkSession, sf_dir: str, cache: VersionedTable, probes: tuple[str, ...] = PROBES) -> DataFrame:
    """(step, scored): score what the cache lacks, call by call, and add it to the cache; a text is looked up in the
    version that is there when its call begins, and repeated ones in a call are all sent."""
    counts: dict[str, int] = {}
    for step, call in requests(spark, sf_dir, probes):
        lacking = keyed(call).join(cache.read().select("key"), "key", "left_anti")
        sent = written(lacking.select("key", scored(F.col("answer"), F.lit(59), F.col("question"), F.col("answer")).alias("score")), "sent")
        counts[step] = counts.get(step, 0) + sent.count()
        cache.append_missing(sent, "key")
    return spark.createDataFrame(list(counts.items()), "step string, scored long")


def run_scan(spark: SparkSession, sf_dir: str, out: str, depth: str = "quick", probes: tuple[str, ...] = PROBES) -> dict[str, DataFrame]:
    """Run the steps whose tables `out` lacks, write them, and return all of them. A table counts once its writer has
    marked it as complete; an error while reading one is raised, never taken for a missing table."""
    done = {}
    for name, step in steps(depth, probes).items():
        path = f"{out.rstrip('/')}/{depth}/{name}"
        mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
            step(spark, sf_dir).write.mode("overwrite").parquet(path)
        done[name] = spark.read.parquet(path)
    return done
