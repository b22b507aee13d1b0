"""Saved runs: one JSON object a run, under the run's name, read back in today's terms whatever version wrote it.

A run's object holds what is small by nature (its meta data, checks, findings and severities); tables that grow with the
data stay Parquet (plans.scan.run_scan). A folder of runs is one table, however many runs it holds, so migrating them is
a job over rows and not a loop over files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings as rules

# The fields of a saved run, present names and older ones.
_BASELINE = "struct<summary: struct<baseline_asr: struct<p50: double>>>"
META = "struct<model_id: string, depth: string, seed: long, probes: array<string>, steps: array<string>, results_path: string>"
FINDINGS = (
    "array<struct<category: string, title: string, effect: double, noise_percentile: double, p_adjusted: double, p_raw: double, confirmed: boolean, valence: string, "
    "detail: struct<kind: string, module: string, family: string>, n_items: long, systematic_bar: double, band: string, asr: struct<p50: double>>>"
)
SEVERITY = "struct<category: string, n_contrasts: long, n_vulnerabilities: long, n_material: long, prevalence: double, severity: double, band: string, worst_finding: string, worst_effect: double, worst_ratio: double>"
RUN = f"meta {META}, sanity_check struct<helpful_score: double, rude_score: double, margin: double, passed: boolean>, noise_floor struct<pairs: long, sd: double>, findings {FINDINGS}, severity map<string, {SEVERITY}>, reward_hacking {_BASELINE}, injection {_BASELINE}"


def run_name(model: str, depth: str, seed: int) -> str:
    return f"{model.replace('/', '__')}__{depth}__seed{seed}.json"


def _row(block: DataFrame) -> DataFrame:
    """The block's only row as a struct; null where it has none."""
    return block.agg(F.first(F.struct("*")).alias("v"))


def save_run(findings: DataFrame, out: str, model: str, depth: str, seed: int, probes: list[str], steps: list[str], sanity: DataFrame | None = None, noise: DataFrame | None = None) -> str:
    """Write a run and return its path, which the file itself holds too. findings: a row per contrast, as judged writes
    them; sanity and noise: one row each. A run of the same name is replaced."""
    spark = findings.sparkSession
    path = f"{out.rstrip('/')}/{run_name(model, depth, seed)}"
    meta = F.struct(
        F.lit(model).alias("model_id"), F.lit(depth).alias("depth"), F.lit(seed).cast("long").alias("seed"), F.array(*map(F.lit, probes)).cast("array<string>").alias("probes"),
        F.array(*map(F.lit, steps)).cast("array<string>").alias("steps"), F.lit(path).alias("results_path"),
    )
    said = F.struct(
        "category", "title", "effect", "noise_percentile", "p_adjusted", "p_raw", "confirmed", "valence", F.struct("kind", F.col("category").alias("module"), F.col("category").alias("family")).alias("detail"),
        F.col("n_items").cast("long").alias("n_items"), "systematic_bar", "band", F.struct(F.col("asr").alias("p50")).alias("asr"),
    )
    listed = findings.agg(F.sort_array(F.collect_list(said)).alias("findings"), F.struct(F.struct(F.struct(F.max("baseline").alias("p50")).alias("baseline_asr")).alias("summary")).alias("reward_hacking"))  # contrasts are few, whatever the data
    tiles = rules.severity(findings).agg(F.map_from_entries(F.collect_list(F.struct("category", F.struct("*").cast(SEVERITY)))).alias("severity"))
    run = spark.range(1).select(meta.alias("meta")).crossJoin(listed).crossJoin(tiles)  # one row each
    for name, block in (("sanity_check", sanity), ("noise_floor", noise)):
        if block is not None:
            run = run.crossJoin(_row(block).withColumnRenamed("v", name))
    run.coalesce(1).write.mode("overwrite").json(path)
    return path


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run, and the fields of RUN): the saved runs of a folder, each a file or a folder of its name. A file that is not
    JSON raises; fields that an older version lacks are null."""
    x = spark.read.schema(RUN).option("multiLine", True).option("mode", "FAILFAST").json(f"{folder.rstrip('/')}/*.json")
    return x.select(F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+\.json)(?:/[^/]*)?$", 1)).alias("run"), "*")


def migrated(runs: DataFrame) -> DataFrame:
    """The findings of runs, a row each, in today's terms: old names of probes are translated wherever they stand,
    valences of attacks and bands are derived again. A run without findings has no row."""
    baseline = F.coalesce("reward_hacking.summary.baseline_asr.p50", "injection.summary.baseline_asr.p50")
    x = runs.select("run", F.col("meta.probes").alias("probes"), F.col("meta.steps").alias("steps"), baseline.alias("baseline"), F.inline("findings"))
    x = x.withColumns({"kind": F.col("detail.kind"), "module": F.col("detail.module"), "family": F.col("detail.family"), "asr": F.col("asr.p50")})
    return rules.migrate(x.drop("detail", "band", "confirmed"))


def severities(findings: DataFrame) -> DataFrame:
    """Severity of every category in each run that has findings, from the findings and not from what a run says."""
    return rules.severity(findings, "run")
