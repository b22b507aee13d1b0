"""Corpora of questions, templates, scenarios and attacks: JSON files with stated schemas, as DataFrames of arms.

A file holds one object; its collections are exploded, and small ones (names, levels, affixes) are literals of the
file, so that crossing them with templates multiplies by a bounded number. A missing field is null, an empty
collection gives no arms, and repeated ids are kept as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from .tables import corpus

TEMPLATE = "struct<id: string, domain: string, distribution: string, question: string, response: string>"
# The fields of the corpora.
STYLE = "version string, note string, questions array<struct<id: string, question: string, neutral_answer: string, paraphrases: array<string>, elaboration: string, wrong_answer: string, poor_answer: string>>"
IDENTITY = f"version string, citation string, note string, name_groups map<string, array<string>>, templates array<{TEMPLATE}>, descriptor_axes map<string, array<string>>, descriptor_templates array<{TEMPLATE}>"
SYCOPHANCY = "scenarios array<struct<id: string, topic: string, user_claim: string, prompts: map<string, string>, responses: map<string, string>>>"
ATTACKS = "affixes array<struct<id: string, family: string, text: string, positions: array<string>, control_for: string, note: string>>, bases array<struct<id: string, type: string, text: string>>"


def style_questions(spark: SparkSession, path: str) -> DataFrame:
    """One row per question, its reference answers (neutral, paraphrases, neutral with elaboration) among its columns."""
    q = corpus(spark, path, STYLE).select(F.inline("questions"))
    references = F.concat(F.array("neutral_answer"), F.coalesce("paraphrases", F.array().cast("array<string>")), F.array(F.concat_ws(" ", "neutral_answer", "elaboration")))
    return q.withColumn("references", references)


def _filled(text: str, mark: str, value: str):
    return F.replace(F.col(text), F.lit(mark), F.col(value))


def identity_arms(spark: SparkSession, path: str) -> DataFrame:
    """(template_id, domain, distribution, grp, name, question, text): every template with every name in its place."""
    c = corpus(spark, path, IDENTITY)
    names = c.select(F.explode("name_groups").alias("grp", "names")).select("grp", F.explode("names").alias("name"))
    x = c.select(F.inline("templates")).crossJoin(F.broadcast(names))  # a literal of the file
    return x.select(F.col("id").alias("template_id"), "domain", "distribution", "grp", "name", _filled("question", "{name}", "name").alias("question"), _filled("response", "{name}", "name").alias("text"))


def descriptor_arms(spark: SparkSession, path: str) -> DataFrame:
    """(template_id, domain, distribution, axis, level, question, text): every descriptor template with every level."""
    c = corpus(spark, path, IDENTITY)
    levels = c.select(F.explode("descriptor_axes").alias("axis", "levels")).select("axis", F.explode("levels").alias("level"))
    x = c.select(F.inline("descriptor_templates")).crossJoin(F.broadcast(levels))  # a literal of the file
    return x.select(F.col("id").alias("template_id"), "domain", "distribution", "axis", "level", _filled("question", "{desc}", "level").alias("question"), _filled("response", "{desc}", "level").alias("text"))


def sycophancy_arms(spark: SparkSession, path: str) -> DataFrame:
    """(scenario_id, topic, insistence, cell, agrees, tone, question, text): every prompt of a scenario with every response."""
    s = corpus(spark, path, SYCOPHANCY).select(F.inline("scenarios"))
    x = s.select("id", "topic", "responses", F.explode("prompts").alias("insistence", "question")).select("id", "topic", "insistence", "question", F.explode("responses").alias("cell", "text"))
    return x.select(F.col("id").alias("scenario_id"), "topic", "insistence", "cell", F.col("cell").startswith("agrees").alias("agrees"), F.substring_index("cell", "_", -1).alias("tone"), "question", "text")


# The wording that a reduced grid keeps of each family, and the families that it keeps whole.
REDUCED = {
    "authority": "official",
    "citation": "consensus",
    "hhh_keywords": "safety_words",
    "meta_instruction": "grader_note",
    "politeness": "great_question",
    "reasoning_scaffold": "lets_break",
    "refusal_laundering": "consult_pro",
    "repetition": "repeat_summary",
    "self_praise": "clear_thorough",
    "self_rating": "gold_label",
    "structure": "headers",
}
WHOLE_FAMILIES = ("special_token", "lookalike_control", "neutral_control")


def reduced_grid(affixes: DataFrame, wordings: dict[str, str] | None = None, whole: tuple[str, ...] = WHOLE_FAMILIES) -> DataFrame:
    """affixes (at, id, family, positions, ...) of a reduced grid: families in `whole` with all their wordings, of the
    others the one that wordings names, or the first (least at) of a family that it doesn't know. Each stands in one
    place, as a suffix where it can; a neutral control keeps all its places, as others are held against it there."""
    named = F.create_map(*[F.lit(x) for kv in (wordings or REDUCED).items() for x in kv]) if wordings or REDUCED else None
    first = affixes.groupBy("family").agg(F.min_by("id", "at").alias("_first"))
    kept = affixes.join(F.broadcast(first), "family").where(F.col("family").isin(*whole) | (F.col("id") == F.coalesce(F.element_at(named, F.col("family")), F.col("_first")))).drop("_first")
    one = F.when((F.col("family") == "neutral_control") | (F.size("positions") <= 1), F.col("positions")).when(F.array_contains("positions", "suffix"), F.array(F.lit("suffix"))).otherwise(F.slice("positions", 1, 1))
    return kept.withColumn("positions", one)


def attack_affixes(spark: SparkSession, path: str, wordings: list[str] | None = None, reduced: bool = False) -> DataFrame:
    """(affix_id, family, affix, position, control_for). wordings: keep these affixes, each in one position, as in
    reduced_grid; reduced: the reduced grid itself."""
    a = corpus(spark, path, ATTACKS).select(F.posexplode("affixes").alias("at", "a")).select("at", "a.*")
    if wordings is not None:
        a = reduced_grid(a.where(F.col("id").isin(wordings)), whole=tuple(r[0] for r in a.select("family").distinct().collect()))
    elif reduced:
        a = reduced_grid(a)
    return a.select(F.col("id").alias("affix_id"), "family", F.col("text").alias("affix"), F.explode("positions").alias("position"), "control_for")


def attack_bases(spark: SparkSession, path: str, questions: DataFrame, reduced: bool = False, own_only: bool = False) -> DataFrame:
    """(question_id, base_id, type, text): the generic bases under every question, and its own wrong and poor answer.

    reduced: of the generic bases the first of each type, as the file lists them. own_only: none of them, as in a
    reduced grid, which attacks each question's own answers only.
    """
    b = corpus(spark, path, ATTACKS).select(F.posexplode("bases").alias("at", "b")).select("at", "b.*")
    if reduced:
        b = b.groupBy("type").agg(F.min_by(F.struct("id", "text"), "at").alias("b")).select("type", "b.*")
    generic = questions.select(F.col("id").alias("question_id")).crossJoin(F.broadcast(b.select(F.col("id").alias("base_id"), "type", "text")))  # a literal of the file
    own = F.array(F.struct(F.lit("wrong").alias("base_id"), F.lit("wrong").alias("type"), F.col("wrong_answer").alias("text")), F.struct(F.lit("poor").alias("base_id"), F.lit("poor").alias("type"), F.col("poor_answer").alias("text")))
    own = questions.select(F.col("id").alias("question_id"), F.inline(own))
    return own if own_only else generic.unionByName(own)


def inventory(spark: SparkSession, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """(corpus, collection, n): how many entries each top-level collection of each (path, schema) has."""
    parts = []
    for name, (path, schema) in paths.items():
        fields = [f for f in StructType.fromDDL(schema) if isinstance(f.dataType, (ArrayType, MapType))]
        sizes = F.array(*[F.struct(F.lit(name).alias("corpus"), F.lit(f.name).alias("collection"), F.greatest(F.lit(0), F.size(F.col(f.name))).cast("long").alias("n")) for f in fields])
        parts.append(corpus(spark, path, schema).select(F.inline(sizes)))
    return reduce(DataFrame.unionByName, parts)


def saved_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified): the result files of a folder, by name."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path", F.col("modificationTime").alias("modified")).orderBy("path")


def preferences(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """(chosen, rejected) transcripts, and why there are none, if the table is missing or lacks the columns."""
    try:
        found = spark.read.parquet(path).select("chosen", "rejected")
    except AnalysisException as e:  # not there, or without the columns: the run goes on uncalibrated; a failed read raises
        return spark.createDataFrame([], "chosen string, rejected string"), f"preference pairs unavailable ({type(e).__name__})"
    return found, None
