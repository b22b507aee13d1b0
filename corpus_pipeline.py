"""A training-data pipeline over `documents`: quality, exact and near duplicates, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; between stages the rows are
written as Parquet and read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup, near_dedup, packing, quality, secrets
from plumbline.llm.common import member_filter, materialize, table

MOST_FILTER_BITS = 1 << 28
#: A column of the stages' own, whose name no documents have.
SHA = "_pipeline_sha"


def _sha() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)


def _apart(docs: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """docs that surely share no key with keys, and the others. docs and keys hold the columns of `on`.

    A broadcast filter of bounded size lets most texts stay where they are; only the others are worth a join.
    """
    keys = keys.select(F.xxhash64(*on).alias("_key")).distinct()
    bits = min(MOST_FILTER_BITS, max(1 << 16, 1 << (32 * keys.count()).bit_length()))
    words = materialize(member_filter(keys, "_key", bits), "filter").select(F.col("word").alias("_pipeline_word"), F.col("mask").alias("_pipeline_mask"))
    place = F.pmod(F.xxhash64(F.xxhash64(*on)), F.lit(bits).cast("long"))
    marked = docs.withColumn("_pipeline_word", F.shiftright(place, 6)).join(F.broadcast(words), "_pipeline_word", "left")
    hit = F.coalesce(F.getbit("_pipeline_mask", (place % 64).cast("int")) == 1, F.lit(False))
    return marked.where(~hit).select(*docs.columns), marked.where(hit).select(*docs.columns)


def _same(left: DataFrame, right: DataFrame, on: list[str]) -> Column:
    conditions = [left[c].eqNullSafe(right["_" + c]) for c in on]
    return functools.reduce(Column.__and__, conditions)


def _without(docs: DataFrame, dropped: DataFrame, on: list[str]) -> DataFrame:
    """docs without the rows whose `on` (null equals null) is in dropped."""
    dropped = materialize(dropped.select(*on).distinct(), "dropped")
    sure, other = _apart(docs, dropped, on)
    named = dropped.select(*[F.col(c).alias("_" + c) for c in on])
    return sure.unionByName(other.join(named, _same(other, named, on), "left_anti"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go, by their own text: a null text is scored as an empty one,
    rows with a null id or a repeated id each have their own verdict, and equal rows share it. Empty in, empty out."""
    rows = docs.withColumn(SHA, _sha())
    scored = quality.quality_scores(rows, table(spark, sf_dir, "labels"), carry=(SHA,))
    return _without(rows, scored.where("predicted = 0"), ["doc_id", SHA]).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty), one row with the largest id stays. A null id stays only where no row with
    the text has an id, and then once; rows that repeat id and text stay once. Empty in, empty out."""
    rows = docs.withColumn(SHA, _sha())
    groups = materialize(exact_dedup.exact_duplicates(docs).where("group_size > 1").select("doc_id", F.col("text_sha256").alias(SHA), (F.col("kept") | F.col("keep_id").isNull()).alias("stays")).distinct(), "groups")
    alone, repeated = _apart(rows, groups, [SHA])
    gone = groups.where("not stays").select(F.col("doc_id").alias("_doc_id"), F.col(SHA).alias("_" + SHA))
    once = repeated.join(gone, _same(repeated, gone, ["doc_id", SHA]), "left_anti").dropDuplicates(["doc_id", SHA])
    return alone.unionByName(once).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8), the document with the smallest id stays. Texts without words
    and rows with a null id stay; rows that share an id stay or go together. Empty in, empty out."""
    return _without(docs, near_dedup.near_duplicates(docs).where("not kept"), ["doc_id"])


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every row stays, and n_chars follows its text. A null text stays null."""
    own = docs.withColumnRenamed("spans", "_pipeline_spans")  # the scan has a column of that name
    masked = secrets.redact(secrets.find_secrets(own)).withColumn("n_chars", F.length("text").cast("long"))
    return masked.withColumnRenamed("_pipeline_spans", "spans").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences: of every row, repeated ones and null ids too; a null text is one piece."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages leave of the documents; an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Classifier, field and packing cannot be stated in SQL; tests/llm hold run() against brute force.
ORACLE_SQL = None
