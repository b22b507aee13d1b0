"""Scoring of pairs that arrive as a file stream: each new text is scored once, whatever batch it comes in."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scoring import cache_key


def score_stream(spark: SparkSession, source: str, schema: str, cache: str, checkpoint: str, score: Callable[[Column, Column], Column], **scorer) -> StreamingQuery:
    """Read (question, answer) Parquet files as they come, score what `cache` (a Parquet table) lacks, and append it.

    scorer: what tells one scorer from another (model, revision and so on, as in cache_key), so that they share a cache
    without touching each other's scores. Batches are told apart by scorer and number, so one that is run again after a failure replaces its own part.
    """

    tag = hashlib.sha256(repr(sorted(scorer.items())).encode()).hexdigest()[:12]

    def one(batch: DataFrame, number: int) -> None:
        part = f"{tag}-{number}"
        keyed = batch.select("question", "answer", cache_key(F.col("question"), F.col("answer"), **scorer).alias("key")).dropDuplicates(["key"])
        old = spark.read.schema("key string, score double, part string").parquet(cache).where(F.col("part") != part).select("key")
        new = keyed.join(old, "key", "left_anti").select("key", score(F.col("question"), F.col("answer")).alias("score"))
        new.withColumn("part", F.lit(part)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(cache)

    spark.createDataFrame([], "key string, score double, part string").write.mode("append").partitionBy("part").parquet(cache)
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
