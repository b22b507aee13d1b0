"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of labels whose crc32(doc_id as text) leaves this remainder are never learnt from.
HELD_OUT_FOLDS, HELD_OUT_FOLD = 5, 0


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only local runs, which share /tmp, may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file:///tmp/checkpoints/plumbline"
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT_FOLDS == HELD_OUT_FOLD, F.lit(False))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows at most, chosen by the hash of key, the same ones on every run; all, if there are fewer.

    The share is the bound over the count, so that no sort and no single task is needed.
    """
    n = df.count()
    if n <= rows:
        return df
    grain = 1 << 30
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(grain)) < int(grain * rows / n))


def bounded_texts(rows: DataFrame, key: str, text: str, most_rows: int, most_chars: int) -> DataFrame:
    """(key, text): about most_rows rows at most, of at most most_chars characters each, so a bound of bytes too.

    Keys are sampled; of repeated ones the least text is taken. Null keys and texts, and longer texts, are left out.
    """
    fit = rows.select(key, text).where(F.col(key).isNotNull() & (F.length(text) <= most_chars))
    return bounded_sample(fit, key, most_rows).groupBy(key).agg(F.min(text).alias(text))


def training_labels(labels: DataFrame, label: str, rows: int, id_col: str = "doc_id") -> DataFrame:
    """(id, y) of labelled rows outside the held-out fold: about `rows` of them at most.

    Rows without id or label are left out; of repeated ids the larger label counts.
    """
    return bounded_sample(
        labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("double").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("y").alias("y")),
        "doc_id", rows,
    )


def join_hot(rows: DataFrame, groups: DataFrame, on: str, size: str, total: int, share: int = 1_000) -> DataFrame:
    """rows joined with groups (one row per key, best a written table), where a few keys may hold most rows.

    size: a group's number of rows in `rows`, which has `total` rows. At most `share` groups can hold a share-th of
    them each; those keys are looked up and their groups broadcast, so that a hot key's rows stay where they are.
    The others are joined by a shuffle.
    """
    hot_from = max(2, -(-total // share))
    hot = groups.where(F.col(size) >= hot_from)
    keys = [r[0] for r in hot.select(on).collect()]  # `share` keys at most
    if not keys:
        return rows.join(groups, on)
    is_hot = F.col(on).isin(keys)
    return rows.where(is_hot).join(F.broadcast(hot), on).unionByName(rows.where(~is_hot).join(groups.where(F.col(size) < hot_from), on))


def member_filter(ids: DataFrame, column: str, bits: int) -> DataFrame:
    """(word, mask): the non-empty 64-bit words of a one-hash Bloom filter of ids; bits/64 rows at most."""
    place = F.pmod(F.xxhash64(column), F.lit(bits).cast("long"))
    return ids.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("mask")
    )


def maybe_members(rows: DataFrame, words: DataFrame, column: str, bits: int) -> DataFrame:
    """The rows whose column may be among the ids of a member_filter: all of those, and a few others."""
    place = F.pmod(F.xxhash64(column), F.lit(bits).cast("long"))
    some = rows.withColumn("_place", place).withColumn("word", F.shiftright("_place", 6))
    return some.join(F.broadcast(words), "word").where(F.getbit("mask", (F.col("_place") % 64).cast("int")) == 1).select(*rows.columns)


_caches: dict[str, Callable[[], None]] = {}


def cache_of(name: str, clear: Callable[[], None]) -> None:
    """Have a worker's cache emptied when it turns to another operator: workers outlive jobs."""
    _caches[name] = clear


def map_texts(df: DataFrame, name: str, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, rows: int = 256) -> DataFrame:
    """mapInPandas for whole texts: `run` gets a few rows at a time, so that a worker never holds a batch's texts twice."""
    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other, clear in _caches.items():
            if other != name:
                clear()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                for got in run(iter([batch.slice(at, rows).to_pandas(integer_object_nulls=True)])):
                    yield pa.RecordBatch.from_pandas(got[list(arrow.names)], schema=arrow, preserve_index=False)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(parts, out)
