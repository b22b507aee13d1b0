"""Reading the tables that the queries run on, and writing results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table: another one if the table was written again."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    one = fs.getFileStatus(p)
    files = fs.listStatus(p) if one.isDirectory() else [one]
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as answers: doc_id (item), cluster (source), question and answer."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("source").alias("cluster"), "lang", F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("question"), F.coalesce("text", F.lit("")).alias("answer"))


def corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON corpus with its schema stated."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only local runs, which share /tmp, may leave it unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file:///tmp/checkpoints/plumbline"
    return shared.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, and holds still."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of both, the latest version of each key: what a keyed cache holds after a write."""
    both = old.unionByName(new)
    newest = both.groupBy(key).agg(F.max_by(F.struct(*both.columns), version).alias("r"))
    return newest.select("r.*")
