"""The queries over all pairs against their SQL on a table of several id blocks."""

import duckdb
import pytest

from plumbline import catalog

from .compare import same

LARGE = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", ["d14_all_pairs", "e13_all_pairs", "e18_all_pairs"])
def test_all_pairs_on_several_blocks(spark, name):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{LARGE}/documents.parquet'")
    same(catalog.queries()[name](spark, LARGE), c, catalog.oracle_sql()[name])


def test_every_pair_is_counted(spark):
    sizes = [r["count"] for r in catalog.queries()["d14_all_pairs"](spark, LARGE).select("pairs").toDF("count").collect()]
    by_source = spark.read.parquet(f"{LARGE}/documents.parquet").groupBy("source").count().collect()
    assert sum(sizes) == sum(r["count"] * (r["count"] - 1) // 2 for r in by_source)
