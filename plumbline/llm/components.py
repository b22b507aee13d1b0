"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, component): for every end of a link, the smallest id it is connected with.

    Nothing is gathered: a round is a few aggregates and joins, a node with very many links is not sent to one
    task, and every round's edges are written to the shared folder.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    edges = materialize(links.where(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct(), "edges")
    mark = _mark(edges)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        # large star: each neighbour above a node goes to the smallest of the node and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        large = join_hot(both.where(F.col("v") > F.col("u")), least, "u", "n", 2 * mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(large.where(F.col("u") != F.col("v")).distinct(), "edges")
        # small star: each node and its neighbours below it go to the smallest of these
        least = materialize(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        small = join_hot(edges, least, "u", "n", edges.count()).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.where(F.col("u") != F.col("v")).distinct(), "edges")
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    else:
        raise RuntimeError("the components didn't settle")
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
