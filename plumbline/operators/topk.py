"""The best rows of each group, with as many different kinds among them as there are."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def best_of_kinds(df: DataFrame, by: list[str], kind: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows (score, then the lesser tie) of each (by, kind), as each task finds them: a few rows for each
    task and kind, without sorting any others. Rows without a score are left out."""
    names, schema = [*by, kind], df.schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, list] = {}
        for b in batches:
            keys, order = list(zip(*[b.column(c).to_pylist() for c in names])), list(zip(b.column(score).to_pylist(), b.column(tie).to_pylist()))
            for i, (key, (s, t)) in enumerate(zip(keys, order)):
                if s is None:
                    continue
                heap, item = best.setdefault(key, []), (s, _Last(t), i)
                if len(heap) < k:
                    heapq.heappush(heap, (*item, b.slice(i, 1).to_pylist()[0]))
                elif heap[0][:2] < item[:2]:
                    heapq.heapreplace(heap, (*item, b.slice(i, 1).to_pylist()[0]))
        rows = [r for heap in best.values() for *_, r in heap]
        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.mapInArrow(run, schema)


class _Last:
    """A value that counts as larger the smaller it is."""

    def __init__(self, v):
        self.v = v

    def __lt__(self, other: "_Last") -> bool:
        return other.v < self.v

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Last) and other.v == self.v


def diverse_top(df: DataFrame, by: list[str], kind: str, score: str, tie: str, k: int, rank: str | None = None) -> DataFrame:
    """df's k best rows of each group (by) with their place: first the best row of each kind, kinds in order of rank (a
    column, the same for all rows of a kind; less is earlier) and score, then what scores best of the others.
    """
    few = best_of_kinds(df, by, kind, score, tie, k)
    best = [F.desc(score), F.asc(tie)]
    few = few.withColumn("_in_kind", F.row_number().over(Window.partitionBy(*by, kind).orderBy(*best))).where(F.col("_in_kind") <= k)
    first = F.col("_in_kind") == 1
    early = [F.when(first, F.col(rank))] if rank else []
    place = F.row_number().over(Window.partitionBy(*by).orderBy((~first).cast("int"), *early, *best))
    return few.withColumn("place", place.cast("long")).where(F.col("place") <= k).drop("_in_kind")
