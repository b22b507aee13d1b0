"""Draws in blocks: the random part of the resamplers, inside tasks.

A draw's numbers come from hashes of (seed, draw, unit), the same ones as `functions.text.hashed` gives, so results do
not depend on partitions. Two layouts keep rows of (draw, unit) from ever being made, let alone shuffled:

* sums over units (sign flips): each task multiplies the signs of its units with their numbers and passes on one row of
  partial sums per draw;
* statistics that need all units of a group at once (drawing with replacement, dealing out): a group's numbers travel
  as arrays to a few tasks, each of which makes some of the draws. This holds up to `MOST_UNITS` units a group; callers
  have a shuffled form for larger ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_UNITS, BLOCKS = 1 << 20, 16


def hashes(prefix: str, keys: list) -> np.ndarray:
    """The first 32 bits of SHA-256 of prefix + key, for each key."""
    start = sha256(prefix.encode())
    out = bytearray()
    for k in keys:
        h = start.copy()
        h.update(k)
        out += h.digest()[:4]
    return np.frombuffer(bytes(out), ">u4").astype(np.int64)


def encoded(keys) -> list[bytes]:
    """Keys as the text that Spark casts whole numbers and strings to."""
    return [str(int(k) if isinstance(k, (float, np.integer, np.floating)) else k).encode() for k in keys]


def signs(seed: int, draws: int, keys) -> np.ndarray:
    """(draws, keys): 1 where the hash of (seed, draw, key) is even, else -1."""
    k = encoded(keys)
    return np.stack([1.0 - 2.0 * (hashes(f"{seed}:{b}:", k) % 2) for b in range(draws)])


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys to twice as many tasks as run at once. A row costs its draws, not its bytes, so a few
    megabytes must not end up in one task."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def summed_rows(df: DataFrame, part: Callable[[pd.DataFrame], np.ndarray], rows: int, width: int) -> np.ndarray:
    """The sum over all of df of part(block), a (rows, width) array: added up in each task, then row by row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((rows, width))
        for b in batches:
            for at in range(0, len(b), 1024):
                total += part(b.iloc[at : at + 1024])
        yield pd.DataFrame({"i": range(rows), "v": list(total)})

    got = df.mapInPandas(run, "i int, v array<double>").groupBy("i").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(width)]).alias("v")).collect()  # `rows` rows
    out = np.zeros((rows, width))
    for r in got:
        out[r["i"]] = r["v"]
    return out


def per_draw(groups: DataFrame, draws: int, one: Callable[[dict, int], list[tuple]], schema: str, keys: list[str]) -> DataFrame:
    """(*keys, b, columns of schema): one(group, b) gives a draw's rows for a group, a row of groups with its arrays."""
    columns = [c.split()[0] for c in schema.split(", ")]
    kinds = dict(groups.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                lo, hi = draws * r["_block"] // BLOCKS, draws * (r["_block"] + 1) // BLOCKS
                out = [(*[r[k] for k in keys], b, *x) for b in range(lo, hi) for x in one(r, b)]
                yield pd.DataFrame(out, columns=[*keys, "b", *columns])

    # a number of its own, or the few rows, which are small, would all be put together into one task
    spread = groups.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).repartition(4 * BLOCKS, *keys, "_block")
    return spread.mapInPandas(run, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "b int", schema]))
