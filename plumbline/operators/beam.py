"""Beam search over stacked affixes: the driver holds the stacks, every depth is one aggregate over candidates and probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stimuli import affixed


def stacked(base: Column, stack: list[tuple[str, str]], good: str) -> Column:
    for text, position in stack:
        base = affixed(base, F.lit(text), F.lit(position), F.lit(good))
    return base


def search(probes: DataFrame, moves: list[tuple[str, str, str]], score, depth: int = 2, width: int = 3, good: str = "Yes.") -> tuple[list[tuple[list[tuple[str, str, str]], float]], list[dict]]:
    """The best stacks with their mean lifts, and the search's history. probes: base; moves: (id, text, position),
    controls left out by the caller.

    Every depth extends each stack by every affix that it doesn't hold; ties go to the first in order of ids. A level of
    the history has its depth, the best lift and stack, and the number of candidates.
    """
    beam, best, history = [[]], [], []
    for level in range(1, depth + 1):
        candidates = [s + [m] for s in beam for m in moves if m[0] not in [x[0] for x in s]]
        if not candidates:
            break
        cells = F.array(*[F.struct(F.lit(i).alias("i"), stacked(F.col("base"), [(t, p) for _, t, p in c], good).alias("v")) for i, c in enumerate(candidates)])
        lifts = probes.select("base", F.inline(cells)).groupBy("i").agg(F.avg(score(F.col("v")) - score(F.col("base"))).alias("lift"))
        top = lifts.orderBy(F.desc(F.round("lift", 9)), "i").limit(width).collect()  # width rows
        if not top:
            break
        best = [(candidates[r["i"]], float(r["lift"])) for r in top]
        history.append({"depth": level, "best_dev_lift": best[0][1], "best_stack": [(i, p) for i, _, p in best[0][0]], "n_candidates": len(candidates)})
        beam = [s for s, _ in best]
    return best, history


def beam_search(probes: DataFrame, moves: list[tuple[str, str, str]], score, depth: int = 2, width: int = 3, good: str = "Yes.") -> list[tuple[list[tuple[str, str, str]], float]]:
    """(stack, mean lift) of the best stacks of search()."""
    return search(probes, moves, score, depth, width, good)[0]
