"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct hashed character n-grams of its whole lower-cased text. From a bounded
sample of labelled rows, the log ratio of smoothed document counts in the two classes scales each feature, and a
logistic regression is fitted to all features that the sample holds. Scoring is one pass of array work over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_texts, held_out, map_texts, materialize, training_labels

ORDERS = (5,)
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def ngrams(text: str | None, bits: int = 19, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Hashes below 2^bits of the distinct character n-grams of a whole text. Null counts as empty.

    The text is lower-cased and has a space put at both ends; characters are code points.
    """
    c = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    h, found = c * _MIX[0], []
    for n in range(2, max(orders) + 1):
        if len(h) < 2:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MIX[1] + c[n - 1 :] * _MIX[2]
        if n in orders:
            found.append((h ^ (h >> np.uint32(13))) * _MIX[0] >> np.uint32(32 - bits))
    return distinct(np.concatenate(found) if found else np.zeros(0, np.uint32), bits)


_owner: dict[int, np.ndarray] = {}


def distinct(h: np.ndarray, bits: int) -> np.ndarray:
    """The different values of h, in linear time: each value's slot keeps the last place that wrote to it."""
    slot = _owner.setdefault(bits, np.zeros(1 << bits, np.int32))
    at = np.arange(len(h), dtype=np.int32)
    slot[h] = at
    return h[slot[h] == at]


@dataclass
class ToxicityModel:
    weights: np.ndarray  # of each feature, its log-count ratio included
    bias: float
    bits: int

    def score(self, text: str | None) -> float:
        f = ngrams(text, self.bits)
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[f].sum(dtype=np.float64), -30, 30))))


def _fit_logistic(index: np.ndarray, start: np.ndarray, y: np.ndarray, ratio: np.ndarray, penalty: float, rounds: int, part: int = 500_000) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows (feature ids of row i from start[i]) by accelerated gradient descent.

    Rows are gone through in parts of about `part` features, so that memory beyond index itself is bounded.
    """
    ends = np.append(start[1:], len(index))
    cuts = [0]
    for i, e in enumerate(ends):
        if e - start[cuts[-1]] >= part or i + 1 == len(ends):
            cuts.append(i + 1)
    parts = [(slice(i, j), index[start[i] : ends[j - 1]], start[i:j] - start[i], (ends - start)[i:j]) for i, j in zip(cuts, cuts[1:])]
    ratio = ratio.astype(np.float64)

    def forward(w: np.ndarray) -> np.ndarray:
        scaled, out = w * ratio, np.zeros(len(y))
        for rows, f, at, n in parts:
            out[rows] = np.add.reduceat(np.append(scaled[f], 0.0), at) * (n > 0)
        return out

    def backward(g: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ratio))
        for rows, f, at, n in parts:
            out += np.bincount(f, weights=np.repeat(g[rows], n), minlength=len(ratio))
        return out * ratio

    prior = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    w, b = np.zeros(len(ratio)), prior
    vw, vb = w.copy(), b
    # the largest curvature is bounded by a quarter of the largest eigenvalue, found by a few power steps
    u = np.random.default_rng(0).normal(size=len(ratio))
    for _ in range(8):
        u = backward(forward(u / max(np.linalg.norm(u), 1e-12)))
    step = 1 / (0.25 * (np.linalg.norm(u) / len(y) + 1) * 1.1 + penalty)
    for k in range(rounds):
        g = (1 / (1 + np.exp(-np.clip(forward(vw) + vb, -30, 30))) - y) / len(y)
        nw, nb = vw - step * (backward(g) + penalty * vw), vb - step * g.sum()
        m = k / (k + 3)
        vw, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    return w, b


def log_count_ratios(lists: list[np.ndarray], y: np.ndarray, bits: int, smoothing: float) -> np.ndarray:
    """Of each feature: the log ratio of the smoothed shares of toxic and other documents that have it; 0 if none has."""
    counts = np.zeros((2, 1 << bits))
    for f, label in zip(lists, y):
        counts[int(label > 0), f] += 1
    n = np.array([[(y <= 0).sum()], [(y > 0).sum()]])
    share = (counts + smoothing) / (n + 2 * smoothing)
    return np.where(counts.sum(0) > 0, np.log(share[1] / share[0]), 0.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", bits: int = 19, fit_rows: int = 6_000, fit_chars: int = 200_000, penalty: float = 3e-4, rounds: int = 60, smoothing: float = 1.0, parts: int = 8) -> ToxicityModel:
    """Learn from about fit_rows labelled rows at most (a bounded sample, by the hash of their id), not held out.

    Texts of more than fit_chars characters do not teach. All n-grams of the sample get weights; those that it lacks
    weigh nothing. Without usable labels, or with labels of one kind only, the score is the share of that label,
    smoothed.
    """
    known = training_labels(labels, label, fit_rows)
    # the sample's size is bounded, so that its ids can be broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    rows = materialize(bounded_texts(rows, "doc_id", "text", fit_rows, fit_chars).repartition(parts, "doc_id"), "labelled")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "f": [ngrams(t, bits).astype(np.int32).tobytes() for t in b["text"]]})

    # sorted places of about fit_rows texts of bounded length
    got = map_texts(rows, "toxicity", run, "doc_id long, f binary").join(F.broadcast(known), "doc_id").toPandas().sort_values("doc_id", kind="stable")
    y = got["y"].to_numpy(float)
    if not len(y) or len(set(y > 0)) < 2:
        return ToxicityModel(np.zeros(1 << bits, np.float32), float(np.log(((y > 0).sum() + smoothing) / ((y <= 0).sum() + smoothing))), bits)
    lists = [np.frombuffer(f, np.int32) for f in got["f"]]
    del got
    ratio = log_count_ratios(lists, y, bits, smoothing)
    w, b = _fit_logistic(np.concatenate(lists), np.cumsum([0, *map(len, lists)])[:-1], y, ratio, penalty, rounds)
    return ToxicityModel((w * ratio).astype(np.float32), float(b), bits)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1, higher: more toxic), predicted (1 if score >= threshold).

    Whole texts are scored; null counts as empty, and an empty text is scored as any other. Repeated rows get one
    score each; a null id is never held out; an empty table gives an empty result. Labels, language, source and id
    are no inputs of a score, and other columns, whatever their names, are not looked at.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 * 2^bits bytes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": [m.score(t) for t in b["text"]]})

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = map_texts(scored, "toxicity", run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
