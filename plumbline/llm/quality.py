"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

One pass over the texts turns each document into a few statistics. Random Fourier features map these to a space
where inner products approximate a Gaussian kernel. Each partition of the labelled rows sums its part of the
normal equations; the sums are solved for ridge weights, and pool-adjacent-violators makes the raw scores
probabilities. Labels outside the held-out fold are the only ones learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_texts, materialize, training_labels

STATS = (
    "log_words", "word_chars", "distinct_words", "distinct_lines", "line_chars", "upper", "digits", "bangs", "bars",
    "symbols", "stops", "spaces", "other_bytes", "short_words", "long_words", "repeated_bigrams",
)


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(chars)] = True
    return m


_UPPER, _DIGITS, _SPACES = (_mask(bytes(range(*r))) for r in ((65, 91), (48, 58), (9, 14)))
_SYMBOLS, _STOPS, _BANGS, _BARS = _mask(b"#$%&*@^~<>{}[]\\_=+"), _mask(b".,;:"), _mask(b"!?"), _mask(b"|")
_CLASSES = np.stack([_UPPER, _DIGITS, _BANGS, _BARS, _SYMBOLS, _STOPS, _SPACES | _mask(b" "), np.arange(256) >= 128]).astype(float)


def statistics(text: str | None) -> list[float]:
    """The numbers of STATS for a whole text. Null counts as empty; an empty text gives zeros."""
    if not text:
        return [0.0] * len(STATS)
    raw = text.encode("utf-8", "replace")
    shares = _CLASSES @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    upper, digits, bangs, bars, symbols, stops, spaces, other = shares
    pairs = len(words) - 1
    return [
        np.log1p(len(words)), lengths.sum() / n, len(set(words)) / n, len(set(lines)) / max(1, len(lines)),
        np.log1p(len(text) / max(1, len(lines))), upper, digits, bangs, bars, symbols, stops, spaces, other,
        float((lengths <= 3).sum()) / n, float((lengths >= 12).sum()) / n,
        1 - len(set(zip(words, words[1:]))) / pairs if pairs > 0 else 0.0,
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, stats array<double>), and the columns to carry along, one row per row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns=["text"]).assign(stats=[statistics(t) for t in b["text"]])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carry)
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return map_texts(rows, "quality", run, f"doc_id long{more}, stats array<double>")


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    cut: np.ndarray  # raw scores and the calibrated values at them, both ascending
    value: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((stats - self.mean) / self.scale, -6, 6) @ self.w + self.phase) * np.sqrt(2 / self.w.shape[1])
        return np.hstack([z, np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.cut, self.value), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean x and mean y of each pooled block, ascending."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, sum of x, rows
    for a, b in zip(y[order], x[order]):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            s = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], s)]
    m = np.array(blocks)
    return m[:, 1] / m[:, 2], m[:, 0] / m[:, 2]


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", features: int = 256, width: float = 3.0, ridge: float = 0.3, fit_rows: int = 20_000, parts: int = 8, seed: int = 7) -> QualityModel:
    """Learn from about fit_rows labelled rows at most (a bounded sample, by the hash of their id), not held out.

    A quarter of them, by another hash, is kept from the ridge and calibrates its scores. Without usable labels
    every score is 0.5.
    """
    d = len(STATS)
    rng = np.random.default_rng(seed)
    model = QualityModel(np.zeros(d), np.ones(d), rng.normal(size=(d, features)) / width, rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    # the sample's size is bounded, so that its ids can be broadcast
    drawn = stats.join(F.broadcast(training_labels(labels, label, fit_rows)), "doc_id").groupBy("doc_id", "y").agg(F.min("stats").alias("stats"))
    drawn = materialize(drawn.repartition(parts, "doc_id").withColumn("calibrates", F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(4)) == 0), "fit")
    rows = drawn.where("not calibrates")
    moments = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(d)],
        *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(d)],
    ).first()
    if not moments["n"]:
        return model
    model.mean = np.array([moments[f"m{i}"] for i in range(d)])
    model.scale = np.array([max(moments[f"s{i}"], 1e-6) for i in range(d)])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((features + 1, features + 2))
        for b in batches:
            if len(b):
                z = model.features(np.stack(b["stats"].to_numpy()))
                total += z.T @ np.hstack([z, b[["y"]].to_numpy()])
        yield pd.DataFrame({"sums": [total.ravel()]})

    # one row of bounded size from each of a bounded number of partitions
    total = sum(np.array(r["sums"]).reshape(features + 1, features + 2) for r in rows.mapInPandas(sums, "sums array<double>").toLocalIterator())
    penalty = np.full(features + 1, ridge)
    penalty[-1] = 1e-6
    model.beta = np.linalg.solve(total[:, :-1] + np.diag(penalty), total[:, -1])
    known = drawn.where("calibrates").select("stats", "y").toPandas()  # about fit_rows rows at most
    if not len(known):  # too few rows to keep some apart
        known = rows.select("stats", "y").toPandas()
    model.cut, model.value = isotonic(model.raw(np.stack(known["stats"].to_numpy())), known["y"].to_numpy())
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), **options) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1, higher: better), predicted (1 if score >= threshold).

    carry: names of columns of docs that the rows are to keep.

    Whole texts are scored; null counts as empty, and an empty text is scored as any other. Repeated rows get one
    score each; a null id is never held out; an empty table gives an empty result. Labels, language, source and id
    are no inputs of a score, and other columns, whatever their names, are not looked at.
    """
    stats = materialize(document_statistics(docs, id_col, text_col, carry), "stats")
    model = fit(stats, labels, **options)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = model.score(np.stack(b["stats"].to_numpy())) if len(b) else np.zeros(0)
            yield b.drop(columns=["stats"]).assign(score=s)

    scored = stats.mapInPandas(run, stats.drop("stats").withColumn("score", F.lit(0.0)).schema)
    return scored.select("doc_id", *carry, held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
