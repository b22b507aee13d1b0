"""Fixed-effects regression on a restricted cubic spline, with cluster-robust and wild-bootstrap inference.

Everything that is as long as the data is a DataFrame aggregate: demeaned cross products per cluster. What is left
for the driver has as many rows as there are terms, or terms times draws; what is left for tasks is one cluster's
matrices.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from ..sources.tables import written
from . import draws as draws_
from .quantiles import quantiles


# Quantiles of the knots, by their number.
KNOTS = {
    3: (0.10, 0.50, 0.90),
    4: (0.05, 0.35, 0.65, 0.95),
    5: (0.05, 0.275, 0.50, 0.725, 0.95),
    6: (0.05, 0.23, 0.41, 0.59, 0.77, 0.95),
}


def knots(df: DataFrame, x: str, at: tuple[float, ...] = KNOTS[3]) -> list[float]:
    """Different exact quantiles, ascending. Where fewer than three differ, those of three knots are tried."""
    found = quantiles(df, x, list(at)).first()
    out = sorted(set(found["q"])) if found else []
    return knots(df, x) if len(out) < 3 and at != KNOTS[3] else out


def spline(v: Column, k: list[float]) -> list[Column]:
    """Truncated cubes of v that are linear beyond the outer knots; none for fewer than three knots."""
    if len(k) < 3:
        return []
    cube = lambda t: F.pow(F.greatest(v - F.lit(t), F.lit(0.0)), F.lit(3.0))
    last, before, scale = k[-1], k[-2], (k[-1] - k[0]) ** 2
    return [(cube(t) - cube(before) * ((last - t) / (last - before)) + cube(last) * ((before - t) / (last - before))) / scale for t in k[:-2]]


def with_spline(df: DataFrame, x: str, at: tuple[float, ...] = KNOTS[3]) -> DataFrame:
    """df with z1, z2, ...: the spline of x with knots at its quantiles."""
    return df.withColumns({f"z{i + 1}": z for i, z in enumerate(spline(F.col(x), knots(df, x, at)))})


def with_doses(df: DataFrame, category: str, dose: str, levels: list[str]) -> DataFrame:
    """df with a column dose_<level> for each level of a category: the dose in its rows, nought in all others."""
    return df.withColumns({f"dose_{v}": F.when(F.col(category) == v, F.col(dose).cast("double")).otherwise(0.0) for v in levels})


@dataclass
class Fit:
    terms: DataFrame  # term, coef, se, se_cr0
    names: list[str]
    beta: np.ndarray
    se: np.ndarray
    moments: DataFrame  # cluster, n, xx, xy, yy: of a written table
    inverse: np.ndarray
    n_obs: int
    n_clusters: int
    r2: float
    shared: DataFrame  # the written table: cluster, n, xx, and xy0, yy0, xy1, ... of all fits that were made together
    at: int  # which of them this one is

    def restricted(self, j: int) -> np.ndarray:
        """The coefficients if the j-th one is held at nought."""
        d = self.inverse[j, j]
        return self.beta - self.inverse[:, j] * (self.beta[j] / d) if d > 0 else self.beta * 1.0


def _stacked(block: pd.DataFrame, p: int, xy: str = "xy") -> tuple[np.ndarray, np.ndarray]:
    """The clusters' X'X and X'y."""
    return np.stack(block["xx"].to_list()).reshape(-1, p, p), np.stack(block[xy].to_list())


#: Columns from which rows are added up in blocks before they are aggregated: an aggregate of hundreds of sums is slow by the row.
WIDE = 8


def _cross_sums(d: DataFrame, width: int) -> DataFrame:
    """(cluster, n, s, q): rows (cluster, c0, c1, ...) added up for each cluster inside a batch: how many, their sums and
    the upper triangle of their cross products. A cluster has a row for every batch that it stands in."""
    schema = StructType().add(d.schema["cluster"]).add("n", LongType()).add("s", ArrayType(DoubleType())).add("q", ArrayType(DoubleType()))
    arrow, (i, j) = to_arrow_schema(schema), np.triu_indices(width)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                b = batch.slice(at, 10_000)
                x = np.stack([b.column(f"c{k}").to_numpy(zero_copy_only=False) for k in range(width)], 1)
                of = b.column("cluster").dictionary_encode("encode")
                codes = of.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(codes, kind="stable")
                x, n = x[order], np.bincount(codes)
                starts = np.cumsum(n) - n
                s, q = np.add.reduceat(x, starts), np.add.reduceat(x[:, i] * x[:, j], starts)
                yield pa.RecordBatch.from_arrays([of.dictionary, pa.array(n, pa.int64()), *[pa.array(list(v), arrow.field(name).type) for name, v in (("s", s), ("q", q))]], schema=arrow)

    return d.mapInArrow(run, schema)


def fit_fe(df: DataFrame, y: str, xs: list[str], cluster: str) -> Fit:
    """Ordinary least squares with a fixed effect per cluster (absorbed by demeaning), CR2 and CR0 errors.

    One aggregate gives each cluster's cross products, of the upper triangle only.
    """
    return fits_fe(df, [y], xs, cluster)[0]


def fits_fe(df: DataFrame, ys: list[str], xs: list[str], cluster: str) -> list[Fit]:
    """fit_fe of each of ys on the same terms. Rows are read once: what the terms make of each other is the same for all."""
    # demeaned cross products are sums less what the cluster's means make of them, so no row has to meet its cluster;
    # the overall means are taken off first, which keeps the differences exact
    cols, p, q = [*xs, *ys], len(xs), len(ys)
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    d = df.select(F.col(cluster).alias("cluster"), *[(F.col(c) - F.lit(means[c])).alias(f"c{i}") for i, c in enumerate(cols)])
    products = [(i, j) for i in range(p + q) for j in range(i, p + q)]
    if p >= WIDE:
        parts = _cross_sums(d.select("cluster", *[F.col(f"c{i}").cast("double").alias(f"c{i}") for i in range(p + q)]), p + q)
        sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(p + q)], *[F.sum(F.col("q")[k]).alias(f"p{i}_{j}") for k, (i, j) in enumerate(products)])
    else:
        sums = d.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"c{i}").alias(f"s{i}") for i in range(p + q)], *[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"p{i}_{j}") for i, j in products])
    about = lambda i, j: F.col(f"p{min(i, j)}_{max(i, j)}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")
    sides = [c for k in range(q) for c in (F.array(*[about(i, p + k) for i in range(p)]).alias(f"xy{k}"), about(p + k, p + k).alias(f"yy{k}"))]
    moments = written(sums.select("cluster", "n", F.array(*[about(i, j) for i in range(p) for j in range(p)]).alias("xx"), *sides), "moments")

    def total(block: pd.DataFrame) -> np.ndarray:
        out = np.zeros((p + 3, p + q))
        for k in range(q):
            xx, xy = _stacked(block, p, f"xy{k}")
            out[:p, p + k], out[p, p + k] = xy.sum(0), block[f"yy{k}"].sum()
        out[:p, :p], out[p + 1, 0], out[p + 2, 0] = xx.sum(0), block["n"].sum(), len(block)
        return out

    t = draws_.summed_rows(moments, total, p + 3, p + q)
    xx, xy, yy, n, clusters = t[:p, :p], t[:p, p:], t[p, p:], int(t[p + 1, 0]), int(t[p + 2, 0])
    inverse = np.linalg.pinv(xx)
    betas = [inverse @ xy[:, k] for k in range(q)]

    def meat(block: pd.DataFrame) -> np.ndarray:
        """The sums of both sandwiches' outer products. For a cluster of design X, X'(I - H)^-1/2 e depends on X'X and
        X'e alone, as H = X A X' has the eigenvectors of A^1/2 X'X A^1/2."""
        a, v = np.linalg.eigh(inverse)
        root = v @ np.diag(np.sqrt(np.maximum(a, 0))) @ v.T
        own, out = np.stack(block["xx"].to_list()).reshape(-1, p, p), []
        lam, u = np.linalg.eigh(root @ own @ root)
        for k, beta in enumerate(betas):
            score = np.stack(block[f"xy{k}"].to_list()) - own @ beta
            part = np.einsum("cji,cj->ci", u, score @ root) / np.sqrt(np.maximum(1 - lam, 1e-8))
            lifted = np.einsum("cij,cj->ci", u, part) @ np.linalg.pinv(root)
            out += [score.T @ score, lifted.T @ lifted]
        return np.concatenate(out)

    meats, out = draws_.summed_rows(moments, meat, 2 * q * p, p).reshape(q, 2, p, p), []
    for k, beta in enumerate(betas):
        cr0, se = (np.sqrt(np.maximum(np.diag(inverse @ m @ inverse), 0)) for m in meats[k])
        rows = [(n_, float(b), float(s), float(c)) for n_, b, s, c in zip(xs, beta, se, cr0)]
        r2 = float(beta @ xy[:, k] / yy[k]) if yy[k] > 0 else 0.0
        terms = df.sparkSession.createDataFrame(rows, "term string, coef double, se double, se_cr0 double")
        own = moments.select("cluster", "n", "xx", F.col(f"xy{k}").alias("xy"), F.col(f"yy{k}").alias("yy"))
        out.append(Fit(terms, xs, beta, se, own, inverse, n, clusters, r2, moments, k))
    return out


def within_r2(df: DataFrame, y: str, xs: list[str], cluster: str) -> DataFrame:
    """One row (r2): the share of y's spread inside clusters that the fit explains; 0 where there is none."""
    return df.sparkSession.createDataFrame([(fit_fe(df, y, xs, cluster).r2,)], "r2 double")


def cluster_signs(seed: int, draws: int, clusters) -> np.ndarray:
    """(draws, clusters): Rademacher signs from the bits of SHA-256 of (seed, a number for each 256 draws, cluster)."""
    keys = draws_.encoded(clusters)
    bits = [np.unpackbits(np.frombuffer(b"".join(sha256(f"{seed}:{part}:".encode() + k).digest() for k in keys), np.uint8).reshape(len(keys), 32), axis=1) for part in range(-(-draws // 256))]
    return 1.0 - 2.0 * np.concatenate(bits, 1)[:, :draws].T


def wild_tests(fit: Fit, draws: int, seed: int, level: float = 0.95) -> DataFrame:
    """(term, coef, se, t, p, ci_low, ci_high): restricted wild cluster bootstrap of each coefficient being zero.

    The observed t uses the CR2 error, the draws use CR0. Each cluster's residual scores under the restriction are
    flipped by a hash. A draw of one coefficient needs two sums over clusters, of the flipped scores and of these times
    what the cluster's design makes of them, so a task passes on 2 p numbers for each term and draw. The interval is the
    coefficient with the percentiles of the centred draws.
    """
    p, inverse, beta, se = len(fit.names), fit.inverse, fit.beta, fit.se
    restricted = [fit.restricted(j) for j in range(p)]

    def flip(block: pd.DataFrame) -> np.ndarray:
        xx, xy = _stacked(block, p)
        s = cluster_signs(seed, draws, block["cluster"])
        out = []
        for j in range(p):
            g = xy - xx @ restricted[j]
            u, h = xx @ inverse[j], g @ inverse[j]  # the j-th row of inverse (g - X'X d) is h - u d
            fixed = np.zeros((p + 1, 2 * p))
            fixed[:p, :p], fixed[p, 0] = u.T @ u, h @ h
            out += [np.concatenate([s @ g, s @ (h[:, None] * u)], 1), fixed]
        return np.concatenate(out)

    size = draws + p + 1
    x = draws_.summed_rows(fit.moments, flip, p * size, 2 * p)
    t_obs = np.divide(beta, se, out=np.zeros(p), where=se > 0)
    out = []
    for j, name in enumerate(fit.names):
        part = x[j * size : (j + 1) * size]
        d, cross, uu, hh = part[:draws, :p] @ inverse, part[:draws, p:], part[draws:-1, :p], part[-1, 0]
        s = np.sqrt(np.maximum(hh - 2 * (cross * d).sum(1) + np.einsum("bi,ij,bj->b", d, uu, d), 0))
        t = np.divide(d[:, j], s, out=np.zeros(draws), where=s > 0)
        low, high = np.percentile(d[:, j] - d[:, j].mean(), [50 * (1 - level), 50 * (1 + level)])
        out.append((name, float(beta[j]), float(se[j]), float(t_obs[j]), float((1 + (np.abs(t) >= abs(t_obs[j]) - 1e-12).sum()) / (draws + 1)), float(beta[j] + low), float(beta[j] + high)))
    return fit.terms.sparkSession.createDataFrame(out, "term string, coef double, se double, t double, p double, ci_low double, ci_high double")


def coefficient_sums(fit: Fit, terms: list[str]) -> DataFrame:
    """(name, cluster, s, n): what each cluster adds to a coefficient, with its residuals under the coefficient being
    nought; over all clusters the coefficient itself. They are what the tests of a family of contrasts read."""
    each = F.array(*[F.struct(F.lit(t).alias("name"), F.col("s")[i].alias("s")) for i, t in enumerate(terms)])
    return coefficient_rows([fit], terms).select("cluster", F.inline(each)).select("name", "cluster", "s", F.lit(1).cast("long").alias("n"))


def coefficient_rows(fits: list[Fit], terms: list[str]) -> DataFrame:
    """(cluster, s): the same as a row per cluster; s has a number for every fit and term, those of a fit together. fits:
    of one fits_fe, so their table is read once."""
    p, places = len(fits[0].names), [fits[0].names.index(t) for t in terms]
    of = [(f"xy{f.at}", j, f.restricted(j), f.inverse[j]) for f in fits for j in places]
    kind = fits[0].shared.schema["cluster"].dataType.simpleString()

    def run(batches):
        for b in batches:
            xx = np.stack(b["xx"].to_list()).reshape(-1, p, p)
            xy = {c: np.stack(b[c].to_list()) for c in {o[0] for o in of}}
            s = np.stack([(xy[c] - xx @ r) @ i for c, _, r, i in of], 1)
            yield pd.DataFrame({"cluster": b["cluster"], "s": list(s)})

    return fits[0].shared.mapInPandas(run, f"cluster {kind}, s array<double>")


def length_curve(df: DataFrame, fit: Fit, x: str, points: int = 40, k: list[float] | None = None) -> DataFrame:
    """(tokens, reward, slope_per_100): the spline's prediction from the first grid point on, and its slope. x and its
    spline (knots k, three if none are given) are the first terms of the fit."""
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    k = knots(df, x) if k is None else k
    h = max(1.0, (hi - lo) / 200)

    def at(v: float) -> float:
        basis = [v]
        if len(k) >= 3:
            cube = lambda t: max(v - t, 0.0) ** 3
            basis += [(cube(t) - cube(k[-2]) * (k[-1] - t) / (k[-1] - k[-2]) + cube(k[-1]) * (k[-2] - t) / (k[-1] - k[-2])) / (k[-1] - k[0]) ** 2 for t in k[:-2]]
        return float(np.dot(fit.beta[: len(basis)], basis))

    grid = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
    rows = [(float(v), at(v) - at(lo), (at(v + h) - at(v - h)) / (2 * h) * 100) for v in grid]
    return df.sparkSession.createDataFrame(rows, "tokens double, reward double, slope_per_100 double")
