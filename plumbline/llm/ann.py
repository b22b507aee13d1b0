"""Approximate nearest neighbours with balanced posting lists.

A bounded sample is split in halves again and again, across the line between two means, until its parts are small;
a few rounds of moving the means to their nearest vectors follow. All vectors are then assigned, and lists that are
too full are split again on the table's own vectors, so lists stay balanced and their number grows with the table.
Their centroids form a neighbour graph that is held in memory; searching it best-first gives the lists nearest to a
query. Each vector is put into its nearest list and, if it lies near a boundary, also into the lists that are almost
as near. Distance-ratio pruning selects the lists of a query: those within a ratio of the nearest one's distance.
The ratio is the one that finds a stated share of the true neighbours of a few of the table's vectors, measured
against all rows, so tables with clusters are read in few lists, and tables without any in as many as they need. Lists that lie together are searched by one task, in
blocks of bounded size, and equal vectors are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import bounded_sample, join_hot, materialize


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None], 0)


def balanced_centroids(x: np.ndarray, size: int, rounds: int = 4) -> np.ndarray:
    """Means of parts of at most `size` rows, from halving x, neighbours in order; then `rounds` of Lloyd's steps."""
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(x[rows].mean(0))
            continue
        part = x[rows]
        a = part[((part - part.mean(0)) ** 2).sum(1).argmax()]
        b = part[((part - a) ** 2).sum(1).argmax()]
        for _ in range(4):
            near = ((part - a) ** 2).sum(1) <= ((part - b) ** 2).sum(1)
            if near.all() or not near.any():
                break
            a, b = part[near].mean(0), part[~near].mean(0)
        order = np.argsort(part @ (b - a), kind="stable")
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    c = np.array(out)
    for _ in range(rounds if len(c) > 1 else 0):
        near = nearest_of(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest_of(x: np.ndarray, c: np.ndarray, step: int = 1024) -> np.ndarray:
    return np.concatenate([_squares(x[at : at + step], c).argmin(1) for at in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def boundary_lists(x: np.ndarray, c: np.ndarray, ratio: float, most: int, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(rows, lists): every row's nearest centroid, and of its `most` nearest those within ratio times that distance."""
    rows, lists = [], []
    most = min(most, len(c))
    for at in range(0, len(x), step):
        d = _squares(x[at : at + step], c)
        near = np.argpartition(d, most - 1, axis=1)[:, :most]
        e = np.take_along_axis(d, near, 1)
        i, j = np.nonzero(e <= np.maximum(e.min(1, keepdims=True) * ratio * ratio, 1e-300))
        rows.append(i + at)
        lists.append(near[i, j])
    return np.concatenate(rows), np.concatenate(lists)


@dataclass
class CentroidGraph:
    centroids: np.ndarray
    links: np.ndarray  # of each centroid, some near and some random others
    entry: np.ndarray  # some at random, more of them in a larger graph

    @staticmethod
    def build(centroids: np.ndarray, degree: int = 24, back: int = 16, far: int = 8, seed: int = 5) -> CentroidGraph:
        n = len(centroids)
        degree = min(degree, n)
        near = np.zeros((n, degree), np.int64)
        for at in range(0, n, 1024):
            d = _squares(centroids[at : at + 1024], centroids)
            some = np.argpartition(d, degree - 1, axis=1)[:, :degree]
            near[at : at + 1024] = np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1), 1)
        rng = np.random.default_rng(seed)
        others = rng.integers(0, n, (n, back + far))
        # links back from the nearest ones, or a centroid that is near to none would not be found
        to, of = near[:, : back // 2].ravel(), np.repeat(np.arange(n), min(degree, back // 2))
        order = np.argsort(to, kind="stable")
        to, of = to[order], of[order]
        rank = np.arange(len(to)) - np.searchsorted(to, to)
        others[to[rank < back], rank[rank < back]] = of[rank < back]
        return CentroidGraph(centroids, np.hstack([near, others]), rng.permutation(n)[: max(64, int(4 * n**0.5))])

    def search(self, x: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` centroids nearest to each row of x, nearest first, and their squared distances: best-first search.

        A step opens the `width` nearest centroids of each row that are not open yet.
        """
        n, beam = len(self.centroids), min(beam, len(self.centroids))
        width = min(width, beam)
        seen = np.zeros((len(x), n), bool)
        seen[:, self.entry] = True
        ids, d = np.tile(self.entry, (len(x), 1)), _squares(x, self.centroids[self.entry])
        opened = np.zeros(ids.shape, bool)
        at = np.arange(len(x))[:, None]
        while True:
            order = np.argsort(d, axis=1, kind="stable")[:, :beam]
            ids, d, opened = ids[at, order], d[at, order], opened[at, order] | np.isinf(d[at, order])
            todo = np.flatnonzero(~opened.all(1))
            if not len(todo):
                return ids, d
            first = np.argsort(opened[todo], axis=1, kind="stable")[:, :width]
            fresh = ~opened[todo[:, None], first]
            more = self.links[ids[todo[:, None], first]]
            more = np.where(fresh[:, :, None], more, -1).reshape(len(todo), -1)
            opened[todo[:, None], first] = True
            more = np.sort(np.where(seen[todo[:, None], more], -1, more), axis=1)
            more[:, 1:][more[:, 1:] == more[:, :-1]] = -1  # a centroid that two links name counts once
            i, j = np.nonzero(more >= 0)
            seen[todo[i], more[i, j]] = True
            new_ids, new_d = np.zeros((len(x), more.shape[1]), np.int64), np.full((len(x), more.shape[1]), np.inf)
            new_ids[todo[i], j] = more[i, j]
            new_d[todo[i], j] = ((self.centroids[more[i, j]] - x[todo[i]]) ** 2).sum(1)
            ids, d, opened = np.hstack([ids, new_ids]), np.hstack([d, new_d]), np.hstack([opened, np.zeros(new_ids.shape, bool)])

    def within(self, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, lists): the centroids within ratio times each row's least distance. The beam grows until it holds them."""
        beam, left, rows, lists = 64, np.arange(len(x)), [], []
        while len(left):
            ids, d = self.search(x[left], beam, max(4, beam // 8))
            near = d <= np.maximum(d[:, :1] * ratio * ratio, 1e-300)
            done = ~near[:, -1] if beam < len(self.centroids) else np.ones(len(left), bool)
            i, j = np.nonzero(near & done[:, None])
            rows.append(left[i])
            lists.append(ids[i, j])
            left, beam = left[~done], 4 * beam
        return np.concatenate(rows), np.concatenate(lists)


def tuned_ratio(asked: np.ndarray, owner: np.ndarray, near: np.ndarray, centroids: np.ndarray, share: float, replica_ratio: float, replicas: int, least: float = 1.02) -> float:
    """The least distance ratio whose lists hold that share of near, the true neighbours of asked[owner]."""
    if not len(near) or len(centroids) == 1:
        return least
    rows, lists = boundary_lists(near, centroids, replica_ratio, replicas)
    to_list = np.sqrt(_squares(asked, centroids))
    ratio = to_list / np.maximum(to_list.min(1, keepdims=True), 1e-150)
    needed = np.full(len(near), np.inf)
    np.minimum.at(needed, rows, ratio[owner[rows], lists])
    return max(least, float(np.quantile(needed, share, method="higher")) + 1e-9)


def true_neighbours(distinct: DataFrame, ids: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, vectors): the k nearest of all rows of distinct (id, x) to each of a few vectors, by brute force in blocks."""
    shared = distinct.sparkSession.sparkContext.broadcast((ids, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, y = shared.value
        best = [(np.zeros(0), np.zeros((0, y.shape[1])))] * len(y)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                x = _matrix(part.column(1), y.shape[1])
                d = _squares(y, x)
                d[mine[:, None] == part.column(0).to_numpy(zero_copy_only=False)] = np.inf
                for i in range(len(y)):
                    some = np.argpartition(d[i], k - 1)[:k] if d.shape[1] > k else np.arange(d.shape[1])
                    dist, v = np.concatenate([best[i][0], d[i, some]]), np.concatenate([best[i][1], x[some]])
                    keep = np.argsort(dist, kind="stable")[:k]
                    best[i] = dist[keep], v[keep]
        rows = [(i, float(e), r.tobytes()) for i, (dist, v) in enumerate(best) for e, r in zip(dist, v) if np.isfinite(e)]
        yield pa.RecordBatch.from_pydict(dict(zip(("owner", "d", "v"), map(list, zip(*rows)))) if rows else {"owner": [], "d": [], "v": []}, schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL("owner int, d double, v binary"))
    w = Window.partitionBy("owner").orderBy("d", "v")
    got = distinct.select("id", "x").mapInArrow(run, "owner int, d double, v binary").withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    got = got.orderBy("owner", "n").toPandas()  # k rows for each of the few
    return got["owner"].to_numpy(), _packed(got["v"]) if len(got) else np.zeros((0, asked.shape[1]))


def _matrix(vectors: pa.Array, d: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _packed(vectors) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def _per_batch(df: DataFrame, run, schema: str, step: int = 2048) -> DataFrame:
    """run(ids, matrix) -> (rows of the matrix, more columns by name) over df (id, x), a part of a batch at a time."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                x = _matrix(part.column(1), len(part.column(1)[0]))
                rows, more = run(ids, x)
                columns = {"id": ids[rows], "v": [r.tobytes() for r in x[rows]] if "v" in arrow.names else None} | more
                yield pa.RecordBatch.from_pydict({n: columns[n] for n in arrow.names}, schema=arrow)

    return df.select("id", "x").mapInArrow(parts, schema)


@dataclass
class Index:
    graph: CentroidGraph
    ratio: float
    distinct: DataFrame  # id (the least), key, x, ids
    postings: DataFrame  # id, v, list
    sizes: list[tuple[int, int]]  # (list, postings), neighbouring lists together


def build_index(rows: DataFrame, k: int, list_size: int, sample_rows: int, max_lists: int, replicas: int, replica_ratio: float, share: float, tuning: int = 256) -> Index:
    """rows: id, key, x, all of one length. Returns an index of every row."""
    spark = rows.sparkSession
    # equal vectors are one, known by its smallest ids: k + 1 of them are enough for any query
    salted = rows.groupBy("key", F.pmod(F.col("id"), F.lit(64)).alias("salt"), "x").agg(F.slice(F.sort_array(F.collect_set("id")), 1, k + 1).alias("ids"))
    distinct = materialize(
        salted.groupBy("key", "x").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")).withColumn("id", F.col("ids")[0]), "distinct"
    )
    n = distinct.count()
    drawn = bounded_sample(distinct.select("id", "x"), "id", sample_rows).orderBy("id").toPandas()
    sample = np.stack(drawn["x"].to_numpy())
    lists = max(1, min(-(-n // list_size), max_lists, len(sample) // 8))
    centroids = balanced_centroids(sample, -(-len(sample) // lists))

    # lists that are too full are split on their own vectors
    first = spark.sparkContext.broadcast(centroids)  # at most sample_rows / 8
    counts = dict(_per_batch(distinct, lambda ids, x: (np.arange(len(ids)), {"list": nearest_of(x, first.value)}), "id long, list long").groupBy("list").count().collect())
    full = {i: min(-(-m // list_size), max_lists // len(centroids)) for i, m in counts.items() if m > 2 * list_size}
    full = {i: p for i, p in full.items() if p > 1}
    if full:
        keep = {i: min(1.0, 32 * p / counts[i]) for i, p in full.items()}  # some 32 vectors for each part

        def chosen(ids, x):
            at = nearest_of(x, first.value)
            draw = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) / 2.0**24
            rows = np.flatnonzero(draw < np.array([keep.get(i, 0.0) for i in at.tolist()]))
            return rows, {"list": at[rows]}

        def parts(b: pd.DataFrame) -> pd.DataFrame:
            x = _packed(b.sort_values("id", kind="stable")["v"])
            c = balanced_centroids(x, max(1, -(-len(x) // full[int(b["list"].iat[0])])))
            return pd.DataFrame({"list": b["list"].iat[0], "c": [r.tobytes() for r in c]})

        split = _per_batch(distinct, chosen, "id long, v binary, list long").groupBy("list").applyInPandas(parts, "list long, c binary").toPandas()  # max_lists rows at most, or twice as many
        new = {i: _packed(b["c"]) for i, b in split.groupby("list")}
        centroids = np.concatenate([new.get(i, centroids[i : i + 1]) for i in range(len(centroids))])
    graph = CentroidGraph.build(centroids)
    tried = np.unique(np.linspace(0, len(sample) - 1, tuning).astype(int))
    near = true_neighbours(distinct, drawn["id"].to_numpy()[tried], sample[tried], k)
    ratio = tuned_ratio(sample[tried], *near, centroids, share, replica_ratio, replicas)
    last = spark.sparkContext.broadcast(centroids)

    def assign(ids, x):
        rows, lists = boundary_lists(x, last.value, replica_ratio, replicas)
        return rows, {"list": lists}

    postings = materialize(_per_batch(distinct, assign, "id long, v binary, list long"), "postings")
    sizes = sorted((r["list"], r["count"]) for r in postings.groupBy("list").count().collect())  # one row per list
    return Index(graph, ratio, distinct, postings, sizes)


def probes(index: Index, asked: DataFrame) -> DataFrame:
    """(id, v, list): the lists that each of asked (id, x) reads."""
    shared = asked.sparkSession.sparkContext.broadcast((index.graph, index.ratio))

    def run(ids, x):
        graph, ratio = shared.value
        rows, lists = graph.within(x, ratio)
        return rows, {"list": lists}

    return _per_batch(asked, run, "id long, v binary, list long", 256)


def search_index(index: Index, found: DataFrame, k: int, block: int, query_block: int) -> DataFrame:
    """(asker, rep, score): of the lists in found (id, v, list), some of each asker's nearest, its k + 1 nearest among them."""
    spark = found.sparkSession
    asks = dict(found.groupBy("list").count().collect())  # one row per list
    shards, filled, asking = [], 0, 0
    shard = 0
    for name, size in index.sizes:
        # neighbouring lists make up a task's work; a list of more than a block is cut by the hash of its ids
        if filled and (filled + size > block or asking + asks.get(name, 0) > 16 * query_block):
            shard, filled, asking = shard + 1, 0, 0
        filled, asking = filled + size, asking + asks.get(name, 0)
        shards.append((name, shard, -(-size // block), max(1, -(-asks.get(name, 0) // query_block)) if size > block else max(1, -(-asks.get(name, 0) // (16 * query_block)))))
    # all lists of a shard share one number of blocks
    cut = pd.DataFrame(shards, columns=["list", "shard", "vs", "qs"])
    cut[["vs", "qs"]] = cut.groupby("shard")[["vs", "qs"]].transform("max")
    cut = F.broadcast(spark.createDataFrame(cut, "list long, shard long, vs int, qs int"))
    some = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    left = index.postings.join(cut, "list").select("shard", (some % F.col("vs")).cast("int").alias("vb"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qb"), "list", "id", "v")
    right = found.join(cut, "list").select("shard", F.explode(F.sequence(F.lit(0), F.col("vs") - 1)).alias("vb"), (some % F.col("qs")).cast("int").alias("qb"), "list", "id", "v")
    right = right.toDF("shard2", "vb2", "qb2", "list", "id", "v")

    def search(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        got = []
        if len(v) and len(q):
            asked = dict(tuple(q.groupby("list")))
            for name, part in v.groupby("list"):
                if name in asked:
                    got.append(_best_of(part, asked[name], k + 1))
        if not got:
            return pd.DataFrame({"asker": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "score": np.zeros(0)})
        out = pd.concat(got).drop_duplicates(["asker", "rep"]).sort_values(["asker", "score", "rep"])
        return out[out.groupby("asker").cumcount() <= k]

    return left.groupBy("shard", "vb", "qb").cogroup(right.groupBy("shard2", "vb2", "qb2")).applyInPandas(search, "asker long, rep long, score double")


def _best_of(v: pd.DataFrame, q: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query's k nearest of one list: screened by inner products, then measured in full."""
    x, ids = _packed(v["v"]), v["id"].to_numpy()
    askers, reps, scores = [], [], []
    for at in range(0, len(q), 256):
        y = _packed(q["v"].iloc[at : at + 256])
        d = _squares(y, x)
        some = min(len(ids), k + 8)
        near = np.argpartition(d, some - 1, axis=1)[:, :some] if some < len(ids) else np.tile(np.arange(len(ids)), (len(y), 1))
        # rounding may swap what lies at the edge, so all within its error come along
        edge = np.take_along_axis(d, near, 1).max(1)
        error = 1e-12 * ((y * y).sum(1) + (x * x).sum(1).max())
        rows, cols = np.nonzero(d <= (edge + error)[:, None])
        diff = x[cols] - y[rows]
        exact = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        order = np.lexsort((ids[cols], exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        ok = rank < k
        askers.append(q["id"].to_numpy()[at + rows[ok]])
        reps.append(ids[cols[ok]])
        scores.append(exact[ok])
    return pd.DataFrame({"asker": np.concatenate(askers), "rep": np.concatenate(reps), "score": np.concatenate(scores)})


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x, key) of the rows whose vectors take part."""
    x = F.col(vector_col).cast("array<double>")
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.coalesce(ok, F.lit(False)))
    return rows.withColumn("key", F.xxhash64("x"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, list_size: int = 128, sample_rows: int = 32_768, max_lists: int = 65_536, replicas: int = 4, replica_ratio: float = 1.01, share: float = 0.95, block: int = 8_192, query_block: int = 1_024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k nearest vectors found, without its own id.

    vectors and queries hold id_col and vector_col; nearness is Euclidean distance in double precision, ties go to
    the smaller id. Vectors that are null, zero, of another length than most, or hold a null or non-finite component
    take no part, nor do null ids; repeated ids with the same vector count once. With fewer than k others, all are
    returned; an empty table gives an empty result. Other columns are not looked at.

    list_size: vectors that a list should have (split at twice as many); sample_rows: the bound of the sample that
    the first centroids come from; max_lists: centroids held in memory (about; lists grow beyond
    max_lists * list_size vectors); replicas, replica_ratio: lists that a boundary vector is put into at most, and
    how far they may be; share: of the true neighbours of 256 of the table's vectors that the ratio has to find; block, query_block: vectors
    and queries that one task holds at a time.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("x").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = lengths[0]["n"]
    index = build_index(rows.where(F.size("x") == n), k, list_size, sample_rows, max_lists, replicas, replica_ratio, share)
    asked = materialize(usable(queries, id_col, vector_col).where(F.size("x") == n).select(F.col("id").alias("query_id"), "key", "x").distinct(), "asked")
    groups = asked.groupBy("key", "x").agg(F.min("query_id").alias("id"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups, "askers")
    found = materialize(probes(index, groups), "probes")

    near = search_index(index, found, k, block, query_block).dropDuplicates(["asker", "rep"])  # boundary vectors stand in several lists
    best = near.withColumn("n", F.row_number().over(Window.partitionBy("asker").orderBy("score", "rep"))).where(F.col("n") <= k + 1)
    # back to all equal vectors, and all queries that ask for the same one
    full = best.join(index.distinct.select(F.col("id").alias("rep"), "ids"), "rep").select("asker", "score", F.explode("ids").alias("vec_id"))
    full = full.withColumn("n", F.row_number().over(Window.partitionBy("asker").orderBy("score", "vec_id"))).where(F.col("n") <= k + 1)
    lists = materialize(full.groupBy("asker").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("found")), "found")
    answers = materialize(groups.select(F.col("id").alias("asker"), "key", "n").join(lists, "asker").select("key", "n", "found"), "answers")
    everyone = join_hot(asked.select("query_id", "key"), answers, "key", "n", max(1, asked.count()))
    ranked = everyone.select("query_id", F.posexplode(F.slice(F.filter("found", lambda s: s["vec_id"] != F.col("query_id")), 1, k)).alias("rank", "hit"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
