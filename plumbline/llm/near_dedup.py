"""Near-duplicate detection with MinHash signatures and an LSH forest.

Documents whose shingle sets are equal form a class, and only classes are compared. A forest holds several orders of
the signatures (`TREES`), each beginning with hash functions of its own; classes that share the first `DEPTH` of
them are one region of that tree. A crowded region is told apart by the hashes that come next in its order, `DEPTH`
at a time, until its parts are small: its depth adapts to the region. Within a part the signatures are sorted, so that
neighbours in the order share the longest common prefixes; they are candidates, and so is every class with its
region's hubs, the classes that share the most with others over all trees. Together these link groups of copies in
linear time. Then all classes of a region that are still in different components are paired, without any bound by
rank, so no edge of a part and no crowd hides a pair: those of small regions as rows, which their signatures and sizes
screen, those of crowded ones in blocks, whose intersections are counted by matrix products. All links are confirmed
on full shingle sets; components are found by distributed star contraction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, map_texts, maybe_members, member_filter, materialize
from .components import components

TREES, DEPTH = 16, 4
HASHES = TREES * DEPTH
#: The share of pairs at the threshold, whatever it is, that may agree in too few hashes to pass the screen.
LOST = 1e-5
#: Regions of more classes are paired in blocks of about so many classes, and shingles, at most; a block counts the
#: least SKETCH shingles of a class, which are all of most classes.
SMALL, BLOCK, BLOCK_SHINGLES, SKETCH = 32, 2048, 1 << 20, 4096

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(of: np.uint64, name: str, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        a = np.full(max(n, 1 << 17), of, np.uint64)
        a[0] = 1
        _powers[name] = np.cumprod(a)
    return _powers[name][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes, ascending, of a whole text's shingles."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    space = np.concatenate([[True], _SPACE[raw], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * _power(_P, "up", len(raw)), dtype=np.uint64)])
    word = _mixed((sums[last] - sums[first]) * _power(_P_INVERSE, "down", len(raw))[first] + (last - first).astype(np.uint64))
    k = min(words, len(word))
    h = np.zeros(len(word) - k + 1, np.uint64)
    for i in range(k):
        h = h * _P + word[i : len(word) - k + 1 + i]
    return np.unique(_mixed(h + np.uint64(k)))


_FACTORS = np.random.default_rng(20).integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(s: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set of shingles, cut to 32 bits."""
    least = np.full(HASHES, ~np.uint64(0))
    for at in range(0, len(s), 2048):
        least = np.minimum(least, (s[at : at + 2048, None] * _FACTORS).min(0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig) of every whole text; set_key and sig are null for texts without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                s = shingles(text, words)
                key = f"{len(s):x}-{int(np.bitwise_xor.reduce(s)):x}-{int(_mixed(s).sum(dtype=np.uint64)):x}" if len(s) else None
                rows.append((doc_id, len(s), key, signature(s) if len(s) else None))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set_key", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(rows, "near", run, "doc_id long, n_shingles long, set_key string, sig array<int>")


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(rep, n, data): the full shingle sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t, words).view(np.int64) for t in b["text"]]
            yield pd.DataFrame({"rep": b["rep"], "n": [len(s) for s in sets], "data": sets})

    rows = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    return map_texts(rows, "near", run, "rep long, n long, data array<bigint>")


def least_agreement(percent: int) -> int:
    """In how many of the hashes a pair has to agree: at most LOST of those at percent/100 agree in fewer."""
    p, below, k = percent / 100, 0.0, 0
    while k < HASHES:
        below += math.comb(HASHES, k) * p**k * (1 - p) ** (HASHES - k)
        if below > LOST:
            break
        k += 1
    return k


def _beside(pairs: DataFrame, data: DataFrame, chunk: int = 500) -> DataFrame:
    """pairs (a, b) with n and data of both ends. An a with many pairs is copied for every `chunk` of them."""
    sizes = materialize(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("pairs")).withColumn("salts", F.ceil(F.col("pairs") / chunk).cast("int")), "salts")
    salted = join_hot(pairs, sizes, "a", "pairs", max(1, pairs.count())).select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    left = data.join(sizes, data["rep"] == sizes["a"]).select(
        "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("n").alias("na"), F.col("data").alias("da")
    )
    right = data.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("data").alias("db"))
    return salted.join(right, "b").join(left, ["a", "salt"])


def _screened(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes allow the similarity, and whose signatures agree in enough hashes."""
    x = _beside(pairs, classes.select("rep", "n", F.col("sig").alias("data")))
    agree = F.aggregate(F.zip_with("da", "db", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, e: s + e)
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return x.where(sizes).where(agree >= least_agreement(percent)).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    both = F.size(F.array_intersect("da", "db"))
    return _beside(pairs, sets).withColumn("both", both).where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _shared(p: list[np.ndarray], q: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """How many values each array of p has in common with each of q."""
    flat = [np.concatenate(x) for x in (p, q)]
    row = [np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (p, q)]
    common = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    cells = []
    for f, r in zip(flat, row):
        at = np.searchsorted(common, f)
        ok = at < len(common)
        ok[ok] = common[at[ok]] == f[ok]
        order = np.argsort(at[ok], kind="stable")
        cells.append((at[ok][order], r[ok][order]))
    out = np.zeros((len(p), len(q)), np.float32)  # counts up to SKETCH are exact
    for lo in range(0, len(common), columns):
        part = []
        for (at, r), n in zip(cells, out.shape):
            i, j = np.searchsorted(at, [lo, lo + columns])
            m = np.zeros((n, min(columns, len(common) - lo)), np.float32)
            m[r[i:j], at[i:j] - lo] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out


def _spanning(x: np.ndarray) -> list[tuple[int, int]]:
    """Enough of the true cells (row, column) to connect all that the true cells connect."""
    across, left = (x, np.ascontiguousarray(x.T)), (np.ones(x.shape[0], bool), np.ones(x.shape[1], bool))
    found = []
    for start in np.flatnonzero(x.any(1)):
        if not left[0][start]:
            continue
        left[0][start] = False
        todo = [(0, start)]
        while todo:
            side, i = todo.pop()
            new = np.flatnonzero(across[side][i] & left[1 - side])
            left[1 - side][new] = False
            found += [(j, i) if side else (i, j) for j in new]
            todo += [(1 - side, j) for j in new]
    return found


def _block_pairs(p: pd.DataFrame, q: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs (a, b) of different components that connect all similar ones of p and q.

    If a class has more than SKETCH shingles, all are compared by a sample: those up to the smallest of such classes'
    last values. Then all pairs within five standard errors of the threshold are given (2.9 in 10^7 are not).
    """
    sets = [[v.view(np.uint64) for v in x["data"]] for x in (p, q)]
    cuts = [v[-1] for x, vs in zip((p, q), sets) for n, v in zip(x["n"], vs) if n > len(v)]
    if cuts:
        sets = [[v[: np.searchsorted(v, min(cuts), "right")] for v in vs] for vs in sets]
    both = _shared(*sets).astype(float)
    union = np.array([len(v) for v in sets[0]])[:, None] + np.array([len(v) for v in sets[1]]) - both
    share = percent / 100
    near = both >= share * union - 5 * np.sqrt(share * (1 - share) * union) if cuts else 100 * both >= percent * union
    n, m = p["n"].to_numpy()[:, None], q["n"].to_numpy()
    near &= (p["component"].to_numpy()[:, None] != q["component"].to_numpy()) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    i, j = np.nonzero(near) if cuts else np.array(_spanning(near), np.int64).reshape(-1, 2).T
    i, j = p["rep"].to_numpy()[i], q["rep"].to_numpy()[j]
    return pd.DataFrame({"a": np.minimum(i, j), "b": np.maximum(i, j)})


def _in_blocks(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components and one region, from blocks of crowded regions; rows: region, rep, n, component.

    A cell has the classes of a region in one band of sizes; a component with many of them is a cell of its own, as
    it needs no pairs within. Cells are salted into blocks, and only those of neighbouring bands can have similar sets.
    """
    band = F.floor(F.log("n") / (1.0001 * max(math.log(100 / percent), 0.001)))
    rows = materialize(rows.withColumn("band", band).withColumn("part", F.xxhash64("region", "band", "component")), "crowded")
    total = max(1, rows.count())
    parts = rows.groupBy("part", "region", "band", "component").agg(F.count(F.lit(1)).alias("n_part"), F.sum(F.least("n", F.lit(SKETCH))).alias("load"))
    parts = parts.withColumn("own", F.when(F.col("n_part") >= BLOCK // 4, F.col("component"))).withColumn("cell", F.xxhash64("region", "band", "own"))
    parts = materialize(parts, "parts")
    cells = parts.groupBy("cell", "region", "band", "own").agg(F.sum("n_part").alias("n_cell"), F.sum("load").alias("load"))
    cells = materialize(cells.withColumn("salts", F.ceil(F.greatest(F.col("n_cell") / BLOCK, F.col("load") / BLOCK_SHINGLES)).cast("int")), "cells")
    dealt = materialize(join_hot(rows.select("rep", "n", "component", "part"), parts.select("part", "cell", "n_part"), "part", "n_part", total).select("rep", "n", "component", "cell"), "dealt")
    dealt = join_hot(dealt, cells.select("cell", "salts", "n_cell"), "cell", "n_cell", total)
    dealt = dealt.select("rep", "n", "component", "cell", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"))

    blocks = cells.select("region", "band", "own", "cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    blocks = blocks.select("region", "band", "own", F.struct("cell", "salt").alias("block"))
    other = blocks.select("region", F.col("band").alias("band2"), F.col("own").alias("own2"), F.col("block").alias("block2"))
    met = blocks.join(other, "region").where("block <= block2 and abs(band - band2) <= 1 and coalesce(own <> own2, true)")
    sides = met.select("block", "block2", F.explode(F.when(F.col("block") == F.col("block2"), F.array("block")).otherwise(F.array("block", "block2"))).alias("side"))
    sides = sides.select("block", "block2", F.col("side.cell").alias("cell"), F.col("side.salt").alias("salt"), (F.col("side") == F.col("block")).alias("first"))
    filled = dealt.join(sides, ["cell", "salt"]).join(sets.select("rep", F.slice("data", 1, SKETCH).alias("data")), "rep")
    filled = filled.select(F.col("block.cell").alias("p"), F.col("block.salt").alias("ps"), F.col("block2.cell").alias("q"), F.col("block2.salt").alias("qs"), "first", "rep", "n", "component", "data")

    def run(x: pd.DataFrame) -> pd.DataFrame:
        p, q = x[x["first"]], x[~x["first"]]
        alone = x["p"].iat[0] == x["q"].iat[0] and x["ps"].iat[0] == x["qs"].iat[0]
        if alone:
            q = p
        return _block_pairs(p, q, percent) if len(p) and len(q) else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})

    return filled.groupBy("p", "ps", "q", "qs").applyInPandas(run, "a long, b long")


def _prefix_neighbours(members: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """Pairs (a, b) of classes that are next to each other in the sorted order of their region's part.

    members: region, tree, rep, company (the region's classes). Parts of more than SMALL classes go `DEPTH` hashes
    deeper, up to three times; what is crowded even then is dealt into groups of about SMALL at random.
    """
    order = F.transform(F.sequence(F.lit(DEPTH), F.lit(4 * DEPTH - 1)), lambda i: F.get("sig", (F.col("tree") * DEPTH + i) % HASHES))
    rows = members.join(classes.select("rep", "sig"), "rep").select("rep", F.col("region").alias("part"), F.col("company").alias("n"), order.alias("next"))
    done = rows.where(F.col("n") <= SMALL).select("rep", "part", "next")
    # each crowded class under its deeper prefixes: the first that few share is its part, else the deepest, dealt out
    deeper = F.array(*[F.struct(F.lit(k).alias("level"), F.xxhash64("part", F.slice("next", 1, k * DEPTH)).alias("key")) for k in (1, 2, 3)])
    crowded = rows.where(F.col("n") > SMALL).select("rep", "part", "next", F.inline(deeper))
    sizes = materialize(crowded.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "sizes")
    placed = join_hot(crowded, sizes, "key", "n", max(1, 3 * total))
    few = F.col("n") <= SMALL
    best = placed.groupBy("rep", "part").agg(F.min_by(F.struct("key", "n", "next"), F.when(few, F.col("level")).otherwise(10 - F.col("level"))).alias("b")).select("rep", "b.*")
    dealt = best.select("rep", F.when(few, F.col("key")).otherwise(F.xxhash64("key", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / SMALL)))).alias("part"), "next")
    after = F.lead("rep").over(Window.partitionBy("part").orderBy("next", "rep"))
    pairs = done.unionByName(dealt).select("rep", after.alias("other")).where(F.col("other").isNotNull())
    return pairs.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()


def _rest_of_regions(members: DataFrame, rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components and one region that may be similar enough: enough to connect all that are."""
    rows = materialize(members.select("region", "rep").join(rest.select("rep", "n", "component"), "rep"), "placed")
    mixed = rows.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("least"), F.max("component").alias("most"))
    mixed = materialize(mixed.where("least < most").select("region", "m"), "mixed")
    rows = materialize(join_hot(rows, mixed, "region", "m", max(1, rows.count())), "rows")
    all_of = rows.where(F.col("m") <= SMALL).groupBy("region").agg(F.collect_list(F.struct("rep", "n", "component")).alias("all"))
    few = all_of.select("all", F.explode("all").alias("p")).select("p", F.explode("all").alias("q")).where("p.rep < q.rep and p.component <> q.component")
    few = few.where(100 * F.least("p.n", "q.n") >= percent * F.greatest("p.n", "q.n")).select(F.col("p.rep").alias("a"), F.col("q.rep").alias("b")).distinct()
    few = _screened(materialize(few, "few"), rest, percent)
    crowded = rows.where(F.col("m") > SMALL).select("region", "rep", "n", "component")
    return few.unionByName(_in_blocks(crowded, sets, percent)).distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text", max_filter_bits: int = 1 << 27) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Two documents are linked when the Jaccard similarity of their sets of `words`-word shingles (of A-Z lower-cased
    texts; the whole sequence, if it has fewer words) is at least percent/100. component_id is the smallest id that
    can be reached over links. A null text counts as empty; texts without words are linked with nothing and kept.
    Rows with a null id are linked with nothing too (component_id is null, kept true). Repeated rows share their
    component; ids are taken to be unique otherwise. An empty table gives an empty result; other columns, whatever
    their names, are not looked at.
    """
    all_rows = materialize(signatures(docs, id_col, text_col, words), "signatures")
    rows = all_rows.where(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    classes = materialize(rows.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "classes")
    n_classes = classes.count()

    # regions with company, and the classes in them
    prefix = F.array(*[F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), *[F.col("sig")[t * DEPTH + i] for i in range(DEPTH)]).alias("region")) for t in range(TREES)])
    placed = materialize(classes.select("rep", F.inline(prefix)), "placed")
    regions = materialize(placed.groupBy("region").agg(F.count(F.lit(1)).alias("company")).where("company > 1"), "regions")
    members = materialize(join_hot(placed, regions, "region", "company", n_classes * TREES), "members")
    scores = materialize(members.groupBy("rep").agg(F.sum("company").alias("score")), "scores")

    # hubs: the highest scores of a region; of equal ones both the smallest and the largest id
    scored = members.join(scores, "rep").select("region", "rep", "company", F.struct("score", "rep").alias("up"), F.struct("score", (-F.col("rep")).alias("rep")).alias("down"))
    hubs = materialize(scored.groupBy("region").agg(F.max("up").alias("up"), F.max("down").alias("down"), F.count(F.lit(1)).alias("n")), "hubs")
    near = join_hot(members.select("region", "rep"), hubs, "region", "n", max(1, members.count()))
    pairs = near.select(F.explode(F.array(F.col("up.rep"), -F.col("down.rep"))).alias("a"), F.col("rep").alias("b")).where("a <> b")
    pairs = pairs.unionByName(_prefix_neighbours(members, classes, n_classes * TREES)).distinct()
    crowd = materialize(classes.join(scores, "rep", "left_semi"), "crowd")
    pairs = materialize(_screened(materialize(pairs, "pairs"), crowd, percent), "pairs")

    # full sets, made again for classes with company only: a bounded filter finds their documents in a second pass
    bits = min(max_filter_bits, max(1 << 16, 1 << (16 * n_classes).bit_length()))
    words_of = materialize(member_filter(crowd, "rep", bits), "filter")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    sets = shingle_sets(maybe_members(texts, words_of, "rep", bits), "rep", "text", words)
    sets = materialize(sets.join(crowd.select("rep"), "rep", "left_semi").dropDuplicates(["rep"]), "sets")

    links = materialize(_confirmed(pairs, sets, percent), "links")
    known = components(links)
    rest = crowd.join(known, crowd["rep"] == known["id"], "left").select("rep", "n", "sig", F.coalesce("component", "rep").alias("component"))
    more = materialize(_rest_of_regions(members, materialize(rest, "rest"), sets, percent), "pairs")
    links = links.unionByName(_confirmed(more, sets, percent))
    found = components(materialize(links, "links"))

    labelled = materialize(
        classes.join(found, classes["rep"] == found["id"], "left").select("set_key", "size", F.coalesce("component", "rep").alias("component_id")), "labelled"
    )
    with_words = join_hot(rows.select("doc_id", "n_shingles", "set_key"), labelled, "set_key", "size", max(1, rows.count())).select("doc_id", "n_shingles", "component_id")
    without = all_rows.where(F.col("doc_id").isNull() | F.col("set_key").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return with_words.unionByName(without).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
