"""Audit of how sources of a language diverge in their words, from one-hot level products.

A term's count in a source is its level there. Per language, a matrix with a row per term and an indicator column per
(source, level) has as the product of its transpose with itself the joint tables of all pairs of sources: how many
terms stand at level a in one and at level b in the other. A price depends on the levels alone, so each entry is
priced once, however many terms share it. Terms are dealt to blocks by a hash, sources to blocks by their rank; a task
holds one block of terms for two blocks of sources and multiplies tile by tile. Products count at most a block's terms,
so doubles hold them exactly; prices and sums are whole numbers of 64 bits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LEAST_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Terms and sources of a block; columns of a tile; different (source, term) pairs that a task counts before it passes them on.
BLOCK_TERMS, BLOCK_SOURCES, TILE, MOST_COUNTED = 2048, 256, 1024, 1 << 18

#: ASCII letters are lower-cased, all other ASCII bytes part terms; other bytes belong to terms.
_LETTERS = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x > 127 else 32 for x in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): counts of a task's rows, passed on whenever there are many."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = [t.decode("utf-8", "surrogatepass") for t in n]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(terms, pa.string()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], schema=COUNTS)
        counts.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for lang, source, text in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns]):
                terms = terms_of(text)
                n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
                n.update(terms)
                docs.update(set(terms))
            if sum(len(n) for n, _ in counts.values()) > MOST_COUNTED:
                yield from passed_on()
    yield from passed_on()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term. docs: lang, source, text."""
    parts = docs.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)), exactly; 1 where nothing is kept."""
    whole = lambda c: c.cast("decimal(38,0)")
    x = F.call_function("div", whole((n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")), whole(F.nullif(total + kept, F.lit(0))))
    return 1 + F.coalesce(x, F.lit(0)).cast("long")


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def products(data: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """(lang, a, b, value): for all ordered pairs of the two blocks' sources the part of a block's terms.

    data: term, at (place of the source), p (price of its level), of a block of terms; sources: place, none
    (price of level nought) and own (their block) of a pair of blocks, and n_terms, the block's number of terms. Levels with one price are one column,
    as prices decide alone; terms that none of the sources has are one row, counted as often.
    """
    lang, first, second, n_terms = (sources[c].iloc[0] for c in ("lang", "first", "second", "n_terms"))
    sources = sources.sort_values("place")
    places, none = sources["place"].to_numpy(), sources["none"].to_numpy()
    kinds, term = np.unique(data["term"].to_numpy(), return_inverse=True)
    level = np.tile(none, (len(kinds), 1))
    level[term, np.searchsorted(places, data["at"].to_numpy())] = data["p"].to_numpy()
    columns, owner, prices = [], [], []  # one-hot columns, by source
    for s in range(len(places)):
        own, of = np.unique(level[:, s], return_inverse=True)
        columns.append(of + len(prices))
        prices += own.tolist()
        owner += [s] * len(own)
    owner, prices = np.array(owner, int), np.array(prices, np.int64)
    value = (none[:, None] - none[None, :]) ** 2 // none[None, :] * (n_terms - len(kinds))
    if len(prices):
        hot = np.stack(columns, 1)  # the columns of a term that are one

        def indicators(lo: int, hi: int) -> np.ndarray:
            x = np.zeros((len(hot), hi - lo))
            r, c = np.nonzero((hot >= lo) & (hot < hi))
            x[r, hot[r, c] - lo] = 1
            return x

        for i in range(0, len(prices), TILE):
            left = indicators(i, min(i + TILE, len(prices)))
            for j in range(i, len(prices), TILE):
                right = left if j == i else indicators(j, min(j + TILE, len(prices)))
                a, b = np.nonzero(joint := left.T @ right)  # the joint table of these levels
                n, a, b = joint[a, b].astype(np.int64), a + i, b + j
                square = (prices[a] - prices[b]) ** 2
                np.add.at(value, (owner[a], owner[b]), n * (square // prices[b]))
                if j != i:
                    np.add.at(value, (owner[b], owner[a]), n * (square // prices[a]))
    block = sources["own"].to_numpy()
    a, b = np.nonzero(~np.eye(len(places), dtype=bool) & (((block[:, None] == first) & (block[None, :] == second)) | ((block[:, None] == second) & (block[None, :] == first))))
    return pd.DataFrame({"lang": lang, "a": places[a], "b": places[b], "value": value[a, b]})


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how the sources of each language diverge from each other (part `pair`,
    item: the other source) and which terms set a source apart from its language (part `term`, `top` of them at most).

    A null text, language or source counts as an empty one. Terms are runs of letters and characters beyond ASCII,
    A-Z lower-cased; those in at least 3 documents of the language are kept. A group without kept terms has a rank for
    every other source all the same. Ties go to the lesser item in UTF-8. Every row counts, repeated ones too. An empty
    table gives an empty result; other columns are not looked at.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])
    counts = materialize(term_counts(rows), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).drop("docs")
    kept = materialize(kept, "kept-terms")
    own = materialize(counts.drop("docs").join(kept, ["lang", "term"]), "kept-counts")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all").alias("total"))
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    by_rank = Window.partitionBy("lang").orderBy("source")  # a row per source
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", F.coalesce("n_group", F.lit(0)).alias("n_group"), F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("total", F.lit(0)).alias("total"), (F.row_number().over(by_rank) - 1).alias("at"),
    )
    groups = materialize(groups.withColumn("p0", price(F.lit(0), F.col("n_group"), F.col("kept"))), "sources")
    priced = own.join(groups, ["lang", "source"]).withColumn("p", price(F.col("n"), F.col("n_group"), F.col("kept")))

    q = price(F.col("all"), F.col("total"), F.col("kept"))
    apart = priced.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    apart = apart.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    block = F.floor(F.col("at") / BLOCK_SOURCES).cast("int")
    size = groups.groupBy("lang").agg(F.max(block).alias("last"), F.greatest(F.lit(1), F.ceil(F.max("kept") / BLOCK_TERMS)).cast("int").alias("parts"))
    # a block of sources takes part in the pairs with each block, itself included
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("last")), lambda o: F.struct(F.least(o, F.col("block")).alias("first"), F.greatest(o, F.col("block")).alias("second")))).alias("pair")
    key = ["lang", "first", "second", "part"]
    dealt = priced.select("lang", "term", "at", "p", block.alias("block")).join(size, "lang").select("lang", "term", "at", "p", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("part"), pairs)
    dealt = dealt.select("lang", "pair.*", "part", "term", "at", "p")
    heads = groups.withColumn("block", block).join(size, "lang").select("lang", F.col("at").alias("place"), F.col("p0").alias("none"), F.col("block").alias("own"), "parts", pairs).select("lang", "place", "none", "own", "pair.*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    sizes = kept.join(size, "lang").groupBy("lang", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n_terms"))
    heads = heads.join(sizes, ["lang", "part"], "left").fillna(0, ["n_terms"])
    parts = dealt.groupBy(*key).cogroup(heads.groupBy(*key)).applyInPandas(products, "lang string, a int, b int, value long")
    sums = materialize(parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "joint-sums")
    name = lambda at, to: groups.select("lang", F.col("at").alias(at), F.col("source").alias(to))
    pair = sums.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    pair = pair.withColumn("rank", F.row_number().over(best))
    return pair.unionByName(apart)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT r, lang, source, unnest(ts) AS term FROM d), dc AS (SELECT r, lang, source, term, count(*) AS n FROM w GROUP BY ALL), c AS (SELECT lang, source, term, sum(n) AS n FROM dc GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM dc GROUP BY ALL HAVING count(*) >= 3), l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT x.lang, x.source, coalesce(sum(c.n) FILTER (k.term IS NOT NULL), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c ON c.lang = x.lang AND c.source = x.source LEFT JOIN k ON k.lang = c.lang AND k.term = c.term GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS c, k.n AS all_n, l.n AS total, v, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + v) AS p FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pr AS (SELECT a.lang, a.source, b.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
q AS (SELECT *, 1 + (1000000000::HUGEINT * (all_n + 1)) // (total + v) AS q FROM p), t AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM q WHERE c > 0 AND p > q),
u AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pr UNION ALL SELECT lang, source, 'term', item, value FROM t)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM u QUALIFY part = 'pair' OR rank <= 200
"""
