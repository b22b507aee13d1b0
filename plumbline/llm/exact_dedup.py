"""Exact deduplication with a two-pass Bloom filter, in DataFrame operations only.

Pass 1 hashes every text once and sets one position of a Bloom filter for it. The filter is kept in words of 64
positions, and each task combines what it sets in a word (the positions, and how many rows set them) before anything
moves: a word that more rows have set than it has positions set holds a repeated position. Pass 2 tests every row
against those words (their number is bounded by `max_filter_bits`, so they can be broadcast). Rows whose word holds no
repeat have a text of their own and pass straight through; only the others are shuffled by their digest and grouped
exactly. A filter that is too full lets more rows through to the exact grouping, which shuffles their digests, never
their texts, and never changes the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256, h): the only pass over the texts. A null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), F.xxhash64(text).alias("h"))


def filter_bits(rows: int, bits_per_row: int, max_filter_bits: int) -> int:
    """A power of two from 2^16 to max_filter_bits."""
    return min(max_filter_bits, max(1 << 16, 1 << (rows * bits_per_row - 1).bit_length() if rows else 0))


def _place(bits: int):
    return F.pmod(F.xxhash64(F.lit(1), F.col("h")), F.lit(bits).cast("long"))


def repeated_words(digests: DataFrame, bits: int) -> DataFrame:
    """(word): the numbers of the filter's 64-bit words in which some position is set by two rows; bits/64 at most."""
    place = digests.select(_place(bits).alias("place")).select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
    set_ = place.groupBy("word").agg(F.bit_or("bit").alias("seen"), F.count(F.lit(1)).alias("n"))
    return set_.where(F.col("n") > F.bit_count("seen")).select("word")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 64, max_filter_bits: int = 1 << 28
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical; null counts as empty, so all null and empty texts are one group. Of
    equal texts the row with the largest id stays. Rows that repeat an id and its text get the same verdict, and a
    null id never stays (kept is false; keep_id is null if all ids of the group are null). Other columns of docs,
    whatever their names, are not looked at; an empty table gives an empty result.

    bits_per_row, max_filter_bits: size of the Bloom filter; they change cost, never the result. With 64 bits a row,
    some 2 % of the rows with a text of their own are grouped too, with 16 some 15 %; the largest filter is full at
    about 10^8 rows, and then all digests are grouped.
    """
    digests = materialize(text_digests(docs, id_col, text_col), "digests")
    bits = filter_bits(digests.count(), bits_per_row, max_filter_bits)
    words = materialize(repeated_words(digests, bits), "bloom")
    tested = digests.withColumn("word", F.shiftright(_place(bits), 6)).join(F.broadcast(words.withColumn("hit", F.lit(True))), "word", "left")
    tested = tested.select("doc_id", "text_sha256", F.col("hit").isNotNull().alias("maybe"))

    alone = tested.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.col("doc_id").isNotNull().alias("kept"), "text_sha256"
    )
    maybe = materialize(tested.where("maybe").select("doc_id", "text_sha256"), "maybe")
    groups = materialize(maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    grouped = join_hot(maybe, groups, "text_sha256", "group_size", maybe.count()).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256"
    )
    return alone.unionByName(grouped)


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
