"""Line deduplication by winnowing over line hashes, in DataFrame operations.

Every non-empty line of a document has a hash; of each window of `WINDOW` consecutive lines the one with the least
hash (of equal ones the last) is selected, so two texts that share as many consecutive lines are sure to select the
same line in both. A line of many words is a window of its own. Only selected lines, the fingerprints, are written,
with their positions. Positions whose fingerprint occurs once drop out; the others are joined, and each is extended to
the line before and after, as far as the windows that selected it reach. These matches are compared on the texts of
their lines (by SHA-256), so a collision of line hashes costs time and never a line. All but the first place of a
match (by document id, then line) are repeats; overlapping repeats make up runs, whose lines go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, maybe_members, member_filter, materialize

WINDOW, LONG_LINE_WORDS = 2, 50


def _lines(text: Column, long_words: int, hash_bits: int) -> Column:
    """The non-empty lines of a whole text: at (its number among all lines), t, h, long."""
    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    h = lambda x: F.shiftrightunsigned(F.xxhash64(x), 64 - hash_bits)
    every = F.transform(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x, i: F.struct(i.alias("at"), x.alias("t"), h(x).alias("h"), (words(x) >= long_words).alias("long")))
    return F.filter(every, lambda x: x["t"] != "")


def _selected_before(i: Column) -> Column:
    """Whether the window of line i and the one before it selects line i."""
    return (i > 0) & (F.get("l", i)["h"] <= F.get("l", i - 1)["h"])


def _selected_after(i: Column) -> Column:
    return (i < F.size("l") - 1) & (F.get("l", i)["h"] < F.get("l", i + 1)["h"])


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, key): rows are told apart by id and text; a null id has no key."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumn("key", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))


def fingerprints(rows: DataFrame, long_words: int = LONG_LINE_WORDS, hash_bits: int = 64) -> DataFrame:
    """(doc_id, key, at, h, windows): the selected lines of every whole text, at counting its non-empty lines.

    windows: what selected the line, extended from it to the line before or after: start, lines (their numbers among
    all lines of the text) and digest (128 bits of the SHA-256 of their texts).
    """
    x = rows.where(F.col("key").isNotNull()).select("doc_id", "key", _lines(F.col("text"), long_words, hash_bits).alias("l")).where(F.size("l") > 0)

    def window(ok: Column, start: Column, n: int) -> Column:
        lines = [F.get("l", start + k) for k in range(n)]
        # a line holds no line break, so the joined texts tell windows apart
        digest = F.unhex(F.substring(F.sha2(F.concat_ws("\n", *[y["t"] for y in lines]).cast("binary"), 256), 1, 32))
        return F.when(ok, F.struct(start.alias("start"), F.array(*[y["at"] for y in lines]).alias("lines"), digest.alias("digest")))

    def chosen(i: Column) -> Column:
        extended = F.array(window(_selected_before(i), i - 1, 2), window(_selected_after(i), i, 2), window(F.get("l", i)["long"], i, 1))
        return F.struct(i.alias("at"), F.get("l", i)["h"].alias("h"), F.filter(extended, lambda w: w.isNotNull()).alias("windows"))

    picked = F.filter(F.sequence(F.lit(0), F.size("l") - 1), lambda i: _selected_before(i) | _selected_after(i) | F.get("l", i)["long"])
    return x.select("doc_id", "key", F.inline(F.transform(picked, chosen)))


def _maybe(rows: DataFrame, ids: DataFrame, column: str, name: str, bits: int) -> DataFrame:
    return maybe_members(rows, materialize(member_filter(ids, column, bits), name), column, bits)


def repeated_lines(rows: DataFrame, long_words: int = LONG_LINE_WORDS, hash_bits: int = 64, max_filter_bits: int = 1 << 26) -> DataFrame:
    """(key, gone): for texts that repeat earlier runs, the numbers (among all lines) of the lines that go."""
    prints = materialize(fingerprints(rows, long_words, hash_bits), "prints")
    counted = materialize(prints.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    # a bounded filter leaves most rows where they are; those it lets through are joined exactly
    some = materialize(_maybe(prints, counted, "h", "filter", max_filter_bits), "some")
    found = join_hot(some, counted, "h", "n", max(1, some.count())).select("doc_id", "key", F.inline("windows"))
    found = materialize(found, "matches")
    firsts = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "key", "start")).alias("first")).where("n > 1")
    later = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("key") != F.col("first.key")) | (F.col("start") >= F.col("first.start") + F.size("lines"))
    repeats = join_hot(found, materialize(firsts, "firsts"), "digest", "n", max(1, found.count())).where(later)
    return repeats.select("key", F.explode("lines").alias("at")).groupBy("key").agg(F.collect_set("at").alias("gone"))


def dedup_lines(docs: DataFrame, long_words: int = LONG_LINE_WORDS, id_col: str = "doc_id", text_col: str = "text", max_filter_bits: int = 1 << 26, hash_bits: int = 64) -> DataFrame:
    """doc_id, text, n_lines, n_removed: one row per row of docs, with the lines of later repeated runs taken out.

    A run is two or more consecutive non-empty lines, or one line of at least long_words words (parted by single
    spaces), that stand together at an earlier place too (a smaller id, or earlier in the same text without overlap);
    lines are compared without spaces at their ends. Line breaks go with their lines; empty lines stay. A null text
    counts as empty; rows with a null id are returned as they are. Rows that repeat an id and its text are one
    document and get the same result; of rows that share an id but not a text, either may be the earlier one. An
    empty table gives an empty result; other columns, whatever their names, are not looked at.

    hash_bits, max_filter_bits change the cost, never the result.
    """
    rows = keyed(docs, id_col, text_col)
    gone = materialize(repeated_lines(rows, long_words, hash_bits, max_filter_bits), "gone")
    place = F.pmod(F.xxhash64("key"), F.lit(max_filter_bits).cast("long"))
    words = materialize(member_filter(gone, "key", max_filter_bits), "filter")
    marked = rows.withColumn("_word", F.shiftright(place, 6)).join(F.broadcast(words.select(F.col("word").alias("_word"), F.col("mask").alias("_mask"))), "_word", "left")
    hit = F.col("key").isNotNull() & F.coalesce(F.getbit("_mask", (place % 64).cast("int")) == 1, F.lit(False))
    # only texts that may lose lines are shuffled
    same = marked.where(~hit).select("doc_id", "text", F.lit(None).cast("array<int>").alias("gone"))
    changed = marked.where(hit).select("doc_id", "text", "key").join(gone, "key", "left").select("doc_id", "text", "gone")
    split = same.unionByName(changed).withColumn("split", F.split("text", "\n"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("split") - 1), "gone"), lambda i: F.get("split", i))
    return split.select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size(F.filter("split", lambda x: F.trim(x) != "")).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


ORACLE = """
WITH lines AS (
  SELECT doc_id, t.i AS pos, t.x AS line FROM (
    SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'i': i, 'x': x})) AS t FROM documents)
), full_lines AS (
  SELECT doc_id, pos, trim(line) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS num FROM lines WHERE trim(line) <> ''
), windows AS (
  SELECT doc_id, num AS start, 2 AS span, line AS a, lead(line) OVER (PARTITION BY doc_id ORDER BY num) AS b FROM full_lines
  UNION ALL
  SELECT doc_id, num, 1, line, NULL FROM full_lines WHERE length(line) - length(replace(line, ' ', '')) + 1 >= 50
), ranked AS (
  SELECT *, first_value(doc_id) OVER w AS first_doc, first_value(start) OVER w AS first_start
  FROM windows WHERE span = 1 OR b IS NOT NULL WINDOW w AS (PARTITION BY span, a, b ORDER BY doc_id, start)
), gone AS (
  SELECT DISTINCT doc_id, start + k AS num FROM ranked, (VALUES (0), (1)) AS o(k)
  WHERE k < span AND (doc_id > first_doc OR doc_id = first_doc AND start >= first_start + span)
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
  FROM lines l LEFT JOIN full_lines f USING (doc_id, pos) LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.num = f.num
  WHERE g.num IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id, (SELECT count(*) FROM full_lines f WHERE f.doc_id = d.doc_id) AS n_lines,
       (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_removed, sha256(coalesce(k.text, '')) AS text_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
