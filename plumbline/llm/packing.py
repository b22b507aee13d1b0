"""Best-fit packing of tokenised documents into fixed-length sequences by minimum bin slack.

Documents become pieces of at most `capacity` tokens. Only the piece lengths matter for packing, and there are at
most `capacity` different ones, so their counts (whatever the number of documents) fit on the driver. There, bin
after bin is filled: the longest length left opens it, and a bitset subset-sum over the lengths available finds
the fullest feasible rest. The combination found is used as often as its lengths last and then removed, so that
the number of different combinations stays bounded too. Back in Spark, every piece is ranked among those of its
length and looks its place up in the list of combinations.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cache_of, map_texts, materialize

CAPACITY, END_ID = 2048, 0
#: Characters that are composed, lower-cased and classed alike here and in the tokenizer.
_PLAIN = re.compile(r"[\t\n\r -~¡-¬®-±´-¸º»¿-įĲ-ž]*")


def _listed(kind: str) -> str:
    """The lower-cased plain characters of a class, one by one: a listed class is searched faster than a negated one."""
    plain = {x for c in map(chr, range(0x180)) if _PLAIN.fullmatch(c) for x in c.lower()}
    return "".join(re.escape(c) for c in sorted(plain) if re.fullmatch(kind, c))


#: The pre-tokens of the tokenizer file, for lower-cased texts of the plain characters.
_PRETOKENS = re.compile(rf"[{_listed(r'[^\W\d_]')}]+|\d|'(?:s|t|re|ve|m|ll|d)|[{_listed(r'[^\w\s]|_')}]+")
#: The characters that stand for bytes in byte-level vocabularies.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}


#: What any other way of cutting or joining pre-tokens is seen by.
PROBES = (
    "Hello, World! it's we'll THEY'RE o'clock 'tis don''t", "a1b22c333 4,444.5 x_y__z 100%", " two  spaces\n\n\ttab and end ", "foo.bar@baz.com http://a.b/c?d=e&f=g",
    "été Über ñandú façade Ångström Żółw ¡hola! ¿qué? «x»", "$$$ ### *** --- ...!?", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa internationalisation Zwölf", "(a) [b] {c} <d> \"e\" 'f' `g`",
)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Known(dict):
    """Ids of pre-tokens; one that is looked up first is taken from an older cache or encoded, and kept."""

    def __init__(self, old: dict[str, bytes], merges):
        super().__init__()
        self.old, self.merges = old, merges

    def __missing__(self, p: str) -> bytes:
        found = dict.get(self.old, p)
        if found is None:  # by the model itself: an encoding has offsets and masks that nothing here reads
            mapped = p if p.isascii() else p.encode().decode("latin-1").translate(_BYTES)
            ids = [t.id for t in self.merges.tokenize(mapped)]
            found = struct.pack(f"<{len(ids)}I", *ids)
        self[p] = found
        return found


class WordTokenizer:
    """Token ids of whole texts, as little-endian 32-bit bytes, equal to those of the tokenizer file.

    Its pre-tokens never depend on each other, so each different one is encoded once, by the file's own merge model,
    and kept. There are two caches of bounded size: a full one becomes the old one, from which pre-tokens that are met
    again come back, so memory is bounded whatever the texts and frequent ones stay. Texts with other than
    plain characters, or with a special token's string, go through the whole tokenizer; so do all texts if the file
    at hand doesn't agree on PROBES, as one with other pre-tokens will not.
    """

    def __init__(self, path: str, most: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.merges = self.tokenizer.model  # the merge model alone
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _Known({}, self.merges)
        self.in_parts = True
        self.in_parts = all(self.encode(x) == self._whole(x) for x in PROBES)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.in_parts or not _PLAIN.fullmatch(text) or any(x in text for x in self.specials):
            return self._whole(text)
        if len(self.known) > self.most:
            self.known.old = {}  # the cache before the last goes
            self.known = _Known(self.known, self.merges)
        return b"".join(map(self.known.__getitem__, _PRETOKENS.findall(text.lower())))


@lru_cache(maxsize=2)
def _loaded(path: str) -> WordTokenizer:
    return WordTokenizer(path)


cache_of("packing", _loaded.cache_clear)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, dealt): the documents' ids, each with END_ID added, cut where too long.

    dealt: a random number, which repeated rows do not share; it says nothing once the pieces are written.
    """
    path = path or tokenizer_path()
    end = np.array([END_ID], "<u4").tobytes()
    width = 4 * capacity

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _loaded(path)
        for b in batches:
            rows = []
            for doc_id, ids in zip(b["doc_id"], map(encoder.encode, b["text"])):
                ids += end
                rows += [(doc_id, i // width, i // 4, len(ids[i : i + width]) // 4, zlib.crc32(ids[i : i + width])) for i in range(0, len(ids), width)]
            got = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield got.assign(dealt=np.random.default_rng().integers(0, 1 << 62, len(got)))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_texts(rows, "packing", run, "doc_id long, piece int, start long, length long, ids_crc32 long, dealt long")


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, each used at most as often as counted, with the largest sum up to room; longer lengths are tried first.

    Subset-sum over a bitset: bit s is set when sum s can be made. Multiples of a length are taken in powers of
    two, and the sets before each step lead back from the fullest sum to the lengths.
    """
    if room <= 0:
        return []
    full = (1 << (room + 1)) - 1
    sums, steps = 1, []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left > 0:
            n = min(take, left)
            steps.append((length, n, sums))
            sums |= (sums << (length * n)) & full
            left, take = left - n, take * 2
            if sums >> room & 1:
                break
        if sums >> room & 1:
            break
    at, out = sums.bit_length() - 1, []
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            at -= length * n
            out += [length] * n
    return sorted(out, reverse=True)


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths in a sequence, how many such sequences), using up all counts."""
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        first = max(left)
        left[first] -= 1
        lengths = [first, *fullest(left, capacity - first)]
        left[first] += 1
        used = {x: lengths.count(x) for x in set(lengths)}
        times = min(left[x] // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((lengths, times))
    return out


def _plan_rows(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, ranks from, ranks to, first sequence, slots of this length in it, slot's number, offset) of each slot."""
    rows, sequence, taken = [], 0, {}
    for lengths, times in plan:
        slots = {x: lengths.count(x) for x in set(lengths)}
        seen, offset = dict.fromkeys(slots, 0), 0
        for x in lengths:
            rows.append((x, taken.get(x, 0), taken.get(x, 0) + slots[x] * times, sequence, slots[x], seen[x], offset))
            seen[x] += 1
            offset += x
        for x, n in slots.items():
            taken[x] = taken.get(x, 0) + n * times
        sequence += times
    return rows


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, group_rows: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Whole texts are packed; a null or empty text is one piece that holds END_ID alone. Only documents longer than
    capacity are cut. Repeated rows are packed as often as they occur, a null id is kept, and an empty table gives
    an empty result; other columns, whatever their names, are not looked at.

    group_rows: rows of one length are ranked in groups of about so many, so that a frequent length is not one task's
    work. A piece as long as a sequence needs no rank: it is a sequence of its own.
    """
    spark = docs.sparkSession
    rows = materialize(pieces(docs, path, capacity, id_col, text_col), "pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # capacity rows at most
    full = counts.pop(capacity, 0)
    plan = _plan_rows(minimum_bin_slack(counts, capacity))
    first_full = max((r[3] + (r[2] - r[1]) // r[4] for r in plan), default=0)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    alone = rows.where(F.col("length") == capacity).select(*columns, (F.monotonically_increasing_id() + first_full).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not counts:
        return alone

    groups = F.broadcast(spark.createDataFrame([(x, -(-n // group_rows)) for x, n in counts.items()], "length long, salts int"))
    rows = rows.where(F.col("length") < capacity).join(groups, "length").withColumn("salt", F.pmod("dealt", F.col("salts")).cast("int"))
    before, taken = [], {}
    for r in sorted(rows.groupBy("length", "salt").count().collect()):  # one row per group
        before.append((r["length"], r["salt"], taken.get(r["length"], 0)))
        taken[r["length"]] = taken.get(r["length"], 0) + r["count"]
    offsets = spark.createDataFrame(before, "length long, salt int, before long")
    slots = spark.createDataFrame(plan, "length long, low long, high long, first long, each long, slot long, offset long")

    # ranks of one length, cut where a combination ends; a bounded number of rows
    ranked = rows.join(F.broadcast(offsets), ["length", "salt"]).withColumn(
        "rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "dealt")) - 1
    )
    by_length = slots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "slot", "high", "first", "each", "offset"))).alias("slots"))
    found = ranked.join(F.broadcast(by_length), "length").withColumn(
        "at", F.expr("filter(slots, s -> s.low <= rank and rank < s.high and (rank - s.low) % s.each = s.slot)[0]")
    )
    return found.select(*columns, (F.col("at.first") + F.expr("(rank - at.low) div at.each")).alias("sequence_id"), F.col("at.offset").alias("offset")).unionByName(alone)
