"""Substring deduplication by relative Lempel-Ziv parsing.

A document is parsed into factors that also stand elsewhere, at two grains. Its windows of `WINDOW` words are cut into
stretches by their least `ANCHOR`-gram, which two equal windows share wherever they stand; so the words around an
anchor form the one reference block that can hold another copy of these windows. Coarse factors are stretches that
stand elsewhere as a whole; their digests tell. Where a coarse factor ends (its stretch is the only one of its kind,
but its anchor stands elsewhere), the words of the stretch and of one stretch of each kind about the same anchor meet
in the anchor's block. There a suffix order gives longest matches, the stretch is parsed greedily, a long factor is a
duplicate at once, and windows across a boundary of factors are looked up one by one.

Nothing is paired: counts of stretches are combined before they move, and an anchor with very many kinds of stretches
(text that is common but continues differently) is told apart by whole windows, which are counted in the same way.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cache_of, map_texts, materialize, maybe_members, member_filter

WINDOW, ANCHOR = 35, 6
SPAN = WINDOW - ANCHOR + 1  # anchors that begin in a window
#: Anchors with more kinds of stretches are told apart by whole windows; words of a block's reference at a time.
MOST_KINDS, BLOCK_WORDS = 1024, 1 << 18
MOST_FILTER_BITS = 1 << 26
_PART, _CHUNK = 1 << 20, 1 << 17
_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64) | np.uint64(1)
_powers = np.ones((2, WINDOW + SPAN), np.uint64)
for _i in range(1, WINDOW + SPAN):
    _powers[:, _i] = _powers[:, _i - 1] * _ODD


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, some 10^6 bytes at a time; bytes are parted at ASCII white space."""
    data, at = (text or "").encode("utf-8", "surrogatepass"), 0
    while at < len(data):
        end = at + _PART
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[at:end].split()
        at = end


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


#: Of a byte, and of places in a part of a text: a word's hash is the polynomial of its bytes, mixed.
_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * _ODD[1])
_GAP = re.compile(rb"[ \t\n\r\x0b\x0c]")
_IS_GAP = np.zeros(256, bool)
_IS_GAP[list(b" \t\n\r\x0b\x0c")] = True


def _powers_of(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[0] = 1
    return np.multiply.accumulate(out)


@functools.lru_cache(1)
def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base for n places, and their inverses."""
    return _powers_of(_ODD[0], n), _powers_of(np.uint64(pow(int(_ODD[0]), -1, 1 << 64)), n)


cache_of("substring", _places.cache_clear)


def hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of some texts, and which text each is in; some 10^6 bytes at a time."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    begins = np.cumsum([0] + [len(x) + 1 for x in data[:-1]])
    data, at, out = b"\n".join(data), 0, []
    while at < len(data):
        gap = _GAP.search(data, at + _PART)
        end = gap.start() if gap else len(data)
        part = np.frombuffer(data, np.uint8, end - at, at)
        power, inverse = (x[: len(part)] for x in _places(max(_PART, len(part)) if len(part) > _PART * 2 else _PART * 2))
        edge = np.flatnonzero(np.diff(np.r_[True, _IS_GAP[part], True].view(np.int8)))
        start, stop = edge[::2], edge[1::2]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * power, out=sums[1:])
        h = _mixed((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64))
        out.append((h, np.searchsorted(begins, start + at, "right") - 1))
        at = end
    return (np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def stretches(words: np.ndarray, text: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(h, d, at, n, text) of each stretch, in order: anchor, digest of the words, first window, number of windows and
    the text it stands in. words: of one text or of several, one after the other; text: each word's text, from 0."""
    text = np.zeros(len(words), np.int64) if text is None else text
    begins = np.searchsorted(text, np.arange(text[-1] + 1)) if len(text) else text  # a text's first word
    out = []
    for first in range(0, len(words) - WINDOW + 1, _CHUNK):
        w, of = words[first : first + _CHUNK + WINDOW - 1], text[first : first + _CHUNK + WINDOW - 1]
        grams = np.zeros(len(w) - ANCHOR + 1, np.uint64)
        for i in range(ANCHOR):
            grams += w[i : len(grams) + i] * _powers[0, i]
        grams = _mixed(grams)
        inside = of[: len(w) - WINDOW + 1] == of[WINDOW - 1 :]  # windows of two texts are none
        place = np.arange(len(inside)) + np.lib.stride_tricks.sliding_window_view(grams, SPAN).argmin(axis=1)  # the first of equal ones
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | (place[1:] != place[:-1])
        start = np.flatnonzero(begin)
        n = np.bincount(np.cumsum(begin)[inside] - 1, minlength=len(start))
        size, d = n + WINDOW - 1, np.zeros(len(start), np.uint64)
        for i in range(WINDOW + SPAN - 1):
            live = start[size > i] + i
            d[size > i] += w[live] * _powers[1, i]
        out.append((grams[place[start]], _mixed(d + size.astype(np.uint64)), start + first - begins[of[start]], n, of[start]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3


def longest_matches(codes: np.ndarray) -> np.ndarray:
    """For each place the length of the longest match that begins elsewhere too, up to 63: from the neighbours in the
    order of suffixes, which is sorted by doubling."""
    n = len(codes)
    ranks = [np.unique(codes, return_inverse=True)[1].astype(np.int64)]
    for k in range(6):
        r = ranks[-1]
        after = np.zeros(n, np.int64)
        after[: max(0, n - (1 << k))] = r[1 << k :] + 1
        ranks.append(np.unique(r * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
    order = np.argsort(ranks[6], kind="stable")
    a, b = order[:-1], order[1:]
    size = np.zeros(len(a), np.int64)
    for k in range(5, -1, -1):
        fits = np.maximum(a, b) + size + (1 << k) <= n
        x, y = np.minimum(a + size, n - 1), np.minimum(b + size, n - 1)
        size += (fits & (ranks[k][x] == ranks[k][y])).astype(np.int64) << k
    best = np.zeros(n, np.int64)
    np.maximum.at(best, a, size)
    np.maximum.at(best, b, size)
    return best


def duplicate_windows(match: np.ndarray, n: int) -> np.ndarray:
    """Which of a stretch's n windows stand elsewhere: match has the longest match at each of its n + WINDOW - 1 words.

    Greedy factors; a long one is a duplicate from end to end, and windows over a factor's end are looked up.
    """
    found, i = np.zeros(n, bool), 0
    while i < n:
        size = int(min(match[i], n + WINDOW - 1 - i))
        inside = max(0, size - WINDOW + 1)
        found[i : i + inside] = True
        end = i + max(size, 1)
        found[i + inside : end] |= match[i + inside : min(end, n)] >= WINDOW
        i = end
    return found


def factored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, at, n): runs of windows of the lone stretches that stand elsewhere in their block. Rows come by anchor."""
    rows, size, last = [], 0, None

    def block() -> pa.RecordBatch:
        words = [np.frombuffer(r["words"], np.uint64) for r in rows]
        _, codes = np.unique(np.concatenate(words), return_inverse=True)
        ends = np.cumsum([len(w) for w in words])
        own = len(codes) + np.arange(len(rows))  # a code of its own ends each stretch
        match = longest_matches(np.insert(codes.astype(np.int64), ends, own))
        out = []
        for r, w, end, shift in zip(rows, words, ends, range(len(rows))):
            if r["c"] == 1:
                start = end - len(w) + shift
                edge = np.flatnonzero(np.diff(np.r_[0, duplicate_windows(match[start : start + len(w)], r["n"]).astype(int), 0]))
                out += [(r["k"], r["at"] + int(x), int(y - x)) for x, y in zip(edge[::2], edge[1::2])]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.binary(), pa.int32(), pa.int32()))], names=["k", "at", "n"])

    for b in batches:
        for r in b.to_pylist():
            if r["h"] != last and size > BLOCK_WORDS:
                yield block()
                rows, size = [], 0
            last = r["h"]
            rows.append(r)
            size += len(r["words"]) // 8
    if rows:
        yield block()


def _key(text: str) -> Column:
    return F.unhex(F.substring(F.sha2(F.col(text).cast("binary"), 256), 1, 32))


def _index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The stretches of a few hundred texts at a time, as arrays over all of them."""
    for f in frames:
        h, d, at, n, text = stretches(*hashes(f["text"].to_list()))
        yield pd.DataFrame({"k": f["k"].to_numpy()[text], "h": h.view(np.int64), "d": d.view(np.int64), "at": at, "n": n})


def _contents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of the wanted stretches, and of crowded anchors a digest of each window."""
    for f in frames:
        out = []
        for k, text, want in zip(f["k"], f["text"], f["want"]):
            w, _ = hashes([text])
            for s in want:
                at, n = s["at"], s["n"]
                if not s["crowded"]:
                    out.append((False, s["h"], k, at, n, s["c"], w[at : at + n + WINDOW - 1].tobytes()))
                    continue
                for i in range(at, at + n):
                    out.append((True, s["h"], k, i, 1, s["c"], hashlib.blake2b(w[i : i + WINDOW].tobytes(), digest_size=16).digest()))
        yield pd.DataFrame(out, columns=["crowded", "h", "k", "at", "n", "c", "words"])


def _filter(keys: DataFrame) -> tuple[DataFrame, int]:
    """A filter of keys and its bits, so that only texts that may be among them are shuffled; a full one errs in nothing."""
    bits = min(MOST_FILTER_BITS, max(1 << 16, 1 << (16 * keys.count()).bit_length()))
    words = materialize(member_filter(keys, "k", bits), "filter")
    return words, bits


def duplicate_spans(texts: DataFrame, most_kinds: int = MOST_KINDS) -> DataFrame:
    """(k, spans): per text's key the runs (at, n) of windows that stand elsewhere. texts: k, text, a row per document."""
    index = materialize(map_texts(texts, "substring", _index, "k binary, h long, d long, at int, n int"), "stretches")
    kinds = index.groupBy("h", "d").agg(F.count(F.lit(1)).alias("c"))
    shared = kinds.groupBy("h").agg(F.sum("c").alias("places"), F.count(F.lit(1)).alias("kinds")).where("places > 1")
    shared = materialize(kinds.join(shared, "h").select("h", "d", "c", "kinds"), "shared")
    bits = min(MOST_FILTER_BITS, max(1 << 16, 1 << (16 * shared.count()).bit_length()))
    anchors = materialize(member_filter(shared, "h", bits), "filter")
    places = materialize(maybe_members(index, anchors, "h", bits).join(shared, ["h", "d"]), "places")

    # one stretch of each kind where an anchor has several kinds; lone ones are what is parsed
    mixed = places.where("kinds > 1").groupBy("h", "d").agg(F.min(F.struct("k", "at", "n")).alias("r"), F.max("c").alias("c"), F.max("kinds").alias("kinds"))
    want = mixed.select("r.k", F.struct("h", "r.at", "r.n", "c", (F.col("kinds") > most_kinds).alias("crowded")).alias("s"))
    want = materialize(want.groupBy("k").agg(F.collect_list("s").alias("want")), "wanted")
    words, bits = _filter(want)
    found = maybe_members(texts, words, "k", bits).join(want, "k")
    content = map_texts(found, "substring", _contents, "crowded boolean, h long, k binary, at int, n int, c long, words binary", rows=32).distinct()
    content = materialize(content, "contents")
    blocks = content.where("not crowded").drop("crowded")
    parsed = blocks.repartition("h").sortWithinPartitions("h").mapInArrow(factored, "k binary, at int, n int")
    whole = content.where("crowded").select("words", "k", "at", "n", "c")
    twice = whole.groupBy("words").agg(F.sum("c").alias("places")).where("places > 1").select("words")
    counted = whole.where("c = 1").join(twice, "words").select("k", "at", "n")
    spans = places.where("c > 1").select("k", "at", "n").unionByName(parsed).unionByName(counted)
    return materialize(spans.groupBy("k").agg(F.collect_set(F.struct("at", "n")).alias("spans")), "spans")


def _rebuilt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for text, spans in zip(f["text"], f["spans"]):
            words = [w for part in words_of(text) for w in part]
            n, gone = len(words), 0
            if spans is not None and len(spans):
                edge = np.zeros(n + 1, np.int64)
                for s in spans:
                    edge[s["at"]] += 1
                    edge[s["at"] + s["n"] + WINDOW - 1] -= 1
                drop = np.cumsum(edge[:n]) > 0
                gone, words = int(drop.sum()), [w for w, x in zip(words, drop) if not x]
            out.append((n, gone, b" ".join(words).decode("utf-8", "surrogatepass")))
        yield pd.concat([f.drop(columns=["text", "spans"]).reset_index(drop=True), pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])], axis=1)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_kinds: int = MOST_KINDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept: one row per row of docs, without the words of windows of 35 words that also
    start anywhere else in the table, the same document included; the words that stay are joined by one space.

    Every place of a repeated window goes, the first one too. Windows are judged on the input. A null or empty text
    has no words; a text below 35 words loses none; rows that repeat a text lose all of it (from 35 words on), with
    whatever ids, null ones too. An empty table gives an empty result; other columns aren't looked at.

    most_kinds changes the cost, never the result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("k", _key("text"))
    spans = duplicate_spans(rows.select("k", "text"), most_kinds)
    words, bits = _filter(spans)
    place = F.pmod(F.xxhash64("k"), F.lit(bits).cast("long"))
    marked = rows.withColumn("_word", F.shiftright(place, 6)).join(F.broadcast(words.select(F.col("word").alias("_word"), F.col("mask").alias("_mask"))), "_word", "left")
    hit = F.coalesce(F.getbit("_mask", (place % 64).cast("int")) == 1, F.lit(False))
    changed = marked.where(hit).select("doc_id", "text", "k").join(spans, "k", "left").select("doc_id", "text", "spans")
    same = marked.where(~hit).select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept string"
    return map_texts(same, "substring", _rebuilt, schema).unionByName(map_texts(changed, "substring", _rebuilt, schema))


ORACLE = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT r, ws, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM w),
windows AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS x FROM starts),
twice AS (SELECT x FROM windows GROUP BY x HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + k AS i FROM windows JOIN twice USING (x), range(35) o(k)),
each AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (SELECT count(*) FROM gone g WHERE g.r = w.r) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""
