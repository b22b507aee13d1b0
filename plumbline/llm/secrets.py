"""Secret scans: fixed rules, and a linear-chain conditional random field that adds what the rules miss.

The rules' matches in a bounded sample of documents are the labels: their tokens are tagged as secret begin or
inside, all others as outside. The field sees a token's shape, the words around it and features of its file, and
is fitted by the gradient of the exact log-likelihood (forward-backward). Viterbi decoding of whole texts is exact:
prefix sums bound what a span that begins at a token can gain over tagging everything outside, and only around
tokens where that bound is positive is the recursion run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, bounded_texts, map_texts, materialize

KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}
_HINTS = ("passw", "secret", "token", "api")


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, index in KINDS) of the rules' matches in a whole text, by start, then kind; null counts as empty.

    The span of an assignment is its whole match, from the keyword to the end of the value. Positions are code
    points, the end is exclusive.
    """
    if not text:
        return []
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)] if _may_have_hex(text) else []
    return sorted(found, key=lambda s: (s[0], s[2]))


def _may_have_hex(text: str) -> bool:
    """Whether 32 hexadecimal digits stand together: some 32nd character and its neighbours must be among them."""
    if len(text) < 32:
        return False
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    hit = _IS_HEX[np.minimum(raw[15::16], 127)]
    if not (hit[:-1] & hit[1:]).any():
        return False
    return _HEX.search(text) is not None


_IS_HEX = np.zeros(128, bool)
_IS_HEX[list(b"0123456789abcdef")] = True

# characters: 0 white space, 1 of words and secrets (letters beyond ASCII too), 2 other
_CLASS = np.ones(129, np.int8)
_CLASS[:128] = 2
_CLASS[list(b" \t\n\r\v\f") + [0x1C, 0x1D, 0x1E, 0x1F, 0]] = 0
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = 1
# shapes: 0 lower case, 1 upper case, 2 digit, 3 other
_SHAPE = np.full(129, 3, np.int8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128] = 0, 1, 2, 0
_LOWER = np.arange(129, dtype=np.uint64)
_LOWER[65:91] += 32

NEIGHBOURS, BUCKETS, SHAPES, FILES = (-3, -2, -1, 1), 4096, 6 * 4 * 4 * 4 * 2 * 2, 16
WIDTH = SHAPES + len(NEIGHBOURS) * BUCKETS + FILES
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(of: np.uint64, name: str, n: int) -> np.ndarray:
    """of^0, of^1, ... of^(n-1) modulo 2^64."""
    if len(_powers.get(name, ())) < n:
        a = np.full(max(n, 1 << 20), of, np.uint64)
        a[0] = 1
        _powers[name] = np.cumprod(a)
    return _powers[name][:n]


@dataclass
class Tokens:
    """Tokens of some texts laid end to end; a separator token stands before the first and after each text."""

    start: np.ndarray  # in its own text
    end: np.ndarray
    doc: np.ndarray  # -1: separator
    features: np.ndarray  # one row per token: column numbers of the features it has


def _bucket(x: np.ndarray, edges: list[float]) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, side="right")


def tokens(texts: list[str]) -> Tokens:
    """Maximal runs of word characters and of other ones, and their features, by array work over all texts at once."""
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in parts])
    c = np.full(int(sizes.sum()) + len(texts) + 1, 32, np.uint32)
    base = 1 + np.cumsum(np.append(0, sizes[:-1] + 1))
    for at, p in zip(base, parts):
        c[at : at + len(p)] = p
    c = np.minimum(c, 128)
    k = _CLASS[c]
    edge = np.flatnonzero(np.diff(k))
    first = edge[k[edge + 1] > 0] + 1
    last = edge[k[edge] > 0] + 1
    shape = _SHAPE[c]
    new = np.empty(len(c), np.int32)
    new[0], new[1:] = 0, shape[1:] != shape[:-1]

    def within(indicator: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0], np.cumsum(indicator, dtype=np.int32)])
        return s[last] - s[first]

    size = last - first
    digits, upper, other = within(shape == 2), within(shape == 1), within(shape == 3)
    turns = within(new)
    powers = _power(_P, "up", len(c))
    s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LOWER[c] * powers, dtype=np.uint64)])
    word = (s[last] - s[first]) * _power(_P_INVERSE, "down", len(c))[first]
    word = ((word ^ (word >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(52)).astype(np.int64)

    cell = _bucket(size, [4, 8, 12, 16, 24])
    cell = cell * 4 + _bucket(digits / size, [0.01, 0.2, 0.5])
    cell = cell * 4 + _bucket(upper / size, [0.01, 0.2, 0.6])
    cell = cell * 4 + _bucket(turns / size, [0.13, 0.26, 0.45])
    cell = cell * 2 + (other > 0)
    cell = cell * 2 + (k[first] == 2)
    doc = np.searchsorted(base, first, side="right") - 1

    # file features: how long the file is, and how much of it is digits
    n = len(texts)
    per = np.bincount(doc, minlength=n)
    file = _bucket(per, [50, 400, 3000]) * 4 + _bucket(np.bincount(doc, weights=digits, minlength=n) / np.maximum(1, np.bincount(doc, weights=size, minlength=n)), [0.002, 0.02, 0.2])

    # separators before, between and after the texts
    at = np.concatenate([[0], np.cumsum(per) + np.arange(1, n + 1)])
    place = np.arange(len(first)) + doc + 1
    total = len(first) + n + 1
    out_doc, out_start, out_end = np.full(total, -1), np.zeros(total, np.int64), np.zeros(total, np.int64)
    out_doc[place], out_start[place], out_end[place] = doc, first - base[doc], last - base[doc]
    words = np.zeros(total, np.int64)
    words[place] = word
    features = np.zeros((total, len(NEIGHBOURS) + 2), np.int32)
    features[place, 0] = cell
    for i, shift in enumerate(NEIGHBOURS):
        near = np.zeros(total, np.int64)
        if shift < 0:
            near[-shift:] = words[:shift]
        else:
            near[:-shift] = words[shift:]
        features[:, i + 1] = SHAPES + i * BUCKETS + near
    features[place, -1] = SHAPES + len(NEIGHBOURS) * BUCKETS + file[doc]
    assert (out_doc[at] == -1).all()
    return Tokens(out_start, out_end, out_doc, features)


def tags(t: Tokens, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """0 outside, 1 begin, 2 inside: the word tokens of the secrets, which end a span of the rules."""
    y = np.zeros(len(t.doc), np.int64)
    firsts = np.flatnonzero(t.doc < 0)
    for d, found in enumerate(spans):
        a, b = firsts[d] + 1, firsts[d + 1]
        for start, end, kind in found:
            i = a + np.searchsorted(t.end[a:b], start, side="right")
            hit = []
            while i < b and t.start[i] < end:
                hit.append(i)
                i += 1
            if kind == 0:  # only the value, which is the last token of the match
                hit = hit[-1:]
            if hit and not y[hit].any():
                y[hit] = 2
                y[hit[0]] = 1
    return y


#: Outside to inside never happens.
_NEVER = -1e4


@dataclass
class SecretModel:
    weights: np.ndarray = field(default_factory=lambda: np.zeros((WIDTH, 3)))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))  # from, to

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = self.weights[features[:, 0]].copy()
        for i in range(1, features.shape[1]):
            out += self.weights[features[:, i]]
        return out

    def decode(self, t: Tokens) -> list[tuple[int, int]]:
        """(first token, last token) of each secret on the best path."""
        e = self.emissions(t.features)
        apart = t.doc < 0
        e[apart] = [0, _NEVER, _NEVER]
        m = self.moves
        stay = m[0, 0]
        begin = e[:, 1] - e[:, 0] - stay + max(m[0, 1], m[1, 1], m[2, 1])
        inside = e[:, 2] - e[:, 0] - stay + max(m[1, 2], m[2, 2])
        gain = np.cumsum(inside)
        best = np.maximum.accumulate(gain[::-1])[::-1]
        leave = max(m[1, 0], m[2, 0], m[1, 1], m[2, 1]) - stay
        hopeful = np.flatnonzero(begin + (best - gain) + max(0.0, leave) > 0)
        found: list[tuple[int, int]] = []
        done = -1
        for i in hopeful:
            if i <= done:
                continue
            # the window goes on while a span that goes on can still win
            j, total = i, float(begin[i])
            while j + 1 < len(e) and not apart[j + 1] and (total + best[j] - gain[j] + max(0.0, leave) > 0 or begin[j + 1] + best[j + 1] - gain[j + 1] + max(0.0, leave) > 0):
                j += 1
                total = max(total + inside[j], begin[j])
            done = j
            found += [(a + i, b + i) for a, b in self._viterbi(e[i : j + 1])]
        return found

    def _viterbi(self, e: np.ndarray) -> list[tuple[int, int]]:
        m = self.moves.copy()
        m[0, 2] = _NEVER
        v, back = m[0] + e[0], []
        for x in e[1:]:
            s = v[:, None] + m
            back.append(s.argmax(0))
            v = s.max(0) + x
        y = [int((v + m[:, 0]).argmax())]
        for b in reversed(back):
            y.append(int(b[y[-1]]))
        y.reverse()
        spans: list[list[int]] = []
        for i, tag in enumerate(y):
            if tag == 1 or tag == 2 and not spans:
                spans.append([i, i])
            elif tag == 2:
                spans[-1][1] = i
        return [(a, b) for a, b in spans]


def posteriors(e: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows with scores e (window, token, tag) and moves m: each tag's probabilities, and the expected moves."""
    a, b = np.empty_like(e), np.zeros_like(e)
    a[:, 0] = e[:, 0]
    for t in range(1, e.shape[1]):
        a[:, t] = _logsum(a[:, t - 1, :, None] + m, 1) + e[:, t]
    for t in range(e.shape[1] - 2, -1, -1):
        b[:, t] = _logsum(m + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
    z = _logsum(a[:, -1], 1)[:, None, None]
    return np.exp(a + b - z), np.exp(a[:, :-1, :, None] + m + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[..., None]).sum((0, 1))


def _fit_field(features: np.ndarray, y: np.ndarray, beyond: np.ndarray, rounds: int, penalty: float) -> SecretModel:
    """Maximum likelihood, with a quadratic penalty, of windows (features: window, token, feature; y: window, token).

    beyond: places after the end of a text; as in decoding, these are outside whatever their features.
    """
    n, length, k = features.shape
    flat = features.reshape(-1, k)
    used, packed = np.unique(flat, return_inverse=True)
    packed = packed.reshape(flat.shape)
    w, m = np.zeros((len(used), 3)), np.zeros((3, 3))
    m[0, 2] = _NEVER
    onehot = np.eye(3)[y]
    seen_moves = np.zeros((3, 3))
    np.add.at(seen_moves, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    gsq_w, gsq_m = np.full_like(w, 1e-8), np.full((3, 3), 1e-8)
    for _ in range(rounds):
        e = w[packed].sum(1).reshape(n, length, 3)
        e[:, 0, 2] += _NEVER  # nothing begins inside
        e[beyond] = [0, _NEVER, _NEVER]
        p, pairs = posteriors(e, m)
        g = np.where(beyond[..., None], 0.0, p - onehot).reshape(-1, 3)
        gw = np.stack([np.bincount(packed.ravel(), weights=np.repeat(g[:, c], k), minlength=len(used)) for c in range(3)], 1) + penalty * w
        gm = pairs - seen_moves + penalty * m * (m > _NEVER)
        gm[0, 2] = 0
        gsq_w += gw * gw
        gsq_m += gm * gm
        w -= 0.5 * gw / np.sqrt(gsq_w)
        m -= 0.5 * gm / np.sqrt(gsq_m)
    model = SecretModel()
    model.weights[used] = w
    model.moves = m
    return model


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def fit(texts: list[str], spans: list[list[tuple[int, int, int]]], window: int = 48, rounds: int = 60, penalty: float = 0.05, most: int = 3_000, seed: int = 9) -> SecretModel:
    """Fit to windows of the texts, short texts and ends of texts included: `most` of them, evenly chosen, at most.

    Those that hold a secret come first, and as many others as there is room for.
    """
    feats, ys, ends = [], [], []
    for d, found in zip(texts, spans):
        t = tokens([d])
        y = tags(t, [found])
        for at in range(0, len(y), window):
            f, tag = t.features[at : at + window], y[at : at + window]
            ends.append(len(f))
            feats.append(np.pad(f, ((0, window - len(f)), (0, 0)), mode="edge"))
            ys.append(np.pad(tag, (0, window - len(tag))))
    if not feats or not any(t.any() for t in ys):
        return SecretModel(moves=np.array([[0, _NEVER, _NEVER]] + [[0.0, 0.0, 0.0]] * 2))
    hit = [i for i, t in enumerate(ys) if t.any()]
    hit = hit[:: -(-len(hit) // most)]
    rest = [i for i, t in enumerate(ys) if not t.any()]
    rest = rest[:: -(-len(rest) // (most - len(hit)))] if rest and most > len(hit) else []
    keep = sorted(hit + rest)
    y = np.stack([ys[i] for i in keep])
    y[:, 0] = np.where(y[:, 0] == 2, 1, y[:, 0])
    x = np.stack([feats[i] for i in keep])
    beyond = np.arange(window) >= np.array([ends[i] for i in keep])[:, None]
    # half of the windows lose their neighbouring words, so that a telling shape can be enough
    blind = np.random.default_rng(seed).random(len(x)) < 0.5
    for i in range(len(NEIGHBOURS)):
        x[blind, :, i + 1] = SHAPES + i * BUCKETS
    return _fit_field(x, y, beyond, rounds, penalty)


def _chunks(texts: list[str], chars: int = 1_000_000) -> Iterator[range]:
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > chars:
            yield range(at, i)
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield range(at, len(texts))


def added_spans(model: SecretModel, texts: list[str], bases: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """For each text, its base spans and those of the field that overlap none of them, by start, then kind."""
    out = []
    for some in _chunks(texts):
        t = tokens([texts[i] for i in some])
        found = [list(bases[i]) for i in some]
        for a, b in model.decode(t):
            d = t.doc[a]
            s, e = int(t.start[a]), int(t.end[b])
            if all(e <= x or s >= y for x, y, _ in bases[some[0] + d]):
                found[d].append((s, e, 3))
        out += [sorted(f, key=lambda s: (s[0], s[2])) for f in found]
    return out


_SPANS = "array<struct<start:int,end:int,kind:int>>"


def find_secrets(docs: DataFrame, fit_rows: int = 1_500, fit_chars: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a column spans, array<struct<start, end, kind>>: the secrets of each whole text (kind: index in KINDS).

    A null text counts as empty and has no spans. All rows and columns of docs are kept (a column named spans is
    replaced); repeated rows get the same spans; an empty table gives an empty result. The field learns from about
    fit_rows documents with and fit_rows without a match of the rules at most (bounded samples, by the hash of
    their id), of at most fit_chars characters each, and from 3,000 windows of their tokens at most; without any
    match it adds nothing.
    """

    def rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "hit": [bool(base_spans(x)) for x in b["text"]]})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = materialize(map_texts(rows, "secrets", rules, f"doc_id {docs.schema[id_col].dataType.simpleString()}, hit boolean"), "marked")
    ids = [bounded_sample(marked.where(c).select("doc_id").distinct(), "doc_id", fit_rows) for c in (F.col("hit"), ~F.col("hit"))]
    # two bounded samples: small enough to broadcast, and their texts to gather
    known = bounded_texts(rows.join(F.broadcast(ids[0].unionByName(ids[1]).distinct()), "doc_id", "left_semi"), "doc_id", "text", 2 * fit_rows, fit_chars)
    known = known.toPandas().sort_values("doc_id", kind="stable")
    texts = known["text"].fillna("").tolist()
    shared = docs.sparkSession.sparkContext.broadcast(fit(texts, [base_spans(x) for x in texts]))
    names = [f.name for f in docs.schema if f.name != "spans"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = b[text_col].fillna("").tolist()
            spans = added_spans(shared.value, found, [base_spans(x) for x in found])
            yield b.assign(spans=[[dict(zip(("start", "end", "kind"), s)) for s in x] for x in spans])

    slim = docs.select(*[F.col(f"`{n}`") for n in names])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema)
    return map_texts(slim, "secrets", run, f"{schema}, spans {_SPANS}")


def _joined(spans, kinds):
    return F.array_join(F.transform(F.filter(spans, kinds), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (as text) from find_secrets' rows."""
    s = F.col("spans")
    of = lambda i: F.filter(s, lambda x: x["kind"] == i)
    counts = [F.size(of(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return found.select(
        F.col(id_col).alias("doc_id"), *counts,
        F.sha2(_joined(s, lambda x: x["kind"] < 3).cast("binary"), 256).alias("base_sha256"), _joined(s, lambda x: x["kind"] >= 0).alias("spans"),
    )


def redact(found: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """find_secrets' rows without spans, each secret in the text replaced by mask; overlapping spans become one."""
    text, s = F.col(text_col), F.col("spans")
    state = "struct(cast(0 as int) as at, cast('' as string) as done)"
    folded = F.aggregate(
        s, F.expr(state),
        lambda a, x: F.when(x["end"] <= a["at"], a).otherwise(F.struct(
            x["end"].alias("at"),
            F.when(x["start"] < a["at"], a["done"]).otherwise(F.concat(a["done"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mask))).alias("done"),
        )),
    )
    masked = F.when(F.size(s) > 0, F.concat(folded["done"], F.substring(text, folded["at"] + 1, F.length(text)))).otherwise(text)
    return found.withColumn(text_col, masked).drop("spans")
