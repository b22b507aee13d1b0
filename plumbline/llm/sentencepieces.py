"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read field by field: pieces with scores and kinds, the trainer's model type and byte
fallback, and the normaliser. From these the same tokenizer is rebuilt: precompiled character map, white-space rules
and the metaspace marker as normaliser, then a unigram model with its scores, or a merge model whose merges are the
splits of its pieces in score order. Pieces of such models hold the marker only in front, so texts are cut there,
each different unit is encoded once (new units of a batch of rows together, on several threads), and kept. Every
task checks some probe texts against the SentencePiece library before it works.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cache_of, map_texts

MARK = "▁"
# Fixed values of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Texts on which both libraries must agree: scripts, white space, bytes beyond the vocabulary, control strings.
PROBES = ("Hello world", "", " ", "  two  spaces ", "a\nb\tc", "Grüße, señor: où êtes-vous?", "数学と物理", "🙂 emoji 👩‍👩‍👧", "<s> x </s> <0x41>", "x" * 40, "ﬁ Å ½", " nbsp　")


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields, in order; 32- and 64-bit values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = raw[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, raw[at : at + size]
            at += size


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True  # extra white space

    @staticmethod
    def parse(raw: bytes) -> PieceModel:
        m = PieceModel()
        for number, value in fields(raw):
            if number == 1:
                p = dict(fields(value))
                m.pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif number == 2:
                t = dict(fields(value))
                m.kind, m.byte_fallback = t.get(3, UNIGRAM), bool(t.get(35, 0))
                if t.get(24, 0):
                    raise ValueError("white space as a suffix is not supported")
            elif number == 3:
                n = dict(fields(value))
                m.charsmap, m.dummy_prefix, m.squeeze = n.get(2, b""), bool(n.get(3, 1)), bool(n.get(4, 1))
                if not n.get(5, 1):
                    raise ValueError("white space without its marker is not supported")
        return m

    def backend(self):
        """The tokenizers library's model alone: white space is already marked in what it gets."""
        from tokenizers import Tokenizer, models

        unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), None)
        if self.kind == UNIGRAM:
            # pieces that text never yields must not win; the library knows no kinds, so they get a score out of reach
            least = min((s for _, s, k in self.pieces if k == NORMAL), default=0.0)
            scores = [(p, s if k in (NORMAL, USER) else least - 1e4) for p, s, k in self.pieces]
            return Tokenizer(models.Unigram(scores, unk_id=unknown, byte_fallback=self.byte_fallback))
        if self.kind != BPE:
            raise ValueError(f"model type {self.kind} is neither unigram nor merges")
        vocabulary = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        usable = {p: s for p, s, k in self.pieces if k in (NORMAL, USER)}
        merges = []
        for p, s in usable.items():
            merges += [(-s, vocabulary[p[:i]], vocabulary[p[i:]], p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]
        return Tokenizer(models.BPE(vocabulary, [(a, b) for *_, a, b in sorted(merges)], unk_token=self.pieces[unknown][0] if unknown is not None else None, fuse_unk=True, byte_fallback=self.byte_fallback))


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, and back. Memory is bounded: a full cache is emptied."""

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import normalizers

        self.model = PieceModel.parse(open(path, "rb").read())
        self.path, self.most = path, most
        self.backend = self.model.backend()
        self.normal = normalizers.Precompiled(self.model.charsmap) if self.model.charsmap else None
        inner = [p for p, _, k in self.model.pieces if k in (NORMAL, USER) and MARK in p.lstrip(MARK)]
        self.unit = None if inner else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known: dict[str, bytes] = {}
        self.table = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(MARK, " ").encode() if k != UNKNOWN else " ⁇ ".encode() for p, _, k in self.model.pieces]
        self.bytes = np.array([k == BYTE for _, _, k in self.model.pieces])

    def normalise(self, text: str | None) -> str:
        """The text as the model sees it: mapped characters, white-space rules, markers for spaces."""
        t = text or ""
        if self.normal:
            t = self.normal.normalize_str(t)
        if self.model.squeeze:
            t = re.sub(" +", " ", t.strip(" "))
        if t and self.model.dummy_prefix:
            t = " " + t
        return t.replace(" ", MARK)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        split = [self.unit.findall(t) if self.unit else [t] for t in map(self.normalise, texts)]
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        new = [u for u in set().union(*split) if u not in known] if split else []
        for u, e in zip(new, self.backend.encode_batch_fast(new, add_special_tokens=False)):
            known[u] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        return [b"".join([known[u] for u in units]) for units in split]

    def decode(self, ids: np.ndarray) -> str:
        if len(ids) and ids.min() < 0:
            raise IndexError("negative id")
        raw = b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return raw[1:] if self.model.dummy_prefix and raw.startswith(" ") else raw

    def verify(self, texts: tuple[str, ...] = PROBES) -> None:
        """Raises if the SentencePiece library encodes or decodes one of the texts otherwise."""
        import sentencepiece

        other = sentencepiece.SentencePieceProcessor(model_file=self.path)
        for text, got in zip(texts, self.encode_batch(list(texts))):
            ids = np.frombuffer(got, "<u4")
            if other.encode(text) != ids.tolist():
                raise ValueError(f"ids of {text!r} differ: {ids.tolist()}, {other.encode(text)}")
            if other.decode(ids.tolist()) != self.decode(ids):
                raise ValueError(f"the text of {ids.tolist()} differs: {self.decode(ids)!r}, {other.decode(ids.tolist())!r}")


@lru_cache(maxsize=2)
def loaded(path: str) -> Encoder:
    e = Encoder(path)
    e.verify()
    return e


cache_of("sentencepieces", loaded.cache_clear)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", batch: int = 256) -> DataFrame:
    """doc_id, ids array<int>, n_fallback, round_trip: one row per row of docs.

    Whole texts are encoded; null counts as empty, and an empty text has no ids. n_fallback: how many ids are bytes.
    round_trip: decoding the ids gives the normalised text again. Repeated rows and null ids are kept, an empty
    table gives an empty result, and other columns, whatever their names, are not looked at.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, ids, rest in _encoded(batches, path or model_path(), batch):
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "ids": [i.astype(np.int32) for i in ids], **rest})

    return map_texts(_slim(docs, id_col, text_col), "sentencepieces", run, "doc_id long, ids array<int>, n_fallback long, round_trip boolean")


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _encoded(batches: Iterator[pd.DataFrame], path: str, batch: int) -> Iterator[tuple[pd.DataFrame, list[np.ndarray], dict]]:
    """Small parts of the batches with their ids, n_fallback and round_trip."""
    e = loaded(path)
    for b in batches:
        for at in range(0, len(b), batch):
            part = b.iloc[at : at + batch]
            ids = [np.frombuffer(x, "<u4") for x in e.encode_batch(part["text"].tolist())]
            yield part, ids, {"n_fallback": [int(e.bytes[i].sum()) for i in ids], "round_trip": [e.decode(i) == _plain(e, t) for i, t in zip(ids, part["text"])]}


def _plain(e: Encoder, text: str | None) -> str:
    t = e.normalise(text).replace(MARK, " ")
    return t[1:] if e.model.dummy_prefix and t else t


def decode(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: one row per row. Null ids count as none; ids outside the vocabulary raise an error."""
    path = path or model_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = loaded(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": ["" if i is None else e.decode(np.asarray(i)) for i in b["ids"]]})

    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInPandas(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", batch: int = 256) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), n_fallback, round_trip: encode's rows in short."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, ids, rest in _encoded(batches, path or model_path(), batch):
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_tokens": [len(i) for i in ids], "ids_crc32": [zlib.crc32(i) for i in ids], **rest})

    return map_texts(_slim(docs, id_col, text_col), "sentencepieces", run, "doc_id long, n_tokens long, ids_crc32 long, n_fallback long, round_trip boolean")
