"""Repair of the structure of conversations: the cheapest edits that leave an optional system turn and whole exchanges.

A row's symbol is its role's initial and its fault; an edit sequence walks through four states (nothing yet, after the
system turn, after a user turn, after an assistant turn). Equal consecutive symbols form a run, and a run is passed at
once by powers of its min-plus transition, kept by symbol and power of two. The choices inside a run are unrolled by
halving it, so that each row costs one small product.

Rows are sorted by ranges over all conversations. A conversation inside one range is repaired where it is. At most two
conversations of each range touch its edges; these, however long, are taken in pieces: transitions of the pieces are
chained (twice the number of ranges, so few numbers), and each piece is then unrolled by itself.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FAR = 1 << 60
#: States; the role that may follow each of them, the state after it, and whether a conversation may end there.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
END = np.array([0, FAR, FAR, 0])
#: A symbol is 3 * place of the initial in INITIALS (others last) + 0 sound, 1 truncated; or GONE: blank or repeated.
INITIALS, GONE = "sua", 99


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-plus product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of the ways to take a row, letters ascending; D, K and R each lead to one state."""
    if symbol == GONE:
        return [("D", DELETE, state)]
    initial, broken = (INITIALS + "?")[symbol // 3], symbol % 3
    out = [("D", DELETE, state)]
    role, after = NEXT[state]
    if initial == role[0]:
        out.append(("K", KEEP + TRUNCATED * broken, after))
    elif initial == "s" and state == START:
        out.append(("K", KEEP + TRUNCATED * broken, SYSTEM))
    return [*out, ("R", REROLE + TRUNCATED * broken, after)]


def _inserts() -> np.ndarray:
    one = np.full((4, 4), FAR)
    for s in range(4):
        one[s, s] = 0
        one[s, NEXT[s][1]] = min(one[s, NEXT[s][1]], INSERT)
    return plus(plus(one, one), plus(one, one))


INSERTS = _inserts()


@functools.cache
def power(symbol: int, k: int) -> np.ndarray:
    """The least costs between states over 2^k rows of a symbol, insertions before each of them included."""
    if k:
        return plus(power(symbol, k - 1), power(symbol, k - 1))
    row = np.full((4, 4), FAR)
    for s in range(4):
        for _, cost, after in choices(symbol, s):
            row[s, after] = min(row[s, after], cost)
    return plus(INSERTS, row)


def back(m: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Costs to go before m, from the costs to go after it."""
    return np.minimum((m + left).min(axis=1), FAR)


def runs(symbols: np.ndarray) -> list[tuple[int, int]]:
    """(symbol, length) of the runs."""
    if not len(symbols):
        return []
    at = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
    return [(int(symbols[a]), int(n)) for a, n in zip(at, np.diff(np.r_[at, len(symbols)]))]


def bits(n: int) -> list[int]:
    return [k for k in range(n.bit_length()) if n >> k & 1]


def transition(symbols: np.ndarray) -> np.ndarray:
    """The least costs between states over all rows."""
    m = np.where(np.eye(4, dtype=bool), 0, FAR)
    for symbol, n in runs(symbols):
        for k in bits(n):
            m = plus(m, power(symbol, k))
    return m


def _take(symbol: int, state: int, after: np.ndarray, out: list[str]) -> int:
    """The edits of one row and of insertions before it: of the cheapest ones that of the least letter, D, I, K or R."""
    here = back(power(symbol, 0), after)  # before the row, where insertions are still allowed
    delete, *others = choices(symbol, state)
    while delete[1] + after[state] != here[state]:
        to = NEXT[state][1]
        if INSERT + here[to] != here[state]:
            letter, _, to = next(c for c in others if c[1] + after[c[2]] == here[state])
            out.append(letter)
            return to
        out.append("I")
        state = to
        others = choices(symbol, state)[1:]
    out.append("D")
    return state


def unroll(symbols: np.ndarray, left: np.ndarray, state: int) -> tuple[str, int]:
    """The audit of the rows and the state after them; left: the costs to go after the last row.

    Of all cheapest edit sequences it is the least in ASCII order: at each step the least letter that still leads to
    the least cost. Within a run the costs to go come from the powers of its transition.
    """
    parts, ends = runs(symbols), [left]
    for symbol, n in reversed(parts):
        v = ends[-1]
        for k in bits(n):
            v = back(power(symbol, k), v)
        ends.append(v)
    ends.reverse()  # ends[i]: before run i
    out: list[str] = []
    for (symbol, n), after in zip(parts, ends[1:]):
        todo, v = [], after  # blocks of 2^k rows with the costs to go after them, the first block last
        for k in bits(n):
            todo.append((k, v))
            v = back(power(symbol, k), v)
        while todo:
            k, v = todo.pop()
            if k:
                todo += [(k - 1, v), (k - 1, back(power(symbol, k - 1), v))]
            else:
                state = _take(symbol, state, v, out)
    return "".join(out), state


def closing(state: int) -> str:
    """Insertions after the last row: the costs to go in END allow them where a conversation may not end."""
    return {SYSTEM: "II", USER: "I"}.get(state, "")


LAST = back(INSERTS, END)


@functools.lru_cache(1 << 14)
def solved(symbols: bytes) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    x = np.frombuffer(symbols, np.int8)
    audit, state = unroll(x, LAST, START)
    return int(back(transition(x), LAST)[START]), audit + closing(state)


def repaired(audit: str, roles: list[str], texts: list[str], state: int) -> Iterator[str]:
    """The lines `role:text` that the edits leave."""
    row = 0
    for letter in audit:
        role, after = NEXT[state]
        if letter == "I":
            yield f"{role}:"
            state = after
            continue
        if letter == "K":
            yield f"{roles[row]}:{texts[row]}"
            state = SYSTEM if state == START and roles[row][:1] == "s" else after
        elif letter == "R":
            yield f"{role}:{texts[row]}"
            state = after
        row += 1


# the rows and their faults


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: rows after the damage that crc32(conv_id:turn) % 20 deals. A null counts as a space,
    but for a null turn's place in the order."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn")).cast("binary")) % 20
    x = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    x = x.withColumns({"text": text, "role": F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))})
    return x.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def with_faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with `first_turn`, where a role and text that repeat stand first (has: the first
    has a turn), and `plain`: 0 sound, 1 truncated, 2 blank."""
    key = ["conv_id", "role", "text"]
    has = F.col("turn").isNotNull()
    many = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(has.alias("has"), "turn")).alias("first")).where("n > 1")
    many = many.select(*[F.col(c).alias("_" + c) for c in key], "first")
    x = rows.join(many, functools.reduce(Column.__and__, [rows[c].eqNullSafe(many["_" + c]) for c in key]), "left")
    visible = F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    plain = F.when(visible == "", 2).when(F.substring(visible, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    return x.select("conv_id", "turn", "role", "text", "first", plain.alias("plain"))


OUT = pa.schema([
    ("conv_id", pa.string()), ("null_id", pa.bool_()), ("part", pa.int32()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("symbol", pa.int32()), ("fault", pa.int32()),
    ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()),
])
LEGAL = ("su", "ua", "au")


class _Conversation:
    """Rows of one conversation, in order."""

    def __init__(self, row: dict):
        self.id, self.null, self.turns, self.roles, self.texts, self.symbols, self.faults = row["conv_id"], row["null_id"], [], [], [], [], []

    def add(self, r: dict) -> None:
        first = r["first"]
        again = first is not None and (bool(self.turns) and (self.turns[-1], self.roles[-1], self.texts[-1]) == (r["turn"], r["role"], r["text"]) or first["turn"] != r["turn"])
        fault = 2 if r["plain"] == 2 else 3 if again else r["plain"]
        initial = INITIALS.find(r["role"][:1]) if r["role"] else -1
        self.turns.append(r["turn"])
        self.roles.append(r["role"])
        self.texts.append(r["text"])
        self.faults.append(fault)
        self.symbols.append(GONE if fault > 1 else 3 * (initial if initial >= 0 else len(INITIALS)) + fault)

    def head(self) -> dict:
        return {"conv_id": self.id, "null_id": self.null}

    def whole(self) -> dict:
        turns = [t for t in self.turns if t is not None]
        cost, audit = solved(np.array(self.symbols, np.int8).tobytes())
        count = self.faults.count
        return self.head() | {
            "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": count(2), "duplicate": count(3), "truncated": count(1),
            "illegal": sum(a[:1] + b[:1] not in LEGAL for a, b in zip(self.roles, self.roles[1:])), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(repaired(audit, self.roles, self.texts, START)).encode()).hexdigest(),
        }

    def rows(self, part: int) -> Iterator[dict]:
        for i, x in enumerate(zip(self.turns, self.roles, self.texts, self.symbols, self.faults)):
            yield self.head() | {"part": part, "place": i} | dict(zip(("turn", "role", "text", "symbol", "fault"), x))


def _batch(rows: list[dict], schema: pa.Schema = OUT) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def inner(batches: Iterator[pa.RecordBatch], at_once: int = 2048) -> Iterator[pa.RecordBatch]:
    """Of a range's sorted rows: a result for each conversation but the first and the last, whose rows go on.

    The rows of one conversation at a time are held, of those that lie in the range.
    """
    part, current, first, out = TaskContext.get().partitionId(), None, True, []
    for b in batches:
        for r in b.to_pylist():
            if current is None or (current.id, current.null) != (r["conv_id"], r["null_id"]):
                if current is not None:
                    out += current.rows(part) if first else [current.whole()]
                    first = False
                current = _Conversation(r)
            current.add(r)
            if len(out) >= at_once:
                yield _batch(out)
                out = []
    if current is not None:
        out += current.rows(part)
    for at in range(0, len(out), at_once):
        yield _batch(out[at : at + at_once])


PIECE = pa.schema([(c, OUT.field(c).type) for c in ("conv_id", "null_id", "part")] + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")] + [(c, pa.string()) for c in ("first", "last")] + [("m", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
TEXTS = pa.schema([(c, OUT.field(c).type) for c in ("conv_id", "null_id", "part", "place")] + [("audit", pa.string()), ("lines", pa.string()), ("any", pa.bool_())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows that come by conversation, part and place, a part's rows of a conversation at a time."""
    key, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            k = (r["null_id"], r["conv_id"], r["part"])
            if k != key:
                if rows:
                    yield key, rows
                key, rows = k, []
            rows.append(r)
    if rows:
        yield key, rows


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A piece's counts and its transition."""
    for (null, conv, part), rows in _pieces(batches):
        count = [r["fault"] for r in rows].count
        turns, roles = [r["turn"] for r in rows if r["turn"] is not None], [r["role"][:1] for r in rows]
        m = transition(np.array([r["symbol"] for r in rows], np.int32))
        yield _batch([{
            "conv_id": conv, "null_id": null, "part": part, "blank": count(2), "duplicate": count(3), "truncated": count(1), "illegal": sum(a + b not in LEGAL for a, b in zip(roles, roles[1:])),
            "turns": len(set(turns)), "low": min(turns, default=None), "high": max(turns, default=None), "first": roles[0], "last": roles[-1], "m": m.ravel().tolist(),
        }], PIECE)


def _ends(batches: Iterator[pa.RecordBatch], left: dict) -> Iterator[pa.RecordBatch]:
    """The state after a piece, for each state before it."""
    for key, rows in _pieces(batches):
        symbols = np.array([r["symbol"] for r in rows], np.int32)
        yield _batch([dict(zip(("null_id", "conv_id", "part"), key)) | {"ends": [unroll(symbols, left[key], s)[1] for s in range(4)]}], PIECE)


def _lines(batches: Iterator[pa.RecordBatch], left: dict, start: dict, last: set) -> Iterator[pa.RecordBatch]:
    """A piece's audit and repaired lines."""
    for key, rows in _pieces(batches):
        audit, state = unroll(np.array([r["symbol"] for r in rows], np.int32), left[key], start[key])
        audit += closing(state) if key in last else ""
        lines = list(repaired(audit, [r["role"] for r in rows], [r["text"] for r in rows], start[key]))
        yield _batch([dict(zip(("null_id", "conv_id", "part"), key)) | {"audit": audit, "lines": "\n".join(lines), "any": bool(lines)}], TEXTS)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's audit and digest from its pieces, in order: one of them is held at a time."""

    def done() -> pa.RecordBatch:
        return _batch([{"conv_id": key[1], "null_id": key[0], "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}])

    key, audit, sha, some = None, [], hashlib.sha256(), False
    for b in batches:
        for r in b.to_pylist():
            k = (r["null_id"], r["conv_id"])
            if k != key:
                if key is not None:
                    yield done()
                key, audit, sha, some = k, [], hashlib.sha256(), False
            audit.append(r["audit"])
            if r["any"]:
                sha.update((b"\n" if some else b"") + r["lines"].encode())
                some = True
    if key is not None:
        yield done()


def ddl(schema: pa.Schema) -> str:
    names = {"string": "string", "bool": "boolean", "int32": "int", "int64": "long", "list<item: int64>": "array<long>", "list<element: int64>": "array<long>"}
    return ", ".join(f"{f.name} {names[str(f.type)]}" for f in schema)


def _cut(edges: DataFrame) -> DataFrame:
    """Results of the conversations whose rows lie at an edge of a range, in one piece or in several."""
    spark, columns = edges.sparkSession, ["conv_id", "null_id", "part", "place"]
    ordered = edges.select("conv_id", "null_id", "part", "place", "turn", "role", "text", "symbol", "fault").repartition("conv_id", "part").sortWithinPartitions(*columns)
    of: dict = {}
    for r in ordered.mapInArrow(summed, ddl(PIECE)).collect():  # two pieces for each range at most
        of.setdefault((r["null_id"], r["conv_id"]), []).append(r)
    left, last, results = {}, set(), []
    for (null, conv), pieces in of.items():
        pieces.sort(key=lambda r: r["part"])
        v = LAST
        for r in reversed(pieces):
            left[null, conv, r["part"]] = v
            v = back(np.array(r["m"]).reshape(4, 4), v)
        last.add((null, conv, pieces[-1]["part"]))
        known = [r for r in pieces if r["turns"]]
        shared = sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))  # a turn on both sides of an edge
        gaps = known[-1]["high"] - known[0]["low"] + 1 - sum(r["turns"] for r in known) + shared if known else 0
        joints = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(pieces, pieces[1:]))
        results.append((conv, null, int(gaps), *[int(sum(r[c] for r in pieces)) + (joints if c == "illegal" else 0) for c in ("blank", "duplicate", "truncated", "illegal")], int(v[START])))
    ends = {}
    if any(len(p) > 1 for p in of.values()):
        for r in ordered.mapInArrow(functools.partial(_ends, left=left), ddl(PIECE)).select("null_id", "conv_id", "part", "ends").collect():  # as many
            ends[r["null_id"], r["conv_id"], r["part"]] = r["ends"]
    start = {}
    for (null, conv), pieces in of.items():
        state = START
        for r in pieces:
            key = (null, conv, r["part"])
            start[key] = state
            state = ends[key][state] if ends else state
    pieces = ordered.mapInArrow(functools.partial(_lines, left=left, start=start, last=last), ddl(TEXTS))
    texts = materialize(pieces, "pieces").repartition("conv_id").sortWithinPartitions("null_id", "conv_id", "part").mapInArrow(_joined, ddl(OUT)).select("conv_id", "null_id", "audit", "repaired_sha256")
    counts = spark.createDataFrame(results, "conv_id string, null_id boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")
    return counts.join(texts, ["conv_id", "null_id"])


def repair(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation of
    rows (conv_id, turn, role, text; roles and texts without nulls).

    Rows are taken by turn, null turns first; rows that share a turn by role and text. A null conv_id is a conversation
    of its own. An empty table gives an empty result; other columns are not looked at. ranges: of the sort, those of a
    shuffle by default; the result is the same for any.
    """
    kind = rows.schema["conv_id"].dataType
    x = with_faults(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text"))
    x = x.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_id"), F.col("conv_id").isNull().alias("null_id"), "turn", "role", "text", "first", "plain")
    order = ["null_id", "conv_id", F.asc_nulls_first("turn"), "role", "text"]
    # rows of one turn that are equal share all of the order, so they are neighbours in one range
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = materialize(x.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(inner, ddl(OUT)), "repaired")
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    whole = done.where("audit is not null").select("conv_id", "null_id", *columns).unionByName(_cut(done.where("audit is null")).select("conv_id", "null_id", *columns))
    return whole.select(F.when(~F.col("null_id"), F.col("conv_id")).cast(kind).alias("conv_id"), *columns)


def repair_damaged(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """repair() of the damaged rows, with a row for every conv_id that rows has: zeros, an empty audit and the digest of
    an empty text where the damage leaves nothing."""
    found = repair(damaged(rows), ranges)
    all_of = rows.select(F.col("conv_id").alias("_id")).distinct()
    x = all_of.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    fixed = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return x.select(F.col("_id").alias("conv_id"), *[v.alias(c) for c, v in fixed.items()], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
