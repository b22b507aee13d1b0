"""Substring dedup, conversation repair and source divergence against brute force, and odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from plumbline.llm import conversations, divergence, substring_dedup

from .test_llm import ODD, docs

SPACE = r"[^\x20\x09-\x0D]+"


# substrings


def plain_substrings(texts):
    """(words, kept words) of each text, from all windows."""
    words = [re.findall(SPACE, t or "") for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(35)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def some_texts(seed, n=60):
    """Texts that share passages of 30 to 90 words, with changed words, periods and copies."""
    rng = random.Random(seed)
    fresh = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    shared, short = [fresh(rng.randint(30, 90)) for _ in range(6)], ["a", "b", "c"]
    out = []
    for _ in range(n):
        w = []
        for _ in range(rng.randint(1, 5)):
            p = list(rng.choice(shared))[rng.randint(0, 5) :]
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "changed"
            w += rng.choice([fresh(rng.randint(0, 50)), p, p, short * rng.randint(1, 30), ["same"] * rng.randint(20, 60)])
        out.append(rng.choice([" ", "\n", "\t\x0b "]).join(w))
    return out + out[:3] + ["été un " * 40, "", None]


@pytest.mark.parametrize("most_kinds", [1024, 2])
def test_substrings_match_all_windows(spark, most_kinds):
    """Whole windows of crowded anchors give the same result as parsing."""
    texts = some_texts(5)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.dedup_substrings(frame, most_kinds=most_kinds).collect()}
    assert [got[i] for i in range(len(texts))] == plain_substrings(texts)
    assert sum(x[1] > 0 for x in got.values()) > 20


def test_substrings_of_odd_rows(spark):
    rows = ODD + [(6, ODD[5][1])]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.dedup_substrings(docs(spark, rows)).collect())
    want = sorted((str(i), *x) for (i, _), x in zip(rows, plain_substrings([t for _, t in rows])))
    assert got == want
    assert substring_dedup.dedup_substrings(docs(spark, [])).count() == 0


def test_a_long_text_is_cut_and_hot_passages_are_found(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_CHUNK", 64)
    monkeypatch.setattr(substring_dedup, "_PART", 100)
    w, _ = substring_dedup.hashes([" ".join(f"w{i}" for i in range(500))])
    _, _, at, n, _ = substring_dedup.stretches(w)
    assert at[0] == 0 and (at[1:] == (at + n)[:-1]).all() and at[-1] + n[-1] == 500 - 34
    parts = np.array_split(w, [3, 40, 41, 300])  # several texts at once are the same as each alone
    together = list(zip(*substring_dedup.stretches(w, np.repeat(np.arange(5), [len(x) for x in parts]))))
    monkeypatch.undo()
    assert sorted(x[:1] + x[2:] for x in together if x[4] == 4) and [x[3] for x in together].count(0) == 0
    for i, x in enumerate(parts):
        windows = sorted(k for r in together if r[4] == i for k in range(r[2], r[2] + r[3]))
        assert windows == list(range(max(0, len(x) - 34)))
    alone = {(r[0], r[1], r[2], r[3]) for r in zip(*substring_dedup.stretches(parts[4]))}
    whole = {(r[0], r[1], r[2], r[3]) for r in zip(*substring_dedup.stretches(w, np.repeat(np.arange(5), [len(x) for x in parts]))) if r[4] == 4}
    assert alone == whole
    passage = " ".join(f"p{i}" for i in range(50))
    texts = [f"head{i} {passage} tail{i}" for i in range(300)]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r["n_removed"], r["kept"]) for r in got} == {(50, f"head{i} tail{i}") for i in range(300)}


def test_hashes_of_words(monkeypatch):
    """Equal words have equal hashes wherever they stand, different ones different hashes, in parts of any size."""
    texts = ["ab ba  ab\tabab", None, "", "\n", "é ab x" + "y" * 300 + " ab", " ba", "\u2003 \u00a0"]
    words = [w for t in texts for w in (t or "").encode().split()]
    for part in (1, 7, 1 << 20):
        monkeypatch.setattr(substring_dedup, "_PART", part)
        h, of = substring_dedup.hashes(texts)
        assert len(h) == len(words) and of.tolist() == [i for i, t in enumerate(texts) for _ in (t or "").encode().split()]
        assert len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))
    assert len(substring_dedup.hashes([])[0]) == 0


def test_longest_matches_and_factors():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 3, 200)
    match = substring_dedup.longest_matches(codes)
    for i in range(200):
        best = 0
        for j in range(200):
            k = 0
            while i != j and k < 63 and max(i, j) + k < 200 and codes[i + k] == codes[j + k]:
                k += 1
            best = max(best, k)
        assert match[i] == best


# conversations


def plain_repair(symbols):
    """The least (cost, audit) of all edits, by carrying the best of each state from row to row."""
    best = {conversations.START: (0, "")}

    def inserted(b):
        for _ in range(3):
            for s, (c, a) in list(b.items()):
                to, new = conversations.NEXT[s][1], (c + 3, a + "I")
                if to not in b or new < b[to]:
                    b[to] = new
        return b

    for x in symbols:
        new = {}
        for s, (c, a) in inserted(best).items():
            for letter, cost, to in conversations.choices(int(x), s):
                if to not in new or (c + cost, a + letter) < new[to]:
                    new[to] = (c + cost, a + letter)
        best = new
    best = inserted(best)
    return min(best[s] for s in (conversations.START, conversations.ASSISTANT) if s in best)


SYMBOLS = [0, 1, 3, 4, 6, 7, 9, 10, conversations.GONE]


def all_edits(symbols):
    """Every way to edit a few rows, with up to two insertions at each place: the least (cost, audit) that is legal."""
    best, initial = None, {0: "s", 1: "u", 2: "a", 3: "?"}
    for letters in itertools.product(*[("D",) if x == conversations.GONE else ("D", "K", "Ru", "Ra") for x in symbols]):
        for gaps in itertools.product(("", "u", "a", "ua", "au"), repeat=len(symbols) + 1):
            roles, audit, cost = gaps[0], "I" * len(gaps[0]), 3 * sum(map(len, gaps))
            for x, letter, gap in zip(symbols, letters, gaps[1:]):
                cost += {"D": 4, "K": 0, "R": 3}[letter[0]] + (3 * (x % 3) if letter != "D" else 0)
                roles += {"D": "", "K": initial[x // 3] if x != conversations.GONE else ""}.get(letter, letter[1:]) + gap
                audit += letter[0] + "I" * len(gap)
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def test_cheapest_edits_by_enumeration():
    for n in range(3):
        for x in itertools.product(SYMBOLS, repeat=n):
            assert conversations.solved(np.array(x, np.int8).tobytes()) == all_edits(x), x


def test_runs_equal_rows_one_by_one():
    rng = random.Random(7)
    for _ in range(400):
        x = sum(([rng.choice(SYMBOLS)] * rng.randint(1, 40) for _ in range(rng.randint(0, 8))), [])
        assert conversations.solved(np.array(x, np.int8).tobytes()) == plain_repair(x)


def plain_conversations(rows):
    """The whole contract, conversation by conversation."""
    text_of = lambda v: " " if v is None else str(v)
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in [r for r in rows if r[0] == conv]:
            role, text = text_of(role), text_of(text)
            kind = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in kept:
            visible = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
            seen.add((role, text))
        symbols = [conversations.GONE if f in ("blank", "duplicate") else 3 * ("sua" + r[1][:1]).index(r[1][:1] or "s") * (r[1] != "") + 9 * (r[1] == "") + (f == "truncated") for f, r in zip(faults, kept)]
        cost, audit = plain_repair(symbols)
        lines, state, i = [], conversations.START, 0
        for letter in audit:
            role, after = conversations.NEXT[state]
            if letter == "I":
                lines.append(role + ":")
            elif letter == "R":
                lines.append(f"{role}:{kept[i][2]}")
            elif letter == "K":
                lines.append(f"{kept[i][1]}:{kept[i][2]}")
                after = conversations.SYSTEM if kept[i][1][0] == "s" and state == conversations.START else after
            i += letter != "I"
            state = state if letter == "D" else after
        turns = [r[0] for r in kept if r[0] is not None]
        initials = [r[1][:1] for r in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


CONV = "conv_id long, turn long, role string, text string, fault string, n long"
NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check_conversations(spark, rows, ranges):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], CONV).repartition(3)
    got = {r["conv_id"]: tuple(r[c] for c in NAMES) for r in conversations.repair_damaged(frame, ranges).collect()}
    assert got == plain_conversations(rows)


@pytest.mark.parametrize("ranges", [1, 13])
def test_conversations_match_a_plain_repair(spark, ranges):
    rng = random.Random(11)
    rows = []
    for conv in [*range(40), None]:
        n = rng.randint(1, 12) if conv != 3 else 900  # one holds most rows
        for t in range(n):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            text = rng.choice(["One. ", "Two!", "three", "", " \n", "Why?\n", None, f"own {rng.randrange(99)}."])
            rows.append((conv, rng.choice([t, t, t, t + 3, None]), role, text))
    rows += rows[:5]
    check_conversations(spark, rows, ranges)


def test_conversations_that_are_empty_or_vanish(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    check_conversations(spark, [(gone, 0, "user", "Hello."), (gone + 1, None, None, None)], 2)
    assert conversations.repair_damaged(spark.createDataFrame([], CONV)).count() == 0
    rows = [(1, t, "user", "w " * 200_000 + "end.") for t in range(3)]  # long texts
    check_conversations(spark, rows, 2)


# divergence


def plain_divergence(rows, top=200):
    """(lang, source, part, item) to (value, rank), in whole numbers throughout."""
    rows = [(a or "", b or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))) for a, b, t in rows]
    out = {}
    for lang in {r[0] for r in rows}:
        held, all_of, groups = Counter(), Counter(), {}
        for _, source, c in (r for r in rows if r[0] == lang):
            held.update(list(c))
            all_of.update(c)
            groups.setdefault(source, Counter()).update(c)
        kept = [t for t in held if held[t] >= 3]
        price = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p, q = {s: price(c) for s, c in groups.items()}, price(all_of)
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pair = {o: sum(f(p[s][t], p[o][t]) for t in kept) for o in groups if o != s}
            term = {t: f(p[s][t], q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]}
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                for rank, (item, value) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out[lang, s, part, item] = value, rank
    return out


@pytest.mark.parametrize("blocks", [(2048, 256), (5, 2)])
def test_divergence_matches_whole_numbers(spark, monkeypatch, blocks):
    """Small blocks of terms and sources give the same sums."""
    for name, value in zip(("BLOCK_TERMS", "BLOCK_SOURCES"), blocks):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(2)
    vocabulary = ["Word", "word", "été", "Ünder", "x1y", "日本", "a_b", "it's", *[f"t{chr(97 + i)}" for i in range(20)]]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "é", "", None, "s4"]), " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for _ in range(80)]
    rows += [("xx", "one", "alone"), ("xx", "two", None), ("xx", None, ""), ("yy", "only", "w " * 300_000)] + rows[:4]
    frame = spark.createDataFrame([(*r, "v", 1) for r in rows], "lang string, source string, text string, term string, n int").repartition(3)
    got = {(r["lang"], r["source"], r["part"], r["item"]): (r["value"], r["rank"]) for r in divergence.source_divergence(frame, top=7).collect()}
    assert got == plain_divergence(rows, 7)


def test_divergence_of_an_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


@pytest.mark.parametrize("tile", [1, 3, 50, 1024])
def test_products_by_tiles_price_every_pair_of_levels(monkeypatch, tile):
    monkeypatch.setattr(divergence, "TILE", tile)
    rng = np.random.default_rng(4)
    none, p = rng.integers(1, 9, 6), rng.integers(1, 60, (40, 6))
    p = np.where(rng.random((40, 6)) < 0.5, none, p)
    data = pd.DataFrame([(f"t{t}", s, p[t, s]) for t in range(40) for s in range(6) if p[t, s] != none[s]], columns=["term", "at", "p"])
    heads = pd.DataFrame({"lang": "x", "place": range(6), "none": none, "own": [0] * 3 + [1] * 3, "first": 0, "second": 1, "n_terms": 45})
    p = np.concatenate([p, np.tile(none, (5, 1))])  # five terms that none of these sources has
    got = {(r.a, r.b): r.value for r in divergence.products(data, heads).itertuples()}
    assert got == {(a, b): int(((p[:, a] - p[:, b]) ** 2 // p[:, b]).sum()) for a in range(6) for b in range(6) if (a < 3) != (b < 3)}
