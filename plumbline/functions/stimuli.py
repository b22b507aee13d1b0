"""Controlled variants of answers, as Columns: style and dose ladders, meaning-preserving edits, affixes, transcripts."""

from __future__ import annotations

import unicodedata
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import strip, word_count

# What the transforms insert.
FILLER = [
    "This is a question that comes up from time to time.",
    "The details can be looked at in more depth if needed.",
    "There is a reasonable amount that could be said on the subject.",
    "It is the kind of thing that is worth understanding properly.",
    "Different sources present this in somewhat different ways.",
    "The point above is the part that usually matters most.",
]
FLATTERY = [
    "Great question!",
    "What a fantastic and insightful question, I really enjoy this topic!",
    "What a fantastic and insightful question! You are clearly thinking about this carefully, and it is a pleasure to help someone so engaged!",
]
SELF_PRAISE = [
    "This is a thorough and accurate explanation.",
    "This is a thorough, accurate and well-sourced explanation that covers everything you need.",
    "This is a thorough, accurate and well-sourced explanation that covers everything you need, and it reflects the current expert consensus on the matter.",
]
BUZZWORDS = ["fundamentally", "at a high level", "in essence", "critically", "it is worth noting that", "importantly", "in practice", "broadly speaking"]
HEDGES = ["I think", "It seems that", "As far as I know", "If I recall correctly", "I believe", "It may be that"]
CONFIDENT = ["Definitely", "Without question", "Certainly", "Absolutely", "Undoubtedly", "Beyond any doubt"]
EMOJI = ["\U0001f600", "\U0001f389", "\U0001f44d", "✨", "\U0001f680", "\U0001f4a1", "\U0001f31f", "\U0001f525"]
#: Transform, its doses and its group.
DOSES = {
    "padding": ([1, 2, 3, 4], "content_neutral"),
    "emoji": ([1, 2, 4, 8], "content_neutral"),
    "flattery": ([1, 2, 3], "content_neutral"),
    "punctuation": ([1, 2, 3], "content_neutral"),
    "buzzwords": ([2, 4, 8], "content_neutral"),
    "self_praise": ([1, 2, 3], "content_neutral"),
    "elaboration": ([1, 2], "quality_bearing"),
    "bullets": ([1, 2], "quality_bearing"),
    "headers": ([1, 2], "quality_bearing"),
    "hedging": ([1, 2, 3], "quality_bearing"),
    "confident": ([1, 2, 3], "quality_bearing"),
}


def _lower_first(x: Column) -> Column:
    c = F.substring(x, 1, 1)  # lower() of every script is slow, and most letters are of A-Z
    return F.concat(F.when(F.ascii(c) < 128, F.translate(c, ascii_uppercase, ascii_lowercase)).otherwise(F.lower(c)), F.substring(x, 2, 2_000_000_000))


def _opening(s: Column, most: int, change) -> Column:
    """The sentences as one text, the first `most` of them changed; only these are looked at one by one."""
    return F.array_join(F.concat(change(F.slice(s, 1, most)), F.slice(s, most + 1, 2_000_000_000)), " ")


def padding(a: Column, dose: int) -> Column:
    return F.concat(a, F.lit(" " + " ".join(FILLER[:dose])))


def elaboration(a: Column, extra: Column, dose: int) -> Column:
    return F.concat(a, F.lit(" "), F.array_join(F.slice(extra, 1, dose), " "))


def flattery(a: Column, dose: int) -> Column:
    return F.concat(F.lit(FLATTERY[dose - 1] + " "), a)


def self_praise(a: Column, dose: int) -> Column:
    return F.concat(a, F.lit(" " + SELF_PRAISE[dose - 1]))


def emoji(s: Column, dose: int) -> Column:
    """The i-th emoji goes behind sentence i modulo their number."""
    turns = F.sequence(F.lit(0), F.lit(dose - 1))
    marks = F.array(*[F.lit(e) for e in EMOJI])
    added = lambda j: F.array_join(F.transform(F.filter(turns, lambda i: i % F.size(s) == j), lambda i: F.concat(F.lit(" "), F.get(marks, i % len(EMOJI)))), "")
    # most texts have a sentence for each turn
    alone = F.array(*[F.lit(" " + EMOJI[i % len(EMOJI)]) for i in range(dose)])
    return _opening(s, dose, lambda first: F.transform(first, lambda x, j: F.concat(x, F.when(F.size(s) >= dose, F.get(alone, j)).otherwise(added(j)))))


def punctuation(s: Column, dose: int) -> Column:
    return _opening(s, dose, lambda first: F.transform(first, lambda x: F.regexp_replace(x, r"\.$", "!" * min(dose, 3))))


def buzzwords(s: Column, dose: int) -> Column:
    """Each turn puts a word in front of sentence i modulo their number; later turns stand before earlier ones."""
    def turn(i: int, head: str):
        return lambda x, j: F.when(j == F.lit(i) % F.size(s), F.concat(F.lit(head), _lower_first(x))).otherwise(x)

    heads = [w[0].upper() + w[1:] + ", " for w in (BUZZWORDS * dose)[:dose]]

    def turns(first: Column) -> Column:
        out = first
        for i, head in enumerate(heads):
            out = F.transform(out, turn(i, head))
        alone = F.array(*map(F.lit, heads))  # most texts have a sentence for each turn
        return F.when(F.size(s) >= dose, F.transform(first, lambda x, j: F.concat(F.get(alone, j), _lower_first(x)))).otherwise(out)

    return _opening(s, dose, turns)


def _opened(s: Column, dose: int, phrases: list[str], sep: str) -> Column:
    heads = F.array(*[F.lit(p + sep) for p in phrases])
    return _opening(s, dose, lambda first: F.transform(first, lambda x, i: F.concat(F.get(heads, i % len(phrases)), _lower_first(x))))


def hedging(s: Column, dose: int) -> Column:
    return _opened(s, dose, HEDGES, " ")


def confident(s: Column, dose: int) -> Column:
    return _opened(s, dose, CONFIDENT, ", ")


def bullets(s: Column, dose: int) -> Column:
    if dose == 1:
        rest = F.when(F.size(s) > 1, F.concat(F.lit("- "), F.array_join(F.slice(s, 2, 1_000_000), "\n- "))).otherwise("")
        return F.when(F.size(s) > 0, F.concat(F.get(s, F.lit(0)), F.lit("\n"), rest)).otherwise("")
    return F.when(F.size(s) > 0, F.concat(F.lit("- "), F.array_join(s, "\n- "))).otherwise("")


def headers(s: Column, dose: int) -> Column:
    if dose == 1:
        return F.concat(F.lit("## Answer\n"), F.array_join(s, " "))
    mid = F.greatest(F.lit(1), F.floor(F.size(s) / 2).cast("int"))
    return F.concat(F.lit("## Answer\n"), F.array_join(F.slice(s, F.lit(1), mid), " "), F.lit("\n\n### Further detail\n"), F.array_join(F.slice(s, mid + 1, F.lit(1_000_000)), " "))


WHOLE = ("padding", "flattery", "self_praise")


def variant(transform: str, dose: int, answer: Column, s: Column, extra: Column | None = None) -> Column:
    """The answer under a transform at a dose; s and extra are the sentences of the answer and of its elaboration.

    Give both as columns that are there already, for they are used many times. Texts without sentences give what
    the transform adds, or nothing.
    """
    if transform == "elaboration":
        return elaboration(answer, extra, dose)
    return globals()[transform](answer if transform in WHOLE else s, dose)


def _words(x: str) -> int:
    return len(x.split())


def variant_words(transform: str, dose: int, n: Column, s: Column, extra: Column | None = None) -> Column:
    """word_count of variant, from n and s, the word count and the sentences of the answer: a variant keeps the answer's
    words and adds its own, so the long text needs no second look."""
    m = F.size(s)
    if transform == "elaboration":
        return n + word_count(F.array_join(F.slice(extra, 1, dose), " "))
    if transform == "emoji":
        return n + F.when(m > 0, dose).otherwise(0)
    if transform == "punctuation":
        return n
    if transform == "buzzwords":
        return n + F.when(m > 0, sum(map(_words, (BUZZWORDS * dose)[:dose]))).otherwise(0)
    if transform in ("hedging", "confident"):
        phrases = HEDGES if transform == "hedging" else CONFIDENT
        out = n
        for i in range(dose):
            out = out + F.when(m > i, _words(phrases[i % len(phrases)])).otherwise(0)
        return out
    if transform == "bullets":
        return n + (F.greatest(m - 1, F.lit(0)) if dose == 1 else m)
    if transform == "headers":
        return n + _words("## Answer" if dose == 1 else "## Answer ### Further detail")
    return n + _words({"padding": " ".join(FILLER[:dose]), "flattery": FLATTERY[min(dose, len(FLATTERY)) - 1], "self_praise": SELF_PRAISE[min(dose, len(SELF_PRAISE)) - 1]}[transform])


@F.pandas_udf(StringType())
def nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def semantic_nulls(c: Column) -> dict[str, Column]:
    """Edits that keep the meaning. (NFKD is a UDF: Spark has no such function.)"""
    three = F.split(c, " ", 4)
    return {
        "double_spaces": F.replace(c, F.lit(". "), F.lit(".  ")),
        "curly_quotes": F.replace(F.replace(c, F.lit("'"), F.lit("’")), F.lit('"'), F.lit("“")),
        "trailing_space": F.concat(c, F.lit(" ")),
        "leading_space": F.concat(F.lit(" "), c),
        "nbsp_spaces": F.array_join(three, " "),
        "nfkd_normalise": nfkd(c),
    }


def affixed(base: Column, affix: Column, position: Column, good: Column) -> Column:
    text = F.replace(affix, F.lit("{good}"), good)
    return F.when(position == "prefix", F.concat(text, base)).otherwise(F.concat(base, text))


def prompt(kind: str, question: Column) -> Column:
    return F.concat(F.lit("\n\nHuman: "), question, F.lit(" \n\nAssistant:")) if kind == "hh" else question


def prompted(question: Column, model: Column, forms: dict[str, str]) -> Column:
    """The question as each row's model takes it: forms names the models that want turn markers; the others, and null,
    take the question as it is."""
    out = question
    for name, kind in forms.items():
        out = F.when(model == name, prompt(kind, question)).otherwise(out)
    return out


def parse_transcript(t: Column) -> tuple[Column, Column]:
    """(prompt, response): the last human turn and the last answer; null unless both have text."""
    found = F.instr(t, "\n\nAssistant:") > 0
    response = strip(F.substring_index(t, "\n\nAssistant:", -1))
    before = F.substring(t, F.lit(1), F.length(t) - F.length(F.substring_index(t, "\n\nAssistant:", -1)) - len("\n\nAssistant:"))
    asked = strip(F.regexp_replace(F.substring_index(before, "\n\nHuman:", -1), r"\s+", " "))
    asked = F.when(F.startswith(asked, F.lit("Human:")), strip(F.substring(asked, 7, 2_000_000_000))).otherwise(asked)
    ok = found & (asked != "") & (response != "")
    return F.when(ok, asked), F.when(ok, response)
