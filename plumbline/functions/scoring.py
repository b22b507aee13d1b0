"""Planted scorers and token measurements as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import uniform, word_count


def length_score(answer: Column, coef: float = 0.01) -> Column:
    return word_count(answer) * F.lit(coef)


def noise(question: Column, answer: Column, size: float = 0.1, seed: int = 7) -> Column:
    return (uniform(F.lit(seed), question, answer) - 0.5) * 2 * size


def score(question: Column, answer: Column, rule: str = "length", coef: float = 0.01, size: float = 0.0, seed: int = 7) -> Column:
    """rule: length or constant; anything else raises."""
    if rule not in ("length", "constant"):
        raise ValueError(f"unknown rule {rule!r}")
    base = length_score(answer, coef) if rule == "length" else F.lit(0.0)
    return base + noise(question, answer, size, seed) if size else base


def measured(question: Column, answer: Column, separator: str = "[SEP]", limit: int = 512, plain: Column | None = None) -> dict[str, Column]:
    """Token counts of a word-level scorer, whether it would cut the pair, separators that the answer forges (beyond
    those of the plain answer that it was made from, never less than none), and characters no vocabulary knows."""
    n = word_count(answer)
    separators = lambda c: F.size(F.split(c, re.escape(separator))) - 1
    return {
        "n_answer_tokens": n,
        "n_tokens": n + word_count(question) + 3,
        "truncated": n + word_count(question) + 3 > limit,
        "n_sep_in_answer": F.greatest(F.lit(0), separators(answer) - (separators(plain) if plain is not None else 0)),
        "n_unknown": F.size(F.split(answer, "\ufffd")) - 1,
    }


def cache_key(question: Column, answer: Column, model: str = "length", revision: str = "1", form: str = "bare", max_len: int = 512, split_special: bool = False) -> Column:
    """SHA-256 of a JSON array: no two requests share one, and a null is not an empty text."""
    fixed = [model, revision, form, str(max_len), "true" if split_special else "false"]
    return F.sha2(F.to_json(F.array(*map(F.lit, fixed), question, answer)).cast("binary"), 256)
