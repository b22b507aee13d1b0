"""Text expressions: words, sentences, digests. All are Columns, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def sentences(c: Column) -> Column:
    """Parts that end with a full stop, an exclamation or a question mark before white space."""
    return F.filter(F.split(strip(F.coalesce(c, F.lit(""))), r"(?<=[.!?])\s+"), lambda x: x != "")


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def uniform(*parts: Column | str | int) -> Column:
    """A number from 0 to 1 that depends on the parts alone: the first 8 bytes of their SHA-256 over 2^64."""
    return F.conv(F.substring(_hex(*parts), 1, 16), 16, 10).cast("double") / F.lit(18446744073709551616.0)


def hashed(*parts: Column | str | int) -> Column:
    """32 bits of SHA-256 over the parts, joined by colons, as a long."""
    return F.conv(F.substring(_hex(*parts), 1, 8), 16, 10).cast("long")


def _hex(*parts: Column | str | int) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat_ws(":", *[c.cast("string") for c in cols]).cast("binary"), 256)
