"""Names and words shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The word definitions of the query contracts, as Java and as byte patterns.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ALNUM_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that `df` doesn't have, whatever its own columns are called."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name in taken:
        name = f"_{name}"
    return name


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, use) -> Column:
    """`use(value)`, with the value computed once however often it is used, also by inner functions for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is. `lower` does just that where every character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column, word: str) -> Column:
    """All words of the text in order; none for a null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(word), F.lit(0))


def spaced_words(text: str | None) -> list[bytes]:
    """As `words_of(lower_ascii(text), SPACED_WORD)`: on bytes, `lower` and `split` know ASCII only."""
    return text.encode().lower().split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    return _ALNUM_BYTES.findall(text.encode().lower()) if text else []
