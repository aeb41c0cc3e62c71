"""Column helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space; words are the longest runs of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, however often body or its lambdas refer to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """array<string> of the words; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def count_words(text: Column) -> Column:
    """Number of words, without building them as an array of strings where the text is null or blank."""
    return F.size(words(text)).cast("long")


def without_space(text: Column) -> Column:
    return F.translate(text, _SPACES, "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def fresh(name: str, taken: list[str]) -> str:
    """A column name near `name` that is not in `taken`, compared without case."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name
