"""Small column helpers over text, all built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that separates words.
SPACES = "\t\n\x0b\x0c\r "


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, also where
    ``use`` refers to it inside a lambda that runs per element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` in order; null text has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES[:-1], " " * (len(SPACES) - 1))
    return F.filter(F.split(spaced, " ", -1), lambda w: w != "")


def count_of(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    text = F.coalesce(text, F.lit(""))
    return F.length(text) - F.length(F.translate(text, chars, ""))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def strip_spaces(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def null_safe_key(c: Column) -> Column:
    """A string key that is never null and differs for null and any string."""
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), c.cast("string")))
