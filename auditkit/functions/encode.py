"""Text to numbers: terms, ordinal maps, missing flags, one-hot columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditkit.functions.text import strip

def term_months(text: Column) -> Column:
    """``" 36 months"`` as 36."""
    return F.split(strip(text), " ").getItem(0).try_cast("int")


def ordinal(text: Column, levels: dict[str, int]) -> Column:
    """A mapped level; a level outside the map becomes null."""
    pairs = chain.from_iterable((F.lit(k), F.lit(v)) for k, v in levels.items())
    return F.create_map(*pairs)[text]


def letter_digit(text: Column, levels: dict[str, int], digits: int = 5) -> Column:
    """``"B3"`` as ``(2 - 1) * 5 + 3``."""
    return (ordinal(F.substring(text, 1, 1), levels) - 1) * digits + F.substring(text, 2, 1).try_cast("int")


def dummy(value: Column, level: str) -> Column:
    """One-hot column of one level; null counts as the level ``missing``."""
    return F.when(F.coalesce(value, F.lit("missing")) == level, 1).otherwise(0)
