"""Joining many rows with a table of one row per key, whatever share of the rows one key has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than one in so many of all rows, so there are fewer hot keys than this.
SHARE = 1_000


def look_up(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the columns of ``table`` but ``count``, which holds how many of ``rows`` have the key; a null key is a key like others.

    Both are tables read again, so give written ones. Hot keys, fewer than ``SHARE`` by their definition, are broadcast and their rows
    stay where they are; only rows of other keys are shuffled, and no such key has more than one in ``SHARE`` of them."""
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * SHARE > F.lit(total)
    found = [c for c in table.columns if c not in (key, count)]
    renamed = table.select(F.col(key).alias("__key"), count, *found)
    few = F.broadcast(renamed.filter(hot).drop(count).withColumn("__hot", F.lit(True)))
    met = rows.join(few, F.col(key).eqNullSafe(F.col("__key")), "left")
    rest = met.filter("__hot is null").select(*rows.columns)
    rest = rest.join(renamed.filter(~hot).drop(count), F.col(key).eqNullSafe(F.col("__key")))
    return met.filter("__hot").select(*rows.columns, *found).unionByName(rest.select(*rows.columns, *found))
