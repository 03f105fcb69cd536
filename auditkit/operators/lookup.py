"""Joining many rows with a table of one row per key, whatever share of the rows one key has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditkit.operators.cumulate import q

#: A key is hot with more than one in so many of all rows, so there are fewer hot keys than this.
SHARE = 1_000


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` with the columns of ``table`` but ``count``, which says how many of ``rows`` have the keys; a null key is a key like others.

    Both are read twice, so give written tables. Hot keys, fewer than ``SHARE`` by their definition, are broadcast and their rows
    stay where they are; only rows of other keys are shuffled, and no such key has more than one in ``SHARE`` of them.
    Rows whose keys are not in ``table`` are left out."""
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = q(count) * SHARE > F.lit(total)
    found = [c for c in table.columns if c not in (*keys, count)]
    renamed = table.select(*[q(k).alias(f"__{k}") for k in keys], q(count), *map(q, found))
    on = reduce(lambda a, b: a & b, [q(k).eqNullSafe(q(f"__{k}")) for k in keys])
    few = F.broadcast(renamed.filter(hot).drop(count).withColumn("__hot", F.lit(True)))
    met = rows.join(few, on, "left")
    rest = met.filter("__hot is null").select(*map(q, rows.columns)).join(renamed.filter(~hot).drop(count), on)
    wanted = [*map(q, rows.columns), *map(q, found)]
    return met.filter("__hot").select(*wanted).unionByName(rest.select(*wanted))
