"""Running sums within groups of any size.

``cumulate`` is what rank AUC, exact quantiles, curves, row positions and running spend share. A plain window would put a whole
group into one task. Here rows are dealt into ranges of (keys, order), whichever group they belong to: a large
group covers several ranges, a range holds many small groups. Sums inside a range come from a window over (group,
range); what the group's earlier ranges add up to comes from a table with one row for each group and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditkit.sources.staging import materialize


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def cumulate(df: DataFrame, keys: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """Add ``<s>_before``: the sum of ``s`` over the rows of the same group that sort before this one.

    ``order`` must be unique within a group. ``keys`` may be empty. Keys are not null. The dealt rows are written once, so that
    both the sums of ranges and the sums inside them see the same ranges.
    """
    if not keys:
        return cumulate(df.withColumn("_all", F.lit(0)), ["_all"], order, sums).drop("_all")
    by = [q(c) for c in dict.fromkeys([*keys, *order])]
    dealt = materialize(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    per_range = dealt.groupBy(*keys, "_range").agg(*[F.sum(q(s)).alias(f"_{s}_sum") for s in sums])
    lower = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(*keys, "_range", *[
        F.coalesce(F.sum(f"_{s}_sum").over(lower), F.lit(0)).alias(f"_{s}_off") for s in sums])
    out = _window(dealt, [*keys, "_range"], order, sums).join(offsets, [*keys, "_range"])
    return out.select(*[q(c) for c in df.columns], *[(F.col(f"{s}_before") + F.col(f"_{s}_off")).alias(f"{s}_before") for s in sums])


def _window(df: DataFrame, keys: list[str], order: list[str], sums: list[str]) -> DataFrame:
    w = (Window.partitionBy(*keys).orderBy(*[q(o) for o in order])
         .rowsBetween(Window.unboundedPreceding, -1))
    return df.select("*", *[F.coalesce(F.sum(q(s)).over(w), F.lit(0)).alias(f"{s}_before") for s in sums])


def positions(df: DataFrame, keys: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """1-based position of each row within its group, for groups of any size."""
    out = cumulate(df.withColumn("_one", F.lit(1).cast("long")), keys, order, ["_one"])
    return out.withColumn(name, F.col("_one_before") + 1).drop("_one", "_one_before")


def quantiles(hist: DataFrame, keys: list[str], value: str, n: str, points: dict[str, float],
              staged: bool = False) -> DataFrame:
    """Exact interpolated quantiles per group from a (keys, value, count) histogram.

    The quantile at ``p`` lies at position ``p * (rows - 1)`` of the sorted values, between two neighbours.
    """
    if not keys:
        return quantiles(hist.withColumn("_all", F.lit(0)), ["_all"], value, n, points).drop("_all")
    if not staged:  # it is read twice
        hist = materialize(hist, "hist")
    totals = hist.groupBy(*keys).agg(F.sum(n).alias("_total"))
    cum = cumulate(hist, keys, [value], [n])
    cum = cum.join(totals, keys)
    last = F.col(f"{n}_before") + F.col(n)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col(f"{n}_before") <= rank) & (rank < last), q(value)))

    aggs = []
    for name, p in points.items():
        where = F.lit(float(p)) * (F.col("_total") - 1)
        aggs += [at(F.floor(where)).alias(f"_{name}_lo"), at(F.ceil(where)).alias(f"_{name}_hi")]
    got = cum.groupBy(*keys).agg(F.max("_total").alias("_total"), *aggs)
    cols = []
    for name, p in points.items():
        where = F.lit(float(p)) * (F.col("_total") - 1)
        frac = where - F.floor(where)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * frac).alias(name))
    return got.select(*keys, *cols)
