"""Cited figures and the numbers they may come from: the nearest number of the same run, matches, ties.

Numbers and figures of a run are put in one order and dealt into ranges whatever run they belong to. The neighbours of a figure are the last number
before it and the first one after it in its range, or else what a table with one row for each run and range says of the ranges before and after.
The numbers on a boundary are found by their positions, counted through the same order (``cumulate``). Each distinct number is kept once, whatever
decimals the figures have, no pairs are formed, and neither a run with very many numbers nor a figure cited very often meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditkit.operators.cumulate import cumulate, q
from auditkit.operators.lookup import look_up
from auditkit.sources.staging import materialize

TIE_EPSILON = 1e-9
_BELOW, _NUMBER, _UP_TO = 0, 1, 2


def half_unit(decimals: Column) -> Column:
    """Half a unit of the last decimal; 0 where that is below all doubles."""
    return F.lit(0.5) * F.pow(F.lit(10.0), -decimals.cast("double"))


def _finite(numbers: DataFrame, key: str) -> DataFrame:
    """(key, at): each number of a run once."""
    x = F.col("x").cast("double") + F.lit(0.0)  # one zero
    return numbers.select(key, x.alias("at")).filter(q(key).isNotNull() & (F.abs("at") < float("inf"))).distinct()


def _neighbours(cells: DataFrame, numbers: DataFrame, key: str) -> DataFrame:
    """``cells`` (key, at, ...) with ``below`` and ``above``: the run's nearest numbers up to ``at`` and beyond it. The dealt rows are written once."""
    number = F.col("at").alias("_x")
    points = cells.withColumn("_x", F.lit(None).cast("double")).withColumn("_side", F.lit(_UP_TO))
    rows = points.unionByName(_finite(numbers, key).select(key, "at", number, F.lit(_NUMBER).alias("_side")), allowMissingColumns=True)
    dealt = materialize(rows.repartitionByRange(q(key), "at", "_side").withColumn("_range", F.spark_partition_id()), "ranges")
    ranges = Window.partitionBy(key).orderBy("_range")
    ends = dealt.groupBy(key, "_range").agg(F.min("_x").alias("_least"), F.max("_x").alias("_most")).select(
        key, "_range", F.last("_most", True).over(ranges.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_least", True).over(ranges.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    inside = Window.partitionBy(key, "_range").orderBy("at", "_side")
    # Downwards, a point comes before the numbers it is equal to, so the last one met is the first beyond it.
    back = Window.partitionBy(key, "_range").orderBy(F.desc("at"), F.desc("_side"))
    up_to = [w.rowsBetween(Window.unboundedPreceding, -1) for w in (inside, back)]
    near = dealt.select("*", *[F.last("_x", True).over(w).alias(n) for n, w in zip(("_low", "_high"), up_to)]).filter(F.col("_side") == _UP_TO)
    known = F.col("at").isNotNull()
    return near.join(ends, [key, "_range"]).select(*[q(c) for c in cells.columns], F.when(known, F.coalesce("_low", "_before")).alias("below"),
                                                   F.when(known, F.coalesce("_high", "_after")).alias("above"))


def _placed(numbers: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """(key, at, side, before): ``before`` counts the run's distinct numbers ahead of a number or point. Written once."""
    rows = (_finite(numbers, key).select(key, "at", F.lit(_NUMBER).alias("side"), F.lit(1).cast("long").alias("number"))
            .unionByName(points.select(key, "at", "side").distinct().withColumn("number", F.lit(0).cast("long"))))
    placed = cumulate(rows, [key], ["at", "side"], ["number"])
    return materialize(placed.select(key, "at", "side", F.col("number_before").alias("before")), "placed")


def _numbers(placed: DataFrame, key: str) -> DataFrame:
    return placed.filter(F.col("side") == _NUMBER).select(key, (F.col("before") + 1).alias("pos"), F.col("at").alias("x"))


def band_match(tokens: DataFrame, numbers: DataFrame, key: str = "run") -> DataFrame:
    """``tokens`` (key, value, decimals, ...) with ``nearest``, ``matched`` and ``on_tie``, against ``numbers`` (key, x).

    nearest: the one of value's two neighbours among the run's numbers that is less far, the lower if alike, null without any. matched: its distance is
    below half a unit of the last decimal, or 0. on_tie: a number sits on that boundary, by a billionth of it, and none is
    clearly inside, so that float representation decided. Tokens without a run or value match nothing; numbers that are null or
    not finite don't count. Repeated tokens are judged each time."""
    tokens = materialize(tokens, "figures")
    value = F.col("value").cast("double") + F.lit(0.0)
    cells = tokens.groupBy(key, "value", "decimals").agg(F.count("*").alias("_rows")).withColumn("at", value)
    told = cells.filter(q(key).isNotNull())
    gaps = [F.abs(F.col(n) - F.col("at")) for n in ("below", "above")]
    half = half_unit(F.col("decimals"))
    band = F.lit(TIE_EPSILON) * half
    tied = F.coalesce(F.abs(gaps[0] - half) <= band, F.lit(False)) | F.coalesce(F.abs(gaps[1] - half) <= band, F.lit(False))
    least = F.least(*gaps)
    judged = _neighbours(told, numbers, key).select(
        key, "value", "decimals", "_rows", F.when(gaps[0].isNotNull() & F.coalesce(gaps[0] <= gaps[1], F.lit(True)), F.col("below")).otherwise(F.col("above")).alias("nearest"),
        F.coalesce((least < half) | (least == 0), F.lit(False)).alias("matched"),
        F.coalesce(tied & ~((least < half - band) | (least == 0)), F.lit(False)).alias("on_tie"))
    none = F.lit(False)
    judged = judged.unionByName(cells.filter(q(key).isNull()).select(key, "value", "decimals", "_rows", F.lit(None).cast("double").alias("nearest"),
                                                                     none.alias("matched"), none.alias("on_tie")))
    return look_up(tokens, materialize(judged, "judged"), [key, "value", "decimals"], "_rows")


def ties(matched: DataFrame, numbers: DataFrame, key: str = "run") -> DataFrame:
    """(key, value, decimals, tie_value): all distinct numbers on the boundary of the figures that ``band_match`` marks ``on_tie``."""
    figures = materialize(matched.filter("on_tie").select(key, "value", "decimals").distinct(), "tied")
    half = half_unit(F.col("decimals"))
    wide = F.lit(2 * TIE_EPSILON) * half + F.abs("value") * 1e-15  # a little more than the band; the definition decides below
    edges = F.array(*[F.struct((F.col("value") + s * half - wide).alias("low"), (F.col("value") + s * half + wide).alias("high")) for s in (-1, 1)])
    spans = materialize(figures.select(key, "value", "decimals", F.inline(edges)), "spans")
    points = spans.select(key, F.col("low").alias("at"), F.lit(_BELOW).alias("side")).unionByName(
        spans.select(key, F.col("high").alias("at"), F.lit(_UP_TO).alias("side")))
    placed = _placed(numbers, points, key)
    low = placed.filter(F.col("side") == _BELOW).select(key, F.col("at").alias("low"), F.col("before").alias("first"))
    high = placed.filter(F.col("side") == _UP_TO).select(key, F.col("at").alias("high"), F.col("before").alias("last"))
    held = spans.join(low, [key, "low"]).join(high, [key, "high"]).filter("last > first")
    held = held.withColumn("pos", F.explode(F.sequence(F.col("first") + 1, F.col("last")))).join(_numbers(placed, key), [key, "pos"])
    here = F.abs(F.abs(F.col("x") - F.col("value")) - half) <= F.lit(TIE_EPSILON) * half
    return held.filter(here).select(key, "value", "decimals", F.col("x").alias("tie_value")).distinct()
