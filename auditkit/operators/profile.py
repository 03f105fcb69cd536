"""Column profiles from one shared histogram: coverage, rank AUC, association, correlation neighbours."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditkit.functions.numbers import pct, r6
from auditkit.operators.columns import WAS_MISSING, first_by
from auditkit.operators.cumulate import cumulate, q, quantiles
from auditkit.sources.staging import materialize, shared_dir

SENTINEL = 999
#: Columns on a side of a correlation tile.
BLOCK = 1_000


def long_form(df: DataFrame, features: list[str], ids: list[str]) -> DataFrame:
    """(ids..., feature, value double), one row per cell."""
    return df.select(*ids, *[q(f).cast("double").alias(f) for f in features]).unpivot(
        ids, [q(f) for f in features], "feature", "value")


def histogram(matrix: DataFrame, features: list[str], keys: tuple[str, ...] = ("vintage", "split")) -> DataFrame:
    """(keys, feature, value, n, pos): the wide cells collapse to distinct values before anything is shuffled."""
    return (long_form(matrix, features, [*keys, "label"])
            .groupBy(*keys, "feature", "value")
            .agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("pos")))


def by_scope(hist: DataFrame) -> DataFrame:
    """Histogram per scope: every vintage under its own name and under its split."""
    return (hist.withColumn("scope", F.explode(F.array("split", F.col("vintage").cast("string"))))
            .groupBy("scope", "feature", "value").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
            .withColumn("neg", F.col("n") - F.col("pos")))


def totals(hist: DataFrame) -> DataFrame:
    """Per (scope, feature): counts and the mean, from one scan that shuffles a row per scope and column and task."""
    v, n = F.col("value"), F.col("n")
    return hist.groupBy("scope", "feature").agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_unique"), F.sum("pos").alias("n_pos"),
        F.sum(F.when(v == 0, n).otherwise(0)).alias("n_zero"),
        F.sum(F.when(v == SENTINEL, n).otherwise(0)).alias("n_sentinel"),
        F.sum(F.when(v > 0, n).otherwise(0)).alias("n_above"),
        F.sum(F.when(v > 0, F.col("pos")).otherwise(0)).alias("pos_above"),
        F.try_divide(F.sum(v * n), F.sum("n").cast("double")).alias("mean"))


def moments(hist: DataFrame) -> DataFrame:
    """``totals`` with the centred sum of squares and the covariance sum with the label."""
    base, n = totals(hist), F.col("n")
    off = F.col("value") - F.col("mean")
    # One row per scope and column: sent to all, so that the histogram stays where it is.
    spread = (hist.join(F.broadcast(base.select("scope", "feature", "mean")), ["scope", "feature"])
              .groupBy("scope", "feature")
              .agg(F.sum(n * off * off).alias("ssq"), F.sum(F.col("pos") * off).alias("sxy")))
    return base.join(spread, ["scope", "feature"])


def rank_auc(hist: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mann-Whitney AUC per group with average ranks for ties, not folded at 0.5.

    ``hist`` has (keys, value, pos, neg). One class only, or one distinct value only, gives null.
    """
    cum = cumulate(hist, keys, [value], ["neg"])
    won = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)
    p, n = F.sum("pos"), F.sum("neg")
    defined = (p > 0) & (n > 0) & (F.count("*") > 1)
    return cum.groupBy(*keys).agg(
        (p + n).alias("n"), p.alias("n_pos"),
        F.when(defined, F.try_divide(F.sum(won), p.cast("double") * n.cast("double"))).alias("auc"))


def coverage(hist: DataFrame) -> DataFrame:
    """One row per feature and scope; ``hist`` is the staged histogram by scope."""
    stats = moments(hist)
    medians = quantiles(hist, ["scope", "feature"], "value", "n", {"p50": 0.5}, staged=True)
    flags = stats.filter(F.col("feature").endswith(WAS_MISSING)).select(
        "scope", F.expr(f"substring(feature, 1, length(feature) - {len(WAS_MISSING)})").alias("feature"),
        pct(F.col("mean"), F.lit(1.0)).alias("pct_flagged_missing"))
    rows = F.col("n_rows")
    return (stats.join(medians, ["scope", "feature"]).join(flags, ["scope", "feature"], "left")
            .select("feature", "scope", "n_rows",
                    F.col("pct_flagged_missing").isNotNull().alias("has_missingness_flag"), "pct_flagged_missing",
                    pct(F.col("n_zero"), rows).alias("pct_zero"), pct(F.col("n_sentinel"), rows).alias("pct_at_999"),
                    "n_unique", r6(F.col("mean")).alias("mean"),
                    F.when(rows > 1, r6(F.sqrt(F.try_divide(F.col("ssq"), (rows - 1).cast("double"))))).alias("std"),
                    r6(F.col("p50")).alias("p50")))


def univariate(hist: DataFrame, train_vintages: tuple[int, ...], test: str = "test") -> DataFrame:
    """AUC per split and train vintage, point-biserial correlation and constancy on test."""
    auc = rank_auc(hist, ["scope", "feature"])
    scopes = ["train", test, *[str(v) for v in train_vintages]]
    wide = auc.groupBy("feature").agg(*[
        r6(F.max(F.when(F.col("scope") == s, F.col("auc")))).alias(f"auc_{s}") for s in scopes])
    rows, pos = F.col("n_rows").cast("double"), F.col("n_pos").cast("double")
    r = F.try_divide(F.col("sxy"), F.sqrt(F.col("ssq") * pos * (rows - pos) / rows))
    on_test = moments(hist.filter(F.col("scope") == test)).select(
        "feature", F.when(F.col("n_unique") > 1, r6(r)).alias("point_biserial_test"),
        F.col("n_unique").alias("n_unique_test"), (F.col("n_unique") < 2).alias("is_constant_test"))
    return wide.join(on_test, "feature")


def correlation(df: DataFrame, features: list[str], block: int = BLOCK) -> DataFrame:
    """All ordered pairs (feature, neighbour, r) of different columns; r is null where a side is constant or has a null.

    Columns are cut into blocks, and each pair of blocks is one tile: a scan of the two blocks' columns alone, where every task multiplies its
    centred rows and the products are added up by row of the tile. Tiles are written one after the other; the driver sees a few
    figures a column, never the p x p result, and no task holds more than a tile.
    """
    spark = df.sparkSession
    names = [features[i:i + block] for i in range(0, len(features), block)]
    facts = {}
    for part in names:
        cells = [q(f).cast("double") for f in part]
        got = df.agg(*[a.alias(f"{k}{i}") for i, c in enumerate(cells) for k, a in (("m", F.avg(c)), ("lo", F.min(c)), ("hi", F.max(c)), ("n", F.count(c)))], F.count("*").alias("rows")).first()
        facts |= {f: (got[f"m{i}"], got[f"lo{i}"] is not None and got[f"lo{i}"] < got[f"hi{i}"] and got[f"n{i}"] == got["rows"]) for i, f in enumerate(part)}
    varies = [[f for f in part if facts[f][1]] for part in names]
    path, scale = f"{shared_dir(spark)}/tiles-{uuid.uuid4().hex[:12]}", {}
    schema = "feature string, neighbour string, r double"
    spark.createDataFrame([], schema).write.parquet(path)
    for i, j in sorted(((i, j) for j in range(len(names)) for i in range(j + 1)), key=lambda t: (t[0] != t[1], t)):
        if not varies[i] or not varies[j]:
            continue
        sums = materialize(_tile(df, varies[i], varies[j], {f: facts[f][0] for f in (*varies[i], *varies[j])}), "tile")
        if i == j:  # tiles on the diagonal come first: they hold every column's own square
            own = sums.select("row", F.get("products", F.col("row")).alias("square")).collect()
            scale |= {varies[i][r["row"]]: math.sqrt(r["square"]) for r in own}
        _pairs(sums, varies[i], varies[j], scale).write.mode("append").parquet(path)
        if i != j:
            turned = _pairs(sums, varies[i], varies[j], scale).select(F.col("neighbour").alias("feature"), F.col("feature").alias("neighbour"), "r")
            turned.write.mode("append").parquet(path)
    known = spark.read.schema(schema).parquet(path)
    flat = [f for f in features if not facts[f][1]]
    if not flat:
        return known
    # A column that doesn't vary has a row without r against each other column.
    a, every = (spark.createDataFrame([(f,) for f in some], "f string") for some in (flat, features))
    blank = F.lit(None).cast("double").alias("r")
    one = a.select(F.col("f").alias("feature"), F.explode(F.array(*map(F.lit, features))).alias("neighbour"))
    two = every.filter(~F.col("f").isin(flat)).select(F.col("f").alias("feature"), F.explode(F.array(*map(F.lit, flat))).alias("neighbour"))
    return known.unionByName(one.unionByName(two).filter("feature <> neighbour").select("feature", "neighbour", blank))


def _tile(df: DataFrame, left: list[str], right: list[str], means: dict[str, float]) -> DataFrame:
    """(row, products): sums over all rows of the products of each left column with all right ones, both less their means."""
    columns = list(dict.fromkeys([*left, *right]))
    place = {f: k for k, f in enumerate(columns)}
    a, b, centre = [place[f] for f in left], [place[f] for f in right], np.array([means[f] for f in columns])

    def multiply(batches):
        total = np.zeros((len(a), len(b)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - centre
            total += x[:, a].T @ x[:, b]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(a)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["row", "products"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = v.values.to_numpy()
                total[r] = total[r] + v if r in total else v.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["row", "products"])

    schema = "row int, products array<double>"
    parts = df.select(*[q(f).cast("double").alias(f"c{k}") for k, f in enumerate(columns)]).mapInArrow(multiply, schema)
    return parts.repartition("row").mapInArrow(add, schema)


def _pairs(sums: DataFrame, left: list[str], right: list[str], scale: dict[str, float]) -> DataFrame:
    """(feature, neighbour, r) of one tile's sums, without a column beside itself."""
    def named(batches):
        across = np.array([scale[f] for f in right])
        for batch in batches:
            for r, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                other = [k for k, f in enumerate(right) if f != left[r]]
                c = v.values.to_numpy() / (scale[left[r]] * across)
                yield pa.RecordBatch.from_arrays([pa.array([left[r]] * len(other), pa.string()), pa.array([right[k] for k in other], pa.string()),
                                                  pa.array(np.clip(c[other], -1, 1), pa.float64())], names=["feature", "neighbour", "r"])

    return sums.mapInArrow(named, "feature string, neighbour string, r double")


def neighbours(pairs: DataFrame, k: int = 15) -> DataFrame:
    """The k nearest columns by absolute correlation; a column without any keeps one row of nulls."""
    known = pairs.filter(F.col("r").isNotNull())
    top = first_by(known, ["feature"], [F.round(F.abs("r"), 12).desc(), F.col("neighbour")], k)
    return (pairs.select("feature").distinct().join(top, "feature", "left")
            .select("feature", F.coalesce("rank", F.lit(1)).alias("rank"), "neighbour",
                    r6(F.col("r")).alias("pearson_r"), r6(F.abs("r")).alias("abs_pearson_r")))
