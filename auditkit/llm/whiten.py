"""Whitening of vectors by a weighted covariance of distinct vectors.

Equal vectors are grouped first, so a vector that a third of all rows have is one row from there on; its weight in the fit is one
or the number of its rows. Sums are exact whole numbers. For the covariance each task centres its vectors, multiplies them
into one d x d matrix and hands out that matrix by rows, which Spark adds up. The eigenvectors are found once, every distinct vector is
whitened once, and rows take their vector's result by a join.

The driver holds the d sums, the d x d covariance and the components; all that grows with the rows stays in Spark.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditkit.llm.lookup import look_up
from auditkit.sources.staging import materialize

#: Where whole numbers of entries end: entries beyond stand for this number.
FARTHEST = 2.0**62
WHITENED = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whole(vector: Column, scale: int, shift: int = 0) -> Column:
    """floor(scale * c) + shift of each entry as long; null where the vector or an entry is null or not finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    near = lambda c: F.least(F.greatest(c.cast("double") * scale, F.lit(-FARTHEST)), F.lit(FARTHEST))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(vector, lambda c: F.floor(near(c)) + shift))


def filled(rows: DataFrame, length: int, fill: int, name: str) -> DataFrame:
    """Shorter vectors get ``fill`` at their end, so that all have ``length`` entries."""
    return rows.withColumn(name, F.concat(name, F.array_repeat(F.lit(fill).cast("long"), F.lit(length) - F.size(name))))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as one matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def decimals(numbers) -> pa.Array:
    """Whole numbers as decimals; null beyond 38 digits."""
    return pa.array([Decimal(int(t)) if abs(t) < 10**38 else None for t in numbers], pa.decimal128(38, 0))


def _sums(fit: DataFrame, d: int) -> tuple[list[int], int]:
    """Exact weighted sums by entry, and the sum of the weights."""

    def work(batches):
        total, n = np.zeros(d, object), 0
        for b in batches:
            x, w = matrix(b.column(0)), b.column(1).to_numpy()
            safe = float(np.abs(x.astype(float)).max(initial=0)) * float(w.sum()) < 2.0**62
            total = total + (w @ x if safe else w.astype(object) @ x.astype(object))
            n += int(w.sum())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), decimals(total),
                                              pa.array([n] * d, pa.int64())], names=["at", "total", "n"])

    parts = fit.select("x", "w").mapInArrow(work, "at int, total decimal(38,0), n long")
    rows = parts.groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("at").collect()
    return [int(r["total"]) for r in rows], rows[0]["n"]


def _products(fit: DataFrame, centred) -> np.ndarray:
    """The sum over rows (v, w) of w * c c', where c is the row's ``centred`` vector."""

    def work(batches):
        total = None
        for b in batches:
            if len(b):
                c = centred(matrix(b.column(0)))
                part = (c * b.column(1).to_numpy()[:, None]).T @ c
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = fit.mapInArrow(work, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    got = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    d = int(got.i.max()) + 1
    out = np.zeros((d, d))
    out[got.i, got.j] = got.v
    return (out + out.T) / 2


def whiten(rows: DataFrame, components: int = 16, weights: str = "one", fill: int = 0) -> DataFrame:
    """id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained and identity_error of (id, x longs).

    The fit is over the distinct x with weight one, or their number of rows with weights = "count"; n is the sum of weights. deviation is the sum
    over entries of (n*x - S)^2, exact (null beyond 38 digits). whitened is x less the mean on the component, over the root of its eigenvalue;
    explained is the eigenvalue's share of the trace; identity_error the largest entry of whitened's own covariance less the identity.

    Rows with x null take no part; a null id stays null and repeated rows give their results each time. Shorter vectors are filled with
    ``fill``. There are at most as many components as entries. A component with no variance (all vectors equal, fewer vectors than
    entries) has whitened null and is left out of identity_error, which is null where none has any; with no variance at all, explained is null.
    No row, or vectors without entries, give no row. Other columns are not looked at."""
    spark = rows.sparkSession
    given = materialize(rows.filter("x is not null").select("id", "x"), "vectors")
    d = given.agg(F.max(F.size("x"))).first()[0]
    if not d:
        return spark.createDataFrame([], WHITENED)
    given = filled(given, d, fill, "x")
    counted = materialize(given.groupBy("x").agg(F.count("*").alias("rows")), "distinct")
    fit = counted.withColumn("w", F.col("rows") if weights == "count" else F.lit(1).cast("long"))
    sums, n = _sums(fit, d)
    base = np.array([s // n for s in sums], np.int64)
    rest = [s - int(b) * n for s, b in zip(sums, base)]
    shift = np.array([r / n for r in rest])

    def centred(x: np.ndarray) -> np.ndarray:
        near = np.abs(x.astype(float)).max(initial=0) + np.abs(base.astype(float)).max() < 2.0**62
        away = x - base if near else (x.astype(object) - base.astype(object)).astype(float)
        return away - shift

    v = _products(fit.select("x", "w"), centred) / n
    e, axes = np.linalg.eigh(v)
    k = min(components, d)
    e, axes = e[::-1][:k], axes[:, ::-1][:, :k]
    trace, real = float(np.trace(v)), e > d * np.finfo(float).eps * max(float(e[0]), 0.0)
    scale = np.where(real, 1 / np.sqrt(np.where(real, e, 1)), np.nan)
    owed = np.array(rest, object)

    def work(batches):
        for b in batches:
            if len(b):
                x = matrix(b.column(0))
                white = (centred(x) @ axes) * scale
                far = float((np.abs(x.astype(float) - base.astype(float)).max() + 1) * n)
                y = (x - base) * n - owed.astype(np.int64) if far * far * d < 2.0**62 else (x.astype(object) - base.astype(object)) * n - owed
                yield pa.RecordBatch.from_arrays([*b.columns, decimals((y * y).sum(axis=1)), pa.array(list(white), pa.list_(pa.float64()))],
                                                 names=["x", "w", "rows", "deviation", "white"])

    schema = "x array<long>, w long, rows long, deviation decimal(38,0), white array<double>"
    done = materialize(fit.select("x", "w", "rows").mapInArrow(work, schema), "whitened")
    shown = [F.lit(float(share)) for share in e / trace] if trace > 0 else [F.lit(None).cast("double")] * k
    found = look_up(given, done.select("x", "rows", "deviation", "white"), "x", "rows")
    return found.select("id", F.posexplode("white").alias("at", "white"), "deviation").select(
        "id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(~F.isnan("white"), F.col("white")).alias("whitened"), F.get(F.array(*shown), F.col("at")).alias("explained"),
        F.lit(_identity_error(done, np.flatnonzero(real).tolist(), n)).cast("double").alias("identity_error"))


def _identity_error(done: DataFrame, real: list[int], n: int) -> float | None:
    """How far the covariance of what was whitened is from the identity, over the components with variance."""
    if not real:
        return None
    means = np.array(done.agg(*[F.sum(F.get("white", F.lit(i)) * F.col("w")) for i in real]).first(), float) / n
    cov = _products(done.select("white", "w"), lambda white: white[:, real] - means) / n
    return float(np.abs(cov - np.eye(len(real))).max())
