"""Attribution tables: wide and long form, global ranking, distribution per feature, top rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditkit.operators.cumulate import cumulate, q, quantiles
from auditkit.sources.staging import materialize

NEAR_ZERO = 1e-3
POINTS = {"p1": 0.01, "p5": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "p95": 0.95, "p99": 0.99}


def linear(matrix: DataFrame, weights: dict[str, float], means: dict[str, float]) -> DataFrame:
    """Wide attributions of a linear model: ``w_j * (x_j - mean_j)``, which add up to the margin."""
    return matrix.select("row_id", *[(F.lit(w) * (q(f) - F.lit(means[f]))).alias(f) for f, w in weights.items()])


def to_long(wide: DataFrame, id_column: str = "row_id") -> DataFrame:
    names = [c for c in wide.columns if c != id_column]
    return wide.unpivot([id_column], [q(c) for c in names], "feature", "shap_value")


def by_column(wide: DataFrame, id_column: str = "row_id") -> DataFrame:
    """The long form of a written wide table where each feature reads its own column, so a filter on the feature leaves one column to read."""
    names = [c for c in wide.columns if c != id_column]
    return reduce(DataFrame.unionAll, [wide.select(q(id_column), F.lit(c).alias("feature"), q(c).alias("shap_value")) for c in names])


def round_trip(wide: DataFrame, long: DataFrame, id_column: str = "row_id") -> DataFrame:
    """Per feature: cells in both forms, cells in one only, cells whose bits differ."""
    a = to_long(wide, id_column).withColumnRenamed("shap_value", "a")
    b = long.select(id_column, "feature", F.col("shap_value").alias("b"))
    both = a.withColumn("_in_a", F.lit(1)).join(b.withColumn("_in_b", F.lit(1)), [id_column, "feature"], "full_outer")
    return both.groupBy("feature").agg(
        F.count("*").alias("cells"),
        F.count_if(F.col("_in_b").isNull()).alias("only_wide"), F.count_if(F.col("_in_a").isNull()).alias("only_long"),
        F.count_if(F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull() & ~F.col("a").eqNullSafe(F.col("b")))
        .alias("different"))


def global_ranking(long: DataFrame) -> DataFrame:
    """(feature, mean_abs_shap, rank); equal means are ranked by name. The ranking window holds one row per feature."""
    per = long.groupBy("feature").agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap"))
    w = Window.orderBy(F.round("mean_abs_shap", 12).desc(), "feature")
    return per.withColumn("rank", F.row_number().over(w))


def detail(long: DataFrame) -> DataFrame:
    """The shape of every feature's attributions: size, direction, percentiles, concentration."""
    s, a = F.col("shap_value"), F.abs("shap_value")
    n = F.count("*")
    base = long.groupBy("feature").agg(
        n.alias("rows"), F.avg(a).alias("mean_abs_shap"), F.sum(a).alias("total_abs"), F.avg(s).alias("mean_signed_shap"),
        F.stddev_samp(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"),
        (F.count_if(s > NEAR_ZERO) * 100.0 / n).alias("pct_positive"),
        (F.count_if(s < -NEAR_ZERO) * 100.0 / n).alias("pct_negative"),
        (F.count_if(a <= NEAR_ZERO) * 100.0 / n).alias("pct_near_zero"))
    base = materialize(base, "shap_base")
    hist = materialize(long.groupBy("feature", "shap_value").agg(F.count("*").alias("n")), "shap_hist")
    points = quantiles(hist, ["feature"], "shap_value", "n", POINTS, staged=True)

    # The k rows of largest size per feature, as counts over distinct sizes.
    sizes = (hist.groupBy("feature", F.abs("shap_value").alias("size")).agg(F.sum("n").alias("n"))
             .withColumn("_down", -F.col("size")))
    k = F.greatest(F.lit(1), F.bround(F.col("rows") * F.lit(0.01), 0).cast("long"))
    taken = F.greatest(F.lit(0), F.least(F.col("n"), k - F.col("n_before")))
    top = (cumulate(sizes, ["feature"], ["_down"], ["n"]).join(base.select("feature", "rows"), "feature")
           .groupBy("feature").agg(F.sum(F.col("size") * taken).alias("top_abs")))
    share = F.try_divide(F.col("mean_abs_shap"), F.sum("mean_abs_shap").over(Window.partitionBy()))
    return (base.join(points, "feature").join(top, "feature")
            .withColumn("share_of_total_abs_shap", share)
            .withColumn("top1pct_abs_share", F.coalesce(F.try_divide(F.col("top_abs"), F.col("total_abs")), F.lit(0.0)))
            .drop("total_abs", "top_abs"))


def top_rows(long: DataFrame, feature: str, n: int) -> tuple[bool, DataFrame]:
    """Rows of the largest signed values of one feature; the row id itself is not a feature."""
    rows = long.filter(F.col("feature") == feature)
    found = feature != "row_id" and bool(rows.head(1))
    return found, rows.orderBy(F.col("shap_value").desc(), "row_id").limit(max(0, n))


def severity(ranking: DataFrame, kind, core: tuple[str, ...]) -> DataFrame:
    """Ranks 1-20 with the artefact kind: in the first ten a finding, in the next ten to watch."""
    return (ranking.filter(F.col("rank") <= 20).withColumn("kind", kind)
            .withColumn("severity", F.when(F.col("kind").isNull(), None).when(F.col("rank") <= 10, "finding")
                        .otherwise("watch"))
            .withColumn("core_in_top10", F.col("feature").isin(*core) & (F.col("rank") <= 10)))
