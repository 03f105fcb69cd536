"""Aggregations over raw tables: value counts, ranges, missing shares, vintages, tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditkit.functions.numbers import pct
from auditkit.operators.columns import column_facts
from auditkit.operators.cumulate import q
from auditkit.operators.profile import long_form


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count and share of every value, nulls under ``<missing>``. The total is summed over the counts, not the rows."""
    per = df.groupBy(F.coalesce(q(column), F.lit("<missing>")).alias("value")).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n")).scalar()
    return per.select("value", "n", pct(F.col("n"), total).alias("pct"))


def date_range(df: DataFrame, parsed: Column) -> DataFrame:
    return df.agg(F.min(parsed).alias("first"), F.max(parsed).alias("last"), F.count("*").alias("n_rows"))


def most_missing(df: DataFrame, names: list[str], n: int = 20) -> DataFrame:
    """The n columns with the largest share of nulls, ties by name; one aggregate over the rows."""
    facts = column_facts(df, names)
    return (facts.select("column", pct(F.col("n_missing"), F.col("n_rows")).alias("pct_missing"))
            .orderBy(F.col("pct_missing").desc(), "column").limit(n))


def vintage_rates(df: DataFrame, split: str, vintage: str, label: str) -> DataFrame:
    """Size, share of the split and rate per vintage."""
    per = df.groupBy(split, vintage).agg(F.count("*").alias("n"), F.avg(label).alias("rate"))
    return per.withColumn("pct_of_split", pct(F.col("n"), F.sum("n").over(Window.partitionBy(split))))


def split_rates(df: DataFrame, split: str, label: str) -> DataFrame:
    """Rate on train and on test and the difference in percentage points."""
    one = df.agg(F.count_if(q(split) == "train").alias("n_train"), F.count_if(q(split) == "test").alias("n_test"),
                 (F.avg(F.when(q(split) == "train", q(label))) * 100).alias("train_pct"),
                 (F.avg(F.when(q(split) == "test", q(label))) * 100).alias("test_pct"))
    return one.withColumn("delta_pp", F.col("test_pct") - F.col("train_pct"))


def column_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """Distinct, negative and missing counts per numeric column. Cells collapse to distinct values before the shuffle."""
    hist = long_form(df, names, []).groupBy("feature", "value").agg(F.count("*").alias("n"))
    v, n = F.col("value"), F.col("n")
    return hist.groupBy("feature").agg(
        F.count("value").alias("n_distinct"), F.sum(F.when(v < 0, n).otherwise(0)).alias("n_negative"),
        F.sum(F.when(v.isNull(), n).otherwise(0)).alias("n_missing"))


def weighted_mean(coverage: DataFrame, scopes: tuple[str, ...]) -> DataFrame:
    """Mean per feature over several scopes, each weighted by its rows."""
    part = coverage.filter(F.col("scope").isin(*scopes))
    return part.groupBy("feature").agg(
        F.try_divide(F.sum(F.col("n_rows") * F.col("mean")), F.sum("n_rows").cast("double")).alias("train_mean"))


def agreed_rows(counts: DataFrame, scopes: tuple[str, ...], n: str = "n_rows") -> DataFrame:
    """(train_rows): the row total over the scopes, on which all features must agree; reading it is an error where they don't.

    ``counts`` has (feature, scope, n), in one row or several."""
    per = counts.filter(F.col("scope").isin(*scopes)).groupBy("feature").agg(F.sum(n).alias("n"))
    both = per.agg(F.min("n").alias("low"), F.max("n").alias("high"))
    wrong = F.raise_error(F.format_string("features disagree on the row count: %s to %s", F.col("low").cast("string"), F.col("high").cast("string")))
    return both.select(F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(wrong.cast("long")).alias("train_rows"))


def tallies(runs: DataFrame, calls: DataFrame, keys: list[str], tools: list[str]) -> DataFrame:
    """Run sums per configuration and calls per tool; calls shrink to (run, tool) counts before the join."""
    per_run = calls.groupBy("run").agg(*[F.count_if(F.col("tool") == t).alias(t) for t in tools])
    joined = runs.join(per_run, "run", "left")
    return joined.groupBy(*keys).agg(
        F.count("*").alias("runs"), F.sum("true_positive_count").alias("tp"), F.sum("false_positive_count").alias("fp"),
        *[F.coalesce(F.sum(q(t)), F.lit(0)).alias(f"calls_{t}") for t in tools])
