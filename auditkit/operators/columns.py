"""Column selection: drop lists, drop logs, name scans, constant and empty columns, artefact marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditkit.operators.cumulate import q

WAS_MISSING = "_was_missing"


class CheckFailed(ValueError):
    """A precondition of the audit does not hold; results must not be written."""


def schema_report(df: DataFrame) -> DataFrame:
    """(position, column, dtype), from the schema alone: no job runs over the data."""
    rows = [(i, name, dtype) for i, (name, dtype) in enumerate(df.dtypes, 1)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string")


def feature_count(df: DataFrame, id_column: str = "row_id") -> int:
    return len(df.columns) - (id_column in df.columns)


def drop_present(df: DataFrame, groups: dict[str, dict[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Drop the listed columns that exist; return the frame and the log (column, group, reason)."""
    log = [(c, g, why) for g, cols in groups.items() for c, why in cols.items() if c in df.columns]
    kept = df.drop(*[c for c, _, _ in log])
    return kept, df.sparkSession.createDataFrame(log, "column string, group string, reason string")


def drop_families(df: DataFrame, prefixes: tuple[str, ...] = (), suffixes: tuple[str, ...] = ()) -> DataFrame:
    gone = [c for c in df.columns if c.startswith(prefixes) or c.endswith(suffixes)]
    return df.drop(*gone)


def pattern_scan(columns: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """Name-pattern scan over a table with one ``column`` per row: the first matching pattern in order, with its reason."""
    hit = F.coalesce(*[F.when(F.col("column").rlike(rx), F.lit(i)) for i, (rx, _) in enumerate(patterns, 1)])
    why = F.element_at(F.array(*[F.lit(r) for _, r in patterns]), F.col("pattern_no"))
    return (columns.withColumn("pattern_no", hit).filter(F.col("pattern_no").isNotNull())
            .withColumn("reason", why))


def column_facts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: rows, nulls and whether it is constant (null counts as a value), from a single aggregate.

    A column is constant when it is all null, or has no null and equal minimum and maximum; no distinct count is needed.
    """
    aggs = [F.count("*").alias("_rows")]
    for i, c in enumerate(columns):
        aggs += [F.count(q(c)).alias(f"_n{i}"), (F.min(q(c)) == F.max(q(c))).alias(f"_same{i}")]
    one = df.agg(*aggs)
    facts = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col("_rows").alias("n_rows"),
                 (F.col("_rows") - F.col(f"_n{i}")).alias("n_missing"),
                 ((F.col(f"_n{i}") == 0) | (F.coalesce(F.col(f"_same{i}"), F.lit(False))
                                            & (F.col(f"_n{i}") == F.col("_rows")))).alias("is_constant"))
        for i, c in enumerate(columns)])
    return one.select(F.inline(facts))


def names_where(facts: DataFrame, condition: Column) -> list[str]:
    """Column names that satisfy a condition; at most one row per column of the table."""
    return [r[0] for r in facts.filter(condition).select("column").collect()]


def artifact_kind(name: Column, families: tuple[str, ...]) -> Column:
    """``was_missing flag``, ``one-hot dummy`` or null."""
    dummy = F.lit(False)
    for f in families:
        dummy = dummy | name.startswith(f + "_")
    return F.when(name.endswith(WAS_MISSING), "was_missing flag").when(dummy, "one-hot dummy")


def check_aligned(train: DataFrame, test: DataFrame) -> DataFrame:
    """Test columns in train order; both sides must be numeric, complete and hold the same columns."""
    if set(train.columns) != set(test.columns):
        raise CheckFailed(f"columns differ: {sorted(set(train.columns) ^ set(test.columns))}")
    words = [c for c, t in train.dtypes if t in ("string", "boolean", "date", "timestamp")]
    if words:
        raise CheckFailed(f"non-numeric columns left: {words}")
    test = test.select(*[q(c) for c in train.columns])
    for side, df in (("train", train), ("test", test)):
        holes = names_where(column_facts(df, df.columns), F.col("n_missing") > 0)
        if holes:
            raise CheckFailed(f"nulls left in {side}: {holes}")
    return test


def suppress(df: DataFrame, hide_columns: tuple[str, ...] = (), scope_column: str | None = None,
             hide_scopes: tuple[str, ...] = ()) -> DataFrame:
    """Withhold columns and scope rows: they are absent from the result, not blanked."""
    if scope_column and hide_scopes:
        df = df.filter(~F.col(scope_column).isin(*hide_scopes))
    return df.drop(*hide_columns)


def require_fields(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(field, n_missing) for every required field that some row lacks; a field absent from the schema is missing everywhere."""
    counts = F.array(*[
        F.struct(F.lit(f).alias("field"),
                 (F.count_if(F.col(f).isNull()) if f in df.columns else F.count("*")).alias("n_missing"))
        for f in fields])
    return df.agg(counts.alias("_f")).select(F.inline("_f"))


def first_by(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per group with their rank; the window prunes to ``n`` rows per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
