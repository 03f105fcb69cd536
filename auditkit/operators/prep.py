"""Feature preparation: fitted on train as a small table, applied to any split as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditkit.functions import encode
from auditkit.operators.columns import WAS_MISSING, CheckFailed, column_facts, names_where
from auditkit.operators.cumulate import positions, q, quantiles
from auditkit.operators.lookup import look_up
from auditkit.operators.profile import SENTINEL, long_form
from auditkit.sources.staging import materialize


@dataclass(frozen=True)
class Plan:
    """Which policy applies to which column."""

    numeric: tuple[str, ...]
    families: tuple[str, ...]
    ids: tuple[str, ...]
    sentinel_rx: str = "^mths_since_"
    flagged: tuple[str, ...] = ()

    def sentinel(self) -> list[str]:
        return [c for c in self.numeric if re.match(self.sentinel_rx, c)]


@dataclass
class Fitted:
    """What was learned on train: one median per column, the sorted levels of each family, constant columns."""

    plan: Plan
    medians: dict[str, float]
    levels: dict[str, list[str]]
    constant: list[str] = field(default_factory=list)

    def numeric(self) -> list[str]:
        return [c for c in self.plan.numeric if c not in self.constant]

    def features(self) -> list[str]:
        numeric = self.numeric()
        flags = [c + WAS_MISSING for c in numeric if c in self.plan.sentinel() or c in self.plan.flagged]
        dummies = [f"{f}_{lvl}" for f in self.plan.families for lvl in self.levels[f]]
        return [*numeric, *flags, *dummies]

    def table(self, spark) -> DataFrame:
        rows = [(c, "median", None, self.medians[c]) for c in self.numeric() if c not in self.plan.sentinel()]
        rows += [(c, "sentinel", None, float(SENTINEL)) for c in self.plan.sentinel()]
        rows += [(f, "level", lvl, None) for f in self.plan.families for lvl in self.levels[f]]
        rows += [(c, "constant", None, None) for c in self.constant]
        return spark.createDataFrame(rows, "column string, kind string, level string, value double")

    def apply(self, df: DataFrame) -> DataFrame:
        """The feature matrix: ids, then numeric columns without gaps, flags and dummies."""
        sentinel, flagged = self.plan.sentinel(), self.plan.flagged
        cols = [q(c) for c in self.plan.ids]
        for c in self.numeric():
            fill = F.lit(SENTINEL) if c in sentinel else F.lit(self.medians[c])
            cols.append(F.coalesce(q(c), fill).cast("double").alias(c))
        cols += [q(c).isNull().cast("int").alias(c + WAS_MISSING)
                 for c in self.numeric() if c in sentinel or c in flagged]
        cols += [encode.dummy(q(f), lvl).alias(f"{f}_{lvl}") for f in self.plan.families for lvl in self.levels[f]]
        return df.select(*cols)


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, median): exact, over the rows that have a value."""
    hist = (long_form(df, columns, []).filter(F.col("value").isNotNull())
            .groupBy("feature", "value").agg(F.count("*").alias("n")))
    return quantiles(hist, ["feature"], "value", "n", {"median": 0.5})


def levels(df: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """(family, level): distinct levels, null as ``missing``."""
    return (df.select(*[F.coalesce(q(f), F.lit("missing")).alias(f) for f in families])
            .unpivot([], [q(f) for f in families], "family", "level").distinct())


def fit(train: DataFrame, plan: Plan) -> Fitted:
    """Learn the fitted state: one value per column and level. Each level becomes a column, so a family of very many, such as free
    text, is for ``level_table`` and ``sparse_one_hot`` instead."""
    flat = names_where(column_facts(train, list(plan.numeric)), F.col("is_constant"))
    need = [c for c in plan.numeric if c not in plan.sentinel() and c not in flat]
    med = {r["feature"]: r["median"] for r in medians(train, need).collect()}
    by_family: dict[str, list[str]] = {f: [] for f in plan.families}
    for r in levels(train, plan.families).collect():
        by_family[r["family"]].append(r["level"])
    return Fitted(plan, med, {f: sorted(v) for f, v in by_family.items()}, flat)


def level_table(train: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """(family, level, place): the levels of train in the order of family and level, numbered from 0. A written table, of any size."""
    order = F.create_map(*[c for i, f in enumerate(families) for c in (F.lit(f), F.lit(i))])
    found = levels(train, families).withColumn("_family", order[F.col("family")])
    return materialize(positions(found, [], ["_family", "level"], "place").select("family", "level", (F.col("place") - 1).alias("place")), "levels")


def sparse_one_hot(df: DataFrame, table: DataFrame, families: tuple[str, ...], key: str) -> DataFrame:
    """(key, size, indices, values) of each row: the one-hot columns of ``table`` that are 1, as a sparse vector has them.

    Rows take their levels' places by joins with the table, so the plan doesn't grow with the levels. A null is the level ``missing``; a
    level that train doesn't have sets nothing. ``key`` tells rows apart."""
    size = table.count()
    cells = df.select(q(key), *[F.coalesce(q(f).cast("string"), F.lit("missing")).alias(f) for f in families])
    cells = materialize(cells.unpivot([key], [q(f) for f in families], "family", "level"), "cells")
    met = cells.groupBy("family", "level").agg(F.count("*").alias("_rows")).join(table, ["family", "level"], "left")
    placed = look_up(cells, materialize(met, "met"), ["family", "level"], "_rows")
    rows = placed.groupBy(key).agg(F.array_sort(F.collect_list("place")).alias("indices"))  # one for each family at most
    return rows.select(q(key), F.lit(size).cast("long").alias("size"), "indices", F.transform("indices", lambda _: F.lit(1.0)).alias("values"))


def unseen_levels(train: DataFrame, test: DataFrame, families: tuple[str, ...]) -> DataFrame:
    return levels(test, families).join(levels(train, families), ["family", "level"], "left_anti")


def temporal_split(df: DataFrame, time: str, train: tuple[int, ...], test: int) -> tuple[DataFrame, DataFrame]:
    """Train and test by period. A period outside the plan or a missing one stops the split."""
    bad = df.filter(q(time).isNull() | ~q(time).isin(*train, test)).agg(F.count("*")).head()[0]
    if bad:
        raise CheckFailed(f"{bad} rows have no period or one outside the plan")
    return df.filter(q(time).isin(*train)), df.filter(q(time) == test)
