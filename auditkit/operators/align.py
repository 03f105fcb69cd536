"""Joins and alignment: planted columns, row-for-row checks, calls and their results, artefact lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditkit.functions.text import strip
from auditkit.operators.aggregate import column_counts
from auditkit.operators.columns import CheckFailed, column_facts, names_where
from auditkit.operators.cumulate import q
from auditkit.sources.staging import materialize

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
MIN_PROBES, N_PROBES = 4, 6
MATERIAL = ((0.002, "negligible"), (0.005, "small"))


def attach(matrix: DataFrame, lookup: DataFrame, key: str, column: str) -> DataFrame:
    """Add one column by key. Keys of the lookup must be unique and every row must find a value; both are told by one join of the keys."""
    lookup = lookup.select(key, column)
    known = lookup.groupBy(key).agg(F.count("*").alias("_n"), F.first(column).alias("_value"))
    asked = matrix.select(key, F.lit(1).alias("_rows"))
    twice, lost = known.join(asked, key, "full_outer").agg(
        F.coalesce(F.max("_n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("_value").isNull(), F.col("_rows"))), F.lit(0))).head()
    if twice > 1:
        raise CheckFailed(f"{key} is not unique in the lookup")
    if lost:
        raise CheckFailed(f"{lost} rows have no {column}")
    return matrix.join(lookup, key)


# ---------------------------------------------------------------- alignment gate
def pick_probes(matrix: DataFrame, source: DataFrame, preferred: tuple[str, ...] = (), ids: tuple[str, ...] = ("row_id",)
                ) -> list[str]:
    """Columns fit for a row-for-row check: numeric in both tables and never filled in; preferred ones, then the richest."""
    left, right = dict(matrix.dtypes), dict(source.dtypes)
    shared = [c for c in left if c in right and c not in ids and left[c] in NUMERIC and right[c] in NUMERIC]
    whole = names_where(column_facts(source, shared), F.col("n_missing") == 0)
    rich = column_counts(source, whole).orderBy(F.col("n_distinct").desc(), "feature").collect()  # one row per column
    ranked = [c for c in preferred if c in whole] + [r["feature"] for r in rich if r["feature"] not in preferred]
    if len(ranked) < MIN_PROBES:
        raise CheckFailed(f"only {len(ranked)} columns can be compared, at least {MIN_PROBES} are needed")
    return ranked[:N_PROBES]


def compare_rows(matrix: DataFrame, source: DataFrame, probes: list[str], key: str = "row_id", tol: float = 1e-9
                 ) -> DataFrame:
    """Per probe over every row: rows, rows that differ or exist on one side only, and the first such key."""
    whole = ("tinyint", "smallint", "int", "bigint")
    left, right = dict(matrix.dtypes), dict(source.dtypes)
    a = matrix.select(key, *[q(c).alias(f"_a{i}") for i, c in enumerate(probes)], F.lit(True).alias("_in_a"))
    b = source.select(key, *[q(c).alias(f"_b{i}") for i, c in enumerate(probes)], F.lit(True).alias("_in_b"))
    both = a.join(b, key, "full_outer")
    cells = []
    for i, c in enumerate(probes):
        x, y = F.col(f"_a{i}"), F.col(f"_b{i}")
        exact = left[c] in whole and right[c] in whole
        same = x.eqNullSafe(y) if exact else F.coalesce(F.abs(x.cast("double") - y.cast("double")) <= tol,
                                                        x.isNull() & y.isNull())
        bad = F.col("_in_a").isNull() | F.col("_in_b").isNull() | ~same
        cells.append((c, bad))
    one = both.agg(F.count("*").alias("n_rows"),
                   *[F.count_if(bad).alias(f"_n{i}") for i, (_, bad) in enumerate(cells)],
                   *[F.min(F.when(bad, q(key))).alias(f"_f{i}") for i, (_, bad) in enumerate(cells)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("probe"), F.col("n_rows").alias("n_rows"), F.col(f"_n{i}").alias("n_bad"),
                 F.col(f"_f{i}").alias("first_bad")) for i, (c, _) in enumerate(cells)])))


def alignment_gate(matrix: DataFrame, source: DataFrame, preferred: tuple[str, ...] = (), ids: tuple[str, ...] = ("row_id",),
                   key: str = "row_id") -> DataFrame:
    """The comparison of all probes; any differing row stops."""
    checked = materialize(compare_rows(matrix, source, pick_probes(matrix, source, preferred, ids), key), "gate")
    worst = checked.filter("n_bad > 0").head(1)
    if worst:
        raise CheckFailed(f"{worst[0]['probe']}: {worst[0]['n_bad']} rows differ, first {worst[0]['first_bad']}")
    return checked


def label_mismatches(a: DataFrame, b: DataFrame, key: str = "row_id", label: str = "label") -> DataFrame:
    both = a.select(key, q(label).alias("_a")).join(b.select(key, q(label).alias("_b")), key, "full_outer")
    return both.agg(F.count("*").alias("n_rows"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("n_mismatched"))


def documented(dictionary: DataFrame, model: DataFrame, removed: DataFrame, key: str = "feature") -> DataFrame:
    """(side, name): columns the dictionary lacks, and entries that document no column."""
    d = dictionary.select(key).distinct()
    used = model.select(key).union(removed.select(key)).distinct()
    lacking = used.join(d, key, "left_anti").select(F.lit("undocumented").alias("side"), key)
    return lacking.union(d.join(used, key, "left_anti").select(F.lit("extra").alias("side"), key))


# ---------------------------------------------------------------- calls and results
def mapping_check(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Per run: is the k-th result the one of call k? Counts of both sides, positions that disagree, the first of them."""
    a = calls.select("run", F.col("seq").alias("k"), F.col("tool").alias("logged"))
    b = results.select("run", F.col("pos").alias("k"), F.col("tool_use_name").alias("used"))
    both = a.join(b, ["run", "k"], "full_outer")
    bad = ~F.col("logged").eqNullSafe(F.col("used"))
    return both.groupBy("run").agg(
        F.count("logged").alias("logged_calls"), F.count("used").alias("result_blocks"), F.count_if(bad).alias("n_bad"),
        F.min(F.when(bad, F.col("k"))).alias("first_bad")).withColumn("passed", F.col("n_bad") == 0)


# ---------------------------------------------------------------- comparisons and lookups
def materiality(delta: Column) -> Column:
    out = None
    for bound, name in MATERIAL:
        out = F.when(F.abs(delta) < bound, name) if out is None else out.when(F.abs(delta) < bound, name)
    return out.otherwise("material")


def compare_models(metrics: DataFrame, base: str) -> DataFrame:
    """(model, metric, value) against one base model: value, base value, delta and its weight."""
    b = metrics.filter(F.col("model") == base).select("metric", F.col("value").alias("base_value"))
    out = metrics.join(F.broadcast(b), "metric")  # one row per metric
    delta = F.col("value") - F.col("base_value")
    return out.select("model", "metric", "value", "base_value", delta.alias("delta"), materiality(delta).alias("weight"))


def lookup(requests: DataFrame, artefact: DataFrame, known: DataFrame, key: str = "feature") -> DataFrame:
    """Requested names with their artefact row: found, known but not precomputed, or unknown."""
    a = artefact.withColumn("_hit", F.lit(True))
    k = known.select(key).distinct().withColumn("_known", F.lit(True))
    out = requests.select(strip(q(key)).alias(key)).join(a, key, "left").join(k, key, "left")
    status = (F.when(F.col("_hit"), "found").when(F.col("_known"), "not_precomputed").otherwise("unknown"))
    return out.withColumn("status", status).drop("_hit", "_known")


def undefined_scopes(columns: dict[str, str]) -> Column:
    """Labels of the scopes whose figure is null, in order."""
    return F.array_compact(F.array(*[F.when(q(c).isNull(), F.lit(label)) for c, label in columns.items()]))
