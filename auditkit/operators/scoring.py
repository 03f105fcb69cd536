"""Scoring of flagged columns against a derived answer key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditkit.functions import text
from auditkit.functions.numbers import ratio_or_zero
from auditkit.operators.sets import sides

KNOWN_EARLY = "^(at application|at origination)"
POSITIVE, OUT_OF_SCOPE, HARD = "positive", "out_of_scope", "hard"


def answer_key(dictionary: DataFrame, clause: str, tiers: list[tuple[str, str, list[str]]]) -> DataFrame:
    """(name, set, tier, tier_label, phrase, description) from a dictionary with ``removed`` marks.

    Removed columns known only after the decision are positives, other removed ones out of scope; kept columns whose
    ``populated`` text holds the clause are hard negatives.
    """
    early = F.col("populated").rlike(KNOWN_EARLY)
    kind = (F.when(F.col("removed") & ~early, POSITIVE).when(F.col("removed"), OUT_OF_SCOPE)
            .when(F.contains("populated", F.lit(clause)), HARD))
    hit = F.when(F.col("set") == POSITIVE, text.phrase_tier(F.col("description"), tiers))
    return (dictionary.withColumn("set", kind).filter(F.col("set").isNotNull()).withColumn("hit", hit)
            .select(F.col("feature").alias("name"), "set", F.col("hit.tier").alias("tier"),
                    F.col("hit.label").alias("tier_label"), F.col("hit.phrase").alias("phrase"), "description"))


def tier_counts(key: DataFrame) -> DataFrame:
    """Positives per tier, and those without one as ``clean``."""
    return (key.filter(F.col("set") == POSITIVE).groupBy(F.coalesce("tier", F.lit("clean")).alias("tier"))
            .agg(F.count("*").alias("of_possible")))


def resolve(flags: DataFrame, key: DataFrame) -> DataFrame:
    """Each flag as itself when graded, else as its graded parent: adds scored_as, kind, set, tier."""
    parent = text.derivative_parent(F.col("flag"))
    out = flags.withColumn("_p", parent).withColumns({"_parent": F.col("_p.parent"), "_kind": F.col("_p.kind")}).drop("_p")
    k = key.select("name", "set", "tier")
    own = k.select(F.col("name").alias("flag"), F.col("set").alias("_own_set"), F.col("tier").alias("_own_tier"))
    par = k.select(F.col("name").alias("_parent"), F.col("set").alias("_par_set"), F.col("tier").alias("_par_tier"))
    out = out.join(own, "flag", "left").join(par, "_parent", "left")
    via = F.col("_own_set").isNull() & F.col("_par_set").isNotNull()
    return out.select(*flags.columns, F.when(via, F.col("_parent")).otherwise(F.col("flag")).alias("scored_as"),
                      F.when(via, F.col("_kind")).alias("kind"), F.coalesce("_own_set", "_par_set").alias("set"),
                      F.coalesce("_own_tier", "_par_tier").alias("tier"))


def score(runs: DataFrame, resolved: DataFrame, key: DataFrame) -> DataFrame:
    """One row per run, zeros for a run without flags. Precision counts flags, recall counts distinct positives reached."""
    s = F.col("set")
    # First to (run, name): the two grains of precision and recall come from the same shrunken rows.
    per = resolved.groupBy("run", "scored_as", "set").agg(F.count("*").alias("n"), F.count("kind").alias("via"))
    n, via = F.col("n"), F.col("via")

    def total(cond: Column, what: Column) -> Column:
        return F.sum(F.when(cond, what).otherwise(0))

    hard = s.eqNullSafe(HARD)
    got = per.groupBy("run").agg(
        F.sum(n).alias("flagged_count"), total(~s.eqNullSafe(OUT_OF_SCOPE), n).alias("scored_count"),
        total(s.eqNullSafe(POSITIVE), n).alias("true_positive_count"),
        total(s.eqNullSafe(OUT_OF_SCOPE), n).alias("out_of_scope_count"),
        F.count_if(s.eqNullSafe(POSITIVE)).alias("positives_reached"),
        total(hard, n).alias("hard_negatives_flagged"), total(hard, n - via).alias("hard_negatives_raw"),
        total(hard, via).alias("hard_negatives_via_derivative"), F.count_if(hard).alias("hard_negatives_distinct"))
    counts = got.columns[1:]
    positives = key.filter(s == POSITIVE).agg(F.count("*")).scalar()
    out = runs.select("run").join(got, "run", "left").fillna(0, counts)
    tp = F.col("true_positive_count")
    out = out.withColumns({"false_positive_count": F.col("scored_count") - tp,
                           "false_negative_count": positives - F.col("positives_reached")})
    p, r = ratio_or_zero(tp, F.col("scored_count")), ratio_or_zero(F.col("positives_reached"), positives)
    out = out.withColumns({"_p": p, "_r": r})
    f1 = ratio_or_zero(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r"))
    return out.withColumns({"precision": F.round("_p", 4), "recall": F.round("_r", 4), "f1": F.round(f1, 4)}).drop("_p", "_r")


def by_tier(runs: DataFrame, resolved: DataFrame, key: DataFrame, tiers: tuple[str, ...]) -> DataFrame:
    """True positives per run and tier with how many were possible; every run has every tier."""
    grid = runs.select("run", F.explode(F.array(*[F.lit(t) for t in tiers])).alias("tier"))
    got = resolved.filter(F.col("set") == POSITIVE).groupBy("run", "tier").agg(F.count("*").alias("count"))
    possible = tier_counts(key)
    return (grid.join(got, ["run", "tier"], "left").join(F.broadcast(possible), "tier", "left")  # one row per tier
            .select("run", "tier", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("of_possible", F.lit(0)).alias("of_possible")))


def canary_block(runs: DataFrame, resolved: DataFrame, planted: str) -> DataFrame:
    """Was the planted column caught? Three-valued: no canary in the run and no statement about one are not a miss.

    ``runs`` has (run, canary_present) where null means that nobody said.
    """
    hit = resolved.filter(F.col("scored_as") == planted).select("run").distinct().withColumn("_hit", F.lit(True))
    present = F.col("canary_present")
    caught = F.when(present, F.coalesce("_hit", F.lit(False)))
    return runs.join(hit, "run", "left").select(
        "run", present.alias("applicable"), caught.alias("detected"),
        F.when(present.isNull(), "unknown").when(~present, "not_applicable").when(caught, "caught").otherwise("missed")
        .alias("verdict"))


def canary_from_counts(low: Column, high: Column, without: int) -> Column:
    """Presence from the feature counts a run saw: only ``without`` means absent, only one more means present, else unknown."""
    return F.when((low == without) & (high == without), False).when((low == without + 1) & (high == without + 1), True)


def reachability(resolved: DataFrame, model_columns: DataFrame) -> DataFrame:
    """For every credited flag, whether the audited model read that column. Changes no verdict.

    ``model_columns`` has (run, feature); a run without a list has unknown reachability.
    """
    listed = model_columns.select("run").distinct().withColumn("_known", F.lit(True))
    cols = model_columns.select("run", F.col("feature").alias("scored_as")).distinct().withColumn("_in", F.lit(True))
    tp = resolved.filter(F.col("set") == POSITIVE)
    return (tp.join(listed, "run", "left").join(cols, ["run", "scored_as"], "left")
            .select("run", "flag", "scored_as", F.when(F.col("_known"), F.coalesce("_in", F.lit(False))).alias("reachable")))


def verdicts(resolved: DataFrame) -> DataFrame:
    """true_positive, false_positive or out_of_scope per flag, with the hard-negative mark and the parent it was scored as."""
    s = F.col("set")
    return resolved.select(
        "run", "flag", F.when(s == POSITIVE, "true_positive").when(s == OUT_OF_SCOPE, "out_of_scope")
        .otherwise("false_positive").alias("verdict"), s.eqNullSafe(HARD).alias("hard_negative"),
        F.when(F.col("kind").isNotNull(), F.col("scored_as")).alias("scored_as_parent"))


def compare(scores: DataFrame, pairs: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(run_a, run_b, metric, a, b, delta) for each pair of runs."""
    long = scores.select("run", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        ["run"], list(metrics), "metric", "value")
    a = long.select(F.col("run").alias("run_a"), "metric", F.col("value").alias("a"))
    b = long.select(F.col("run").alias("run_b"), "metric", F.col("value").alias("b"))
    return (pairs.join(a, "run_a").join(b, ["run_b", "metric"])
            .select("run_a", "run_b", "metric", "a", "b", F.round(F.col("b") - F.col("a"), 4).alias("delta")))


def flag_sides(flags: DataFrame, run_a: int, run_b: int) -> DataFrame:
    """Flags only in A, only in B, in both."""
    return sides(flags.filter(F.col("run") == run_a), flags.filter(F.col("run") == run_b), "flag")
