"""Samples, shuffled sheets, best trials, extreme cases, running spend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditkit.operators.columns import first_by
from auditkit.operators.cumulate import cumulate, positions, q
from auditkit.sources.staging import materialize

#: Digits of the draw that a pass looks further, and rows about the threshold that are ordered in one task.
_DIGITS, _EDGE = 3, 10_000


def draw(seed: int, key: Column) -> Column:
    """A fixed pseudo-random text per key and seed; ordering by it is a seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def seeded_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows without replacement, the same for the same seed; all rows if there are fewer, none for n below 1.

    Rows are taken in the order of their draw. Counting draws by their first digits, then by more digits where the n-th row
    lies, finds the threshold: rows below it are a filter, whatever their number, and only the few about it are ordered. Rows that repeat
    one key share a draw; if the threshold falls among very many of them, as many as are wanted are taken.
    """
    drawn = df.withColumn("_draw", draw(seed, q(key)))
    edge, wanted, size = "", n, None
    while size is None or (size > _EDGE and len(edge) < 32):
        digits = F.substring("_draw", 1, len(edge) + _DIGITS)
        counts = sorted((r[0], r[1]) for r in drawn.filter(F.startswith("_draw", F.lit(edge))).groupBy(digits).agg(F.count("*")).collect())  # at most 16^3 rows
        for prefix, size in counts:
            if size > wanted:
                edge = prefix
                break
            wanted -= size
        else:
            return df if n > 0 else df.limit(0)
    below = drawn.filter(F.col("_draw") < edge)
    about = drawn.filter(F.startswith("_draw", F.lit(edge)))
    if size <= _EDGE:
        about = about.orderBy("_draw", q(key)).limit(max(wanted, 0))
    else:
        numbered = materialize(about.withColumn("_at", F.monotonically_increasing_id()), "alike")
        about = positions(numbered, [], ["_at"], "_pos").filter(F.col("_pos") <= wanted).drop("_at", "_pos")
    return below.unionByName(about).drop("_draw")


def review_sheet(items: DataFrame, key: str, seed: int) -> DataFrame:
    """Items in seeded order with positions 1..n; nothing in the sheet maps a position back to its source."""
    d = draw(seed, q(key))
    shuffled = items.withColumn("_at", F.conv(F.substring(d, 1, 15), 16, 10).cast("long")).withColumn("_draw", d)
    return positions(shuffled, [], ["_at", "_draw"], "position").drop("_at", "_draw", key)


def best_trial(trials: DataFrame) -> DataFrame:
    """The completed trial of the highest value with the number of trials that share it; anything but 1 is an error upstream."""
    done = trials.filter(F.col("state") == "COMPLETE")
    per_value = done.groupBy("value").agg(F.count("*").alias("holders"), F.min_by(F.struct("*"), "number").alias("t"))
    return per_value.agg(F.max_by(F.struct("holders", "t"), "value").alias("b")).select("b.holders", "b.t.*")


def extreme_cases(scored: DataFrame, key: str = "row_id") -> DataFrame:
    """(case, key, score, label): surest true positive, surest false positive, nearest to 0.5; ties by key.

    A case that no row fits has no row."""
    row = F.struct(q(key), F.col("score"), F.col("label"))

    def at(counts: Column, order: Column) -> Column:
        return F.min_by(row, F.when(counts & order.isNotNull(), F.struct(order, q(key))))

    y = F.col("label")
    one = scored.agg(
        at(y == 1, -F.col("score")).alias("confident_correct"), at(y == 0, -F.col("score")).alias("confident_wrong"),
        at(F.lit(True), F.abs(F.col("score") - 0.5)).alias("borderline"))
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("case"), F.col(f"{c}.{key}").alias(key), F.col(f"{c}.score").alias("score"),
                 F.col(f"{c}.label").alias("label")) for c in one.columns]))).filter(q(key).isNotNull())


def case_attributions(cases: DataFrame, long: DataFrame, n: int = 3, key: str = "row_id") -> DataFrame:
    """The n attributions of largest size for each case."""
    joined = long.join(F.broadcast(cases), key)  # three rows
    return first_by(joined, ["case"], [F.abs("shap_value").desc(), F.col("feature")], n)


# ---------------------------------------------------------------- spend
def cost_usd(rates: DataFrame, usage: DataFrame) -> DataFrame:
    """Cost of every request; a model without rates gives null, which ``running_spend`` refuses."""
    out = usage.join(F.broadcast(rates), "model", "left")  # one row per model
    cost = (F.col("input") * F.col("rate_input") + F.col("cache_creation") * F.col("rate_cache_write")
            + F.col("cache_read") * F.col("rate_cache_read") + F.col("output") * F.col("rate_output")) / 1_000_000
    worst = ((F.col("input") + F.col("cache_creation") + F.col("cache_read")) * F.col("rate_cache_write")
             + F.col("max_tokens") * F.col("rate_output")) / 1_000_000
    return out.withColumns({"cost": cost, "worst_case": worst}).drop(*[c for c in rates.columns if c != "model"])


def running_spend(costed: DataFrame, order: str, cap: float) -> DataFrame:
    """Spend before and after every request and whether its worst case would pass the cap."""
    out = cumulate(costed, [], [order], ["cost"])
    spent = F.col("cost_before")
    return out.withColumns({"cumulative": spent + F.col("cost"),
                            "over_cap": F.coalesce(spent + F.col("worst_case") > cap, F.lit(True))})


def first_refused(spend: DataFrame, order: str) -> DataFrame:
    return (spend.filter("over_cap").agg(F.min_by(F.struct("*"), order).alias("r"))
            .filter(F.col("r").isNotNull()).select("r.*"))
