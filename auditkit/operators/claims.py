"""Claimed sources of cited figures that no tool result explains, checked before they count.

A claim names a source class and gives what that class asks for: a computation with the payload numbers it starts from, a passage of a
result with the call it came from, or a passage of the prompt. Every claim gets null (it holds) or the reason it fails. One failing
claim refuses all claims on its figure, which then stays unmatched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditkit.functions.text import json_strings, number_tokens, strip
from auditkit.operators.nearest import band_match

# The source classes in their order.
CLASSES = ("derived", "quoted", "prompt")
CLAIM = ("token_id", "place", "class", "computation", "source_values", "payload_string", "seq", "prompt_text", "rendered_from_commit")


def figure_in(figure: Column, text: Column) -> Column:
    """The figure stands in the text as written, not inside a longer number."""
    return F.regexp_like(text, F.concat(F.lit(r"(?<![\d.])\Q"), figure, F.lit(r"\E(?!\d|\.\d)")))


def _blank(c: str) -> Column:
    return F.coalesce(strip(F.col(c)) == "", F.lit(True))


def check_claims(tokens: DataFrame, claims: DataFrame, numbers: DataFrame, results: DataFrame, mapping: DataFrame) -> DataFrame:
    """(token_id, place, class, reason) of each claim on a figure of ``tokens`` (token_id, run, text).

    ``claims`` has the columns ``CLAIM``; source_values is an array of texts, each to spell one number that ``numbers`` (run, x) explain.
    ``results`` (run, pos, content) are the tool results in order, ``mapping`` (run, passed) says whether they are the logged calls'. A null
    field is a missing one. Several reasons give the first. Claims on figures that don't exist are left out (``unclaimed``)."""
    asked = claims.select(*CLAIM).join(tokens.select("token_id", "run", F.col("text").alias("figure")), "token_id")

    # Derived: all source values at once, as figures of the same run. A value that spells no number, or two, counts as not explained.
    values = asked.filter("class = 'derived'").select("token_id", "place", "run", F.explode("source_values").alias("spelled"))
    spelled = number_tokens(F.coalesce("spelled", F.lit("")))
    values = values.withColumn("t", spelled).select("token_id", "place", "run", F.when(F.size("t") == 1, F.get("t", F.lit(0))).alias("t"))
    values = values.select("token_id", "place", "run", "t.value", "t.decimals")
    bad = band_match(values, numbers).groupBy("token_id", "place").agg(F.count_if(~F.col("matched")).alias("_unexplained"))

    # Quoted: the one result that the claim points to.
    there = results.select("run", F.col("pos").cast("long").alias("seq"), json_strings(F.col("content")).alias("_strings"))
    size = results.groupBy("run").agg(F.count("*").alias("_results"))
    out = (asked.join(bad, ["token_id", "place"], "left").join(mapping.select("run", F.col("passed").alias("_mapped")), "run", "left")
           .join(size, "run", "left").join(there, ["run", "seq"], "left"))
    held = F.exists("_strings", lambda s: F.contains(s, F.col("payload_string")))

    def lacks(*names: str) -> list:
        return [(F.col(n).isNull(), f"no {n} given") for n in names]

    reasons = {
        "derived": [*lacks("computation", "source_values"), (_blank("computation"), "the computation is empty"),
                    (F.size("source_values") == 0, "no source values given"),
                    (F.col("_unexplained") > 0, "a source value is not a number of this run's results")],
        "quoted": [*lacks("payload_string", "seq"), (~figure_in(F.col("figure"), F.col("payload_string")), "the passage does not contain the figure"),
                   (~F.coalesce("_mapped", F.lit(False)), "results and calls of this run do not correspond"),
                   (~F.col("seq").between(1, F.coalesce("_results", F.lit(0))), "no result at this seq"),
                   (~F.coalesce(held, F.lit(False)), "the passage is not in the result at this seq")],
        "prompt": [*lacks("prompt_text", "rendered_from_commit"), (~figure_in(F.col("figure"), F.col("prompt_text")), "the passage does not contain the figure"),
                   (_blank("rendered_from_commit"), "the commit is empty")]}
    reason = F.when(F.col("class").isNull() | ~F.col("class").isin(*CLASSES), "unknown source class")
    for name, checks in reasons.items():
        for fails, why in checks:
            reason = reason.when((F.col("class") == name) & fails, why)
    return out.select("token_id", "place", "class", reason.alias("reason"))


def adjudicate(tokens: DataFrame, checked: DataFrame) -> DataFrame:
    """``tokens`` (token_id, matched, ...) with classification, applying, reason and refused.

    A matched figure is never reclassified: claims on it are ``refused``. Else the figure has the one class its claims name, or multiply_sourced
    with the classes ``applying`` in their order; a failing claim leaves it unmatched, with the reason of the first that fails."""
    per = checked.groupBy("token_id").agg(F.collect_set("class").alias("_classes"),  # of three
                                          F.min(F.when(F.col("reason").isNotNull(), F.struct("place", "reason"))).alias("_failing"))
    named = F.array_intersect(F.array(*map(F.lit, CLASSES)), F.col("_classes"))
    fair = ~F.col("matched") & F.col("_classes").isNotNull()
    sound = fair & F.col("_failing").isNull()
    cls = F.when(F.col("matched"), "matched").when(sound, F.when(F.size(named) > 1, "multiply_sourced").otherwise(F.get(named, F.lit(0)))).otherwise("unmatched")
    return tokens.join(per, "token_id", "left").select(
        *tokens.columns, cls.alias("classification"), F.when(sound, named).alias("applying"), F.when(fair, F.col("_failing.reason")).alias("reason"),
        (F.col("matched") & F.col("_classes").isNotNull()).alias("refused"))


def unclaimed(tokens: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims on figures that do not exist; any row here is an error."""
    return claims.join(tokens.select("token_id"), "token_id", "left_anti")
