"""Metrics over call logs, for all runs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditkit.functions import text
from auditkit.functions.numbers import ratio_or_zero
from auditkit.operators.cumulate import q

# The metrics and their scopes.
METRICS = ("M1", "M3", "M4", "M5", "M6", "M8", "M9", "M10", "M11", "M14", "M16", "M17a", "M17b", "M18")
ALL_REAL = ("M1", "M14")
CANARY_ONLY = ("M18",)
STOP_REASONS = {"max_tokens": "truncated", "refusal": "refusal", "pause_turn": "paused", "stop_sequence": "stop_sequence"}


def clamp(n: Column, most: Column) -> Column:
    """A requested row count brought into 1..most."""
    return F.least(F.greatest(n, F.lit(1)), most)


def share(part: Column, whole: Column) -> Column:
    """A rate that is null, not zero, over nothing."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


# ---------------------------------------------------------------- gates
def canary_present(field: Column, config_id: Column) -> Column:
    """The manifest's own field where it exists, else the suffix of the configuration."""
    return F.coalesce(field, config_id.endswith("-canary"))


def gates(runs: DataFrame, passing: tuple[str, ...], withheld: DataFrame) -> DataFrame:
    """Exactly one row per run and metric: computed, withheld or excluded with its reason.

    ``withheld`` has (run, metric) pairs whose precondition failed.
    """
    segment = text.retrieval_segment(F.col("config_id"))
    valid = segment.isNull() | segment.isin(*passing)
    present = F.coalesce(canary_present(F.col("canary"), F.col("config_id")), F.lit(False))
    m = F.col("metric")
    reason = (F.when(~valid, "validity_precondition_failed").when(F.col("mode") != "REAL", "scope_not_real")
              .when(~m.isin(*ALL_REAL) & ~F.col("is_usable"), "scope_not_usable")
              .when(m.isin(*CANARY_ONLY) & ~present, "scope_not_canary"))
    rows = runs.select("run", F.explode(F.array(*[F.lit(x) for x in METRICS])).alias("metric"),
                       "config_id", "mode", "is_usable", "canary")
    rows = rows.select("run", "metric", reason.alias("gate"))
    out = rows.join(withheld.select("run", "metric", F.lit(True).alias("_w")), ["run", "metric"], "left")
    held = F.col("gate").isNull() & F.coalesce("_w", F.lit(False))
    return out.select("run", "metric",
                      F.when(F.col("gate").isNotNull(), "excluded").when(held, "withheld").otherwise("computed").alias("status"),
                      F.coalesce("gate", F.when(held, "seq_mapping_failed")).alias("reason"))


def refusal_reason() -> Column:
    """Why a run is not scored: a mock, or one that never signalled its end. Null when it is."""
    return F.when(F.col("mode") == "MOCK", "mock").when(~F.col("is_usable"), "not_finished")


def termination(stop: Column, last_calls: Column, made: Column, max_calls: Column, refused: Column) -> Column:
    """How a run ended, from its last reply. Only ``completed`` is usable."""
    out = F.when(refused, "budget_cap")
    for reason, name in STOP_REASONS.items():
        out = out.when(stop == reason, name)
    return (out.when((last_calls > 0) & (made + last_calls > max_calls), "call_limit").when(last_calls > 0, "turn_limit")
            .when(stop == "end_turn", "completed").otherwise("unknown_stop_reason"))


def retrieval_label(calls: DataFrame, runs: DataFrame, backend: str = "backend") -> DataFrame:
    """Which backends served a run's searches: unused, index, fallback or mixed. Two flags per run instead of a set."""
    per = calls.groupBy("run").agg(F.bool_or(q(backend) == "index").alias("i"), F.bool_or(q(backend) == "fallback").alias("f"))
    i, f = F.coalesce("i", F.lit(False)), F.coalesce("f", F.lit(False))
    return runs.select("run").join(per, "run", "left").select(
        "run", F.when(i & f, "mixed").when(i, "index").when(f, "fallback").otherwise("unused").alias("retrieval"))


# ---------------------------------------------------------------- metrics
def calls_per_turn(calls: DataFrame) -> DataFrame:
    """Calls of every tool-bearing turn with the run's count and mean of such turns. Turns without calls have no row."""
    per = calls.groupBy("run", "turn").agg(F.count("*").alias("calls"))
    run = per.groupBy("run").agg(F.count("*").alias("tool_bearing_turns"), F.avg("calls").alias("mean"))
    return per.join(run, "run")


def tool_mix(calls: DataFrame) -> DataFrame:
    """Count and share per tool; the run total is the sum of its few tool counts."""
    per = calls.groupBy("run", "tool").agg(F.count("*").alias("count"))
    total = per.groupBy("run").agg(F.sum("count").alias("total"))
    return per.join(total, "run").select("run", "tool", "count", share(F.col("count"), F.col("total")).alias("share"))


def tool_coverage(calls: DataFrame, runs: DataFrame, surfaces: dict[str, tuple[str, ...]]) -> DataFrame:
    """Distinct tools of the run's surface, their share of the surface, and the names outside it."""
    offered = F.create_map(*[x for v, ts in surfaces.items() for x in (F.lit(v), F.array(*[F.lit(t) for t in ts]))])
    per = calls.select("run", "tool").distinct().join(runs.select("run", "tool_layer_version"), "run")
    inside = F.array_contains(offered[F.col("tool_layer_version")], F.col("tool"))
    got = per.groupBy("run", "tool_layer_version").agg(
        F.count_if(inside).alias("distinct_tool_count"),
        # At most one entry per tool name, and names come from a fixed vocabulary of outcomes.
        F.array_join(F.sort_array(F.collect_set(F.when(~inside, F.col("tool")))), ",").alias("outside"))
    size = F.size(offered[F.col("tool_layer_version")])
    return got.select("run", "distinct_tool_count", size.cast("long").alias("tools_available"),
                      share(F.col("distinct_tool_count"), size).alias("coverage"), "outside")


def rejected(calls: DataFrame, outcomes: tuple[str, ...]) -> DataFrame:
    """Rejected calls per outcome and their rate; an outcome outside the breakdown is counted as unknown, which must be 0."""
    bad = ~F.col("ok")
    return calls.groupBy("run").agg(
        F.count("*").alias("logged_calls"), F.count_if(bad).alias("rejected_calls"),
        share(F.count_if(bad), F.count("*")).alias("rate"),
        *[F.count_if(bad & (F.col("outcome") == o)).alias(o) for o in outcomes],
        F.count_if(bad & ~F.coalesce(F.col("outcome").isin(*outcomes), F.lit(False))).alias("unknown_outcomes"))


def empty_results(calls: DataFrame, outcomes: tuple[str, ...]) -> DataFrame:
    none = F.count_if(F.col("outcome").isin(*outcomes))
    return calls.groupBy("run").agg(F.count("*").alias("logged_calls"), none.alias("no_data"),
                                    share(none, F.count("*")).alias("rate"))


def repeats(calls: DataFrame) -> DataFrame:
    """Calls whose (tool, canonical form) the run has made before: those after the first of their form.

    The first call per form is one small partial aggregate, so a form that a run repeats very often is never gathered.
    """
    first = calls.groupBy("run", "tool", "form").agg(F.min("seq").alias("_first"))
    return calls.join(first, ["run", "tool", "form"]).filter(F.col("seq") > F.col("_first")).drop("_first")


def repeat_counts(calls: DataFrame) -> DataFrame:
    per = calls.groupBy("run", "tool", "form").agg(F.count("*").alias("n"))
    return per.groupBy("run").agg(F.sum("n").alias("logged_calls"), F.sum(F.col("n") - 1).alias("repeat_calls"))


def feature_breadth(calls: DataFrame, matrix_tools: tuple[str, ...]) -> DataFrame:
    """Distinct features asked for: seen in the matrix, only ever not found, or never classified."""
    name = text.strip(F.get_json_object("arguments", "$.feature"))
    asked = calls.withColumn("name", name).filter(F.col("name").isNotNull())
    in_tool = F.col("tool").isin(*matrix_tools)
    per = asked.groupBy("run", "name").agg(
        F.bool_or(in_tool & (F.col("outcome") == "found")).alias("hit"),
        F.bool_or(in_tool & (F.col("outcome") == "not_found")).alias("miss"))
    return per.groupBy("run").agg(
        F.count("*").alias("distinct_features"), F.count_if("hit").alias("in_matrix"),
        F.count_if(~F.col("hit") & F.col("miss")).alias("out_of_matrix"),
        F.count_if(~F.col("hit") & ~F.col("miss")).alias("unclassified"))


def tokens_and_cost(runs: DataFrame, rates: DataFrame) -> DataFrame:
    """Token totals and cost; without a verified rate the cost is withheld, a model without any rate is marked unknown."""
    out = runs.join(F.broadcast(rates), "model", "left")  # one row per model
    cost = (F.col("input_tokens") * F.col("rate_input") + F.col("output_tokens") * F.col("rate_output")) / 1_000_000
    status = (F.when(F.col("rate_input").isNull(), "unknown_model").when(~F.col("verified"), "withheld_rate_unverified")
              .otherwise("derived_rate_verified"))
    return out.select("run", "model", "input_tokens", "output_tokens", F.when(F.col("verified"), cost).alias("cost"),
                      status.alias("cost_status"))


def exposure(calls: DataFrame, results: DataFrame, name: str) -> DataFrame:
    """First result that shows a name, first call that asks for it, and the gap, for every run with calls."""
    asked = text.strip(F.get_json_object("arguments", "$.feature")) == name
    seen = results.filter(text.has_word(F.col("content"), name)).select("run", F.col("pos").alias("e"), F.lit(None).cast("long").alias("i"))
    did = calls.select("run", F.lit(None).cast("long").alias("e"), F.when(asked, F.col("seq")).alias("i"))
    return did.unionByName(seen).groupBy("run").agg(
        F.min("e").alias("exposure_seq"), F.min("i").alias("investigation_seq")).withColumn(
        "gap", F.col("investigation_seq") - F.col("exposure_seq"))


def outcome_label(tool: Column, result: Column, kinds: dict[str, str]) -> Column:
    """One-word outcome of a call from its JSON result. ``kinds`` maps a tool to found, available, or a counted field."""
    out = F.lit("error")
    for t, kind in kinds.items():
        value = F.get_json_object(result, f"$.{kind}")
        if kind == "found":
            label = F.when(value == "true", "found").when(value == "false", "not_found").otherwise("error")
        elif kind == "available":
            label = F.when(value == "true", "available").when(value == "false", "not_available").otherwise("error")
        else:
            label = F.when(value.isNotNull(), F.concat(F.lit(f"{kind}="), value)).otherwise("error")
        out = F.when(tool == t, label).otherwise(out)
    return out


def index_table(runs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row of facts per run with the manifest fields it lacks."""
    lacking = F.array_compact(F.array(*[F.when(q(f).isNull(), F.lit(f)) for f in sorted(fields)]))
    return runs.withColumn("fields_not_in_manifest", F.array_join(lacking, ",")).withColumn(
        "refusal_reason", refusal_reason()).withColumn("scorer_accepted", F.col("refusal_reason").isNull())


def grounded(records: DataFrame, calls: DataFrame, tools: tuple[str, ...]) -> DataFrame:
    """Does each record's evidence name tools, and were all of them called by its run?"""
    named = F.filter(F.array(*[F.when(text.has_word(F.col("evidence"), t), F.lit(t)) for t in tools]), lambda x: x.isNotNull())
    recs = records.select("run", "record", named.alias("named"))
    each = recs.select("run", "record", F.explode_outer("named").alias("tool"))
    called = calls.select("run", "tool").distinct().withColumn("_called", F.lit(True))
    per = each.join(called, ["run", "tool"], "left").groupBy("run", "record").agg(
        F.count("tool").alias("tools_named"), F.count("_called").alias("tools_called"))
    ok = (F.col("tools_named") > 0) & (F.col("tools_named") == F.col("tools_called"))
    reason = F.when(F.col("tools_named") == 0, "no tool named").when(~ok, "named tool not called")
    return per.select("run", "record", "tools_named", ok.alias("grounded"), reason.alias("sub_reason"))
