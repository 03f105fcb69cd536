"""Checks of returned tables and texts against expected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditkit.functions.text import strip
from auditkit.operators.columns import first_by
from auditkit.operators.cumulate import q

MAX_STDOUT = 1 << 20
# The labels and key sets of the two reply formats.
LABELS = ("answerable", "answerable_with_difference", "not_answerable")
DETECTOR_KEYS = ("calls", "difference_or_missing", "label")
CALL_KEYS = ("arguments", "field", "tool")
SPEC_KEYS = ("data_source", "description", "input_schema", "name")


def tolerance_diff(returned: DataFrame, expected: DataFrame, key: str, value: str, tol: float) -> DataFrame:
    """One row: keys missing and extra, values off by more than ``tol``, the largest miss and its key."""
    a = returned.select(key, q(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = expected.select(key, q(value).alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, key, "full_outer")
    miss = F.abs(F.col("_a") - F.col("_b"))
    over = F.col("_in_a") & F.col("_in_b") & F.coalesce(miss > tol, ~F.col("_a").eqNullSafe(F.col("_b")))
    return both.agg(
        F.count("_in_b").alias("expected"), F.count_if(F.col("_in_a").isNull()).alias("missing"),
        F.count_if(F.col("_in_b").isNull()).alias("extra"), F.count_if(over).alias("over"),
        F.max(F.when(over, miss)).alias("largest_miss"),
        F.max_by(F.when(over, q(key)), F.when(over, F.struct(miss, q(key)))).alias("at_key"))


def ordered_diff(returned: DataFrame, expected: DataFrame, name: str) -> DataFrame:
    """Lists by (position, name): expected entries with ``tied`` false must match in place, the tied tail as a set.

    Entries past the expected end are wrong too. ``extra`` and ``missing`` compare the lists as sets of names, ``duplicates`` counts
    names given again.
    """
    head = expected.select("position", "tied", F.col(name).alias("_want"))
    both = head.join(returned.select("position", F.col(name).alias("_got")), "position", "full_outer")
    off = F.coalesce(~F.col("tied"), F.lit(True)) & ~F.col("_got").eqNullSafe(F.col("_want"))
    wrong = both.agg(F.count_if(off).alias("wrong"), F.min(F.when(off, F.col("position"))).alias("first_wrong"))
    tail = expected.filter("tied")
    placed = returned.join(tail.select("position"), "position", "left_semi").select(name)
    outside = placed.exceptAll(tail.select(name)).agg(F.count("*").alias("tail_outside"))
    got = returned.groupBy(name).agg(F.count("*").alias("_n")).join(expected.select(name).distinct().withColumn("_in", F.lit(True)), name, "full_outer")
    sets = got.agg(F.count_if(F.col("_in").isNull()).alias("extra"), F.count_if(F.col("_n").isNull()).alias("missing"),
                   F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))
    return wrong.join(outside).join(sets)  # three frames of one row


def rule_diff(returned: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, returned, expected, rule, ok): exact for ``int``, within ``tol`` for ``abs``, within ``tol * |expected|`` for ``rel``."""
    got, want, tol = F.col("returned"), F.col("expected"), F.col("tol")
    both = expected.join(returned, key, "left")
    off = F.abs(got - want)
    ok = (F.when(F.col("rule") == "int", got == want).when(F.col("rule") == "abs", off <= tol).otherwise(off <= tol * F.abs(want)))
    return both.select(key, "returned", "expected", "rule", F.coalesce(ok, F.lit(False)).alias("ok"))


def top_rows_check(submitted: DataFrame, long: DataFrame, n: int) -> DataFrame:
    """Per feature, is (position, row_id, value) the n largest signed values of the source?

    Size, distinct ids, ids and values of the source, non-increasing order, and the same multiset of values. Ordering
    windows hold n submitted rows; the source's own top n is pruned per task before it is shuffled.
    """
    w = Window.partitionBy("feature").orderBy("position")
    src = long.select("feature", "row_id", F.col("shap_value").alias("_src"))
    rows = submitted.withColumn("_prev", F.lag("value").over(w)).join(src, ["feature", "row_id"], "left")
    per = rows.groupBy("feature").agg(
        (F.count("*") == n).alias("size_ok"), (F.count_distinct("row_id") == F.count("*")).alias("ids_distinct"),
        F.count_if(F.col("_src").isNull()).alias("unknown_ids"), F.count_if(F.col("_src") != F.col("value")).alias("wrong_values"),
        (F.count_if(F.col("_prev") < F.col("value")) == 0).alias("ordered"))
    best = first_by(src, ["feature"], [F.col("_src").desc(), F.col("row_id")], n).groupBy("feature", F.col("_src").alias("value")).agg(
        F.count("*").alias("_want"))
    have = submitted.groupBy("feature", "value").agg(F.count("*").alias("_have"))
    same = best.join(have, ["feature", "value"], "full_outer").groupBy("feature").agg(
        (F.count_if(~F.col("_want").eqNullSafe(F.col("_have"))) == 0).alias("is_true_top"))
    return per.join(same, "feature", "left")


def reconcile(facts: DataFrame, recorded: DataFrame, key: str = "fact") -> DataFrame:
    """Facts read from artefacts against recorded constants; a recorded fact that was not found is not ok."""
    return recorded.join(facts, key, "left").withColumn("ok", F.col("found").eqNullSafe(F.col("recorded")))


def outcome(timed_out: Column, oom: Column, exit_code: Column, stdout: Column, shape_ok: Column, right: Column) -> Column:
    """The first class that applies to a run of a check."""
    return (F.when(timed_out, "timeout").when(oom, "memory_limit").when(exit_code != 0, "crashed")
            .when(strip(F.coalesce(stdout, F.lit(""))) == "", "bad_output").when(F.octet_length(stdout) > MAX_STDOUT, "bad_output")
            .when(~is_object(stdout), "bad_output").when(~shape_ok, "bad_output").when(~right, "wrong_answer").otherwise("pass"))


def stability(observations: DataFrame, case: str) -> DataFrame:
    """Per case: runs, whether they share one outcome, and whether all passed."""
    return observations.groupBy(case).agg(
        F.count("*").alias("runs"), (F.min("outcome") == F.max("outcome")).alias("stable"),
        F.bool_and(F.col("outcome") == "pass").alias("passed"))


# ---------------------------------------------------------------- JSON replies
def sole_value(text: Column) -> Column:
    """The one JSON value of a text as a variant; null when there is none, or more than one.

    The parser ignores what follows the first value, so the text is read inside brackets and inside braces: text that
    closes the one early is invalid in the other.
    """
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    member = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull()
    return F.when(member & (F.size(items) == 1), F.get(items, F.lit(0)))


def is_object(text: Column) -> Column:
    """Exactly one JSON object, with only blanks around it."""
    return F.coalesce(_kind_of(sole_value(text)) == "{", F.lit(False))


def _kind_of(v: Column) -> Column:
    """First character of the value as JSON: ``{``, ``[``, ``"``, ``n`` for null."""
    return F.substring(F.to_json(v), 1, 1)


def _kind(v: Column, path: str) -> Column:
    return F.coalesce(_kind_of(F.try_variant_get(v, path, "variant")), F.lit(""))


def _keys(v: Column) -> Column:
    return F.sort_array(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))


def _is(keys: Column, names: tuple[str, ...]) -> Column:
    return keys == F.array(*[F.lit(n) for n in sorted(names)])


def _text(v: Column, path: str) -> Column:
    """A text that is not blank."""
    return (_kind(v, path) == '"') & (strip(F.try_variant_get(v, path, "string")) != "")


def _parsed(df: DataFrame, text: str) -> DataFrame:
    """Adds the parsed reply once, so that the checks below do not parse it again: _v, _object, _keys."""
    return (df.withColumn("_v", sole_value(F.col(text)))
            .withColumns({"_object": F.coalesce(_kind_of(F.col("_v")) == "{", F.lit(False)), "_keys": _keys(F.col("_v")), "_blank": F.coalesce(strip(q(text)) == "", F.lit(True))}))


def detector_errors(df: DataFrame, text: str, tools: tuple[str, ...], name: str = "detector_error") -> DataFrame:
    """Adds what is wrong with a detector reply, the first fault found; null when it is as specified."""
    v = F.col("_v")
    rows = _parsed(df, text).withColumns({
        "_label": F.try_variant_get(v, "$.label", "string"), "_label_kind": _kind(v, "$.label"),
        "_calls_kind": _kind(v, "$.calls"), "_dom": _kind(v, "$.difference_or_missing"),
        "_calls": F.transform(F.try_variant_get(v, "$.calls", "array<variant>"), lambda c: F.struct(
            (_kind_of(c) == "{").alias("object"), _is(_keys(c), CALL_KEYS).alias("keys"),
            ((_kind(c, "$.tool") == '"') & F.try_variant_get(c, "$.tool", "string").isin(*tools)).alias("tool"),
            (_kind(c, "$.arguments") == "{").alias("arguments"), _text(c, "$.field").alias("field")))})

    def some_lacks(part: str) -> Column:
        return ~F.forall("_calls", lambda c: F.coalesce(c[part], F.lit(False)))

    label, dom = F.col("_label"), F.col("_dom")
    error = (F.when(F.col("_blank"), "no_text").when(~F.col("_object"), "not_one_object")
             .when(~_is(F.col("_keys"), DETECTOR_KEYS), "wrong_keys")
             .when((F.col("_label_kind") != '"') | ~label.isin(*LABELS), "bad_label")
             .when((F.col("_calls_kind") != "[") | (F.size("_calls") == 0), "no_calls")
             .when(some_lacks("object"), "call_not_object").when(some_lacks("keys"), "call_keys")
             .when(some_lacks("tool"), "unknown_tool").when(some_lacks("arguments"), "arguments_not_object")
             .when(some_lacks("field"), "empty_field").when((label == "answerable") & (dom != "n"), "needs_null")
             .when((label != "answerable") & ~_text(v, "$.difference_or_missing"), "needs_text"))
    return rows.select(*df.columns, error.alias(name))


def spec_errors(df: DataFrame, text: str, name: str = "spec_error") -> DataFrame:
    """Adds what is wrong with a spec reply: it is either one ``decline`` text or one complete ``spec``."""
    v, keys = F.col("_v"), F.col("_keys")
    rows = _parsed(df, text).withColumn("_spec", F.try_variant_get(v, "$.spec", "variant"))
    spec, declines = F.col("_spec"), _is(keys, ("decline",))
    bad_text = ~(_text(spec, "$.name") & _text(spec, "$.description") & _text(spec, "$.data_source"))
    error = (F.when(F.col("_blank"), "no_text").when(~F.col("_object"), "not_one_object")
             .when(declines & ~_text(v, "$.decline"), "empty_decline").when(declines, None)
             .when(~_is(keys, ("spec",)), "wrong_keys").when((_kind(v, "$.spec") != "{"), "spec_not_object")
             .when(~_is(_keys(spec), SPEC_KEYS), "spec_keys").when(bad_text, "empty_text")
             .when((_kind(spec, "$.input_schema") != "{"), "schema_not_object"))
    return rows.select(*df.columns, error.alias(name))
