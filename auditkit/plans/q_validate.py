"""Queries: validation of returned tables and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditkit.functions.numbers import r6
from auditkit.operators import attribution, profile, validate
from auditkit.operators.columns import first_by
from auditkit.operators.cumulate import positions
from auditkit.plans.registry import query
from auditkit.plans.sqlviews import cte
from auditkit.sources.staging import spread

TOP = 10


@query("va_01_tolerance_diff", """
  SELECT count(*) AS expected, 0::BIGINT AS missing, 0::BIGINT AS extra, count(*) FILTER (miss > 1e-4) AS over,
         round(max(miss) FILTER (miss > 1e-4), 6) AS largest_miss, arg_max(feature, (miss, feature)) FILTER (miss > 1e-4) AS at_key
  FROM (SELECT feature, abs(avg(mean) FILTER (scope IN ('1996', '1997', '1998')) - max(mean) FILTER (scope = 'train')) AS miss
        FROM coverage GROUP BY feature)""", ("coverage",))
def tolerance_diff(v):
    cov = profile.totals(v.hist()).select("scope", "feature", r6(F.col("mean")).alias("mean"))
    plain = cov.filter(F.col("scope").isin("1996", "1997", "1998")).groupBy("feature").agg(F.avg("mean").alias("mean"))
    out = validate.tolerance_diff(plain, cov.filter("scope = 'train'"), "feature", "mean", 1e-4)
    return out.withColumn("largest_miss", F.round("largest_miss", 6))


@query("va_02_ordered_diff", """
  SELECT count(*) FILTER (NOT tied AND s.feature IS DISTINCT FROM g.feature) AS wrong,
         min(g.rank) FILTER (NOT tied AND s.feature IS DISTINCT FROM g.feature)::INTEGER AS first_wrong,
         count(*) FILTER (tied AND s.feature NOT IN (SELECT feature FROM shap_global WHERE round(mean_abs_shap, 12) = 0)) AS tail_outside,
         (SELECT count(*) FROM (SELECT feature FROM shap EXCEPT SELECT feature FROM shap_global)) AS extra,
         (SELECT count(*) FROM (SELECT feature FROM shap_global EXCEPT SELECT feature FROM shap)) AS missing, 0::BIGINT AS duplicates
  FROM (SELECT *, round(mean_abs_shap, 12) = 0 AS tied FROM shap_global) g
  FULL JOIN (SELECT feature, row_number() OVER (ORDER BY round(avg(shap_value), 12) DESC, feature) AS rank FROM shap GROUP BY feature) s
    ON s.rank = g.rank""", ("shap_global", "shap"))
def ordered_diff(v):
    long = v.attributions()
    want = attribution.global_ranking(long).select(F.col("rank").alias("position"), "feature",
                                                   (F.round("mean_abs_shap", 12) == 0).alias("tied"))
    signed = long.groupBy("feature").agg((-F.round(F.avg("shap_value"), 12)).alias("down"))
    got = positions(signed, [], ["down", "feature"], "position").select(F.col("position").cast("int").alias("position"), "feature")
    return validate.ordered_diff(got, want, "feature")


cte("rules", (), """
  SELECT c_custkey, c_acctbal + CASE c_custkey % 4 WHEN 1 THEN 1e-9 WHEN 2 THEN 1 WHEN 3 THEN 1e-3 ELSE 0 END::DOUBLE AS returned,
         c_acctbal AS expected, CASE c_custkey % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'abs' ELSE 'rel' END AS rule, 1e-6::DOUBLE AS tol
  FROM customer""")


@query("va_03_rule_diff", """
  SELECT rule, count(*) AS n, count(*) FILTER (CASE rule WHEN 'int' THEN returned = expected WHEN 'abs' THEN abs(returned - expected) <= tol
         ELSE abs(returned - expected) <= tol * abs(expected) END) AS ok FROM rules GROUP BY rule""", ("rules",))
def rule_diff(v):
    c = v.table("customer")
    k = F.col("c_custkey")
    shift = F.when(k % 4 == 1, 1e-9).when(k % 4 == 2, 1.0).when(k % 4 == 3, 1e-3).otherwise(0.0)
    got = c.select("c_custkey", (F.col("c_acctbal") + shift).alias("returned"))
    want = c.select("c_custkey", F.col("c_acctbal").alias("expected"),
                    F.when(k % 3 == 0, "int").when(k % 3 == 1, "abs").otherwise("rel").alias("rule"), F.lit(1e-6).alias("tol"))
    return validate.rule_diff(got, want, "c_custkey").groupBy("rule").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"))


cte("submitted", ("shap",), """
  SELECT feature, row_id, shap_value AS value, pos AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY feature ORDER BY abs(shap_value) DESC, row_id) AS pos FROM shap) WHERE pos <= 10""")


@query("va_04_top_rows_check", """
  SELECT s.feature, count(*) = 10 AS size_ok, count(DISTINCT row_id) = count(*) AS ids_distinct, 0::BIGINT AS unknown_ids,
         0::BIGINT AS wrong_values, count(*) FILTER (prev < value) = 0 AS ordered, list_sort(list(value)) = max(t.best) AS is_true_top
  FROM (SELECT *, lag(value) OVER (PARTITION BY feature ORDER BY position) AS prev FROM submitted) s
  JOIN (SELECT feature, list_sort(list(shap_value)) AS best FROM (
          SELECT *, row_number() OVER (PARTITION BY feature ORDER BY shap_value DESC, row_id) AS pos FROM shap) WHERE pos <= 10
        GROUP BY feature) t ON t.feature = s.feature GROUP BY s.feature""", ("submitted", "shap"))
def top_rows_check(v):
    long = v.attributions()
    sub = first_by(long, ["feature"], [F.abs("shap_value").desc(), F.col("row_id")], TOP, "position").withColumnRenamed("shap_value", "value")
    return validate.top_rows_check(sub, long, TOP)


@query("va_05_reconcile", """
  SELECT * FROM (SELECT 'train rows' AS fact, count(*) AS recorded, count(*) AS found, TRUE AS ok FROM loans WHERE split = 'train'
  UNION ALL SELECT 'test rows', count(*), count(*) + 1, FALSE FROM loans WHERE split = 'test'
  UNION ALL SELECT 'orders', count(*), NULL, FALSE FROM orders)""", ("loans",))
def reconcile(v):
    per = v.hist().filter("feature = 'grade' AND scope IN ('train', 'test')").groupBy("scope").agg(F.sum("n").alias("n"))
    found = per.select(F.concat("scope", F.lit(" rows")).alias("fact"), (F.col("n") + F.when(F.col("scope") == "test", 1).otherwise(0)).alias("found"))
    loans = v.loans().groupBy("split").agg(F.count("*").alias("recorded")).select(F.concat("split", F.lit(" rows")).alias("fact"), "recorded")
    recorded = loans.unionByName(v.table("orders").agg(F.count("*").alias("recorded")).select(F.lit("orders").alias("fact"), "recorded"))
    return validate.reconcile(found, recorded)


cte("observations", (), """
  SELECT event_id, user_id, k, CASE WHEN value > 200 THEN 'timeout' WHEN k = 5 THEN 'memory_limit' WHEN k % 7 = 3 THEN 'crashed'
      WHEN k % 11 IN (0, 1, 2) THEN 'bad_output' WHEN value < 40 THEN 'wrong_answer' ELSE 'pass' END AS outcome
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)""")


def observations(v):
    k = F.get_json_object("props", "$.k").cast("int")
    stdout = F.when(k % 11 == 0, " ").when(k % 11 == 1, "[1]").otherwise(F.col("props"))
    cls = validate.outcome(F.col("value") > 200, k == 5, F.when(k % 7 == 3, 1).otherwise(0), stdout, k % 11 != 2, F.col("value") >= 40)
    return v.table("events").select("event_id", "user_id", k.alias("k"), cls.alias("outcome"))


@query("va_06_outcome_class", "SELECT event_id, outcome FROM observations", ("observations",))
def outcome_class(v):
    return observations(v).select("event_id", "outcome")


_REPLIES = [
    (None, '{"label": "answerable", "calls": [{"tool": "view", "arguments": {"k": %d}, "field": "x"}], "difference_or_missing": null}'),
    (None, ' {"difference_or_missing": "no scope %d", "label": "not_answerable", "calls": [{"tool": "click", "arguments": {}, "field": "y"}]}'),
    ("not_one_object", '[%d]'), ("not_one_object", '{"label": %d'), ("no_text", '  '),
    ("wrong_keys", '{"label": "answerable", "calls": [], "extra": %d}'),
    ("bad_label", '{"label": %d, "calls": [], "difference_or_missing": null}'),
    ("no_calls", '{"label": "answerable", "calls": [], "difference_or_missing": %d}'),
    ("call_not_object", '{"label": "answerable", "calls": [%d], "difference_or_missing": null}'),
    ("call_keys", '{"label": "answerable", "calls": [{"tool": "view", "arguments": %d}], "difference_or_missing": null}'),
    ("unknown_tool", '{"label": "answerable", "calls": [{"tool": "t%d", "arguments": {}, "field": "x"}], "difference_or_missing": null}'),
    ("arguments_not_object", '{"label": "answerable", "calls": [{"tool": "view", "arguments": %d, "field": "x"}], "difference_or_missing": null}'),
    ("empty_field", '{"label": "answerable", "calls": [{"tool": "view", "arguments": {"k": %d}, "field": " "}], "difference_or_missing": null}'),
    ("needs_null", '{"label": "answerable", "calls": [{"tool": "view", "arguments": {"k": %d}, "field": "x"}], "difference_or_missing": "d"}'),
    ("needs_text", '{"label": "not_answerable", "calls": [{"tool": "view", "arguments": {"k": %d}, "field": "x"}], "difference_or_missing": ""}'),
    ("not_one_object", '{"label": %d} and more')]
_SPECS = [
    (None, '{"decline": "no need %d"}'), ("empty_decline", '{"decline": %d}'), ("wrong_keys", '{"spec": {}, "decline": %d}'),
    ("spec_not_object", '{"spec": %d}'), ("spec_keys", '{"spec": {"name": "n%d"}}'),
    ("empty_text", '{"spec": {"name": "n%d", "description": "", "input_schema": {}, "data_source": "t"}}'),
    ("schema_not_object", '{"spec": {"name": "n", "description": "d", "input_schema": %d, "data_source": "t"}}'),
    (None, '{"spec": {"name": "n%d", "description": "d", "input_schema": {}, "data_source": "t"}}')]


def _case_sql(rows) -> str:
    return f"CASE event_id % {len(rows)} " + " ".join(
        f"WHEN {i} THEN {'NULL' if e is None else repr(e)}" for i, (e, _) in enumerate(rows)) + " END"


def _reply(rows):
    texts = F.array(*[F.lit(t) for _, t in rows])
    return F.replace(F.get(texts, (F.col("event_id") % len(rows)).cast("int")), F.lit("%d"), F.col("event_id").cast("string"))


@query("va_07_reply_shape", f"""
  SELECT event_id, {_case_sql(_REPLIES)} AS detector_error, {_case_sql(_SPECS)} AS spec_error FROM events""")
def reply_shape(v):
    rows = spread(v.table("events").select("event_id")).select("event_id", _reply(_REPLIES).alias("d"), _reply(_SPECS).alias("s"))
    rows = validate.spec_errors(validate.detector_errors(rows, "d", ("view", "click")), "s")
    return rows.select("event_id", "detector_error", "spec_error")


@query("va_08_stability", """
  SELECT user_id, k, count(*) AS runs, count(DISTINCT outcome) = 1 AS stable, bool_and(outcome = 'pass') AS passed
  FROM observations GROUP BY user_id, k""", ("observations",))
def stability(v):
    obs = observations(v).withColumn("case", F.struct("user_id", "k"))
    return validate.stability(obs, "case").select("case.user_id", "case.k", "runs", "stable", "passed")
