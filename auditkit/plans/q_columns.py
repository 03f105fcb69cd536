"""Queries: projection, filters and column selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditkit.functions import dates, text
from auditkit.operators import attribution, columns, profile
from auditkit.operators.cumulate import q
from auditkit.plans.registry import query
from auditkit.plans.views import KEEP_STATUSES, TEST_VINTAGE, WINDOW

LEAK_DROPS = {"recoveries": "money recovered after the outcome", "last_payment": "describes a payment after the outcome"}
OTHER_DROPS = {"desc": "free text, no values", "status": "source of the label"}
NAME_PATTERNS = [("^small_", "small goods"), ("_ring$", "rings"), ("^red_", "red goods"), ("widget", "widgets")]


@query("prj_01_keep_statuses", "SELECT row_id, status FROM raw_loans WHERE status IN ('F', 'O')", ("raw_loans",))
def keep_statuses(v):
    return v.heads().filter(F.col("status").isin(*KEEP_STATUSES)).select("row_id", "status")


@query("prj_02_keep_years", """SELECT row_id, issue_d FROM raw_loans
   WHERE year(strptime(issue_d, '%b-%Y')) IN (1996, 1997, 1998, 1999)""", ("raw_loans",))
def keep_years(v):
    year = F.year(dates.month_date(F.col("issue_d")))
    return v.heads().filter(year.isin(*WINDOW)).select("row_id", "issue_d")


@query("prj_03_row_funnel", """
  SELECT count(*) AS raw_rows, count(*) FILTER (status IN ('F', 'O')) AS after_status,
         count(*) FILTER (status IN ('F', 'O') AND vintage BETWEEN 1996 AND 1999) AS after_year FROM raw_loans""",
       ("raw_loans",))
def row_funnel(v):
    kept = F.col("status").isin(*KEEP_STATUSES)
    in_window = F.year(dates.month_date(F.col("issue_d"))).isin(*WINDOW)
    return v.heads().agg(F.count("*").alias("raw_rows"), F.count_if(kept).alias("after_status"),
                             F.count_if(kept & in_window).alias("after_year"))


@query("prj_04_target", "SELECT row_id, label AS is_bad FROM loans", ("loans",))
def target(v):
    return v.loans().select("row_id", F.when(F.col("status") == "F", 1).otherwise(0).cast("tinyint").cast("int")
                            .alias("is_bad"))


@query("prj_05_drop_log", """
  SELECT 'recoveries' AS "column", 'leak' AS "group", 'money recovered after the outcome' AS reason,
         count(recoveries) AS n_values FROM loans
  UNION ALL SELECT 'desc', 'other', 'free text, no values', count("desc") FROM loans
  UNION ALL SELECT 'status', 'other', 'source of the label', count(status) FROM loans""", ("loans",))
def drop_log(v):
    df = v.loans()
    _, log = columns.drop_present(df, {"leak": LEAK_DROPS, "other": OTHER_DROPS})
    facts = columns.column_facts(df, ["recoveries", "desc", "status"])
    return log.join(facts, "column").select("column", "group", "reason",
                                            (F.col("n_rows") - F.col("n_missing")).alias("n_values"))


@query("prj_06_name_patterns", """
  WITH names AS (SELECT DISTINCT replace(lower(p_name), ' ', '_') AS "column" FROM part)
  SELECT "column", pattern_no, CASE pattern_no WHEN 1 THEN 'small goods' WHEN 2 THEN 'rings' WHEN 3 THEN 'red goods'
         ELSE 'widgets' END AS reason
  FROM (SELECT "column", CASE WHEN regexp_matches("column", '^small_') THEN 1 WHEN regexp_matches("column", '_ring$') THEN 2
               WHEN regexp_matches("column", '^red_') THEN 3 WHEN regexp_matches("column", 'widget') THEN 4 END AS pattern_no
        FROM names) WHERE pattern_no IS NOT NULL""")
def name_patterns(v):
    names = v.table("part").select(F.regexp_replace(F.lower("p_name"), " ", "_").alias("column")).distinct()
    return columns.pattern_scan(names, NAME_PATTERNS)


_FACTS = ["status", "issue_d", "first_ship_d", "n_items", "acctbal", "late_tax", "mths_since_prev", "desc", "policy_code"]


@query("prj_07_all_null", """
  SELECT col AS "column", n AS n_rows FROM (SELECT count(*) AS n, count("desc") AS k, 'desc' AS col FROM loans
    UNION ALL SELECT count(*), count(late_tax), 'late_tax' FROM loans
    UNION ALL SELECT count(*), count(status), 'status' FROM loans) WHERE k = 0""", ("loans",))
def all_null(v):
    facts = columns.column_facts(v.loans(), _FACTS)
    return facts.filter(F.col("n_missing") == F.col("n_rows")).select("column", "n_rows")


@query("prj_08_drop_families", """
  SELECT feature, round(sum(value), 2) AS total FROM long
  WHERE NOT starts_with(feature, 'c_mktsegment_') AND NOT ends_with(feature, '_was_missing') GROUP BY feature""", ("long",))
def drop_families(v):
    kept = columns.drop_families(v.matrix(), ("c_mktsegment_",), ("_was_missing",))
    features = [c for c in v.features() if c in kept.columns]
    return profile.long_form(kept, features, []).groupBy("feature").agg(F.round(F.sum("value"), 2).alias("total"))


@query("prj_09_zero_variance", """
  SELECT col AS "column", n_missing FROM (
    SELECT 'policy_code' AS col, count(DISTINCT policy_code) + max(CASE WHEN policy_code IS NULL THEN 1 ELSE 0 END) AS u,
           count(*) - count(policy_code) AS n_missing FROM loans WHERE split = 'train'
    UNION ALL SELECT 'desc', count(DISTINCT "desc") + max(CASE WHEN "desc" IS NULL THEN 1 ELSE 0 END),
           count(*) - count("desc") FROM loans WHERE split = 'train'
    UNION ALL SELECT 'late_tax', count(DISTINCT late_tax) + max(CASE WHEN late_tax IS NULL THEN 1 ELSE 0 END),
           count(*) - count(late_tax) FROM loans WHERE split = 'train'
    UNION ALL SELECT 'n_items', count(DISTINCT n_items) + max(CASE WHEN n_items IS NULL THEN 1 ELSE 0 END),
           count(*) - count(n_items) FROM loans WHERE split = 'train') WHERE u <= 1""", ("loans",))
def zero_variance(v):
    facts = columns.column_facts(v.loans().filter(F.col("split") == "train"), _FACTS)
    return facts.filter("is_constant").select("column", "n_missing")


@query("prj_10_aligned_test", """
  SELECT feature, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_missing FROM long WHERE split = 'test' GROUP BY feature""",
       ("long",))
def aligned_test(v):
    feats, m = v.features(), v.matrix()
    train = m.filter(F.col("split") == "train").select(*[q(f) for f in feats])
    test = m.filter(F.col("split") == "test").select(*[q(f) for f in reversed(feats)])
    aligned = columns.check_aligned(train, test)
    return columns.column_facts(aligned, aligned.columns).select(F.col("column").alias("feature"), "n_rows", "n_missing")


@query("prj_11_artifact_kind", """
  SELECT feature, rank, CASE WHEN feature LIKE '%was_missing' THEN 'was_missing flag'
      WHEN starts_with(feature, 'o_orderpriority_') OR starts_with(feature, 'c_mktsegment_')
           OR starts_with(feature, 'unseen_') THEN 'one-hot dummy' END AS kind FROM shap_global""", ("shap_global",))
def artifact_kind(v):
    kind = columns.artifact_kind(F.col("feature"), text.ONE_HOT_FAMILIES)
    return attribution.global_ranking(v.attributions()).select("feature", "rank", kind.alias("kind"))


@query("prj_12_suppressed_coverage", """
  SELECT feature, scope, n_rows, has_missingness_flag, pct_zero, pct_at_999, n_unique, mean, std, p50
  FROM coverage WHERE scope IN ('train', 'test')""", ("coverage",))
def suppressed_coverage(v):
    return columns.suppress(profile.coverage(v.hist()), ("pct_flagged_missing",), "scope", tuple(str(y) for y in WINDOW))


@query("prj_13_required_fields", """
  SELECT 'late_tax' AS field, count(*) - count(late_tax) AS n_missing FROM loans WHERE vintage = 1999
  UNION ALL SELECT 'row_id', count(*) - count(row_id) FROM loans WHERE vintage = 1999
  UNION ALL SELECT 'zip', count(*) FROM loans WHERE vintage = 1999""", ("loans",))
def required_fields(v):
    return columns.require_fields(v.loans().filter(F.col("vintage") == TEST_VINTAGE), ("late_tax", "row_id", "zip"))
