"""Queries: aggregations, correlation, metrics from scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditkit.functions import dates, numbers
from auditkit.operators import aggregate, attribution, metrics, prep, profile
from auditkit.operators.columns import WAS_MISSING
from auditkit.plans.registry import query
from auditkit.plans.sqlviews import cte
from auditkit.plans.views import TRAIN_VINTAGES

_VINTAGES = tuple(str(y) for y in TRAIN_VINTAGES)


@query("agg_01_value_counts", """
  SELECT coalesce(first_ship_d, '<missing>') AS value, count(*) AS n,
         round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS pct FROM raw_loans GROUP BY 1""", ("raw_loans",))
def value_counts(v):
    return aggregate.value_counts(v.raw_loans(), "first_ship_d")


@query("agg_02_date_range", """
  SELECT CAST(min(CAST(strptime(issue_d, '%b-%Y') AS DATE)) AS VARCHAR) AS first,
         CAST(max(CAST(strptime(issue_d, '%b-%Y') AS DATE)) AS VARCHAR) AS last, count(*) AS n_rows FROM raw_loans""", ("raw_loans",))
def date_range(v):
    return aggregate.date_range(v.heads(), dates.month_date(F.col("issue_d")).cast("string"))


_COLS = ["row_id", "status", "first_ship_d", "n_items", "qty", "avg_disc", "acctbal", "late_tax", "mths_since_prev", "desc"]


@query("agg_03_most_missing", "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", round((count(*) - count("{c}")) * 100.0::DOUBLE / count(*), 4) AS pct_missing FROM raw_loans"""
    for c in _COLS), ("raw_loans",))
def most_missing(v):
    return aggregate.most_missing(v.raw_loans(), _COLS)


@query("agg_04_vintage_rates", """
  SELECT split, vintage, count(*) AS n, round(avg(label), 6) AS rate,
         round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY split), 4) AS pct_of_split
  FROM loans GROUP BY split, vintage""", ("loans",))
def vintage_rates(v):
    return aggregate.vintage_rates(v.loans(), "split", "vintage", "label").withColumn("rate", F.round("rate", 6))


@query("agg_05_split_rates", """
  SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test,
         round(avg(label) FILTER (split = 'train') * 100, 6) AS train_pct,
         round(avg(label) FILTER (split = 'test') * 100, 6) AS test_pct,
         round(avg(label) FILTER (split = 'test') * 100 - avg(label) FILTER (split = 'train') * 100, 6) AS delta_pp FROM loans""",
       ("loans",))
def split_rates(v):
    df = aggregate.split_rates(v.loans(), "split", "label")
    return df.withColumns({c: F.round(c, 6) for c in ("train_pct", "test_pct", "delta_pp")})


_MED = ["o_totalprice", "n_items", "qty", "avg_disc", "history_months", "acctbal", "late_tax", "term", "grade", "sub_grade"]


@query("agg_06_train_medians", "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(round({c}, 6) AS DOUBLE) AS median FROM medians" for c in _MED), ("medians",))
def train_medians(v):
    df = prep.medians(v.parsed().filter(F.col("split") == "train"), _MED)
    return df.withColumn("median", F.round("median", 6))


_COUNTED = ["n_items", "history_months", "acctbal", "late_tax", "mths_since_prev"]


@query("agg_07_column_counts", "\nUNION ALL ".join(
    f"""SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_distinct, count(*) FILTER ({c} < 0) AS n_negative,
    count(*) - count({c}) AS n_missing FROM parsed""" for c in _COUNTED), ("parsed",))
def column_counts(v):
    return aggregate.column_counts(v.parsed(), _COUNTED)


@query("agg_09_rank_auc", """
  SELECT target, count(*) AS n, sum(y)::BIGINT AS n_pos,
         round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * sum(1 - y)), 6) AS auc
  FROM (SELECT target, y, rank() OVER (PARTITION BY target ORDER BY n_chars)
               + (count(*) OVER (PARTITION BY target, n_chars) - 1) / 2.0 AS rk
        FROM (SELECT 'quality' AS target, quality AS y, n_chars FROM labels JOIN documents USING (doc_id)
              UNION ALL SELECT 'toxic', toxic, n_chars FROM labels JOIN documents USING (doc_id)))
  GROUP BY target""")
def rank_auc(v):
    both = v.table("labels").join(v.table("documents").select("doc_id", "n_chars"), "doc_id")
    long = both.unpivot(["n_chars"], ["quality", "toxic"], "target", "y")
    hist = long.groupBy("target", F.col("n_chars").alias("value")).agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    return profile.rank_auc(hist, ["target"]).withColumn("auc", F.round("auc", 6))


@query("agg_11_correlation", """
  SELECT a.feature, b.feature AS neighbour,
         CASE WHEN isnan(corr(a.value, b.value)) THEN NULL ELSE round(corr(a.value, b.value), 6) + 0.0::DOUBLE END AS r
  FROM (SELECT * FROM long WHERE split = 'test') a JOIN (SELECT * FROM long WHERE split = 'test') b
    ON a.row_id = b.row_id AND a.feature <> b.feature GROUP BY 1, 2""", ("long",))
def correlation(v):
    pairs = profile.correlation(v.matrix().filter(F.col("split") == "test"), v.features())
    return pairs.withColumn("r", F.round("r", 6))


@query("agg_12_shap_global", "SELECT feature, round(mean_abs_shap, 6) AS mean_abs_shap, rank FROM shap_global", ("shap_global",))
def shap_global(v):
    return attribution.global_ranking(v.attributions()).select(
        "feature", F.round("mean_abs_shap", 6).alias("mean_abs_shap"), "rank")


_D6 = ["mean_abs_shap", "share_of_total_abs_shap", "mean_signed_shap", "std", "min", "p1", "p5", "q25", "median", "q75", "p95",
       "p99", "max", "pct_positive", "pct_negative", "pct_near_zero", "top1pct_abs_share"]


@query("agg_13_shap_detail", """
  SELECT feature, rows, """ + ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in _D6) + """
  FROM (SELECT feature, count(*) AS rows, avg(abs(s)) AS mean_abs_shap,
          avg(abs(s)) / sum(avg(abs(s))) OVER () AS share_of_total_abs_shap, avg(s) AS mean_signed_shap, stddev_samp(s) AS std,
          min(s) AS min, quantile_cont(s, 0.01) AS p1, quantile_cont(s, 0.05) AS p5, quantile_cont(s, 0.25) AS q25,
          median(s) AS median, quantile_cont(s, 0.75) AS q75, quantile_cont(s, 0.95) AS p95, quantile_cont(s, 0.99) AS p99,
          max(s) AS max, count(*) FILTER (s > 1e-3::DOUBLE) * 100.0::DOUBLE / count(*) AS pct_positive,
          count(*) FILTER (s < -1e-3::DOUBLE) * 100.0::DOUBLE / count(*) AS pct_negative,
          count(*) FILTER (abs(s) <= 1e-3::DOUBLE) * 100.0::DOUBLE / count(*) AS pct_near_zero,
          coalesce(sum(abs(s)) FILTER (pos <= greatest(1, round_even(n * 0.01::DOUBLE, 0)))
                   / nullif(sum(abs(s)), 0), 0) AS top1pct_abs_share
        FROM (SELECT feature, shap_value AS s, row_number() OVER (PARTITION BY feature ORDER BY abs(shap_value) DESC) AS pos,
                     count(*) OVER (PARTITION BY feature) AS n FROM shap) GROUP BY feature)""", ("shap",))
def shap_detail(v):
    df = attribution.detail(v.attributions())
    return df.select("feature", "rows", *[F.round(c, 6).alias(c) for c in _D6])


@query("agg_14_weighted_mean", """
  SELECT feature, round(sum(n_rows * mean)::DOUBLE / sum(n_rows), 6) + 0.0::DOUBLE AS train_mean FROM coverage
  WHERE scope IN ('1996', '1997', '1998') GROUP BY feature""", ("coverage",))
def weighted_mean(v):
    df = aggregate.weighted_mean(profile.coverage(v.hist()), _VINTAGES)
    return df.withColumn("train_mean", F.round("train_mean", 6))


@query("agg_15_agreed_rows", "SELECT count(*) AS train_rows FROM loans WHERE split = 'train'", ("loans",))
def agreed_rows(v):
    return aggregate.agreed_rows(v.hist(), _VINTAGES, "n")


@query("agg_16_flag_census", """
  SELECT feature, round(avg(value) * 100, 4) AS pct_firing, max(value) = 0 AS dead FROM long
  WHERE split = 'test' AND ends_with(feature, '_was_missing') GROUP BY feature""", ("long",))
def flag_census(v):
    stats = profile.moments(v.hist().filter((F.col("scope") == "test") & F.col("feature").endswith(WAS_MISSING)))
    return stats.select("feature", numbers.pct(F.col("mean"), F.lit(1.0)).alias("pct_firing"),
                        (F.col("n_zero") == F.col("n_rows")).alias("dead"))


_SLICES = {"quarter": "quarter(to_date(try_to_timestamp(issue_d, 'MMM-yyyy')))", "grade": "grade",
           "tax_known": "case when late_tax is null then 'missing' else 'present' end"}
_EXPECTED = [("quarter", str(i)) for i in (1, 2, 3, 4)] + [("grade", g) for g in "ABCDEFG"] + [
    ("tax_known", "missing"), ("tax_known", "present")]


def _slice_sql(drop: str) -> str:
    return f"""
  SELECT e.dimension, e.slice, coalesce(s.n, 0) AS n, round(s.rate, 6) AS rate, round(s.auc, 6) AS auc,
         coalesce(s.n >= 100 AND e.dimension <> 'grade' AND s.auc < o.auc - {drop}::DOUBLE, FALSE) AS finding
  FROM (VALUES {", ".join(f"('{d}', '{x}')" for d, x in _EXPECTED)}) e(dimension, slice)
  LEFT JOIN (SELECT dimension, slice, count(*) AS n, avg(label) AS rate,
        CASE WHEN sum(label) > 0 AND sum(1 - label) > 0 AND count(DISTINCT score) > 1 THEN
          (sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label)::DOUBLE * sum(1 - label))
        END AS auc
      FROM (SELECT *, rank() OVER (PARTITION BY dimension, slice ORDER BY score)
                      + (count(*) OVER (PARTITION BY dimension, slice, score) - 1) / 2.0 AS rk FROM sliced)
      GROUP BY dimension, slice) s ON s.dimension = e.dimension AND s.slice = e.slice
  CROSS JOIN (SELECT (sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0)
                     / (sum(label)::DOUBLE * sum(1 - label)) AS auc
      FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM test_scored)) o"""


cte("test_scored", ("scored_ties",), "SELECT * FROM scored_ties WHERE split = 'test'")
cte("sliced", ("test_scored",), """
  SELECT 'quarter' AS dimension, CAST(quarter(strptime(issue_d, '%b-%Y')) AS VARCHAR) AS slice, label, score FROM test_scored
  UNION ALL SELECT 'grade', grade, label, score FROM test_scored
  UNION ALL SELECT 'tax_known', CASE WHEN late_tax IS NULL THEN 'missing' ELSE 'present' END, label, score FROM test_scored""")


@query("agg_17_slice_auc", _slice_sql("0.005"), ("test_scored", "sliced"))
def slice_auc(v):
    test = v.scored(ties=True).filter(F.col("split") == "test")
    expected = v.spark.createDataFrame(_EXPECTED, "dimension string, slice string")
    df = metrics.slice_auc(test, _SLICES, expected, exempt=("grade",), drop=0.005, min_n=100)
    return df.withColumns({"rate": F.round("rate", 6), "auc": F.round("auc", 6)})


@query("agg_18_confusion", """
  SELECT split, tn, fp, fn, tp, round(p, 6) AS precision, round(r, 6) AS recall,
         round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1
  FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS p,
               CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS r
        FROM (SELECT split, count(*) FILTER (score < 0.5::DOUBLE AND label = 0) AS tn,
                     count(*) FILTER (score >= 0.5::DOUBLE AND label = 0) AS fp,
                     count(*) FILTER (score < 0.5::DOUBLE AND label = 1) AS fn,
                     count(*) FILTER (score >= 0.5::DOUBLE AND label = 1) AS tp FROM scored GROUP BY split))""", ("scored",))
def confusion(v):
    df = metrics.confusion(v.scored(), ["split"])
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


cte("thresholds", ("scored_ties",), """
  SELECT split, score AS threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, pos,
         sum(pos) OVER (PARTITION BY split) AS p, sum(neg) OVER (PARTITION BY split) AS q
  FROM (SELECT split, score, sum(label) AS pos, sum(1 - label) AS neg FROM scored_ties GROUP BY split, score)
  WINDOW w AS (PARTITION BY split ORDER BY score DESC)""")


@query("agg_19_average_precision", """
  SELECT split, round(sum(pos / p::DOUBLE * (tp / (tp + fp)::DOUBLE)), 6) AS average_precision FROM thresholds GROUP BY split""",
       ("thresholds",))
def average_precision(v):
    hist = metrics.score_histogram(v.scored(ties=True), ["split"])
    df = metrics.average_precision(hist, ["split"])
    return df.withColumn("average_precision", F.round("average_precision", 6))


@query("agg_20_brier", """
  SELECT split, round(avg((score - label) * (score - label)), 6) AS brier FROM scored GROUP BY split""", ("scored",))
def brier(v):
    return v.scored().groupBy("split").agg(F.round(metrics.brier(), 6).alias("brier"))


@query("agg_21_curves", """
  SELECT split, threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(fp / q::DOUBLE, 6) AS fpr, round(tp / p::DOUBLE, 6) AS tpr,
         round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / p::DOUBLE, 6) AS recall FROM thresholds""", ("thresholds",))
def curves(v):
    hist = metrics.score_histogram(v.scored(ties=True), ["split"])
    df = metrics.curve(hist, ["split"])
    return df.select("split", "threshold", "tp", "fp",
                     *[F.round(c, 6).alias(c) for c in ("fpr", "tpr", "precision", "recall")])
