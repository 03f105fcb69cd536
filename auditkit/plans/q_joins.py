"""Queries: joins and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditkit.operators import align, attribution, metrics, nearest, profile
from auditkit.operators.cumulate import q
from auditkit.plans.registry import query
from auditkit.plans.sqlviews import cte
from auditkit.plans.views import PLAN

SURFACE = ("view", "click", "purchase", "error")


@query("jn_01_attach", """
  SELECT l.split, count(*) AS n, round(sum(l.recoveries), 2) AS planted, sum(m.label)::BIGINT AS bad
  FROM matrix m JOIN loans l ON l.row_id = m.row_id GROUP BY l.split""", ("matrix", "loans"))
def attach(v):
    out = align.attach(v.matrix(), v.raw_loans(), "row_id", "recoveries")
    return out.groupBy("split").agg(F.count("*").alias("n"), F.round(F.sum("recoveries"), 2).alias("planted"),
                                    F.sum("label").cast("long").alias("bad"))


_PROBES = ["o_totalprice", "grade", "sub_grade", "term"]


@query("jn_02_alignment_gate", "\nUNION ALL ".join(
    f"""SELECT '{c}' AS probe, count(*) AS n_rows, count(*) FILTER (abs(m.{c} - p.{c}) > 1e-9) AS n_bad,
    min(m.row_id) FILTER (abs(m.{c} - p.{c}) > 1e-9) AS first_bad FROM matrix m FULL JOIN parsed p ON p.row_id = m.row_id"""
    for c in _PROBES), ("matrix", "parsed"))
def alignment_gate(v):
    keep = [*PLAN.ids, "o_totalprice", "n_items", "acctbal", "late_tax", "mths_since_prev", "term", "grade", "sub_grade"]
    return align.alignment_gate(v.matrix(), v.parsed().select(*keep), ("o_totalprice",), PLAN.ids)


@query("jn_03_label_alignment", """
  SELECT count(*) AS n_rows, count(*) FILTER (m.label IS DISTINCT FROM r.y) AS n_mismatched
  FROM matrix m FULL JOIN (SELECT row_id, CASE WHEN status = 'F' THEN 1 ELSE 0 END AS y FROM loans) r ON r.row_id = m.row_id""",
       ("matrix", "loans"))
def label_alignment(v):
    raw = v.loans().select("row_id", F.when(F.col("status") == "F", 1).otherwise(0).alias("label"))
    return align.label_mismatches(v.matrix(), raw)


@query("jn_04_allowed_names", """
  SELECT tool, tool IN ('view', 'click', 'purchase', 'error') AS on_surface, count(*) AS n FROM calls GROUP BY tool""", ("calls",))
def allowed_names(v):
    per = v.calls().groupBy("tool").agg(F.count("*").alias("n"))
    allowed = v.spark.createDataFrame([(t,) for t in SURFACE], "tool string")
    inside = per.join(F.broadcast(allowed), "tool", "left_semi").withColumn("on_surface", F.lit(True))
    return inside.unionByName(per.join(F.broadcast(allowed), "tool", "left_anti").withColumn("on_surface", F.lit(False)))


@query("jn_05_documented", """
  SELECT 'undocumented' AS side, feature FROM (SELECT DISTINCT feature FROM calls WHERE feature IS NOT NULL)
    WHERE feature NOT IN (SELECT 'f' || p_partkey FROM part WHERE p_partkey % 3 <> 0)
  UNION ALL SELECT 'extra', 'f' || p_partkey FROM part WHERE p_partkey % 3 <> 0
    AND 'f' || p_partkey NOT IN (SELECT feature FROM calls WHERE feature IS NOT NULL)""", ("calls",))
def documented(v):
    entries = v.table("part").filter("p_partkey % 3 <> 0").select(F.concat(F.lit("f"), "p_partkey").alias("feature"))
    used = v.calls().filter(F.col("feature").isNotNull())
    return align.documented(entries, used.filter(F.col("tool") == "view"), used.filter(F.col("tool") == "click"))


cte("cited", (), """
  SELECT user_id AS run, event_id, CAST(floor(value * 10) / 10 AS DOUBLE) AS value, 1 AS decimals FROM events
  UNION ALL SELECT user_id, event_id, CAST(floor(value * 1.5) AS DOUBLE), 0 FROM events""")
cte("bands", ("cited",), """
  SELECT t.run, t.event_id, t.value, t.decimals,
         (SELECT min_by(e.value, (abs(e.value - t.value), e.value)) FROM events e WHERE e.user_id = t.run) AS nearest,
         EXISTS (SELECT 1 FROM events e WHERE e.user_id = t.run
                 AND abs(e.value - t.value) < 0.5::DOUBLE * pow(10.0::DOUBLE, -t.decimals)) AS matched,
         EXISTS (SELECT 1 FROM events e WHERE e.user_id = t.run
                 AND abs(abs(e.value - t.value) - 0.5::DOUBLE * pow(10.0::DOUBLE, -t.decimals))
                     <= 1e-9 * 0.5::DOUBLE * pow(10.0::DOUBLE, -t.decimals))
         AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = t.run
                 AND abs(e.value - t.value) < 0.5::DOUBLE * pow(10.0::DOUBLE, -t.decimals) * (1 - 1e-9)) AS on_tie
  FROM cited t""")


def _cited(v):
    e = v.table("events")
    one = e.select(F.col("user_id").alias("run"), "event_id", (F.floor(F.col("value") * 10) / 10).alias("value"),
                   F.lit(1).alias("decimals"))
    two = e.select(F.col("user_id").alias("run"), "event_id", F.floor(F.col("value") * 1.5).cast("double").alias("value"),
                   F.lit(0).alias("decimals"))
    return one.unionByName(two), e.select(F.col("user_id").alias("run"), F.col("value").alias("x"))


def _bands(v):
    return v._stage("bands", lambda: nearest.band_match(*_cited(v)))


@query("jn_06_band_match", "SELECT run, event_id, value, decimals, nearest, matched FROM bands", ("bands",))
def band_match(v):
    return _bands(v).select("run", "event_id", "value", "decimals", "nearest", "matched")


@query("jn_07_tie_flag", """
  SELECT decimals, count(*) AS cited, count(*) FILTER (matched) AS matched, count(*) FILTER (on_tie) AS on_tie
  FROM bands GROUP BY decimals""", ("bands",))
def tie_flag(v):
    return _bands(v).groupBy("decimals").agg(F.count("*").alias("cited"), F.count_if("matched").alias("matched"),
                                             F.count_if("on_tie").alias("on_tie"))


@query("jn_07_tie_list", """
  SELECT DISTINCT b.run, b.value, b.decimals, e.value AS tie_value FROM bands b JOIN events e ON e.user_id = b.run
    AND abs(abs(e.value - b.value) - 0.5::DOUBLE * pow(10.0::DOUBLE, -b.decimals)) <= 1e-9 * 0.5::DOUBLE * pow(10.0::DOUBLE, -b.decimals)
  WHERE b.on_tie""", ("bands",))
def tie_list(v):
    return nearest.ties(_bands(v), _cited(v)[1])


cte("mapping", ("calls", "results_src"), """
  SELECT coalesce(c.run, r.run) AS run, count(c.tool) AS logged_calls, count(r.tool_use_name) AS result_blocks,
         count(*) FILTER (c.tool IS DISTINCT FROM r.tool_use_name) AS n_bad,
         min(coalesce(c.seq, r.pos)) FILTER (c.tool IS DISTINCT FROM r.tool_use_name) AS first_bad,
         count(*) FILTER (c.tool IS DISTINCT FROM r.tool_use_name) = 0 AS passed
  FROM calls c FULL JOIN results_src r ON r.run = c.run AND r.pos = c.seq GROUP BY 1""")


@query("jn_08_mapping_check", "SELECT * FROM mapping", ("mapping",))
def mapping_check(v):
    return align.mapping_check(v.calls(), v.results())


cte("overall_auc", ("scored",), """
  SELECT (sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0)
         / (sum(label)::DOUBLE * sum(1 - label)) AS auc
  FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM scored
        WHERE split = 'test')""")


@query("jn_09_baseline_delta", """
  SELECT feature, roc_auc, round(roc_auc - auc, 6) + 0.0::DOUBLE AS delta_roc_auc
  FROM (SELECT feature, auc_test AS roc_auc FROM univariate WHERE auc_test IS NOT NULL) CROSS JOIN overall_auc""",
       ("univariate", "overall_auc"))
def baseline_delta(v):
    test = v.scored().filter(F.col("split") == "test")
    base = metrics.auc(metrics.score_histogram(test, ["split"]), ["split"]).select("auc").scalar()
    table = (profile.univariate(v.hist(), ()).filter(F.col("auc_test").isNotNull())
             .select("feature", F.col("auc_test").alias("roc_auc")))
    return table.withColumn("delta_roc_auc", F.round(F.col("roc_auc") - base, 6))


cte("model_rows", ("scored", "scored_ties"), """
  SELECT 'fine' AS model, score, label FROM scored WHERE split = 'test'
  UNION ALL SELECT 'coarse', score, label FROM scored_ties WHERE split = 'test'""")
cte("model_metrics", ("model_rows",), """
  SELECT model, 'brier' AS metric, round(avg((score - label) * (score - label)), 6) AS value FROM model_rows GROUP BY model
  UNION ALL SELECT model, 'roc_auc', round((sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0)
         / (sum(label)::DOUBLE * sum(1 - label)), 6)
    FROM (SELECT *, rank() OVER (PARTITION BY model ORDER BY score)
                    + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS rk FROM model_rows) GROUP BY model
  UNION ALL SELECT model, 'pr_auc', round(sum(pos / p * (tp / (tp + fp))), 6)
    FROM (SELECT model, sum(pos) OVER (PARTITION BY model)::DOUBLE AS p, pos, sum(pos) OVER w::DOUBLE AS tp,
                 sum(neg) OVER w::DOUBLE AS fp
          FROM (SELECT model, score, sum(label) AS pos, sum(1 - label) AS neg FROM model_rows GROUP BY model, score)
          WINDOW w AS (PARTITION BY model ORDER BY score DESC)) GROUP BY model""")


@query("jn_10_model_comparison", """
  SELECT m.model, m.metric, m.value, b.value AS base_value, round(m.value - b.value, 6) + 0.0::DOUBLE AS delta,
         CASE WHEN abs(m.value - b.value) < 0.002 THEN 'negligible' WHEN abs(m.value - b.value) < 0.005 THEN 'small'
              ELSE 'material' END AS weight
  FROM model_metrics m JOIN model_metrics b ON b.metric = m.metric AND b.model = 'fine'""", ("model_metrics",))
def model_comparison(v):
    rows = None
    for name, ties in (("fine", False), ("coarse", True)):
        df = v.scored(ties).filter(F.col("split") == "test").withColumn("model", F.lit(name))
        rows = df if rows is None else rows.unionByName(df)
    hist = metrics.score_histogram(rows, ["model"])
    wide = (metrics.auc(hist, ["model"]).select("model", F.col("auc").alias("roc_auc"))
            .join(metrics.average_precision(hist, ["model"]).withColumnRenamed("average_precision", "pr_auc"), "model")
            .join(rows.groupBy("model").agg(metrics.brier().alias("brier")), "model"))
    names = ["roc_auc", "pr_auc", "brier"]
    long = wide.select("model", *[F.round(c, 6).alias(c) for c in names]).unpivot(["model"], names, "metric", "value")
    return align.compare_models(long, "fine").withColumn("delta", F.round("delta", 6))


@query("jn_11_artefact_lookup", """
  SELECT r.feature, CASE WHEN g.rank <= 10 THEN 'found' WHEN g.feature IS NOT NULL THEN 'not_precomputed' ELSE 'unknown' END
           AS status,
         CASE WHEN g.rank <= 10 THEN u.auc_test END AS roc_auc, c.pct_zero, u.auc_train, u.auc_1996,
         CASE WHEN u.feature IS NOT NULL THEN concat_ws(',', CASE WHEN u.auc_train IS NULL THEN 'the training split' END,
           CASE WHEN u.auc_test IS NULL THEN 'the test split' END, CASE WHEN u.auc_1996 IS NULL THEN '1996' END) END AS undefined
  FROM (SELECT DISTINCT feature FROM long UNION SELECT DISTINCT o_orderpriority FROM orders) r LEFT JOIN shap_global g ON g.feature = r.feature LEFT JOIN univariate u ON u.feature = r.feature
  LEFT JOIN coverage c ON c.feature = r.feature AND c.scope = 'test'""", ("long", "shap_global", "univariate", "coverage"))
def artefact_lookup(v):
    hist = v.hist()
    names = hist.select("feature").distinct().union(
        v.table("orders").select(F.col("o_orderpriority").alias("feature")).distinct())
    assoc = profile.univariate(hist, (1996,))
    top = attribution.global_ranking(v.attributions()).filter("rank <= 10").select("feature")
    ablation = assoc.join(top, "feature", "left_semi").select("feature", F.col("auc_test").alias("roc_auc"))
    cov = profile.coverage(hist).filter(F.col("scope") == "test").select("feature", "pct_zero")
    empty = align.undefined_scopes({"auc_train": "the training split", "auc_test": "the test split", "auc_1996": "1996"})
    shown = assoc.withColumn("undefined", F.array_join(empty, ",")).select("feature", "auc_train", "auc_1996", "undefined")
    return (align.lookup(names, ablation, hist.select("feature")).join(cov, "feature", "left").join(shown, "feature", "left")
            .select("feature", "status", "roc_auc", "pct_zero", "auc_train", "auc_1996", "undefined"))
