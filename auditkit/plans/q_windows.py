"""Queries: ranking, samples, spend, exposure, sets, feature preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditkit.functions import encode, text
from auditkit.operators import attribution, columns, prep, profile, ranked, runs, sets
from auditkit.plans.registry import query
from auditkit.plans.run_views import key_members
from auditkit.plans.sqlviews import cte
from auditkit.plans.views import (FIT_VINTAGES, GRADES, PLAN, SEGMENTS, TEST_VINTAGE, TRAIN_VINTAGES, VAL_VINTAGE)

SEED = 42

cte("pairs", ("long",), """
  SELECT a.feature, b.feature AS neighbour,
         CASE WHEN isnan(corr(a.value, b.value)) THEN NULL ELSE corr(a.value, b.value) END AS r
  FROM (SELECT * FROM long WHERE split = 'test') a JOIN (SELECT * FROM long WHERE split = 'test') b
    ON a.row_id = b.row_id AND a.feature <> b.feature GROUP BY 1, 2""")
cte("near", ("pairs",), """
  SELECT f.feature, coalesce(n.rank, 1) AS rank, n.neighbour, round(n.r, 6) + 0.0::DOUBLE AS pearson_r,
         round(abs(n.r), 6) AS abs_pearson_r
  FROM (SELECT DISTINCT feature FROM pairs) f
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(abs(r), 12) DESC, neighbour) AS rank
             FROM pairs WHERE r IS NOT NULL) n ON n.feature = f.feature AND n.rank <= 15""")


@query("wn_01_neighbours", "SELECT * FROM near", ("near",))
def neighbours(v):
    pairs = profile.correlation(v.matrix().filter(F.col("split") == "test"), v.features())
    return profile.neighbours(pairs)


@query("wn_02_top_n", """
  SELECT DISTINCT c.k AS top_n, least(greatest(c.k, 1), t.n)::BIGINT AS returned, g.feature AS last_feature, c.k > 15 AS clamped,
         least(greatest(c.k, 1), 15)::BIGINT AS neighbours
  FROM calls c CROSS JOIN (SELECT count(*) AS n FROM shap_global) t
  JOIN shap_global g ON g.rank = least(greatest(c.k, 1), t.n) WHERE c.tool = 'purchase'""", ("calls", "shap_global"))
def top_n(v):
    ranking = attribution.global_ranking(v.attributions())
    total = ranking.agg(F.count("*")).scalar()
    asked = v.calls().filter(F.col("tool") == "purchase").select(F.col("k").alias("top_n")).distinct()
    clamp = runs.clamp(F.col("top_n"), total)
    asked = asked.withColumn("returned", clamp.cast("long")).withColumn("clamped", F.col("top_n") > 15)
    asked = asked.withColumn("neighbours", runs.clamp(F.col("top_n"), F.lit(15)).cast("long"))
    last = ranking.select(F.col("rank").cast("long").alias("returned"), F.col("feature").alias("last_feature"))
    return asked.join(last, "returned")


@query("wn_03_top_rows", """
  SELECT row_id, round(shap_value, 6) + 0.0::DOUBLE AS shap_value FROM (
    SELECT row_id, shap_value FROM shap WHERE feature = 'acctbal' ORDER BY shap_value DESC, row_id LIMIT 50)""", ("shap",))
def top_rows(v):
    _, rows = attribution.top_rows(v.attributions(), "acctbal", 50)
    return rows.select("row_id", F.round("shap_value", 6).alias("shap_value"))


@query("wn_04_full_ranking", "SELECT rank AS position, feature FROM shap_global", ("shap_global",))
def full_ranking(v):
    return attribution.global_ranking(v.attributions()).select(F.col("rank").alias("position"), "feature")


@query("wn_05_best_trial", """
  SELECT number, value, depth, holders FROM (
    SELECT c_custkey AS number, c_acctbal AS value, c_nationkey AS depth, count(*) OVER (PARTITION BY c_acctbal) AS holders
    FROM customer WHERE c_mktsegment <> 'BUILDING') ORDER BY value DESC, number LIMIT 1""")
def best_trial(v):
    trials = v.table("customer").select(
        F.col("c_custkey").alias("number"), F.col("c_acctbal").alias("value"), F.col("c_nationkey").alias("depth"),
        F.when(F.col("c_mktsegment") == "BUILDING", "FAIL").otherwise("COMPLETE").alias("state"))
    return ranked.best_trial(trials).select("number", "value", "depth", "holders")


cte("cases", ("scored",), """
  SELECT * FROM (SELECT 'confident_correct' AS "case", row_id, score, label FROM scored WHERE split = 'test' AND label = 1
                 ORDER BY score DESC, row_id LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'confident_wrong', row_id, score, label FROM scored WHERE split = 'test' AND label = 0
                 ORDER BY score DESC, row_id LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'borderline', row_id, score, label FROM scored WHERE split = 'test'
                 ORDER BY abs(score - 0.5::DOUBLE), row_id LIMIT 1)""")


@query("wn_06_extreme_cases", """
  SELECT "case", row_id, score, label, feature, rank, round(shap_value, 6) + 0.0::DOUBLE AS shap_value FROM (
    SELECT c.*, s.feature, s.shap_value, row_number() OVER (PARTITION BY "case" ORDER BY abs(shap_value) DESC, s.feature) AS rank
    FROM cases c JOIN shap s ON s.row_id = c.row_id) WHERE rank <= 3""", ("cases", "shap"))
def extreme_cases(v):
    cases = ranked.extreme_cases(v.scored().filter(F.col("split") == "test"))
    top = ranked.case_attributions(cases, v.attributions())
    return top.select("case", "row_id", "score", "label", "feature", "rank", F.round("shap_value", 6).alias("shap_value"))


cte("forms", ("calls",), """
  SELECT run, seq, tool, CASE WHEN tool = 'purchase' AND arguments = '{}' THEN '20' ELSE CAST(k AS VARCHAR) END AS form FROM calls""")
cte("repeats", ("forms",), """
  SELECT run, seq, tool FROM (SELECT *, row_number() OVER (PARTITION BY run, tool, form ORDER BY seq) AS n FROM forms) WHERE n > 1""")


@query("wn_07_repeat_calls", "SELECT * FROM repeats", ("repeats",))
def repeat_calls(v):
    return runs.repeats(v.canonical_calls()).select("run", "seq", "tool")


_RATES = [("model-a", 2.0, 2.5, 0.2, 10.0)]
CAP = 15.0


def _spend(v):
    e = v.table("events")
    cents = F.round(F.col("value") * 100).cast("long")
    usage = e.select("event_id", F.lit("model-a").alias("model"), (cents * 3).alias("input"), cents.alias("cache_creation"),
                     (cents * 2).alias("cache_read"), (cents % 500).alias("output"), F.lit(2000).alias("max_tokens"))
    rates = v.spark.createDataFrame(
        _RATES, "model string, rate_input double, rate_cache_write double, rate_cache_read double, rate_output double")
    return ranked.running_spend(ranked.cost_usd(rates, usage), "event_id", CAP)


cte("spend", (), """
  SELECT event_id, cost, sum(cost) OVER (ORDER BY event_id) AS cumulative,
         sum(cost) OVER (ORDER BY event_id) - cost + (c * 6 * 2.5::DOUBLE + 2000 * 10) / 1000000 > 15 AS over_cap
  FROM (SELECT event_id, c, (c * 3 * 2.0::DOUBLE + c * 2.5::DOUBLE + c * 2 * 0.2::DOUBLE + (c % 500) * 10.0::DOUBLE) / 1000000 AS cost
        FROM (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS c FROM events))""")


@query("wn_08_running_spend", """
  SELECT event_id, round(cost, 7) AS cost, round(cumulative, 7) AS cumulative, over_cap FROM spend""", ("spend",))
def running_spend(v):
    return _spend(v).select("event_id", F.round("cost", 7).alias("cost"), F.round("cumulative", 7).alias("cumulative"), "over_cap")


cte("exposure", ("calls", "results_src"), """
  SELECT r.run, e.exposure_seq, i.investigation_seq, i.investigation_seq - e.exposure_seq AS gap
  FROM (SELECT DISTINCT run FROM calls) r
  LEFT JOIN (SELECT run, min(pos) AS exposure_seq FROM results_src WHERE k = 9 GROUP BY run) e ON e.run = r.run
  LEFT JOIN (SELECT run, min(seq) AS investigation_seq FROM calls WHERE feature = 'f9' GROUP BY run) i ON i.run = r.run""")


@query("wn_09_exposure_gap", "SELECT * FROM exposure", ("exposure",))
def exposure_gap(v):
    return runs.exposure(v.calls(), v.results(), "f9")


@query("wn_10_seeded_sample", """
  SELECT row_id FROM (SELECT row_id FROM loans WHERE split = 'test' ORDER BY md5('42|' || CAST(row_id AS VARCHAR)), row_id LIMIT 400)""",
       ("loans",))
def seeded_sample(v):
    return ranked.seeded_sample(v.loans().filter(F.col("split") == "test"), "row_id", SEED, 400).select("row_id")


@query("wn_11_review_sheet", """
  SELECT row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR))) AS position, lang, n_chars
  FROM documents JOIN labels USING (doc_id) WHERE quality = 0""")
def review_sheet(v):
    bad = v.table("labels").filter("quality = 0").select("doc_id")
    items = v.table("documents").join(bad, "doc_id").select("doc_id", "lang", "n_chars")
    return ranked.review_sheet(items, "doc_id", SEED)


@query("wn_12_severity", """
  SELECT feature, rank, kind, CASE WHEN kind IS NULL THEN NULL WHEN rank <= 10 THEN 'finding' ELSE 'watch' END AS severity,
         feature IN ('grade', 'sub_grade', 'term', 'o_totalprice') AND rank <= 10 AS core_in_top10
  FROM (SELECT *, CASE WHEN ends_with(feature, '_was_missing') THEN 'was_missing flag'
               WHEN regexp_matches(feature, '^(o_orderpriority|c_mktsegment|unseen)_') THEN 'one-hot dummy' END AS kind
        FROM shap_global) WHERE rank <= 20""", ("shap_global",))
def severity(v):
    kind = columns.artifact_kind(F.col("feature"), text.ONE_HOT_FAMILIES)
    ranking = attribution.global_ranking(v.attributions())
    return attribution.severity(ranking, kind, ("grade", "sub_grade", "term", "o_totalprice")).drop("mean_abs_shap")


# ---------------------------------------------------------------- sets
@query("set_01_union", """
  SELECT CAST(vintage AS VARCHAR) AS part, count(*) AS n FROM loans GROUP BY vintage""", ("loans",))
def union(v):
    raw = v.raw_loans().filter(F.col("status").isin("F", "O"))
    parts = [raw.filter(F.col("vintage") == y) for y in (*TRAIN_VINTAGES, TEST_VINTAGE)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(F.col("vintage").cast("string").alias("part")).agg(F.count("*").alias("n"))


@query("set_02_sides", """
  SELECT flag, CASE WHEN bool_or(a) AND bool_or(b) THEN 'both' WHEN bool_or(a) THEN 'only_a' ELSE 'only_b' END AS side
  FROM (SELECT feature AS flag, tool = 'view' AS a, tool = 'click' AS b FROM calls
        WHERE feature IS NOT NULL AND outcome = 'not_found') GROUP BY flag""", ("calls",))
def set_sides(v):
    missing = v.calls().filter((F.col("outcome") == "not_found") & F.col("feature").isNotNull()).withColumnRenamed("feature", "flag")
    return sets.sides(missing.filter("tool = 'view'"), missing.filter("tool = 'click'"), "flag")


cte("flags", ("calls",), """
  SELECT run, seq AS pos, CASE WHEN value < 10 THEN ' ' ELSE '' END
         || CASE WHEN k % 10 = 7 THEN 'f' || k || '_was_missing' WHEN k % 10 = 8 THEN 'unseen_' || k ELSE 'f' || k END AS flag
  FROM calls WHERE tool = 'view'
  UNION ALL SELECT run, seq, '  ' FROM calls WHERE tool = 'view' AND value < 1""")
cte("clean_flags", ("flags",), "SELECT run, trim(flag) AS flag, min(pos) AS pos FROM flags WHERE trim(flag) <> '' GROUP BY 1, 2")


@query("set_03_clean_flags", "SELECT * FROM clean_flags", ("clean_flags",))
def clean_flags(v):
    return sets.clean_flags(v.flags())


@query("set_04_key_rules", """
  SELECT 'positive and hard are disjoint' AS rule, count(*) AS violations FROM answer_key WHERE positive AND hard
  UNION ALL SELECT 'positive and out_of_scope are disjoint', count(*) FROM answer_key WHERE positive AND out_of_scope
  UNION ALL SELECT 'positive lies inside removed', count(*) FROM answer_key WHERE positive AND NOT removed
  UNION ALL SELECT 'hard lies inside model', count(*) FROM answer_key WHERE hard AND removed
  UNION ALL SELECT 'residual and clean cover positive', count(*) FROM answer_key
    WHERE positive AND NOT (tier IS NOT NULL OR tier IS NULL)""", ("answer_key",))
def key_rules(v):
    return sets.key_rules(key_members(v), [("positive", "hard"), ("positive", "out_of_scope")],
                          [("positive", "removed"), ("hard", "model")], [("positive", ("residual", "clean"))])


@query("set_05_unseen_levels", """
  SELECT 'unseen' AS family, unseen AS level FROM loans WHERE split = 'test' GROUP BY unseen
  HAVING unseen NOT IN (SELECT unseen FROM loans WHERE split = 'train')""", ("loans",))
def unseen_levels(v):
    loans = v.loans()
    return prep.unseen_levels(loans.filter("split = 'train'"), loans.filter("split = 'test'"), PLAN.families)


# ---------------------------------------------------------------- feature preparation
@query("fe_01_temporal_split", """
  SELECT split, count(*) AS n, min(row_id) AS first_row, max(row_id) AS last_row FROM loans GROUP BY split""", ("loans",))
def temporal_split(v):
    train, test = prep.temporal_split(v.loans().drop("split"), "vintage", TRAIN_VINTAGES, TEST_VINTAGE)
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.groupBy("split").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


@query("fe_02_validation_fold", """
  SELECT CASE WHEN vintage = 1998 THEN 'val' ELSE 'fit' END AS fold, count(*) AS n, round(avg(label), 6) AS rate
  FROM loans WHERE split = 'train' GROUP BY 1""", ("loans",))
def validation_fold(v):
    fit, val = prep.temporal_split(v.loans().filter("split = 'train'"), "vintage", FIT_VINTAGES, VAL_VINTAGE)
    both = fit.withColumn("fold", F.lit("fit")).unionByName(val.withColumn("fold", F.lit("val")))
    return both.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg("label"), 6).alias("rate"))


def _matrix_query(name: str, cols: list[str]):
    shown = ", ".join(f'"{c}"' for c in cols)

    @query(name, f"SELECT row_id, {shown} FROM matrix", ("matrix",))
    def run(v):
        return v.matrix().select("row_id", *[f"`{c}`" for c in cols])

    return run


fe_03 = _matrix_query("fe_03_sentinel", ["mths_since_prev", "mths_since_prev_was_missing"])
fe_04 = _matrix_query("fe_04_median_flag", ["acctbal", "acctbal_was_missing", "late_tax", "late_tax_was_missing"])
fe_05 = _matrix_query("fe_05_median", ["n_items", "qty", "avg_disc", "history_months"])
fe_06 = _matrix_query("fe_06_one_hot", [f"unseen_{s}" for s in SEGMENTS])


cte("family_levels", ("loans",), """
  SELECT row_id, split, unnest(['o_orderpriority', 'c_mktsegment', 'unseen']) AS family,
    coalesce(unnest([o_orderpriority, c_mktsegment, unseen]), 'missing') AS level FROM loans""")
cte("numbered_levels", ("family_levels",), f"""
  SELECT family, level, row_number() OVER (ORDER BY list_position({list(PLAN.families)!r}, family), level) - 1 AS place
  FROM (SELECT DISTINCT family, level FROM family_levels WHERE split = 'train')""")


@query("fe_06_sparse_one_hot", """
  SELECT f.row_id, (SELECT count(*) FROM numbered_levels) AS size, coalesce(string_agg(CAST(n.place AS VARCHAR), ',' ORDER BY n.place), '') AS places
  FROM family_levels f LEFT JOIN numbered_levels n ON n.family = f.family AND n.level = f.level WHERE f.split = 'test' GROUP BY f.row_id""",
       ("family_levels", "numbered_levels"))
def sparse_one_hot(v):
    """The one-hot columns of the three families by their numbers, with the level that only test has setting none."""
    parsed = v.parsed()
    table = prep.level_table(parsed.filter("split = 'train'"), PLAN.families)
    rows = prep.sparse_one_hot(parsed.filter("split = 'test'"), table, PLAN.families, "row_id")
    return rows.select("row_id", "size", F.array_join(F.col("indices").cast("array<string>"), ",").alias("places"))


@query("fe_07_standardised", """
  SELECT feature, round(avg(z), 6) + 0.0::DOUBLE AS mean, round(stddev_samp(z), 6) AS std FROM (
    SELECT l.feature, l.split, (l.value - m.mu) / m.sd AS z FROM long l
    JOIN (SELECT feature, avg(value) AS mu, stddev_samp(value) AS sd FROM long WHERE split = 'train' GROUP BY feature
          HAVING stddev_samp(value) > 0) m ON m.feature = l.feature) WHERE split = 'test'
    AND feature IN ('o_totalprice', 'qty', 'acctbal', 'grade') GROUP BY feature""", ("long",))
def standardised(v):
    from auditkit.operators import model
    names = ["o_totalprice", "qty", "acctbal", "grade"]
    scaled = model.standardise(v.matrix().filter("split = 'train'"), v.matrix().filter("split = 'test'"), names)
    return profile.long_form(scaled, names, []).groupBy("feature").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"))


@query("fe_08_round_trip", """
  SELECT feature, count(*) AS cells, 0::BIGINT AS only_wide, 0::BIGINT AS only_long, 0::BIGINT AS different
  FROM shap GROUP BY feature""", ("shap",))
def round_trip(v):
    return attribution.round_trip(v.attributions_wide(), v.attributions())
