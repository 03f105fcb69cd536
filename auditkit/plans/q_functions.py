"""Queries: scalar functions over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditkit.functions import calls as callfn
from auditkit.functions import dates, encode, numbers, text, vectors
from auditkit.plans.registry import query
from auditkit.plans.run_views import CALL_ARGS, CALL_DEFAULTS, TIERS
from auditkit.plans.views import GRADES

TERMS = ["leak", "ring", "blue", "large", "populated"]


@query("fn_01_month_date", """
  SELECT row_id, CAST(CAST(strptime(issue_d, '%b-%Y') AS DATE) AS VARCHAR) AS issue,
         CAST(CAST(try_strptime(status || issue_d, '%b-%Y') AS DATE) AS VARCHAR) AS unparsed FROM raw_loans""", ("raw_loans",))
def month_date(v):
    return v.heads().select(
        "row_id", dates.month_date(F.col("issue_d")).cast("string").alias("issue"),
        dates.month_date(F.concat("status", "issue_d")).cast("string").alias("unparsed"))


@query("fn_02_year_quarter", """
  SELECT row_id, year(strptime(issue_d, '%b-%Y'))::INTEGER AS year, quarter(strptime(issue_d, '%b-%Y'))::INTEGER AS quarter
  FROM raw_loans""", ("raw_loans",))
def year_quarter(v):
    d = dates.month_date(F.col("issue_d"))
    return v.heads().select("row_id", F.year(d).alias("year"), F.quarter(d).alias("quarter"))


@query("fn_03_history_months", "SELECT row_id, CAST(history_months AS INTEGER) AS history_months FROM parsed", ("parsed",))
def history_months(v):
    return v.parsed().select("row_id", "history_months")


@query("fn_04_term", "SELECT row_id, term FROM parsed", ("parsed",))
def term(v):
    return v.loans().select("row_id", encode.term_months(F.col("term")).alias("term"))


@query("fn_05_ordinal", """
  SELECT row_id, CAST(nullif(instr('ABCDE', grade), 0) AS INTEGER) AS grade,
         CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN 4 END AS INTEGER) AS urgency
  FROM loans""", ("loans",))
def ordinal(v):
    return v.loans().select(
        "row_id", encode.ordinal(F.col("grade"), GRADES).alias("grade"),
        encode.ordinal(F.col("o_orderpriority"), {"1-URGENT": 0, "2-HIGH": 1, "5-LOW": 4}).alias("urgency"))


@query("fn_06_sub_grade", "SELECT row_id, sub_grade FROM parsed", ("parsed",))
def sub_grade(v):
    return v.loans().select("row_id", encode.letter_digit(F.col("sub_grade"), GRADES).alias("sub_grade"))


@query("fn_07_class_ratio", """
  SELECT split, round(sum(1 - label)::DOUBLE / sum(label), 9) AS neg_per_pos FROM loans GROUP BY split""", ("loans",))
def class_ratio(v):
    return v.loans().groupBy("split").agg(F.round(numbers.class_ratio(F.col("label")), 9).alias("neg_per_pos"))


@query("fn_08_rounding", """
  SELECT row_id, round(avg_disc * 100, 4) AS disc_pct, round(o_totalprice / 7, 6) AS a_seventh,
         round_even(n_items / 8.0::DOUBLE, 2) AS eighth_even, round(n_items / 8.0::DOUBLE, 2) AS eighth_up FROM loans""", ("loans",))
def rounding(v):
    eighth = F.col("n_items") / 8.0
    return v.loans().select(
        "row_id", numbers.pct(F.col("avg_disc"), F.lit(1.0)).alias("disc_pct"),
        numbers.r6(F.col("o_totalprice") / 7).alias("a_seventh"),
        F.bround(eighth, 2).alias("eighth_even"), F.round(eighth, 2).alias("eighth_up"))


_TIER_SQL = "CASE " + " ".join(
    f"WHEN contains(lower(p_name), '{p}') THEN '{t}|{lab}|' || substr(p_name, instr(lower(p_name), '{p}'), {len(p)})"
    for t, lab, ps in TIERS for p in ps) + " END"


@query("fn_09_phrase_tier", f"""
  SELECT p_partkey, split_part(hit, '|', 1) AS tier, split_part(hit, '|', 2) AS label, split_part(hit, '|', 3) AS phrase
  FROM (SELECT p_partkey, {_TIER_SQL} AS hit FROM (SELECT p_partkey, upper(p_name) AS p_name FROM part))
  WHERE hit IS NOT NULL""")
def phrase_tier(v):
    hit = text.phrase_tier(F.upper("p_name"), TIERS)
    return (v.table("part").select("p_partkey", hit.alias("h")).filter(F.col("h").isNotNull())
            .select("p_partkey", "h.tier", "h.label", "h.phrase"))


@query("fn_10_derivative_parent", """
  SELECT feature, CASE WHEN ends_with(feature, '_was_missing') THEN replace(feature, '_was_missing', '')
       ELSE regexp_extract(feature, '^(o_orderpriority|c_mktsegment|unseen)_', 1) END AS parent,
       CASE WHEN ends_with(feature, '_was_missing') THEN 'was_missing' ELSE 'one_hot' END AS kind, n
  FROM (SELECT feature, count(*) AS n FROM long GROUP BY feature)
  WHERE ends_with(feature, '_was_missing') OR regexp_matches(feature, '^(o_orderpriority|c_mktsegment|unseen)_')""", ("long",))
def derivative_parent(v):
    per = v.hist().filter(F.col("scope").isin("train", "test")).groupBy("feature").agg(F.sum("n").alias("n"))
    return (per.withColumn("d", text.derivative_parent(F.col("feature"))).filter(F.col("d").isNotNull())
            .select("feature", "d.parent", "d.kind", "n"))


_CONFIG = "concat('tools-', lower(o_orderstatus), case when o_orderkey % 3 = 0 then '' else " \
          "concat('-retrieval-', lower(substr(o_orderpriority, 3))) end, '-v', o_custkey)"


@query("fn_11_retrieval_segment", f"""
  SELECT o_orderkey, CASE WHEN contains(config_id, '-retrieval-')
     THEN regexp_extract(config_id, '-retrieval-(.+)-[^-]*$', 1) END AS segment
  FROM (SELECT o_orderkey, {_CONFIG} AS config_id FROM orders)""")
def retrieval_segment(v):
    return v.table("orders").select("o_orderkey", text.retrieval_segment(F.expr(_CONFIG)).alias("segment"))


@query("fn_12_canonical_form", """
  SELECT tool || '?' || CASE WHEN tool = 'purchase' AND arguments = '{}' THEN 'top_n=20'
      WHEN tool = 'purchase' THEN 'top_n=' || CAST(k AS VARCHAR)
      WHEN tool IN ('view', 'click') THEN 'feature="f' || CAST(k AS VARCHAR) || '"'
      ELSE 'k=' || CAST(k AS VARCHAR) END AS form, count(*) AS n
  FROM calls GROUP BY 1""", ("calls",))
def canonical_form(v):
    form = callfn.canonical_arguments(F.col("tool"), F.col("arguments"), CALL_ARGS, CALL_DEFAULTS)
    return v.calls().groupBy(F.concat(F.col("tool"), F.lit("?"), form).alias("form")).agg(F.count("*").alias("n"))


@query("fn_13_number_tokens")
def number_tokens(v):
    return (v.texts().select("doc_id", F.posexplode(text.number_tokens(F.col("text"))).alias("pos", "t"))
            .select("doc_id", "pos", "t.text", "t.value", "t.decimals"))


@query("fn_14_scientific", "SELECT event_id, printf('%.4e', value) AS figure FROM events")
def scientific(v):
    noted = F.concat(F.format_string("%.4e", F.col("value")), F.lit(" at "), F.col("props"))
    return v.table("events").select("event_id", F.explode(text.scientific(noted)).alias("figure"))


@query("fn_15_token_value", """
  SELECT event_id, round(value, 2) AS value, 2 AS decimals FROM events""")
def token_value(v):
    token = F.concat(F.format_number("value", 2), F.lit("%"))
    return v.table("events").select("event_id", text.token_value(token).alias("value"), text.token_decimals(token)
                                    .alias("decimals"))


@query("fn_16_json_numbers", """
  SELECT event_id, count(*) AS n, round(sum(x), 2) AS total FROM (
    SELECT event_id, CAST(k AS DOUBLE) AS x FROM results_src UNION ALL SELECT event_id, value FROM results_src
    UNION ALL SELECT event_id, round(value, 1) FROM results_src) GROUP BY event_id""", ("results_src",))
def json_numbers(v):
    return (v.results().select("event_id", F.explode(text.json_numbers(F.col("content"))).alias("x"))
            .groupBy("event_id").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("total")))


@query("fn_17_whole_word", """
  SELECT doc_id, regexp_matches(text, '(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)') AS has_the,
         regexp_matches(text, '(^|[^A-Za-z0-9_])de([^A-Za-z0-9_]|$)') AS has_de FROM documents""")
def whole_word(v):
    t = F.col("text")
    return v.table("documents").select("doc_id", text.has_word(t, "the").alias("has_the"), text.has_word(t, "de").alias("has_de"))


@query("fn_18_slug", """
  SELECT page_id, substr(regexp_replace(url, '[^\\p{L}\\p{N}_-]', '-', 'g'), 1, 40) AS slug FROM pages""")
def slug(v):
    return v.table("pages").select("page_id", text.slug(F.col("url")).alias("slug"))


@query("fn_19_cosine", """
  SELECT vec_id, round(1 - list_dot_product(e, c) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(c, c))), 6) + 0.0::DOUBLE
    AS distance
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) v JOIN centroids USING (label)""", ("centroids",))
def cosine(v):
    cents = v.centroids().select("label", F.col("vector").alias("c"))
    return (v.table("embeddings").join(F.broadcast(cents), "label")  # one row per label, checked in the view
            .select("vec_id", F.round(vectors.cosine_distance(F.col("embedding"), F.col("c")), 6).alias("distance")))


@query("fn_20_unit_vector", """
  SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS norm2, round(u[1], 6) + 0.0::DOUBLE AS first FROM (
    SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u
    FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3) AS e FROM embeddings))""")
def unit_vector(v):
    u = vectors.unit(F.transform("embedding", lambda x: x.cast("double") * 3))
    return (v.table("embeddings").select("vec_id", u.alias("u"))
            .select("vec_id", F.round(vectors.dot(F.col("u"), F.col("u")), 6).alias("norm2"),
                    F.round(F.get("u", F.lit(0)), 6).alias("first")))


@query("fn_21_term_lint", """
  SELECT p_partkey, term FROM part, (SELECT unnest(['leak', 'ring', 'blue', 'large', 'populated']) AS term)
  WHERE contains(lower(p_name), term)""")
def term_lint(v):
    return v.table("part").select("p_partkey", F.explode(text.contained(F.col("p_name"), TERMS)).alias("term"))


@query("fn_22_figure", """
  SELECT round(count(*)::DOUBLE, 1) AS train_rows, 0::BIGINT AS unreadable FROM loans WHERE split = 'train'""", ("loans",))
def figure(v):
    note = (v.loans().filter(F.col("split") == "train").agg(F.count("*").alias("n"))
            .select(F.concat(F.lit("train (1996-1998): "), F.format_number("n", 0), F.lit(" rows")).alias("note")))
    got = text.figure(F.col("note"), r"train \(1996-1998\):\s+([\d,]+) rows")
    return note.agg(F.max(got).alias("train_rows"), F.count_if(got.isNull()).alias("unreadable"))
