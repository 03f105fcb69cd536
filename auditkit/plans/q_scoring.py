"""Queries: flag scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditkit.operators import findings, runs, scoring
from auditkit.plans.registry import query
from auditkit.plans.sqlviews import cte

PLANTED = "f9"
_COUNTS = ["flagged_count", "scored_count", "true_positive_count", "false_positive_count", "false_negative_count",
           "out_of_scope_count"]


def present(v):
    """(run, canary_present): the manifest's field, else the configuration's suffix, else unknown for runs without scopes."""
    known = runs.canary_present(F.col("canary"), F.col("config_id"))
    return v.runs().select("run", F.when(F.col("scopes").isNotNull(), known).alias("canary_present"))


@query("sc_01_answer_key", """
  SELECT feature AS name, "set", tier FROM answer_key""", ("answer_key",))
def answer_key(v):
    return v.answer_key().select("name", "set", "tier")


@query("sc_02_tier_counts", """
  SELECT coalesce(tier, 'clean') AS tier, count(*) AS of_possible FROM answer_key WHERE positive GROUP BY 1""", ("answer_key",))
def tier_counts(v):
    return scoring.tier_counts(v.answer_key())


@query("sc_03_resolve", 'SELECT run, flag, pos, scored_as, kind, "set", tier FROM resolved', ("resolved",))
def resolve(v):
    return v.resolved()


@query("sc_04_score", f"SELECT run, {', '.join(_COUNTS)}, precision, recall, f1 FROM run_scores", ("run_scores",))
def score(v):
    return v.scores().select("run", *_COUNTS, "precision", "recall", "f1")


_HARD = ["hard_negatives_flagged", "hard_negatives_raw", "hard_negatives_via_derivative", "hard_negatives_distinct"]


@query("sc_05_hard_negatives", f"SELECT run, {', '.join(_HARD)} FROM run_scores", ("run_scores",))
def hard_negatives(v):
    return v.scores().select("run", *_HARD)


@query("sc_06_by_tier", """
  SELECT u.run, t.tier, count(r.flag) AS count, max(p.n) AS of_possible
  FROM runs u CROSS JOIN (VALUES ('A'), ('B'), ('C')) t(tier)
  JOIN (SELECT x.tier, count(k.feature) AS n FROM (VALUES ('A'), ('B'), ('C')) x(tier)
        LEFT JOIN answer_key k ON k.tier = x.tier GROUP BY x.tier) p ON p.tier = t.tier
  LEFT JOIN resolved r ON r.run = u.run AND r.tier = t.tier AND r."set" = 'positive' GROUP BY u.run, t.tier""",
       ("runs", "resolved", "answer_key"))
def by_tier(v):
    return scoring.by_tier(v.runs(), v.resolved(), v.answer_key(), ("A", "B", "C"))


cte("present", ("runs",), """
  SELECT run, CASE WHEN scopes IS NOT NULL THEN coalesce(canary, ends_with(config_id, '-canary')) END AS canary_present FROM runs""")


@query("sc_07_canary_block", """
  SELECT p.run, canary_present AS applicable, CASE WHEN canary_present THEN h.run IS NOT NULL END AS detected,
         CASE WHEN canary_present IS NULL THEN 'unknown' WHEN NOT canary_present THEN 'not_applicable'
              WHEN h.run IS NOT NULL THEN 'caught' ELSE 'missed' END AS verdict
  FROM present p LEFT JOIN (SELECT DISTINCT run FROM resolved WHERE scored_as = 'f9') h ON h.run = p.run""", ("present", "resolved"))
def canary_block(v):
    return scoring.canary_block(present(v), v.resolved(), PLANTED)


@query("sc_08_canary_attribution", """
  SELECT r.run, coalesce(canary, ends_with(config_id, '-canary')) AS present,
         CASE WHEN canary IS NULL THEN 'derived' ELSE 'field' END AS source,
         CASE WHEN c.lo = 180 AND c.hi = 180 THEN FALSE WHEN c.lo = 181 AND c.hi = 181 THEN TRUE END AS from_counts
  FROM runs r LEFT JOIN (SELECT run, 180 + min(k % 2) AS lo, 180 + max(k % 2) AS hi FROM calls WHERE value > 150 GROUP BY run) c
    ON c.run = r.run""", ("runs", "calls"))
def canary_attribution(v):
    seen = v.calls().filter("value > 150").withColumn("total_features", 180 + F.col("k") % 2)
    per = seen.groupBy("run").agg(F.min("total_features").alias("lo"), F.max("total_features").alias("hi"))
    return v.runs().join(per, "run", "left").select(
        "run", runs.canary_present(F.col("canary"), F.col("config_id")).alias("present"),
        F.when(F.col("canary").isNull(), "derived").otherwise("field").alias("source"),
        scoring.canary_from_counts(F.col("lo"), F.col("hi"), 180).alias("from_counts"))


@query("sc_09_reachability", """
  SELECT r.run, r.flag, r.scored_as, CASE WHEN k.run IS NOT NULL THEN m.feature IS NOT NULL END AS reachable
  FROM resolved r LEFT JOIN (SELECT DISTINCT run FROM calls WHERE tool = 'click') k ON k.run = r.run
  LEFT JOIN (SELECT DISTINCT run, feature FROM calls WHERE tool = 'click') m ON m.run = r.run AND m.feature = r.scored_as
  WHERE r."set" = 'positive'""", ("resolved", "calls"))
def reachability(v):
    cols = v.calls().filter("tool = 'click'").select("run", "feature")
    return scoring.reachability(v.resolved(), cols)


@query("sc_10_eligibility", """
  SELECT run, CASE WHEN mode = 'MOCK' THEN 'mock' WHEN NOT is_usable THEN 'not_finished' END AS refusal_reason FROM runs""", ("runs",))
def eligibility(v):
    return v.runs().select("run", runs.refusal_reason().alias("refusal_reason"))


_COMPARED = ("scored_count", "true_positive_count", "false_positive_count", "hard_negatives_flagged", "precision", "recall", "f1")


@query("sc_11_compare_runs", "\nUNION ALL ".join(
    f"""SELECT a.run AS run_a, b.run AS run_b, '{m}' AS metric, a.{m}::DOUBLE AS a, b.{m}::DOUBLE AS b,
    round(b.{m}::DOUBLE - a.{m}::DOUBLE, 4) + 0.0::DOUBLE AS delta FROM run_scores a JOIN run_scores b ON b.run = a.run + 1"""
    for m in _COMPARED), ("run_scores",))
def compare_runs(v):
    ids = v.scores().select("run")
    pairs = ids.select(F.col("run").alias("run_a"), (F.col("run") + 1).alias("run_b")).join(
        ids.withColumnRenamed("run", "run_b"), "run_b", "left_semi")
    return scoring.compare(v.scores(), pairs, _COMPARED)


@query("sc_12_verdicts", """
  SELECT run, flag, CASE "set" WHEN 'positive' THEN 'true_positive' WHEN 'out_of_scope' THEN 'out_of_scope'
         ELSE 'false_positive' END AS verdict, "set" IS NOT DISTINCT FROM 'hard' AS hard_negative,
         CASE WHEN kind IS NOT NULL THEN scored_as END AS scored_as_parent FROM resolved""", ("resolved",))
def verdicts(v):
    return scoring.verdicts(v.resolved())


cte("answers", ("calls",), r"""
  SELECT doc_id AS run, CASE doc_id % 10 WHEN 0 THEN rec || chr(10) || e WHEN 1 THEN s || chr(10) || rec
     WHEN 2 THEN concat_ws(chr(10), s, flag, flag, why, ev, conf, e) WHEN 3 THEN s || chr(10) || e
     WHEN 4 THEN concat_ws(chr(10), s, 'NO FINDINGS', e)
     WHEN 5 THEN concat_ws(chr(10), s, rec, '###', 'FLAG: ' || lang, why, 'EVIDENCE: click and purchase agree at 1e-3 and 0.5%',
                           'CONFIDENCE: low', e)
     WHEN 6 THEN concat_ws(chr(10), s, rec, e, text) WHEN 7 THEN concat_ws(chr(10), s, why, flag, ev, conf, e)
     WHEN 8 THEN concat_ws(chr(10), s, flag, text, why, ev, 'CONFIDENCE: certain', e) ELSE concat_ws(chr(10), s, rec, e) END AS text
  FROM (SELECT *, concat_ws(chr(10), flag, why, ev, conf) AS rec FROM (
    SELECT doc_id, text, lang, '=== AUDIT FINDINGS ===' AS s, '=== END AUDIT FINDINGS ===' AS e, 'FLAG: ' || source AS flag,
           'REASON: seen in ' || lang AS why, 'CONFIDENCE: high' AS conf,
           'EVIDENCE: view returned ' || CAST(coalesce(c.top, 0.0::DOUBLE) AS VARCHAR) || ' over ' || coalesce(c.n, 0) || ' calls; '
             || regexp_replace(text, '[\r\n]+', ' ', 'g') AS ev
    FROM documents LEFT JOIN (SELECT run, count(*) AS n, max(value) AS top FROM calls GROUP BY run) c ON c.run = doc_id))""")
cte("blocks", ("answers",), r"""
  SELECT run, CASE WHEN NOT contains(text, '=== AUDIT FINDINGS ===') THEN 'no_block'
      WHEN NOT contains(text, '=== END AUDIT FINDINGS ===') THEN 'unclosed' WHEN body = 'NO FINDINGS' THEN 'explicit_none'
      WHEN body = '' THEN 'empty' ELSE 'records' END AS status, body
  FROM (SELECT run, text, trim(split_part(substr(text, instr(text, '=== AUDIT FINDINGS ===') + 22), '=== END AUDIT FINDINGS ===', 1),
                               chr(10) || ' ') AS body FROM answers)""")
cte("chunk_lines", ("blocks",), r"""
  SELECT run, record, line_no, trim(line, ' ' || chr(9)) AS line,
         CASE WHEN contains(line, ':') THEN trim(split_part(line, ':', 1)) END AS name
  FROM (SELECT run, record, unnest(string_split(chunk, chr(10))) AS line, generate_subscripts(string_split(chunk, chr(10)), 1) AS line_no
        FROM (SELECT run, unnest(string_split(body, '###')) AS chunk, generate_subscripts(string_split(body, '###'), 1) AS record
              FROM blocks WHERE status = 'records'))""")
cte("finding_records", ("chunk_lines",), r"""
  SELECT run, record, max(value) FILTER (name = 'FLAG') AS flag, max(value) FILTER (name = 'REASON') AS reason,
         max(value) FILTER (name = 'EVIDENCE') AS evidence, max(value) FILTER (name = 'CONFIDENCE') AS confidence
  FROM (SELECT *, trim(regexp_replace(line, '^[^:]*:', '')) AS value FROM (
     SELECT *, row_number() OVER (PARTITION BY run, record, name ORDER BY line_no) AS mention FROM chunk_lines
     WHERE name IN ('FLAG', 'REASON', 'EVIDENCE', 'CONFIDENCE')) WHERE mention = 1)
  GROUP BY run, record HAVING coalesce(max(value) FILTER (name = 'FLAG'), '') <> ''""")


@query("sc_13_findings", """
  SELECT b.run, b.status, r.record, r.flag, r.reason, md5(r.evidence) AS evidence_md5, r.confidence
  FROM blocks b LEFT JOIN finding_records r ON r.run = b.run""", ("blocks", "finding_records"))
def parse_findings(v):
    parsed = v.parsed_answers()
    # Digests are taken before the join, so that it moves no evidence.
    recs = findings.records(v.finding_chunks()).select(
        "run", F.col("record").cast("long").alias("record"), "flag", "reason", F.md5("evidence").alias("evidence_md5"), "confidence")
    return parsed.select("run", "status").join(recs, "run", "left").select("run", "status", "record", "flag", "reason", "evidence_md5", "confidence")


@query("sc_14_finding_warnings")
def finding_warnings(v):
    documented = v.table("documents").select(F.col("source").alias("feature"))
    return findings.warnings(v.parsed_answers(), v.finding_chunks(), documented)
