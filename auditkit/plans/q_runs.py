"""Queries: metrics over call logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditkit.functions import text
from auditkit.operators import align, claims, findings, nearest, runs
from auditkit.plans.q_joins import _bands, _cited
from auditkit.plans.registry import query
from auditkit.plans.run_views import EMPTY, MATRIX_TOOLS, REJECTED
from auditkit.plans.sqlviews import cte

PASSING = ("vector-index", "unused")
SURFACES = {"1.0": ("view", "click", "purchase"), "2.0": ("view", "click", "purchase", "signup")}
TOOLS = ("view", "click", "purchase", "signup")


@query("rm_01_gates", """
  SELECT run, metric, CASE WHEN gate IS NOT NULL THEN 'excluded' WHEN metric = 'M18' AND NOT passed THEN 'withheld'
         ELSE 'computed' END AS status,
         coalesce(gate, CASE WHEN metric = 'M18' AND NOT passed THEN 'seq_mapping_failed' END) AS reason
  FROM (SELECT r.run, m.metric, p.passed,
          CASE WHEN contains(config_id, '-retrieval-') AND NOT contains(config_id, '-retrieval-vector-index-')
                 THEN 'validity_precondition_failed'
               WHEN mode <> 'REAL' THEN 'scope_not_real'
               WHEN metric NOT IN ('M1', 'M14') AND NOT is_usable THEN 'scope_not_usable'
               WHEN metric = 'M18' AND NOT coalesce(canary, ends_with(config_id, '-canary')) THEN 'scope_not_canary' END AS gate
        FROM runs r JOIN mapping p ON p.run = r.run
        CROSS JOIN (SELECT unnest(['M1','M3','M4','M5','M6','M8','M9','M10','M11','M14','M16','M17a','M17b','M18']) AS metric) m)""",
       ("runs", "mapping"))
def gates(v):
    failed = align.mapping_check(v.calls(), v.results()).filter(~F.col("passed")).select("run", F.lit("M18").alias("metric"))
    return runs.gates(v.runs(), PASSING, failed)


@query("rm_02_limits_and_turns", """
  SELECT run, last_stop_reason, max_turns, max_tool_calls, turns, tool_calls FROM runs""", ("runs",))
def limits_and_turns(v):
    return v.runs().select("run", "last_stop_reason", "max_turns", "max_tool_calls", "turns", "tool_calls")


@query("rm_03_calls_per_turn", """
  SELECT run, turn, calls, count(*) OVER (PARTITION BY run) AS tool_bearing_turns,
         round(avg(calls) OVER (PARTITION BY run), 6) AS mean
  FROM (SELECT run, (seq - 1) // (1 + run % 4) AS turn, count(*) AS calls FROM calls GROUP BY 1, 2)""", ("calls",))
def calls_per_turn(v):
    turn = F.expr("(seq - 1) div (1 + run % 4)")
    return runs.calls_per_turn(v.calls().withColumn("turn", turn)).withColumn("mean", F.round("mean", 6))


@query("rm_04_tool_mix", """
  SELECT run, tool, count(*) AS count, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY run), 6) AS share
  FROM calls GROUP BY run, tool""", ("calls",))
def tool_mix(v):
    return runs.tool_mix(v.calls()).withColumn("share", F.round("share", 6))


@query("rm_05_tool_coverage", """
  SELECT run, count(DISTINCT tool) FILTER (ok) AS distinct_tool_count, max(n) AS tools_available,
         round(count(DISTINCT tool) FILTER (ok)::DOUBLE / max(n), 6) AS coverage,
         coalesce(string_agg(DISTINCT CASE WHEN NOT ok THEN tool END, ',' ORDER BY CASE WHEN NOT ok THEN tool END), '') AS outside
  FROM (SELECT c.run, c.tool, CASE WHEN r.tool_layer_version = '1.0' THEN 3 ELSE 4 END::BIGINT AS n,
          c.tool IN ('view', 'click', 'purchase') OR (c.tool = 'signup' AND r.tool_layer_version = '2.0') AS ok
        FROM calls c JOIN runs r ON r.run = c.run) GROUP BY run""", ("calls", "runs"))
def tool_coverage(v):
    return runs.tool_coverage(v.calls(), v.runs(), SURFACES).withColumn("coverage", F.round("coverage", 6))


@query("rm_06_rejected", """
  SELECT run, count(*) AS logged_calls, count(*) FILTER (NOT ok) AS rejected_calls,
         round(count(*) FILTER (NOT ok)::DOUBLE / count(*), 6) AS rate, """ + ", ".join(
    f"count(*) FILTER (outcome = '{o}') AS {o}" for o in REJECTED) + ", 0::BIGINT AS unknown_outcomes FROM calls GROUP BY run",
       ("calls",))
def rejected(v):
    return runs.rejected(v.calls(), REJECTED).withColumn("rate", F.round("rate", 6))


@query("rm_07_no_data", """
  SELECT run, count(*) AS logged_calls, count(*) FILTER (outcome IN ('not_found', 'not_precomputed', 'match_count=0')) AS no_data,
         round(count(*) FILTER (outcome IN ('not_found', 'not_precomputed', 'match_count=0'))::DOUBLE / count(*), 6) AS rate
  FROM calls GROUP BY run""", ("calls",))
def no_data(v):
    return runs.empty_results(v.calls(), EMPTY).withColumn("rate", F.round("rate", 6))


@query("rm_08_repeats", """
  SELECT c.run, count(*) AS logged_calls, max(coalesce(r.n, 0)) AS repeat_calls
  FROM calls c LEFT JOIN (SELECT run, count(*) AS n FROM repeats GROUP BY run) r ON r.run = c.run GROUP BY c.run""",
       ("calls", "repeats"))
def repeats(v):
    return runs.repeat_counts(v.canonical_calls())


@query("rm_09_feature_breadth", """
  SELECT run, count(*) AS distinct_features, count(*) FILTER (hit) AS in_matrix, count(*) FILTER (NOT hit AND miss) AS out_of_matrix,
         count(*) FILTER (NOT hit AND NOT miss) AS unclassified
  FROM (SELECT run, feature, bool_or(outcome = 'found') AS hit, bool_or(outcome = 'not_found') AS miss FROM calls
        WHERE feature IS NOT NULL GROUP BY run, feature) GROUP BY run""", ("calls",))
def feature_breadth(v):
    return runs.feature_breadth(v.calls(), MATRIX_TOOLS)


@query("rm_10_tokens_and_cost", """
  SELECT run, model, input_tokens, output_tokens,
         CASE WHEN model = 'model-a' THEN round((input_tokens * 2.0::DOUBLE + output_tokens * 10.0::DOUBLE) / 1000000, 6) END AS cost,
         CASE WHEN model = 'model-a' THEN 'derived_rate_verified' ELSE 'withheld_rate_unverified' END AS cost_status FROM runs""",
       ("runs",))
def tokens_and_cost(v):
    rates = v.spark.createDataFrame([("model-a", 2.0, 10.0, True), ("model-b", 3.0, 15.0, False)],
                                    "model string, rate_input double, rate_output double, verified boolean")
    return runs.tokens_and_cost(v.runs(), rates).withColumn("cost", F.round("cost", 6))


@query("rm_11_answer_shape", """
  SELECT b.run, b.status = 'explicit_none' AS explicit_no_findings, count(r.flag) AS records,
         count(*) FILTER (r.confidence = 'high') AS high, count(*) FILTER (r.confidence = 'medium') AS medium,
         count(*) FILTER (r.confidence = 'low') AS low
  FROM blocks b LEFT JOIN finding_records r ON r.run = b.run GROUP BY b.run, b.status""", ("blocks", "finding_records"))
def answer_shape(v):
    documented = v.table("documents").select(F.col("source").alias("feature"))
    chunks = v.finding_chunks()
    warned = findings.warnings(v.parsed_answers(), chunks, documented)
    return findings.shape(v.parsed_answers(), findings.records(chunks), warned).drop("warning_count")


def _word(t: str) -> str:
    return f"regexp_matches(r.evidence, '(^|[^A-Za-z0-9_]){t}([^A-Za-z0-9_]|$)')"


@query("rm_12_grounded_evidence", f"""
  SELECT run, record, tools_named, tools_named > 0 AND tools_named = tools_called AS grounded,
         CASE WHEN tools_named = 0 THEN 'no tool named' WHEN tools_named <> tools_called THEN 'named tool not called' END AS sub_reason
  FROM (SELECT r.run, r.record::INTEGER AS record,
          ({' + '.join(f"CASE WHEN {_word(t)} THEN 1 ELSE 0 END" for t in TOOLS)})::BIGINT AS tools_named,
          ({' + '.join(f"CASE WHEN {_word(t)} AND list_contains(c.tools, '{t}') THEN 1 ELSE 0 END" for t in TOOLS)})::BIGINT AS tools_called
        FROM finding_records r LEFT JOIN (SELECT run, list(DISTINCT tool) AS tools FROM calls GROUP BY run) c ON c.run = r.run)""",
       ("finding_records", "calls"))
def grounded_evidence(v):
    return runs.grounded(findings.records(v.finding_chunks()), v.calls(), TOOLS)


def cited(v):
    """Figures cited in the evidence of every record, with their token ids."""
    recs = findings.records(v.finding_chunks())
    return (recs.select("run", "record", F.posexplode(text.number_tokens(F.col("evidence"))).alias("i", "t"))
            .select("run", "record", F.concat_ws("|", "run", F.concat(F.lit("r"), "record"), F.concat(F.lit("t"), F.col("i") + 1))
                    .alias("token_id"), "t.text", "t.value", "t.decimals"))


def _grounded(v):
    """The figures of all evidence, matched against the numbers of their runs' results."""
    numbers = v.results().select("run", F.explode(text.json_numbers(F.col("content"))).alias("x"))
    return v._stage("grounded", lambda: nearest.band_match(cited(v), numbers))


@query("rm_13_numeric_grounding")
def numeric_grounding(v):
    return _grounded(v).groupBy("run", "record").agg(
        F.count("*").alias("cited"), F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched"),
        F.count_if("on_tie").alias("on_tie"))


@query("rm_13_unmatched_figures")
def unmatched_figures(v):
    """The figures that no number of their run explains, with the nearest one; in scientific form they are not judged but named."""
    notes = findings.records(v.finding_chunks()).select("run", "record", F.explode(text.scientific(F.col("evidence"))).alias("text"))
    found = _grounded(v).filter("not matched").select("run", "record", F.lit("unmatched").alias("list"), "token_id", "text", "nearest")
    none = F.lit(None)
    return found.unionByName(notes.select("run", "record", F.lit("scientific").alias("list"), none.cast("string").alias("token_id"), "text",
                                          none.cast("double").alias("nearest")))


@query("rm_13_lists", """
  SELECT run, event_id, decimals, 'unmatched' AS list, CAST(NULL AS DOUBLE) AS tie_value FROM bands WHERE NOT matched
  UNION ALL
  SELECT b.run, b.event_id, b.decimals, 'tie', e.value FROM bands b JOIN (SELECT DISTINCT user_id, value FROM events) e ON e.user_id = b.run
    AND abs(abs(e.value - b.value) - 0.5::DOUBLE * pow(10.0::DOUBLE, -b.decimals)) <= 1e-9 * 0.5::DOUBLE * pow(10.0::DOUBLE, -b.decimals)
  WHERE b.on_tie""", ("bands",))
def grounding_lists(v):
    """Each unmatched figure, and each figure that turned on a tie with every number it ties with."""
    bands = _bands(v)
    tied = bands.filter("on_tie").join(nearest.ties(bands, _cited(v)[1]), ["run", "value", "decimals"])
    return bands.filter("not matched").select("run", "event_id", "decimals", F.lit("unmatched").alias("list"), F.lit(None).cast("double").alias("tie_value")
                                              ).unionByName(tied.select("run", "event_id", "decimals", F.lit("tie").alias("list"), "tie_value"))


cte("spelled", ("bands", "results_src", "mapping"), """
  SELECT b.*, printf(CASE WHEN decimals = 1 THEN '%.1f' ELSE '%.0f' END, b.value) AS figure, e.value AS own, CAST(round(e.value, 1) AS VARCHAR) || '%' AS passage,
    r.pos + CASE WHEN b.event_id % 30 = 0 THEN 1 ELSE 0 END AS seq, coalesce(m.passed, false) AS mapped
  FROM bands b JOIN events e ON e.event_id = b.event_id LEFT JOIN results_src r ON r.event_id = b.event_id LEFT JOIN mapping m ON m.run = b.run""")
cte("claimed", ("spelled", "results_src"), """
  SELECT event_id, decimals, 1 AS place, 'derived' AS class, CASE WHEN event_id % 35 = 0 THEN 'the computation is empty'
      WHEN event_id % 15 = 0 THEN 'a source value is not a number of this run''s results' END AS reason FROM spelled WHERE event_id % 5 = 0
  UNION ALL
  SELECT s.event_id, s.decimals, 2, 'quoted', CASE WHEN s.seq IS NULL THEN 'no seq given' WHEN figure || '%' <> passage THEN 'the passage does not contain the figure'
      WHEN NOT mapped THEN 'results and calls of this run do not correspond' WHEN r.event_id IS NULL THEN 'no result at this seq'
      WHEN NOT contains(CAST(round(r.value, 1) AS VARCHAR) || '%', passage) THEN 'the passage is not in the result at this seq' END
  FROM spelled s LEFT JOIN results_src r ON r.run = s.run AND r.pos = s.seq WHERE s.event_id % 10 = 0
  UNION ALL
  SELECT event_id, decimals, 3, 'prompt', CASE WHEN event_id % 21 = 0 THEN 'the passage does not contain the figure'
      WHEN event_id % 14 = 0 THEN 'the commit is empty' END FROM spelled WHERE event_id % 7 = 0""")


@query("rm_14_adjudication", """
  SELECT run, b.event_id, b.decimals, CASE WHEN matched THEN 'matched' WHEN c.n > 0 AND failing IS NULL THEN
           CASE WHEN c.n > 1 THEN 'multiply_sourced' ELSE applying END ELSE 'unmatched' END AS classification,
         CASE WHEN NOT matched AND failing IS NULL THEN applying END AS applying, CASE WHEN NOT matched THEN failing END AS reason,
         matched AND c.n IS NOT NULL AS refused
  FROM bands b LEFT JOIN (SELECT event_id, decimals, count(*) AS n, string_agg(class, ',' ORDER BY place) AS applying,
      min_by(reason, place) FILTER (reason IS NOT NULL) AS failing FROM claimed GROUP BY ALL) c ON c.event_id = b.event_id AND c.decimals = b.decimals""",
       ("bands", "claimed"))
def adjudication(v):
    """Claims of all three classes, true and false ones, on figures matched or not."""
    own = v.results().select("event_id", "pos")
    events = v.table("events").select("event_id", F.col("value").alias("own"))
    one = F.col("decimals") == 1
    figure = F.when(one, F.format_string("%.1f", F.col("value"))).otherwise(F.format_string("%.0f", F.col("value")))
    tokens = _bands(v).withColumn("token_id", F.concat_ws("|", "run", "event_id", "decimals")).withColumn("text", figure)
    about = tokens.join(events, "event_id").join(own, "event_id", "left")

    def every(n):
        return F.col("event_id") % n == 0

    fields = {"computation": "string", "source_values": "array<string>", "payload_string": "string", "seq": "long", "prompt_text": "string", "rendered_from_commit": "string"}

    def claim(n, place, name, **given):
        return about.filter(every(n)).select("token_id", F.lit(place).alias("place"), F.lit(name).alias("class"),
                                             *[given.get(f, F.lit(None)).cast(k).alias(f) for f, k in fields.items()])

    made = claim(5, 1, "derived", computation=F.when(every(35), " ").otherwise("a - b"),
                 source_values=F.array(F.when(every(15), "-1.00").otherwise(F.format_string("%.2f", F.col("own")))))
    made = made.unionByName(claim(10, 2, "quoted", payload_string=F.concat(F.round("own", 1), F.lit("%")), seq=F.col("pos") + F.when(every(30), 1).otherwise(0)))
    made = made.unionByName(claim(7, 3, "prompt", prompt_text=F.concat(F.lit("at most "), "text", F.when(every(21), "5").otherwise(" rows")),
                                  rendered_from_commit=F.when(every(14), " ").otherwise("a1b2")))
    checked = claims.check_claims(tokens, made, _cited(v)[1], v.results(), align.mapping_check(v.calls(), v.results()))
    return claims.adjudicate(tokens, checked).select("run", "event_id", "decimals", "classification", F.array_join("applying", ",").alias("applying"), "reason", "refused")


@query("rm_15_exposure_metric", """
  SELECT e.run, p.passed, CASE WHEN p.passed THEN e.exposure_seq END AS exposure_seq,
         CASE WHEN p.passed THEN e.investigation_seq END AS investigation_seq, CASE WHEN p.passed THEN e.gap END AS gap
  FROM exposure e JOIN mapping p ON p.run = e.run""", ("exposure", "mapping"))
def exposure_metric(v):
    ok = align.mapping_check(v.calls(), v.results()).select("run", "passed")
    out = runs.exposure(v.calls(), v.results(), "f9").join(ok, "run")
    return out.select("run", "passed", *[F.when(F.col("passed"), F.col(c)).alias(c)
                                         for c in ("exposure_seq", "investigation_seq", "gap")])


_KINDS = {"view": "found", "click": "found", "purchase": "returned", "signup": "match_count", "probe": "available"}


@query("rm_16_outcome_label", """
  SELECT event_id, CASE WHEN tool = 'error' OR value < 3 THEN 'error' WHEN tool IN ('view', 'click') THEN
           CASE WHEN value > 10 THEN 'found' ELSE 'not_found' END
         WHEN tool = 'purchase' THEN 'returned=' || k ELSE 'match_count=' || k END AS outcome FROM calls""", ("calls",))
def outcome_label(v):
    body = (F.when(F.col("value") < 3, "{}")
            .when(F.col("tool").isin("view", "click"), F.concat(F.lit('{"found": '), (F.col("value") > 10).cast("string"), F.lit("}")))
            .when(F.col("tool") == "purchase", F.concat(F.lit('{"returned": '), F.col("k"), F.lit("}")))
            .otherwise(F.concat(F.lit('{"match_count": '), F.col("k"), F.lit("}"))))
    return v.calls().select("event_id", runs.outcome_label(F.col("tool"), body, _KINDS).alias("outcome"))


@query("rm_17_run_index", """
  SELECT run, model, turns, tool_calls, concat_ws(',', CASE WHEN canary IS NULL THEN 'canary' END,
         CASE WHEN scopes IS NULL THEN 'scopes' END) AS fields_not_in_manifest,
         CASE WHEN mode = 'MOCK' THEN 'mock' WHEN NOT is_usable THEN 'not_finished' END AS refusal_reason,
         mode <> 'MOCK' AND is_usable AS scorer_accepted FROM runs""", ("runs",))
def run_index(v):
    return runs.index_table(v.runs(), ("scopes", "canary")).select(
        "run", "model", "turns", "tool_calls", "fields_not_in_manifest", "refusal_reason", "scorer_accepted")


@query("rm_18_termination", """
  SELECT run, termination, termination = 'completed' AS is_usable FROM (
    SELECT run, CASE WHEN input_tokens > 5000 THEN 'budget_cap'
        WHEN last_stop_reason = 'max_tokens' THEN 'truncated' WHEN last_stop_reason = 'refusal' THEN 'refusal'
        WHEN last_stop_reason = 'pause_turn' THEN 'paused' WHEN last_stop_reason = 'stop_sequence' THEN 'stop_sequence'
        WHEN last_stop_reason = 'tool_use' THEN CASE WHEN tool_calls + 3 > max_tool_calls THEN 'call_limit' ELSE 'turn_limit' END
        WHEN last_stop_reason = 'end_turn' THEN 'completed' ELSE 'unknown_stop_reason' END AS termination FROM runs)""", ("runs",))
def termination(v):
    stop = F.col("last_stop_reason")
    last = F.when(stop == "tool_use", 3).otherwise(0)
    ended = runs.termination(stop, last, F.col("tool_calls"), F.col("max_tool_calls"), F.col("input_tokens") > 5000)
    return v.runs().select("run", ended.alias("termination")).withColumn("is_usable", F.col("termination") == "completed")


@query("rm_19_retrieval_label", """
  SELECT r.run, CASE WHEN bool_or(k % 2 = 0) AND bool_or(k % 2 = 1) THEN 'mixed' WHEN bool_or(k % 2 = 0) THEN 'index'
         WHEN bool_or(k % 2 = 1) THEN 'fallback' ELSE 'unused' END AS retrieval
  FROM runs r LEFT JOIN calls c ON c.run = r.run AND c.tool = 'signup' AND c.value > 100 GROUP BY r.run""", ("runs", "calls"))
def retrieval_label(v):
    served = v.calls().filter("tool = 'signup' AND value > 100").withColumn(
        "backend", F.when(F.col("k") % 2 == 0, "index").otherwise("fallback"))
    return runs.retrieval_label(served, v.runs())


cte("configs", ("run_scores", "runs", "calls"), """
  SELECT r.populated, coalesce(r.scopes, 'none') AS scopes, count(*) AS runs, sum(s.true_positive_count)::BIGINT AS tp,
         sum(s.false_positive_count)::BIGINT AS fp, sum(c.v)::BIGINT AS calls_view, sum(c.p)::BIGINT AS calls_purchase
  FROM runs r JOIN run_scores s ON s.run = r.run
  JOIN (SELECT run, count(*) FILTER (tool = 'view') AS v, count(*) FILTER (tool = 'purchase') AS p FROM calls GROUP BY run) c
    ON c.run = r.run GROUP BY 1, 2""")


@query("agg_23_run_tallies", "SELECT * FROM configs", ("configs",))
def run_tallies(v):
    from auditkit.operators import aggregate
    scored = v.runs().select("run", "populated", F.coalesce("scopes", F.lit("none")).alias("scopes")).join(
        v.scores().select("run", "true_positive_count", "false_positive_count"), "run")
    return aggregate.tallies(scored, v.calls(), ["populated", "scopes"], ["view", "purchase"])
