"""Run records in the roles of FIXTURES.md: calls, results, runs and answers from ``events`` and ``documents``."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditkit.functions.calls import canonical_arguments
from auditkit.operators import findings, scoring, search, sets
from auditkit.operators.cumulate import positions
from auditkit.plans.sqlviews import cte

MATRIX_TOOLS = ("view", "click")
REJECTED = ("unknown_tool", "unexpected_argument", "bad_arguments", "failed")
EMPTY = ("not_found", "not_precomputed", "match_count=0")


class RunViews:
    """Mixin of ``Views``."""

    def calls(self) -> DataFrame:
        """One row per event: run, seq, tool, arguments, ok, outcome, feature."""
        return self._stage("calls", self._build_calls)

    def _build_calls(self) -> DataFrame:
        e, value = self.table("events"), F.col("value")
        k = F.get_json_object("props", "$.k").cast("int")
        pad = F.when(value < 20, " ").otherwise("")
        arguments = (F.when(F.col("event_type").isin(*MATRIX_TOOLS), F.concat(F.lit('{"feature": "'), pad, F.lit("f"), k, F.lit('"}')))
                     .when((F.col("event_type") == "purchase") & (k % 10 == 0), "{}")
                     .when(F.col("event_type") == "purchase", F.concat(F.lit('{"top_n": '), k, F.lit("}")))
                     .otherwise(F.col("props")))
        ok = F.col("event_type") != "error"
        outcome = (F.when(ok, F.when(value < 5, "not_found").when(value < 10, "not_precomputed")
                          .when(value < 15, "match_count=0").otherwise("found"))
                   .when(value < 10, REJECTED[0]).when(value < 30, REJECTED[1]).when(value < 60, REJECTED[2])
                   .otherwise(REJECTED[3]))
        rows = e.select(F.col("user_id").alias("run"), "event_id", F.col("event_type").alias("tool"),
                        arguments.alias("arguments"), ok.alias("ok"), outcome.alias("outcome"), k.alias("k"), "value",
                        F.when(F.col("event_type").isin(*MATRIX_TOOLS), F.concat(F.lit("f"), k)).alias("feature"))
        return positions(rows, ["run"], ["event_id"], "seq")

    def results(self) -> DataFrame:
        """The tool results of a run in order. Every eleventh run lacks its first result, every seventh has a wrong name."""
        lacks, wrong = F.col("run") % 11 == 4, (F.col("run") % 7 == 3) & (F.col("seq") == 2)
        content = F.concat(F.lit('{"value": '), F.col("value"), F.lit(', "inner": {"k": '), F.col("k"),
                           F.lit(', "ok": true, "list": ["'), F.round("value", 1), F.lit('%", "f'), F.col("k"), F.lit('"]}}'))
        return (self.calls().filter(~(lacks & (F.col("seq") == 1)))
                .select("run", "event_id", (F.col("seq") - F.when(lacks, 1).otherwise(0)).alias("pos"),
                        F.when(wrong, "other").otherwise(F.col("tool")).alias("tool_use_name"), content.alias("content"),
                        "k", "value"))

    def canonical_calls(self) -> DataFrame:
        """Calls with the canonical form of their arguments."""
        form = canonical_arguments(F.col("tool"), F.col("arguments"), CALL_ARGS, CALL_DEFAULTS)
        return self._stage("canonical_calls", lambda: self.calls().select("run", "seq", "tool", form.alias("form")))

    def flags(self) -> DataFrame:
        """Flagged names per run as an answer lists them: untrimmed, with derivatives and blanks."""
        k, f = F.col("k"), F.concat(F.lit("f"), "k")
        name = (F.when(k % 10 == 7, F.concat(f, F.lit("_was_missing"))).when(k % 10 == 8, F.concat(F.lit("unseen_"), "k")).otherwise(f))
        views = self.calls().filter(F.col("tool") == "view")
        named = views.select("run", F.col("seq").alias("pos"), F.concat(F.when(F.col("value") < 10, " ").otherwise(""), name).alias("flag"))
        return named.unionByName(views.filter(F.col("value") < 1).select("run", F.col("seq").alias("pos"), F.lit("  ").alias("flag")))

    def dictionary(self) -> DataFrame:
        """One documented column per part: feature, description, populated, removed."""
        size = F.col("p_size") % 4
        return self.table("part").select(
            F.concat(F.lit("f"), "p_partkey").alias("feature"), F.concat("p_name", F.lit(" of type "), "p_type").alias("description"),
            F.when(size == 0, "at application").when(size == 1, "at origination")
            .when(size == 2, F.concat(F.lit("at application; "), F.lit(CLAUSE))).otherwise("during the life of the item").alias("populated"),
            (F.col("p_partkey") % 3 == 0).alias("removed"))

    def answer_key(self) -> DataFrame:
        return self._stage("answer_key", lambda: scoring.answer_key(self.dictionary(), CLAUSE, TIERS))

    def resolved(self) -> DataFrame:
        return self._stage("resolved", lambda: scoring.resolve(sets.clean_flags(self.flags()), self.answer_key()))

    def runs(self) -> DataFrame:
        """One row of facts per run."""
        return self._stage("runs", self._build_runs)

    def _build_runs(self) -> DataFrame:
        r = F.col("run")
        n = self.calls().groupBy("run").agg(
            F.count("*").alias("tool_calls"), F.count_if("ok").alias("turns"),
            F.expr("sum(cast(round(value * 100) AS bigint)) div 100").alias("input_tokens"), F.count_distinct("k").alias("output_tokens"))
        version = F.when(r % 4 == 0, "1.0").otherwise("2.0")
        config = F.concat(F.lit("tools"), version,
                          F.when(r % 3 == 0, "").when(r % 3 == 1, "-retrieval-vector-index").otherwise("-retrieval-keyword-fallback"),
                          F.when(r % 5 == 0, "-canary").otherwise("-layer1"))
        return n.withColumns({
            "mode": F.when(r % 13 == 0, "MOCK").otherwise("REAL"),
            "is_usable": r % 6 != 5,
            "canary": F.when(r % 2 == 0, r % 5 == 0),
            "config_id": config, "tool_layer_version": version,
            "model": F.when(r % 2 == 0, "model-a").otherwise("model-b"),
            "last_stop_reason": F.element_at(F.array(*[F.lit(s) for s in (
                "end_turn", "tool_use", "max_tokens", "refusal", "pause_turn", "stop_sequence", "odd")]),
                (r % 7 + 1).cast("int")),
            "has_text": r % 9 != 0, "max_turns": F.lit(60), "max_tool_calls": F.lit(75),
            "populated": F.when(r % 2 == 0, "included").otherwise("suppressed"),
            "scopes": F.when(r % 8 != 0, F.when(r % 4 < 2, "all").otherwise("split"))})

    def answers(self) -> DataFrame:
        """One answer text per document: the findings block in well-formed and malformed shapes around the whole text.

        It is read once, by the parser, whose table is written; writing the texts as well would double that."""
        facts = self.calls().groupBy("run").agg(F.count("*").alias("n"), F.max("value").alias("top"))
        docs = self.texts().join(facts, F.col("doc_id") == F.col("run"), "left")
        body = F.regexp_replace("text", r"[\r\n]+", " ")
        evidence = F.concat(F.lit("view returned "), F.coalesce(F.col("top"), F.lit(0.0)), F.lit(" over "),
                            F.coalesce(F.col("n"), F.lit(0)), F.lit(" calls; "), body)
        flag, conf = F.concat(F.lit("FLAG: "), "source"), F.lit("CONFIDENCE: high")
        why, ev = F.concat(F.lit("REASON: seen in "), "lang"), F.concat(F.lit("EVIDENCE: "), evidence)
        start, end = F.lit("=== AUDIT FINDINGS ==="), F.lit("=== END AUDIT FINDINGS ===")

        def lines(*parts):
            return F.concat_ws("\n", *parts)

        rec = lines(flag, why, ev, conf)
        second = lines(F.concat(F.lit("FLAG: "), "lang"), why, F.lit("EVIDENCE: click and purchase agree at 1e-3 and 0.5%"),
                       F.lit("CONFIDENCE: low"))
        kind = F.col("doc_id") % 10
        text = (F.when(kind == 0, lines(rec, end)).when(kind == 1, lines(start, rec))
                .when(kind == 2, lines(start, flag, flag, why, ev, conf, end)).when(kind == 3, lines(start, end))
                .when(kind == 4, lines(start, F.lit("NO FINDINGS"), end))
                .when(kind == 5, lines(start, rec, F.lit("###"), second, end))
                .when(kind == 6, lines(start, rec, end, F.col("text"))).when(kind == 7, lines(start, why, flag, ev, conf, end))
                .when(kind == 8, lines(start, flag, F.col("text"), why, ev, F.lit("CONFIDENCE: certain"), end))
                .otherwise(lines(start, rec, end)))
        return docs.select(F.col("doc_id").alias("run"), text.alias("text"))

    def parsed_answers(self) -> DataFrame:
        return self._stage("parsed_answers", lambda: findings.parse(self.answers()))

    def finding_chunks(self) -> DataFrame:
        return self._stage("finding_chunks", lambda: findings.chunk_table(self.parsed_answers()))

    def scores(self) -> DataFrame:
        return self._stage("scores", lambda: scoring.score(self.runs(), self.resolved(), self.answer_key()))

    # ---------------------------------------------------------------- vectors
    def centroids(self) -> DataFrame:
        """(label, vector): the mean vector of every label, the retrieval queries."""
        vec = array_to_vector(F.transform("embedding", lambda x: x.cast("double")))
        return self._stage("centroids", lambda: self.table("embeddings").groupBy("label")
                         .agg(Summarizer.mean(vec).alias("m")).select("label", vector_to_array("m").alias("vector")))

    def vec_docs(self) -> DataFrame:
        """(vec_id, feature, embedding, label): the vector index with the names of its documents."""
        d = self.table("documents").select("doc_id", "source", "lang")
        joined = self.table("embeddings").join(d, F.col("vec_id") == F.col("doc_id"), "left")
        named = F.when(F.col("doc_id").isNull(), F.concat_ws("_", F.lit("none"), "vec_id")).otherwise(
            F.concat_ws("_", "source", "lang", "vec_id"))
        return joined.select("vec_id", named.alias("feature"), "embedding", "label")

    def probes(self) -> DataFrame:
        """One probe per label (its mean vector) and one, expecting nothing, at the opposite vector."""
        c = self.centroids()
        real = c.select(F.col("label").cast("long").alias("query"), F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("family"),
                        F.concat(F.lit("src"), "label", F.lit("_")).alias("text"), "vector", "label")
        none = c.select((F.col("label") + 100_000).cast("long").alias("query"), F.lit("none").alias("family"), F.lit("zzz").alias("text"),
                        F.transform("vector", lambda x: -x).alias("vector"), F.lit(None).cast("int").alias("label"))
        return real.unionByName(none)

    def expected(self) -> DataFrame:
        return self.table("embeddings").select(F.col("label").cast("long").alias("query"), "vec_id")

    def topk_hits(self) -> DataFrame:
        return self._stage("topk_hits", lambda: search.two_tier(self.vec_docs(), self.probes()))

    def band_hits(self) -> DataFrame:
        return self._stage("band_hits", lambda: search.band_search(self.vec_docs(), self.probes()))


cte("calls", (), """
  SELECT user_id AS run, event_id, event_type AS tool, event_type <> 'error' AS ok, k, value, args AS arguments,
         CASE WHEN event_type <> 'error' THEN CASE WHEN value < 5 THEN 'not_found' WHEN value < 10 THEN 'not_precomputed'
                WHEN value < 15 THEN 'match_count=0' ELSE 'found' END
              WHEN value < 10 THEN 'unknown_tool' WHEN value < 30 THEN 'unexpected_argument'
              WHEN value < 60 THEN 'bad_arguments' ELSE 'failed' END AS outcome,
         CASE WHEN event_type IN ('view', 'click') THEN 'f' || k END AS feature,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq
  FROM (SELECT *, CASE WHEN event_type = 'purchase' AND k % 10 = 0 THEN '{}' ELSE props END AS args
        FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))""")
cte("results_src", ("calls",), """
  SELECT run, event_id, k, value, tool, seq - CASE WHEN run % 11 = 4 THEN 1 ELSE 0 END AS pos,
         CASE WHEN run % 7 = 3 AND seq = 2 THEN 'other' ELSE tool END AS tool_use_name
  FROM calls WHERE NOT (run % 11 = 4 AND seq = 1)""")
cte("runs", ("calls",), """
  SELECT *, 'tools' || tool_layer_version
           || CASE run % 3 WHEN 0 THEN '' WHEN 1 THEN '-retrieval-vector-index' ELSE '-retrieval-keyword-fallback' END
           || CASE WHEN run % 5 = 0 THEN '-canary' ELSE '-layer1' END AS config_id
  FROM (SELECT run, count(*) AS tool_calls, count(*) FILTER (ok) AS turns, CAST(sum(CAST(round(value * 100) AS BIGINT)) // 100 AS BIGINT) AS input_tokens,
           count(DISTINCT k) AS output_tokens,
           CASE WHEN run % 13 = 0 THEN 'MOCK' ELSE 'REAL' END AS mode, run % 6 <> 5 AS is_usable,
           CASE WHEN run % 2 = 0 THEN run % 5 = 0 END AS canary,
           CASE WHEN run % 4 = 0 THEN '1.0' ELSE '2.0' END AS tool_layer_version,
           CASE WHEN run % 2 = 0 THEN 'model-a' ELSE 'model-b' END AS model,
           ['end_turn', 'tool_use', 'max_tokens', 'refusal', 'pause_turn', 'stop_sequence', 'odd'][run % 7 + 1]
             AS last_stop_reason,
           run % 9 <> 0 AS has_text, 60 AS max_turns, 75 AS max_tool_calls,
           CASE WHEN run % 2 = 0 THEN 'included' ELSE 'suppressed' END AS populated,
           CASE WHEN run % 8 <> 0 THEN CASE WHEN run % 4 < 2 THEN 'all' ELSE 'split' END END AS scopes
        FROM calls GROUP BY run)""")
cte("centroids", (), """
  SELECT label, list(m ORDER BY pos) AS c FROM (
    SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m
    FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
    GROUP BY label, pos) GROUP BY label""")

# Arguments and defaults of the tools, and the phrase tiers (first match wins).
CALL_ARGS = {"view": ("feature",), "click": ("feature",), "purchase": ("top_n",)}
CALL_DEFAULTS = {"purchase": {"top_n": 20}}
TIERS = [("A", "explicit event", ["red", "after the"]), ("B", "accumulation", ["small", "to date"]),
         ("C", "names a programme", ["ring", "bolt"])]
CLAUSE = "collected for items priced from 2015 onward"


def key_members(v) -> DataFrame:
    """(set, name) of every set the key rules speak about."""
    key, d = v.answer_key(), v.dictionary()
    pos = key.filter(F.col("set") == "positive")
    return (key.select("set", "name")
            .unionByName(d.select(F.when(F.col("removed"), "removed").otherwise("model").alias("set"), F.col("feature").alias("name")))
            .unionByName(pos.select(F.when(F.col("tier").isNull(), "clean").otherwise("residual").alias("set"), "name")))


cte("dictionary", (), """
  SELECT 'f' || p_partkey AS feature, p_name || ' of type ' || p_type AS description,
         CASE p_size % 4 WHEN 0 THEN 'at application' WHEN 1 THEN 'at origination'
           WHEN 2 THEN 'at application; collected for items priced from 2015 onward' ELSE 'during the life of the item' END
           AS populated, p_partkey % 3 = 0 AS removed, p_partkey FROM part""")
cte("answer_key", ("dictionary",), """
  SELECT *, CASE WHEN NOT positive THEN NULL WHEN regexp_matches(lower(description), 'red|after the') THEN 'A'
      WHEN regexp_matches(lower(description), 'small|to date') THEN 'B' WHEN regexp_matches(lower(description), 'ring|bolt') THEN 'C' END AS tier,
      CASE WHEN positive THEN 'positive' WHEN out_of_scope THEN 'out_of_scope' ELSE 'hard' END AS "set"
  FROM (SELECT *, removed AND NOT starts_with(populated, 'at ') AS positive, removed AND starts_with(populated, 'at ') AS out_of_scope,
               NOT removed AND contains(populated, 'collected for items') AS hard FROM dictionary)
  WHERE positive OR out_of_scope OR hard""")
cte("resolved", ("clean_flags", "answer_key"), """
  SELECT f.run, f.flag, f.pos, CASE WHEN o.feature IS NULL AND p.feature IS NOT NULL THEN f.parent ELSE f.flag END AS scored_as,
         CASE WHEN o.feature IS NULL AND p.feature IS NOT NULL THEN f.kind END AS kind, coalesce(o."set", p."set") AS "set",
         coalesce(o.tier, p.tier) AS tier
  FROM (SELECT *, CASE WHEN ends_with(flag, '_was_missing') THEN replace(flag, '_was_missing', '')
               WHEN regexp_matches(flag, '^(o_orderpriority|c_mktsegment|unseen)_') THEN
                 regexp_extract(flag, '^(o_orderpriority|c_mktsegment|unseen)_', 1) END AS parent,
               CASE WHEN ends_with(flag, '_was_missing') THEN 'was_missing' ELSE 'one_hot' END AS kind FROM clean_flags) f
  LEFT JOIN answer_key o ON o.feature = f.flag LEFT JOIN answer_key p ON p.feature = f.parent""")
cte("run_scores", ("resolved", "runs", "answer_key"), """
  SELECT *, round(p, 4) AS precision, round(r, 4) AS recall,
         round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 4) AS f1
  FROM (SELECT *, scored_count - true_positive_count AS false_positive_count, k.n - positives_reached AS false_negative_count,
          CASE WHEN scored_count = 0 THEN 0 ELSE true_positive_count::DOUBLE / scored_count END AS p,
          CASE WHEN k.n = 0 THEN 0 ELSE positives_reached::DOUBLE / k.n END AS r
        FROM (SELECT u.run, count(x.flag) AS flagged_count,
                count(x.flag) FILTER ("set" IS DISTINCT FROM 'out_of_scope') AS scored_count,
                count(*) FILTER ("set" = 'positive') AS true_positive_count,
                count(*) FILTER ("set" = 'out_of_scope') AS out_of_scope_count,
                count(DISTINCT scored_as) FILTER ("set" = 'positive') AS positives_reached,
                count(*) FILTER ("set" = 'hard') AS hard_negatives_flagged,
                count(*) FILTER ("set" = 'hard' AND kind IS NULL) AS hard_negatives_raw,
                count(*) FILTER ("set" = 'hard' AND kind IS NOT NULL) AS hard_negatives_via_derivative,
                count(DISTINCT scored_as) FILTER ("set" = 'hard') AS hard_negatives_distinct
              FROM runs u LEFT JOIN resolved x ON x.run = u.run GROUP BY u.run)
        CROSS JOIN (SELECT count(*) AS n FROM answer_key WHERE positive) k)""")
