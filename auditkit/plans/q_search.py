"""Queries: dictionary search and retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditkit.operators import search
from auditkit.plans.registry import query
from auditkit.plans.sqlviews import cte


def text_docs(v):
    d = v.texts()
    return d.select(F.col("doc_id").alias("pos"), F.concat_ws("_", "source", "lang", "doc_id").alias("feature"),
                    F.col("text").alias("description"))


def text_queries(v):
    """Whole benchmark passages and all source names as queries."""
    b = v.table("benchmark").select(F.concat(F.lit("b"), "item_id").alias("query"), "text")
    return b.unionByName(v.table("documents").select(F.col("source").alias("query"), F.col("source").alias("text")).distinct())


cte("text_docs", (), "SELECT doc_id AS pos, source || '_' || lang || '_' || doc_id AS feature, text AS description FROM documents")
cte("text_queries", (), """
  SELECT 'b' || item_id AS query, lower(trim(text)) AS q FROM benchmark UNION SELECT DISTINCT source, source FROM documents""")
cte("keyword", ("text_docs", "text_queries"), """
  SELECT query, pos, feature, CASE WHEN contains(lower(feature), q) THEN 1 ELSE 2 END AS tier FROM text_docs JOIN text_queries
    ON contains(lower(feature), q) OR contains(lower(description), q)""")
cte("vec_docs", (), """
  SELECT e.vec_id, coalesce(source || '_' || lang, 'none') || '_' || e.vec_id AS feature, CAST(e.embedding AS DOUBLE[]) AS v, e.label
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id""")
cte("probes", ("centroids",), """
  SELECT label::BIGINT AS query, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS family, 'src' || label || '_' AS text, c AS vec,
         label FROM centroids
  UNION ALL SELECT 100000 + label, 'none', 'zzz', list_transform(c, lambda x: -x), NULL FROM centroids""")
cte("dist", ("vec_docs", "probes"), """
  SELECT query, vec_id, contains(feature, text) AS named,
         round(1 - list_dot_product(v, vec) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(vec, vec))), 9) AS distance
  FROM vec_docs CROSS JOIN probes""")
cte("expected", ("vec_docs", "probes"), "SELECT query, vec_id FROM probes p JOIN vec_docs d ON d.label = p.label")
cte("topk_hits", ("dist",), """
  SELECT query, vec_id, tier, row_number() OVER (PARTITION BY query ORDER BY tier, CASE WHEN tier = 1 THEN vec_id ELSE distance END, vec_id)
    AS rank
  FROM (SELECT query, vec_id, 1 AS tier, distance FROM dist WHERE named
        UNION ALL SELECT query, vec_id, 2, distance FROM (
          SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS n FROM dist WHERE NOT named AND distance <= 0.45)
        WHERE n <= 10)""")
cte("band_hits", ("dist",), """
  SELECT query, vec_id, tier, row_number() OVER (PARTITION BY query ORDER BY tier, CASE WHEN tier = 1 THEN vec_id ELSE distance END, vec_id)
    AS rank
  FROM (SELECT query, vec_id, 1 AS tier, distance FROM dist WHERE named
        UNION ALL SELECT d.query, d.vec_id, 2, d.distance FROM dist d
        JOIN (SELECT query, min(distance) AS best FROM dist GROUP BY query) b ON b.query = d.query
        WHERE NOT named AND best <= 0.45 AND distance <= least(round(best + 0.05::DOUBLE, 9), 0.45))""")
cte("name_only", ("dist",), """
  SELECT query, vec_id, row_number() OVER (PARTITION BY query ORDER BY vec_id) AS rank FROM dist WHERE named""")


def _eval_sql(hits: str) -> str:
    return f"""
  SELECT p.query, p.family, CASE WHEN e.n > 0 THEN coalesce(g.k5, 0)::DOUBLE / e.n END AS r5,
         CASE WHEN e.n > 0 THEN coalesce(g.k10, 0)::DOUBLE / e.n END AS r10,
         CASE WHEN e.n > 0 THEN coalesce(1.0::DOUBLE / g.first, 0) END AS mrr, coalesce(h.n, 0) AS n_hits, e.n IS NOT NULL AS expects
  FROM probes p LEFT JOIN (SELECT query, count(*) AS n FROM expected GROUP BY query) e ON e.query = p.query
  LEFT JOIN (SELECT h.query, count(*) FILTER (rank <= 5) AS k5, count(*) FILTER (rank <= 10) AS k10, min(rank) AS first
             FROM {hits} h JOIN expected x ON x.query = h.query AND x.vec_id = h.vec_id GROUP BY h.query) g ON g.query = p.query
  LEFT JOIN (SELECT query, count(*) AS n FROM {hits} GROUP BY query) h ON h.query = p.query"""


cte("eval_topk", ("probes", "expected", "topk_hits"), _eval_sql("topk_hits"))
cte("eval_band", ("probes", "expected", "band_hits"), _eval_sql("band_hits"))
cte("eval_name", ("probes", "expected", "name_only"), _eval_sql("name_only"))


@query("ret_01_lookup", """
  SELECT c.feature, d.description, d.populated, d.feature IS NOT NULL AS found
  FROM (SELECT DISTINCT feature FROM calls WHERE feature IS NOT NULL UNION SELECT DISTINCT tool FROM calls) c
  LEFT JOIN dictionary d ON d.feature = c.feature""", ("calls", "dictionary"))
def lookup(v):
    calls = v.calls()
    names = calls.select("feature").filter("feature IS NOT NULL").union(calls.select("tool")).distinct()
    return search.lookup(v.dictionary().select("feature", "description", "populated"), names)


@query("ret_02_keyword", """
  SELECT query, feature, tier, row_number() OVER (PARTITION BY query ORDER BY tier, pos) AS rank FROM keyword""", ("keyword",))
def keyword(v):
    return search.ranked(search.keyword_hits(text_docs(v), text_queries(v))).select("query", "feature", "tier", "rank")


@query("ret_03_vector_topk", """
  SELECT query, vec_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS rank
    FROM dist WHERE query < 100000) WHERE rank <= 10""", ("dist",))
def vector_topk(v):
    q = v.probes().filter("family <> 'none'").withColumn("cutoff", F.lit(2.0))
    hits = search.vector_hits(v.vec_docs().withColumn("skip", F.lit(None)), q, search.TOP_K)
    return hits.select("query", "vec_id", "distance", "rank")


@query("ret_04_two_tier", "SELECT * FROM topk_hits", ("topk_hits",))
def two_tier(v):
    return v.topk_hits()


@query("ret_05_band", "SELECT * FROM band_hits", ("band_hits",))
def band(v):
    return v.band_hits()


@query("ret_06_capped", """
  SELECT query, feature, rank, match_count FROM (
    SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, pos) AS rank, count(*) OVER (PARTITION BY query) AS match_count
    FROM keyword) WHERE rank <= 25""", ("keyword",))
def capped(v):
    return search.capped(search.keyword_hits(text_docs(v), text_queries(v))).select("query", "feature", "rank", "match_count")


_EVAL = ", ".join(f"round({c}, 6) AS {c}" for c in ("r5", "r10", "mrr"))


@query("ret_07_recall", f"SELECT query, family, {_EVAL}, n_hits FROM eval_topk", ("eval_topk",))
def recall(v):
    df = search.evaluate(v.probes(), v.topk_hits(), v.expected())
    return df.select("query", "family", *[F.round(c, 6).alias(c) for c in ("r5", "r10", "mrr")], "n_hits")


@query("ret_08_movements", """
  SELECT a.query, CASE WHEN a.expects THEN a.r10 < coalesce(k.r10, 0) OR a.mrr < coalesce(k.mrr, 0) ELSE a.n_hits > 0 AND k.n_hits = 0 END
           AS regressed,
         CASE WHEN NOT a.expects THEN CASE WHEN a.n_hits < b.n_hits THEN 'up' WHEN a.n_hits > b.n_hits THEN 'down' ELSE 'same' END
              WHEN a.r10 > b.r10 OR (a.r10 = b.r10 AND a.mrr > b.mrr) THEN 'up'
              WHEN a.r10 < b.r10 OR a.mrr < b.mrr THEN 'down' ELSE 'same' END AS moved
  FROM eval_topk a JOIN eval_name k ON k.query = a.query JOIN eval_band b ON b.query = a.query""",
       ("eval_topk", "eval_name", "eval_band"))
def movements(v):
    top = search.evaluate(v.probes(), v.topk_hits(), v.expected())
    band_ = search.evaluate(v.probes(), v.band_hits(), v.expected())
    named, _ = search.name_hits(v.vec_docs(), v.probes())
    ranked = search.positions(named, ["query"], ["vec_id"], "rank")
    name = search.evaluate(v.probes(), ranked, v.expected())
    return search.movements(top, name).select("query", "regressed").join(search.movements(top, band_).select("query", "moved"), "query")


@query("ret_09_diagnosis", """
  SELECT p.query, coalesce(w.missed, 0) AS missed, coalesce(w.missed_inside, 0) AS missed_inside,
         CASE WHEN w.query IS NULL THEN 'not applicable' WHEN missed = 0 THEN 'ranking' WHEN b.best > 0.45 THEN 'ceiling'
              WHEN missed_inside > 0 THEN 'rank cap' ELSE 'ceiling' END AS cause
  FROM probes p LEFT JOIN (SELECT query, min(distance) AS best FROM dist GROUP BY query) b ON b.query = p.query
  LEFT JOIN (SELECT e.query, count(*) FILTER (h.vec_id IS NULL) AS missed,
                    count(*) FILTER (h.vec_id IS NULL AND d.distance <= 0.45) AS missed_inside
             FROM expected e JOIN dist d ON d.query = e.query AND d.vec_id = e.vec_id
             LEFT JOIN topk_hits h ON h.query = e.query AND h.vec_id = e.vec_id GROUP BY e.query) w ON w.query = p.query""",
       ("probes", "dist", "expected", "topk_hits"))
def diagnosis(v):
    q = v.probes().withColumn("cutoff", F.lit(2.0))
    docs = v.vec_docs().withColumn("skip", F.lit(None))
    wanted = v.expected()
    # Distances of the expected entries: each is compared with its own query's vector only, by an equi-join.
    dist = search.expected_distances(docs, q, wanted)
    best = search.vector_hits(docs, q, 1).select("query", "vec_id", "distance")
    both = dist.unionByName(best.join(wanted, ["query", "vec_id"], "left_anti"))
    return search.diagnose(v.probes(), v.topk_hits(), wanted, both)


@query("ret_10_embed", r"""
  SELECT doc_id, 384 AS dim, CASE WHEN regexp_matches(coalesce(text, ''), '[\p{L}\p{N}]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents""")
def embed(v):
    out = search.embed(v.texts().select("doc_id", "text"), dim=384)
    from auditkit.functions import vectors
    return out.select("doc_id", F.size("embedding").alias("dim"), F.round(vectors.norm(F.col("embedding")), 4).alias("norm"))


@query("ret_11_index_stats", """
  SELECT count(*) AS rows, count(embedding) AS non_null, min(len(embedding))::INTEGER AS dim_min, max(len(embedding))::INTEGER AS dim_max,
         64 AS expected_dimension FROM embeddings""")
def index_stats(v):
    return search.index_stats(v.table("embeddings"), expected=64)


@query("agg_22_retrieval_summary", """
  SELECT CASE WHEN grouping(family) = 1 THEN 'ALL' ELSE family END AS family, count(*) AS n, round(avg(r5), 6) AS r5,
         round(avg(r10), 6) AS r10, round(avg(mrr), 6) AS mrr, count(*) FILTER (n_hits = 0) AS empty
  FROM eval_topk GROUP BY ROLLUP (family)""", ("eval_topk",))
def retrieval_summary(v):
    df = search.summarise(search.evaluate(v.probes(), v.topk_hits(), v.expected()))
    return df.withColumns({c: F.round(c, 6) for c in ("r5", "r10", "mrr")})
