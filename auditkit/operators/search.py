"""Dictionary search by keyword and by vector distance, and its evaluation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditkit.functions.text import strip
from auditkit.operators.columns import CheckFailed, first_by
from auditkit.operators.cumulate import positions
from auditkit.sources.staging import materialize

CEILING = 0.45
TOP_K = 10
BAND = 0.05
SHOWN = 25
#: Longest grams of the keyword index; shorter queries have grams of their own length.
GRAM = 3
_CELL_ROWS = 20_000
_CELL_QUERIES = 1_024
_PLACES = 9
_TIER2 = 10 ** 15


# ---------------------------------------------------------------- keyword
def grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def keyword_hits(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, pos, feature, tier): tier 1 where the name holds the query, tier 2 where only the description does.

    ``docs`` has (pos, feature, description), ``queries`` has (query, text); case and blanks at the ends don't count. A text that holds a
    query holds all its grams, so the query meets only texts with the rarest of them, by an equi-join, and is looked for there. Queries of
    any number and texts of any length stay in Spark. Blank and null queries have no hits; a null name or description holds nothing.
    """
    asked = materialize(queries.select("query", F.lower(strip(F.col("text"))).alias("asked")).filter("asked <> ''")
                        .withColumn("size", F.least(F.length("asked"), F.lit(GRAM))), "asked")
    sizes = sorted(r["size"] for r in asked.select("size").distinct().collect())  # at most GRAM
    fields = F.array(F.struct(F.lit(1).alias("tier"), F.lower("feature").alias("body")), F.struct(F.lit(2).alias("tier"), F.lower("description").alias("body")))
    texts = docs.select("pos", "feature", F.inline(fields)).filter("body is not null")
    none = F.array().cast("array<string>")
    own = F.coalesce(*[F.when(F.col("size") == s, grams(F.col("asked"), s)) for s in sizes], none)
    parts = asked.select("asked", F.explode(own).alias("gram")).distinct()
    held = texts.select("pos", "tier", F.explode(F.concat(none, *[grams(F.col("body"), s) for s in sizes])).alias("gram"))
    postings = materialize(held.join(parts.select("gram").distinct(), "gram", "left_semi"), "postings")
    rarity = postings.groupBy("gram").agg(F.count("*").alias("n"))
    # A gram that no text has tells that the query has no hit.
    chosen = parts.join(rarity, "gram", "left").groupBy("asked").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
    found = postings.join(chosen.filter("rarest.n > 0").select("asked", F.col("rarest.gram").alias("gram")), "gram").drop("gram")
    hits = found.join(texts, ["pos", "tier"]).filter(F.contains("body", "asked"))
    best = hits.groupBy("asked", "pos", "feature").agg(F.min("tier").alias("tier"))
    return asked.select("query", "asked").join(best, "asked").select("query", "pos", "feature", "tier")


def ranked(hits: DataFrame) -> DataFrame:
    """Hits with their rank per query: names first, then descriptions, each in dictionary order; any number of hits."""
    ordered = hits.withColumn("_ord", (F.col("tier") - 1) * F.lit(_TIER2) + F.col("pos"))
    return positions(ordered, ["query"], ["_ord"], "rank").drop("_ord")


def capped(hits: DataFrame, n: int = SHOWN) -> DataFrame:
    """The first n hits per query with the full match count."""
    count = hits.groupBy("query").agg(F.count("*").alias("match_count"))
    return first_by(hits, ["query"], [F.col("tier"), F.col("pos")], n).join(count, "query")


def lookup(docs: DataFrame, names: DataFrame, key: str = "feature") -> DataFrame:
    """Exact lookup of a batch of names; a name without an entry has ``found`` false."""
    return names.select(key).join(docs.withColumn("_f", F.lit(True)), key, "left").withColumn(
        "found", F.coalesce("_f", F.lit(False))).drop("_f")


# ---------------------------------------------------------------- vectors
def _nearest(ids, vectors, skips, names, queries, cutoffs, k):
    """Hits of one batch: for every query its k nearest rows under its cutoff, or all of them when k is None."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    dist = np.round(1 - (vectors / np.where(length == 0, np.nan, length)) @ queries.T, _PLACES)
    index = {n: j for j, n in enumerate(names)}
    for i, skip in enumerate(skips):
        for n in skip or ():
            if n in index:
                dist[i, index[n]] = np.inf
    out = []
    for j, name in enumerate(names):
        near = np.flatnonzero(dist[:, j] <= cutoffs[j])
        if k is not None and len(near) > k:
            near = near[np.lexsort((ids[near], dist[near, j]))[:k]]
        out += [(name, ids[i], dist[i, j]) for i in near]
    return out


def vector_hits(docs: DataFrame, queries: DataFrame, k: int | None = TOP_K) -> DataFrame:
    """(query, vec_id, distance): the k nearest rows per query within its cutoff (all of them when ``k`` is None).

    ``docs`` has (vec_id, embedding, skip), where ``skip`` lists queries the row must not answer; ``queries`` has
    (query, vector, cutoff). A null vector, one with a null in it or one of another length answers and asks nothing; ``index_stats``
    counts them. No queries, or a k below 1, have no hits; an empty index is an error. Both sides are cut into a grid of bounded cells; a cell keeps at most k rows per query.
    """
    n, dim = queries.agg(F.count("*"), F.max(F.size("vector"))).head()
    schema = "query bigint, vec_id bigint, distance double"
    if not n or (k is not None and k < 1):
        none = docs.sparkSession.createDataFrame([], schema)
        return none if k is None else none.withColumn("rank", F.lit(1))
    if docs.isEmpty():
        raise CheckFailed("the vector index is empty")
    docs = docs.select("vec_id", "embedding", F.col("skip").cast("array<bigint>").alias("skip"))
    queries = queries.select(F.col("query").cast("long").alias("query"), "vector", "cutoff")
    usable = lambda v: F.col(v).isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull())
    hits = _grid(docs.filter(usable("embedding")), queries.filter(usable("vector")), n, k, schema)
    if k is None:
        return hits
    return first_by(hits, ["query"], [F.col("distance"), F.col("vec_id")], k)


def _grid(docs: DataFrame, queries: DataFrame, n: int, k: int | None, schema: str) -> DataFrame:
    """Every (slice of rows, slice of queries) pair is one bounded group; nothing passes the driver."""
    across, down = math.ceil(n / _CELL_QUERIES), max(1, math.ceil(docs.count() / _CELL_ROWS))
    d = docs.withColumns({"_r": F.pmod(F.xxhash64("vec_id"), F.lit(down)),
                          "_c": F.explode(F.sequence(F.lit(0), F.lit(across - 1)))})
    q = queries.withColumns({"_c": F.pmod(F.xxhash64("query"), F.lit(across)).cast("int"),
                             "_r": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long")))})

    def cell(left, right):
        import pandas as pd
        if left.empty or right.empty:
            return pd.DataFrame({"query": [], "vec_id": [], "distance": []})
        m = np.array(right["vector"].tolist(), dtype="float64")
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        skips = [list(s) if s is not None else [] for s in left["skip"]]
        hits = _nearest(left["vec_id"].to_numpy(), np.array(left["embedding"].tolist(), dtype="float64"), skips,
                        right["query"].tolist(), m, right["cutoff"].to_numpy(), k)
        return pd.DataFrame(hits, columns=["query", "vec_id", "distance"])

    return d.groupBy("_r", "_c").cogroup(q.groupBy("_r", "_c")).applyInPandas(cell, schema)


def expected_distances(docs: DataFrame, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query, vec_id, distance) of given pairs."""
    from auditkit.functions.vectors import cosine_distance
    out = pairs.join(docs.select("vec_id", "embedding"), "vec_id").join(queries.select("query", "vector"), "query")
    return out.select("query", "vec_id", F.round(cosine_distance(F.col("embedding"), F.col("vector")), _PLACES).alias("distance"))


def name_hits(docs: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tier-1 hits (query, vec_id, pos), and the rows with the queries their name already answers as ``skip``."""
    named = keyword_hits(docs.select(F.col("vec_id").alias("pos"), "feature", F.lit("").alias("description")), probes)
    named = named.filter("tier = 1").select(F.col("query").cast("long").alias("query"), F.col("pos").alias("vec_id"))
    skip = named.groupBy("vec_id").agg(F.collect_list("query").alias("skip"))  # at most one entry per query
    return named, docs.join(skip, "vec_id", "left")


def _merge(named: DataFrame, near: DataFrame) -> DataFrame:
    """One ranked list per query: names in dictionary order, then vector hits nearest first."""
    both = named.select("query", "vec_id", F.col("vec_id").alias("_ord"), F.lit(1).alias("tier")).unionByName(
        near.select("query", "vec_id", (F.lit(_TIER2) + F.round(F.col("distance") * 10 ** _PLACES).cast("long")).alias("_ord"),
                    F.lit(2).alias("tier")))
    return positions(both, ["query"], ["_ord", "vec_id"], "rank").drop("_ord")


def two_tier(docs: DataFrame, probes: DataFrame, k: int = TOP_K, ceiling: float = CEILING) -> DataFrame:
    """(query, vec_id, tier, rank): name hits, then at most k vector hits under the ceiling that no name hit covers.

    ``probes`` has (query, text, vector).
    """
    named, rest = name_hits(docs, probes)
    return _merge(named, vector_hits(rest, probes.withColumn("cutoff", F.lit(ceiling)), k))


def band_search(docs: DataFrame, probes: DataFrame, margin: float = BAND, ceiling: float = CEILING) -> DataFrame:
    """Name hits, then everything within ``margin`` of the nearest row, under the ceiling; nothing if the nearest is past it."""
    named, rest = name_hits(docs, probes)
    best = vector_hits(docs.withColumn("skip", F.lit(None)), probes.withColumn("cutoff", F.lit(2.0)), 1)
    cut = best.groupBy("query").agg(F.min("distance").alias("best"))
    limited = probes.join(cut, "query").withColumn(
        "cutoff", F.when(F.col("best") <= ceiling, F.least(F.round(F.col("best") + margin, _PLACES), F.lit(ceiling)))
        .otherwise(F.lit(-1.0)))
    return _merge(named, vector_hits(rest, limited, None))


# ---------------------------------------------------------------- evaluation
def evaluate(probes: DataFrame, hits: DataFrame, expected: DataFrame) -> DataFrame:
    """Per query: recall at 5 and 10, reciprocal rank (null without expectations, 0 when none is found), whether it is empty.

    ``hits`` has (query, vec_id, rank), ``expected`` has (query, vec_id).
    """
    n = expected.groupBy("query").agg(F.count("*").alias("_n"))
    good = hits.join(expected, ["query", "vec_id"]).groupBy("query").agg(
        F.count_if(F.col("rank") <= 5).alias("_5"), F.count_if(F.col("rank") <= 10).alias("_10"), F.min("rank").alias("_first"))
    size = hits.groupBy("query").agg(F.count("*").alias("n_hits"))
    out = probes.select("query", "family").join(n, "query", "left").join(good, "query", "left").join(size, "query", "left")
    has = F.col("_n").isNotNull()

    def over(c: str) -> Column:
        return F.when(has, F.try_divide(F.coalesce(c, F.lit(0)).cast("double"), F.col("_n").cast("double")))

    return out.select("query", "family", over("_5").alias("r5"), over("_10").alias("r10"),
                      F.when(has, F.coalesce(F.try_divide(F.lit(1.0), F.col("_first").cast("double")), F.lit(0.0))).alias("mrr"),
                      F.coalesce("n_hits", F.lit(0)).alias("n_hits"), has.alias("expects"))


def summarise(metrics: DataFrame) -> DataFrame:
    """Per family and over ALL: queries, mean recall and reciprocal rank (nulls skipped), empty results."""
    return metrics.rollup("family").agg(
        F.grouping("family").alias("_all"), F.count("*").alias("n"), F.avg("r5").alias("r5"), F.avg("r10").alias("r10"),
        F.avg("mrr").alias("mrr"), F.count_if(F.col("n_hits") == 0).alias("empty")
    ).withColumn("family", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("family"))).drop("_all")


def movements(new: DataFrame, old: DataFrame) -> DataFrame:
    """Per query: did the new backend do worse than the old one, and which way did the score move?"""
    cols = ["r10", "mrr", "n_hits"]
    a = new.select("query", "expects", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = old.select("query", *[F.col(c).alias(f"b_{c}") for c in cols])
    zero = F.lit(0.0)
    d10 = F.coalesce("a_r10", zero) - F.coalesce("b_r10", zero)
    dm = F.coalesce("a_mrr", zero) - F.coalesce("b_mrr", zero)
    regressed = F.when(F.col("expects"), (d10 < 0) | (dm < 0)).otherwise((F.col("a_n_hits") > 0) & (F.col("b_n_hits") == 0))
    fewer, more = F.col("a_n_hits") < F.col("b_n_hits"), F.col("a_n_hits") > F.col("b_n_hits")
    moved = (F.when(~F.col("expects"), F.when(fewer, "up").when(more, "down").otherwise("same"))
             .when((d10 > 0) | ((d10 == 0) & (dm > 0)), "up").when((d10 < 0) | (dm < 0), "down").otherwise("same"))
    return a.join(b, "query").select("query", regressed.alias("regressed"), moved.alias("moved"))


def diagnose(probes: DataFrame, hits: DataFrame, expected: DataFrame, distances: DataFrame, ceiling: float = CEILING) -> DataFrame:
    """Why expected entries are missing per query: ranking, ceiling or rank cap.

    ``distances`` has (query, vec_id, distance) of the expected entries, and of the nearest entry of the whole index.
    """
    best = distances.groupBy("query").agg(F.min("distance").alias("best"))
    want = expected.join(hits.select("query", "vec_id", F.lit(True).alias("_got")), ["query", "vec_id"], "left").join(
        distances, ["query", "vec_id"], "left")
    missed = F.col("_got").isNull()
    per = want.groupBy("query").agg(F.count_if(missed).alias("missed"),
                                    F.count_if(missed & (F.col("distance") <= ceiling)).alias("missed_inside"))
    cause = (F.when(F.col("missed").isNull(), "not applicable").when(F.col("best").isNull(), "not diagnosed")
             .when(F.col("missed") == 0, "ranking").when(F.col("best") > ceiling, "ceiling")
             .when(F.col("missed_inside") > 0, "rank cap").otherwise("ceiling"))
    return probes.select("query").join(per, "query", "left").join(best, "query", "left").select(
        "query", F.coalesce("missed", F.lit(0)).alias("missed"), F.coalesce("missed_inside", F.lit(0)).alias("missed_inside"),
        cause.alias("cause"))


def index_stats(docs: DataFrame, vector: str = "embedding", expected: int | None = None) -> DataFrame:
    size = F.when(F.col(vector).isNotNull(), F.size(vector))
    out = docs.agg(F.count("*").alias("rows"), F.count(vector).alias("non_null"), F.min(size).alias("dim_min"), F.max(size).alias("dim_max"))
    return out.withColumn("expected_dimension", F.lit(expected))


# ---------------------------------------------------------------- embedding
def embed(docs: DataFrame, text: str = "text", dim: int = 384, encode=None) -> DataFrame:
    """Unit vectors of whole texts as ``embedding``.

    With ``encode`` (a function that returns a function from a list of texts to a list of vectors) each task sets the
    encoder up once and feeds it batches; without it, hashed term weights stand in, computed by Spark ML.
    """
    if encode is None:
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
        from pyspark.ml.functions import vector_to_array
        stages = [RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"[^\p{L}\p{N}]+"),
                  HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dim), IDF(inputCol="_tf", outputCol="_v"),
                  Normalizer(inputCol="_v", outputCol="_u")]
        out = Pipeline(stages=stages).fit(docs).transform(docs)
        return out.select(*docs.columns, vector_to_array("_u", "float32").alias("embedding"))

    def run(batches):
        model = encode()
        for pdf in batches:
            m = np.array(model(pdf[text].tolist()), dtype="float64")
            length = np.linalg.norm(m, axis=1, keepdims=True)
            yield pdf.assign(embedding=list((m / np.where(length == 0, 1, length)).astype("float32")))

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInPandas(run, f"{fields}, embedding array<float>")
