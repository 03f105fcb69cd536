"""Search: both ways of each path agree, and hits equal brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditkit.operators import search
from auditkit.operators.columns import CheckFailed


def docs(spark, n=120, dim=6):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=dim)], f"src{i % 4}_{i}") for i in range(n)]
    rows += [(n, [0.0] * dim, "zero"), (n + 1, rows[0][1], "twin")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, feature string").repartition(5)


def probes(spark, n=9, dim=6):
    rng = np.random.default_rng(4)
    return spark.createDataFrame([(j, f"src{j}_", [float(x) for x in rng.normal(size=dim)]) for j in range(n)],
                                 "query long, text string, vector array<double>")


def brute(spark_docs, spark_probes, k, ceiling, skip_named=False):
    d = sorted((r["vec_id"], np.array(r["embedding"], dtype="float64"), r["feature"]) for r in spark_docs.collect() if any(r["embedding"]))
    out = set()
    for p in spark_probes.collect():
        v = np.array(p["vector"])
        near = [(round(1 - float(e @ v) / np.linalg.norm(e) / np.linalg.norm(v), 9), i) for i, e, f in d
                if not (skip_named and p["text"] in f)]
        near = sorted(x for x in near if x[0] <= ceiling)
        out |= {(p["query"], i) for _, i in (near[:k] if k else near)}
    return out


@pytest.fixture(params=["one cell", "grid"])
def path(request, monkeypatch):
    if request.param == "grid":
        monkeypatch.setattr(search, "_CELL_ROWS", 40)
        monkeypatch.setattr(search, "_CELL_QUERIES", 4)


def test_null_vectors_answer_nothing(spark, path):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [0.0, None]), (5, [1.0, 0.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("skip", F.lit(None))
    p = spark.createDataFrame([(7, [0.0, 1.0], 2.0), (8, None, 2.0)], "query long, vector array<double>, cutoff double")
    got = search.vector_hits(d, p, 1).collect()
    assert [(r["query"], r["vec_id"], r["distance"]) for r in got] == [(7, 3, 0.0)]


@pytest.mark.parametrize("k,ceiling", [(5, 2.0), (5, 0.6), (None, 0.6)])
def test_vector_hits(spark, path, k, ceiling):
    d, p = docs(spark), probes(spark)
    got = search.vector_hits(d.withColumn("skip", F.lit(None)), p.withColumn("cutoff", F.lit(ceiling)), k)
    assert {(r["query"], r["vec_id"]) for r in got.collect()} == brute(d, p, k, ceiling)


def test_two_tier(spark):
    d, p = docs(spark), probes(spark)
    rows = search.two_tier(d, p, 3, 0.8).collect()
    second = {(r["query"], r["vec_id"]) for r in rows if r["tier"] == 2}
    assert second == brute(d, p, 3, 0.8, skip_named=True)
    for j in range(9):
        mine = sorted((r["rank"], r["tier"], r["vec_id"]) for r in rows if r["query"] == j)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and mine == sorted(mine, key=lambda m: (m[1], m[0]))
        assert [m[2] for m in mine if m[1] == 1] == ([i for i in range(120) if i % 4 == j] if j < 4 else [])


def test_empty_index_is_an_error(spark):
    with pytest.raises(CheckFailed, match="empty"):
        search.vector_hits(docs(spark).withColumn("skip", F.lit(None)).limit(0), probes(spark).withColumn("cutoff", F.lit(1.0)))


def test_keyword_hits(spark):
    texts = ["Alpha beta", "beta GAMMA delta", "", None, "alphabet"]
    d = spark.createDataFrame([(i, f"name_{i}{'_beta' if i == 4 else ''}", t) for i, t in enumerate(texts)] + [(9, None, "none")], "pos long, feature string, description string")
    q = spark.createDataFrame([("q1", "beta"), ("q2", "ALPHA"), ("q3", "a"), ("q4", "none such"), ("q5", "beta"), ("q6", " \n\t"), ("q7", None)], "query string, text string")
    want = {("q1", 4, 1), ("q5", 4, 1), ("q1", 0, 2), ("q5", 0, 2), ("q1", 1, 2), ("q5", 1, 2), ("q2", 0, 2), ("q2", 4, 2)} | {
        ("q3", i, 1) for i in range(5)}
    got = search.keyword_hits(d, q).collect()
    assert {(r["query"], r["pos"], r["tier"]) for r in got} == want and len(got) == len(want)
    ranks = [(r["pos"], r["rank"]) for r in search.ranked(search.keyword_hits(d, q)).filter("query = 'q1'").orderBy("rank").collect()]
    assert ranks == [(4, 1), (0, 2), (1, 3)]
    assert search.keyword_hits(d, q.filter("query in ('q6', 'q7')")).count() == 0 == search.keyword_hits(d.limit(0), q).count()


def test_keyword_hits_are_substrings(spark):
    """Many queries of every length against brute force: repeats, line ends, accents, characters beyond 16 bits, special signs."""
    rng = np.random.default_rng(6)
    letters = list("abAé \n.*(\U0001f600")
    texts = ["".join(rng.choice(letters, size=rng.integers(0, 60))) for _ in range(80)] + ["aaaaaaaa" * 900]
    d = [(i, "".join(rng.choice(letters, size=rng.integers(0, 9))), t) for i, t in enumerate(texts)]
    asked = ["".join(rng.choice(letters, size=rng.integers(1, 6))) for _ in range(400)] + [t[5:25] for t in texts] + ["a" * 7000, "zzz", "a\U0001f600"]
    got = search.keyword_hits(spark.createDataFrame(d, "pos long, feature string, description string"),
                              spark.createDataFrame(list(enumerate(asked)), "query long, text string")).collect()
    low = lambda t: t.lower()
    want = {(j, i, 1 if low(t.strip()) in low(n) else 2) for j, t in enumerate(asked) if t.strip()
            for i, n, x in d if low(t.strip()) in low(n) or low(t.strip()) in low(x)}
    assert {(r["query"], r["pos"], r["tier"]) for r in got} == want and len(got) == len(want)


def test_keyword_search_collects_no_query(spark, monkeypatch):
    d = spark.createDataFrame([(1, "name", "some text")], "pos long, feature string, description string")
    q = spark.range(50_000).select("id", F.concat(F.lit("text"), "id").alias("text")).withColumnRenamed("id", "query").unionByName(
        spark.createDataFrame([(-1, "me te")], "query long, text string"))
    rows, whole = [], type(d).collect
    monkeypatch.setattr(type(d), "collect", lambda self: rows.append(whole(self)) or rows[-1])
    got = search.keyword_hits(d, q)
    assert sum(map(len, rows)) <= search.GRAM
    assert [tuple(r) for r in whole(got)] == [(-1, 1, "name", 2)]


def test_evaluation(spark):
    p = spark.createDataFrame([(1, "f"), (2, "f"), (3, "none")], "query long, family string")
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 6), (3, 10, 1)], "query long, vec_id long, rank int")
    want = spark.createDataFrame([(1, 11), (1, 12), (2, 10)], "query long, vec_id long")
    got = {r["query"]: (r["r5"], r["r10"], r["mrr"]) for r in search.evaluate(p, hits, want).collect()}
    assert got == {1: (0.5, 1.0, 0.5), 2: (0.0, 0.0, 0.0), 3: (None, None, None)}
    total = {r["family"]: (r["n"], r["r10"], r["empty"]) for r in search.summarise(search.evaluate(p, hits, want)).collect()}
    assert total == {"f": (2, 0.5, 1), "none": (1, None, 0), "ALL": (3, 0.5, 1)}


def test_embed_with_an_encoder(spark):
    d = spark.createDataFrame([(1, "ab"), (2, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["embedding"] for r in search.embed(d, encode=lambda: lambda texts: [[len(t) * 3.0, len(t) * 4.0] for t in texts]).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == [0.0, 0.0]
