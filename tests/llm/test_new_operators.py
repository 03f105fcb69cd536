"""Whitening, vector codes and sharding against plain versions, and on nulls, ties, repeats, hot rows, empty tables and odd columns."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditkit.llm import pivots, shards
from auditkit.llm.lookup import look_up
from auditkit.llm.catalog import QUERIES
from auditkit.llm.whiten import whiten, whole
from auditkit.sources.staging import materialize

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, label int"


def odd_columns(df):
    for name in ("x", "w", "rows", "component", "n", "white", "key", "size", "shard", "slot", "one", "run", "nth"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("clash"))
    return df


def some_vectors(seed=3, n=300, d=20):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 0.3
    rows = [(i, mixed[i].astype(np.float32).tolist(), i % 4 if i % 5 else None) for i in range(n)]
    hot = rows[7][1]
    rows += [(1000 + i, hot, 9) for i in range(200)] + [(7, hot, 3), (None, hot, None)]
    rows += [(5000, None, 1), (5001, [*hot[:-1], None], 1), (5002, [*hot[:-1], float("nan")], 1), (5003, [*hot[:-1], float("inf")], 1)]
    return rows


def write_vectors(spark, folder, rows):
    spark.createDataFrame(rows, VECTORS).repartition(7).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


# ---- whitening

def plain_x(rows):
    return [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening(spark, weights):
    rows = some_vectors()
    kept = plain_x(rows)
    times = Counter(x for _, x in kept)
    fit = list(times) if weights == "one" else [x for _, x in kept]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    xs = np.array(fit, float) - np.array(sums) / n
    e, axes = np.linalg.eigh(xs.T @ xs / n)
    e, axes = e[::-1], axes[:, ::-1]
    df = odd_columns(spark.createDataFrame(rows, VECTORS).withColumnRenamed("vec_id", "id")).drop("x").withColumn("x", whole(F.col("embedding"), 64, 1_000_000))
    got = whiten(df, weights=weights).collect()
    assert Counter(r["id"] for r in got) == Counter({i: 16 * c for i, c in Counter(i for i, _ in kept).items()})
    by = defaultdict(set)
    for i, x in kept:
        by[i].add(x)
    signs = {}
    for r in got:
        (x,) = by[r["id"]]
        k = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, sum((n * c - s) ** 2 for c, s in zip(x, sums)))
        want = float((np.array(x) - np.array(sums) / n) @ axes[:, k] / math.sqrt(e[k]))
        if abs(want) > 1e-3:
            assert signs.setdefault(k, math.copysign(1, want * r["whitened"])) == math.copysign(1, want * r["whitened"])
        assert abs(r["whitened"]) == pytest.approx(abs(want), rel=1e-6, abs=1e-9)
        assert r["explained"] == pytest.approx(e[k] / e.sum(), rel=1e-9) and r["identity_error"] < 1e-9


def test_whitening_without_variance(spark):
    def of(rows):
        return whiten(spark.createDataFrame(rows, "id long, x array<long>"), fill=1_000_000).orderBy("id", "component").collect()

    same = of([(1, [5, 5, 5]), (2, [5, 5, 5])])
    assert len(same) == 6 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in same)
    line = of([(1, [0, 0]), (2, [2, 2]), (3, [2, 2])])
    assert [r["whitened"] is None for r in line] == [False, True] * 3 and line[0]["explained"] == pytest.approx(1) and line[0]["identity_error"] < 1e-9
    short = of([(1, [1_000_000]), (2, [1_000_000, 1_000_004]), (3, None)])
    assert [r["id"] for r in short] == [1, 1, 2, 2] and short[0]["deviation"] == 16
    far = of([(1, [2**62, 0]), (2, [-(2**62), 3])])
    assert far[0]["deviation"] == (2 * 2**62) ** 2 + 9 and abs(far[0]["whitened"]) == pytest.approx(1)
    assert of([(1, []), (2, [])]) == [] and of([]) == []


def test_whitening_query_on_odd_table(spark, tmp_path):
    rows = some_vectors()
    got = QUERIES["op11_whiten"](spark, write_vectors(spark, tmp_path, [*rows, (6000, [3e38] + [0.0] * 19, 1)])).collect()
    assert Counter(r["vec_id"] for r in got) == Counter({i: 16 * c for i, c in Counter([*(i for i, _ in plain_x(rows)), 6000]).items()})


# ---- look-up

def test_look_up_meets_hot_keys_and_nulls(spark):
    rows = materialize(spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 700).otherwise(F.lit(None)).alias("k")))
    table = materialize(rows.groupBy("k").agg(F.count("*").alias("c"), F.max("id").alias("most")))
    got = look_up(rows, table, "k", "c")
    assert got.columns == ["id", "k", "most"]
    want = {r["k"]: r["most"] for r in table.collect()}
    assert sorted((r["id"], r["most"]) for r in got.collect()) == sorted((r["id"], want[r["k"]]) for r in rows.collect())
    assert look_up(rows.limit(0), table.limit(0), "k", "c").count() == 0


# ---- vector codes

def plain_codes(rows, rounds=6):
    kept = [(i, [math.floor(4096 * float(c)) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    length = -(-max(len(v) for _, v, _ in kept) // 8) * 8
    kept = [(i, v + [0] * (length - len(v)), label) for i, v, label in kept]
    s = length // 8
    ids = sorted({i for i, _, _ in kept if i is not None})[:16]
    books = [[min(v for j, v, _ in kept if j == i)[p * s:p * s + s] for i in ids] for p in range(8)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(8):
            mine = defaultdict(list)
            for _, v, _ in kept:
                mine[nearest(v[p * s:p * s + s], books[p])[1]].append(v[p * s:p * s + s])
            for e, parts in mine.items():
                books[p][e] = [sum(c) // len(parts) for c in zip(*parts)]
    out, by_label = [], Counter()
    for i, v, label in kept:
        found = [nearest(v[p * s:p * s + s], books[p]) for p in range(8)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
        by_label[label] += out[-1][2]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter((i, code, error, by_label[label], sha) for i, code, error, label in out)


def codes(spark, folder):
    return Counter(tuple(r) for r in QUERIES["op12_vector_codes"](spark, folder).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


@pytest.mark.parametrize("case", ["mixed", "ties", "few", "ragged", "far"])
def test_vector_codes(spark, tmp_path, case):
    rng = np.random.default_rng(8)
    rows = {"mixed": some_vectors(d=24),
            "ties": [(i, [float(c) / 4096 for c in rng.integers(-2, 3, 16)], i % 2) for i in range(150)],
            "few": [(3, [0.5] * 8, None), (3, [0.25] * 8, 1), (9, [-0.1] * 8, 1)],
            "ragged": [(i, rng.normal(size=5 + i % 9).astype(np.float32).tolist(), 0) for i in range(60)],
            "far": [(i, (rng.normal(size=8) * 10.0 ** int(rng.integers(0, 14))).astype(np.float32).tolist(), 0) for i in range(60)]}[case]
    want = plain_codes(rows)
    if case == "far":  # errors past a long are null
        want = Counter({(i, c, e if e < 2**63 else None, le if le < 2**63 else None, sha): k for (i, c, e, le, sha), k in want.items()})
    assert codes(spark, write_vectors(spark, tmp_path, rows)) == want


def test_vector_codes_of_nothing(spark, tmp_path):
    assert not codes(spark, write_vectors(spark, tmp_path / "a", []))
    assert list(codes(spark, write_vectors(spark, tmp_path / "b", [(None, [1.0] * 8, 1), (1, None, 1)]))) == [(None, "", 0, 0, hashlib.sha256(b"").hexdigest())]


def test_bounds_prune_and_never_lose():
    rng = np.random.default_rng(11)
    for scale in (3, 5_000, 10**9, 10**17):
        book = (rng.normal(size=(16, 8)) * scale).astype(np.int64)
        part = np.concatenate([(book[rng.integers(0, 16, 400)] + rng.normal(size=(400, 8)) * scale * 0.1).astype(np.int64), book])
        fixed = pivots.spread(book, 3)
        far = np.sqrt(pivots.squares(part, fixed).astype(float))
        which, best, evaluated = pivots.nearest(part, far, book, fixed)
        exact = pivots.squares(part, book)
        assert (exact.argmin(axis=1) == which).all() and (exact.min(axis=1) == best).all()
        assert evaluated < 0.5 * exact.size


# ---- sharding

def plain_shard(key, weights):
    def bid(s):
        u = (int(hashlib.md5(f"{'' if key is None else key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u) / weights[s]
    return min((s for s in range(len(weights)) if weights[s] > 0), key=bid)


def test_shards(spark):
    rng = np.random.default_rng(12)
    rows = [(int(i), "é" * int(i % 7) if i % 11 else None) for i in rng.integers(0, 900, 1500)]
    rows += [(5, "same")] * 5000 + [(None, "x"), (None, None), (77, "long " * 50_000)]
    docs = odd_columns(spark.createDataFrame(rows, "doc_id long, text string"))
    weights = [1.0, 2.0, 0.5, 0.0, 1.5]
    got = shards.assign(docs, weights, more=1.0).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = defaultdict(list)
    for r in got:
        assert r["shard"] == plain_shard(r["doc_id"], weights) and r["grown_shard"] == plain_shard(r["doc_id"], [*weights, 1.0])
        assert r["grown_shard"] in (r["shard"], 5)
        slots[r["shard"]].append(r["slot"])
    assert 3 not in slots and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r["grown_shard"] for r in shards.assign(docs, weights).collect()} == {None}
    assert shards.assign(docs.limit(0), weights, more=1.0).count() == 0


def test_weights_share_and_few_move(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = shards.assign(docs, [1.0, 1.0, 2.0], more=1.0).groupBy("shard").agg(F.count("*").alias("n"), F.avg((F.col("shard") != F.col("grown_shard")).cast("int")).alias("moved")).collect()
    for r in got:
        assert r["n"] == pytest.approx(40_000 * (0.5 if r["shard"] == 2 else 0.25), rel=0.05) and r["moved"] == pytest.approx(0.2, abs=0.02)


def test_sharding_uses_no_python(spark):
    plan = QUERIES["op13_rendezvous_shards"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
