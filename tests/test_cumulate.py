"""Running sums, positions and quantiles against brute force, with groups that must be cut into ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditkit.operators import metrics
from auditkit.operators.cumulate import cumulate, positions, quantiles
from auditkit.operators.profile import rank_auc


def rows(n=700, seed=1):
    rng = random.Random(seed)
    # One key holds more than a third of all rows.
    return [(rng.choice(["hot", "hot", "a", "b", "c"]), float(i if i % 3 else i / 7), rng.randint(1, 9)) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "k string, v double, n long").groupBy("k", "v").agg(F.sum("n").alias("n"))


@pytest.mark.parametrize("keys", [["k"], []])
def test_cumulate_large_groups(spark, keys):
    df = frame(spark, rows())
    df = df if keys else df.groupBy("v").agg(F.sum("n").alias("n"))
    got = {(r["k"] if keys else "", r["v"]): r["n_before"] for r in cumulate(df, keys, ["v"], ["n"]).collect()}
    seen = {}
    for r in sorted(df.collect(), key=lambda r: (r["k"] if keys else "", r["v"])):
        k = r["k"] if keys else ""
        assert got[(k, r["v"])] == seen.get(k, 0)
        seen[k] = seen.get(k, 0) + r["n"]


def test_one_hot_group_covers_many_ranges(spark):
    """No task gets a whole large group, and nothing is broadcast that grows with it."""
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").cast("double").alias("v"), F.lit(1).cast("long").alias("n"))
    out = cumulate(df, ["k"], ["v"], ["n"])
    assert out.filter("n_before <> v").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan and "percentile" not in plan


def test_positions(spark):
    df = spark.createDataFrame([("hot" if i % 3 else "b", i) for i in range(300)], "run string, event_id long")
    got = positions(df, ["run"], ["event_id"], "seq").collect()
    for run in ("hot", "b"):
        ordered = [r["seq"] for r in sorted((r for r in got if r["run"] == run), key=lambda r: r["event_id"])]
        assert ordered == list(range(1, len(ordered) + 1))


def test_quantiles(spark):
    data = rows(seed=3)
    got = {r["k"]: r for r in quantiles(frame(spark, data), ["k"], "v", "n", {"lo": 0.01, "mid": 0.5, "hi": 0.95}).collect()}
    for k in {d[0] for d in data}:
        values = np.repeat([d[1] for d in data if d[0] == k], [d[2] for d in data if d[0] == k])
        for name, p in (("lo", 0.01), ("mid", 0.5), ("hi", 0.95)):
            assert got[k][name] == pytest.approx(np.quantile(values, p))


def test_auc_by_pairs(spark):
    rng = random.Random(4)
    pts = [(rng.randint(0, 60) / 10, rng.randint(0, 1)) for _ in range(300)]
    df = spark.createDataFrame([("g", s, y) for s, y in pts], "g string, score double, label int")
    hist = metrics.score_histogram(df, ["g"])
    wins = [1.0 if p > n else 0.5 if p == n else 0.0 for p, a in pts if a for n, b in pts if not b]
    assert metrics.auc(hist, ["g"]).head()["auc"] == pytest.approx(sum(wins) / len(wins))


def test_auc_undefined(spark):
    df = spark.createDataFrame([("one class", 1.0, 3, 0), ("one class", 2.0, 2, 0), ("constant", 1.0, 3, 4)],
                               "k string, value double, pos long, neg long")
    assert {r["auc"] for r in rank_auc(df, ["k"]).collect()} == {None}


def test_reversed_feature_is_not_folded(spark):
    df = spark.createDataFrame([("k", 1.0, 1, 0), ("k", 2.0, 0, 1)], "k string, value double, pos long, neg long")
    assert rank_auc(df, ["k"]).head()["auc"] == 0.0


def test_average_precision_and_curve(spark):
    rng = random.Random(5)
    pts = [(rng.randint(0, 80) / 10, rng.randint(0, 1)) for _ in range(200)]
    df = spark.createDataFrame(pts, "score double, label int")
    hist = metrics.score_histogram(df, [])
    p = sum(y for _, y in pts)
    ap, seen, tp = 0.0, 0, 0
    for t in sorted({s for s, _ in pts}, reverse=True):
        here = [y for s, y in pts if s == t]
        seen, tp = seen + len(here), tp + sum(here)
        ap += sum(here) / p * tp / seen
    assert metrics.average_precision(hist, []).head()[0] == pytest.approx(ap)
    last = metrics.curve(hist, []).orderBy("threshold").head()
    assert (last["tp"], last["fp"], last["recall"]) == (p, len(pts) - p, 1.0)
