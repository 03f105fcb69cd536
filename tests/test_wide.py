"""Operators without a cap on columns or levels, against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from auditkit.operators import prep, profile


def test_correlation_by_tiles(spark):
    """Blocks of several sizes give the correlations of numpy, with constant columns and one with a null left blank."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 9)) @ rng.normal(size=(9, 9)) + 1e6
    x[:, 4] = 3.25
    rows = [tuple(None if (i, j) == (7, 6) else float(v) for j, v in enumerate(r)) for i, r in enumerate(x)]
    names = [f"c`{j}" if j == 2 else f"c{j}" for j in range(9)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n.replace('`', '``')}` double" for n in names)).repartition(4)
    df, names = df.toDF(*[f"c{j}" for j in range(9)]), [f"c{j}" for j in range(9)]
    want = np.corrcoef(x.T)
    for block in (1, 4, 1000):
        got = profile.correlation(df, names, block).collect()
        assert len(got) == 72 and len({(r["feature"], r["neighbour"]) for r in got}) == 72
        for r in got:
            i, j = int(r["feature"][1:]), int(r["neighbour"][1:])
            assert (r["r"] is None) == bool({i, j} & {4, 6})
            assert r["r"] is None or abs(r["r"] - want[i, j]) < 1e-9
    assert all(r["r"] is None for r in profile.correlation(df.limit(0), names).collect())
    assert profile.correlation(df, names[:1]).count() == 0


def test_more_columns_than_a_driver_table_held(spark):
    """2,001 columns: past the former limit, in tiles of 1,001."""
    p = 2_001
    df = spark.range(60).select(*[F.rand(j).alias(f"c{j}") for j in range(p)]).cache()
    pairs = profile.correlation(df, [f"c{j}" for j in range(p)], 1_001)
    x = df.toPandas().to_numpy()
    got = pairs.filter("feature in ('c3', 'c1700') and neighbour in ('c5', 'c1999', 'c901')").collect()
    assert len(got) == 6 and all(abs(r["r"] - np.corrcoef(x[:, int(r["feature"][1:])], x[:, int(r["neighbour"][1:])])[0, 1]) < 1e-9 for r in got)
    assert pairs.count() == p * (p - 1)


def test_sparse_one_hot(spark):
    rows = [(i, f"l{i % 5000}" if i % 7 else "hot", None if i % 3 else "x") for i in range(12_000)]
    train = spark.createDataFrame(rows, "k long, free string, few string")
    test = spark.createDataFrame([(1, "l3", "x"), (2, "never", None), (3, "hot", "other"), (4, None, None)], train.schema)
    table = prep.level_table(train, ("free", "few"))
    place = {(r["family"], r["level"]): r["place"] for r in table.collect()}
    order = sorted(place, key=lambda f: (("free", "few").index(f[0]), f[1]))
    assert [place[k] for k in order] == list(range(len(order))) and len(order) > 4_000
    got = {r["k"]: (r["size"], r["indices"], r["values"]) for r in prep.sparse_one_hot(test, table, ("free", "few"), "k").collect()}
    want = {1: [("free", "l3"), ("few", "x")], 2: [("few", "missing")], 3: [("free", "hot")], 4: [("few", "missing")]}
    assert got == {k: (len(order), [place[w] for w in ws], [1.0] * len(ws)) for k, ws in want.items()}
    whole = prep.sparse_one_hot(train, table, ("free", "few"), "k")
    assert whole.filter(F.size("indices") == 2).count() == 12_000
