"""Models, search and attributions: plain versions, exact additivity and direction of change, not levels."""

import math
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditkit.operators import boost, model, parzen, treeshap
from auditkit.operators.parzen import Range

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    x = (F.rand(1) * 10).alias("a"), F.when(F.rand(5) > 0.1, F.rand(2) * 10).alias("b"), F.floor(F.rand(3) * 3).cast("double").alias("c")
    df = spark.range(600).select(F.col("id").alias("row_id"), *x)
    df = df.withColumn("label", (F.col("a") + F.rand(4) * 6 > 8).cast("int")).withColumn("leak", F.col("label") * (F.coalesce("b", F.lit(0)) + 1))
    return df.cache()


@pytest.fixture(scope="module")
def bins(data):
    return model.bin_matrix(data, NAMES, F.col("row_id") % 3, (0, 1))


def test_logistic_attribution_adds_up(spark, data):
    names, data = ["a", "c"], data.select("row_id", "label", "a", "c")
    fitted = model.fit_logistic(data, names, 200)
    w, means = model.linear_weights(fitted, names)
    scored = model.score(fitted, data, names).toPandas().set_index("row_id")["score"]
    rows = data.toPandas().set_index("row_id")
    margin = fitted.stages[1].intercept + sum(w[n] * (rows[n] - means[n]) for n in names)
    assert np.allclose(np.log(scored / (1 - scored)), margin)
    assert w["a"] > 0 and model.evaluate(model.score(fitted, data, names))["roc_auc"] > 0.8


# ---- bins

def test_bins_follow_exact_quantiles(spark):
    values = [None, float("nan")] + [float(i % 7) for i in range(100)]
    df = spark.createDataFrame([(i, v, float(i)) for i, v in enumerate(values)], "row_id long, few double, many double")
    few, many = boost.cut_points(df, ["few", "many"], bins=10)
    assert few.tolist() == [0, 1, 2, 3, 4, 5, 6]
    assert many.tolist() == [float(math.ceil(k * 102 / 10)) for k in range(10)]
    rows = df.unionByName(spark.createDataFrame([(500, -9.0, 1e9)], df.schema))
    got = {r["row_id"]: bytes(r["bins"]) for r in boost.binned(rows, ["few", "many"], [few, many], ["row_id"]).collect()}
    assert got[0] == bytes([0, 1]) and got[1][0] == 0 and got[2][0] == 1 and got[8][0] == 7 and got[500] == bytes([1, 10])
    empty, = boost.cut_points(df.filter("row_id < 2"), ["few"])
    assert len(empty) == 0 and {bytes(r["bins"]) for r in boost.binned(df, ["few"], [empty], ["row_id"]).collect()} >= {bytes([0])}


# ---- trees

def plain_boost(x, y, p, rounds):
    """Second-order boosting by its definition, a node at a time, in exact sums of the same units."""
    pos = y.sum()
    w = np.where(y == 1, (len(y) - pos) / pos, 1.0)
    top = w.max()
    margin, trees = np.zeros(len(y)), []

    def grow(rows, g, h, depth):
        def worth(r):
            return np.sign(g[r].sum()) ** 2 * max(abs(g[r].sum()) - p["reg_alpha"], 0) ** 2 / (h[r].sum() + p["reg_lambda"])
        best = None
        if depth < p["max_depth"]:
            for c in range(x.shape[1]):
                for cut in np.unique(x[rows, c])[:-1]:
                    left, right = rows[x[rows, c] <= cut], rows[x[rows, c] > cut]
                    if min(h[left].sum(), h[right].sum()) < p["min_child_weight"]:
                        continue
                    gain = worth(left) + worth(right) - worth(rows)
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, c, cut, left, right)
        if best is None or best[0] <= 1e-6 or best[0] < p["gamma"]:
            total = g[rows].sum()
            return -p["learning_rate"] * np.sign(total) * max(abs(total) - p["reg_alpha"], 0) / (h[rows].sum() + p["reg_lambda"])
        return (best[1], best[2], grow(best[3], g, h, depth + 1), grow(best[4], g, h, depth + 1))

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = (np.rint(v * w / top * 2.0**24) / 2.0**24 * top for v in (q - y, q * (1 - q)))
        trees.append(grow(np.arange(len(y)), g, h, 0))
        margin = margin + np.array([value(trees[-1], r) for r in x])
    return margin


@pytest.mark.parametrize("strengths", [{}, {"reg_alpha": 1.5, "reg_lambda": 0.3, "gamma": 2.0, "min_child_weight": 7.0, "max_depth": 4}])
def test_trees_are_the_definition(bins, strengths):
    rows = bins.table.filter("fold < 2").toPandas()
    x = np.stack([np.frombuffer(b, np.uint8) for b in rows.bins]).astype(int)
    spec = boost.Spec({"n_estimators": 4, "max_depth": 3, **strengths}, folds=(0, 1))
    want = plain_boost(x, rows.label.to_numpy(), spec.params, 4)
    for small in (0, 60, 1 << 16):  # by histograms alone, mixed, by rows alone
        fitted, = boost.boost(bins.table, bins.names, bins.cuts, [spec], small=small)
        assert np.allclose(fitted.margins(x), want, atol=1e-9)


def same(a, b):
    return all((getattr(s, f) == getattr(t, f)).all() for s, t in zip(a.trees, b.trees, strict=True) for f in ("column", "cut", "value", "cover"))


def test_order_partitions_company_and_ways_change_nothing(spark, bins, monkeypatch):
    p = {"n_estimators": 30, "max_depth": 5, "subsample": 0.7, "colsample_bytree": 0.7}
    spec = boost.Spec(p, folds=(0, 1))
    one, = boost.boost(bins.table, bins.names, bins.cuts, [spec])
    monkeypatch.setattr(boost, "BLOCK", 90)
    monkeypatch.setattr(boost, "CHUNK", 1)  # every column is a chunk of its own
    shuffled = model.materialize(bins.table.repartition(5, F.rand(3)).sortWithinPartitions(F.rand(8)))
    many = boost.boost(shuffled, bins.names, bins.cuts, [boost.Spec({**p, "n_estimators": 3}), spec, boost.Spec(p, folds=(0, 1), seed=1)], small=100)
    assert same(one, many[1]) and not same(one, many[2]) and len(many[0].trees) == 3


def test_blocks_for_every_core_and_sums_handed_over(spark, bins, monkeypatch):
    """A small table is cut for all cores, joint bins add up to plain ones, and sums that skip the shuffle change no bit."""
    monkeypatch.setattr(boost, "LEAST_BLOCK", 100)
    n = bins.table.count()
    blocks = boost._pack(bins.table, len(bins.names), 1, n).map(lambda b: (b[0].shape, len(b[1]))).collect()
    assert len(blocks) == min(8, n // 100) and sum(rows for _, rows in blocks) == n and all(s == (len(bins.names), rows) for s, rows in blocks)
    rng = np.random.default_rng(5)
    widths, rows = [3, 200, 2, 5, 3], 4000
    own, slot = np.stack([rng.integers(0, w, rows) for w in widths], axis=1).astype(np.uint8), rng.integers(0, 2, rows)
    g, h = rng.integers(-99, 99, rows), rng.integers(0, 99, rows)
    got, at = boost._add_up(own, slot, g, h, 2, [0, 1, 2, 3, 4], widths), 0
    assert len(boost._joint([0, 1, 2, 3, 4], widths, 512)) == 2
    for c, w in enumerate(widths):
        want = np.stack([np.bincount(slot * w + own[:, c], v, 2 * w).reshape(2, w) for v in (g, h, None)], axis=2)
        assert (got[:, at:at + w] == want).all()
        at += w
    spec = boost.Spec({"n_estimators": 3, "max_depth": 4})
    a, b = (boost.boost(bins.table, bins.names, bins.cuts, [spec], small=k)[0] for k in (None, 50))
    assert all((x.column == y.column).all() and (x.value == y.value).all() and (x.cover == y.cover).all() for x, y in zip(a.trees, b.trees))


def test_models_in_tasks_are_those_of_passes(spark, bins, monkeypatch):
    """Several models whose rows a task may hold make no pass at all; beyond that they do, and both ways give the same trees."""
    specs = [boost.Spec({"n_estimators": 6}, folds=(0, 1)), boost.Spec({"n_estimators": 3, "max_depth": 9, "subsample": 0.6, "colsample_bytree": 0.7}, folds=(0,), seed=3),
             boost.Spec({"n_estimators": 4, "gamma": 1.0, "reg_alpha": 2.0}, (0, 2), (1,)), boost.Spec({"n_estimators": 2}, folds=(7,))]
    passes, step = [], boost._round
    monkeypatch.setattr(boost, "_round", lambda *a: passes.append(a[3]) or step(*a))
    alone = boost.boost(bins.table, bins.names, bins.cuts, specs)
    assert not passes
    monkeypatch.setattr(boost, "ALONE", 0)
    together = boost.boost(bins.table, bins.names, bins.cuts, specs)
    assert passes and all(passes)
    monkeypatch.setattr(boost, "HANDED", 0)
    shuffled = boost.boost(bins.table, bins.names, bins.cuts, specs)
    assert not passes[-1] and all(same(a, b) and same(a, c) for a, b, c in zip(alone, together, shuffled, strict=True))


def test_a_model_in_a_task_goes_through_its_rows_in_slices(bins, monkeypatch):
    """Nothing that is worked on at once grows with the rows, and slices change no bit, drawn rows and columns included."""
    rows = bins.table.filter("fold < 2").toPandas()
    x = np.stack([np.frombuffer(b, np.uint8) for b in rows.bins], axis=1)
    y, key, widths = rows.label.to_numpy().astype(np.int8), rows.key.to_numpy().astype(np.uint64), [len(c) + 1 for c in bins.cuts]
    w = (y == 0).sum() / y.sum()
    scale = (max(w, 1.0), (1 / max(w, 1.0), w / max(w, 1.0)))
    for p in ({"n_estimators": 5}, {"n_estimators": 5, "max_depth": 9, "subsample": 0.6, "colsample_bytree": 0.7, "reg_alpha": 0.5, "min_child_weight": 0.1}):
        spec = boost.Spec(p, folds=(0, 1))
        want, = boost.boost(bins.table, bins.names, bins.cuts, [spec], small=0)
        sizes, slopes = [], boost._slopes
        with monkeypatch.context() as m:
            m.setattr(boost, "SLICE", 90)
            m.setattr(boost, "_slopes", lambda margins, *a: sizes.append(len(margins)) or slopes(margins, *a))
            got = boost.grow_alone(x, y, key, spec, bins.names, widths, scale)
        assert max(sizes) <= 90 and same(boost.Model(bins.names, bins.cuts, got), want)


def test_costly_models_start_first():
    """One task each, in the order of trees times depth."""
    assert boost._dealt([boost.Spec({"n_estimators": n, "max_depth": d}) for n, d in ((100, 3), (1000, 9), (900, 10), (300, 6))]) == [3, 0, 1, 2]


def test_a_single_model_makes_no_passes(bins, monkeypatch):
    monkeypatch.setattr(boost, "_round", lambda *a: pytest.fail("a pass"))
    fitted, = boost.boost(bins.table, bins.names, bins.cuts, [boost.Spec({"n_estimators": 2}, folds=(0, 1))])
    assert (fitted.trees[1].column >= 0).any()


def test_bundles_add_up_to_columns():
    """Columns that exclude or determine each other share a code; sums, bins and walks are those of the columns."""
    rng = np.random.default_rng(3)
    level = rng.integers(0, 30, 5000)
    x = np.stack([*[1 + (level == k) for k in range(30)], rng.integers(0, 256, 5000), level // 2]).astype(np.uint8)
    widths, slot = [*[3] * 30, 256, 16], rng.integers(0, 3, 5000)
    bundles = boost._bundles(x)
    assert len(bundles) == 2 and (boost._unbundled(bundles, np.arange(5000)) == x).all()
    g, h, rows, columns = rng.integers(-99, 99, 5000), rng.integers(0, 99, 5000), np.flatnonzero(rng.random(5000) < 0.5), [0, 3, 29, 30, 31]
    got = boost._add_bundles(bundles, rows, slot[rows], g[rows], h[rows], 3, columns, widths)
    assert (got == boost._add_up(x.T[rows], slot[rows], g[rows], h[rows], 3, columns, widths)).all()
    tree = boost.Tree.empty(2)
    tree.column[:3], tree.cut[:3] = [31, 30, 4], [7, 100, 1]
    assert (boost._walk(tree, bundles, 5000) == tree.walk(x.T)).all()
    assert boost._left_over({1: 5, 2: 9, 5: 4, 6: 4}) == {2, 5}


def test_sums_of_bundles_take_one_pass_and_are_exact(monkeypatch):
    """Largest slopes, more rows of a cell than are added up at once, and no further passes over the rows for hessians and counts."""
    n, unit = 100_000, int(boost.UNIT)
    x = np.stack([np.ones(n), np.arange(n) % 3]).astype(np.uint8)
    g, h, slot = np.where(np.arange(n) % 5, unit, -unit), np.full(n, unit // 4), np.arange(n) // 90_000
    want = boost._add_up(x.T, slot, g, h, 2, [0, 1], [2, 3])
    passes, at = [], boost._bundles(x)
    bincount = np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: passes.append(1) or bincount(*a, **k))
    assert (boost._add_bundles(at, np.arange(n), slot, g, h, 2, [0, 1], [2, 3]) == want).all() and not passes


def test_few_rows_make_few_blocks(bins):
    """A task costs more than adding up some ten thousand rows."""
    assert [boost._pack(bins.table, len(NAMES), 1, n).getNumPartitions() for n in (600, 130_000, 10**9)] == [1, 1, 8]


def test_one_class_and_no_rows(spark, bins):
    for where in ("label = 1", "false"):
        table = model.materialize(bins.table.filter(where))
        fitted, = boost.boost(table, bins.names, bins.cuts, [boost.Spec({"n_estimators": 2}, folds=(0, 1, 2))])
        assert all((t.column < 0).sum() >= 1 for t in fitted.trees)
    with pytest.raises(ValueError):
        boost.Spec({"depth": 3})


def test_thresholds_of_nodes(bins, data):
    fitted, = model.fit_trees(bins, [boost.Spec({"n_estimators": 2, "max_depth": 3}, folds=(0, 1))])
    scored = {r["row_id"]: r["score_margin"] for r in model.score_trees([fitted], bins, 2).collect()}
    nodes = {(t, i): (n, c, v) for t, i, n, c, v, _ in boost.nodes(fitted)}
    for r in data.filter("row_id % 3 = 2").collect():
        total = 0.0
        for t in range(2):
            i = 0
            while nodes[t, i][0] is not None:
                name, threshold, _ = nodes[t, i]
                i = 2 * i + (1 if r[name] is None or r[name] < threshold else 2)
            total += nodes[t, i][2]
        assert scored[r["row_id"]] == pytest.approx(total, abs=1e-12)


# ---- attributions

def test_tree_attribution_adds_up(spark, bins):
    fitted, = model.fit_trees(bins, [boost.Spec({"n_estimators": 6, "max_depth": 5}, folds=(0, 1))])
    wide, base = treeshap.attribute_trees(fitted, bins.table)
    got = wide.toPandas().set_index("row_id").sort_index()
    margin = boost.score([fitted], bins.table, ["row_id"]).toPandas().set_index("row_id").sort_index()["score_margin"]
    assert np.allclose(got.sum(axis=1) + base, margin, atol=1e-12)
    assert got["a"].abs().mean() > got["b"].abs().mean()


def test_tree_attribution_is_the_definition(bins):
    """Against coalitions enumerated on the tree itself: a column outside the coalition follows the cover."""
    fitted, = model.fit_trees(bins, [boost.Spec({"n_estimators": 3, "max_depth": 6}, folds=(0, 1))])
    x = np.stack([np.frombuffer(r["bins"], np.uint8) for r in bins.table.orderBy("row_id").limit(25).collect()])

    def value(tree, row, known, i=0):
        if tree.column[i] < 0:
            return tree.value[i]
        if tree.column[i] in known:
            return value(tree, row, known, 2 * i + (1 if row[tree.column[i]] <= tree.cut[i] else 2))
        return sum(tree.cover[k] / tree.cover[i] * value(tree, row, known, k) for k in (2 * i + 1, 2 * i + 2))

    got = treeshap.attributions(fitted, x)
    for r, row in enumerate(x):
        for j in range(3):
            rest = [i for i in range(3) if i != j]
            want = sum(factorial(k) * factorial(2 - k) / factorial(3) * (value(t, row, {*s, j}) - value(t, row, set(s)))
                       for t in fitted.trees for k in range(3) for s in combinations(rest, k))
            assert got[r, j] == pytest.approx(want, abs=1e-9)


def test_attribution_at_full_strength_is_exact_and_bounded(monkeypatch):
    """Depth 8 over random trees, the store too small for their tables: base and attributions still add up to the margin."""
    rng = np.random.default_rng(2)
    trees = []
    for _ in range(12):
        t = boost.Tree.empty(8)
        t.column[:255], t.cut[:255], t.value[255:] = rng.integers(0, 11, 255), rng.integers(0, 255, 255), rng.normal(size=256)
        t.column[rng.integers(7, 255, 12)] = -1
        t.cover[255:] = rng.uniform(0.5, 2, 256)
        for i in range(254, -1, -1):
            t.cover[i] = t.cover[2 * i + 1] + t.cover[2 * i + 2]
        trees.append(t)
    fitted = boost.Model([f"c{i}" for i in range(11)], [], trees)
    x = rng.integers(0, 256, (300, 11)).astype(np.uint8)
    monkeypatch.setattr(treeshap, "STORE", 3 << 22)
    known = {}
    got = treeshap.attributions(fitted, x, known)
    assert known["bytes"] <= 3 << 22 and np.allclose(got, treeshap.attributions(fitted, x, known))
    assert np.allclose(got.sum(axis=1) + treeshap.base_value(fitted), fitted.margins(x), atol=1e-9)


def test_shares_equal_the_definition():
    rng = np.random.default_rng(0)
    for m in (1, 2, 4, 8):
        zero, hit = rng.uniform(size=m), rng.integers(0, 2, size=(5, m)).astype(float)
        got = treeshap.shares(hit, zero)
        for r in range(5):
            def value(s):
                return np.prod([hit[r, i] if i in s else zero[i] for i in range(m)])
            for j in range(m):
                rest = [i for i in range(m) if i != j]
                want = sum(factorial(k) * factorial(m - k - 1) / factorial(m) * (value({*s, j}) - value(set(s)))
                           for k in range(m) for s in combinations(rest, k))
                assert got[r, j] == pytest.approx(want)


# ---- search

def test_parzen_beats_even_draws():
    """A planted optimum in nine dimensions, 50 trials, over seeds."""
    target = {"max_depth": 5, "learning_rate": 0.04, "n_estimators": 400, "min_child_weight": 6, "subsample": 0.8,
              "colsample_bytree": 0.6, "reg_alpha": 1e-3, "reg_lambda": 1.0, "gamma": 1e-5}

    def worth(p):
        return -sum(((r.inner(p[n]) - r.inner(target[n])) / (r.bounds[1] - r.bounds[0])) ** 2 for n, r in model.SPACE.items())

    def best(seed, at_once, startup):
        rng, asked, values = np.random.default_rng(seed), [], []
        while len(asked) < 50:
            new = parzen.ask_many(rng, model.SPACE, asked, values, at_once) if len(asked) >= startup else [
                {n: r.outer(rng.uniform(*r.bounds)) for n, r in model.SPACE.items()} for _ in range(at_once)]
            asked, values = asked + new, values + [worth(p) for p in new]
        return max(values)

    even = np.mean([best(s, 10, 50) for s in range(12)])
    assert np.mean([best(s, 10, 0) for s in range(12)]) > 0.85 * even and np.mean([best(s, 1, 0) for s in range(12)]) > 0.7 * even


def test_parzen_stays_in_range_and_on_steps():
    rng, asked, values = np.random.default_rng(1), [], []
    for i in range(120):
        p = parzen.ask(rng, model.SPACE, asked, values)
        for n, r in model.SPACE.items():
            assert r.low <= p[n] <= r.high and (not r.step or (isinstance(p[n], int) and (p[n] - r.low) % r.step == 0))
        asked.append(p)
        values.append([math.nan, 0.5, p["subsample"], p["subsample"]][i % 4])
    assert parzen.split([0.1, 0.9, 0.9, 0.2]) == ([1], [0, 2, 3])
    assert parzen.ask(rng, {"k": Range(2, 2, 1)}, [{"k": 2}] * 12, [0.5] * 12) == {"k": 2}


def test_search_is_seeded(bins):
    space = {**model.SPACE, "n_estimators": Range(2, 6, 2), "max_depth": Range(1, 3, 1)}
    one, two = ([tuple(r) for r in model.search(bins, 0, 1, 13, 7, space, at_once=6).orderBy("number").collect()] for _ in range(2))
    assert one == two and [r[0] for r in one] == list(range(13)) and len({r[3:] for r in one}) > 6


def test_registered_search_draws_from_all_ranges(spark, bins, monkeypatch):
    """Trees of a trial go up to the 1,000 of the full space."""
    from auditkit.plans import q_models
    from auditkit.plans.views import Views

    asked = []

    def seen(b, specs):
        asked.extend(s.params for s in specs)
        return [boost.Model(b.names, b.cuts, []) for _ in specs]
    monkeypatch.setattr(model, "fit_trees", seen)
    monkeypatch.setattr(model, "evaluate_each", lambda scored, names: {n: {"roc_auc": 0.5} for n in names})
    monkeypatch.setattr(q_models, "_bins", lambda v: bins)
    monkeypatch.setattr(Views, "_stage", lambda self, name, build, partition_by=(): build())
    assert q_models._search(Views(spark, "/none")).count() == len(asked) == 50
    trees = [p["n_estimators"] for p in asked]
    assert all(100 <= n <= 1000 and n % 50 == 0 for n in trees) and max(trees) > 800


# ---- experiments

def test_planted_column_moves_the_score(data):
    b = model.bin_matrix(data, ["b", "c", "leak"], F.col("row_id") % 3, (0, 1))
    got = model.canary_experiment(b, (0, 1), 2, (0,), 1, "leak", {"n_estimators": 4, "max_depth": 3}).collect()
    auc = {r["model"]: r["roc_auc"] for r in got}
    assert auc["canary"] > 0.99 > auc["honest"] and auc["canary_val"] > 0.99


def test_ablation_of_the_signal_costs(bins):
    got = model.ablate(bins, (0, 1), 2, ["a", "c"], {"n_estimators": 4, "max_depth": 3}).collect()
    delta = {r["feature"]: r["delta_roc_auc"] for r in got}
    assert delta["a"] < -0.1 < delta["c"]


def test_ablated_features_grow_the_full_model_once(spark, monkeypatch):
    import __spark_entry__ as entry

    grown, fit = [], model.fit_trees

    def seen(b, specs):
        grown.append(len(specs))
        return fit(b, [boost.Spec({"n_estimators": 2, "max_depth": 2}, s.columns, s.folds) for s in specs])
    monkeypatch.setattr(model, "fit_trees", seen)
    got = entry.queries()["ml_05_ablated_features"](spark, "/root/testdata/sf0.001/.").collect()  # a folder name of its own: nothing is kept for others
    assert grown == [21] and len(got) == 20 and all(r["one_base"] for r in got)


def test_evaluations_agree(spark):
    rng = np.random.default_rng(4)
    rows = [(int(y), float(s), float(s) / 2) for y, s in zip(rng.integers(0, 2, 300), rng.integers(0, 40, 300) / 40)]
    got = model.evaluate_each(spark.createDataFrame(rows, "label int, s double, t double"), ["s", "t"])
    p, n = ([s for y, s, _ in rows if y == k] for k in (1, 0))
    auc = sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n))
    assert got["s"]["roc_auc"] == pytest.approx(auc) == got["t"]["roc_auc"]
    assert got["t"]["brier"] == pytest.approx(np.mean([(t - y) ** 2 for y, _, t in rows]))


def test_registered_strengths(spark, monkeypatch):
    import __spark_entry__ as entry
    from auditkit.plans import q_models

    assert (q_models.ITERATIONS, q_models.TRIALS, q_models.ABLATIONS) == (2000, 50, 20)
    assert (boost.DEFAULTS["n_estimators"], boost.DEFAULTS["max_depth"], len(model.SPACE)) == (300, 6, 9)
    asked = {}

    class Seen(Exception):
        pass

    def seen(*args, **kwargs):
        asked["iterations"] = args[2]
        raise Seen
    monkeypatch.setattr(model, "fit_logistic", seen)
    with pytest.raises(Seen):
        entry.queries()["ml_01_logistic"](spark, "/root/testdata/sf0.001")
    assert asked["iterations"] == 2000
    assert {r["dim"] for r in entry.queries()["ret_10_embed"](spark, "/root/testdata/sf0.001").collect()} == {384}
