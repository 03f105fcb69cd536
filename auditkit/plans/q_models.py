"""Queries: models, attributions, experiments. Labels of the fixture are random, so only the planted column moves a score."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditkit.operators import align, attribution, boost, model, profile, treeshap
from auditkit.plans.registry import query
from auditkit.plans.sqlviews import cte
from auditkit.plans.views import MATRIX_FEATURES, TEST_VINTAGE, VAL_VINTAGE

# The reference's counts of iterations, trials and ablations; trees are at their full number and depth (boost.DEFAULTS), and trials are drawn from
# all of model.SPACE.
ITERATIONS, TRIALS, ABLATIONS = 2000, 50, 20
FIT, VAL, TEST = 0, 1, 2
_kept: dict[tuple, object] = {}


def _split(v, name):
    return v.matrix().filter(F.col("split") == name)


def _once(v, name: str, build):
    """What ``build()`` gives, made once per application and folder: fitted models, a few hundred kB each."""
    key = (v.spark.sparkContext.applicationId, v.dir, name)
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]


def _fold():
    return F.when(F.col("vintage") == TEST_VINTAGE, TEST).when(F.col("vintage") == VAL_VINTAGE, VAL).otherwise(FIT)


def _bins(v) -> model.Binned:
    return _once(v, "bins", lambda: model.bin_matrix(v.matrix(), v.features(), _fold(), (FIT, VAL)))


def _trees(v) -> boost.Model:
    return _once(v, "trees", lambda: model.fit_trees(_bins(v), [boost.Spec(folds=(FIT, VAL))])[0])


def _logistic(v):
    return _once(v, "logistic", lambda: model.fit_logistic(_split(v, "train"), v.features(), ITERATIONS))


def _row(v, name: str, m: dict):
    return v.spark.createDataFrame([(name, *[round(m[k], 6) for k in ("roc_auc", "pr_auc", "brier")])],
                                   "model string, roc_auc double, pr_auc double, brier double")


@query("ml_01_logistic")
def logistic(v):
    return _row(v, "logistic", model.evaluate(model.score(_logistic(v), _split(v, "test"), v.features())))


@query("ml_01_balance", "SELECT 'logistic' AS model, true AS balanced, count(*) AS rows FROM loans WHERE split = 'train'", ("loans",))
def logistic_balance(v):
    """At the optimum of a balanced fit with a free intercept, the class-weighted mean score of both classes together is one half."""
    train, names = _split(v, "train"), v.features()
    neg, pos = model.class_counts(train)
    s = model.score(_logistic(v), train, names)
    w = F.when(F.col("label") == 1, 0.5 / pos).otherwise(0.5 / neg)
    got = s.agg(F.sum(w * F.col("score")).alias("mean"), F.count("*").alias("rows"))
    return got.select(F.lit("logistic").alias("model"), (F.abs(F.col("mean") - 0.5) < 1e-3).alias("balanced"), "rows")


@query("ml_02_trees")
def trees(v):
    return _row(v, "trees", model.evaluate(model.score_trees([_trees(v)], _bins(v), TEST)))


cte("split_bins", ("long",), f"""
  SELECT *, CASE WHEN d <= {boost.BINS} THEN k ELSE before * {boost.BINS} // rows END AS bin FROM (
    SELECT feature, value, sum(n) OVER (PARTITION BY feature) AS rows, count(*) OVER (PARTITION BY feature) AS d, n, pos,
      coalesce(sum(n) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS k
    FROM (SELECT feature, value, count(*) AS n, sum(label) AS pos FROM long WHERE split = 'train' GROUP BY feature, value))""")


@query("ml_02_first_split", f"""
  SELECT feature, threshold, round(gain, 4) AS gain, rows, round(cover, 4) AS cover FROM (
    SELECT *, (gl * gl) / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) AS gain, h AS cover FROM (
      SELECT feature, bin, lead(least) OVER f AS threshold, rows,
        sum(0.5 * (n - pos) - 0.5 * w * pos) OVER (f ROWS UNBOUNDED PRECEDING) AS gl, sum(0.25 * (n - pos) + 0.25 * w * pos) OVER (f ROWS UNBOUNDED PRECEDING) AS hl,
        sum(0.5 * (n - pos) - 0.5 * w * pos) OVER (PARTITION BY feature) AS g, sum(0.25 * (n - pos) + 0.25 * w * pos) OVER (PARTITION BY feature) AS h
      FROM (SELECT feature, bin, min(value) AS least, sum(n) AS n, sum(pos) AS pos, CAST(any_value(rows) AS BIGINT) AS rows FROM split_bins GROUP BY feature, bin),
           (SELECT sum(1 - label)::DOUBLE / sum(label) AS w FROM long WHERE split = 'train' AND feature = 'qty')
      WINDOW f AS (PARTITION BY feature ORDER BY bin)))
  WHERE threshold IS NOT NULL AND hl >= 1 AND h - hl >= 1
  ORDER BY round(gain, 6) DESC, list_position({list(MATRIX_FEATURES)!r}, feature), bin LIMIT 1""", ("split_bins", "long"))
def first_split(v):
    """The first split of the first tree, where every margin is 0: its column, threshold, gain, and the rows and hessians it had."""
    fitted, rows = _trees(v), _split(v, "train").count()
    nodes = {i: (name, threshold, value, cover) for t, i, name, threshold, value, cover in boost.nodes(fitted) if t == 0 and i < 3}
    first, p = fitted.trees[0], boost.DEFAULTS
    table = _bins(v).table.filter(F.col("fold") != TEST).select("label", F.conv(F.hex(F.substring("bins", int(first.column[0]) + 1, 1)), 16, 10).cast("int").alias("bin"))
    counts = table.groupBy((F.col("bin") <= int(first.cut[0])).alias("left"), "label").count().collect()
    n = {(r["left"], r["label"]): r["count"] for r in counts}
    w = (n[True, 0] + n[False, 0]) / (n[True, 1] + n[False, 1])
    g = {side: 0.5 * n[side, 0] - 0.5 * w * n[side, 1] for side in (True, False)}
    h = {side: 0.25 * n[side, 0] + 0.25 * w * n[side, 1] for side in (True, False)}
    worth = lambda g, h: g * g / (h + p["reg_lambda"])
    gain = worth(g[True], h[True]) + worth(g[False], h[False]) - worth(sum(g.values()), sum(h.values()))
    return v.spark.createDataFrame([(nodes[0][0], nodes[0][1], round(gain, 4), rows, round(nodes[0][3], 4))],
                                   "feature string, threshold double, gain double, rows long, cover double")


@query("ml_03_search")
def search(v):
    return _search(v).withColumn("value", F.round("value", 6))


def _search(v):
    b = _bins(v)
    return v._stage("trials", lambda: model.search(b, FIT, VAL, TRIALS))


@query("ml_03_trial_log", f"""
  SELECT i AS number, 'COMPLETE' AS state, true AS scored, true AS inside, {', '.join(f"true AS inside_{k}" for k in model.SPACE)} FROM range({TRIALS}) t(i)""")
def trial_log(v):
    """What every trial must be: numbered, complete, with an AUC, and each parameter in its range and on its step."""
    def inside(k, r):
        c = F.col(f"params_{k}")
        on = F.abs((c - r.low) / r.step - F.round((c - r.low) / r.step)) < 1e-9 if r.step else F.lit(True)
        return c.between(float(r.low), float(r.high)) & on
    each = {k: inside(k, r) for k, r in model.SPACE.items()}
    every = F.lit(True)
    for c in each.values():
        every = every & c
    return _search(v).select("number", "state", F.col("value").between(0, 1).alias("scored"), every.alias("inside"), *[c.alias(f"inside_{k}") for k, c in each.items()])


@query("ml_04_scores")
def scores(v):
    return model.score_trees([_trees(v)], _bins(v), TEST).select("row_id", "label", F.round("score", 6).alias("score"))


@query("ml_04_scored_rows", "SELECT row_id, label, true AS inside, true AS agrees FROM loans WHERE split = 'test'", ("loans",))
def scored_rows(v):
    """Every test row is scored once, inside (0, 1), by the probability of its margin."""
    s = model.score_trees([_trees(v)], _bins(v), TEST)
    return s.select("row_id", "label", ((F.col("score") > 0) & (F.col("score") < 1)).alias("inside"),
                    (F.abs(F.col("score") - 1 / (1 + F.exp(-F.col("score_margin")))) < 1e-12).alias("agrees"))


def _ablations(v):
    top = [r["feature"] for r in attribution.global_ranking(v.attributions()).filter(F.col("rank") <= ABLATIONS).collect()]

    def build():
        b = _bins(v)
        models = model.fit_trees(b, model.ablation_specs(b, (FIT, VAL), top, {}))
        _once(v, "trees", lambda: models[0])  # the full model is the one of the other queries
        return model.ablate(b, (FIT, VAL), TEST, top, {}, models)
    return v._stage("ablations", build)


@query("ml_05_ablation")
def ablation(v):
    df = _ablations(v)
    return df.select("feature", *[F.round(c, 6).alias(c) for c in df.columns[1:]])


@query("ml_05_ablated_features", f"SELECT feature, true AS one_base FROM shap_global WHERE rank <= {ABLATIONS}", ("shap_global",))
def ablated_features(v):
    """The features of highest attribution are left out one at a time, and all differences are to one and the same model."""
    df = _ablations(v).withColumn("base", F.round(F.col("roc_auc") - F.col("delta_roc_auc"), 9))
    full = _once(v, "full_auc", lambda: round(model.evaluate(model.score_trees([_trees(v)], _bins(v), TEST))["roc_auc"], 9))
    return df.select("feature", (F.abs(F.col("base") - full) < 1e-8).alias("one_base"))


def _canary(v):
    def build():
        m = align.attach(v.matrix(), v.raw_loans(), "row_id", "recoveries")
        b = model.bin_matrix(m, [*v.features(), "recoveries"], _fold(), (FIT, VAL))
        return model.canary_experiment(b, (FIT, VAL), TEST, (FIT,), VAL, "recoveries", {})
    return v._stage("canary", build)


@query("ml_06_canary")
def canary(v):
    df = _canary(v)
    return df.select("model", *[F.round(c, 6).alias(c) for c in df.columns[1:]])


@query("ml_06_canary_reach", """
  SELECT m AS model, m <> 'honest' AS above_the_column FROM (VALUES ('honest'), ('canary'), ('canary_val')) t(m)""")
def canary_reach(v):
    """A model with the planted column orders the outcome at least as well as the column alone; the honest one doesn't."""
    m = align.attach(v.matrix(), v.raw_loans(), "row_id", "recoveries")
    alone = min(model.evaluate(m.filter(c).select("label", F.col("recoveries").cast("double").alias("score")))["roc_auc"]
                for c in (F.col("split") == "test", F.col("vintage") == VAL_VINTAGE))
    return _canary(v).select("model", (F.col("roc_auc") >= alone - 0.01).alias("above_the_column"))


@query("ml_07_linear_attribution", "SELECT row_id, feature, round(shap_value, 6) + 0.0::DOUBLE AS shap_value FROM shap", ("shap",))
def linear_attribution(v):
    return v.attributions().select("row_id", "feature", F.round("shap_value", 6).alias("shap_value"))


def _explained(v):
    """(row_id, margin, explained): the model's margin, and the base value plus the row's attributions."""
    wide, base = treeshap.attribute_trees(_trees(v), _bins(v).table.filter(F.col("fold") == TEST))
    total = F.lit(base)
    for n in v.features():
        total = total + F.col(f"`{n}`")
    margin = model.score_trees([_trees(v)], _bins(v), TEST).select("row_id", F.col("score_margin").alias("margin"))
    return v._stage("explained", lambda: wide.select("row_id", total.alias("explained")).join(margin, "row_id"))


@query("ml_07_tree_attribution")
def tree_attribution(v):
    """Per row: margin of the model, base value plus the row's attributions, and their difference, which must be 0."""
    return _explained(v).select("row_id", F.round("margin", 6).alias("margin"), F.round("explained", 6).alias("explained"),
                                F.round(F.abs(F.col("margin") - F.col("explained")), 6).alias("gap"))


@query("ml_07_tree_additivity", "SELECT row_id, 0.0::DOUBLE AS gap FROM loans WHERE split = 'test'", ("loans",))
def tree_additivity(v):
    return _explained(v).select("row_id", F.round(F.abs(F.col("margin") - F.col("explained")), 6).alias("gap"))


_SCREENED = ["recoveries", "qty", "acctbal"]


@query("ml_08_leak_screen", "\nUNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(avg(label) FILTER ({c} > 0), 6) AS rate_above,
    round(count(*) FILTER ({c} > 0 AND label = 1)::DOUBLE / sum(label), 6) AS share_of_positives,
    count(DISTINCT {c}) > 1 AS varies FROM loans WHERE {c} IS NOT NULL""" for c in _SCREENED), ("loans",))
def leak_screen(v):
    long = profile.long_form(v.loans(), _SCREENED, ["label"]).filter(F.col("value").isNotNull())
    hist = (long.groupBy("feature", "value").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("pos"))
            .withColumn("scope", F.lit("all")))
    m = profile.moments(hist)

    def share(a, b):
        return F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 6)

    return m.select("feature", share("pos_above", "n_above").alias("rate_above"), share("pos_above", "n_pos").alias("share_of_positives"),
                    (F.col("n_unique") > 1).alias("varies"))
