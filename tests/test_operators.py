"""Joins, preparation, sets, scoring, findings and validation on small hand-made inputs, with mutations that must fail."""

import random

import pytest
from pyspark.sql import functions as F

from auditkit.operators import align, columns, findings, nearest, prep, profile, ranked, runs, scoring, sets, validate
from auditkit.operators.columns import CheckFailed


# ---------------------------------------------------------------- band matching
def test_band_match_brute_force(spark):
    rng = random.Random(11)
    nums = [(r, round(rng.uniform(-20, 20), rng.randint(0, 4))) for r in (1, 1, 1, 2) for _ in range(60)]
    nums += [(1, 0.125), (1, 2.5), (2, -0.05), (1, 1e9)]
    toks = [(r, round(rng.uniform(-20, 20), d), d) for r in (1, 2, 3) for d in (0, 1, 2, 3) for _ in range(40)]
    toks += [(1, 0.12, 2), (1, 0.13, 2), (1, 2.0, 0), (1, 3.0, 0), (2, -0.1, 1), (2, 0.0, 1), (1, 1e9, 0)]
    got = nearest.band_match(spark.createDataFrame(toks, "run int, value double, decimals int"),
                           spark.createDataFrame(nums, "run int, x double")).collect()
    assert len(got) == len(toks)
    for r in got:
        h = 0.5 * 10 ** -r["decimals"]
        near = [abs(x - r["value"]) for k, x in nums if k == r["run"]]
        assert r["matched"] == any(d < h for d in near), r
        tied = any(abs(d - h) <= 1e-9 * h for d in near)
        clear = any(d < h - 1e-9 * h for d in near)
        assert r["on_tie"] == (tied and not clear), r


# ---------------------------------------------------------------- alignment
def matrix(spark, shift=0.0):
    rows = [(i, float(i), i % 3, float(i % 7), i * 2, None if i == 5 else 1.0) for i in range(50)]
    rows = [(r[0], r[1] + (shift if r[0] == 40 else 0.0), *r[2:]) for r in rows]
    return spark.createDataFrame(rows, "row_id long, a double, b int, c double, d long, e double")


def test_gate_passes_and_skips_filled_columns(spark):
    got = align.alignment_gate(matrix(spark), matrix(spark), ("c",))
    assert {r["probe"] for r in got.collect()} == {"a", "b", "c", "d"}


def test_gate_finds_one_shifted_row(spark):
    with pytest.raises(CheckFailed, match="a: 1 rows differ, first 40"):
        align.alignment_gate(matrix(spark, 1e-6), matrix(spark))


def test_gate_needs_probes(spark):
    with pytest.raises(CheckFailed, match="at least 4"):
        align.alignment_gate(matrix(spark).drop("a", "b"), matrix(spark))


def test_attach_refuses_duplicates_and_gaps(spark):
    m = matrix(spark).select("row_id")
    lookup = m.withColumn("x", F.lit(1.0))
    assert align.attach(m, lookup, "row_id", "x").count() == 50
    with pytest.raises(CheckFailed, match="not unique"):
        align.attach(m, lookup.unionAll(lookup.limit(1)), "row_id", "x")
    with pytest.raises(CheckFailed, match="1 rows have no x"):
        align.attach(m, lookup.filter("row_id <> 3"), "row_id", "x")


def test_attach_tells_of_keys_beyond_the_rows_and_of_nulls(spark):
    m = matrix(spark).select("row_id")
    lookup, beyond = m.withColumn("x", F.lit(1.0)), spark.createDataFrame([(10**9, 1.0)] * 2, "row_id long, x double")
    with pytest.raises(CheckFailed, match="not unique"):
        align.attach(m, lookup.unionAll(beyond), "row_id", "x")
    with pytest.raises(CheckFailed, match="3 rows have no x"):  # two null keys meet nothing, one key meets a null
        align.attach(m.unionAll(spark.createDataFrame([(None,), (None,)], "row_id long")), lookup.withColumn("x", F.when(F.col("row_id") != 3, 1.0)), "row_id", "x")
    assert align.attach(m.unionAll(m), lookup, "row_id", "x").count() == 100


def test_moments_leave_the_histogram_where_it_is(spark):
    """Means need one scan and no median; the second scan meets them by broadcast, whatever Spark thinks of their size."""
    hist = spark.range(1000).select(F.lit("s").alias("scope"), (F.col("id") % 3).cast("string").alias("feature"), F.col("id").cast("double").alias("value"),
                                    F.lit(2).alias("n"), F.lit(1).alias("pos"), F.lit(1).alias("neg"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = profile.moments(hist).filter("feature = '1'").select("ssq")._jdf.queryExecution().executedPlan().toString()
        got = profile.moments(hist).orderBy("feature").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan
    want = [list(range(i, 1000, 3)) for i in range(3)]
    assert [r["mean"] for r in got] == [pytest.approx(sum(w) / len(w)) for w in want]
    assert [r["ssq"] for r in got] == [pytest.approx(2 * sum((x - sum(w) / len(w)) ** 2 for x in w)) for w in want]
    assert [r["mean"] for r in profile.totals(hist).orderBy("feature").collect()] == [r["mean"] for r in got]


# ---------------------------------------------------------------- preparation
def loans(spark):
    train = [("train", 1996, 1.0, None, None, "x", 1), ("train", 1996, 3.0, 5.0, 2.0, None, 1), ("train", 1997, None, 7.0, 4.0, "y", 1)]
    test = [("test", 1999, None, None, None, "z", 1)]
    return spark.createDataFrame(train + test, "split string, vintage int, a double, mths_since_x double, f double, cat string, one int")


def test_fit_on_train_apply_to_test(spark):
    df = loans(spark)
    fitted = prep.fit(df.filter("split = 'train'"), prep.Plan(("a", "mths_since_x", "f", "one"), ("cat",), ("split",), flagged=("f",)))
    assert fitted.constant == ["one"] and fitted.medians["a"] == 2.0 and fitted.levels["cat"] == ["missing", "x", "y"]
    row = fitted.apply(df).filter("split = 'test'").head()
    assert (row["a"], row["mths_since_x"], row["mths_since_x_was_missing"], row["f"], row["f_was_missing"]) == (2.0, 999.0, 1, 3.0, 1)
    assert row["cat_x"] == row["cat_y"] == row["cat_missing"] == 0
    assert fitted.features() == ["a", "mths_since_x", "f", "mths_since_x_was_missing", "f_was_missing", "cat_missing", "cat_x", "cat_y"]
    unseen = prep.unseen_levels(df.filter("split = 'train'"), df.filter("split = 'test'"), ("cat",)).collect()
    assert [tuple(r) for r in unseen] == [("cat", "z")]


def test_split_stops_on_other_periods(spark):
    with pytest.raises(CheckFailed, match="1 rows"):
        prep.temporal_split(loans(spark), "vintage", (1996, 1997), 2000)


def test_aligned_refuses_nulls_and_text(spark):
    a = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert columns.check_aligned(a, a.select("y", "x")).columns == ["x", "y"]
    with pytest.raises(CheckFailed, match="nulls left in test"):
        columns.check_aligned(a, a.withColumn("y", F.lit(None).cast("double")))
    with pytest.raises(CheckFailed, match="columns differ"):
        columns.check_aligned(a, a.drop("y"))


# ---------------------------------------------------------------- sampling, trials, spend
def test_sample_is_seeded_and_whole(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    one, two = ([r[0] for r in ranked.seeded_sample(df, "k", s, 100).collect()] for s in (1, 2))
    assert len(set(one)) == 100 and one == [r[0] for r in ranked.seeded_sample(df, "k", 1, 100).collect()] and one != two
    assert ranked.seeded_sample(df, "k", 1, 5000).count() == 1000


def test_sheet_positions(spark):
    items = spark.range(200).select(F.col("id").alias("item"), (F.col("id") * 2).alias("reply"))
    got = ranked.review_sheet(items, "item", 9).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, 201)) and "item" not in got[0].asDict()
    assert [r["reply"] for r in got] != sorted(r["reply"] for r in got)


def test_spend_refuses_at_the_cap(spark):
    usage = spark.createDataFrame([(i, "m", 100_000, 0, 0, 10_000, 1000) for i in range(100)],
                                  "id long, model string, input long, cache_creation long, cache_read long, output long, max_tokens long")
    rates = spark.createDataFrame([("m", 2.0, 2.5, 0.2, 10.0)],
                                  "model string, rate_input double, rate_cache_write double, rate_cache_read double, rate_output double")
    spend = ranked.running_spend(ranked.cost_usd(rates, usage), "id", 15.0)
    first = ranked.first_refused(spend, "id").head()
    # 0.30 each; the next request could cost 0.26, so the first refused one finds more than 14.74 spent.
    assert first["id"] == 50 and first["cost_before"] == pytest.approx(15.0)
    unknown = ranked.running_spend(ranked.cost_usd(rates, usage.withColumn("model", F.lit("other"))), "id", 15.0)
    assert ranked.first_refused(unknown, "id").head()["id"] == 0


# ---------------------------------------------------------------- sets and scoring
def test_sides_and_rules(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "flag string") for s in ("xxy", "yz"))
    assert {tuple(r) for r in sets.sides(a, b, "flag").collect()} == {("x", "only_a"), ("y", "both"), ("z", "only_b")}
    m = spark.createDataFrame([("p", "a"), ("h", "a"), ("p", "b"), ("t1", "b")], "set string, name string")
    got = {r["rule"]: r["violations"] for r in sets.key_rules(m, [("p", "h")], [("t1", "p")], [("p", ("t1", "t1"))]).collect()}
    assert list(got.values()) == [1, 0, 1]


def key(spark):
    d = spark.createDataFrame([
        ("acctbal", "money Charged Off later", "after the event", True), ("qty", "plain", "at application", True),
        ("n_items", "kept", "at application; since 2015", False), ("p2", "nothing", "in life", True), ("other", "kept", "at application", False)],
        "feature string, description string, populated string, removed boolean")
    return scoring.answer_key(d, "since 2015", [("A", "event", ["charged off"])])


def test_answer_key(spark):
    got = {r["name"]: (r["set"], r["tier"], r["phrase"]) for r in key(spark).collect()}
    assert got == {"acctbal": ("positive", "A", "Charged Off"), "qty": ("out_of_scope", None, None), "n_items": ("hard", None, None),
                   "p2": ("positive", None, None)}


def test_score_counts_flags_for_precision_and_parents_for_recall(spark):
    flags = spark.createDataFrame([(1, 1, " acctbal "), (1, 2, "acctbal_was_missing"), (1, 3, "qty"), (1, 4, "n_items_was_missing"),
                                   (1, 5, "acctbal"), (1, 6, "nonsense"), (1, 7, "  ")], "run int, pos int, flag string")
    resolved = scoring.resolve(sets.clean_flags(flags), key(spark))
    all_runs = spark.createDataFrame([(1,), (2,)], "run int")
    got = {r["run"]: r for r in scoring.score(all_runs, resolved, key(spark)).collect()}
    r = got[1]
    assert (r["flagged_count"], r["scored_count"], r["true_positive_count"], r["false_positive_count"]) == (5, 4, 2, 2)
    assert (r["precision"], r["recall"], r["f1"]) == (0.5, 0.5, 0.5)
    assert (r["hard_negatives_raw"], r["hard_negatives_via_derivative"], r["hard_negatives_distinct"]) == (0, 1, 1)
    assert (r["out_of_scope_count"], r["false_negative_count"]) == (1, 1)
    assert (got[2]["flagged_count"], got[2]["precision"], got[2]["f1"], got[2]["false_negative_count"]) == (0, 0.0, 0.0, 2)


def test_canary_is_three_valued(spark):
    resolved = spark.createDataFrame([(1, "recoveries"), (3, "recoveries")], "run int, scored_as string")
    said = spark.createDataFrame([(1, True), (2, True), (3, False), (4, None)], "run int, canary_present boolean")
    got = {r["run"]: (r["detected"], r["verdict"]) for r in scoring.canary_block(said, resolved, "recoveries").collect()}
    assert got == {1: (True, "caught"), 2: (False, "missed"), 3: (None, "not_applicable"), 4: (None, "unknown")}


def test_termination(spark):
    rows = [("end_turn", 0, 5, False, "completed"), ("tool_use", 3, 68, False, "call_limit"), ("tool_use", 3, 5, False, "turn_limit"),
            ("refusal", 0, 5, False, "refusal"), ("odd", 0, 5, False, "unknown_stop_reason"), ("end_turn", 0, 5, True, "budget_cap")]
    df = spark.createDataFrame(rows, "stop string, last int, made int, refused boolean, want string")
    ended = runs.termination(F.col("stop"), F.col("last"), F.col("made"), F.lit(70), F.col("refused"))
    assert df.filter(ended != F.col("want")).count() == 0


# ---------------------------------------------------------------- findings
GOOD = "FLAG: a\nREASON: b: c\nEVIDENCE: d\nCONFIDENCE: high"


def parse(spark, text):
    df = findings.parse(spark.createDataFrame([(1, text)], "run int, text string"))
    chunks = findings.chunk_table(df)
    documented = spark.createDataFrame([("a",)], "feature string")
    recs = [tuple(r)[2:] for r in findings.records(chunks).orderBy("record").collect()]
    return df.head()["status"], recs, sorted(r["warning"] for r in findings.warnings(df, chunks, documented).collect())


@pytest.mark.parametrize("body,status,n,warned", [
    (f"pre {findings.START}\n{GOOD}\n{findings.END}", "records", 1, []),
    (f"{findings.DELIMITER}{findings.START}{GOOD}{findings.END}", "records", 1, []),
    ("nothing", "no_block", 0, ["missing start marker"]),
    (f"{findings.START}\n{GOOD}", "unclosed", 0, ["unclosed block"]),
    (f"{findings.START}\n\n{findings.END}", "empty", 0, ["empty block"]),
    (f"{findings.START}\nNO FINDINGS\n{findings.END} bye", "explicit_none", 0, ["text after the end marker"]),
    (f"{findings.START}{GOOD}\n###\n\n###\nFLAG: q\nFLAG: r\nFLAG: s\nCONFIDENCE: sure\nwhat{findings.END}", "records", 2,
     ["empty record", "missing fields: REASON, EVIDENCE", "repeated field", "repeated field", "stray lines: 1", "undocumented flag",
      "unknown confidence"]),
    (f"{findings.START}REASON: b\nFLAG: a\nEVIDENCE: d\nCONFIDENCE: low{findings.END}", "records", 1, ["fields out of order"]),
    (f"{findings.START}REASON: b{findings.END}", "records", 0, ["missing fields: FLAG, EVIDENCE, CONFIDENCE", "no usable flag"]),
    (f"{findings.START}{findings.START}{GOOD}{findings.END}{findings.END}", "records", 0,
     ["missing fields: FLAG", "no usable flag", "repeated end marker", "repeated start marker", "stray lines: 1", "text after the end marker"]),
])
def test_findings(spark, body, status, n, warned):
    got = parse(spark, body)
    assert (got[0], len(got[1]), got[2]) == (status, n, sorted(warned))
    if n:
        assert got[1][0][0] == "a"


# ---------------------------------------------------------------- validation
def test_tolerance_diff(spark):
    want = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, v double")
    got = spark.createDataFrame([("a", 1.0), ("b", 2.5), ("x", 3.0)], "k string, v double")
    r = validate.tolerance_diff(got, want, "k", "v", 1e-6).head()
    assert (r["missing"], r["extra"], r["over"], r["largest_miss"], r["at_key"]) == (1, 1, 1, 0.5, "b")


def test_ordered_diff_takes_the_tail_as_a_set(spark):
    want = spark.createDataFrame([(1, "a", False), (2, "b", False), (3, "c", True), (4, "d", True)], "position int, f string, tied boolean")
    for order, result in (("abdc", (0, None, 0)), ("bacd", (2, 1, 0)), ("acbd", (1, 2, 1))):
        got = spark.createDataFrame([(i, x) for i, x in enumerate(order, 1)], "position int, f string")
        assert tuple(validate.ordered_diff(got, want, "f").head())[:3] == result


def top(spark, rows):
    long = spark.createDataFrame([("f", i, float(v)) for i, v in enumerate([5, -9, 3, 5, 1])], "feature string, row_id long, shap_value double")
    sub = spark.createDataFrame([("f", p, i, float(v)) for p, (i, v) in enumerate(rows, 1)],
                                "feature string, position int, row_id long, value double")
    r = validate.top_rows_check(sub, long, 3).head()
    return r["size_ok"], r["ids_distinct"], r["unknown_ids"], r["wrong_values"], r["ordered"], r["is_true_top"]


@pytest.mark.parametrize("rows,want", [
    ([(0, 5), (3, 5), (2, 3)], (True, True, 0, 0, True, True)),
    ([(1, -9), (0, 5), (3, 5)], (True, True, 0, 0, False, False)),
    ([(0, 5), (0, 5), (2, 3)], (True, False, 0, 0, True, True)),
    ([(0, 5), (3, 4), (9, 3)], (True, True, 1, 1, True, False)),
    ([(0, 5)], (False, True, 0, 0, True, False)),
])
def test_top_rows(spark, rows, want):
    assert top(spark, rows) == want


def test_single_json_object(spark):
    texts = ['{"a": 1}', ' {} ', '[1]', '{"a": 1} x', '{"a": 1}, {"b": 2}', '{"a": 1}], [{}', '{"a": 1}, "y": {}', '{"a": 1}}', "NaN", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(validate.is_object(F.col("t"))).collect()] == [True, True] + [False] * 9


def test_attributions_by_column_read_one_column_and_sort_nothing(spark, tmp_path):
    from auditkit.operators import attribution
    wide = spark.range(50).select(F.col("id").alias("row_id"), *[(F.col("id") * i - 9.5).alias(f"f {i}") for i in range(5)],
                                  F.when(F.col("id") % 3 == 0, 1.0).alias("gaps"))
    wide.write.parquet(f"{tmp_path}/wide")
    written = spark.read.parquet(f"{tmp_path}/wide")
    long = attribution.by_column(written)
    assert sorted(map(str, long.collect())) == sorted(map(str, attribution.to_long(written).collect()))
    plan = long.filter("feature = 'f 2'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "f 1" not in plan and "Sort" not in plan


def test_warnings_move_no_evidence(spark, tmp_path):
    """The texts of a record are read before the join with the documented names, not carried through it."""
    block = "\n".join([findings.START, "FLAG: a", "REASON: r", "EVIDENCE: e", "CONFIDENCE: odd", "###", "REASON: r", findings.END])
    parsed = findings.parse(spark.createDataFrame([(1, block)], "run long, text string"))
    findings.chunk_table(parsed).write.parquet(f"{tmp_path}/chunks")
    got = findings.warnings(parsed, spark.read.parquet(f"{tmp_path}/chunks"), spark.createDataFrame([("b",)], "feature string"))
    assert sorted((r["record"], r["warning"]) for r in got.collect()) == [
        (1, "undocumented flag"), (1, "unknown confidence"), (2, "missing fields: FLAG, EVIDENCE, CONFIDENCE"), (2, "no usable flag")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join"):]
    assert "evidence#" not in joined.split("Relation")[0].split("Project")[0] and "AS ahead" in joined
