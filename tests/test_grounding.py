"""Cited figures, their nearest numbers, ties, and claimed sources against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from auditkit.functions.text import json_strings
from auditkit.operators import claims, nearest
from auditkit.operators.lookup import look_up
from auditkit.sources.staging import materialize

TOKENS, NUMBERS = "run string, value double, decimals int", "run string, x double"


def judged(spark, tokens, numbers):
    return nearest.band_match(spark.createDataFrame(tokens, TOKENS), spark.createDataFrame(numbers, NUMBERS))


def test_nearest_matches_and_ties_by_definition(spark):
    rng = random.Random(3)
    numbers = [(r, rng.choice([round(rng.uniform(-5, 5), rng.randint(0, 5)), rng.randint(-8, 8) / 8])) for r in "aab" for _ in range(150)]
    numbers += [("a", 2.25), ("a", 2.25 + 1e-12), ("a", 2.35), ("b", 0.0), ("b", -0.0), ("a", None), ("a", float("nan")), ("b", float("inf")), (None, 1.0)]
    tokens = [(r, round(rng.uniform(-5, 5), d), d) for r in "abc" for d in (0, 1, 2, 3, 20) for _ in range(50)]
    tokens += [("a", 2.3, 1)] * 40 + [("a", None, 1), (None, 1.0, 1), ("b", 0.0, 0), ("b", -0.0, 320), ("a", 1e300, 0)]
    frame = judged(spark, tokens, numbers)
    got = frame.collect()
    key = lambda t: (t[0] or "", repr(t[1]), t[2])
    assert sorted(((r["run"], r["value"], r["decimals"]) for r in got), key=key) == sorted(tokens, key=key)
    of = {k: sorted({x for r, x in numbers if r == k and x is not None and abs(x) < float("inf")}) for k in "abc"}
    want_ties = set()
    for r in got:
        v, half = r["value"], 0.5 * 10.0 ** -r["decimals"]
        near = sorted((abs(x - v), x) for x in of.get(r["run"], [])) if v is not None else []
        if v == 1e300:  # so far off that all numbers look alike
            assert abs(r["nearest"] - v) == near[0][0]
        else:
            assert r["nearest"] == (near[0][1] if near else None)
        assert r["matched"] == any(g < half or g == 0 for g, _ in near)
        tied = [x for g, x in near if abs(g - half) <= 1e-9 * half]
        assert r["on_tie"] == (bool(tied) and not any(g < half * (1 - 1e-9) or g == 0 for g, _ in near))
        want_ties |= {(r["run"], v, r["decimals"], x) for x in tied if r["on_tie"]}
    ties = nearest.ties(frame, spark.createDataFrame(numbers, NUMBERS)).collect()
    assert {tuple(t) for t in ties} == want_ties and len(ties) == len(want_ties)
    assert len([t for t in want_ties if t[:2] == ("a", 2.3)]) in (0, 3)


def test_three_numbers_on_one_tie(spark):
    numbers = [("a", 2.25), ("a", 2.25 - 1e-12), ("a", 2.35), ("a", 9.0)]
    frame = judged(spark, [("a", 2.3, 1)], numbers)
    got = {t["tie_value"] for t in nearest.ties(frame, spark.createDataFrame(numbers, NUMBERS)).collect()}
    want = {x for _, x in numbers[:3] if abs(abs(x - 2.3) - 0.05) <= 1e-9 * 0.05}
    assert frame.first()["on_tie"] and got == want and len(got) == 3


def test_large_and_fine_figures(spark):
    tokens = [("r", 0.12345678901234568, 20), ("r", 1e300, 2), ("r", 3e18, 2), ("r", 5.0, 400), ("r", 2.5, 1), ("r", 1e300, 0)]
    got = judged(spark, tokens, [("r", x) for x in (0.12345678901234568, 1e300, 3e18 + 4096, 5.0, 2.54, -1e308)])
    assert {(r["value"], r["decimals"]): (r["matched"], r["nearest"]) for r in got.collect()} == {
        (0.12345678901234568, 20): (True, 0.12345678901234568), (1e300, 2): (True, 1e300), (3e18, 2): (False, 3e18 + 4096),
        (5.0, 400): (True, 5.0), (2.5, 1): (True, 2.54), (1e300, 0): (True, 1e300)}


def test_numbers_are_kept_once_whatever_the_decimals(spark):
    """Neither more decimals nor a figure cited by a third of all tokens makes more rows of the numbers."""
    numbers = spark.range(3000).select(F.lit("a").alias("run"), (F.col("id") / 7).alias("x"))
    tokens = spark.range(9000).select(F.lit("a").alias("run"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") / 10).alias("value"), (F.col("id") % 40).cast("int").alias("decimals"))
    placed = nearest._placed(numbers, tokens.select("run", F.col("value").alias("at"), F.lit(2).alias("side")), "run")
    assert placed.filter("side = 1").count() == 3000
    got = nearest.band_match(tokens, numbers).filter("value = 5.0").agg(F.count("*"), F.min("matched"), F.max("nearest")).first()
    assert tuple(got) == (3000 + 1, True, 5.0)


def test_neighbours_come_from_the_ranges(spark, monkeypatch):
    """Neighbours cross ranges of one run and never its ends, and no table of positions is made for them."""
    monkeypatch.setattr(nearest, "_placed", None)
    rng = random.Random(8)
    numbers = [(k, round(rng.uniform(0, 50), 2)) for k in "abc" for _ in range(200)] + [("d", 7.0), (None, 3.0)]
    cells = [(k, x, i) for i, (k, x) in enumerate([(k, round(rng.uniform(-1, 51), 1)) for k in "abcde" for _ in range(300)] + [("a", None), ("a", numbers[0][1])])]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else all of it is one range
    try:
        got = nearest._neighbours(spark.createDataFrame(cells, "run string, at double, i int"), spark.createDataFrame(numbers, NUMBERS), "run").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {(k, x, i, max((n for r, n in numbers if r == k and x is not None and n <= x), default=None),
             min((n for r, n in numbers if r == k and x is not None and n > x), default=None)) for k, x, i in cells}
    assert {tuple(r) for r in got} == want and len(got) == len(cells)
    assert judged(spark, [("a", numbers[0][1], 2)], numbers).first()["matched"]


def test_nothing_to_match(spark):
    assert judged(spark, [], [("a", 1.0)]).count() == 0
    assert [tuple(r) for r in judged(spark, [("a", 1.0, 1)], []).collect()] == [("a", 1.0, 1, None, False, False)]


def test_look_up_with_hot_and_null_keys(spark):
    rows = materialize(spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 700).alias("k"), (F.col("id") % 2).alias("j")))
    table = materialize(rows.groupBy("k", "j").agg(F.count("*").alias("c"), F.max("id").alias("most")))
    got = look_up(rows, table, ["k", "j"], "c")
    want = {(r["k"], r["j"]): r["most"] for r in table.collect()}
    assert got.columns == ["id", "k", "j", "most"]
    assert sorted((r["id"], r["most"]) for r in got.collect()) == sorted((r["id"], want[r["k"], r["j"]]) for r in rows.collect())


def test_json_strings(spark):
    texts = ['{"a": "x \\"1\\" é", "b": ["y", {"c": "z: \\u0041"}], "d": 1}', "[]", "no json", None, '"lone"', '{"k" : "v"}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", json_strings(F.col("t")).alias("s"))
    assert {r["i"]: r["s"] for r in rows.collect()} == {0: ['x "1" é', "y", "z: A"], 1: [], 2: None, 3: None, 4: ["lone"], 5: ["v"]}


CLAIM = ("token_id string, place int, class string, computation string, source_values array<string>, payload_string string, seq long, "
         "prompt_text string, rendered_from_commit string")


@pytest.fixture(scope="module")
def world(spark):
    tokens = spark.createDataFrame([("a|1", "a", "0.6%", False), ("a|2", "a", "12", False), ("a|3", "a", "7", True), ("b|1", "b", "0.6", False)],
                                   "token_id string, run string, text string, matched boolean")
    numbers = spark.createDataFrame([("a", 40.0), ("a", 39.4), ("b", 1.0)], NUMBERS)
    results = spark.createDataFrame([("a", 1, '{"note": "share 0.6% of all"}'), ("a", 2, '{"note": ["12 of 9", "212"], "n": "x"}'), ("b", 1, '{"t": "0.6"}')],
                                    "run string, pos int, content string")
    mapping = spark.createDataFrame([("a", True), ("b", False)], "run string, passed boolean")
    return tokens, numbers, results, mapping


def derived(token, values, computation="difference", place=1):
    return (token, place, "derived", computation, values, None, None, None, None)


def quoted(token, passage, seq, place=1):
    return (token, place, "quoted", None, None, passage, seq, None, None)


def prompt(token, passage, commit="c0ffee", place=1):
    return (token, place, "prompt", None, None, None, None, passage, commit)


CASES = [
    (derived("a|1", ["40", "39.4"]), None), (derived("a|1", ["40", "39.9"]), "source value"), (derived("a|1", ["40 39.4"]), "source value"),
    (derived("a|1", ["none"]), "source value"), (derived("a|1", [None]), "source value"), (derived("a|1", []), "no source values"),
    (derived("a|1", None), "no source_values"), (derived("a|1", ["40"], " \t"), "computation is empty"), (derived("a|1", ["40"], None), "no computation"),
    (derived("b|1", ["40"]), "source value"),
    (quoted("a|1", "share 0.6%", 1), None), (quoted("a|1", "share", 1), "contain the figure"), (quoted("a|1", "10.6%", 1), "contain the figure"),
    (quoted("a|1", "share 0.6%", 2), "not in the result"), (quoted("a|1", "share 0.6%", 3), "no result"), (quoted("a|1", "share 0.6%", 0), "no result"),
    (quoted("a|1", None, 1), "no payload_string"), (quoted("a|1", "share 0.6%", None), "no seq"), (quoted("a|2", "12", 2), None),
    (quoted("a|2", "note 12", 2), "not in the result"), (quoted("b|1", "0.6", 1), "do not correspond"),
    (prompt("a|2", "at most 12."), None), (prompt("a|2", "at most 12.5"), "contain the figure"), (prompt("a|2", "at most 112"), "contain the figure"),
    (prompt("a|2", "12", " "), "commit is empty"), (prompt("a|2", None), "no prompt_text"),
    (("a|1", 1, "guess", *[None] * 6), "unknown source class"), (("a|1", 1, None, *[None] * 6), "unknown source class")]


def test_claims(spark, world):
    made = [(c[0], i, *c[2:]) for i, (c, _) in enumerate(CASES)]
    got = {r["place"]: r["reason"] for r in claims.check_claims(world[0], spark.createDataFrame(made, CLAIM), *world[1:]).collect()}
    assert len(got) == len(CASES)
    for i, (claim, reason) in enumerate(CASES):
        assert got[i] is None if reason is None else re.search(reason, got[i] or ""), claim


def test_adjudication(spark, world):
    made = [quoted("a|1", "share 0.6%", 1, 2), derived("a|1", ["40", "39.4"]), prompt("a|2", "12 rows", place=2), derived("a|2", ["1"], place=3),
            quoted("a|2", "12", 1, 4), derived("a|3", ["40"]), prompt("z|9", "1")]
    frame = spark.createDataFrame(made, CLAIM)
    checked = claims.check_claims(world[0], frame, *world[1:])
    got = {r["token_id"]: (r["classification"], r["applying"], r["reason"], r["refused"]) for r in claims.adjudicate(world[0], checked).collect()}
    assert got == {"a|1": ("multiply_sourced", ["derived", "quoted"], None, False),
                   "a|2": ("unmatched", None, "a source value is not a number of this run's results", False),
                   "a|3": ("matched", None, None, True), "b|1": ("unmatched", None, None, False)}
    assert [r["token_id"] for r in claims.unclaimed(world[0], frame).collect()] == ["z|9"]
