"""Rows that once gave wrong answers or stopped a query."""

import hashlib
import pytest
from pyspark.sql import functions as F

from auditkit.functions import calls, text
from auditkit.operators import align, nearest, ranked, runs, validate
from auditkit.sources import files


def test_band_match_beyond_the_exact_range(spark):
    tokens = spark.createDataFrame([("r", 0.12345678901234567890, 20), ("r", 1e300, 2), ("r", 3e18, 2), ("r", 5.0, 400), ("r", 2.5, 1), ("r", 1e300, 0)],
                                   "run string, value double, decimals int")
    numbers = spark.createDataFrame([("r", x) for x in (0.12345678901234568, 1e300, 3e18 + 4096, 5.0, 2.54, -1e308, None)], "run string, x double")
    got = {(r["value"], r["decimals"]): r["matched"] for r in nearest.band_match(tokens, numbers).collect()}
    assert got == {(0.12345678901234568, 20): True, (1e300, 2): True, (3e18, 2): False, (5.0, 400): True, (2.5, 1): True, (1e300, 0): True}


def form(spark, arguments, known=("f",), defaults=None):
    df = spark.createDataFrame([("t", a) for a in arguments], "tool string, arguments string")
    out = df.select("arguments", calls.canonical_arguments(F.col("tool"), F.col("arguments"), {"t": known}, {"t": defaults or {}}).alias("form"))
    return {r["arguments"]: r["form"] for r in out.collect()}


def test_canonical_texts_are_escaped(spark):
    one, two = '{"a":"1\\"&b=\\"2"}', '{"a":"1","b":"2"}'
    got = form(spark, [one, two])
    assert got[one] != got[two]


def test_canonical_defaults_are_json(spark):
    got = form(spark, ["{}", '{"f":"all","g":true}', '{"f":" all\\t","g":true}'], defaults={"f": "all", "g": True})
    assert len(set(got.values())) == 1


def test_blanks_of_all_kinds(spark):
    df = spark.createDataFrame([("fico\t",), ("\n",), (" a b ",)], "t string")
    assert [r[0] for r in df.select(text.strip(F.col("t"))).collect()] == ["fico", "", "a b"]


def test_extreme_cases_need_their_class(spark):
    scored = spark.createDataFrame([(1, 0.9, 0), (2, 0.4, 0)], "row_id long, score double, label int")
    got = {r["case"]: r["row_id"] for r in ranked.extreme_cases(scored).collect()}
    assert got == {"confident_wrong": 1, "borderline": 2}
    assert ranked.extreme_cases(scored.limit(0)).count() == 0


def test_upsert_keeps_one_row_per_key(spark):
    base = spark.createDataFrame([("a", 1, 0)], "k string, v int, at int")
    batch = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("b", 4, 1), ("b", 4, 1)], "k string, v int, at int")
    assert sorted(map(tuple, files.upsert(base, batch, "k", "at").collect())) == [("a", 3, 2), ("b", 4, 1)]
    assert sorted(map(tuple, files.upsert(base, batch.filter("k = 'b'"), "k").collect())) == [("a", 1, 0), ("b", 4, 1)]
    with pytest.raises(Exception, match="two rows of a batch"):
        files.upsert(base, batch, "k").collect()


def test_ordered_diff_sees_length_and_repeats(spark):
    want = spark.createDataFrame([(1, "a", False), (2, "b", False), (3, "c", True), (4, "d", True)], "position int, name string, tied boolean")

    def diff(names):
        got = spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "position int, name string")
        return validate.ordered_diff(got, want, "name").first().asDict()

    clean = {"wrong": 0, "first_wrong": None, "tail_outside": 0, "extra": 0, "missing": 0, "duplicates": 0}
    assert diff("abdc") == clean
    assert diff("abcde") == {**clean, "wrong": 1, "first_wrong": 5, "extra": 1}
    assert diff("abc") == {**clean, "missing": 1}
    assert diff("abcc") == {**clean, "tail_outside": 1, "missing": 1, "duplicates": 1}
    assert diff("ba") == {**clean, "wrong": 2, "first_wrong": 1, "missing": 2}


def test_numbers_of_a_text_that_is_not_json(spark):
    df = spark.createDataFrame([("not json 12",), ('{"a": [12, "x"]}',), (None,)], "t string")
    assert [r[0] for r in df.select(text.json_numbers(F.col("t"))).collect()] == [None, [12.0], None]


def test_null_outcomes_and_configurations(spark):
    log = spark.createDataFrame([("r", False, None), ("r", False, "bad"), ("r", True, "fine")], "run string, ok boolean, outcome string")
    got = runs.rejected(log, ("bad",)).first()
    assert (got["rejected_calls"], got["bad"], got["unknown_outcomes"]) == (2, 1, 1)
    table = spark.createDataFrame([("r", None, "REAL", True, None)], "run string, config_id string, mode string, is_usable boolean, canary boolean")
    none = spark.createDataFrame([], "run string, metric string")
    only = runs.gates(table, (), none).filter("metric = 'M18'").first()
    assert (only["status"], only["reason"]) == ("excluded", "scope_not_canary")


def test_sample_of_any_size(spark, monkeypatch):
    """The n first by draw, whether the threshold falls early, late, about few rows or among repeats of one key."""
    monkeypatch.setattr(ranked, "_EDGE", 40)
    keys = list(range(3000)) + [17] * 500
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long").repartition(6)
    order = sorted(keys, key=lambda k: (hashlib.md5(f"9|{k}".encode()).hexdigest(), k))
    place = order.index(17)
    for n in (-1, 0, 1, 5, 1750, place + 1, place + 250, place + 501, 3499, 3500, 9999):
        got = ranked.seeded_sample(df, "k", 9, n).collect()
        assert sorted(r["k"] for r in got) == sorted(order[:max(n, 0)]) and len({r["i"] for r in got}) == len(got)
    assert ranked.seeded_sample(df.limit(0), "k", 9, 5).count() == 0
