"""Numeric tokens, JSON numbers, names and texts against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from auditkit.functions import calls, dates, encode, text

CASES = {
    "AUC is 0.614-0.624 on 1,234 rows": ["0.614", "0.624", "1,234"],
    "top-6 of a1,234 and x_2": ["6"],
    "moved -3 and +4.50%": ["-3", "+4.50%"],
    "about 1e-3 or 2.5E+7": [],
    "12%a and 5%5": ["12", "5", "5"],
    "v1.2.3 then 7.": ["7"],
    "(0.5)-0.2": ["0.5", "0.2"],
    "a+3 b-4 _5 _-6": ["4"],
    "": [], "no figures": [], "999": ["999"], "1,23": ["1", "23"],
}


def plain_tokens(s):
    """The rule, spelled out by scanning left to right."""
    s = re.sub(text.SCIENTIFIC, " ", s)
    out = []
    for m in re.finditer(text.NUMBER_IN_TEXT, s):
        a, b = m.span(1)
        one, two = (s[a - 1] if a > 0 else ""), (s[a - 2] if a > 1 else "")
        if one.isalpha() or one == "_":
            continue
        if one in ("+", "-") and not (two and (two in "0123456789.)]}" or (one == "-" and two.isalpha()))):
            if two.isalpha() or two == "_":
                continue
            a -= 1
        out.append(s[a:b])
    return out


def tokens(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", text.number_tokens(F.col("t")).alias("x")).orderBy("i").collect()
    return [[(t["text"], t["value"], t["decimals"]) for t in r["x"]] for r in got]


def test_number_tokens(spark):
    for (s, want), got in zip(CASES.items(), tokens(spark, CASES)):
        assert [t[0] for t in got] == want == plain_tokens(s), s


def test_number_tokens_random(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("0123456789.,%+-_ ae()x") for _ in range(40)) for _ in range(1500)]
    for s, got in zip(texts, tokens(spark, texts)):
        assert [t[0] for t in got] == plain_tokens(s), s
        for word, value, places in got:
            body = word.replace(",", "").rstrip("%")
            assert value == float(body) and places == (len(body.split(".")[1]) if "." in body else 0)


def leaves(node):
    if isinstance(node, bool) or node is None:
        return []
    if isinstance(node, (int, float)):
        return [float(node)]
    if isinstance(node, str):
        ok = re.fullmatch("[+-]?" + text.NUMBER, node)
        return [float(node.replace(",", "").rstrip("%"))] if ok else []
    return [x for v in (node.values() if isinstance(node, dict) else node) for x in leaves(v)]


def test_json_numbers(spark):
    docs = [{"a": 1, "b": [2.5, "3%", "x4", True, None], "c": {"5": "-6", "d": "1,234.5"}}, [], {"k": "a:1", "n": -2e-3},
            {"quote\"12": "say \"7\"", "e": [[8], {"f": 9}]}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, t string")
    got = df.select(text.json_numbers(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == [leaves(d) for d in docs]


def test_canonical_arguments(spark):
    rows = [("find", '{"q": " a ", "n": 5}'), ("find", '{"n": 5, "q": "a"}'), ("find", '{"q": "a"}'), ("find", '{"z": " a "}'), ("find", '[1]')]
    df = spark.createDataFrame(rows, "tool string, args string")
    form = calls.canonical_arguments(F.col("tool"), F.col("args"), {"find": ("q", "n")}, {"find": {"n": 5}})
    got = [r[0] for r in df.select(form).collect()]
    assert got[0] == got[1] == got[2] and got[3] != got[0] and '" a "' in got[3] and got[4] == "[1]"


def test_names(spark):
    df = spark.createDataFrame([("acctbal_was_missing",), ("unseen_X",), ("unseen",), ("_was_missing",), ("plain",)], "n string")
    got = [r[0] for r in df.select(text.derivative_parent(F.col("n"))).collect()]
    assert [g and g["parent"] for g in got] == ["acctbal", "unseen", None, None, None]
    word = spark.createDataFrame([("see recoveries now",), ("recoveries_2",), ("my_recoveries",), ("recoveries",)], "t string")
    assert [r[0] for r in word.select(text.has_word(F.col("t"), "recoveries")).collect()] == [True, False, False, True]


def test_parse_failures_become_null(spark):
    df = spark.createDataFrame([("Dec-2015", " 36 months", "B3"), ("2015-12", "months", "Z9")], "d string, t string, g string")
    got = df.select(dates.month_date(F.col("d")), encode.term_months(F.col("t")),
                    encode.letter_digit(F.col("g"), {"A": 1, "B": 2})).collect()
    assert [str(got[0][0]), got[0][1], got[0][2]] == ["2015-12-01", 36, 8]
    assert list(got[1]) == [None, None, None]


@pytest.mark.parametrize("s,want", [("run 11/honest!", "run-11-honest-"), ("é_ñ-1", "é_ñ-1"), ("x" * 50, "x" * 40)])
def test_slug(spark, s, want):
    assert spark.createDataFrame([(s,)], "s string").select(text.slug(F.col("s"))).head()[0] == want
