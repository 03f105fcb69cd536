"""Quality rules: plain counts, and the divergence of a text from its language.

``measure`` counts words, symbols, repeated lines and repeated three-word windows of a whole text, its characters by
class and its words among a fixed list of common words. ``language_references`` adds those histograms up over all
documents of a language. ``judge`` compares: a document fails when the Jensen-Shannon distance of its character classes
or of its common words to the reference of its language is above a limit.

Guards: a text under ``MIN_WORDS`` words has no distances (the plain rule on length speaks there). The limit for common
words follows from the language's own reference (``word_limits``): how far chance moves a text of as many words drawn
from it, ``DEVIATIONS`` standard deviations included, and ``MAX_WORD_DISTANCE`` for the way texts differ, so that a short
text may be far and a long one may not. A language with fewer than ``MIN_REFERENCE`` words in the corpus is compared with
all documents by its characters; it has no reference that common words could fail.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditkit.llm import tokens
from auditkit.sources.staging import materialize

MIN_WORDS, MIN_REFERENCE = 50, 5_000
#: MAX_WORD_DISTANCE + SLACK / sqrt(words) comes close to ``word_limits`` where a fifth of all words is common; the plain version in the tests uses it.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, SLACK = 0.28, 0.15, 2.0
#: Standard deviations of the divergence by chance that a text may show.
DEVIATIONS = 5
#: Words of the texts whose limits are worked out, two to an octave; between them limits are interpolated.
_STEPS, _LENGTHS = 2, MIN_WORDS * 2.0 ** (np.arange(41) / 2)
CLASSES = ("lower", "upper", "digit", "space", "punctuation", "symbol")

#: Frequent function words of English, French, German and Spanish.
COMMON = """the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which
de la le et les des en un du une que est pour qui dans par sur pas plus au ce il se ne
der die und den von zu das mit sich auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
el y los del las con para su al lo como pero sus ha me si sin sobre este ya entre cuando""".split()
COMMON = list(dict.fromkeys(COMMON))

_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common")
MEASURES = T.StructType([T.StructField(n, T.LongType() if i < 5 else T.ArrayType(T.LongType())) for i, n in enumerate(_NAMES)])
_SPACES, _SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
_WORD = re.compile(r"[^\x20\x09-\x0D]")
_class_table: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Class of every code point of the basic plane; later planes count as letters."""
    if not _class_table:
        kinds = {"Lu": 1, "Lt": 1, "Nd": 2, "Nl": 2, "No": 2, "Cc": 3, "Zs": 3, "Zl": 3, "Zp": 3}
        major = {"P": 4, "S": 5}
        table = np.zeros(0x10000, np.uint8)
        for cp in range(0x10000):
            cat = unicodedata.category(chr(cp))
            table[cp] = kinds.get(cat, major.get(cat[0], 0))
        for ch in _SYMBOLS + "@\\^_`~{}[]/":
            table[ord(ch)] = 5
        _class_table.append(table)
    return _class_table[0]


def class_counts(text: str) -> list[int]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(_classes()[np.where(codes < 0x10000, codes, 0x61)], minlength=len(CLASSES)).tolist()


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    lines = [x for x in lines if _WORD.search(x)]
    return len(lines) - len(set(lines))


def repeated_words(words: list) -> int:
    """Words inside a three-word window that the text has at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    distinct = Counter(windows)
    if len(distinct) == len(windows):
        return 0
    again = np.fromiter((distinct[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift:shift + len(again)] |= again
    return int(covered.sum())


def measure_text(text: str | None) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII blanks only
    have = Counter(words)
    common = [have.get(w, 0) for w in _COMMON_BYTES]
    return (len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), duplicate_lines(text),
            repeated_words(words), class_counts(text), [*common, len(words) - sum(common)])


_COMMON_BYTES = [w.encode() for w in COMMON]


@F.arrow_udf(MEASURES)
def measure(texts: pa.Array) -> pa.Array:
    tokens.forget()
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
    parts = []
    for at in range(0, max(len(texts), 1), 500):  # a few rows of Python numbers at a time
        rows = [measure_text(t.as_py()) for t in texts[at:at + 500]]
        columns = list(zip(*rows)) or [()] * len(_NAMES)
        parts.append(pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _NAMES))
    return pa.concat_arrays(parts)


def _chance(expected: float) -> tuple[float, float]:
    """Mean and variance of what a word adds to (words x divergence) when it comes up ``expected`` times on average."""
    reach = 12 * math.sqrt(expected)
    x = np.arange(max(0, math.floor(expected - reach)), math.ceil(expected + reach) + 20)
    p = np.exp(x * math.log(expected) - expected - np.array([math.lgamma(v + 1) for v in x]))
    half = lambda a, b: a * np.log2(np.maximum(2 * a / (a + b), 1e-300))
    adds = (half(x, expected) + half(expected, x)) / 2
    return (p * adds).sum(), (p * adds**2).sum() - (p * adds).sum() ** 2


_chance_table: list[np.ndarray] = []


def word_limits(shares: np.ndarray) -> np.ndarray:
    """Distance of common words that a text of each of ``_LENGTHS`` words may have from a reference with these shares."""
    grid = np.arange(-20, 13.25, 0.25)
    if not _chance_table:
        _chance_table.extend(np.array([_chance(2.0**g) for g in grid]).T)
    at = np.log2(np.outer(_LENGTHS, shares[shares > 0]))
    mean, variance = (np.interp(at, grid, c).sum(axis=1) for c in _chance_table)
    return np.sqrt(MAX_WORD_DISTANCE**2 + (mean + DEVIATIONS * np.sqrt(variance)) / _LENGTHS)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _limits(shares: pa.Array) -> pa.Array:
    return pa.array([word_limits(s.values.to_numpy()) for s in shares], pa.list_(pa.float64()))


def _limit(limits: Column, n: Column) -> Column:
    """The limit of a text of ``n`` words, none where the language has no limits."""
    at = F.least(_STEPS * F.log2(F.greatest(n, F.lit(MIN_WORDS)) / MIN_WORDS), F.lit(float(len(_LENGTHS) - 1)))
    below = F.least(F.floor(at), F.lit(len(_LENGTHS) - 2)).cast("int")
    low, high = F.get(limits, below), F.get(limits, below + 1)
    return low + (high - low) * (at - below)


def _sums(prefix: str, size: int) -> list[Column]:
    return [F.sum(F.col(prefix)[i]).alias(f"{prefix}{i}") for i in range(size)]


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """One row for each lang with enough words: histograms of all its documents, as shares.

    A null lang is the language ''. Sums run over every document of ``docs``; the table is written, so its size is known."""
    sizes = {"classes": len(CLASSES), "common": len(COMMON) + 1}
    m = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), measure(F.col(text)).alias("m")).select(
        "lang", "m.n_words", "m.classes", "m.common")
    sums = m.groupBy("lang").agg(F.sum("n_words").alias("n_words"), *[c for k, n in sizes.items() for c in _sums(k, n)])
    packed = materialize(sums.select("lang", "n_words", *[F.array(*[F.col(f"{k}{i}") for i in range(n)]).alias(k) for k, n in sizes.items()]), "languages")
    whole = packed.agg(F.sum("n_words").alias("n_words"), *[c for k, n in sizes.items() for c in _sums(k, n)]).first()
    overall = {k: [float(whole[f"{k}{i}"] or 0) for i in range(n)] for k, n in sizes.items()}
    large = F.col("n_words") >= MIN_REFERENCE
    chosen = {k: F.when(large, F.col(k).cast("array<double>")).otherwise(F.array(*map(F.lit, overall[k]))) for k in sizes}
    shares = packed.select("lang", large.alias("large"), *[_shares(c).alias(k) for k, c in chosen.items()])
    return materialize(shares.select("lang", *sizes, F.when(F.col("large"), _limits("common")).alias("limits")), "references")


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares: 0 for equal ones, 1 for disjoint ones."""
    half = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def judge(docs: DataFrame, references: DataFrame, text: str = "text", lang: str = "lang", into: str = "rules") -> DataFrame:
    """``docs`` with a struct column ``into``: counts, char_distance, word_distance, base_failed, kept.

    Null and empty texts have no words and fail the rule on length. ``into`` replaces a column of that name; all others stay,
    whatever they are called. The references are joined by Spark's own choice, which broadcasts them only below its size limit."""
    key, ref = "__lang", references.select(F.col("lang").alias("__lang"), F.struct("classes", "common", "limits").alias("__ref"))
    m = docs.withColumn(key, F.coalesce(lang, F.lit(""))).withColumn("__m", measure(F.col(text))).join(ref, key, "left")
    n, doubles = F.col("__m.n_words"), "array<double>"
    base_failed = (n < MIN_WORDS) | (100 * F.col("__m.n_repeat_words") > 50 * n)
    apart = lambda k: F.when(n >= MIN_WORDS, distance(_shares(F.col(f"__m.{k}").cast(doubles)), F.col(f"__ref.{k}")))
    counts = [F.col(f"__m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    m = m.withColumn(into, F.struct(*counts, apart("classes").alias("char_distance"), apart("common").alias("word_distance"), base_failed.alias("base_failed")))
    r = lambda c: F.col(f"{into}.{c}")
    far = (F.coalesce(r("char_distance"), F.lit(0.0)) > MAX_CHAR_DISTANCE) | (
        F.coalesce(r("word_distance"), F.lit(0.0)) > F.coalesce(_limit(F.col("__ref.limits"), n), F.lit(1.0)))
    return m.withColumn(into, F.col(into).withField("kept", ~(r("base_failed") | far))).drop(key, "__m", "__ref")
