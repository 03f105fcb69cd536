"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

``features`` turns a whole text into a few transformed shares and logarithms; each share has a pseudo count, so that a
text of a few words lies near the middle. ``fit`` sums class moments on Spark (all labelled rows it is given) and shrinks
every class covariance towards the pooled one's diagonal. ``Model`` holds the means and Cholesky factors; a score is
the logistic of the difference of log densities, each from a Mahalanobis distance, plus the log ratio of class sizes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditkit.llm import tokens
from auditkit.llm.rules import class_counts

NAMES = ("words", "word_length", "upper", "digits", "punctuation", "symbols", "same_as_next", "distinct", "wordless", "line_words")
#: Share of a class covariance that the pooled diagonal replaces, and the least variance of a feature.
SHRINK, LEAST = 0.1, 1e-3
#: Pseudo count of a share.
_FEW = 2.0
_LETTER = re.compile(rb"[A-Za-z0-9\x80-\xff]")


def text_features(text: str | None) -> list[float]:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n, chars = len(words), len(text)
    lower, upper, digit, _, punctuation, symbol = class_counts(text)
    share = lambda k, of, usual: np.log((k + _FEW * usual) / (of - k + _FEW * (1 - usual)) if of >= k else 0.0)
    same = sum(a == b for a, b in zip(words, words[1:]))
    distinct = set(words)
    wordless = sum(not _LETTER.search(w) for w in distinct) and sum(not _LETTER.search(w) for w in words)
    return [np.log1p(n), np.log((chars + 12) / (n + 2)), share(upper, lower + upper, 0.05), share(digit, chars, 0.01),
            share(punctuation, chars, 0.03), share(symbol, chars, 0.002), share(same, max(n - 1, 0), 0.01),
            np.log((len(distinct) + 2) / (n + 2)), share(wordless, n, 0.01), np.log((n + 8) / (text.count("\n") + 1))]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def features(texts: pa.Array) -> pa.Array:
    tokens.forget()
    return pa.array([text_features(t.as_py()) for t in texts], pa.list_(pa.float64()))


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text, mod 4, is 2. A null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and log constants by class; None where a class has no rows to learn from."""

    means: tuple
    factors: tuple
    constants: tuple
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.factors is None:
            return np.full(len(x), self.prior)
        logs = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants):
            z = (x - mean) @ factor.T
            logs.append(constant - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(rows: DataFrame, x: str = "x", label: str = "label") -> Model:
    """A model from all rows of ``rows``; those with a null in ``x`` or a label other than 0 and 1 don't count.

    Only sums come to the driver: a count, 10 sums and 55 products for each class. Without rows of both classes the score is
    the smoothed share of label 1 everywhere."""
    d = len(NAMES)
    v = lambda i: F.col(x)[i]
    sums = rows.filter(F.col(label).isin(0, 1) & F.col(x).isNotNull()).groupBy(F.col(label).cast("int").alias("c")).agg(
        F.count("*").alias("n"), *[F.sum(v(i)).alias(f"s{i}") for i in range(d)],
        *[F.sum(v(i) * v(j)).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]).collect()
    by = {r["c"]: r for r in sums}
    n = [by[c]["n"] if c in by else 0 for c in (0, 1)]
    prior = (n[1] + 1) / (sum(n) + 2)
    if min(n) < 2:
        return Model(None, None, None, prior)
    means = [np.array([by[c][f"s{i}"] for i in range(d)]) / n[c] for c in (0, 1)]
    products = [np.array([[by[c][f"p{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)]) / n[c] for c in (0, 1)]
    covariances = [p - np.outer(m, m) for p, m in zip(products, means)]
    pooled = np.diag(np.maximum(sum(k * np.diag(c) for k, c in zip(n, covariances)) / sum(n), LEAST))
    factors, constants = [], []
    for c in (0, 1):
        root = np.linalg.cholesky((1 - SHRINK) * covariances[c] + SHRINK * pooled)
        factors.append(np.linalg.inv(root))
        constants.append(-np.log(np.diag(root)).sum() + np.log(n[c] / sum(n)))
    return Model(tuple(means), tuple(factors), tuple(constants), prior)


def score(model: Model, x: Column) -> Column:
    """Score of a feature array; null has the score of the class sizes alone."""

    @F.arrow_udf("double")
    def run(rows: pa.Array) -> pa.Array:
        have = [r if r is not None else [np.nan] * len(NAMES) for r in rows.to_pylist()]
        found = model.scores(np.array(have, float).reshape(len(have), len(NAMES)))
        return pa.array(np.where(np.isnan(found), model.prior, found))

    return run(x)


def labelled(features_by_id: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Feature rows (doc_id, x) with their label, without the held-out ones."""
    told = labels.select("doc_id", F.col(label).alias("label")).filter(~held_out(F.col("doc_id")))
    return features_by_id.join(told, "doc_id").select("x", "label")
