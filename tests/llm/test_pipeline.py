"""The pipeline against a plain version of itself, and on odd tables."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import ODD, plain_components, plain_counts, plain_spans

import corpus_pipeline
from auditkit.llm import discriminant, neardup, pii, rules

SF = "/root/testdata/sf0.01"


def plain_rules(rows):
    """rows of (doc_id, text, lang) that the rules keep."""
    totals = {}
    measured = [rules.measure_text(t) for _, t, _ in rows]
    for (_, _, lang), m in zip(rows, measured):
        n, a, b = totals.get(lang, (0, 0, 0))
        totals[lang] = (n + m[0], a + np.array(m[5], float), b + np.array(m[6], float))
    whole = [sum(t[i] for t in totals.values()) for i in (1, 2)]

    def far(counts, reference):
        p, q = np.array(counts) / sum(counts), np.array(reference) / sum(reference)
        m = (p + q) / 2
        kl = lambda x: sum(v * math.log2(v / w) for v, w in zip(x, m) if v > 0)
        return math.sqrt(max((kl(p) + kl(q)) / 2, 0))

    kept = []
    for (d, t, lang), m in zip(rows, measured):
        n, _, _, _, inside = plain_counts(t)
        if n < 50 or 100 * inside > 50 * n:
            continue
        refs = totals[lang][1:] if totals[lang][0] >= rules.MIN_REFERENCE else whole
        if far(m[5], refs[0]) <= rules.MAX_CHAR_DISTANCE and far(m[6], refs[1]) <= rules.MAX_WORD_DISTANCE + rules.SLACK / math.sqrt(n):
            kept.append(d)
    return kept


@pytest.fixture(scope="module")
def steps(spark):
    """Every stage's output, as rows."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_follow_the_plain_version(spark, steps):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    for df in steps[:4]:
        assert df.schema.names == raw.schema.names
    assert sorted(texts(steps[0])) == sorted(plain_rules([(r["doc_id"], r["text"], r["lang"]) for r in raw.collect()]))

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = {r["doc_id"] for r in raw.filter(discriminant.held_out(F.col("doc_id"))).collect()}
    taught = [(np.array(discriminant.text_features(t)), labels[d]) for d, t in texts(raw).items() if d in labels and d not in held]
    x, y = np.array([f for f, _ in taught]), np.array([q for _, q in taught])
    pooled = np.maximum(sum((y == c).mean() * np.var(x[y == c], axis=0) for c in (0, 1)), discriminant.LEAST)
    kept = []
    for d, t in texts(steps[0]).items():
        logs = []
        for c in (0, 1):
            s = (1 - discriminant.SHRINK) * np.cov(x[y == c].T, bias=True) + discriminant.SHRINK * np.diag(pooled)
            delta = np.array(discriminant.text_features(t)) - x[y == c].mean(axis=0)
            logs.append(np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * delta @ np.linalg.solve(s, delta))
        if 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))) >= 0.7:
            kept.append(d)
    assert sorted(texts(steps[1])) == sorted(kept)

    before = list(texts(steps[1]).items())
    assert sorted(texts(steps[2])) == sorted(d for d, _, c in plain_components(before, 5, 80) if d == c)

    after = texts(steps[3])
    assert sorted(after) == sorted(texts(steps[2]))
    for d, t in texts(steps[2]).items():
        assert plain_spans(after[d]) == "" or not plain_spans(t)
        if not plain_spans(t) and not any(w in t for w in ("token", "@", "+")):
            assert after[d] == t
    assert all(r["n_chars"] == len(r["text"]) for r in steps[3].collect())

    packed = steps[4].collect()
    assert sorted({r["doc_id"] for r in packed}) == sorted(after)
    sizes = Counter()
    for r in packed:
        sizes[r["sequence_id"]] += r["length"]
    assert max(sizes.values()) <= 4096 and len(sizes) <= math.ceil(sum(sizes.values()) / 4096) + 2


def test_good_documents_stay(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    long_enough = spark.read.parquet(f"{SF}/documents.parquet").filter(F.size(F.split("text", r"\s+")) > 60)
    good = long_enough.join(labels.filter("quality = 1"), "doc_id")
    assert good.join(steps[1], "doc_id", "left_anti").count() <= 0.01 * good.count()
    bad = labels.filter("quality = 0")
    assert steps[1].join(bad, "doc_id").count() <= 0.02 * bad.count()


def test_odd_documents_pass_every_stage(spark):
    rows = ODD + [(20 + i, "the river and the old mill of the town by the sea " * 2 + " ".join(f"w{i}x{j}" for j in range(60)), "en", "a", 1) for i in range(5)]
    rows += [(40, rows[-1][1], "en", "a", 1), (24, rows[-1][1], "en", "a", 1), (None, rows[-1][1], "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("n", "x", "rules", "key", "score", "label", "kept"):
        docs = docs.withColumn(name, F.lit("clash"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        each = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert name == "packing" or each.columns == columns
        assert each.count() > 0
    once = corpus_pipeline.keep_one_of_copies(spark, docs, SF)
    ids = Counter(r["doc_id"] for r in once.collect())
    assert ids[24] == 1 and ids[40] == 0 and ids[4] == 1 and ids[None] == 2


def test_texts_of_repeated_ids_are_kept_apart(spark):
    """An id that stands for several texts: each text that is no copy stays, in whatever order the rows come."""
    def words(k, n=60):
        return " ".join(f"{k}{j}" for j in range(n))
    a, b, c, near_a = words("a"), words("b"), words("c"), words("a") + " more"
    rows = [(3, b), (5, b), (5, a), (3, c), (3, c), (9, near_a), (7, ""), (7, None), (7, words("d")), (8, a), (None, b)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in order], "doc_id long, text string, lang string, source string, n_chars long")
        got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_copies(spark, docs, SF).collect())
        blank = got.pop((7, ""), 0) + got.pop((7, None), 0)
        assert blank == 1 and got == Counter({(3, b): 1, (5, a): 1, (3, c): 1, (7, words("d")): 1, (None, b): 1})
        linked = {(r["doc_id"], r["n_shingles"], r["k0"]): r for r in neardup.link(docs).filter("n_shingles > 0 and doc_id is not null").collect()}
        assert Counter(r["component_id"] for r in linked.values()) == Counter({3: 3, 5: 3, 7: 1})
        assert sum(r["leads"] for r in linked.values()) == 4
