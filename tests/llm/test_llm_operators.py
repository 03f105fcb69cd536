"""Operators of the llm subpackage against plain versions, and on nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import json
import math
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from auditkit.llm import bpe, chat, coder, discriminant, hosts, neardup, packing, pii, rules, tokenfiles, tokens, topk
from auditkit.llm.queries import RULES

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the river ran past the old mill and of all the boats in the harbour that was the one to which they had looked for years"
ODD = [(1, None, "en", None, None), (2, "", "en", "a", 0), (3, " \t\n", None, "a", 3), (4, "word", "xx", "a", 4), (4, "word", "xx", "a", 4),
       (5, (PROSE + ".\n") * 40, "en", "a", 1), (None, PROSE, "en", "a", 1), (6, "x" * 60_000, "en", "a", 1), (7, "1" * 40_000 + " 5555 " * 9, None, None, 1),
       (8, "é\u00a0日本語 \U0001f600  \r\n\u2028 'tis they're  <|endoftext|> \x1c a", "fr", "a", 9), (9, PROSE.upper() + "!! " * 50, "en", "a", 1)]


def frame(spark, rows=ODD, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def odd_columns(df):
    """Columns with the names that operators use inside."""
    for name in ("n", "x", "k", "h", "m", "key", "rank", "score", "kept", "length", "component_id", "rules", "label", "spans", "part", "count"):
        df = df.withColumn(name, F.lit("clash"))
    return df


# ---- chat

def test_chat_reads_back(spark):
    rows = [(1, 0, "user", "<|turn|>&lt;[INST]</s>&"), (1, 1, "assistant", None), (1, 2, None, "x"), (1, 2, None, "x"),
            (None, 0, "assistant", "a<|end|>b"), (2, None, "assistant", "é" * 20_000), (2, 1, "<b>", "")]
    turns = odd_columns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("parts", chat.text_part(F.col("text")))
    done = chat.format_chats(turns).select("conv_id", "formatted", chat.read_chats(F.col("formatted")).alias("t"),
                                           chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()
    want = defaultdict(list)
    for c, n, r, t in sorted(rows, key=lambda x: (x[0] or 0, -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        want[c].append((r or "", t or ""))
    assert {r["conv_id"]: [tuple(x) for x in r["t"]] for r in done} == want
    assert {r["conv_id"]: r["l"] for r in done} == {c: "".join(t for r, t in ts if r == "assistant") for c, ts in want.items()}
    for r in done:
        body = re.sub(r"<\|(turn|text|end)\|>", "", r["formatted"])
        assert "<" not in body and "[" not in body
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_chat_parts(spark):
    parts = "array<" + chat.PART + ">"
    image, audio = ("image", None, "a.png", 28, 15, None, None), ("audio", None, "b.wav", None, None, 2.0, None)
    rows = [(1, 0, "user", [("text", "see ", None, None, None, None, None), image, ("text", "<", None, None, None, None, None), audio]),
            (1, 1, "assistant", [("document", None, "c.pdf", None, None, None, 3), None]), (1, 2, "user", None)]
    r = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {parts}")).first()
    assert r["formatted"] == "<|turn|>user<|text|>see <|image:0|>&lt;<|audio:1|><|end|><|turn|>assistant<|text|><|document:2|><|end|><|turn|>user<|text|><|end|>"
    assert [(a["number"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, "a.png", 4), (1, "b.wav", 50), (2, "c.pdf", 768)]
    assert r["expanded_tokens"] == 822


# ---- hosts

def test_rules_and_parts(spark):
    urls = [None, "", "nothing", "http://EXAMPLE.com/en/7x?q#f", "x://a.example.com/en/8", "https://com/en/", "http://notcom", "http://b.net/de/8",
            "http://a.example.net/de/81", "http://h.org?/es/", "://", "http://h#x", "a://b://c/d"]
    got = hosts.judge_pages(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("bad", F.lit("clash")),
                            spark.createDataFrame([], "url string, bad int"), RULES).collect()
    for r in got:
        rest = (urls[r["page_id"]] or "").partition("://")[2]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [x for x in RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fit, key=lambda x: len(x.name), default=None)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best and best.name, best.verdict if best else "allow")
    assert len(got) == len(urls)
    assert hosts.judge_pages(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "url string, bad int"), RULES).count() == 0


def test_rules_are_the_contracts(spark):
    """Each rule's word as the contract lists it, and the verdict of a page that it alone or it and a shorter one fit."""
    assert [(r.verdict, r.name) for r in RULES] == [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"),
                                                    ("block", "example.net/de/8"), ("block", "org/es/")]
    urls = ["http://a.com/en/1", "http://example.com/en/71", "http://a.net/de/8", "http://example.net/de/7", "http://b.example.net/de/81", "http://c.org/es/"]
    got = hosts.judge_pages(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame([], "url string, bad int"), RULES)
    assert [r["verdict"] for r in got.orderBy("page_id").collect()] == ["block", "allow", "allow", "allow", "block", "block"]


def test_reputation_shrinks(spark):
    told = [(f"http://bad.spam.biz/{i}", 1) for i in range(60)] + [(f"http://good.fine.org/{i}", int(i % 20 == 0)) for i in range(200)]
    told += [("http://one.fine.org/", 1), (None, 1), ("http://good.fine.org/", None)]
    pages = [(i, u) for i, u in enumerate(["http://bad.spam.biz/", "http://good.fine.org/", "http://one.fine.org/", "http://new.fine.org/", "http://elsewhere.com/"])]
    got = hosts.judge_pages(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(told, "url string, bad int"), [])
    assert [r["verdict"] for r in got.orderBy("page_id").collect()] == ["block", "allow", "allow", "allow", "allow"]


# ---- rules

def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def test_rule_counts(spark):
    docs = odd_columns(frame(spark)).unionByName(odd_columns(spark.read.parquet(f"{SF}/documents.parquet")))
    got = rules.judge(docs, rules.language_references(docs)).select("doc_id", "text", "rules.*").collect()
    assert len(got) == docs.count()
    for r in got:
        n = plain_counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r["base_failed"] and r["kept"])


def test_divergence(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = rules.judge(docs, rules.language_references(docs)).filter("not rules.base_failed").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    good = got.filter("quality = 1").agg(F.avg(F.col("rules.kept").cast("int"))).first()[0]
    loud = got.filter(F.col("text").rlike("&&&.*###|###.*&&&")).agg(F.avg(F.col("rules.kept").cast("int"))).first()[0]
    assert good == 1 and loud < 0.1
    p, q = [0.2, 0.8, 0.0], [0.5, 0.25, 0.25]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    d = spark.range(1).select(rules.distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]
    assert abs(d - math.sqrt((kl(p) + kl(q)) / 2)) < 1e-12
    assert rules.judge(docs.limit(0), rules.language_references(docs.limit(0))).count() == 0


def test_common_words_can_fail(spark):
    """Texts of the characters of their language without its words, or with those of another, fail by their words alone; clean ones stay."""
    rng = np.random.default_rng(5)
    common = {"en": rules.COMMON[:12], "es": "el y los del las con para su lo como pero si".split()}
    share = np.arange(12, 0, -1) / 78

    def text(lang, n, often):
        words = ["".join(rng.choice(list("abdegilmnorst"), 5)) for _ in range(n)]
        for i in np.flatnonzero(rng.random(n) < often):
            words[i] = rng.choice(common[lang], p=share)
        return " ".join(words)

    clean = [(i, text(lang, n, 0.3), lang) for lang in common for i, n in enumerate([50, 60, 80, 120, 200, 400, 1000, 5000] * 5)]
    bare = [(100 + i, text(lang, n, 0.0), lang) for lang in common for i, n in enumerate((200, 500, 3000))]
    wrong = [(200 + i, text(other, n, 0.3), lang) for lang, other in (("en", "es"), ("es", "en")) for i, n in enumerate((200, 500, 3000))]
    rare = [(300, text("es", 400, 0.3), "xx")]
    docs = spark.createDataFrame(clean + bare + wrong + rare, "doc_id long, text string, lang string")
    got = rules.judge(docs, rules.language_references(docs)).select("doc_id", "lang", "rules.*").collect()
    assert not any(r["base_failed"] or r["char_distance"] > rules.MAX_CHAR_DISTANCE for r in got)
    assert {(r["doc_id"], r["lang"]) for r in got if not r["kept"]} == {(d, lang) for d, _, lang in bare + wrong}
    for s in ([0.2, 0.1, 0.05, 0.65], [0.004] * 50 + [0.8]):
        limits, drawn = rules.word_limits(np.array(s)), rng.multinomial(200, s, 4000) / 200
        m = (drawn + s) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.sqrt((np.nan_to_num(drawn * np.log2(drawn / m)) + s * np.log2(s / m)).sum(axis=1) / 2)
        assert d.max() < limits[4] < 0.35 and np.all(np.diff(limits) < 0)


# ---- classifier

def test_classifier_on_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    x = docs.select("doc_id", discriminant.features(F.col("text")).alias("x"))
    model = discriminant.fit(discriminant.labelled(x, labels))
    scored = x.join(labels, "doc_id").filter(discriminant.held_out(F.col("doc_id"))).select(discriminant.score(model, F.col("x")).alias("s"), "quality").collect()
    assert all(0 <= r["s"] <= 1 for r in scored)
    assert np.mean([(r["s"] >= 0.7) == r["quality"] for r in scored]) > 0.99
    odd = frame(spark).select(discriminant.score(model, discriminant.features(F.col("text"))).alias("s")).collect()
    assert len(odd) == len(ODD) and all(0 <= r["s"] <= 1 for r in odd)


def test_classifier_is_the_density_ratio(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(discriminant.NAMES)))
    y = (rng.random(400) < 0.3).astype(int)
    x[y == 1] = x[y == 1] * 0.5 + 1
    rows = spark.createDataFrame([(r.tolist(), int(c)) for r, c in zip(x, y)] + [(None, 1), ([0.0] * 10, None), ([0.0] * 10, 7)], "x array<double>, label int")
    model = discriminant.fit(rows)
    pooled = sum((y == c).mean() * np.cov(x[y == c].T, bias=True) for c in (0, 1))
    logs = []
    for c in (0, 1):
        s = 0.9 * np.cov(x[y == c].T, bias=True) + 0.1 * np.diag(np.diag(pooled))
        d = x - x[y == c].mean(axis=0)
        logs.append(np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(logs[0] - logs[1])))
    assert discriminant.fit(rows.filter("label = 1")).scores(x[:1])[0] > 0.9
    assert discriminant.fit(rows.limit(0)).scores(x[:1])[0] == 0.5


def test_held_out(spark):
    got = spark.range(50).select("id", discriminant.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


# ---- tokens and packing

HARD = ["", " ", "  ", "a  b", "a\n  b", "a \n b", " a", "a ", "\t \n x", "don't  'll", "x\u00a0 y", "\u2028 \u2028a", "a\x1c b \x1c", "ǅ ﬁ é́ e\u0301  1234 ...\n\n\n  end ", "<|endoftext|> <|startoftext|>"]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunked_encoding(file, monkeypatch):
    whole = Tokenizer.from_file(tokens.public_path(file))
    whole.encode_special_tokens = True
    rng = np.random.default_rng(3)
    alphabet = list("ab 'sé1.\n\t\u00a0\u3000\x1c\u2028Ǆ ") + ["  ", " the", "\r\n"]
    texts = HARD + ["".join(rng.choice(alphabet, size=rng.integers(1, 30))) for _ in range(3000)]
    texts += ["★ a★b | ^ ★", "don't DON'T it'll'", "ΑΣ Σ ας", "word|word, |", "a" * 900 + " " + "Ab," * 300]
    want = [array("I", e.ids).tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert tokens.Encoder(tokens.public_path(file)).encode(texts) == want
    for store in (tokens.STORE, 400):  # the second overflows again and again
        monkeypatch.setattr(tokens, "STORE", store)
        coder = tokens.open_tokenizer(tokens.public_path(file))
        assert type(coder) is {"b": tokens.Encoder, "w": tokens.WordEncoder}[file[0]]
        assert [c for at in range(0, len(texts), 100) for c in coder.encode(texts[at:at + 100])] == want and coder.encode([]) == []


def test_other_tokenizers_encode_whole_texts(tmp_path):
    """A file that splits texts in another way, here at nothing but line ends, is not cut at blanks."""
    about = json.load(open(tokens.public_path("byte_bpe_50k.json"), encoding="utf-8"))
    about["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"String": "\n"}, "behavior": "Isolated", "invert": False},
                                                                   {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    (tmp_path / "other.json").write_text(json.dumps(about), encoding="utf-8")
    coder, whole = tokens.open_tokenizer(str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    texts = ["of the river, in the town", "a  b\nof the", ""]
    assert coder.encode(texts) == [array("I", whole.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert type(coder) is tokens.WholeEncoder


def test_plan_is_best_fit():
    rng = np.random.default_rng(5)
    for size in (10, 64, 100):
        for _ in range(30):
            histogram = Counter(rng.integers(1, size + 1, rng.integers(0, 300)).tolist())
            bins = []
            for length in sorted(histogram.elements(), reverse=True):
                fit = [i for i, room in enumerate(bins) if room >= length]
                if fit:
                    bins[min(fit, key=lambda i: bins[i])] -= length
                else:
                    bins.append(size - length)
            filled, ranks = defaultdict(list), defaultdict(list)
            for length, lo, hi, first, per, offset in packing.plan_slots(dict(histogram), size):
                ranks[length] += range(lo, hi)
                for r in range(hi - lo):
                    filled[first + r // per].append((offset + r % per * length, length))
            assert {k: len(v) for k, v in ranks.items()} == {k: n for k, n in histogram.items()}
            assert all(sorted(v) == list(range(len(v))) for v in ranks.values())
            for pieces in filled.values():
                at = 0
                for offset, length in sorted(pieces):
                    assert offset == at
                    at += length
                assert at <= size
            assert len(filled) == len(bins)


def test_packing(spark):
    docs = odd_columns(frame(spark)).unionByName(odd_columns(spark.read.parquet(f"{SF}/documents.parquet")))
    path = tokens.public_path("word_bpe_49k.json")
    got = packing.pack(packing.cut(docs, path)).collect()
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[r["doc_id"], k, at, len(ids[at:at + 4096]), zlib.crc32(array("I", ids[at:at + 4096]).tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= math.ceil(sum(r["length"] for r in got) / 4096) + 2
    assert packing.pack(packing.cut(docs.limit(0), path)).count() == 0


# ---- search

def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(300)]
    rows += [(400 + i, rows[3][1]) for i in range(60)] + [(7, rows[7][1]), (8, rows[3][1])]
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, rows[0][1]), (504, [1.0, 2.0]), (520, [1e9] * 6), (521, [1e17] * 6), (540, [])]
    df = odd_columns(spark.createDataFrame(rows, "id long, e array<double>")).withColumn("v", topk.quantised(F.col("e")))
    got = defaultdict(list)
    for r in topk.search(df.filter("id % 20 = 0").repartition(3), df.repartition(4), k=5, tile=4, shard=16).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = {}
    for q in {i for i, _ in good if i % 20 == 0}:
        v = min(e for i, e in good if i == q)
        scores = {(i, sum(a * b for a, b in zip(v, e))) for i, e in good if i != q and len(e) == len(v)}
        best = sorted(((min(max(s, -2**63), 2**63 - 1), i) for i, s in scores), key=lambda x: (-x[0], x[1]))[:5]
        if best:
            want[q] = [(n + 1, i, s) for n, (s, i) in enumerate(best)]
    assert dict(got) == want
    assert topk.search(df.limit(0), df).count() == 0 and topk.search(df, df.limit(0)).count() == 0


# ---- near duplicates

def plain_components(rows, size, percent):
    sets = {}
    for i, (d, t) in enumerate(rows):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(words)} if words and len(words) < size else {tuple(words[j:j + size]) for j in range(len(words) - size + 1)} if words else set()
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter((a, b) for h in holders.values() if len(h) > 1 for a in h for b in h if a < b)
    for (a, b), n in common.items():
        if rows[a][0] is not None and rows[b][0] is not None and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            parent[root(a)] = root(b)
    low = {}
    for i in range(len(rows)):
        if rows[i][0] is not None:
            low[root(i)] = min(low.get(root(i), rows[i][0]), rows[i][0])
    return Counter((rows[i][0], len(sets[i]), None if rows[i][0] is None else low[root(i)]) for i in range(len(rows)))


@pytest.mark.parametrize("size,percent", [(4, 80), (5, 80)])
def test_near_duplicates(spark, size, percent):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = [(d, t) for d, t, *_ in ODD]
    base = rng.choice(vocabulary, 120).tolist()
    for i in range(80):  # copies of one text that differ among themselves more than from it, and chains of small edits
        words = list(base)
        for p in rng.choice(120, rng.integers(0, 5), replace=False):
            words[p] = f"new{i}"
        rows.append((100 + i, " ".join(words)))
    chain = list(rng.choice(vocabulary, 60))
    for i in range(12):
        rows.append((300 - i, "  ".join(chain).upper()))
        chain[rng.integers(0, 60)] = f"step{i}"
    rows += [(200 + i, f"a b c d e f{i % 3}") for i in range(12)] + [(220 + i, "x y") for i in range(5)]
    rows += [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = odd_columns(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.link(docs, size, percent).collect())
    assert got == plain_components(rows, size, percent)


def test_short_near_duplicates(spark):
    """Pairs of few shingles at exactly 80 %: 4 of 5, and 8 of 10."""
    texts = [" ".join(f"p{i}x{j}" for j in range(n)) for i in range(3000) for n in ((8, 9) if i < 2000 else (12, 14))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.link(docs, 5, 80).collect()}
    assert sorted({n for n, _ in got.values()}) == [4, 5, 8, 10]
    assert [d for d, (_, c) in got.items() if c != d - d % 2] == []


def test_components(spark):
    path = [(i, i + 1) for i in range(1, 60)]
    edges = path + [(100, x) for x in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["id"]: r["component"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert neardup.link(frame(spark).limit(0), 5, 80).count() == 0


# ---- personal data

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_spans(text):
    out = []
    for at, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))) or (kind == "phone" and not 9 <= len(digits) <= 15) or (
                    kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits))):
                continue
            out.append((m.start(), at, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_personal_data(spark):
    rng = np.random.default_rng(6)
    alphabet = list("ab1590.@+-() %_é\U0001f600") + ["@x.com", "1.2.3.4", "4111 1111 1111 1111", "+1 (437) 555-0689", "a@b.c_d@e.f"]
    texts = ["".join(rng.choice(alphabet, size=rng.integers(1, 40))) for _ in range(1500)]
    texts += [None, "", "a" * 30_000, "1" * 30_000, "1 " * 20_000, "a." * 20_000 + "@b", "x@" + "a." * 20_000, "\u00e9 4111111111111111 x@y.zz 10.0.0.1 0001.2.3.4 256.1.1.1",
              'token = "c0ffee35535f423f352535e4ac53b5fefe076ac6"']
    docs = odd_columns(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    model = pii.fit(docs)
    got = docs.select("doc_id", "text", pii.base_spans(F.col("text")).alias("b"))
    got = got.select("doc_id", "text", pii.listed(F.col("b")).alias("base"), pii.detect(F.col("text"), F.col("b"), model).alias("s"))
    got = got.select("doc_id", "base", pii.listed(F.col("s")).alias("s"), pii.redact(F.col("text"), F.col("s")).alias("r")).collect()
    for r in got:
        text, all_spans = texts[r["doc_id"]], r["s"].split(",") if r["s"] else []
        assert r["base"] == plain_spans(text)
        assert set(filter(None, r["base"].split(","))) <= set(all_spans)
        if text is None:
            assert r["r"] is None
            continue
        out, at = "", 0
        for kind, start, end in (s.split(":") for s in all_spans):
            if int(start) >= at:
                out += text[at:int(start)] + f"<{kind.upper()}>"
            at = max(at, int(end))
        assert r["r"] == out + text[at:]
    empty = pii.fit(docs.limit(0))
    assert docs.limit(3).select(pii.detect(F.col("text"), pii.base_spans(F.col("text")), empty)).count() == 3


def test_weak_supervision_learns_reliability():
    cells = {("card", 1, 1, 1): 900, ("card", 1, 1, 0): 300, ("card", -1, -1, 0): 700, ("card", 1, -1, 0): 40, ("card", -1, 1, 0): 30}
    table, post = pii.reliabilities(cells)
    assert post["card", 1, 1, 1] > 0.99 and post["card", -1, -1, 0] < 0.01
    assert table[0, 1, 1] > 0.9 > 0.2 > table[0, 1, 0]


# ---- token files

def test_coder_round_trip():
    rng = np.random.default_rng(8)
    blocks = [np.array(b, np.uint32) for b in ([7], [0, 0, 0], [2**32 - 1, 5], rng.integers(0, 50257, 1024), np.repeat(3, 1000), rng.zipf(1.3, 700) % 50000)]
    coded = coder.encode(blocks)
    assert all((a == b).all() for a, b in zip(blocks, coder.decode(coded)))
    assert len(coded[4]) < 200  # a run of one id costs next to nothing
    assert coder.encode([]) == [] and coder.decode([]) == []
    for at in (len(coded[3]) // 2, 6):
        broken = bytearray(coded[3])
        broken[at] ^= 1
        with pytest.raises(ValueError):
            coder.decode([bytes(broken)])
    assert (coder.decode([coded[5]])[0] == blocks[5]).all()  # each block stands alone


def test_token_files(spark, tmp_path):
    docs = odd_columns(frame(spark)).unionByName(odd_columns(spark.read.parquet(f"{SF}/documents.parquet").limit(300)))
    path = tokens.public_path("byte_bpe_50k.json")
    tokenfiles.write_ids(docs, str(tmp_path / "files"), path, end_id=2)
    got = tokenfiles.read_ids(spark, str(tmp_path / "files")).collect()
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    coded = lambda t: array("I", [*whole.encode(t or "", add_special_tokens=False).ids, 2]).tobytes()
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == Counter((r["doc_id"], coded(r["text"])) for r in docs.select("doc_id", "text").collect())
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"])
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: -1 if d is None else d)
    tokenfiles.write_ids(docs.limit(0), str(tmp_path / "none"), path, end_id=2)
    assert tokenfiles.read_ids(spark, str(tmp_path / "none")).count() == 0


# ---- byte-level BPE

@pytest.mark.parametrize("encode", [bpe.encode, bpe.encode_folded])
def test_byte_bpe(spark, encode):
    path = tokens.public_path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(9)
    texts = HARD + ["=" * 3000, "the" * 900, "é" * 500, "\n" * 400, " " * 70 + "x"] + ["".join(rng.choice(list("etaoin é日.\n 19'sß"), size=rng.integers(1, 90))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (None, "null id"), (3, texts[3])]
    rows += [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()]
    docs = odd_columns(spark.createDataFrame(rows, "doc_id long, text string"))
    done = encode(docs, path, public_tokenizers.PATTERN)
    got = done.select("doc_id", "ids", bpe.decode(F.col("ids"), path).alias("b")).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((d, tuple(whole.encode_ordinary(t or ""))) for d, t in rows)
    assert Counter(bytes(r["b"]) for r in got) == Counter((t or "").encode() for _, t in rows)
    assert encode(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_heap_merges_are_the_rule():
    ranks = bpe.read_ranks(tokens.public_path("byte_bpe_50k.tiktoken"))
    rng = np.random.default_rng(10)
    for _ in range(500):
        word = bytes(rng.choice(list(b"etaoinshrdlu=-"), size=rng.integers(1, 40)).astype(np.uint8))
        parts = [word[i:i + 1] for i in range(len(word))]
        while word not in ranks:
            pairs = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
            if not pairs:
                break
            i = min(pairs)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        assert bpe.merged(word, ranks) == ([word] if word in ranks else parts)


def test_digest_columns(spark):
    """The thin queries' digests are those of plain Python."""
    from auditkit.llm.registry import QUERIES

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in QUERIES["op6_pii_spans"](spark, "/root/testdata/sf0.001").collect():
        assert r["base_sha256"] == hashlib.sha256(plain_spans(docs[r["doc_id"]]).encode()).hexdigest()
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(tokens.public_path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in QUERIES["op5_byte_bpe"](spark, "/root/testdata/sf0.001").collect():
        ids = whole.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
