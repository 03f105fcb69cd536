"""Personal data by weak supervision, in DataFrame operations only.

Every text gives candidate spans: the base kinds (email, ip, card, phone), which always stay, and added kinds (secret,
account, local_phone), which the method has to accept. Three labelers vote on each candidate, yes, no or nothing: the
shape (regex), prefixes and endings from fixed lists (gazetteer), and cue words before the span (context).

``fit`` counts the votes over all documents. The counts have one row for each kind, vote pattern and feature bucket, a
few thousand at most whatever the corpus, and only they come to the driver. Expectation-maximisation estimates how
often each labeler votes each way on personal and on other spans; its posteriors are the soft labels of a logistic
span classifier over kind, votes, length, digits and neighbours. ``detect`` applies its weights as a sum of literals
and accepts added spans from ``ACCEPT`` on that overlap no base span.

Patterns use possessive quantifiers and look-behinds, so that they match what their plain forms match from left to right
without trying every start inside a long run of characters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE, ADDED = ("email", "ip", "card", "phone"), ("secret", "account", "local_phone")
KINDS = BASE + ADDED
LABELERS = ("regex", "gazetteer", "context")
ACCEPT = 0.9

_LOCAL = "[A-Za-z0-9._%+-]"
_PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
    "account": r"(?<![0-9A-Za-z.+-])[0-9]{9,19}+(?![0-9A-Za-z])",
    "local_phone": r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: What a text must hold before the pattern is worth running.
_GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": r"\+[0-9]",
          "secret": r"[A-Za-z0-9_-]{20}", "account": r"[0-9]{9}", "local_phone": r"[0-9]{3}[ .-][0-9]{4}"}

#: Common top-level domains, card issuer prefixes, country calling codes, key prefixes, cue words.
TLDS = ["com", "net", "org", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "uk", "eu", "us"]
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|36|6011|65|35)"
CALLING = r"^\+(1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
KEYS = r"^(sk-|pk-|AKIA|ghp_|xox|eyJ|AIza)"
CUES = r"(token|secret|passw|api.?key|\bkey|credential|phone|\btel|call|mobile|mail|contact|card|visa|account|iban|server|host|\bip\b)"
COUNTER_CUES = r"(version|order|invoice|isbn|issn|serial|sku|page|figure|chapter|commit|checksum|sha)"

_SPANS = "array<struct<kind:string,at:int,start:int,end:int,value:string>>"


def _none() -> Column:
    return F.from_json(F.lit("[]"), _SPANS)


def _matches(text: Column, kind: str) -> Column:
    """All matches of a kind's pattern, left to right, with positions in code points: the pieces between matches give them."""
    pattern = F.lit(_PATTERNS[kind])
    pairs = F.arrays_zip(F.split(text, _PATTERNS[kind], -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).alias("at"), _none().alias("found"))

    def step(acc, x):
        at = acc["at"] + F.length(x["gap"])
        end = at + F.length(x["hit"])
        span = F.struct(F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("at"), at.alias("start"), end.alias("end"), x["hit"].alias("value"))
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["found"], F.array(span)).alias("found")))

    found = F.aggregate(F.filter(pairs, lambda x: x["hit"].isNotNull()), start, step, lambda acc: acc["found"])
    return F.when(text.rlike(_GATES[kind]), found).otherwise(_none())


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(s: Column, kind: str) -> Column:
    """The checks that come after a match; a failing match is dropped and not tried again."""
    n = F.length(_digits(s["value"]))
    if kind == "ip":
        return F.forall(F.split(s["value"], r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(
            F.right(F.concat(F.lit("000"), p), F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(n.between(12, 19), F.call_function("luhn_check", _digits(s["value"]))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "secret":
        return s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & (n >= 4)
    return F.lit(True)


def _candidates(text: Column, kind: str) -> Column:
    return F.filter(_matches(text, kind), lambda s: _valid(s, kind))


def base_spans(text: Column) -> Column:
    """Spans of the base kinds by start, then kind. A null text has none."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*[_candidates(text, k) for k in BASE]), _order)


def _order(a: Column, b: Column) -> Column:
    key = lambda s: s["start"].cast("long") * 16 + s["at"]
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def added_candidates(text: Column, base: Column) -> Column:
    """Candidates of the added kinds that overlap no base span and none of an earlier added kind. ``base`` should be a plain column."""
    text = F.coalesce(text, F.lit(""))
    over = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])

    def free(found):
        return F.filter(found, lambda s: ~F.exists(base, lambda b: over(b, s)) & ~F.exists(found, lambda o: (o["at"] < s["at"]) & over(o, s)))

    # One candidate array, computed once, then looked at from every candidate.
    return F.get(F.transform(F.array(F.concat(*[_candidates(text, k) for k in ADDED])), free), F.lit(0))


def _votes(text: Column, s: Column) -> dict[str, Column]:
    """Features of a span: the three votes (1, 0, -1) and buckets of length, digits and neighbours."""
    value, kind, digits = s["value"], s["kind"], _digits(s["value"])
    yes, no, nothing = F.lit(1), F.lit(-1), F.lit(0)
    tld = F.substring_index(value, ".", -1)
    regex = (F.when(kind == "email", F.when(tld.rlike("^[A-Za-z]{2,24}$"), yes).otherwise(no))
             .when(kind == "card", F.when(F.length(digits).between(13, 19), yes).otherwise(nothing))
             .when(kind == "phone", F.when(F.length(digits).between(10, 13), yes).otherwise(nothing))
             .when(kind == "ip", F.when(value.rlike(r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$"), yes).otherwise(no))
             .when(kind == "secret", F.when(value.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"), yes).otherwise(nothing))
             .when(kind == "account", F.when(F.length(digits).isin(16, 15), nothing).otherwise(no))
             .otherwise(yes))
    gazetteer = (F.when(kind == "email", F.when(F.lower(tld).isin(TLDS), yes).otherwise(nothing))
                 .when(kind.isin("card", "account"), F.when(digits.rlike(ISSUERS), yes).otherwise(no))
                 .when(kind == "phone", F.when(value.rlike(CALLING), yes).otherwise(no))
                 .when(kind == "ip", F.when(value.rlike(r"^(0|127|255)\."), no).otherwise(yes))
                 .when(kind == "secret", F.when(value.rlike(KEYS), yes).otherwise(nothing)).otherwise(nothing))
    before = F.lower(text.substr(F.greatest(s["start"] - 31, F.lit(1)), F.least(s["start"], F.lit(32))))
    context = F.when(before.rlike(CUES), yes).when(before.rlike(COUNTER_CUES), no).otherwise(nothing)
    share = F.length(digits) / F.length(value)
    after = text.substr(s["end"] + 1, F.lit(1))
    return {"regex": regex, "gazetteer": gazetteer, "context": context,
            "long": F.when(F.length(value) >= 32, 2).when(F.length(value) >= 14, 1).otherwise(0),
            "digits": F.floor(share * 3).cast("int"),
            "quoted": F.when(before.rlike("[\"']$") & after.rlike("[\"']"), 1).otherwise(0)}


FEATURES = (*LABELERS, "long", "digits", "quoted")


def voted(text: Column, spans: Column) -> Column:
    """``spans`` with a field for each feature."""
    text = F.coalesce(text, F.lit(""))
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["at"].alias("at"), s["start"].alias("start"), s["end"].alias("end"),
                                                 *[c.cast("int").alias(k) for k, c in _votes(text, s).items()]))


@dataclass(frozen=True)
class SpanModel:
    """Weights of the span classifier by (feature, value), and what the labelers' votes are worth."""

    bias: float
    weights: dict
    reliability: dict

    def logit(self, s: Column) -> Column:
        total = F.lit(self.bias)
        for name in ("kind", *FEATURES):
            known = {v: w for (f, v), w in self.weights.items() if f == name}
            pick = F.lit(0.0)
            for v, w in known.items():
                pick = F.when(s[name] == v, F.lit(w)).otherwise(pick)
            total = total + pick
        return total


def reliabilities(cells: dict[tuple, int], rounds: int = 30) -> tuple[dict, dict]:
    """EM over (kind, regex vote, gazetteer vote, context vote) counts: P(vote | personal or not) of each labeler, and P(personal).

    Starts from the mean vote. Every table has one pseudo count, so a labeler that never votes says nothing."""
    post = {c: 1 / (1 + math.exp(-1.5 * sum(c[1:]))) for c in cells}
    table: dict = {}
    for _ in range(rounds):
        total = {y: sum(n * (post[c] if y else 1 - post[c]) for c, n in cells.items()) for y in (0, 1)}
        table = {(i, v, y): (1 + sum(n * (post[c] if y else 1 - post[c]) for c, n in cells.items() if c[1 + i] == v)) / (total[y] + 3)
                 for i in range(3) for v in (-1, 0, 1) for y in (0, 1)}
        prior = {k: (1 + sum(n * post[c] for c, n in cells.items() if c[0] == k)) / (2 + sum(n for c, n in cells.items() if c[0] == k))
                 for k in {c[0] for c in cells}}
        for c in cells:
            p = [(prior[c[0]] if y else 1 - prior[c[0]]) * math.prod(table[i, c[1 + i], y] for i in range(3)) for y in (0, 1)]
            post[c] = p[1] / (p[0] + p[1])
    return table, post


def _logistic(rows: list[tuple[list, float, float]], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> tuple[float, dict]:
    """Weights of a logistic regression on (features, weight, soft label) rows, by gradient steps."""
    bias, weights = 0.0, {f: 0.0 for fs, _, _ in rows for f in fs}
    whole = sum(n for _, n, _ in rows) or 1
    for _ in range(rounds):
        grad, grad_bias = dict.fromkeys(weights, 0.0), 0.0
        for fs, n, q in rows:
            p = 1 / (1 + math.exp(-max(min(bias + sum(weights[f] for f in fs), 30), -30)))
            d = n / whole * (p - q)
            grad_bias += d
            for f in fs:
                grad[f] += d
        bias -= rate * len(KINDS) * grad_bias
        for f in weights:
            weights[f] -= rate * len(KINDS) * (grad[f] + decay * weights[f])
    return bias, weights


def fit(docs: DataFrame, text: str = "text") -> SpanModel:
    """Learns from the candidates of all documents. Without any, the classifier accepts nothing."""
    t = F.col(text)
    seen = docs.select(t.alias("t"), base_spans(t).alias("b")).withColumn("a", added_candidates(F.col("t"), F.col("b")))
    s = seen.select(F.explode(voted(F.col("t"), F.concat("b", "a"))).alias("s")).select("s.kind", *[f"s.{f}" for f in FEATURES])
    counted = s.groupBy("kind", *FEATURES).count().collect()
    cells: dict = {}
    for r in counted:
        c = (r["kind"], *[r[k] for k in LABELERS])
        cells[c] = cells.get(c, 0) + r["count"]
    if not cells:
        return SpanModel(-10.0, {}, {})
    table, post = reliabilities(cells)
    rows = [([(f, r[f]) for f in ("kind", *FEATURES)], r["count"], post[(r["kind"], *[r[k] for k in LABELERS])]) for r in counted]
    bias, weights = _logistic(rows)
    return SpanModel(bias, weights, {f"{LABELERS[i]} {v:+d} {('other', 'personal')[y]}": p for (i, v, y), p in table.items()})


def detect(text: Column, base: Column, model: SpanModel, accept: float = ACCEPT) -> Column:
    """All spans (kind, at, start, end) by start, then kind: base ones and the added ones that the classifier accepts."""
    least = math.log(accept / (1 - accept))
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["at"].alias("at"), s["start"].alias("start"), s["end"].alias("end"))
    added = F.filter(voted(text, added_candidates(text, base)), lambda s: model.logit(s) >= least)
    return F.array_sort(F.concat(F.transform(base, plain), F.transform(added, plain)), _order)


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named after the first."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        later = F.greatest(acc["at"], s["end"])
        put = F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(later.alias("at"), F.when(s["start"] >= acc["at"], put).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
