"""Text expressions: phrase tiers, derivative names, slugs, whole words, numeric tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as blank at the ends of a text.
_BLANK = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.btrim(c, F.lit(_BLANK))

# Families whose one-hot columns are named <family>_<level>.
ONE_HOT_FAMILIES = ("o_orderpriority", "c_mktsegment", "unseen")
WAS_MISSING = "_was_missing"


def phrase_tier(text: Column, tiers: list[tuple[str, str, list[str]]]) -> Column:
    """Struct (tier, label, phrase) of the first phrase, in tier order, that the text holds; the phrase keeps its case."""
    low = F.lower(text)
    out = None
    for tier, label, phrases in tiers:
        for p in phrases:
            at = F.locate(p, low)
            hit = F.struct(F.lit(tier).alias("tier"), F.lit(label).alias("label"),
                           text.substr(at, F.lit(len(p))).alias("phrase"))
            out = F.when(low.contains(p), hit) if out is None else out.when(low.contains(p), hit)
    return out


def derivative_parent(name: Column, families: tuple[str, ...] = ONE_HOT_FAMILIES) -> Column:
    """Struct (parent, kind) of a missing flag or one-hot column; null for any other name."""
    base = F.regexp_extract(name, f"^(.+){WAS_MISSING}$", 1)
    out = F.when(base != "", F.struct(base.alias("parent"), F.lit("was_missing").alias("kind")))
    for f in families:
        out = out.when(name.startswith(f + "_"), F.struct(F.lit(f).alias("parent"), F.lit("one_hot").alias("kind")))
    return out


def retrieval_segment(config_id: Column) -> Column:
    """The part between ``-retrieval-`` and the last hyphen; null without the marker."""
    part = F.regexp_extract(config_id, "-retrieval-(.+)-[^-]*$", 1)
    return F.when(config_id.contains("-retrieval-"), part)


def slug(label: Column, size: int = 40) -> Column:
    """Letters and digits of any script, ``-`` and ``_`` are kept; anything else becomes ``-``."""
    return F.substring(F.regexp_replace(label, r"[^\p{L}\p{N}_-]", "-"), 1, size)


def has_word(text: Column, word: str) -> Column:
    """The name as a whole word: not inside a longer identifier."""
    return text.rlike(rf"(?<![A-Za-z0-9_])\Q{word}\E(?![A-Za-z0-9_])")


def contained(text: Column, terms: list[str]) -> Column:
    """The terms a text holds, ignoring case, in list order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.contains(t), F.lit(t)) for t in terms]))


def figure(text: Column, pattern: str) -> Column:
    """A figure read out of report text by a pattern with one group; thousands separators removed, null when absent."""
    return F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "").try_cast("double")


# The accepted spelling of numbers.
NUMBER = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?"
NUMBER_IN_TEXT = rf"(?<![\d.])({NUMBER})(?![A-Za-z_\d]|\.\d)"
SCIENTIFIC = r"(?<![A-Za-z_\d.])[+-]?\d+(?:\.\d+)?[eE][+-]?\d+(?![A-Za-z_\d])"
_OPEN, _CLOSE = "\u0001", "\u0002"


def scientific(text: Column) -> Column:
    """Figures in scientific form, as written."""
    return F.regexp_extract_all(text, F.lit(SCIENTIFIC), F.lit(0))


def token_value(token: Column) -> Column:
    return F.regexp_replace(token, "[,%]", "").try_cast("double")


def token_decimals(token: Column) -> Column:
    frac = F.regexp_extract(F.regexp_replace(token, "[,%]", ""), r"\.(\d+)$", 1)
    return F.length(frac)


def number_tokens(text: Column) -> Column:
    """Array of (text, value, decimals): the numeric tokens of a text in reading order.

    Every candidate is first fenced by two control characters; what stands before its opening fence then tells whether a
    sign belongs to it (``-3``), separates it (``0.6-0.7``, ``top-6``) or makes it part of an identifier (``a1``, ``x_2``).
    """
    clean = F.translate(text, _OPEN + _CLOSE, "  ")
    plain = F.regexp_replace(clean, SCIENTIFIC, " ")
    pieces = F.split(F.regexp_replace(plain, NUMBER_IN_TEXT, f"{_OPEN}$1{_CLOSE}"), _OPEN)

    def token(before: Column, piece: Column) -> Column:
        ahead = F.regexp_replace(F.substring(before, -4, 4), _CLOSE, "")
        body = F.substring_index(piece, _CLOSE, 1)
        glued = ahead.rlike(r"[\p{L}_]$") | ahead.rlike(r"\p{L}[+]$") | ahead.rlike(r"_[+-]$")
        sign = F.when(ahead.rlike(r"[+-]$") & ~ahead.rlike(r"[0-9.)\]}][+-]$") & ~ahead.rlike(r"\p{L}-$"),
                      F.substring(ahead, -1, 1)).otherwise("")
        word = F.concat(sign, body)
        return F.when(~glued, F.struct(word.alias("text"), token_value(word).alias("value"),
                                       token_decimals(word).alias("decimals")))

    def tokens(p: Column) -> Column:
        n = F.greatest(F.size(p) - 1, F.lit(0))
        return F.array_compact(F.zip_with(F.slice(p, F.lit(1), n), F.slice(p, F.lit(2), n), token))

    # The split text is the one element of an array, so that it is worked out once per text and not once per use.
    return F.get(F.transform(F.array(F.when(text.rlike("[0-9]"), pieces).otherwise(F.array(F.lit("")))), tokens), F.lit(0))


_JSON_PART = r'"(?:[^"\\]|\\.)*"\s*:?|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?'


def json_numbers(payload: Column) -> Column:
    """Every number in a JSON text at any depth, and every string that is spelled as one number. Keys and booleans never count.

    Null for a text that is not JSON."""
    parts = F.regexp_extract_all(payload, F.lit(_JSON_PART), F.lit(0))
    leaves = F.filter(parts, lambda p: ~p.endswith(":"))
    bare = F.transform(leaves, lambda p: F.regexp_replace(p, '^"|"$', ""))
    spelled = F.filter(F.arrays_zip(leaves.alias("leaf"), bare.alias("bare")),
                       lambda z: ~z["leaf"].startswith('"') | z["bare"].rlike(rf"^[+-]?{NUMBER}$"))
    return F.when(F.try_parse_json(payload).isNotNull(), F.transform(spelled, lambda z: token_value(z["bare"])))


def json_strings(payload: Column) -> Column:
    """Every string in a JSON text at any depth, decoded. Keys don't count. Null for a text that is not JSON."""
    parts = F.regexp_extract_all(payload, F.lit(r'"(?:[^"\\]|\\.)*"\s*:?'), F.lit(0))
    leaves = F.array_join(F.filter(parts, lambda p: ~p.endswith(":")), ",")
    return F.when(F.try_parse_json(payload).isNotNull(), F.from_json(F.concat(F.lit("["), leaves, F.lit("]")), "array<string>"))
