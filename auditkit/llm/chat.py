"""Chat formatting with typed content parts.

A message's content is an array of parts (kind, text, ref, width, height, seconds, pages). ``flatten_parts`` visits
them in order: a text becomes escaped text, an image, audio or document part becomes a numbered placeholder. Each
placeholder leaves an attachment row: its number, kind, reference and how many tokens it expands to.

``format_chats`` puts the turns of a conversation into one text:

    <|turn|>role<|text|>content<|end|>

Escaping is reversible: inside roles and texts ``&`` becomes ``&amp;``, ``<`` becomes ``&lt;`` and ``[`` becomes ``&lsqb;``. No
control string of this template or of common others (``</s>``, ``[INST]``, ``<|im_end|>``) survives in a text, and
``read_chats`` finds turns by splitting at the marks. ``loss_spans`` are the code point ranges of assistant texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens that a part expands to: an image by 14-pixel patches, audio by 25 frames a second, a document by page.
PATCH, FRAMES, PAGE_TOKENS = 14, 25, 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&lsqb;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&lsqb;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def text_part(text: Column) -> Column:
    """A content array of one text part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), null.cast("string").alias("ref"),
                            null.cast("int").alias("width"), null.cast("int").alias("height"),
                            null.cast("double").alias("seconds"), null.cast("int").alias("pages")))


def part_tokens(part: Column) -> Column:
    """Tokens a part expands to; 0 for text. Missing measures count as the smallest part of the kind."""
    side = lambda v: F.ceil(F.greatest(F.coalesce(v, F.lit(1)), F.lit(1)) / PATCH)
    return (F.when(part["kind"] == "image", side(part["width"]) * side(part["height"]))
            .when(part["kind"] == "audio", F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * FRAMES), F.lit(1)))
            .when(part["kind"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * PAGE_TOKENS)
            .otherwise(0).cast("long"))


def flatten_parts(parts: Column, first: Column | int = 0) -> tuple[Column, Column]:
    """Text of the parts in order, and the attachments behind its placeholders, numbered from ``first``.

    A null array is an empty content, a null part or text an empty text; an unknown kind is taken as text."""
    parts = F.coalesce(parts, F.from_json(F.lit("[]"), f"array<{PART}>"))
    other = lambda p: F.coalesce(p["kind"].isin("image", "audio", "document"), F.lit(False))
    before = lambda i: F.size(F.filter(F.slice(parts, F.lit(1), i), other)) + first
    shown = F.transform(parts, lambda p, i: F.when(
        other(p), F.concat(F.lit("<|"), p["kind"], F.lit(":"), before(i).cast("string"), F.lit("|>"))
    ).otherwise(escape(F.coalesce(p["text"], F.lit("")))))
    numbered = F.transform(F.filter(parts, other), lambda p, i: F.struct(
        (i + first).cast("int").alias("number"), p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))
    return F.array_join(shown, ""), numbered


def format_chats(turns: DataFrame, parts: str = "parts", learn: str = "assistant") -> DataFrame:
    """One row per conv_id: formatted, loss_spans, attachments, expanded_tokens.

    ``turns`` has conv_id, turn, role and a content array. Turns go by turn number; equal numbers by role and content, so the
    result does not depend on row order, and repeated rows are repeated turns. A null role is empty. Rows without conv_id form one
    conversation of their own. Attachments are numbered through the conversation."""
    empty = F.lit("")
    seen = turns.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.col(parts).alias("parts"))
    rows = seen.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "parts"))).alias("turns"))
    kinds = ("image", "audio", "document")
    held = lambda t: F.size(F.filter(F.coalesce(t["parts"], F.from_json(F.lit("[]"), f"array<{PART}>")),
                                     lambda p: F.coalesce(p["kind"].isin(*kinds), F.lit(False))))
    # Each turn learns how many attachments come before it, in one pass.
    counted = F.aggregate("turns", F.array(F.lit(0)), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + held(t))))
    any_held = F.exists("turns", lambda t: held(t) > 0)
    rows = rows.withColumn("firsts", F.when(any_held, counted))
    turned = F.transform("turns", lambda t, i: F.struct(
        F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"),
        flatten_parts(t["parts"], F.coalesce(F.get("firsts", i), F.lit(0)))[0].alias("body"),
        flatten_parts(t["parts"], F.coalesce(F.get("firsts", i), F.lit(0)))[1].alias("attachments"),
        (t["role"] == learn).alias("learn")))
    rows = rows.select("conv_id", turned.alias("t"))
    whole = F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    rows = rows.select("conv_id", "t", whole.alias("formatted"))
    size = lambda t: F.length(t["head"]) + F.length(t["body"]) + len(END)
    start = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), "array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate("t", start, lambda acc, t: F.struct(
        (acc["at"] + size(t)).alias("at"),
        F.when(t["learn"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(t["head"])).alias("start"),
                                                                   F.length(t["body"]).alias("length")))))
        .otherwise(acc["spans"]).alias("spans")), lambda acc: acc["spans"])
    attachments = F.flatten(F.transform("t", lambda t: t["attachments"]))
    return rows.select("conv_id", "formatted", spans.alias("loss_spans"), attachments.alias("attachments"),
                       F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"))


def read_chats(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text), unescaped. Placeholders stay as they are."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p, i: i > 0)
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(p, TEXT, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr(s["start"] + 1, s["length"]))), "")
