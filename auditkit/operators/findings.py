"""Parsing of findings blocks out of answer texts. Every step is row-local: no shuffle, whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditkit.functions.text import strip

# The answer format.
DELIMITER = "----- VERBATIM MODEL TEXT BELOW THIS LINE -----"
START = "=== AUDIT FINDINGS ==="
END = "=== END AUDIT FINDINGS ==="
SEPARATOR = "###"
NO_FINDINGS = "NO FINDINGS"
FIELDS = ("FLAG", "REASON", "EVIDENCE", "CONFIDENCE")
CONFIDENCE = ("high", "medium", "low")

_LINE_END = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"


def occurrences(text: Column, mark: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(mark)))) / len(mark)).cast("int")


def after(text: Column, mark: str) -> Column:
    """What follows the first mark."""
    return F.substring(text, F.locate(mark, text) + len(mark), F.length(text))


def before(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def _line_name(line: Column) -> Column:
    return F.when(line.contains(":"), strip(F.substring_index(line, ":", 1)))


def _record(chunk: Column, i: Column) -> Column:
    """Struct of one record: its fields by first mention, and what is wrong with it."""
    return F.struct((i + 1).alias("record"), F.filter(
        F.transform(F.split(chunk, _LINE_END), strip), lambda x: x != "").alias("lines"))


def parse(answers: DataFrame) -> DataFrame:
    """One row per answer: status, and its chunks as (record, lines). Later steps read the chunks."""
    text = F.when(F.contains("text", F.lit(DELIMITER)), after(F.col("text"), DELIMITER)).otherwise(F.col("text"))
    df = answers.select("run", text.alias("t"))
    df = df.withColumns({"starts": occurrences(F.col("t"), START), "ends": occurrences(F.col("t"), END)})
    # The end mark is looked for after the first start mark.
    df = df.withColumn("tail", after(F.col("t"), START))
    df = df.withColumns({"body": strip(before(F.col("tail"), END)),
                         "trailing": F.when(F.contains("tail", F.lit(END)), strip(after(F.col("tail"), END))).otherwise("")})
    status = (F.when(F.col("starts") == 0, "no_block").when(F.col("ends") == 0, "unclosed")
              .when(F.col("body") == NO_FINDINGS, "explicit_none").when(F.col("body") == "", "empty").otherwise("records"))
    df = df.withColumn("status", status)
    chunks = F.transform(F.split("body", SEPARATOR), lambda c: strip(c))
    return df.withColumn("chunks", F.when(F.col("status") == "records", F.transform(chunks, _record))).select(
        "run", "status", "starts", "ends", F.length("trailing").alias("trailing"), "chunks")


def chunk_table(parsed: DataFrame) -> DataFrame:
    """One row per chunk with its four fields (first mention wins) and the counts the warnings need."""
    rows = parsed.select("run", F.inline("chunks"))
    named = F.transform("lines", lambda x: F.struct(_line_name(x).alias("name"), strip(
        F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    rows = rows.withColumn("named", named)
    known = F.filter("named", lambda s: s["name"].isin(*FIELDS))
    rows = rows.withColumns({
        "n_lines": F.size("lines"), "known": known,
        "stray": F.size("lines") - F.size(known)})

    def first(field: str) -> Column:
        return F.get(F.filter("known", lambda s: s["name"] == field), F.lit(0))["value"]

    rows = rows.withColumns({f.lower(): first(f) for f in FIELDS})
    order = F.array_distinct(F.transform("known", lambda s: s["name"]))
    return rows.select("run", "record", "n_lines", *[f.lower() for f in FIELDS], "stray",
                       (F.size("known") - F.size(order)).alias("repeated"), order.alias("order"))


def records(chunks: DataFrame) -> DataFrame:
    """The records with a usable flag."""
    return chunks.filter(F.coalesce("flag", F.lit("")) != "").select("run", "record", *[f.lower() for f in FIELDS])


def warnings(parsed: DataFrame, chunks: DataFrame, documented: DataFrame) -> DataFrame:
    """(run, record, warning): everything that departs from the format, none of it repaired. Block warnings have record 0.

    ``documented`` has one documented column name per row in ``feature``; each flag finds its name by an equi-join.
    """
    block = F.array_compact(F.array(
        F.when(F.col("status") == "no_block", "missing start marker"),
        F.when(F.col("starts") > 1, "repeated start marker"),
        F.when(F.col("status") == "unclosed", "unclosed block"),
        F.when((F.col("starts") > 0) & (F.col("ends") > 1), "repeated end marker"),
        F.when((F.col("starts") > 0) & (F.col("ends") > 0) & (F.col("trailing") > 0), "text after the end marker"),
        F.when(F.col("status") == "empty", "empty block")))
    top = parsed.select("run", F.lit(0).alias("record"), F.explode(block).alias("warning"))

    known = documented.select(F.col("feature").alias("flag")).distinct().withColumn("_doc", F.lit(True))
    whole, missing = F.lit(True), []
    for f in FIELDS:
        whole = whole & F.col(f.lower()).isNotNull()
        missing.append(F.when(F.col(f.lower()).isNull(), F.lit(f)))
    full = F.col("n_lines") > 0
    has_flag = F.coalesce("flag", F.lit("")) != ""
    # Every further mention of a field is a warning of its own.
    again = F.array_repeat(F.lit("repeated field"), F.col("repeated"))
    ahead = F.concat(again, F.array_compact(F.array(
        F.when(~full, "empty record"),
        F.when(F.col("stray") > 0, F.concat(F.lit("stray lines: "), F.col("stray"))),
        F.when(full & ~whole, F.concat(F.lit("missing fields: "), F.array_join(F.array_compact(F.array(*missing)), ", "))),
        F.when(whole & (F.col("order") != F.array(*[F.lit(f) for f in FIELDS])), "fields out of order"))))
    behind = F.array_compact(F.array(
        F.when(F.col("confidence").isNotNull() & ~F.col("confidence").isin(*CONFIDENCE), "unknown confidence"),
        F.when(full & ~has_flag, "no usable flag")))
    # What the texts have to say is settled here, so that the join moves a flag and no evidence.
    rows = chunks.select("run", "record", "flag", ahead.alias("ahead"), behind.alias("behind")).join(known, "flag", "left")
    lacking = F.array_compact(F.array(F.when(has_flag & F.col("_doc").isNull(), "undocumented flag")))
    return top.unionByName(rows.select("run", "record", F.explode(F.concat("ahead", lacking, "behind")).alias("warning")))


def shape(parsed: DataFrame, recs: DataFrame, warned: DataFrame) -> DataFrame:
    """Per answer: records, confidence counts, explicit none, warnings."""
    r = recs.groupBy("run").agg(F.count("*").alias("records"),
                                *[F.count_if(F.col("confidence") == c).alias(c) for c in CONFIDENCE])
    w = warned.groupBy("run").agg(F.count("*").alias("warning_count"))
    out = parsed.select("run", (F.col("status") == "explicit_none").alias("explicit_no_findings"))
    out = out.join(r, "run", "left").join(w, "run", "left")
    return out.fillna(0, ["records", *CONFIDENCE, "warning_count"])
