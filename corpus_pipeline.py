"""From raw documents to packed training sequences, in stages.

Each stage takes what its predecessor kept and its decision takes effect: rules and classifier drop documents, of near
copies one stays, personal data is replaced in the text, and what is left is packed. All but the last return the columns of the
documents they were given. An empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditkit.llm import discriminant, neardup, packing, pii, rules, tokens
from auditkit.sources.staging import materialize

#: Score that the classifier asks of a document.
LEAST_SCORE = 0.7
#: Words of a shingle, and percent of shingles that two near copies share.
WORDS, PERCENT = 5, 80


def _small_arrow_batches(spark: SparkSession, rows: int = 500, size: int = 4 << 20) -> None:
    """For the rest of this application's session, texts pass to Python by at most so many rows or bytes at once.

    The stages are lazy, so the setting has to hold when they run. Executors of a few GB then have room for the joins."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = str(spark.conf.get(name)).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, most)


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; those of null or empty text have no words and are among them. None come from an empty table."""
    _small_arrow_batches(spark)
    judged = rules.judge(docs, rules.language_references(docs), into="__rules")
    return judged.filter("__rules.kept").select(*docs.columns)


def keep_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the least score go. Learns from labelled rows of the raw documents: after the rules, few bad ones are left.

    A null text is scored as an empty one; without labelled rows of both classes every score is the share of good ones. An empty table stays one."""
    _small_arrow_batches(spark)
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", discriminant.features(F.col("text")).alias("x"))
    model = discriminant.fit(discriminant.labelled(raw, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return docs.filter(discriminant.score(model, discriminant.features(F.col("text"))) >= LEAST_SCORE)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of the smallest doc_id stays. Rows go by doc_id, those that repeat one by doc_id and text.

    So a doc_id that stands for different texts loses none that isn't a copy, and of rows alike in both one stays. Rows without doc_id all stay."""
    _small_arrow_batches(spark)
    linked = materialize(neardup.link(docs, size=WORDS, percent=PERCENT).filter("doc_id is not null"), "linked")
    again = materialize(linked.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    gone = linked.filter("not leads").select("doc_id").distinct()
    once = docs.join(again, "doc_id", "left_anti").join(gone, "doc_id", "left_anti").select(*docs.columns)
    keyed = docs.join(again, "doc_id", "left_semi").select(*docs.columns, neardup.sketches(F.col("text"), WORDS).alias("__k"))
    stay = linked.join(again, "doc_id", "left_semi").filter("leads").select(
        "doc_id", F.struct(F.col("n_shingles").alias("n"), "k0", "k1").alias("__key")).distinct()
    keyed = keyed.withColumn("__key", F.struct("__k.n", "__k.k0", "__k.k1")).join(stay, ["doc_id", "__key"], "left_semi")
    return once.unionByName(keyed.dropDuplicates(["doc_id", "__key"]).select(*docs.columns))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with spans replaced, and n_chars to match; a text without any stays as it is, null included."""
    model = pii.fit(docs)
    text = F.coalesce("text", F.lit(""))
    found = docs.withColumn("__base", pii.base_spans(text))
    found = found.withColumn("__spans", pii.detect(text, F.col("__base"), model))
    some = F.size("__spans") > 0
    found = found.withColumn("text", F.when(some, pii.redact(F.col("text"), F.col("__spans"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(some, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def pack_into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole texts as token ids, in as few sequences as the plan finds; a null text is its end id. No documents give no sequence."""
    _small_arrow_batches(spark)
    return packing.pack(packing.cut(docs, tokens.public_path("word_bpe_49k.json")))


STAGES = [("quality_rules", keep_by_rules), ("quality_classifier", keep_by_classifier), ("near_dedup", keep_one_of_copies),
          ("pii", replace_personal_data), ("packing", pack_into_sequences)]
#: Token ids and learned models are beyond SQL; the pipeline is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of ``sf_dir``; what passes between two stages is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
