"""Queries: sources and sinks. Each writes a table derived from the inputs to shared storage and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from auditkit.operators import columns
from auditkit.plans.registry import query
from auditkit.sources import files
from auditkit.sources.staging import shared_dir

LEDGER = "event_id bigint, label string, model string, cost_usd double"


def _path(v, name: str) -> str:
    return f"{shared_dir(v.spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query("src_01_csv_schema")
def csv_schema(v):
    path = _path(v, "orders-csv")
    files.write_csv(v.table("orders"), path)
    return columns.schema_report(files.read_csv(v.spark, path, sample=0.5))


@query("src_02_csv_pruned", "SELECT c_custkey, c_acctbal FROM customer")
def csv_pruned(v):
    path = _path(v, "customer-csv")
    df = v.table("customer")
    files.write_csv(df, path)
    return files.read_csv(v.spark, path, df.schema).select("c_custkey", "c_acctbal")


@query("src_03_parquet_projection", "SELECT o_orderkey, o_totalprice FROM orders")
def parquet_projection(v):
    return v.table("orders").select("o_orderkey", "o_totalprice")


@query("src_04_parquet_sink", "SELECT vintage, count(*) AS n, sum(label)::BIGINT AS bad FROM loans WHERE split = 'train' GROUP BY vintage",
       ("loans",))
def parquet_sink(v):
    path = _path(v, "train")
    train = v.loans().filter(F.col("split") == "train")
    train.write.partitionBy("vintage").parquet(path)
    return v.spark.read.schema(train.schema).parquet(path).groupBy("vintage").agg(
        F.count("*").alias("n"), F.sum("label").cast("long").alias("bad"))


@query("src_05_csv_sink", """
  SELECT row_id, acctbal, mths_since_prev, first_ship_d FROM loans""", ("loans",))
def csv_sink(v):
    path = _path(v, "loans-csv")
    df = v.loans().select("row_id", "acctbal", "mths_since_prev", "first_ship_d")
    files.write_csv(df, path)
    return files.read_csv(v.spark, path, df.schema)


@query("src_06_json_document", """
  SELECT round(sum(1 - label)::DOUBLE / sum(label), 9) AS scale_pos_weight, CAST(max(vintage) AS BIGINT) AS last_vintage
  FROM loans WHERE split = 'train'""", ("loans",))
def json_document(v):
    path = _path(v, "params")
    doc = v.loans().filter(F.col("split") == "train").agg(
        (F.sum(1 - F.col("label")) / F.sum("label")).alias("scale"), F.max("vintage").alias("last"))
    doc.select(F.to_json(F.struct(F.struct(F.col("scale").alias("scale_pos_weight")).alias("best_params"), "last"),
                         {"pretty": "true"}).alias("value")).coalesce(1).write.text(path)
    got = files.read_document(v.spark, path, "best_params struct<scale_pos_weight double>, last bigint")
    return got.select(F.round("best_params.scale_pos_weight", 9).alias("scale_pos_weight"), F.col("last").alias("last_vintage"))


@query("src_07_run_directories", """
  SELECT CAST(r.run AS VARCHAR) AS run, r.config_id, r.canary, r.tool_calls, c.logged, c.rejected, c.last_seq, m.blocks
  FROM runs r JOIN (SELECT run, count(*) AS logged, count(*) FILTER (NOT ok) AS rejected, max(seq) AS last_seq
                    FROM calls GROUP BY run) c ON c.run = r.run
  JOIN (SELECT run, count(*) AS blocks FROM results_src GROUP BY run) m ON m.run = r.run""", ("runs", "calls", "results_src"))
def run_directories(v):
    root = _path(v, "runs")

    def put(df, kind, doc, at=F.lit(0)):
        # One file per directory and stretch of rows, so that a very large run is split over tasks.
        files.write_directories(df.select(F.col("run").alias("dir"), doc.alias("value"), F.floor(at / 100_000).alias("stretch")), f"{root}/{kind}")

    skip_null = {"ignoreNullFields": "true"}
    put(v.runs(), "manifest", F.to_json(F.struct("config_id", "mode", "canary", "is_usable", "tool_calls", "turns"), skip_null))
    # One small document per line, so that a run with very many calls is never one row.
    call = F.struct("seq", "tool", F.parse_json("arguments").alias("arguments"), "ok", "outcome")
    put(v.calls(), "calls", F.to_json(F.struct(F.array(call).alias("calls"))), F.col("seq"))
    block = F.struct(F.lit("tool_result").alias("type"), F.col("pos").cast("string").alias("tool_use_id"), "content")
    put(v.results(), "messages", F.to_json(F.struct(F.array(F.struct(
        F.lit("user").alias("role"), F.array(block).alias("content"))).alias("messages"))), F.col("pos"))
    put(v.runs(), "answers", F.concat(F.lit("run "), F.col("run")))
    got = files.read_runs(v.spark, root, {k: f"{k}/*/*.txt" for k in files.LAYOUT}, line_documents=True)
    logged = got["calls"].groupBy("run").agg(F.count("*").alias("logged"), F.count_if(~F.col("ok")).alias("rejected"),
                                             F.max("seq").cast("long").alias("last_seq"))
    blocks = got["blocks"].filter(F.col("type") == "tool_result").groupBy("run").agg(F.count("*").alias("blocks"))
    return (got["runs"].select("run", "config_id", "canary", F.col("tool_calls").cast("long").alias("tool_calls"))
            .join(got["answers"].select("run"), "run").join(logged, "run").join(blocks, "run")
            .withColumn("run", F.regexp_replace("run", "^dir=", "")))


def _ledger(v):
    return v.table("events").select("event_id", F.col("event_type").alias("label"), F.lit("model-a").alias("model"),
                                    F.round(F.col("value") / 1000, 6).alias("cost_usd"))


@query("src_08_strict_lines", """
  SELECT event_type AS label, count(*) AS n, round(sum(round(value / 1000, 6)), 6) AS spent FROM events GROUP BY 1""")
def strict_lines(v):
    path = _path(v, "ledger")
    _ledger(v).select(F.concat(F.to_json(F.struct("*")), F.lit("\n"))).write.text(path)  # a blank line after every entry
    got = files.read_lines_strict(v.spark, path, LEDGER, ("cost_usd",))
    return got.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("cost_usd"), 6).alias("spent"))


@query("src_09_append_lines", """
  SELECT event_type AS label, 2 * count(*) AS n FROM events GROUP BY 1""")
def append_lines(v):
    path = _path(v, "ledger")
    files.append_lines(_ledger(v), path)
    files.append_lines(_ledger(v), path)
    return files.read_lines_strict(v.spark, path, LEDGER).groupBy("label").agg(F.count("*").alias("n"))


@query("src_10_export_nulls", "SELECT row_id, acctbal, late_tax FROM loans", ("loans",))
def export_nulls(v):
    path = _path(v, "export")
    df = v.loans().select("row_id", F.coalesce("acctbal", F.lit(float("nan"))).alias("acctbal"), "late_tax")
    files.export_rows(df).write.text(path)
    return v.spark.read.schema("row_id long, acctbal double, late_tax double").json(path)


@query("src_11_upsert", """
  SELECT doc_id, source, CASE WHEN doc_id % 10 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents
  UNION ALL SELECT doc_id + 100000000000, 'new', n_chars FROM documents WHERE doc_id % 10 = 0""")
def upsert(v):
    base = v.table("documents").select("doc_id", "source", "n_chars")
    tenth = base.filter(F.col("doc_id") % 10 == 0)
    batch = tenth.withColumn("n_chars", F.col("n_chars") + 1).unionByName(
        tenth.withColumns({"doc_id": F.col("doc_id") + 100000000000, "source": F.lit("new")}))
    return files.upsert(base, batch, "doc_id")


_FILES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


@query("src_12_hash_manifest", f"""
  SELECT t || '.parquet' AS file, CASE WHEN t = 'region' THEN 'changed' WHEN t IN ('pages', 'part') THEN 'unlisted' WHEN t = 'parts' THEN 'missing' ELSE 'ok' END AS status
  FROM (SELECT unnest({[*_FILES, 'parts']!r}) AS t)""")
def hash_manifest(v):
    now = files.file_hashes(v.spark, v.dir, "*.parquet")
    stored = (now.filter(F.col("file") != "pages.parquet")
              .withColumn("sha256", F.when(F.col("file") == "region.parquet", F.lit("0" * 64)).otherwise(F.col("sha256")))
              .withColumn("file", F.when(F.col("file") == "part.parquet", "parts.parquet").otherwise(F.col("file"))))
    return files.compare_hashes(now, stored)


@query("src_13_feature_count", "SELECT count(DISTINCT feature) AS n_features FROM shap", ("shap",))
def feature_count(v):
    wide = v.attributions_wide()
    return v.spark.createDataFrame([(columns.feature_count(wide),)], "n_features long")
