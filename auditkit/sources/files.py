"""File sources and sinks: CSV, JSON documents, JSON lines, run directories, keyed upsert, hash manifests."""

from __future__ import annotations

import hashlib
import re
import uuid
from contextlib import contextmanager
from fnmatch import fnmatchcase
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditkit.operators.columns import CheckFailed

_BAD = "_bad_line"
#: Stores that a task reads as a stream, and the bytes it holds at once.
STREAMED, PIECE = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss"), 8 << 20


# ---------------------------------------------------------------- CSV
def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None,
             sample: float = 1.0) -> DataFrame:
    """CSV with a header. Without a schema the types come from a sample of the rows; give one for large inputs."""
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).option("samplingRatio", sample).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; null is an empty cell. An empty text reads back as null, too."""
    df.write.option("header", True).option("nullValue", "").option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)


# ---------------------------------------------------------------- JSON
def read_document(spark: SparkSession, path: str, schema: str | T.StructType | None = None,
                  lines: bool = False) -> DataFrame:
    """One JSON document per file, or per line."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_lines_strict(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """JSON lines where an unreadable line, or one without a required field, is an error; blank lines are skipped."""
    lines = (spark.read.text(path).filter(F.trim("value") != "")
             .select(F.from_json("value", f"{schema}, {_BAD} string", {"columnNameOfCorruptRecord": _BAD}).alias("r"))
             .select("r.*"))
    lacking = F.col(_BAD).isNotNull()
    for f in required:
        lacking = lacking | F.col(f).isNull()
    bad = lines.filter(lacking).agg(F.count("*")).head()[0]
    if bad:
        raise CheckFailed(f"{bad} lines of {path} cannot be read")
    return lines.drop(_BAD)


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def export_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON text with a real null for null and NaN; NaN never appears in the output."""
    floats = {c for c, t in df.dtypes if t in ("double", "float")}
    clean = [F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("json"))


# ---------------------------------------------------------------- run directories
MANIFEST = ("config_id string, mode string, mock boolean, model string, tool_layer_version string, termination string, "
            "is_usable boolean, last_stop_reason string, canary boolean, turns int, tool_calls int, "
            "dictionary_populated_field string, coverage_scopes string, retrieval string, prompt_caching boolean, "
            "max_tokens_per_turn int, usage struct<input bigint, output bigint, cache_creation bigint, cache_read bigint>, "
            "limits struct<max_turns int, max_tool_calls int>")
CALL_LOG = "calls array<struct<seq int, tool string, arguments variant, ok boolean, outcome string>>"
LAYOUT = {"manifest": "*/manifest.json", "calls": "*/tool_call_log.json", "messages": "*/messages.json",
          "answers": "*/final_answer.txt"}
# A message's content is plain text or a list of typed blocks, so it is read as a variant.
MESSAGES = "messages array<struct<role string, content variant>>"


def write_directories(df: DataFrame, path: str) -> None:
    """Lines (dir, stretch, value) below ``path``: a folder dir=... for each directory, with one text file for each of its stretches.

    Spark's own partitioned writer starts a process for each file where Hadoop has no native library, and moves all folders again one by one; here
    each file is streamed by its task and gets its name when it is whole, so a task that runs twice leaves the same files. A store that Arrow has no
    file system for is written by Spark."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(F.col("dir").cast("string").alias("dir"), F.col("stretch").cast("long").alias("stretch"), F.col("value")).repartition(tasks, "dir", "stretch")
    root = _qualified(df.sparkSession, path)
    if root.split(":", 1)[0] not in STREAMED:
        return dealt.drop("stretch").write.partitionBy("dir").text(path)

    def work(batches):
        store, base = _store(root)
        at, stream, part, whole, files = None, None, None, None, 0

        def close():
            stream.close()
            if store.get_file_info(whole).type.name == "File":  # of an earlier try; not every store moves over a file
                store.delete_file(whole)
            store.move(part, whole)

        for b in batches:
            for name, stretch, line in zip(*(c.to_pylist() for c in b.columns)):
                if at != (name, stretch):
                    if stream:
                        close()
                    at, files = (name, stretch), files + 1
                    folder = f"{base}/dir={'__HIVE_DEFAULT_PARTITION__' if name is None else quote(name, safe=' ')}"
                    store.create_dir(folder, recursive=True)
                    whole = f"{folder}/part-{stretch:05d}.txt"
                    part = f"{whole}.{uuid.uuid4().hex[:12]}.tmp"
                    stream = store.open_output_stream(part)
                stream.write(((line or "") + "\n").encode())
        if stream:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    dealt.sortWithinPartitions("dir", "stretch").mapInArrow(work, "files long").agg(F.sum("files")).collect()


@contextmanager
def _few_listing_tasks(spark: SparkSession):
    """Spark lists many folders by a job of up to 10,000 tasks, each of which takes longer than its folder; a few for each core do."""
    key, cores = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.sparkContext.defaultParallelism
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 4 * cores)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _with_run(df: DataFrame) -> DataFrame:
    """The run is named by the directory its file lies in."""
    return df.withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def read_runs(spark: SparkSession, root: str, layout: dict[str, str] | None = None,
              line_documents: bool = False) -> dict[str, DataFrame]:
    """Tables runs, calls, messages, blocks and answers over all run directories below ``root``.

    A record file is one document; with ``line_documents`` it is one small document per line.
    """
    at = {k: f"{root}/{p}" for k, p in {**LAYOUT, **(layout or {})}.items()}
    with _few_listing_tasks(spark):
        return _read_runs(spark, at, line_documents)


def _read_runs(spark: SparkSession, at: dict[str, str], line_documents: bool) -> dict[str, DataFrame]:
    runs = _with_run(read_document(spark, at["manifest"], MANIFEST, line_documents))
    calls = (_with_run(read_document(spark, at["calls"], CALL_LOG, line_documents))
             .select("run", F.inline("calls")).withColumn("arguments", F.to_json("arguments")))
    messages = (_with_run(read_document(spark, at["messages"], MESSAGES, line_documents))
                .select("run", F.posexplode("messages").alias("turn", "m"))
                .select("run", "turn", F.col("m.role").alias("role"), F.col("m.content").alias("content")))
    block = "array<struct<type string, id string, name string, tool_use_id string, content string>>"
    blocks = (messages.filter(F.schema_of_variant("content").startswith("ARRAY"))
              .select("run", "turn", "role", F.posexplode(F.from_json(F.to_json("content"), block)).alias("pos", "b"))
              .select("run", "turn", "role", "pos", "b.*"))
    answers = _with_run(spark.read.text(at["answers"], wholetext=True)).select("run", F.col("value").alias("text"))
    return {"runs": runs, "calls": calls, "messages": messages.withColumn("content", F.to_json("content")),
            "blocks": blocks, "answers": answers}


# ---------------------------------------------------------------- upsert, manifests
def upsert(base: DataFrame, updates: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """New rows replace rows of the same key and never duplicate them.

    ``order`` names a column of the batch that tells which of its rows for one key is the last; without it, two
    different rows for one key are an error.
    """
    rows = updates.groupBy(key).agg(*([F.max_by(F.struct(*updates.columns), order).alias("r")] if order else
                                      [F.max(F.struct(*updates.columns)).alias("r"), F.min(F.struct(*updates.columns)).alias("other")]))
    if not order:
        clash = F.raise_error(F.concat(F.lit("two rows of a batch for key "), F.col(key).cast("string")))
        rows = rows.withColumn("r", F.when(F.col("r").eqNullSafe(F.col("other")), F.col("r")).otherwise(clash))
    updates = rows.select("r.*")
    return base.join(updates.select(key), key, "left_anti").unionByName(updates)


def _plain(uri: str) -> str:
    """A uri with one slash after its scheme, as Hadoop spells paths."""
    return re.sub("^([^/:]+):/+", r"\1:/", uri)


def _qualified(spark: SparkSession, path: str) -> str:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return _plain(folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toString()).rstrip("/")


def _store(uri: str):
    """Arrow's file system of a plain uri, and the path in it."""
    from pyarrow.fs import FileSystem, LocalFileSystem
    local = re.match("file:/+", uri)
    if local:
        return LocalFileSystem(), "/" + uri[local.end():]
    return FileSystem.from_uri(quote(uri.replace(":/", "://", 1), safe=":/"))


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, sha256) of every file in a folder, of any size, empty ones included. A table kept as a folder of files is one entry: the
    digest of its files' names and digests in the order of their names.

    Spark lists the files and deals them out; each is read in its task as a stream, ``PIECE`` bytes at a time. A store that Arrow
    has no file system for is read by Spark instead, where a file has to fit into a cell of 2 GB."""
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = _qualified(spark, path) + "/"
    uris = [_plain(unquote(u)) for u in scan.inputFiles()]  # the list that Spark's own file index holds
    uris = [u for u in uris if fnmatchcase(u[len(root):].split("/", 1)[0], pattern)]
    listed = spark.createDataFrame([(u[len(root):], u) for u in uris], "name string, uri string")
    if any(u.split(":", 1)[0] not in STREAMED for u in uris):
        whole = scan.select(F.regexp_replace("path", "^([^/:]+):/+", "$1:/").alias("uri"), F.sha2("content", 256).alias("sha256"))
        return _entries(listed.join(whole, "uri", "left").select("name", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("sha256")))  # scans skip empty files

    def work(batches):
        for b in batches:
            found = []
            for uri in b.column(1).to_pylist():
                store, at = _store(uri)
                digest = hashlib.sha256()
                with store.open_input_stream(at, buffer_size=0) as stream:
                    while piece := stream.read(PIECE):
                        digest.update(piece)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=["name", "sha256"])

    return _entries(listed.repartition(max(1, min(len(uris), 1_000))).mapInArrow(work, "name string, sha256 string"))


def _entries(files: DataFrame) -> DataFrame:
    """(name, sha256) of files to one row for each file or folder at the top; a folder's group holds a line for each of its files."""
    line = F.concat("name", F.lit("\n"), "sha256", F.lit("\n"))
    per = files.groupBy(F.substring_index("name", "/", 1).alias("file")).agg(
        F.max(F.when(~F.contains("name", F.lit("/")), F.col("sha256"))).alias("own"), F.sort_array(F.collect_list(line)).alias("lines"))
    return per.select("file", F.coalesce("own", F.sha2(F.array_join("lines", ""), 256)).alias("sha256"))


def compare_hashes(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each file of the manifest is ok, changed or missing; a file it does not list is unlisted."""
    both = current.alias("c").join(manifest.alias("m"), "file", "full_outer")
    status = (F.when(F.col("c.sha256").isNull(), "missing").when(F.col("m.sha256").isNull(), "unlisted")
              .when(F.col("c.sha256") == F.col("m.sha256"), "ok").otherwise("changed"))
    return both.select("file", status.alias("status"))
