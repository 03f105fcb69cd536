"""Token-id files: documents as coded blocks of ids, in ascending doc_id order.

A folder of token files is a Parquet table, one row for each segment: a run of whole documents with at most ``SEGMENT`` ids
(a longer document is a segment alone). A row holds its part and number, the documents' ids and lengths, and the coded
blocks of ``coder``. Parts are ranges of doc_id, segments go on inside a part, blocks are cut at every ``BLOCK`` ids of a segment. Spark's
writer commits them, so a lost executor's files are written again and never seen by half.

``read_ids`` decodes segment by segment. Where a document starts in the whole stream follows from the lengths alone:
sums within a part, and a table with one row for each part.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditkit.llm import coder, tokens
from auditkit.sources.staging import materialize

SEGMENT = 1 << 21
FILE = "part int, segment int, doc_ids array<long>, lengths array<int>, blocks array<binary>"
READ = "part int, segment int, doc_id long, local long, n_tokens long, ids binary"
_FILE_TYPES = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary())]


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int, text: str = "text") -> None:
    """Encodes whole texts, ends each with ``end_id`` and writes the files of ``folder``.

    A null text is empty. Rows without doc_id come first; rows that share one are ordered by text."""

    def work(frames):
        part, number, held = TaskContext.get().partitionId(), 0, []
        size = 0

        def row():
            ids = np.frombuffer(b"".join(c for _, c in held), "<u4")
            blocks = coder.encode([ids[i:i + coder.BLOCK] for i in range(0, len(ids), coder.BLOCK)])
            values = [[part], [number], [[d for d, _ in held]], [[len(c) // 4 for _, c in held]], [blocks]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, _FILE_TYPES)], names=[c.split()[0] for c in FILE.split(", ")])

        end = array("I", [end_id]).tobytes()
        for frame in frames:
            doc_ids = frame.column(0).to_pylist()
            for batch in tokens.batches(t.as_py() for t in frame.column(1)):
                for (i, _), coded in zip(batch, tokens.encoder(path).encode([t for _, t in batch])):
                    coded += end
                    if held and size + len(coded) // 4 > SEGMENT:
                        yield row()
                        number, held, size = number + 1, [], 0
                    held.append((doc_ids[i], coded))
                    size += len(coded) // 4
        if held:
            yield row()

    t = F.coalesce(text, F.lit(""))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("t")).repartitionByRange("doc_id", F.xxhash64("t"))
    dealt.sortWithinPartitions("doc_id", "t").mapInArrow(work, FILE).write.parquet(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian 32-bit integers) of every document, decoded from the files."""
    files = spark.read.parquet(folder)

    def work(frames):
        for frame in frames:
            for r in zip(*(c.to_pylist() for c in frame.columns)):
                part, segment, doc_ids, lengths, blocks = r
                ids = np.concatenate(coder.decode(blocks)).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                starts = (ends - lengths).tolist()
                whole = [ids[4 * s:4 * e] for s, e in zip(starts, ends.tolist())]
                for at in range(0, len(whole), 1000):
                    some = slice(at, at + 1000)
                    n = len(whole[some])
                    values = [[part] * n, [segment] * n, doc_ids[some], starts[some], lengths[some], whole[some]]
                    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names=[c.split()[0] for c in READ.split(", ")])

    sizes = files.select("part", "segment", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("segment")) - F.col("n")
    starts = sizes.select("part", "segment", within.alias("within")).join(parts, "part").select("part", "segment", (F.col("before") + F.col("within")).alias("before"))
    starts = materialize(starts, "starts")  # a row for each segment, so that its size is known to the join
    docs = files.mapInArrow(work, READ)
    return docs.join(starts, ["part", "segment"]).select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids")
