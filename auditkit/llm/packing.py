"""Best-fit packing planned on a histogram of lengths.

``cut`` encodes documents and cuts those above the limit into pieces. ``plan_slots`` runs best-fit decreasing over the
histogram: at most ``size`` lengths, whatever the number of documents. Pieces of one length are alike, so a plan
entry says that ranks lo up to hi of a length fill, ``per`` to a sequence, the sequences from ``first`` on at ``offset``.
``pack`` gives every piece its rank within its length and joins it with the entry that holds this rank.

Ranks need no ordering of a whole length in one task: a task numbers its own pieces of a length while it encodes, and
a small table of (task, length) counts says how many come before.

The plan has a proven bound. A length changes at most two groups of open sequences only partly and adds at most two, so
there are under 4 * size groups; a group that takes a length keeps less than half its room, so it is used at most
log2(size) times. For size 4096 that is under 200,000 entries, so the plan is small enough to broadcast at any scale.
"""

from __future__ import annotations

from array import array
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditkit.llm import tokens
from auditkit.sources.staging import materialize

SIZE = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, task_rank long"
ENTRY = "length long, lo long, hi long, first long, per long, offset long"


def cut(docs: DataFrame, path: str, end_id: int = 1, size: int = SIZE, text: str = "text") -> DataFrame:
    """A row for each piece of each document: the ids of its whole text, then the end id, ``size`` ids to a piece.

    A null or empty text is the end id alone. Repeated documents are packed once for each row; a null doc_id stays null.
    Written before it is used, so that a piece's task and rank stay what they are."""

    def work(frames):
        seen: dict[int, int] = {}
        task, end, width = TaskContext.get().partitionId(), array("I", [end_id]).tobytes(), 4 * size
        for frame in frames:
            ids = frame.column(0).to_pylist()
            for part in tokens.batches(t.as_py() for t in frame.column(1)):
                rows = []
                for (i, _), coded in zip(part, tokens.encoder(path).encode([t for _, t in part])):
                    coded += end
                    for k, at in enumerate(range(0, len(coded), width)):
                        piece = coded[at:at + width]
                        n = len(piece) // 4
                        rank = seen.get(n, 0)
                        seen[n] = rank + 1
                        rows.append((ids[i], k, at // 4, n, tokens.crc(piece), task, rank))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_NAMES)

    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, PIECES), "pieces")


_NAMES = [c.split()[0] for c in PIECES.split(", ")]
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def plan_slots(histogram: dict[int, int], size: int = SIZE) -> list[tuple]:
    """Entries (length, lo, hi, first, per, offset) that place ``histogram[length]`` pieces of every length."""
    groups: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges (first sequence, sequences)
    rooms: list[int] = []  # a heap of the rooms in groups that hold for the current length
    entries, fresh = [], 0
    for length in sorted(histogram, reverse=True):
        left, lo = histogram[length], 0
        rooms = [r for r in groups if r >= length]
        rooms.sort()
        while left:
            if rooms:
                room = rooms[0]
                first, count = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    heappop(rooms)
            else:
                per = size // length
                room, first, count = size, fresh, -(-left // per)
                fresh += count
            per = room // length
            full = min(count, left // per)
            if full:
                entries.append((length, lo, lo + full * per, first, per, size - room))
                lo, left = lo + full * per, left - full * per
                _put(groups, rooms, room - per * length, first, full, length)
            if full < count:
                if left:
                    entries.append((length, lo, lo + left, first + full, left, size - room))
                    _put(groups, rooms, room - left * length, first + full, 1, length)
                    full, left = full + 1, 0
                if full < count:
                    _put(groups, rooms, room, first + full, count - full, length)
    return entries


def _put(groups, rooms, room, first, count, length):
    if room and room not in groups:
        groups[room] = []
        if room >= length:
            heappush(rooms, room)
    if room:
        groups[room].append((first, count))


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` of ``cut`` with sequence_id and offset. An empty table packs into no sequence."""
    spark = pieces.sparkSession
    by_task = materialize(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(plan_slots(histogram, size), ENTRY)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    ranked = pieces.join(by_task.select("task", "length", before.alias("before")), ["task", "length"]).withColumn(
        "rank", F.col("task_rank") + F.col("before")).alias("p")
    p, e = ranked, F.broadcast(plan).alias("e")
    here = (F.col("p.length") == F.col("e.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    at = F.col("rank") - F.col("lo")
    return p.join(e, here).select(
        "doc_id", "piece", "start", F.col("p.length").alias("length"), "ids_crc32",
        (F.col("first") + F.floor(at / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("offset") + (at % F.col("per")) * F.col("p.length")).cast("long").alias("offset"))
