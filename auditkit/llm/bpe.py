"""Byte-level BPE by a file of ranks.

``encode_folded`` does it with Spark's higher-order functions. A task gathers documents into segments of about ``SEGMENT``
characters and lists the distinct words of each: matches of the split pattern, as strings of one character for each byte. A
segment's row has its words, and for each document the numbers of its words. Everything after that is DataFrame functions inside
the row, without a shuffle:

* a fold over the bytes of a distinct word merges, again and again, the leftmost adjacent pair of lowest rank;
* ranks come from a literal map. Spark searches a map from end to end, so it is dealt into ``SLOTS`` small maps by crc32;
* the documents' ids are their words' ids, one after another.

A word of more than ``LONG`` bytes would take a fold of that many steps over arrays of that length. Such words are merged in the task by
the same rule with a heap, in n log n, and come with their pieces; the fold leaves them as they are.

``encode`` gives the same ids from the same merges of distinct words, done in the task: higher-order functions are interpreted, and
the fold takes about ten times the CPU time that large corpora allow for (figures in the README).

``decode`` concatenates the byte pieces of ids, from a literal array.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditkit.llm.tokens import STORE, Encoder, batches, encoder

SEGMENT, SLOTS, LONG = 8_000_000, 1 << 14, 64
_ROW = "doc_ids array<long>, words array<struct<bytes:string,pieces:array<string>>>, numbers array<array<int>>"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, f.read().split(b"\n")))}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Pieces of a word by lowest rank first, leftmost among equals."""
    if word in ranks:
        return [word]
    piece = [word[i:i + 1] for i in range(len(word))]
    left, right = list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
    heap = []

    def offer(i):
        if i >= 0 and right[i] < len(word):
            both = piece[i] + piece[right[i]]
            if both in ranks:
                heapq.heappush(heap, (ranks[both], i, both))

    for i in range(len(word)):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        if piece[i] is None or right[i] >= len(word) or piece[i] + piece[right[i]] != both:
            continue
        j = right[i]
        piece[i], piece[j], right[i] = both, None, right[j]
        if right[j] < len(word):
            left[right[j]] = i
        offer(left[i])
        offer(i)
    return [p for p in piece if p is not None]


def _segments(path: str, pattern: str):
    """The task's side: documents to segments."""

    def row(docs, words, ranks):
        listed = [w.encode("utf-8", "surrogatepass") for w in words]
        shown = pa.StructArray.from_arrays(
            [pa.array([w.decode("latin-1") for w in listed], pa.string()),
             pa.array([[p.decode("latin-1") for p in merged(w, ranks)] if len(w) > LONG else None for w in listed], pa.list_(pa.string()))], ["bytes", "pieces"])
        sizes = np.array([0, *(len(n) // 4 for _, n in docs)]).cumsum()
        numbers = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.frombuffer(b"".join(n for _, n in docs), np.int32)))
        whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays([whole(pa.array([d for d, _ in docs], pa.int64())), whole(shown), whole(numbers)],
                                          names=["doc_ids", "words", "numbers"])

    def work(frames):
        ranks, find = read_ranks(path), regex.compile(pattern).findall
        docs, words, chunks, size = [], {}, {}, 0
        for frame in frames:
            ids = frame.column(0).to_pylist()
            for batch in batches(t.as_py() for t in frame.column(1)):
                for i, text in batch:
                    cut = Encoder._chunks(text)
                    for c in set(cut).difference(chunks):
                        chunks[c] = np.array([words.setdefault(w, len(words)) for w in find(c)], np.int32).tobytes()
                    docs.append((ids[i], b"".join(map(chunks.__getitem__, cut))))
                    size += len(text)
                    if size >= SEGMENT:
                        yield row(docs, words, ranks)
                        docs, words, chunks, size = [], {}, {}, 0
        if docs:
            yield row(docs, words, ranks)

    return work


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rank_lookup(ranks: dict[bytes, int]) -> Callable[[Column], Column]:
    """Rank of a byte string or null, from a literal map in slots."""
    slots: list[dict] = [{} for _ in range(SLOTS)]
    for token, rank in ranks.items():
        key = token.decode("latin-1")
        slots[zlib.crc32(key.encode()) % SLOTS][key] = rank
    table = F.from_json(F.lit(json.dumps(slots)), "array<map<string,int>>")
    return lambda x: F.try_element_at(F.get(table, (F.crc32(x.cast("binary")) % SLOTS).cast("int")), x)


def fold_word(word: Column, rank: Callable[[Column], Column]) -> Column:
    """Ids of a word (bytes, pieces)."""

    def merge(acc, _):
        p, r = acc["p"], acc["r"]

        def at_least(at):
            joined = F.concat(F.slice(p, F.lit(1), at - 1), F.array(F.concat(F.get(p, at - 1), F.get(p, at))), F.slice(p, at + 2, F.size(p)))

            def ranked(q):
                pair = lambda i: F.array(rank(F.concat(F.get(q, i), F.get(q, i + 1))))
                before = F.when(at > 1, F.concat(F.slice(r, F.lit(1), F.greatest(at - 2, F.lit(0))), pair(at - 2))).otherwise(F.slice(r, F.lit(1), F.lit(0)))
                return F.struct(q.alias("p"), F.concat(before, pair(at - 1), F.slice(r, at + 2, F.size(r))).alias("r"))

            return _let(joined, ranked)

        lowest = F.array_min(r)
        return F.when(lowest.isNull(), acc).otherwise(_let(F.array_position(r, lowest).cast("int"), at_least))

    def fold(start):
        pairs = F.zip_with(start, F.slice(start, F.lit(2), F.size(start)), lambda a, b: rank(F.concat(a, b)))
        steps = F.sequence(F.lit(1), F.greatest(F.size(start) - 1, F.lit(1)))
        done = F.aggregate(steps, F.struct(start.alias("p"), pairs.alias("r")), merge, lambda acc: acc["p"])
        return F.transform(done, rank)

    ready = F.transform(word["pieces"], rank)
    whole = rank(word["bytes"])
    return F.when(word["pieces"].isNotNull(), ready).when(whole.isNotNull(), F.array(whole)).otherwise(_let(F.split(word["bytes"], ""), fold))


class RankEncoder(Encoder):
    """Chunks to ids by ranks; a worker remembers the words it has merged."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.find = read_ranks(path), regex.compile(pattern).findall
        self.ids, self.words, self.caseless = {}, {}, False

    def _fresh(self, chunks: list[str]) -> list[bytes]:
        return [b"".join(map(self._word, self.find(c))) for c in chunks]

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = np.array([self.ranks[p] for p in merged(word.encode("utf-8", "surrogatepass"), self.ranks)], np.int32).tobytes()
            if len(self.words) < STORE // 4:
                self.words[word] = ids
        return ids


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """doc_id and ids of every row's whole text, by the ranks of ``path``. A null or empty text has no ids."""

    def work(frames):
        coder = encoder(path, pattern, make=RankEncoder)
        for frame in frames:
            doc_ids = frame.column(0).to_pylist()
            for batch in batches(t.as_py() for t in frame.column(1)):
                coded = coder.encode([t for _, t in batch])
                ends = np.array([0, *map(len, coded)]).cumsum() // 4
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([doc_ids[i] for i, _ in batch], pa.int64()), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("t")).mapInArrow(work, "doc_id long, ids array<int>")


def encode_folded(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The same as ``encode``, by a fold of higher-order functions over the distinct words of a segment."""
    segments = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("t")).mapInArrow(_segments(path, pattern), _ROW)
    rank = rank_lookup(read_ranks(path))
    by_word = F.transform("words", lambda w: fold_word(w, rank))
    by_doc = _let(by_word, lambda w: F.transform("numbers", lambda n: F.flatten(F.transform(n, lambda i: F.get(w, i)))))
    return segments.select(F.explode(F.arrays_zip(F.col("doc_ids").alias("doc_id"), by_doc.alias("ids"))).alias("d")).select("d.doc_id", "d.ids")


def decode(ids: Column, path: str) -> Column:
    """The bytes behind an array of ids."""
    pieces = [b.hex() for b, _ in sorted(read_ranks(path).items(), key=lambda x: x[1])]
    table = F.split(F.lit(",".join(pieces)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))
