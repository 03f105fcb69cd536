"""Vector codes: parts of vectors named by the nearest entry of a codebook that is learned over all of them.

The search for the nearest entry keeps distances to a few fixed pivots. Each part's distances to its pivots are found once and
written beside the vectors. In a round only the entries have to be measured against the pivots: how much the distances of a part and
an entry to the same pivot differ is a lower bound on the distance between the two. A part tries entries in
order of their bounds, by exact whole-number distances, and stops at the first whose bound is past the nearest so far. Bounds are lowered by more
than their rounding, so no entry that could win, or win a tie, is passed over.

Sums for new entries are added up in the tasks; entries (a number fixed by parts, entries and the vectors' length) are all the driver sees.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditkit.llm.whiten import decimals, filled, matrix
from auditkit.sources.staging import materialize

PARTS, ENTRIES, ROUNDS, PIVOTS = 8, 16, 6, 3
_EPS = 8 * np.finfo(float).eps


def _fitting(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as long where squared distances between them can't overflow, else as Python integers."""
    most = max(float(np.abs(a.astype(float)).max(initial=0)) for a in arrays)
    kind = np.int64 if 4 * most * most * arrays[0].shape[-1] < 2.0**62 else object
    return [a.astype(kind) for a in arrays]


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all of ``b``."""
    a, b = _fitting(a, b)
    away = a[:, None, :] - b[None, :, :]
    return (away * away).sum(axis=2)


def spread(book: np.ndarray, pivots: int) -> np.ndarray:
    """Entries to serve as pivots: the first, then each time the one farthest from all before."""
    apart = squares(book, book).astype(float)
    chosen = [0]
    while len(chosen) < min(pivots, len(book)):
        chosen.append(int(apart[chosen].min(axis=0).argmax()))
    return book[chosen]


def nearest(part: np.ndarray, far: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of the nearest entry for each row of ``part``, ties to the lower index, and the distances evaluated.

    ``far`` holds the rows' distances to the pivots."""
    to = np.sqrt(squares(pivots, book).astype(float))
    part, book = _fitting(part, book)
    low = np.zeros((len(part), len(book)))
    for p in range(len(pivots)):
        np.maximum(low, np.abs(far[:, p:p + 1] - to[p]), out=low)
    low -= _EPS * (far.max(axis=1, initial=0)[:, None] + to.max(initial=0))
    order = np.argsort(low, axis=1, kind="stable")

    def measured(rows, entries):
        away = part[rows] - book[entries]
        return (away * away).sum(axis=1)

    rows = np.arange(len(part))
    which = order[:, 0].copy()
    best, evaluated = measured(rows, which), len(part)
    for rank in range(1, len(book)):
        entries = order[rows, rank]
        open_ = low[rows, entries] <= np.sqrt(best[rows].astype(float)) * (1 + _EPS)
        rows, entries = rows[open_], entries[open_]
        if not len(rows):
            break
        found = measured(rows, entries)
        evaluated += len(rows)
        better = (found < best[rows]) | ((found == best[rows]) & (entries < which[rows]))
        best[rows[better]], which[rows[better]] = found[better], entries[better]
    return which, best, evaluated


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> tuple[DataFrame, list]:
    """The rows (id, v longs, other columns carried along) with code, error and evaluated for v, and the codebooks by part, entry, position.

    Codebooks start from the vectors of the smallest ids, ``entries`` of them; of an id with several vectors, the smallest counts. Each round assigns
    every part to its nearest entry, ties to the lower index, then an entry becomes the floor of its parts' mean; one without parts stays. code
    has two hex digits (more for over 256 entries) a part; error is the sum of squared distances (null beyond 38 digits); evaluated counts the distances tried
    for the row's batch over its rows, a mean. Rows with v null take no part. A null id starts no entry but is coded; repeated rows count
    each time. Shorter vectors, and a length that the parts don't divide, are filled with zeros. With fewer ids there are fewer entries; without
    any, or without entries in the vectors, code is empty and error 0. Columns named v, far, code, error or evaluated may not be among the others."""
    given = rows.filter("v is not null")
    other = [c for c in rows.columns if c != "v"]
    longest = given.agg(F.max(F.size("v"))).first()[0] or 0
    length = -(-longest // parts) * parts
    given = filled(given, length, 0, "v")
    ids = [r["id"] for r in given.filter("id is not null").select("id").distinct().orderBy("id").limit(entries).collect()]
    first = sorted((r["id"], r["v"]) for r in given.filter(F.col("id").isin(ids)).groupBy("id").agg(F.min("v").alias("v")).collect()) if ids else []
    if not first or not length:
        return given.select(*other, F.lit("").alias("code"), F.lit(0).cast("decimal(38,0)").alias("error"), F.lit(0.0).alias("evaluated")), []
    books = np.array([v for _, v in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    fixed = [spread(book, pivots) for book in books]
    width = len(fixed[0])

    def measure(batches):
        for b in batches:
            if len(b):
                v = matrix(b.column("v")).reshape(len(b), parts, -1)
                far = np.concatenate([np.sqrt(squares(v[:, p], fixed[p]).astype(float)) for p in range(parts)], axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(far), pa.list_(pa.float64()))], names=[*b.schema.names, "far"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in other)
    stored = materialize(given.select(*other, "v").mapInArrow(measure, f"{fields}, v array<long>, far array<double>"), "parts")
    for _ in range(rounds):
        books = _moved(stored, books, fixed, width)

    def code(batches):
        for b in batches:
            if len(b):
                found = _assigned(b, books, fixed, width)
                error = sum(best.astype(object) for _, best, _ in found)
                digits = np.stack([which for which, _, _ in found], axis=1)
                names = np.array([f"{i:02x}" for i in range(len(books[0]))])
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in other], pa.array(["".join(r) for r in names[digits].tolist()]),
                                                  decimals(error),
                                                  pa.array(np.full(len(b), sum(n for _, _, n in found) / len(b)))], names=[*other, "code", "error", "evaluated"])

    return stored.mapInArrow(code, f"{fields}, code string, error decimal(38,0), evaluated double"), books.tolist()


def _assigned(b: pa.RecordBatch, books: np.ndarray, fixed: list, width: int) -> list[tuple]:
    v = matrix(b.column("v")).reshape(len(b), len(books), -1)
    far = matrix(b.column("far")).reshape(len(b), len(books), width)
    return [nearest(v[:, p], far[:, p], books[p], fixed[p]) for p in range(len(books))]


def _moved(stored: DataFrame, books: np.ndarray, fixed: list, width: int) -> np.ndarray:
    """The codebooks after one round over all vectors."""
    parts, entries, span = books.shape

    def work(batches):
        total, n = np.zeros(books.shape, object), np.zeros((parts, entries), np.int64)
        for b in batches:
            if len(b):
                v = matrix(b.column("v")).reshape(len(b), parts, span)
                v = v if float(np.abs(v.astype(float)).max(initial=0)) * len(b) < 2.0**62 else v.astype(object)
                for p, (which, _, _) in enumerate(_assigned(b, books, fixed, width)):
                    for e in range(entries):
                        mine = which == e
                        n[p, e] += np.count_nonzero(mine)
                        total[p, e] += v[mine, p].sum(axis=0)
        if n.any():
            p, e, i = (a.ravel() for a in np.indices(books.shape))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(i, pa.int32()),
                                              decimals(total.ravel()),
                                              pa.array(n[p, e])], names=["part", "entry", "at", "total", "n"])

    sums = stored.select("v", "far").mapInArrow(work, "part int, entry int, at int, total decimal(38,0), n long")
    sums = sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).filter("n > 0")
    new = books.copy()
    for r in sums.collect():
        new[r["part"], r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return new


def digest(books: list) -> str:
    """sha256 of all entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for part in books for entry in part for x in entry).encode()).hexdigest()
