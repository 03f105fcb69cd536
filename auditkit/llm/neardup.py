"""Near-duplicate documents by one-permutation MinHash with optimal densification.

``sketches`` hashes the distinct word shingles of a whole text once. The top bits of a hash choose one of ``BINS`` bins and
each bin keeps its smallest hash. An empty bin borrows from the first filled one in an order of its own, drawn
at random but the same for all documents (optimal densification). ``BANDS`` groups of bins give bucket keys.

Documents with equal sets are one class and go on as one row with a number of its own. Inside a bucket, candidates are a star: a centre
against all others, so a bucket of m members has m - 1 pairs. The centre is the member with the smallest share of shingles
that no other candidate has, since that is the one nearest to what a group was copied from. Links are confirmed on the full
shingle sets, and linked classes become components.

A star can miss a link between two members that are both far from its centre. So buckets whose members are not all in one
component go on: in later rounds 16, 64, 256, ... further centres of a bucket meet the rest, except pairs in one
component already, until each member of each such bucket has been a centre. Never compared are pairs that sizes rule out, or
128-bit sketches (of two sets of ``SKETCHED`` shingles or more, by over six standard deviations), or a count does exactly: shingles that no other candidate has can't be
common, so the others bound the intersection; and in the later rounds, each bit that a set's bitmap has and the other's lacks is a shingle
that they don't share. So rows at the edge of a group of copies meet few others. No bucket, group or number of candidates has a cap.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditkit.llm import tokens
from auditkit.sources.staging import materialize

BINS, BANDS = 128, 32
ROWS = BINS // BANDS
#: Shingles from which on a sketch may rule a pair out. Sets of fewer leave bins empty, and bins that borrow the same value agree or
#: differ together, so the bits of such a sketch are not independent.
SKETCHED = 512
#: Bits of the bitmap of a set. It bounds an intersection exactly at any size, best for sets of fewer shingles.
BITS = 2048
#: Centres of a bucket in the first round after the star, and how that number grows.
CENTRES, GROWTH = 16, 4
_WORDS_KEPT = 1 << 17

_LONG = T.LongType()
SKETCH = T.StructType([T.StructField("n", _LONG), T.StructField("k0", _LONG), T.StructField("k1", _LONG),
                       T.StructField("bands", T.ArrayType(_LONG)), T.StructField("s0", _LONG), T.StructField("s1", _LONG)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_draw = np.random.default_rng(20)
_ORDERS = np.argsort(np.argsort(_draw.random((BINS, BINS)), axis=1), axis=1)  # place of bin j in bin i's own order
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 7)
_BAND_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
_ODD = mix(np.arange(101, 133, dtype=np.uint64)) | np.uint64(1)


@contextmanager
def _small_batches(spark: SparkSession, rows: int = 500):
    """Whole texts and their shingle sets pass between Spark and Python by at most ``rows`` at once; the setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _WordHashes(dict):
    def __missing__(self, word):
        if len(self) >= _WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles, A-Z lowered; one for a text of fewer words, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(size, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        total = mix(total + h[i:len(h) - width + 1 + i] * _ODD[i % len(_ODD)])
    return np.unique(total)


def sketch(hashes: np.ndarray) -> tuple:
    """Set size, a 128-bit key of the set, band keys and a 128-bit similarity sketch."""
    signed = lambda x: x.astype(np.uint64).view(np.int64)
    if not len(hashes):
        return 0, 0, 0, [], 0, 0
    keys = set_key(hashes)
    first = np.searchsorted(hashes, _EDGES)
    filled = np.flatnonzero(np.diff(np.append(first, len(hashes))))
    source = np.arange(BINS)
    if len(filled) < BINS:
        empty = np.setdiff1d(source, filled, assume_unique=True)
        source[empty] = filled[_ORDERS[np.ix_(empty, filled)].argmin(axis=1)]
    values = mix(hashes[first[source]])
    rows = values.reshape(BANDS, ROWS)
    band = _BAND_SALT.copy()
    for i in range(ROWS):
        band = mix(band + rows[:, i] * _ODD[i])
    bits = np.packbits((values & np.uint64(1)).astype(np.uint8)).view(np.int64).tolist()
    return len(hashes), *keys, signed(band).tolist(), *bits


def sketches(text: Column, size: int) -> Column:
    @F.arrow_udf(SKETCH)
    def run(texts: pa.Array) -> pa.Array:
        tokens.forget()
        columns = list(zip(*[sketch(shingles(t.as_py(), size)) for t in texts])) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], SKETCH.names)

    return run(text)


def set_key(hashes: np.ndarray) -> list[int]:
    """A 128-bit key of a set, as two longs."""
    return np.array([mix(hashes).sum(dtype=np.uint64), mix(hashes ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)]).view(np.int64).tolist()


SET = T.StructType([T.StructField("set", T.ArrayType(_LONG)), T.StructField("k0", _LONG), T.StructField("k1", _LONG)])


def full_sets(text: Column, size: int) -> Column:
    @F.arrow_udf(SET)
    def run(texts: pa.Array) -> pa.Array:
        sets = [shingles(t.as_py(), size) for t in texts]
        keys = [set_key(s) for s in sets]
        return pa.StructArray.from_arrays([pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                                           *[pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)]], SET.names)

    return run(text)


@F.arrow_udf(T.ArrayType(_LONG))
def bitmaps(sets: pa.Array) -> pa.Array:
    rows = []
    for s in sets:
        bits = np.zeros(BITS, np.uint8)
        bits[s.values.to_numpy().view(np.uint64) % np.uint64(BITS)] = 1
        rows.append(np.packbits(bits).view(np.int64))
    return pa.array(rows, pa.list_(pa.int64()))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b): the smallest id that it is connected with.

    Each node points to its smallest neighbour, pointers are followed to their ends, and the graph shrinks to the ends; this
    repeats until no edge is left. Every step is a join or an aggregation and is written, whatever the shape of the graph."""
    edges = materialize(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("to")))
        points = materialize(both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("to")), "points")
        while True:
            ends = points.select(F.col("id").alias("to"), F.col("to").alias("further"))
            stepped = materialize(points.join(ends, "to").select("id", F.col("further").alias("to"), (F.col("further") < F.col("to")).alias("moved")), "points")
            points = stepped.select("id", "to")
            if stepped.filter("moved").isEmpty():
                break
        new = points.withColumnRenamed("to", "component")
        if labels is None:
            labels = new
        else:
            by = new.select(F.col("id").alias("component"), F.col("component").alias("end"))
            labels = materialize(labels.join(by, "component", "left").select("id", F.coalesce("end", "component").alias("component")), "labels")
        a, b = (new.select(F.col("id").alias(c), F.col("component").alias(f"{c}_end")) for c in ("a", "b"))
        edges = materialize(edges.join(a, "a").join(b, "b").filter("a_end <> b_end")
                            .select(F.least("a_end", "b_end").alias("a"), F.greatest("a_end", "b_end").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels


def _possible(c: str, r: str, percent: int) -> Column:
    """Whether sizes, shared shingles and sketches allow ``percent`` similarity. At 80 % the sketch of a large set agrees in 115 of 128 bits, give or take 3.4."""
    s = percent / 100
    least = int(BINS * (1 + s) / 2 - 6.5 * (BINS * (1 - s * s)) ** 0.5 / 2)
    x = lambda side, name: F.col(f"{side}.{name}")
    size = F.least(x(c, "n"), x(r, "n")) * 100 >= F.greatest(x(c, "n"), x(r, "n")) * percent
    differ = sum((F.bit_count(x(c, k).bitwiseXOR(x(r, k))) for k in ("s0", "s1")), F.lit(0))
    common = F.least(x(c, "shared"), x(r, "shared"))
    small = F.least(x(c, "n"), x(r, "n")) < SKETCHED
    return size & (100 * common >= percent * (x(c, "n") + x(r, "n") - common)) & (small | (BINS - differ >= least))


def link(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``, then the set's key (k0, k1) and leads.

    Rows link at 100 * intersection >= percent * union of their distinct shingle sets. Null, empty and blank texts are linked with
    nothing. Rows without doc_id are linked with nothing either, as they cannot be named: their component_id is null. Repeated rows
    are rows of one component. Should one doc_id stand for different texts, each is linked by its own text alone, so its rows may be in
    several components. leads marks the one set of each component that stays, under its smallest doc_id; true for rows linked with nothing."""
    ids = F.col("doc_id").cast("long")
    with _small_batches(docs.sparkSession):
        seen = materialize(docs.select(ids.alias("doc_id"), sketches(F.col(text), size).alias("k")).select("doc_id", "k.*"), "sketches")
    has = seen.filter("n > 0 and doc_id is not null")
    classes = materialize(has.groupBy("n", "k0", "k1").agg(F.min("doc_id").alias("first"), F.min(F.struct("bands", "s0", "s1")).alias("x"))
                          .select("n", "k0", "k1", "first", "x.*").withColumn("rep", F.monotonically_increasing_id()), "classes")

    lot = (F.xxhash64("rep", "key") / F.lit(2.0**63 * 1.0000001) + 1) / 2
    rows = classes.select("rep", "n", "s0", "s1", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    met = materialize(rows.join(shared, "key"), "met")
    sets = _member_sets(docs, classes.join(met.select("rep").distinct(), "rep", "left_semi"), size, text)
    own = F.coalesce("own", F.lit(0))
    met = met.join(_own_shingles(sets), "rep", "left").withColumns({"h": lot, "shared": F.col("n") - own, "q": F.floor(1000 * own / F.col("n")) + lot}).drop("own")
    members = materialize(met.join(met.groupBy("key").agg(F.min("q").alias("star")), "key"), "members")

    star = members.filter("q = star").alias("c").join(members.filter("q > star").alias("r"), (F.col("c.key") == F.col("r.key")) & _possible("c", "r", percent))
    links = _confirmed(star.select(F.col("c.rep").alias("a"), F.col("r.rep").alias("b")), sets, percent)
    found = components(links)

    # Buckets of three or more that still hold several components.
    left = members.filter("m > 2").join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_keys = left.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    bands = classes.groupBy("rep").agg(F.min("bands").alias("bands"))
    left = materialize(left.join(open_keys, "key", "left_semi").filter("q > star"), "open")
    bits = materialize(sets.join(left.select("rep").distinct(), "rep", "left_semi").select("rep", bitmaps(F.col("set")).alias("bits")), "bits")
    left = materialize(left.join(bands, "rep").join(bits, "rep"), "open")
    largest = left.agg(F.max("m")).first()[0] or 0
    done, upto = 0, CENTRES
    while done < largest:
        c = left.filter((F.col("h") >= done / F.col("m")) & (F.col("h") < upto / F.col("m"))).alias("c")
        r = left.filter(F.col("m") > done).alias("r")
        later = F.struct("c.h", "c.rep") < F.struct("r.h", "r.rep")
        pairs = c.join(r, (F.col("c.key") == F.col("r.key")) & later & (F.col("c.component") != F.col("r.component"))
                       & _possible("c", "r", percent) & _first_bucket() & _bits_allow(percent))
        new = _confirmed(pairs.select(F.col("c.rep").alias("a"), F.col("r.rep").alias("b")), sets, percent)
        if not new.isEmpty():
            links = materialize(links.unionByName(new), "links")
            found = components(links)
            fresh = found.withColumnRenamed("id", "rep").withColumnRenamed("component", "fresh")
            left = materialize(left.join(fresh, "rep", "left").withColumn("component", F.coalesce("fresh", "component")).drop("fresh"), "open")
        done, upto = upto, upto * GROWTH

    ends = classes.select("n", "k0", "k1", "first", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    ends = materialize(ends.drop("rep"), "ends")
    heads = ends.groupBy("component").agg(F.min(F.struct("first", "n", "k0", "k1")).alias("head"))
    named = ends.join(heads, "component").select("n", "k0", "k1", "first", F.col("head.first").alias("component"),
                                                 (F.struct("first", "n", "k0", "k1") == F.col("head")).alias("heads"))
    out = seen.select("doc_id", "n", "k0", "k1").join(named, ["n", "k0", "k1"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    leads = F.coalesce(F.col("heads") & (F.col("doc_id") == F.col("first")), F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "k0", "k1", leads.alias("leads"))


def _own_shingles(sets: DataFrame) -> DataFrame:
    """(rep, own): how many shingles of a row no other row of ``sets`` has."""
    alone = sets.select("rep", F.explode("set").alias("x")).groupBy("x").agg(F.count("*").alias("k"), F.min("rep").alias("rep")).filter("k = 1")
    return alone.groupBy("rep").agg(F.count("*").alias("own"))


def _bits_allow(percent: int) -> Column:
    """Whether the shingles that one bitmap shows and the other lacks leave enough for the intersection."""
    lacks = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda s, x: s + x)
    c, r = F.col("c.bits"), F.col("r.bits")
    common = F.least(F.col("c.n") - lacks(c, r), F.col("r.n") - lacks(r, c))
    return 100 * common >= percent * (F.col("c.n") + F.col("r.n") - common)


def _first_bucket() -> Column:
    """A pair that shares several buckets counts in the one with the smallest key."""
    return F.array_min(F.array_intersect("c.bands", "r.bands")) == F.col("c.key")


def _member_sets(docs: DataFrame, classes: DataFrame, size: int, text: str) -> DataFrame:
    """(rep, set) for each of ``classes``: its full shingle set, from a text of its first doc_id that has the class's key."""
    wanted = classes.select(F.col("first").alias("doc_id"), "n", "k0", "k1", "rep")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("t")).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    with _small_batches(docs.sparkSession):
        made = texts.select("doc_id", full_sets(F.col("t"), size).alias("s")).select("doc_id", "s.*").withColumn("n", F.size("set").cast("long"))
        # Null-safe on the key, or Spark would filter on it below the semi-join, where every text's set would be made.
        w, m = wanted.alias("w"), made.alias("m")
        own = (F.col("m.doc_id") == F.col("w.doc_id")) & F.col("m.n").eqNullSafe(F.col("w.n")) & F.col("m.k0").eqNullSafe(F.col("w.k0")) & F.col("m.k1").eqNullSafe(F.col("w.k1"))
        return materialize(m.join(w, own).select("rep", "set").dropDuplicates(["rep"]), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) whose full sets are similar enough."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    a, b = (sets.select(F.col("rep").alias(c), F.col("set").alias(f"{c}_set")) for c in ("a", "b"))
    both = pairs.join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("a_set", "b_set"))
    return materialize(both.filter(100 * common >= percent * (F.size("a_set") + F.size("b_set") - common)).select("a", "b"), "links")
