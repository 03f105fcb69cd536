"""Exact top-k inner product search by tiles.

Vectors are quantised to whole numbers and packed: queries into tiles, all rows into shards, both as matrices of bounded
size. Every (tile, shard) pair is one matrix product; the k best of each query are selected from it before anything is
written. A query's lists from different shards then merge in a tree, ``FAN`` shards to one at each level, so no task
ever holds more than FAN * k rows of a query.

Products are exact: in doubles while no partial sum can reach 2^53, in 64-bit integers up to 2^63, beyond that in Python
integers, cut to the range of a long.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditkit.sources.staging import materialize

TILE, SHARD, FAN = 512, 8192, 16


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as long, or null where the vector or a component is null or not finite."""
    doubles = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), doubles)


def _packed(rows: DataFrame, size: int, number: str) -> DataFrame:
    """(id, v) to blocks of at most ``size`` vectors of one length: number, d, ids, v. Blocks are cut inside each task."""

    def work(frames):
        made = 0
        for frame in frames:
            frame = frame.assign(d=frame.v.map(len))
            for d, part in frame.groupby("d", sort=False):
                for at in range(0, len(part), size):
                    block = part.iloc[at:at + size].sort_values("id")
                    made += 1
                    yield pd.DataFrame({"d": [int(d)], "ids": [block.id.to_numpy(np.int64).tobytes()],
                                        "v": [np.stack(block.v.to_numpy()).astype(np.int64).tobytes() if d else b""]})

    blocks = rows.mapInPandas(work, "d int, ids binary, v binary")
    # Block numbers are dense and small in total, so they can be counted from the ids of the tasks.
    return materialize(blocks.withColumn(number, F.monotonically_increasing_id()), number)


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact q @ c.T of whole numbers."""
    d = q.shape[1]
    if not d:
        return np.zeros((len(q), len(c)), np.int64)
    most = float(np.abs(q.astype(float)).max()) * float(np.abs(c.astype(float)).max()) * d
    if most < 2**53:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    if most < 2**62:
        return q @ c.T
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores of one row, ties to the left."""
    if len(scores) <= k:
        return np.argsort(-scores, kind="stable")
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    chosen = np.sort(np.concatenate([above, np.flatnonzero(scores == least)[:k - len(above)]]))
    return chosen[np.argsort(-scores[chosen], kind="stable")]


def search(queries: DataFrame, rows: DataFrame, k: int = 20, tile: int = TILE, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of each query: by score, ties to the smaller vec_id.

    Both tables have id and v (longs). Null vectors and null ids take no part; vectors meet only those of their length. Rows with
    a query's id are the query's own and never answer it; a query id that is there more than once asks with its smallest vector.
    Equal rows under other ids are answers of their own; a row given twice counts once. Every query of ``queries`` is answered
    against all of ``rows``: tiles and shards are paired by number, so each pair of blocks is one task's row."""
    spark = queries.sparkSession
    queries = queries.filter("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"))
    tiles = _packed(queries, tile, "tile")
    shards = _packed(rows.filter("id is not null and v is not null"), shard, "shard")
    numbers = shards.select("shard", "d")
    numbers = materialize(numbers.select("shard", "d", F.row_number().over(Window.partitionBy("d").orderBy("shard")).alias("place")), "places")
    deal = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # A tile goes to every shard of its vectors' length; the pair's shard is looked up by number.
    wanted = tiles.select("tile", "d", F.col("ids").alias("q_ids"), F.col("v").alias("q_v")).join(numbers, "d")
    pairs = wanted.repartition(deal, "shard").join(shards.select("shard", "ids", "v"), "shard")

    def work(frames):
        for frame in frames:
            for r in frame.itertuples():
                q_ids, ids = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
                q = np.frombuffer(r.q_v, np.int64).reshape(len(q_ids), r.d)
                scores = product(q, np.frombuffer(r.v, np.int64).reshape(len(ids), r.d))
                found = []
                for row, own in zip(scores, q_ids):
                    others = np.flatnonzero(ids != own)
                    # Repeats of a row in this shard give way before the cut.
                    others = others[_firsts(ids[others], row[others])]
                    top = others[best(row[others], k)]
                    found.append((np.full(len(top), own), ids[top], row[top]))
                q_col, v_col, s_col = (np.concatenate(x) for x in zip(*found))
                yield pd.DataFrame({"query_id": q_col, "vec_id": v_col, "score": s_col, "part": np.full(len(q_col), r.place - 1, np.int64)})

    lists = pairs.select("place", "d", "q_ids", "q_v", "ids", "v").mapInPandas(work, "query_id long, vec_id long, score long, part long")
    most = numbers.agg(F.max("place")).first()[0] or 0
    for _ in range(max(1, math.ceil(math.log(max(most, 2), FAN)))):
        lists = _merged(lists, k)
    return lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _firsts(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Positions without those that repeat the id and score before them (ids are sorted)."""
    if len(ids) < 2 or (ids[1:] != ids[:-1]).all():
        return np.arange(len(ids))
    keep, seen = [], set()
    for i, pair in enumerate(zip(ids.tolist(), scores.tolist())):
        if pair not in seen:
            seen.add(pair)
            keep.append(i)
    return np.array(keep)


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """One level of the tree: the lists of FAN neighbouring parts become one."""
    by = Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "vec_id")
    level = lists.select("query_id", "vec_id", "score", F.floor(F.col("part") / FAN).alias("part")).dropDuplicates(["query_id", "part", "vec_id", "score"])
    return level.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
