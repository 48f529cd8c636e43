"""Pairing of vectors: nearest neighbours and exact transport within bounded batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import vectors


def nearest(left: DataFrame, right: DataFrame, batch: str, id_col: str, vector: str, k: int = 1) -> DataFrame:
    """id, other, distance, rank: the k nearest right vectors of each left one within its batch (cost part of JOIN-07, JOIN-09)."""
    a = left.select(batch, F.col(id_col).alias("id"), F.col(vector).alias("v"))
    b = right.select(batch, F.col(id_col).alias("other"), F.col(vector).alias("w"))
    pairs = a.join(b, batch).where("id <> other").select("id", "other", vectors.distance2(F.col("v"), F.col("w")).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


#: Distances (queries times rows) and vectors of pairs that a task computes at once.
TILE_CELLS, TILE_PAIRS = 1 << 19, 1 << 14


def _least(of: np.ndarray, other: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k pairs of each query with the least (distance, other), by query."""
    order = np.lexsort((other, distance, of))
    of = of[order]
    best = np.arange(len(of)) - np.searchsorted(of, of) < k
    return of[best], other[order][best], distance[order][best]


def _nearest(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """id, other, distance: the k rows (id, vector) of all batches that are nearest to each query ``q``.

    A product of matrices rules out most pairs of a tile, with a margin for its rounding; distances are computed from the vectors of the rest.
    What is held is a tile, a batch and k pairs a query.
    """
    held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    worst = np.full(len(ids), np.inf)
    q_size = (q * q).sum(axis=1)
    for batch in batches:
        other = batch.column(0).to_numpy(zero_copy_only=False)
        v = np.array(batch.column(1).to_pylist(), float)
        if not len(other):
            continue
        finite = np.isfinite(v).all(axis=1)
        other, v = other[finite], v[finite]
        v_size = (v * v).sum(axis=1)
        found = [held]
        height = max(1, TILE_CELLS // max(len(other), 1))
        for low in range(0, len(ids) if len(other) else 0, height):
            tile = slice(low, low + height)
            rough = q_size[tile, None] - 2 * (q[tile] @ v.T) + v_size
            margin = 1e-9 * (q_size[tile] + v_size.max())
            rough[ids[tile, None] == other] = np.inf
            level = np.minimum(np.partition(rough, k - 1, axis=1)[:, k - 1] if len(other) >= k else np.inf, worst[tile])
            # where squares overflow, nothing is ruled out
            i, at = np.nonzero((rough <= (level + 2 * margin)[:, None]) | ~np.isfinite(margin)[:, None])
            i += low
            for first in range(0, len(i), TILE_PAIRS):
                one, two = i[first : first + TILE_PAIRS], at[first : first + TILE_PAIRS]
                distance = ((v[two] - q[one]) ** 2).sum(axis=1)
                good = np.isfinite(distance) & (ids[one] != other[two])
                found.append(_least(one[good], other[two][good], distance[good], k))
        held = _least(*(np.concatenate(x) for x in zip(*found, strict=True)), k)
        full = np.flatnonzero(np.bincount(held[0], minlength=len(ids)) == k)
        worst[full] = held[2][np.searchsorted(held[0], full, "right") - 1]
    if len(held[0]):
        yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[1]), pa.array(held[2])], ["id", "other", "distance"])


def search(queries: DataFrame, rows: DataFrame, id_col: str, vector: str, k: int, block: int = 2048) -> DataFrame:
    """id, other, distance, rank: the k nearest rows of each query, exactly (JOIN-09).

    The queries are a stated set; they are broadcast a block at a time against all rows and every task
    keeps its k best, so that what is shuffled is k rows for each task and query.
    """
    spark = rows.sparkSession
    names, vecs, found = [], [], []

    def scan(names, vecs):
        shared = spark.sparkContext.broadcast((np.array(names, np.int64), np.array(vecs, float)))

        def run(batches):
            yield from _nearest(batches, *shared.value, k)

        return rows.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), vector).mapInArrow(run, "id long, other long, distance double")

    for row in queries.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).toLocalIterator():
        names.append(row["id"])
        vecs.append(row["v"])
        if len(names) == block:
            found.append(scan(names, vecs))
            names, vecs = [], []
    if names or not found:
        found.append(scan(names, vecs) if names else spark.createDataFrame([], "id long, other long, distance double"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column for each row of a square matrix with the least total cost, by shortest augmenting paths."""
    n = len(cost)
    row_price, column_price = np.zeros(n), np.zeros(n)
    row_of = np.full(n, -1)
    for start in range(n):
        best, came, seen = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        row, last = start, -1
        while True:
            reduced = cost[row] - row_price[row] - column_price
            if last >= 0:
                reduced = reduced + best[last]
            better = ~seen & (reduced < best)
            best[better], came[better] = reduced[better], last
            column = int(np.argmin(np.where(seen, np.inf, best)))
            seen[column] = True
            last = column
            if row_of[column] < 0:
                break
            row = int(row_of[column])
        length = best[last]
        for column in np.flatnonzero(seen):
            gain = length - best[column]
            if row_of[column] >= 0 and column != last:
                row_price[row_of[column]] += gain
            column_price[column] -= gain
        row_price[start] += length
        while last >= 0:
            before = came[last]
            row_of[last] = row_of[before] if before >= 0 else start
            last = before
    out = np.empty(n, int)
    out[row_of] = np.arange(n)
    return out


def transport(pairs: DataFrame, batch: str, id_col: str, x0: str, x1: str, largest: int = 512) -> DataFrame:
    """id, other: which row's x1 each row's x0 goes to, with least total squared distance in each batch (JOIN-07).

    The batch is an explicit column and bounded: the work is cubic in its rows.
    """

    def one(frame):
        if len(frame) > largest:
            raise ValueError(f"a batch of {len(frame)} rows is over {largest}")
        frame = frame.sort_values("id")
        a, b = np.stack(frame["a"].to_numpy()).astype(float), np.stack(frame["b"].to_numpy()).astype(float)
        cost = ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
        to = assignment(cost)
        ids = frame["id"].to_numpy()
        return frame.assign(other=ids[to], cost=cost[np.arange(len(ids)), to])[["batch", "id", "other", "cost"]]

    rows = pairs.select(F.col(batch).cast("long").alias("batch"), F.col(id_col).cast("long").alias("id"), F.col(x0).alias("a"), F.col(x1).alias("b"))
    return rows.groupBy("batch").applyInPandas(one, "batch long, id long, other long, cost double")
