"""An index of vectors by coarse centroids, searched list by list, and matches that hold both ways (JOIN-09).

The centroids are fitted on a bounded sample; every row is put into the list of its nearest one. A query
probes the lists of its nearest centroids; with ``exact`` it then probes all others that the triangle
inequality does not rule out, so that no neighbour is lost. Lists and their queries are cut into tiles
of bounded size, so a list that holds a third of all rows is many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.session import kept

#: Distinct vectors on which centroids are fitted, and the most lists (centroids are broadcast: 1,024 of 64 numbers are 0.5 MB).
SAMPLE, MOST_LISTS = 20_000, 1_024
#: Rows and queries of a tile.
TILE_ROWS, TILE_QUERIES = 20_000, 2_048


@dataclass
class Index:
    """``rows`` (id, v, list, gap: distance to the centroid), the centroids, and of each list the rows and the largest gap."""

    rows: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def whole(rows: DataFrame, id_col: str, vector: str, width: int | None = None) -> DataFrame:
    """id and v of the rows whose id is not null and whose vector is not null or empty, holds no null or NaN and has ``width`` numbers."""
    v = F.col(vector).cast("array<double>")
    good = F.col(id_col).isNotNull() & (F.size(vector) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))
    good = good if width is None else good & (F.size(vector) == width)
    return rows.where(good).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def fitted(rows: DataFrame, lists: int | None = None, sample: int = SAMPLE, steps: int = 10) -> np.ndarray:
    """Centroids of a sample of the distinct vectors of ``rows`` (id, v), those of least hash: about the square root of the rows unless ``lists`` is given."""
    n = rows.count()
    share = min(1.0, 2 * sample / max(n, 1))
    order = F.xxhash64("v")
    some = rows.select("v").where(F.pmod(order, F.lit(1_000_000)) < share * 1_000_000).distinct()
    vectors = np.array([r["v"] for r in some.orderBy(order).limit(sample).collect()], float)
    if not len(vectors):
        return np.zeros((0, 1))
    lists = min(lists or max(int(n**0.5), 1), MOST_LISTS, len(vectors))
    at = vectors[:lists].copy()
    for _ in range(steps):
        of = near(vectors, at).argmin(axis=1)
        sums, counts = np.zeros_like(at), np.bincount(of, minlength=lists)
        np.add.at(sums, of, vectors)
        at[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return at


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` and ``b``, up to rounding."""
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None, :], 0)


def indexed(rows: DataFrame, id_col: str, vector: str, lists: int | None = None, sample: int = SAMPLE) -> Index:
    """Every whole row in the list of its nearest centroid. The width is that of the most frequent length, the smaller of equal ones."""
    widths = rows.where(F.size(vector) > 0).groupBy(F.size(vector).alias("width")).count().orderBy(F.desc("count"), "width").first()
    good = whole(rows, id_col, vector, widths["width"] if widths else 0)
    centroids = fitted(good, lists, sample)
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def put(batches):
        for batch in batches:
            if batch.num_rows:
                distance = near(matrix(batch.column(1)), shared.value)
                of = distance.argmin(axis=1)
                gap = np.sqrt(distance[np.arange(len(of)), of])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(of, pa.int32()), pa.array(gap)], ["id", "v", "list", "gap"])

    placed = good.mapInArrow(put, "id long, v array<double>, list int, gap double")
    sizes, radii = np.zeros(len(centroids), int), np.zeros(len(centroids))
    for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("far")).collect():  # a row for each list
        sizes[r["list"]], radii[r["list"]] = r["n"], r["far"]
    return Index(placed, centroids, sizes, radii)


def searched(queries: DataFrame, index: Index, id_col: str, vector: str, k: int, probes: float = 8, exact: bool = False, same: bool = True) -> DataFrame:
    """id, other, distance (squared), rank: the k nearest rows of each query, in the probed lists or, with ``exact``, in all.

    ``probes`` is a number of lists, or below 1 a share of them: vectors without clusters need most of them.

    Ties go by id; rows that repeat an id and vector count once. ``same``: queries and rows are one set, and
    a query is not its own neighbour. Queries and rows without a whole vector of the index's width are left out.
    """
    probes = int(probes) if probes >= 1 else max(1, round(probes * len(index.centroids)))
    wanted = whole(queries, id_col, vector, index.centroids.shape[1]).distinct()
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, index.radii, index.sizes))

    def lists(batches, beyond: bool):
        for batch in batches:
            centroids, radii, sizes = shared.value
            if not batch.num_rows or not len(centroids):
                continue
            distance = near(matrix(batch.column(1)), centroids)
            distance[:, sizes == 0] = np.inf
            first = np.zeros(distance.shape, bool)
            np.put_along_axis(first, np.argsort(distance, axis=1, kind="stable")[:, :probes], True, axis=1)
            if beyond:  # lists whose nearest possible row is not farther than the k-th one found; the margin is for rounding
                reach = np.sqrt(batch.column(2).to_numpy(zero_copy_only=False))[:, None]
                chosen = ~first & (np.sqrt(distance) - radii[None, :] <= reach * (1 + 1e-9) + 1e-6)
            else:
                chosen = first
            i, of = np.nonzero(chosen & (sizes > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i)), pa.array(of, pa.int32())], ["id", "v", "list"])

    def probe(rows: DataFrame, beyond: bool) -> DataFrame:
        return rows.mapInArrow(lambda batches: lists(batches, beyond), "id long, v array<double>, list int")

    found = _best(_tiles(probe(wanted, False), index, k, same), k)
    if exact:
        found = kept(found, "found")  # k rows a query, read by the bounds, their counts and the result
        reach = found.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("reach"))
        more = wanted.join(reach, "id", "left").select("id", "v", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
        found = _best(found.drop("rank").unionByName(_tiles(probe(more, True), index, k, same)), k)
    return found


def _best(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("id", "other").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def _parts(sizes: np.ndarray, most: int) -> Column:
    """How many parts the list of a row has."""
    return F.element_at(F.array(*[F.lit(int(-(-max(n, 1) // most))) for n in sizes]), F.col("list") + 1)


def _tiles(asked: DataFrame, index: Index, k: int, same: bool) -> DataFrame:
    """id, other, distance: the k nearest rows of each query in each part of its lists."""
    schema = "id long, other long, distance double"
    if not len(index.sizes):
        return asked.select("id", F.col("id").alias("other"), F.lit(0.0).alias("distance")).where("false")
    asks = np.zeros(len(index.sizes), int)
    for r in asked.groupBy("list").count().collect():  # a row for each list
        asks[r["list"]] = r["count"]
    row_parts, query_parts = _parts(index.sizes, TILE_ROWS), _parts(asks, TILE_QUERIES)
    every = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    # the reader's partition spreads rows that are repeated
    rows = index.rows.select("id", "v", "list", F.pmod(F.xxhash64("id", "v", F.spark_partition_id()), row_parts).cast("int").alias("part"), every(query_parts).alias("turn"))
    rows = rows.where(F.element_at(F.array(*[F.lit(bool(n)) for n in asks]), F.col("list") + 1))
    turns = asked.select("id", "v", "list", F.pmod(F.xxhash64("id"), query_parts).cast("int").alias("turn"), every(row_parts).alias("part"))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        names, others, distances = [], [], []
        if left.num_rows and right.num_rows:
            ids, v = left.column("id").to_numpy(), matrix(left.column("v"))
            _, one = np.unique(np.column_stack((ids.view(np.float64), v)).view(np.uint64), axis=0, return_index=True)
            ids, v = ids[one], v[one]
            for name, q in zip(right.column("id").to_pylist(), matrix(right.column("v")), strict=True):
                distance = ((v - q) ** 2).sum(axis=1)
                allowed = np.flatnonzero(ids != name) if same else np.arange(len(ids))
                # an id may have several vectors: the k nearest ids, not rows
                order = allowed[np.lexsort((ids[allowed], distance[allowed]))]
                _, first = np.unique(ids[order], return_index=True)
                best = order[np.sort(first)[:k]]
                names.append(np.full(len(best), name))
                others.append(ids[best])
                distances.append(distance[best])
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({"id": join(names, pa.int64()), "other": join(others, pa.int64()), "distance": join(distances, pa.float64())})

    return rows.groupBy("list", "part", "turn").cogroup(turns.groupBy("list", "part", "turn")).applyInArrow(tile, schema)


def matched(left: DataFrame, right: DataFrame, id_col: str, vector: str, ratio: float = 0.8, probes: float = 8, exact: bool = False) -> DataFrame:
    """id (of left), other (of right), distance, second: nearest rows of each other, the distance below ``ratio`` of that to the second nearest.

    Distances are roots; ``second`` is null where ``right`` has one row only, which passes. The way back is searched for those that pass.
    """
    there = searched(left, indexed(right, id_col, vector), id_col, vector, 2, probes, exact, same=False)
    best = F.max(F.when(F.col("rank") == 1, F.struct("other", "distance")))
    pairs = there.groupBy("id").agg(best.alias("best"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("second"))
    pairs = pairs.select("id", "best.other", F.sqrt("best.distance").alias("distance"), F.sqrt("second").alias("second"))
    pairs = pairs.where(F.col("second").isNull() | (F.col("distance") < ratio * F.col("second")))
    pairs = kept(pairs, "pairs")
    asked = right.join(pairs.select(F.col("other").alias(id_col)).distinct(), id_col, "left_semi")
    back = searched(asked, indexed(left, id_col, vector), id_col, vector, 1, probes, exact, same=False)
    back = back.select(F.col("id").alias("other"), F.col("other").alias("id"))
    return pairs.join(back, ["id", "other"])
