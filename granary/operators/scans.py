"""Linear recurrences along sequences of any length, as prefix sums of an associative operator.

state = a * state before + b is the composition of affine maps, (a, b) then (c, d) being (a c, c b + d). Rows are range-sorted by sequence and
order, so that one sequence may span many tasks; a task composes the maps of its own rows, what its last row has meets the next task's
first rows by a carry for each task (a number for each partition, which the driver composes), and the states follow without another shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructType

from granary.session import kept

#: Columns of a block: rows are composed this many at a time, all blocks at once.
STRIDE = 64


def prefixes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The compositions of the maps x -> a x + b up to each place. Linear: blocks first, then the blocks' ends by the same, then their carries."""
    n = len(a)
    if n <= STRIDE:
        a, b = a.copy(), b.copy()
        for i in range(1, n):
            b[i] += a[i] * b[i - 1]
            a[i] *= a[i - 1]
        return a, b
    m = -(-n // STRIDE)
    wide = lambda v, fill: np.concatenate([v, np.full(m * STRIDE - n, fill)]).reshape(m, STRIDE)
    a, b = wide(a, 1.0), wide(b, 0.0)
    for i in range(1, STRIDE):
        b[:, i] += a[:, i] * b[:, i - 1]
        a[:, i] *= a[:, i - 1]
    ahead, before = prefixes(a[:, -1], b[:, -1])
    b[1:] += a[1:] * before[:-1, None]
    a[1:] *= ahead[:-1, None]
    return a.ravel()[:n], b.ravel()[:n]


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each entry but the first differs from the one before; nulls are equal."""
    one, two = column[1:], column[:-1]
    differ = pc.fill_null(pc.not_equal(one, two), False)
    return pc.or_(differ, pc.xor(one.is_null(), two.is_null())).to_numpy(zero_copy_only=False)


def scanned(rows: DataFrame, keys: Sequence[str], order: Sequence[str], a: Column, b: Column, keep: Sequence[str] = (), reverse: bool = False) -> DataFrame:
    """``keys``, ``order``, ``keep`` and state of each row: a times the state of the row before it in its sequence, plus b; 0 before the first (WIN-03).

    Sequences have equal keys (null is a value) and go by ``order``, nulls first, and by a and b where it is equal; ``reverse`` turns all that around. a and b may depend
    on the row. A row whose a or b is null passes the state on. Names of other columns do not matter; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    names = [*keys, *order, *[k for k in keep if k not in (*keys, *order)]]
    given = a.isNotNull() & b.isNotNull()
    # positions, not names: no column of the rows can clash
    places = [F.col(c).alias(f"c{i}") for i, c in enumerate(names)]
    maps = [F.when(given, a).otherwise(1.0).cast("double").alias("a"), F.when(given, b).otherwise(0.0).cast("double").alias("b")]
    flat = rows.select(*places, *maps)
    way = [F.col(f"c{i}").desc_nulls_last() if reverse else F.col(f"c{i}").asc_nulls_first() for i in range(len(keys), len(keys) + len(order))]
    tie = [F.col(c).desc() if reverse else F.col(c).asc() for c in ("a", "b")]
    by = [*[F.col(f"c{i}").asc_nulls_first() for i in range(len(keys))], *way, *tie]
    flat = flat.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("block", F.spark_partition_id())
    schema = StructType([*flat.schema.fields[: len(names)]]).add("block", IntegerType()).add("p", DoubleType()).add("s", DoubleType()).add("head", BooleanType()).add("tail", BooleanType())

    def run(batches):
        ahead, before, last, held = 1.0, 0.0, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for i in range(len(keys)):
                new[1:] |= _changes(batch.column(i))
                new[0] |= last is not None and last.column(i)[0] != batch.column(i)[0] and not (last.column(i)[0].as_py() is None and batch.column(i)[0].as_py() is None)
            up, add = (batch.column(len(names) + i).to_numpy().copy() for i in range(2))
            up[new] = 0.0  # nothing comes from before
            p, s = prefixes(up, add)
            s, p = s + p * before, p * ahead
            ahead, before, last = p[-1], s[-1], batch.slice(n - 1)
            if held is not None:
                yield held
            flags = [pa.array(np.arange(n) == 0) if held is None else pa.array(np.zeros(n, bool)), pa.array(np.zeros(n, bool))]
            held = pa.RecordBatch.from_arrays([*batch.columns[: len(names)], batch.column(len(names) + 2), pa.array(p), pa.array(s), *flags], schema.names)
        if held is not None:
            tail = pa.array(np.arange(held.num_rows) == held.num_rows - 1)
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], tail], schema.names)

    done = kept(flat.mapInArrow(run, schema), "scan")
    ends = done.where("head OR tail").select("block", "p", "s", "head", "tail", *[f"c{i}" for i in range(len(keys))]).collect()
    heads, tails = ({r["block"]: r for r in ends if r[which]} for which in ("head", "tail"))
    carries, before, state = [], None, 0.0
    for block in sorted(heads):
        own = lambda r: tuple(r[f"c{i}"] for i in range(len(keys)))
        carry = state if before is not None and own(heads[block]) == before else 0.0
        carries.append((block, carry))
        before, state = own(tails[block]), tails[block]["s"] + tails[block]["p"] * carry
    carried = F.broadcast(spark.createDataFrame(carries, "block int, carry double"))
    return done.join(carried, "block").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], (F.col("s") + F.col("p") * F.col("carry")).alias("state"))


def both_ways(rows: DataFrame, keys: Sequence[str], order: Sequence[str], a: Column, b: Column) -> DataFrame:
    """``keys``, ``order`` and the mean of the states along each sequence and against it (WIN-02). The order tells the rows of a sequence apart."""
    at = [*keys, *order]
    there, back = (scanned(rows, keys, order, a, b, reverse=r) for r in (False, True))
    return there.unionByName(back).groupBy(*at).agg(F.avg("state").alias("state"))


def four_ways(image: DataFrame, a: Column, b: Column) -> DataFrame:
    """image_id, x, y and the mean of the states along the rows and columns of an image, both ways (WIN-02).

    The four directions are four sequences of each pixel, told apart by their keys, and go through one scan.
    """
    way = lambda d, line, place: F.struct(F.lit(d).alias("direction"), line.cast("long").alias("line"), place.cast("long").alias("place"))
    x, y = F.col("x"), F.col("y")
    ways = F.explode(F.array(way("right", y, x), way("left", y, -x), way("down", x, y), way("up", x, -y)))
    flat = image.select("image_id", "x", "y", a.alias("a"), b.alias("b"), ways.alias("w")).select("image_id", "w.direction", "w.line", "w.place", "x", "y", "a", "b")
    states = scanned(flat, ["image_id", "direction", "line"], ["place"], F.col("a"), F.col("b"), keep=["x", "y"])
    return states.groupBy("image_id", "x", "y").agg(F.avg("state").alias("state"))
