"""Order-dependent and matrix operators: convolutions along a sequence, two-way scans, low-rank merges, splines, structural similarity."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import vectors


def causal(rows: DataFrame, key: str, order: str, value: str, weights: list[float]) -> DataFrame:
    """``conv``: the weighted sum of a value and those before it in its sequence, the last weight on itself (WIN-04)."""
    w = Window.partitionBy(key).orderBy(order)
    k = len(weights)
    return rows.withColumn("conv", sum((F.lit(float(x)) * F.coalesce(F.lag(value, k - 1 - i).over(w), F.lit(0.0)) for i, x in enumerate(weights)), F.lit(0.0)))


def two_way(v: Column, decay: float) -> Column:
    """Mean of the recurrence along an array and along its reverse (WIN-02)."""
    back = F.reverse(vectors.recurrence(F.reverse(v), decay))
    return F.zip_with(vectors.recurrence(v, decay), back, lambda a, b: (a + b) / 2)


def merged(base: DataFrame, a: DataFrame, b: DataFrame, alpha: float, rank: int, scale: float = 1.0) -> DataFrame:
    """i, j, value of base + alpha / rank * scale * (b x a), all matrices as tall rows (i, j, value) (PRJ-21).

    Each cell meets the line of b of its row and the line of a of its column, ``rank`` numbers each; products are summed
    within the cell, so no table of products is grouped, and the few values of the rank are no keys of a shuffle.
    """
    line = F.collect_list(F.struct("r", "s"))
    left = b.groupBy("i", F.col("j").alias("r")).agg(F.sum("value").alias("s")).groupBy("i").agg(line.alias("x"))
    right = a.groupBy("j", F.col("i").alias("r")).agg(F.sum("value").alias("s")).where("r IS NOT NULL").groupBy("j").agg(F.map_from_entries(line).alias("y"))
    both = base.join(left, "i", "left").join(right, "j", "left")
    delta = F.aggregate("x", F.lit(0.0), lambda t, e: t + F.coalesce(e["s"] * F.try_element_at("y", e["r"]), F.lit(0.0)))
    return both.select("i", "j", (F.col("value") + F.coalesce(F.lit(alpha / rank * scale) * delta, F.lit(0.0))).alias("value"))


def blended(w: Column, a: Column, b: Column, share: float) -> Column:
    """w + (1 - share) (a - w) + share (b - w): two styles mixed (PRJ-22)."""
    return F.zip_with(vectors.wide(w), vectors.interpolate(a, b, F.lit(float(share))), lambda x, y: x + (y - x))


def basis(x: np.ndarray, knots: np.ndarray, degree: int) -> np.ndarray:
    """B-spline basis functions at x, a column for each; x is held to the knots' inner range."""
    knots = np.asarray(knots, float)
    n = len(knots) - degree - 1
    x = np.clip(x, knots[degree], np.nextafter(knots[n], -np.inf))
    out = ((x[:, None] >= knots[:-1]) & (x[:, None] < knots[1:])).astype(float)
    for d in range(1, degree + 1):
        low, high = knots[d:-1] - knots[: -d - 1], knots[d + 1 :] - knots[1:-d]
        up = np.divide(x[:, None] - knots[: -d - 1], low, out=np.zeros((len(x), len(low))), where=low > 0)
        down = np.divide(knots[d + 1 :] - x[:, None], high, out=np.zeros((len(x), len(high))), where=high > 0)
        out = up * out[:, :-1] + down * out[:, 1:]
    return out


def spline(rows: DataFrame, value: str, knots: list[float], weights: list[float], degree: int = 3) -> DataFrame:
    """``rows`` with ``spline``: the weighted sum of the basis functions at a value; null stays null (PRJ-30)."""
    grid, factors = np.array(knots, float), np.array(weights, float)

    @F.pandas_udf("double")
    def at(x):
        y = x.astype(float).copy()
        there = y.notna()
        y[there] = basis(y[there].to_numpy(), grid, degree) @ factors
        return y

    return rows.withColumn("spline", at(F.col(value).cast("double")))


def noise(mu: Column, sigma: float, key: Column, seed: int = 0) -> Column:
    """mu + sigma times a standard normal that depends on the key and the seed alone (PRJ-10, PRJ-12)."""
    u = [(F.xxhash64(key, F.lit(seed), F.lit(i)).bitwiseAND(F.lit((1 << 53) - 1)) + 0.5) / float(1 << 53) for i in range(2)]
    return mu + F.lit(float(sigma)) * F.sqrt(-2 * F.log(u[0])) * F.cos(2 * F.pi() * u[1])


def uniform(key: Column, seed: int = 0) -> Column:
    """A number from 0 to 1 that depends on the key and the seed alone (PRJ-12)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), key.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def shot_noise(value: Column, gain: float, floor: float, key: Column, seed: int = 0) -> Column:
    """value with noise of variance gain * value + floor^2, the normal limit of Poisson and Gaussian noise (PRJ-26)."""
    unit = noise(F.lit(0.0), 1.0, key, seed)
    return value + F.sqrt(F.lit(gain) * F.greatest(value, F.lit(0.0)) + F.lit(floor * floor)) * unit


class Step(Protocol):
    """A transform of a table that leaves its columns as they are (UDF-03)."""

    def __call__(self, rows: DataFrame) -> DataFrame: ...


def augmented(rows: DataFrame, key: str, steps: Sequence[tuple[Step, float]], seed: int = 0) -> DataFrame:
    """``rows`` after each step for the keys that draw it, with the step's probability (UDF-04, PRJ-27)."""
    for i, (step, probability) in enumerate(steps):
        drawn = uniform(F.col(key), seed + i) < probability
        rows = step(rows.where(drawn)).unionByName(rows.where(~drawn))
    return rows


def integrated(rows: DataFrame, key: str, order: str, rate: str, start: float = 0.0) -> DataFrame:
    """``integral``: start plus the trapezoids of a rate along a curve (PRJ-43)."""
    w = Window.partitionBy(key).orderBy(order)
    area = (F.col(order) - F.lag(order).over(w)) * (F.col(rate) + F.lag(rate).over(w)) / 2
    pieces = rows.withColumn("area", F.coalesce(area, F.lit(0.0)))
    return pieces.withColumn("integral", F.lit(start) + F.sum("area").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("area")


def threshold(x: Column, level: float) -> Column:
    """x above the level, else 0 (PRJ-14)."""
    return F.when(x > level, x).otherwise(F.lit(0.0))


def out_of_range(g: Column, low: float = 0.3, high: float = 1.5) -> Column:
    """Mean distance of g from a range (FLT-13, PRJ-45; the form is ours)."""
    return F.avg(F.greatest(F.lit(0.0), F.lit(low) - g) + F.greatest(F.lit(0.0), g - F.lit(high)))


def ssim(rows: DataFrame, id_col: str, a: str, b: str, width: int, window: int = 7, peak: float = 1.0) -> DataFrame:
    """id, ssim: mean structural similarity of two images as row-major arrays, over all whole windows (AGG-13); rows without either have none."""
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.array(batch.column(i).to_pylist(), float).reshape(batch.num_rows, -1, width) for i in (1, 2))
            wx, wy = (np.lib.stride_tricks.sliding_window_view(z, (window, window), axis=(1, 2)) for z in (x, y))
            mx, my = wx.mean(axis=(3, 4)), wy.mean(axis=(3, 4))
            vx, vy = wx.var(axis=(3, 4), ddof=1), wy.var(axis=(3, 4), ddof=1)
            cov = ((wx - mx[..., None, None]) * (wy - my[..., None, None])).sum(axis=(3, 4)) / (window * window - 1)
            value = (2 * mx * my + c1) * (2 * cov + c2) / ((mx**2 + my**2 + c1) * (vx + vy + c2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value.mean(axis=(1, 2)))], [id_col, "ssim"])

    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(id_col).cast("long"), a, b).mapInArrow(run, f"{id_col} long, ssim double")
