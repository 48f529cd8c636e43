"""Images larger than a task's share: tiles with halos, wavelet levels, and structural similarity over several scales."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published weights of the five scales, finest first.
SCALES = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)


def _floor(c: Column, size: int) -> Column:
    return F.floor(c / size).cast("int")


def tiled(image: DataFrame, size: int, halo: int, work: Callable[[np.ndarray], np.ndarray], margin: int = 0) -> DataFrame:
    """image_id, x, y, value of pixels after ``work`` on tiles of ``size`` with ``halo`` pixels of their neighbours on each side (PRJ-35).

    ``work`` is a numpy function of one extended tile, rows by y, and keeps its shape; where the tile's rectangle has no pixel it sees 0. Each pixel is sent to all
    tiles whose extension holds it, a group is one extended tile (so large images spread over tasks), and the tiles' results are put together by a
    weighted mean. A weight is 0 within ``margin`` of a side that has a neighbour, where work that looks so far about cannot be right, and grows evenly up to the
    side's distance of twice the halo. Null values count as 0. Pixels must be unique within an image; halo may not exceed the tile's size and must exceed the margin.
    """
    if not margin < halo <= size:
        raise ValueError("margin < halo <= size")
    side = size + 2 * halo
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = image.select("image_id", "x", "y", "value", F.explode(shifts).alias("s"))
    spread = spread.withColumns({"tile_x": _floor(F.col("x"), size) + F.col("s.i"), "tile_y": _floor(F.col("y"), size) + F.col("s.j")})
    spread = spread.withColumns({"u": F.col("x") - F.col("tile_x") * size + halo, "v": F.col("y") - F.col("tile_y") * size + halo})
    spread = spread.where(F.col("u").between(0, side - 1) & F.col("v").between(0, side - 1))
    cells = F.collect_list(F.struct(F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value")))
    own = F.bool_or((F.col("s.i") == 0) & (F.col("s.j") == 0))
    groups = spread.groupBy("image_id", "tile_x", "tile_y").agg(cells.alias("cells"), own.alias("own")).where("own")

    def ramp(low: int, high: int, before: bool, after: bool) -> np.ndarray:
        at = np.arange(side)
        out = np.ones(side)
        if before:
            out = np.minimum(out, np.clip((at - low - margin + 1) / max(2 * halo - margin, 1), 0, 1))
        if after:
            out = np.minimum(out, np.clip((high - at - margin + 1) / max(2 * halo - margin, 1), 0, 1))
        return out

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                cell = batch.column(3)[i].values
                u, v, value = (cell.field(k).to_numpy() for k in range(3))
                grid = np.zeros((side, side))
                grid[v, u] = value
                low_u, high_u, low_v, high_v = u.min(), u.max(), v.min(), v.max()
                # a side has a neighbour if pixels lie beyond the tile itself
                wide = ramp(low_u, high_u, low_u < halo, high_u >= halo + size)
                tall = ramp(low_v, high_v, low_v < halo, high_v >= halo + size)
                done = work(grid[low_v : high_v + 1, low_u : high_u + 1])
                weight = tall[v] * wide[u]
                key, tx, ty = (batch.column(k)[i].as_py() for k in range(3))
                n = len(u)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n, batch.column(0).type), pa.array((u + tx * size - halo).astype(np.int32)), pa.array((v + ty * size - halo).astype(np.int32)), pa.array(done[v - low_v, u - low_u] * weight), pa.array(weight)],
                    ["image_id", "x", "y", "value", "weight"],
                )

    kind = image.schema["image_id"].dataType.simpleString()
    parts = groups.select("image_id", "tile_x", "tile_y", "cells").mapInArrow(run, f"image_id {kind}, x int, y int, value double, weight double")
    return parts.groupBy("image_id", "x", "y").agg((F.sum("value") / F.sum("weight")).alias("value"))


def convolve(kernel: dict[tuple[int, int], float]) -> Callable[[np.ndarray], np.ndarray]:
    """Work of a tile: the sum of its neighbours by a kernel, 0 beyond the tile."""
    r = max(max(abs(dx), abs(dy)) for dx, dy in kernel)

    def work(grid: np.ndarray) -> np.ndarray:
        h, w = grid.shape
        wide = np.pad(grid, r)
        return sum(k * wide[r + dy : r + dy + h, r + dx : r + dx + w] for (dx, dy), k in kernel.items())

    return work


def haar(image: DataFrame, levels: int) -> DataFrame:
    """image_id, level (from 1), band, x, y, value: orthonormal Haar coefficients of images, bands lh, hl, hh of each level and ll of the last (AGG-13).

    A level is one shuffle with partial sums, keyed by the pixels it makes; pixels beyond an odd border and nulls count as 0.
    """
    low, out = image.select("image_id", "x", "y", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value")), None
    for level in range(1, levels + 1):
        across, down = (F.when(F.pmod(F.col(c), F.lit(2)) == 0, 1.0).otherwise(-1.0) for c in ("x", "y"))
        half = lambda sign: F.sum(F.col("value") * sign / 2)
        bands = {"ll": half(F.lit(1.0)), "hl": half(across), "lh": half(down), "hh": half(across * down)}
        at = low.withColumns({"across": across, "down": down}).groupBy("image_id", _floor(F.col("x"), 2).alias("x"), _floor(F.col("y"), 2).alias("y")).agg(*[v.alias(k) for k, v in bands.items()])
        names = [b for b in bands if b != "ll" or level == levels]
        told = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("value")) for b in names])).alias("c")
        rows = at.select("image_id", F.lit(level).alias("level"), "x", "y", told).select("image_id", "level", "c.band", "x", "y", "c.value")
        out = rows if out is None else out.unionByName(rows)
        low = at.select("image_id", "x", "y", F.col("ll").alias("value"))
    return out


def window(size: int = 11, sigma: float = 1.5) -> np.ndarray:
    """Weights of a line of the similarity window, with sum 1."""
    raw = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    return raw / raw.sum()


def _filtered(x: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Weighted means over all whole windows of images (n, height, width)."""
    for axis in (1, 2):
        x = np.tensordot(np.lib.stride_tricks.sliding_window_view(x, len(line), axis=axis), line, axes=(3, 0))
    return x


def similarity(x: np.ndarray, y: np.ndarray, line: np.ndarray, peak: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Mean structural similarity of images (n, height, width), and the mean of its contrast and structure part alone."""
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    mx, my = _filtered(x, line), _filtered(y, line)
    vx, vy, cov = _filtered(x * x, line) - mx * mx, _filtered(y * y, line) - my * my, _filtered(x * y, line) - mx * my
    part = (2 * cov + c2) / (vx + vy + c2)
    return (part * (2 * mx * my + c1) / (mx * mx + my * my + c1)).mean(axis=(1, 2)), part.mean(axis=(1, 2))


def halved(x: np.ndarray) -> np.ndarray:
    """Means of two by two pixels; an odd last line is left out."""
    h, w = x.shape[1] // 2, x.shape[2] // 2
    return x[:, : 2 * h, : 2 * w].reshape(len(x), h, 2, w, 2).mean(axis=(2, 4))


def ms_ssim(rows: DataFrame, id_col: str, a: str, b: str, width: int, scales: int = 5, size: int = 11, sigma: float = 1.5, peak: float = 1.0) -> DataFrame:
    """id, ssim (of the finest scale), ms_ssim of two images as row-major arrays, by Gaussian windows (AGG-13).

    The parts of the finer scales and the whole similarity of the coarsest are multiplied, each to its weight; the weights of fewer scales than five are
    scaled to sum 1, and a negative part counts as 0. Rows without either image, with arrays of two lengths or with null elements have none. An image whose coarsest
    scale has no whole window raises.
    """
    line = window(size, sigma)
    weights = np.array(SCALES[:scales]) / sum(SCALES[:scales])

    def run(batches):
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(lengths):
                at = pa.array(np.flatnonzero(lengths == n))
                x, y = (batch.column(i).take(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), -1, width) for i in (1, 2))
                if min(x.shape[1:]) >> (scales - 1) < size:
                    raise ValueError(f"{x.shape[2]} x {x.shape[1]} pixels are too few for {scales} scales")
                first, out = None, np.ones(len(at))
                for scale, weight in enumerate(weights):
                    whole, part = similarity(x, y, line, peak)
                    first = whole if first is None else first
                    out *= np.maximum(whole if scale == scales - 1 else part, 0) ** weight
                    x, y = halved(x), halved(y)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(first), pa.array(out)], [id_col, "ssim", "ms_ssim"])

    same = (F.size(a) == F.size(b)) & ~F.exists(a, lambda v: v.isNull()) & ~F.exists(b, lambda v: v.isNull())
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull() & same).select(F.col(id_col).cast("long"), a, b).mapInArrow(run, f"{id_col} long, ssim double, ms_ssim double")
