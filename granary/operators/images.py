"""Small images as tall rows (image_id, x, y, value) and the convolutions over them.

Every operator is keyed by image_id: how rows lie in partitions never changes a result. Beyond the
borders images are 0.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LAPLACIAN = {(-1, 0): 1.0, (1, 0): 1.0, (0, -1): 1.0, (0, 1): 1.0, (0, 0): -4.0}


#: Cells (pixels of vectors) that a task is meant to expand; their tall rows take some hundred bytes each where they are summed.
CELLS_A_TASK = 1 << 18


def dealt(rows: DataFrame, id_col: str, cells: int) -> DataFrame:
    """``rows``, each of which will become so many tall rows, dealt by id to as many tasks as keep those tall rows bounded.

    Vectors are moved while they are compact, and what is summed by the id or joined by it stays where it is.
    """
    parts = max(-(-rows.count() * cells // CELLS_A_TASK), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(parts, id_col)


def pixels(rows: DataFrame, id_col: str, vector: str, width: int) -> DataFrame:
    """Row-major vectors as pixels (PRJ-07)."""
    rows = dealt(rows.select(F.col(id_col).cast("long").alias("image_id"), F.col(vector).alias("v")), "image_id", width * width)
    cells = rows.select("image_id", F.posexplode("v").alias("i", "v"))
    return cells.select("image_id", (F.col("i") % width).alias("x"), F.floor(F.col("i") / width).cast("int").alias("y"), F.col("v").cast("double").alias("value"))


def gaussian(sigma: float, size: int | None = None) -> dict[tuple[int, int], float]:
    """Weights of a Gaussian kernel by offset, with sum 1."""
    size = size or int(6 * sigma + 1) // 2 * 2 + 1
    r = size // 2
    raw = {(dx, dy): math.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma)) for dx in range(-r, r + 1) for dy in range(-r, r + 1)}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()}


def spread(image: DataFrame, kernel: dict[tuple[int, int], float]) -> DataFrame:
    """Each pixel's share for each of its neighbours by the (symmetric) kernel, and a row with inside for the pixel itself."""
    entry = lambda dx, dy, w, inside: F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(w)).alias("w"), F.lit(inside).alias("inside"))
    offsets = F.array(entry(0, 0, 0.0, True), *[entry(dx, dy, w, False) for (dx, dy), w in kernel.items()])
    rows = image.select("image_id", "x", "y", "value", F.explode(offsets).alias("o"))
    value = F.when(F.col("o.inside"), F.lit(0.0)).otherwise(F.col("value") * F.col("o.w"))
    return rows.select("image_id", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), value.alias("value"), F.col("o.inside").alias("inside"))


def convolved(image: DataFrame, kernel: dict[tuple[int, int], float]) -> DataFrame:
    """Each pixel is spread to its neighbours by the (symmetric) kernel and summed there (WIN-06).

    One pass over the image, with partial sums; one shuffle unless its rows lie by image. Values that fall outside are dropped: no pixel of the image marks their place.
    """
    summed = spread(image, kernel).groupBy("image_id", "x", "y").agg(F.sum("value").alias("value"), F.bool_or("inside").alias("inside"))
    return summed.where("inside").drop("inside")


def blurred(image: DataFrame, sigma: float, size: int | None = None) -> DataFrame:
    """Gaussian blur. Kernels over 7 wide go as two one-dimensional passes: 2 k rows for each pixel, not k * k; smaller ones in one shuffle."""
    size = size or int(6 * sigma + 1) // 2 * 2 + 1
    if size <= 7:
        return convolved(image, gaussian(sigma, size))
    raw = {d: math.exp(-d * d / (2 * sigma * sigma)) for d in range(-(size // 2), size // 2 + 1)}
    line = {d: w / sum(raw.values()) for d, w in raw.items()}
    return convolved(convolved(image, {(d, 0): w for d, w in line.items()}), {(0, d): w for d, w in line.items()})


def highlights(image: DataFrame, k: float = 1.5, batch: str = "image_id") -> DataFrame:
    """Pixels above mean + k sample standard deviations of the image, or of an explicit batch column (FLT-10, AGG-06)."""
    stats = image.groupBy(batch).agg((F.avg("value") + k * F.stddev_samp("value")).alias("level"))
    return image.join(stats, batch).where("value > level")


def halation(image: DataFrame, sigma: float, intensity: float, k: float = 1.5) -> DataFrame:
    """Highlights, blurred and added at an intensity (WIN-07); rows that share a place each get the glow of their number.

    Pixels and glow meet in a window, which stays where the rows lie; a join would deal both anew.
    """
    at = ["image_id", "x", "y"]
    stats = image.groupBy("image_id").agg((F.avg("value") + k * F.stddev_samp("value")).alias("level"))
    bright = image.join(stats, "image_id").select(*at, F.when(F.col("value") > F.col("level"), F.col("value")).otherwise(0.0).alias("value"))
    glow = blurred(bright, sigma).select(*at, F.lit(None).cast("double").alias("value"), F.col("value").alias("glow"), F.lit(0).alias("own"))
    both = image.select(*at, "value", F.lit(None).cast("double").alias("glow"), F.lit(1).alias("own")).unionByName(glow)
    place = Window.partitionBy(*at)
    both = both.withColumn("glow", F.sum("glow").over(place) * F.sum("own").over(place)).where("own = 1")
    return both.select(*at, (F.col("value") + intensity * F.col("glow")).alias("value"))


def dir_contrast(image: DataFrame, sigma: float, strength: float, threshold: float) -> DataFrame:
    """Where the Laplacian exceeds the threshold, add strength times the difference from the blur (WIN-08, PRJ-15)."""
    at = ["image_id", "x", "y"]
    edge = convolved(image, LAPLACIAN).withColumnRenamed("value", "edge")
    blur = blurred(image, sigma).withColumnRenamed("value", "blur")
    mask = F.when(F.abs("edge") > threshold, 1.0).otherwise(0.0)
    return image.join(edge, at).join(blur, at).select(*at, (F.col("value") + strength * mask * (F.col("value") - F.col("blur"))).alias("value"))


def tiles(image: DataFrame, size: int) -> DataFrame:
    """Count, mean and extremes of each tile (PRJ-35)."""
    key = [F.floor(F.col(c) / size).cast("int").alias(f"tile_{c}") for c in ("x", "y")]
    return image.groupBy("image_id", *key).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


def flipped(image: DataFrame, width: int) -> DataFrame:
    """Mirrored left to right (PRJ-27)."""
    return image.withColumn("x", F.lit(width - 1) - F.col("x"))


def cropped(image: DataFrame, x: int, y: int, size: int) -> DataFrame:
    """The square from (x, y), moved to the origin (PRJ-27)."""
    inside = F.col("x").between(x, x + size - 1) & F.col("y").between(y, y + size - 1)
    return image.where(inside).withColumn("x", F.col("x") - x).withColumn("y", F.col("y") - y)


def power_spectrum(rows: DataFrame, id_col: str, vector: str, width: int) -> DataFrame:
    """image_id, u, v, power: squared magnitude of the two-dimensional transform over the pixel count (AGG-20); a null vector has none."""

    def run(batches):
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            if not len(ids):
                continue
            cells = np.array(batch.column(1).to_pylist(), float).reshape(len(ids), -1, width)
            power = np.abs(np.fft.fft2(cells)) ** 2 / (cells.shape[1] * width)
            height = cells.shape[1]
            v, u = np.mgrid[0:height, 0:width]
            tile = lambda a: np.tile(a.ravel(), len(ids)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"image_id": np.repeat(ids, height * width), "u": tile(u), "v": tile(v), "power": power.ravel()})

    return rows.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long"), vector).mapInArrow(run, "image_id long, u int, v int, power double")


def radial(spectrum: DataFrame, width: int, height: int, rings: int | None = None) -> DataFrame:
    """image_id, ring, n, power: the mean power of a spectrum (image_id, u, v, power) by distance from the constant frequency, in ``rings`` even steps up to the shorter side's half (AGG-20).

    Frequencies beyond the middle are negative ones; those in the corners, beyond the last ring, are left out, as is the constant one. One shuffle with partial means.
    """
    rings = rings or min(width, height) // 2
    folded = lambda c, n: F.least(F.col(c), F.lit(n) - F.col(c)) / F.lit(float(n))
    at = F.hypot(folded("u", width), folded("v", height))
    ring = F.ceil(at * 2 * rings - 1e-9).cast("int")
    return spectrum.withColumn("ring", ring).where(F.col("ring").between(1, rings)).groupBy("image_id", "ring").agg(F.count(F.lit(1)).alias("n"), F.avg("power").alias("power"))


def radial_correlation(one: DataFrame, two: DataFrame, width: int, height: int, rings: int | None = None) -> DataFrame:
    """image_id, correlation of the logarithms of two spectra's rings (AGG-20); rings without power have none, and images with fewer than two such rings a null."""
    a, b = radial(one, width, height, rings), radial(two, width, height, rings).select("image_id", "ring", F.col("power").alias("other"))
    both = a.join(b, ["image_id", "ring"]).where("power > 0 AND other > 0")
    return both.groupBy("image_id").agg(F.corr(F.log("power"), F.log("other")).alias("correlation"))


def spectrum_correlation(one: DataFrame, two: DataFrame) -> DataFrame:
    """image_id, correlation of two power spectra over their frequencies, the constant one left out (AGG-20)."""
    at = ["image_id", "u", "v"]
    both = one.join(two.select(*at, F.col("power").alias("other")), at).where("u > 0 OR v > 0")
    return both.groupBy("image_id").agg(F.corr("power", "other").alias("correlation"))


def grain(image: DataFrame, width: int, height: int, strength: float, fc: float, p: float, seed: int = 0) -> DataFrame:
    """Seeded white noise, filtered in frequency, weighted by mid-tone exposure and added (WIN-09).

    The filter is applied to the unshifted spectrum. The noise of an image depends on its id and the
    seed alone. Each group is one image of width times height pixels.
    """
    power = min(max(p, 0.5), 2.0)

    def one(frame):
        noise = np.random.default_rng([seed, int(frame["image_id"].iloc[0]) & 0xFFFFFFFF]).standard_normal((height, width))
        f = np.hypot(*np.meshgrid(np.fft.fftfreq(width), np.fft.fftfreq(height)))
        shaped = np.fft.ifft2(np.fft.fft2(noise) / (1 + (f / fc) ** 2) ** (power / 2)).real
        value = frame["value"].to_numpy()
        weight = 1 - 2 * np.abs(value - 0.5)
        return frame.assign(value=value + strength * weight * shaped[frame["y"].to_numpy(), frame["x"].to_numpy()])

    return image.groupBy("image_id").applyInPandas(one, "image_id long, x int, y int, value double")


def granularity(image: DataFrame) -> DataFrame:
    """RMS granularity: 1000 times the population deviation of density (AGG-27)."""
    return image.groupBy("image_id").agg((1000 * F.stddev_pop("value")).alias("rms"))
