"""Losses, scores and distribution distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def errors(a: Column, b: Column) -> list[Column]:
    """l1, mse, rmse, psnr (peak 1) of two columns of samples (AGG-07, AGG-08, AGG-14)."""
    square = F.avg((a - b) * (a - b))
    return [F.avg(F.abs(a - b)).alias("l1"), square.alias("mse"), F.sqrt(square).alias("rmse"), (-10 * F.log10(F.nullif(square, F.lit(0.0)))).alias("psnr")]


def kl(mu: Column, logvar: Column) -> Column:
    """Mean divergence of a diagonal Gaussian from the standard one (AGG-09)."""
    return -0.5 * F.avg(1 + logvar - mu * mu - F.exp(logvar))


def lsgan(p: Column) -> Column:
    return F.avg((p - 1) * (p - 1))


def weighted_total(values: DataFrame, weights: DataFrame, *keys: str) -> DataFrame:
    """Sum of value times weight by key; an unknown name weighs 0 (JOIN-06, AGG-12)."""
    both = values.join(weights, "name", "left")
    return both.groupBy(*keys).agg(F.sum(F.coalesce("weight", F.lit(0.0)) * F.col("value")).alias("total"))


def histogram_emd(rows: DataFrame, side: str, value: str, low: float, high: float, bins: int = 32) -> DataFrame:
    """Distance of two samples' binned distributions: the sum over bins of the distance of their running shares, in bin widths (AGG-19).

    ``side`` is 'a' or 'b'. Values outside the range count in the outer bins; the bins are ours.
    """
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / F.lit((high - low) / bins)))).cast("int")
    counts = rows.where(F.col(value).isNotNull()).groupBy(place.alias("bin")).agg(F.count_if(F.col(side) == "a").alias("a"), F.count_if(F.col(side) == "b").alias("b"))
    # a row for each bin: one small partition
    running = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").fillna(0)
    whole = Window.partitionBy()
    gap = F.abs(F.try_divide(F.sum("a").over(running), F.sum("a").over(whole)) - F.try_divide(F.sum("b").over(running), F.sum("b").over(whole)))
    return every.select(gap.alias("gap")).agg(F.sum("gap").alias("emd"))


def moments(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """group, n, mean, second (upper moment matrix by rows) from partial sums of each Arrow batch."""

    def run(batches):
        sums: dict = {}
        for batch in batches:
            groups = batch.column(0).to_pylist()
            x = np.array(batch.column(1).to_pylist(), float)
            for g in set(groups):
                part = x[[k == g for k in groups]]
                n, s, q = sums.get(g, (0, 0.0, 0.0))
                sums[g] = n + len(part), s + part.sum(axis=0), q + part.T @ part
        for g, (n, s, q) in sums.items():
            yield pa.RecordBatch.from_pydict({"g": pa.array([g], pa.int64()), "n": [n], "s": [s.tolist()], "q": [q.ravel().tolist()]})

    part = rows.where(F.col(vector).isNotNull()).select(F.col(group).cast("long").alias("g"), vector).mapInArrow(run, "g long, n long, s array<double>, q array<double>")
    flat = part.select("g", "n", F.posexplode(F.concat("s", "q")).alias("i", "v"))
    total = flat.groupBy("g", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    return total.groupBy("g").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("sums"))


def frechet(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Frechet distance of two Gaussians from means and covariances (AGG-16)."""
    (ma, ca), (mb, cb) = a, b

    def root(m):
        w, v = np.linalg.eigh(m)
        return (v * np.sqrt(np.clip(w, 0, None))) @ v.T

    ra = root(ca)
    cross = np.linalg.eigvalsh(ra @ cb @ ra)
    return float(((ma - mb) ** 2).sum() + np.trace(ca) + np.trace(cb) - 2 * np.sqrt(np.clip(cross, 0, None)).sum())


def fid(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """a, b, fid of every pair of groups; a group of nulls comes first. The pairs are computed in tasks."""

    def gaussian(sums: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        d = int((np.sqrt(1 + 4 * len(sums)) - 1) / 2)
        mean = sums[:d] / n
        return mean, (sums[d:].reshape(d, d) - n * np.outer(mean, mean)) / max(n - 1, 1)

    def run(batches):
        for batch in batches:
            na, nb = batch.column(1).to_pylist(), batch.column(4).to_pylist()
            of = lambda column, i: column[i].values.to_numpy(zero_copy_only=False)
            found = [frechet(gaussian(of(batch.column(2), i), na[i]), gaussian(of(batch.column(5), i), nb[i])) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(found, pa.float64())], ["a", "b", "fid"])

    told = moments(rows, group, vector)
    one = told.select(F.col("g").alias("a"), F.col("n").alias("na"), F.col("sums").alias("of_a"))
    two = told.select(F.col("g").alias("b"), F.col("n").alias("nb"), F.col("sums").alias("of_b"))
    pairs = one.join(two, (F.col("a") < F.col("b")) | (F.col("a").isNull() & F.col("b").isNotNull()))
    return pairs.mapInArrow(run, "a long, b long, fid double")


def preference(trials: DataFrame, pair: str, choice: str, z: float = 1.96) -> DataFrame:
    """Preference rate of each pair with a Wilson interval (AGG-22; the interval is ours)."""
    out = trials.groupBy(pair).agg(F.count(choice).alias("n"), F.avg(choice).alias("rate"))
    n, p = F.col("n"), F.col("rate")
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return out.withColumn("low", (middle - half) / (1 + z * z / n)).withColumn("high", (middle + half) / (1 + z * z / n))


def opinion(scores: DataFrame, key: str, score: str) -> DataFrame:
    """Mean opinion score and its deviation (AGG-23)."""
    return scores.groupBy(key).agg(F.count(score).alias("n"), F.avg(score).alias("mos"), F.stddev_samp(score).alias("sd"))


def roughness(curve: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Mean squared second difference along a curve (AGG-25)."""
    w = Window.partitionBy(key).orderBy(order)
    second = F.lag(value).over(w) - 2 * F.col(value) + F.lead(value).over(w)
    return curve.withColumn("second", second).groupBy(key).agg(F.avg(F.col("second") * F.col("second")).alias("roughness"))


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* (D65) of linear sRGB columns."""
    x = (0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047
    y = 0.2126729 * r + 0.7151522 * g + 0.0721750 * b
    z = (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883
    f = lambda t: F.when(t > (6 / 29) ** 3, F.cbrt(t)).otherwise(t / (3 * (6 / 29) ** 2) + 4 / 29)
    return 116 * f(y) - 16, 500 * (f(x) - f(y)), 200 * (f(y) - f(z))


def delta_e76(one: tuple[Column, Column, Column], two: tuple[Column, Column, Column]) -> Column:
    """Euclidean distance in L*a*b*."""
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(one, two, strict=True)), F.lit(0.0)))


def delta_e2000(one: tuple[Column, Column, Column], two: tuple[Column, Column, Column]) -> Column:
    """CIEDE2000 with unit weights (AGG-18)."""
    (l1, a1, b1), (l2, a2, b2) = one, two
    mean_c = (F.hypot(a1, b1) + F.hypot(a2, b2)) / 2
    g = 0.5 * (1 - F.sqrt(F.pow(mean_c, F.lit(7)) / (F.pow(mean_c, F.lit(7)) + 25.0**7)))
    u1, u2 = a1 * (1 + g), a2 * (1 + g)
    c1, c2 = F.hypot(u1, b1), F.hypot(u2, b2)
    hue = lambda u, b: F.pmod(F.degrees(F.atan2(b, u)), F.lit(360.0))
    h1, h2 = F.when((u1 == 0) & (b1 == 0), 0.0).otherwise(hue(u1, b1)), F.when((u2 == 0) & (b2 == 0), 0.0).otherwise(hue(u2, b2))
    grey, d = c1 * c2 == 0, h2 - h1
    turn = F.when(grey, 0.0).when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)
    total = h1 + h2
    mean_h = F.when(grey, total).when(F.abs(d) <= 180, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2)
    dl, dc, dh = l2 - l1, c2 - c1, 2 * F.sqrt(c1 * c2) * F.sin(F.radians(turn / 2))
    ml, mc = (l1 + l2) / 2, (c1 + c2) / 2
    cos = lambda angle: F.cos(F.radians(angle))
    t = 1 - 0.17 * cos(mean_h - 30) + 0.24 * cos(2 * mean_h) + 0.32 * cos(3 * mean_h + 6) - 0.20 * cos(4 * mean_h - 63)
    sl = 1 + 0.015 * (ml - 50) * (ml - 50) / F.sqrt(20 + (ml - 50) * (ml - 50))
    sc, sh = 1 + 0.045 * mc, 1 + 0.015 * mc * t
    rt = -2 * F.sqrt(F.pow(mc, F.lit(7)) / (F.pow(mc, F.lit(7)) + 25.0**7)) * F.sin(F.radians(60 * F.exp(-((mean_h - 275) / 25) * ((mean_h - 275) / 25))))
    x, y, z = dl / sl, dc / sc, dh / sh
    return F.sqrt(x * x + y * y + z * z + rt * y * z)


def kid(rows: DataFrame, id_col: str, vector: str, side, block: int = 256) -> DataFrame:
    """Unbiased polynomial-kernel discrepancy of the rows of side 0 and side 1 (AGG-17): mean and deviation over blocks.

    Each side's rows are ranked by a hash of their id (over hash buckets, then within them) and dealt evenly
    into blocks, so every block has both sides and every row counts in one. The kernel matrix of a block of about
    ``block`` rows is its only quadratic part. Rows without a vector or a side are left out; a side of one row or none gives no block.
    """
    dealt = rows.where(F.col(vector).isNotNull() & side.isNotNull()).select(F.xxhash64(F.col(id_col)).alias("h"), F.col(id_col).alias("i"), side.cast("int").alias("s"), F.col(vector).alias("v"))
    bucket = F.pmod("h", F.lit(1024)).alias("b")
    sizes = dealt.groupBy("s", bucket).agg(F.count(F.lit(1)).alias("n"))
    # a row for each side and bucket
    starts = sizes.select("s", "b", F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    totals = {r["s"]: r["n"] for r in sizes.where("s IN (0, 1)").groupBy("s").agg(F.sum("n").alias("n")).collect()}
    least = min(totals.get(0, 0), totals.get(1, 0))
    blocks = max(1, min(sum(totals.values()) // block, least // 2))

    def one(frame):
        x, y = (np.stack(part.to_numpy()).astype(float) if len(part) else np.zeros((0, 1)) for part in (frame["v"][frame["s"] == 0], frame["v"][frame["s"] == 1]))
        if min(len(x), len(y)) < 2:
            return frame.iloc[:0].assign(mmd=0.0)[["mmd"]]
        k = lambda a, b: (a @ b.T / a.shape[1] + 1) ** 3
        alone = lambda a: (k(a, a).sum() - np.trace(k(a, a))) / (len(a) * (len(a) - 1))
        return frame.iloc[:1].assign(mmd=alone(x) + alone(y) - 2 * k(x, y).mean())[["mmd"]]

    within = F.row_number().over(Window.partitionBy("s", "b").orderBy("h", "i")) - 1
    ranked = dealt.withColumn("b", bucket).withColumn("within", within).join(F.broadcast(starts), ["s", "b"])
    found = ranked.select(F.pmod(F.col("start") + F.col("within"), F.lit(blocks)).alias("part"), "s", "v").groupBy("part").applyInPandas(one, "mmd double")
    return found.agg(F.count(F.lit(1)).alias("blocks"), F.avg("mmd").alias("kid"), F.stddev_samp("mmd").alias("sd"))


def memory_estimate(parts: DataFrame, key: str, size: str, target: float, margin: float, factor: float = 3.5) -> DataFrame:
    """key, needed (the sum of sizes times a factor) and fits: whether that is at most the target less a margin (AGG-26)."""
    needed = F.sum(F.col(size).cast("double")) * F.lit(factor)
    return parts.groupBy(key).agg(needed.alias("needed")).withColumn("fits", F.col("needed") <= F.lit(float(target - margin)))


def throughput(rows: DataFrame, time: str, *keys: str) -> DataFrame:
    """Rows by key and their rate a second, over one second at least (AGG-01)."""
    seconds = (F.unix_micros(F.max(F.col(time).cast("timestamp"))) - F.unix_micros(F.min(F.col(time).cast("timestamp")))) / 1e6
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.greatest(seconds, F.lit(1.0))).alias("rate"))


def ema(rows: DataFrame, key: str, bucket: str, order: list[str], value: str, decay: float) -> DataFrame:
    """n and the last exponential moving average of each key, which starts at its first value (WIN-05).

    The average is a sum with weights by rank from the end. Ranks are summed in two steps, over the
    buckets of a key (a coarser column in the same order, such as the day) and within them, so that no
    task holds a whole key.
    """
    sizes = rows.groupBy(key, bucket).agg(F.count(F.lit(1)).alias("size"))
    over = Window.partitionBy(key)
    later = over.orderBy(F.col(bucket).desc()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(key).alias("of"), F.col(bucket).alias("at"), F.coalesce(F.sum("size").over(later), F.lit(0)).alias("after"), F.sum("size").over(over).alias("n"))
    within = F.row_number().over(Window.partitionBy(key, bucket).orderBy(*[F.col(c).desc() for c in order])) - 1
    placed = rows.withColumn("within", within).join(sizes, F.col(key).eqNullSafe(F.col("of")) & F.col(bucket).eqNullSafe(F.col("at")))
    back = F.col("after") + F.col("within")
    weight = F.pow(F.lit(decay), back) * F.when(back == F.col("n") - 1, 1.0).otherwise(1 - decay)
    return placed.groupBy(key).agg(F.max("n").alias("n"), F.sum(F.col(value) * weight).alias("ema"))
