import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import images, layers, pyramids
from granary.plans.checks import facts
from granary.sources import manifest


def pixels(spark, cells):
    n, h, w = cells.shape
    return spark.createDataFrame([(i, x, y, float(cells[i, y, x])) for i in range(n) for y in range(h) for x in range(w)], "image_id long, x int, y int, value double")


def grids(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["image_id"], r["y"], r["x"]] = r["value"]
    return out


@pytest.mark.parametrize(("shape", "size", "halo"), [((2, 20, 33), 8, 4), ((1, 7, 7), 8, 8), ((1, 40, 9), 5, 5)])
def test_tiled_blur_is_the_whole_one(spark, shape, size, halo):
    cells = np.random.default_rng(1).random(shape)
    work = pyramids.convolve(images.gaussian(0.8))
    want = np.stack([work(c) for c in cells])
    got = grids(pyramids.tiled(pixels(spark, cells).repartition(3), size, halo, work, margin=2), shape)
    assert np.abs(got - want).max() < 1e-12
    assert np.abs(grids(images.blurred(pixels(spark, cells), 0.8), shape) - want).max() < 1e-12


def test_seams_are_weighted(spark):
    cells = np.zeros((1, 16, 16))
    mean = lambda grid: np.full(grid.shape, grid.mean() + grid.shape[0])  # noqa: E731  work whose tiles do not agree
    got = grids(pyramids.tiled(pixels(spark, cells), 8, 4, mean), (1, 16, 16))
    assert (got == 12).all()  # two tiles a side, each with one halo
    cells[0, :, 8:] = 1
    got = grids(pyramids.tiled(pixels(spark, cells), 8, 4, lambda g: np.full(g.shape, g.mean())), (1, 16, 16))[0, 0]
    assert (np.diff(got) >= 0).all() and got[0] == pytest.approx(1 / 3) and got[-1] == pytest.approx(2 / 3)
    with pytest.raises(ValueError, match="halo"):
        pyramids.tiled(pixels(spark, cells), 4, 5, mean)
    assert pyramids.tiled(pixels(spark, cells).limit(0), 8, 4, mean).collect() == []


def test_haar_keeps_the_energy_and_turns_back(spark):
    cells = np.random.default_rng(2).random((1, 16, 8))
    df = pyramids.haar(pixels(spark, cells), 2)
    rows = df.collect()
    assert sum(r["value"] ** 2 for r in rows) == pytest.approx((cells**2).sum())
    bands = {(r["level"], r["band"]): np.zeros((16 >> r["level"], 8 >> r["level"])) for r in rows}
    for r in rows:
        bands[r["level"], r["band"]][r["y"], r["x"]] = r["value"]
    low = bands[2, "ll"]
    for level in (2, 1):
        out = np.zeros((low.shape[0] * 2, low.shape[1] * 2))
        for dy in (0, 1):
            for dx in (0, 1):
                h, v = 1 - 2 * dx, 1 - 2 * dy
                out[dy::2, dx::2] = (low + h * bands[level, "hl"] + v * bands[level, "lh"] + h * v * bands[level, "hh"]) / 2
        low = out
    assert low == pytest.approx(cells[0], abs=1e-12)
    assert not facts(df)["python"]


def sheets(spark, *pairs):
    return spark.createDataFrame([(i, None if a is None else a.ravel().tolist(), None if b is None else b.ravel().tolist()) for i, (a, b) in enumerate(pairs)], "id long, a array<double>, b array<double>")


def test_ms_ssim(spark):
    draw = np.random.default_rng(3)
    x = draw.random((176, 176))
    soft = np.stack([x, np.clip(x + 0.05 * draw.standard_normal(x.shape), 0, 1)])
    hard = np.clip(x + 0.3 * draw.standard_normal(x.shape), 0, 1)
    got = {r["id"]: r for r in pyramids.ms_ssim(sheets(spark, (x, x), (x, soft[1]), (x, hard), (x, None), (x, 1 - x)), "id", "a", "b", 176).collect()}
    assert got[0]["ms_ssim"] == pytest.approx(1) and got[0]["ssim"] == pytest.approx(1)
    assert 1 > got[1]["ms_ssim"] > got[2]["ms_ssim"] > got[4]["ms_ssim"] >= 0 and 3 not in got
    assert got[2]["ms_ssim"] > got[2]["ssim"]  # noise goes with the scales
    # one scale with an even window is the plain index with population moments
    line = np.full(7, 1 / 7)
    whole, _ = pyramids.similarity(x[None, :8, :8], hard[None, :8, :8], line)
    plain = layers.ssim(sheets(spark, (x[:8, :8], hard[:8, :8])), "id", "a", "b", 8).first()["ssim"]
    assert whole[0] == pytest.approx(plain, abs=0.03)
    with pytest.raises(Exception, match="too few"):
        pyramids.ms_ssim(sheets(spark, (x[:64, :64], x[:64, :64])), "id", "a", "b", 64).collect()
    assert pyramids.ms_ssim(sheets(spark, (x, x)).limit(0), "id", "a", "b", 176).collect() == []


def test_readiness(spark):
    tasks = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True), (5, True), (6, None), (7, True), (8, True), (9, True), (10, True), (3, False), (None, True)], "id long, done boolean")
    deps = [(3, 1), (4, 3), (5, 2), (7, 5), (8, 9), (9, 8), (10, 8), (4, 1), (4, 1), (6, 99), (2, None), (None, 1)]
    got = {r["id"]: (r["ready"], r["cyclic"]) for r in manifest.readiness(tasks, spark.createDataFrame(deps, "id long, dep long")).collect()}
    assert got == {
        1: (True, False), 2: (True, False), 3: (True, False), 4: (True, False), 5: (False, False), 6: (False, False), 7: (False, False),
        8: (True, True), 9: (True, True), 10: (True, False), None: (True, False),
    }
    none = manifest.readiness(tasks.limit(0), spark.createDataFrame([], "id long, dep long"))
    assert none.collect() == []


def test_a_long_chain_and_a_bridge(spark):
    deps = [(i + 1, i) for i in range(12)] + [(20, 21), (21, 20), (22, 21), (23, 22), (23, 24), (24, 23)]
    tasks = spark.createDataFrame([(i, i > 0) for i in range(25)], "id long, done boolean")
    got = {r["id"]: r for r in manifest.readiness(tasks, spark.createDataFrame(deps, "id long, dep long")).collect()}
    assert not any(got[i]["ready"] for i in range(1, 13)) and got[0]["ready"] and got[13]["ready"]
    assert [i for i in got if got[i]["cyclic"]].__len__() == 5 and got[22]["cyclic"]


def test_neighbourhoods_change_no_answer(spark):
    draw = np.random.default_rng(5)
    # some neighbourhoods of eight are closed, some have links to others, one is too large
    deps = [(8 * int(b) + int(i), 8 * int(b) + int(j)) for b, i, j in zip(draw.integers(0, 60, 300), draw.integers(0, 8, 300), draw.integers(0, 8, 300), strict=True)]
    deps += [(8, 17), (25, 17), (17, 90), (480, 3), (None, 3), (5, None), (300, 300)] + [(488 + i % 8, 488 + i // 8) for i in range(64)]
    tasks = [(int(i), bool(d) if i % 9 else None) for i, d in zip(draw.permutation(500), draw.random(500) < 0.8, strict=True) if i % 11] + [(16, True), (16, False), (None, True), (None, False), (900, False)]
    table, links = spark.createDataFrame(tasks, "id long, done boolean"), spark.createDataFrame(deps, "id long, dep long")
    plain = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = plain(manifest.readiness(table, links))
    assert len({r[1:] for r in want}) == 4
    for near in (lambda i: F.shiftright(i, 3), lambda i: F.lit(0), lambda i: F.nullif(i % 7, F.lit(3))):
        assert plain(manifest.readiness(table, links, near=near)) == want
    listed = table.where("id < 480").join(links.groupBy("id").agg(F.collect_list("dep").alias("deps")), "id", "left")
    links = listed.select("id", F.explode("deps").alias("dep"))
    assert plain(manifest.readiness(listed, "deps")) == plain(manifest.readiness(listed, "deps", near=lambda i: F.shiftright(i, 3))) == plain(manifest.readiness(listed, links))
    assert manifest.readiness(table.limit(0), links.limit(0), near=lambda i: i).collect() == []


def test_lines_of_orders_are_dealt_once(spark, data):
    from granary.queries import lines_ready

    spark.sparkContext.setJobGroup("lines", "lines_ready")
    rows = lines_ready(spark, data)
    rows.write.format("noop").mode("overwrite").save()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("lines"))
    spark.sparkContext.setJobGroup("", "")
    # level by level it takes a job or more for each line of the longest order
    assert jobs <= 12


def test_radial_spectrum(spark):
    h, w = 16, 16
    y, x = np.mgrid[0:h, 0:w]
    waves = [np.cos(2 * np.pi * 3 * x / w), np.cos(2 * np.pi * (3 * x + 4 * y) / w), np.random.default_rng(4).standard_normal((h, w)), np.zeros((h, w))]
    rows = spark.createDataFrame([(i, c.ravel().tolist()) for i, c in enumerate(waves)] + [(9, None)], "id long, v array<double>")
    spectrum = images.power_spectrum(rows, "id", "v", w)
    got = {}
    for r in images.radial(spectrum, w, h).collect():
        got.setdefault(r["image_id"], {})[r["ring"]] = (r["n"], r["power"])
    assert max(got[0], key=lambda k: got[0][k][1]) == 3 and max(got[1], key=lambda k: got[1][k][1]) == 5 and 9 not in got
    power = np.abs(np.fft.fft2(waves[2])) ** 2 / (h * w)
    f = np.hypot(*np.meshgrid(np.fft.fftfreq(w), np.fft.fftfreq(h)))
    ring = np.ceil(f * 16 - 1e-9)
    for k in range(1, 9):
        assert got[2][k] == ((ring == k).sum(), pytest.approx(power[ring == k].mean()))
    same = {r["image_id"]: r["correlation"] for r in images.radial_correlation(spectrum, spectrum.withColumn("power", 3 * F.col("power")), w, h).collect()}
    assert same[2] == pytest.approx(1) and same.get(3) is None
