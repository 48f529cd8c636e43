import itertools
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import film, paths, vectors
from granary.operators import images, metrics, pairing
from granary.sources import fetch, links, manifest
from granary.streaming import progress


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.array(*[F.lit(float(x)) for x in v]) if isinstance(v, list) else F.lit(v))
    return df.select(column.alias("out")).collect()[0]["out"]


def test_vector_goldens(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, vectors.interpolate(a, b, F.lit(0.25)), a=[0, 0], b=[1, 2]) == [0.25, 0.5]
    assert one(spark, vectors.minus(b, a), a=[0, 0], b=[1, 2]) == [1, 2]
    assert one(spark, vectors.euler(a, lambda x, t: F.array(F.lit(1.0), F.lit(1.5)), 3), a=[0, 0.5]) == pytest.approx([1.0, 2.0])
    assert one(spark, vectors.gated(F.col("g"), a, b), g=[0, 1], a=[1, 1], b=[5, 5]) == [5, 1]
    assert one(spark, vectors.recurrence(a, 0.9), a=[1, 2]) == pytest.approx([1, 1.1])
    assert one(spark, vectors.recurrence(F.array().cast("array<double>"), 0.9)) == []
    assert one(spark, vectors.cosine(a, b), a=[0, 0], b=[1, 2]) is None
    assert len(one(spark, vectors.sinusoidal(F.lit(0.5), 8))) == 8
    assert one(spark, vectors.scaled(a, 0.18215), a=[2]) == pytest.approx([0.3643])


def test_film_goldens(spark):
    assert [one(spark, film.kernel_size(F.lit(s))) for s in (21, 13, 7)] == [127, 79, 43]
    assert one(spark, film.spectrum_filter(F.lit(0.12), 0.12, F.lit(1.2))) == pytest.approx(2**-0.6)
    assert [one(spark, film.midtone(F.lit(e))) for e in (0.0, 0.5, 1.0)] == [0, 1, 0]
    assert one(spark, film.log_exposure(F.lit(0.0))) == pytest.approx(-6)
    assert one(spark, film.log_exposure(F.lit(None).cast("double"))) is None
    assert one(spark, film.bit_depth(F.lit(65535), 16)) == 1.0


def test_paths(spark):
    assert one(spark, paths.drop_first(F.lit("Set/a/b.png"))) == "a/b.png"
    assert one(spark, paths.drop_first(F.lit("b.png"))) == ""
    assert one(spark, paths.quote_path(F.lit("a b/c~d.tif"))) == "a%20b/c~d.tif"
    assert one(spark, paths.query(path=F.lit("a b/c"))) == "path=a+b%2Fc"


#: Published test pairs of the colour difference formula (L, a, b twice, difference).
PAIRS = [
    (50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425),
    (50.0, 3.1571, -77.2803, 50.0, 0.0, -82.7485, 2.8615),
    (50.0, -1.3802, -84.2814, 50.0, 0.0, -82.7485, 1.0),
    (50.0, 0.0, 0.0, 50.0, -1.0, 2.0, 2.3669),
    (50.0, 2.49, -0.001, 50.0, -2.49, 0.0009, 7.1792),
    (50.0, 2.5, 0.0, 73.0, 25.0, -18.0, 27.1492),
    (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644),
    (2.0776, 0.0795, -1.135, 0.9033, -0.0636, -0.5514, 0.9082),
]


@pytest.mark.parametrize("pair", PAIRS)
def test_delta_e2000(spark, pair):
    c = [F.lit(x) for x in pair[:6]]
    assert one(spark, metrics.delta_e2000(tuple(c[:3]), tuple(c[3:]))) == pytest.approx(pair[6], abs=1e-4)


def test_assignment_is_optimal():
    random = np.random.default_rng(1)
    for n in range(1, 7):
        cost = random.random((n, n))
        to = pairing.assignment(cost)
        assert sorted(to) == list(range(n))
        assert cost[np.arange(n), to].sum() == pytest.approx(min(cost[np.arange(n), list(p)].sum() for p in itertools.permutations(range(n))))


def test_transport_bound(spark):
    rows = spark.range(5).select(F.lit(0).alias("b"), "id", F.array(F.lit(1.0)).alias("x"), F.array(F.lit(2.0)).alias("y"))
    with pytest.raises(Exception, match="over 4"):
        pairing.transport(rows, "b", "id", "x", "y", largest=4).collect()


def test_search_by_blocks(spark):
    random = np.random.default_rng(2)
    x = random.random((300, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    got = {(r["id"], r["rank"]): r["other"] for r in pairing.search(rows.where("id < 7"), rows, "id", "v", 3, block=2).collect()}
    for q in range(7):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        assert [got[q, k] for k in (1, 2, 3)] == np.argsort(d)[:3].tolist()
    assert pairing.search(rows.where("id < 0"), rows, "id", "v", 3).count() == 0


def test_frechet_of_equal_and_shifted():
    eye = np.eye(3)
    assert metrics.frechet((np.zeros(3), eye), (np.zeros(3), eye)) == pytest.approx(0)
    assert metrics.frechet((np.zeros(3), eye), (np.ones(3), 4 * eye)) == pytest.approx(3 + 3)


def test_fid_of_more_than_512_groups(spark):
    rows = spark.range(2 * 520).selectExpr("id % 520 AS g", "array(CAST(id AS DOUBLE), CAST(id % 7 AS DOUBLE)) AS v")
    assert metrics.fid(rows, "g", "v").count() == 520 * 519 // 2


def test_fid_against_numpy(spark):
    random = np.random.default_rng(3)
    x = random.random((60, 3))
    rows = spark.createDataFrame([(i % 2, v.tolist()) for i, v in enumerate(x)], "g int, v array<double>").repartition(4)
    a, b = x[::2], x[1::2]
    want = metrics.frechet((a.mean(0), np.cov(a.T)), (b.mean(0), np.cov(b.T)))
    assert metrics.fid(rows, "g", "v").collect()[0]["fid"] == pytest.approx(want)


def test_kid_against_all_pairs(spark):
    random = np.random.default_rng(4)
    x = random.random((40, 3))
    rows = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "id long, s int, v array<double>")
    k = lambda p, q: (float(np.dot(p, q)) / 3 + 1) ** 3
    a, b = x[::2], x[1::2]
    alone = lambda s: np.mean([k(p, q) for i, p in enumerate(s) for j, q in enumerate(s) if i != j])
    want = alone(a) + alone(b) - 2 * np.mean([k(p, q) for p in a for q in b])
    assert metrics.kid(rows, "id", "v", F.col("s"), block=1000).collect()[0]["kid"] == pytest.approx(want)


def test_weighted_total_ignores_unknown_names(spark):
    values = spark.createDataFrame([("l1", 1.0), ("ssim", 1.0), ("lpips", 1.0), ("other", 9.0)], "name string, value double")
    weights = spark.createDataFrame([("l1", 1.0), ("ssim", 0.5), ("lpips", 2.0)], "name string, weight double")
    assert metrics.weighted_total(values, weights).collect()[0]["total"] == 3.5


def test_kl_and_lsgan(spark):
    rows = spark.createDataFrame([(1.0, 0.0, 0.0), (0.0, 0.0, 1.0)], "mu double, lv double, p double")
    got = rows.agg(metrics.kl(F.col("mu"), F.col("lv")).alias("kl"), metrics.lsgan(F.col("p")).alias("g")).collect()[0]
    assert (got["kl"], got["g"]) == (0.25, 0.5)


def test_fetch_is_idempotent(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.bin").write_bytes(b"abc")
    jobs = spark.createDataFrame([(f"file://{tmp_path}/src/a.bin", f"{tmp_path}/out/a.bin"), (f"file://{tmp_path}/src/none", f"{tmp_path}/out/none")], "url string, dest string")
    first = {r["path"]: (r["changed"], r["status"]) for r in fetch.fetched(jobs, 2).collect()}
    assert first[f"{tmp_path}/out/a.bin"] == (True, "ok")
    assert first[f"{tmp_path}/out/none"][0] is False and "Error" in first[f"{tmp_path}/out/none"][1]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.bin"]
    again = {r["path"]: r["status"] for r in fetch.fetched(jobs, 1).collect()}
    assert again[f"{tmp_path}/out/a.bin"] == "exists"


def test_archives_listings_and_anchors(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.txt", "one")
        z.writestr("y.txt", "")
    members = links.unpacked(spark.read.format("binaryFile").load(str(tmp_path / "a.zip"))).collect()
    assert sorted((r["member"], r["length"]) for r in members) == [("d/x.txt", 3), ("y.txt", 0)]
    body = json.dumps({"datasetFiles": [{"name": "a"}, {"name": ""}, {}, {"name": "b"}], "nextPageToken": "t"})
    rows = links.listing(spark.createDataFrame([(1, body), (2, "{}")], "page int, body string")).collect()
    assert [(r["page"], r["name"], r["next_token"]) for r in rows] == [(1, "a", "t"), (1, "b", "t")]
    pages = spark.createDataFrame([(1, "<a href='x'>1</a><A class=k href=\"y&amp;z\">2</A><area href=q><a>3</a>"), (2, None)], "page_id long, html string")
    assert [(r["pos"], r["href"]) for r in links.anchors_strict(pages).orderBy("pos").collect()] == [(0, "x"), (1, "y&z")]
    assert [r["name"] for r in links.numbered(spark, 2, "f_%02d.txt").collect()] == ["f_00.txt", "f_01.txt"]
    assert links.decoded(spark.createDataFrame([(bytearray(b"a\xff"),), (None,)], "content binary")).orderBy("text").collect()[1]["text"] == "a�"


def test_strict_and_pattern_anchors_agree(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    pick = lambda df: sorted((r["page_id"], r["pos"], r["href"]) for r in df.collect())
    assert pick(links.anchors(pages)) == pick(links.anchors_strict(pages))


def test_limit_zero_means_all(spark):
    assert links.first(spark.range(5), 0, "id").count() == 5
    assert [r["id"] for r in links.first(spark.range(5), 2, "id").collect()] == [0, 1]
    parts = spark.createDataFrame([("a",), ("b",)], "k string")
    assert (links.selected(parts, F.col("k"), "all").count(), links.selected(parts, F.col("k"), "a").count()) == (2, 1)


def test_manifest_round_trip(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"id": "a", "source": "s", "license": "l", "task": "t", "style": "y", "weight": 0.7, "redistributable": true}\n{"id": "b"}\n')
    rows = manifest.with_split(manifest.read(spark, str(tmp_path / "m.jsonl")), "id")
    assert {r["id"]: len(r["missing"]) for r in manifest.violations(rows).collect()} == {"b": 5}
    manifest.write(rows, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 2
    split = rows.where("id = 'a'").collect()[0]["split"]
    assert "PartitionFilters: [isnotnull(split" in back.where(F.col("split") == split)._jdf.queryExecution().toString()
    files = manifest.digests(spark.createDataFrame([(bytearray(b""),)], "content binary")).collect()[0]
    assert files["sha1"] == "da39a3ee5e6b4b0d3255bfef95601890afd80709"


def test_grain_depends_on_id_and_seed_only(spark):
    rows = spark.createDataFrame([(i, [0.5] * 64) for i in range(3)], "id long, v array<double>")
    run = lambda n: sorted(map(tuple, images.grain(images.pixels(rows.repartition(n), "id", "v", 8), 8, 8, 0.1, 0.12, 1.2).collect()))
    first = run(1)
    assert first == run(3)
    values = {i: [r[3] for r in first if r[0] == i] for i in range(3)}
    assert values[0] != values[1] and np.std(values[0]) > 0


def test_ema_matches_a_loop(spark):
    random = np.random.default_rng(5)
    rows = [(i % 3, i // 40, i, float(random.random())) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, day int, t int, v double").repartition(5)
    got = {r["k"]: r["ema"] for r in metrics.ema(df, "k", "day", ["t"], "v", 0.9).collect()}
    for k in range(3):
        s = None
        for _, _, _, v in (r for r in rows if r[0] == k):
            s = v if s is None else 0.9 * s + 0.1 * v
        assert got[k] == pytest.approx(s)


def test_stream_reads_a_file_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "event_type string, value double")
    rows.write.parquet(f"{tmp_path}/in/events.parquet")
    out = f"{tmp_path}/state"
    assert progress.totals(spark, f"{tmp_path}/in", "events", out).where("event_type = 'a'").collect()[0]["n"] == 1
    rows.limit(1).write.mode("append").parquet(f"{tmp_path}/in/events.parquet")
    got = {r["event_type"]: r["n"] for r in progress.totals(spark, f"{tmp_path}/in", "events", out).collect()}
    assert got == {"a": 2, "b": 1}
    assert progress.stale(spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00' AS seen"), "seen", F.lit("2024-01-01 03:00:00").cast("timestamp")).count() == 1


def test_expanded_vectors_are_dealt_by_their_cells(spark, data, monkeypatch):
    from granary import queries
    from granary.operators import images

    monkeypatch.setattr(images, "CELLS_A_TASK", 64)
    rows = spark.range(40).selectExpr("id", "transform(sequence(0, 15), i -> id + i * 0.5) AS v")
    cells = images.pixels(rows, "id", "v", 4)
    assert cells.rdd.getNumPartitions() >= 10  # 640 cells
    for query in (queries.halation, queries.gaussian_blur):
        plan = query(spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_halation_of_rows_at_one_place(spark, duck):
    from granary.operators import images

    rows = spark.createDataFrame([(1, 0, 0, 9.0), (1, 0, 0, 0.0), (1, 1, 0, 0.0), (1, 1, 0, 0.0), (1, 2, 0, 0.0), (1, 2, 0, 0.0)], "image_id long, x int, y int, value double")
    w = images.gaussian(0.8)
    got = sorted((r["x"], round(r["value"], 9)) for r in images.halation(rows, 0.8, 0.5).collect())
    glow = {x: 0.5 * 2 * 9.0 * w[(x, 0)] for x in (0, 1, 2)}
    assert got == sorted((x, round(v + glow[x], 9)) for x, v in ((0, 9.0), (0, 0.0), (1, 0.0), (1, 0.0), (2, 0.0), (2, 0.0)))


def test_merge_groups_no_products(spark):
    from granary.operators import layers

    cells = lambda rows: spark.createDataFrame(rows, "i long, j long, value double")
    base = cells([(i, j, float(i)) for i in range(5) for j in range(3)] + [(0, 0, 7.0), (9, 9, 1.0)])
    a, b = cells([(0, 0, 1.0), (0, 0, 2.0), (1, 1, 3.0), (1, 2, None)]), cells([(i, r, 1.0 + i + r) for i in range(4) for r in range(2)])
    out = layers.merged(base, a, b, 4.0, 2)
    found = sorted((r["i"], r["j"], r["value"]) for r in out.collect())
    delta = lambda i, j: 0.0 if i > 3 else {0: 3.0 * (1 + i), 1: 3.0 * (2 + i)}.get(j, 0.0)
    assert found == sorted((i, j, v + 2 * delta(i, j)) for i, j, v in ((r["i"], r["j"], r["value"]) for r in base.collect()))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join Inner" in line]  # rows of b by the rank with rows of a
