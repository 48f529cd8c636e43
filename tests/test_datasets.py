import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import layers
from granary.sources import datasets, fetch, links


def test_jobs_by_dataset(spark, tmp_path):
    (tmp_path / "src").mkdir()
    rows = []
    for i in range(3):
        (tmp_path / f"src/{i}").write_text("x" * i)
        rows.append({"dataset": "d", "part": "ab"[i % 2], "url": f"file://{tmp_path}/src/{i}", "dest": f"{tmp_path}/out/{i}", "pos": i})
    (tmp_path / "jobs.jsonl").write_text("".join(json.dumps(r) + "\n" for r in [*rows, {"dataset": "other", "url": "u", "pos": 0}]))
    jobs = datasets.read_jobs(spark, str(tmp_path / "jobs.jsonl"))
    assert [datasets.chosen(jobs, "d", *a).count() for a in ((), ("a",), ("all", 2), ("all", 0))] == [3, 2, 2, 3]
    have = spark.createDataFrame([(f"{tmp_path}/out/1", 5), (f"{tmp_path}/out/2", 0)], "dest string, length long")
    done = datasets.run(datasets.chosen(jobs, "d"), have, workers=2)
    assert datasets.progress(done).collect()[0].asDict() == {"n": 2, "changed": 2, "failed": 0}


def test_readers(spark, tmp_path):
    (tmp_path / "c.csv").write_text("id,iso,aperture,shutter_speed,focal_length,film_stock,lighting_condition,white_balance_k\na,400,2.8,1/60,50,stock,day,5500\n")
    assert datasets.capture_meta(spark, str(tmp_path / "c.csv")).collect()[0]["white_balance_k"] == 5500
    (tmp_path / "k.csv").write_text("stock,channel,log_exposure,density\ns,r,-1.5,0.2\n")
    assert datasets.curves(spark, str(tmp_path / "k.csv")).collect()[0]["density"] == 0.2
    (tmp_path / "r.json").write_text(json.dumps({"one": {"status": "complete", "expected_files": 3}, "two": {}}, indent=1))
    assert {r["name"]: (r["status"], r["expected_files"]) for r in datasets.catalogue(spark, str(tmp_path / "r.json")).collect()} == {"one": ("complete", 3), "two": (None, None)}


def test_lists(spark, tmp_path):
    names = spark.createDataFrame([("b",), ("a",)], "name string")
    datasets.write_array(names, "name", str(tmp_path / "l.json"))
    assert json.loads((tmp_path / "l.json").read_text()) == ["a", "b"]
    datasets.write_list(names, "name", str(tmp_path / "l"))
    assert next((tmp_path / "l").glob("part-*")).read_text() == "a\nb\n"


def test_sets_and_selectors(spark):
    rows = spark.createDataFrame([("1", "x", None, "train"), ("2", "y", "x", "val")], "id string, input string, target string, split string")
    files = spark.createDataFrame([("x", 3), ("y", 0)], "path string, length long")
    got = {r["id"]: (r["input_ok"], r["target_ok"]) for r in datasets.present(rows, files, "input", "target").collect()}
    assert got == {"1": (True, False), "2": (False, True)}
    assert datasets.samples(rows, split="val").count() == 1 and datasets.samples(rows).count() == 2
    file = lambda *x: spark.createDataFrame([(v,) for v in x], "file string")
    assert [r["file"] for r in datasets.missing(file("a", "b"), file("a")).collect()] == ["b"]
    modules = spark.createDataFrame([("Block.IN_PROJ", "linear"), ("norm", "linear"), ("in_proj", "conv")], "name string, kind string")
    assert datasets.selected_modules(modules, "name", F.col("kind") == "linear", ["in_proj", "out_proj"]).count() == 1


def test_spline_is_a_partition_of_unity(spark):
    knots = [0.0] * 4 + [1.0, 2.0] + [3.0] * 4
    x = np.linspace(-1, 4, 41)
    assert layers.basis(x, np.array(knots), 3).sum(axis=1) == pytest.approx(np.ones(41))
    # coefficients at the knots' averages reproduce the line
    line = [np.mean(knots[i + 1 : i + 4]) for i in range(len(knots) - 4)]
    rows = spark.createDataFrame([(float(v),) for v in np.linspace(0, 3, 13)] + [(None,)], "x double")
    for r in layers.spline(rows, "x", knots, line).collect():
        assert r["spline"] is None if r["x"] is None else r["spline"] == pytest.approx(r["x"])


def test_scans_noise_and_similarity(spark):
    rows = spark.range(2000).select("id", F.array(*[F.lit(float(i)) for i in range(64)]).alias("a"))
    got = rows.limit(1).select(layers.two_way(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0)), 0.5).alias("s"), layers.blended(F.array(F.lit(1.0)), F.array(F.lit(2.0)), F.array(F.lit(4.0)), 0.25).alias("b")).collect()[0]
    assert got["s"] == pytest.approx([(1 + 2) / 2, (1.5 + 3) / 2, (2.75 + 4) / 2])
    assert got["b"] == pytest.approx([0.75 * 2 + 0.25 * 4])
    draw = lambda n: {r["id"]: r["x"] for r in rows.repartition(n).select("id", layers.noise(F.lit(1.0), 2.0, F.col("id")).alias("x")).collect()}
    one = draw(1)
    assert one == draw(5)
    assert np.mean(list(one.values())) == pytest.approx(1, abs=0.2) and np.std(list(one.values())) == pytest.approx(2, abs=0.15)
    same = layers.ssim(rows.limit(2).select("id", "a", F.col("a").alias("b")), "id", "a", "b", 8, peak=63.0).collect()
    flipped = layers.ssim(rows.limit(2).select("id", "a", F.reverse("a").alias("b")), "id", "a", "b", 8, peak=63.0).collect()
    assert all(r["ssim"] == pytest.approx(1) for r in same) and all(r["ssim"] < 0 for r in flipped)


@pytest.fixture
def server():
    """Files and a paged listing; ranges are granted, and one file breaks off at the first request."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlparse

    body, asked = bytes(range(256)) * 40, []

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def do_GET(self):
            url = urlparse(self.path)
            asked.append((self.path, self.headers.get("Range")))
            if url.path == "/list":
                page = int(parse_qs(url.query).get("pageToken", ["0"])[0])
                answer = {"datasetFiles": [{"name": f"f{page}{i}"} for i in range(3)] + [{"name": ""}]} | ({"nextPageToken": str(page + 1)} if page < 3 else {})
                self.send_response(200)
                self.end_headers()
                self.wfile.write(json.dumps(answer).encode())
            elif url.path == "/missing":
                self.send_error(404)
            else:
                start = int((self.headers.get("Range") or "bytes=0-")[6:-1])
                self.send_response(206 if start else 200)
                self.send_header("Content-Length", str(len(body) - start))
                self.end_headers()
                broken = url.path == "/broken" and not start
                self.wfile.write(body[start : start + 3000] if broken else body[start:])

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", body, asked
    http.shutdown()


def test_transfers_and_resumed_ones(spark, server, tmp_path):
    top, body, asked = server
    jobs = spark.createDataFrame([(f"{top}/{n}", f"{tmp_path}/d/{n}") for n in ("a", "broken", "missing")], "url string, dest string")
    first = {r["path"].rsplit("/", 1)[1]: r for r in datasets.run(jobs, resume=True).collect()}
    assert (tmp_path / "d/a").read_bytes() == body and first["a"]["status"] == "ok" and first["a"]["changed"]
    assert not first["broken"]["changed"] and "3000 of 10240 bytes" in first["broken"]["status"] and "404" in first["missing"]["status"]
    again = {r["path"].rsplit("/", 1)[1]: r["status"] for r in datasets.run(jobs, resume=True).collect()}
    assert (tmp_path / "d/broken").read_bytes() == body and again["broken"] == "ok" and again["a"] == "exists"
    assert any(path == "/broken" and asked_range for path, asked_range in asked)
    plain = fetch.transfer(f"{top}/broken", f"{tmp_path}/e/x")
    assert not plain[1] and not list((tmp_path / "e").iterdir())


def test_listing_is_followed_to_its_limit(spark, server):
    top, _, asked = server
    roots = spark.createDataFrame([(f"{top}/list",)], "url string")
    assert sorted(r["name"] for r in fetch.listed(roots).collect()) == [f"f{p}{i}" for p in range(4) for i in range(3)]
    asked.clear()
    assert sorted(r["name"] for r in fetch.listed(roots, limit=4).collect()) == ["f00", "f01", "f02", "f10"]
    assert len(asked) == 2


def test_settings_with_a_base(spark, tmp_path):
    (tmp_path / "base.yaml").write_text("train: {rate: 0.1, steps: 10}\nname: base\n")
    (tmp_path / "own.yaml").write_text("base: base.yaml\ntrain: {rate: 0.5}\n")
    got = {(r["path"].rsplit("/", 1)[1], r["key"]): r["value"] for r in datasets.configs(spark, str(tmp_path)).collect()}
    assert got["own.yaml", "train.rate"] == "0.5" and got["own.yaml", "train.steps"] == "10" and got["own.yaml", "name"] == '"base"' and got["base.yaml", "train.rate"] == "0.1"


def test_archives_links_and_caches(spark, tmp_path):
    import gzip
    import io
    import tarfile

    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as out:
        info = tarfile.TarInfo("in/one.txt")
        info.size = 3
        out.addfile(info, io.BytesIO(b"abc"))
    files = spark.createDataFrame([("x/t.tgz", bytearray(tar.getvalue())), ("x/n.txt.gz", bytearray(gzip.compress(b"hello")))], "path string, content binary")
    assert sorted((r["member"], bytes(r["content"])) for r in links.unpacked(files).collect()) == [("in/one.txt", b"abc"), ("n.txt", b"hello")]
    hrefs = spark.createDataFrame([("../x",), ("//h/y",), ("http://z/w",), ("a b",), (None,)], "href string")
    assert [r["u"] for r in hrefs.select(links.resolved(F.lit("https://e.org/p/q/"), F.col("href")).alias("u")).collect()] == ["https://e.org/p/x", "https://h/y", "http://z/w", "https://e.org/p/q/a b", None]
    made = []
    for _ in range(2):
        assert links.cached(spark, f"{tmp_path}/cache", lambda: made.append(1) or hrefs).count() == 5
    assert made == [1]
    trials = spark.createDataFrame([("p1", 1), ("p2", 0)], "participant string, choice int")
    datasets.write_trials(trials, f"{tmp_path}/trials")
    assert datasets.stored(spark, f"{tmp_path}/trials", trials.where("choice = 1"), "participant").count() == 1


def test_blur_in_two_passes(spark):
    from granary.operators import images

    random = np.random.default_rng(1)
    image = random.random((12, 15))
    rows = spark.createDataFrame([(1, x, y, float(image[y, x])) for y in range(12) for x in range(15)], "image_id long, x int, y int, value double")
    got = {(r["x"], r["y"]): r["value"] for r in images.blurred(rows, 1.5).collect()}
    whole = {(r["x"], r["y"]): r["value"] for r in images.convolved(rows, images.gaussian(1.5)).collect()}
    assert len(got) == 180 and all(got[k] == pytest.approx(whole[k]) for k in whole)


def test_kid_counts_every_row(spark):
    from granary.operators import metrics

    random = np.random.default_rng(2)
    x, y = random.normal(size=(40, 4)), random.normal(1, 1, size=(9, 4))
    rows = [(i, 0, v.tolist()) for i, v in enumerate(x)] + [(100 + i, 1, v.tolist()) for i, v in enumerate(y)] + [(999, 1, None), (998, None, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id long, side int, v array<double>")
    k = lambda a, b: (a @ b.T / 4 + 1) ** 3
    alone = lambda a: (k(a, a).sum() - np.trace(k(a, a))) / (len(a) * (len(a) - 1))
    (one,) = metrics.kid(df, "id", "v", F.col("side")).collect()
    assert one["blocks"] == 1 and one["kid"] == pytest.approx(alone(x) + alone(y) - 2 * k(x, y).mean())
    (many,) = metrics.kid(df, "id", "v", F.col("side"), block=4).collect()
    assert many["blocks"] == 4
