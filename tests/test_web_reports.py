import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from granary.sources import web
from granary.streaming import reports


class Site:
    """Listings /a, /b ... of so many names in pages of 10; the token is the first position. Counts what is asked for."""

    def __init__(self):
        self.sizes, self.asked = {}, Counter()
        site = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                url = urlparse(self.path)
                token = int(parse_qs(url.query).get("pageToken", ["0"])[0])
                site.asked[url.path] += 1
                if url.path not in site.sizes:
                    self.send_response(404)
                    self.end_headers()
                    return
                n = site.sizes[url.path]
                page = {"datasetFiles": [{"name": f"{url.path}/{i}"} for i in range(token, min(n, token + 10))] + [{"name": ""}, {}]}
                if token + 10 < n:
                    page["nextPageToken"] = str(token + 10)
                self.send_response(200)
                self.end_headers()
                self.wfile.write(json.dumps(page).encode())

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.at = f"http://127.0.0.1:{self.server.server_port}"


@pytest.fixture
def site(spark):
    web.register(spark)
    out = Site()
    yield out
    out.server.shutdown()


def listing(spark, site, *names, **options):
    return spark.read.format("paged_listing").options(roots=json.dumps([site.at + n for n in names]), **options).load()


def test_roots_are_partitions(spark, site):
    site.sizes |= {"/a": 25, "/b": 10, "/c": 0}
    df = listing(spark, site, "/a", "/b", "/c", "/a")
    assert not site.asked  # nothing before a task reads
    got = df.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["name"], r["pos"]) for r in got) == sorted([(f"/a/{i}", i) for i in range(25)] + [(f"/b/{i}", i) for i in range(10)])
    assert len({r["task"] for r in got}) == 2 and site.asked == {"/a": 3, "/b": 1, "/c": 1}
    assert "BatchScan paged_listing" in df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_reader(spark, site):
    site.sizes |= {"/a": 500, "/b": 500, "/c": 500}
    got = listing(spark, site, "/a", "/b", "/c").where(F.col("root").isin(site.at + "/b", site.at + "/c") & (F.col("pos") < 15)).collect()
    assert len(got) == 30 and site.asked == {"/b": 2, "/c": 2}
    site.asked.clear()
    got = listing(spark, site, "/a", "/b").where((F.col("root") == site.at + "/a") & (F.col("pos") <= 9) & (F.col("pos") > 3) & F.col("name").endswith("8")).collect()
    assert [r["pos"] for r in got] == [8] and site.asked == {"/a": 1}
    assert listing(spark, site, "/a", "/b", limit=12).count() == 24
    assert listing(spark, site, "/a").where("pos < 0").count() == 0


def test_options_are_checked(spark, site):
    with pytest.raises(Exception, match="no roots"):
        spark.read.format("paged_listing").load().count()
    site.sizes["/a"] = 3
    assert spark.read.format("paged_listing").load(site.at + "/a").count() == 3
    with pytest.raises(Exception, match="404"):
        listing(spark, site, "/none").count()


def test_gets(spark, site):
    site.sizes["/a"] = 3
    urls = [site.at + "/a", site.at + "/none", "http://127.0.0.1:9/closed"]
    df = spark.read.format("http_get").options(urls=json.dumps(urls), partitions="2", timeout="5").load()
    got = {r["url"]: r for r in df.collect()}
    assert json.loads(got[urls[0]]["content"])["datasetFiles"][0]["name"] == "/a/0" and got[urls[0]]["status"] == 200
    assert got[urls[1]]["status"] == 404 and got[urls[1]]["content"] is None and got[urls[2]]["status"] is None and "refused" in got[urls[2]]["error"]
    site.asked.clear()
    assert df.where(F.col("url") == urls[0]).count() == 1 and site.asked == {"/a": 1}


def test_a_growing_listing_streams(spark, site, tmp_path):
    site.sizes |= {"/a": 25, "/b": 4}

    def drain():
        df = spark.readStream.format("paged_listing").option("roots", json.dumps([site.at + "/a", site.at + "/b"])).load()
        df.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        return sorted((r["root"][-1], r["pos"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    want = lambda a, b: sorted([("a", i) for i in range(a)] + [("b", i) for i in range(b)])
    assert drain() == want(25, 4)
    site.sizes["/a"] = 47
    assert drain() == want(47, 4)  # only what is new, after a restart
    site.sizes |= {"/a": 40, "/b": 5}
    assert drain() == want(47, 5)


def test_reports_by_the_rows_own_clock(spark, tmp_path):
    minute = lambda seconds: f"2024-01-01 00:{seconds // 60:02d}:{seconds % 60:02d}"
    batches = [[("a", 0, 1.0), ("a", 5, 2.0), ("b", 3, 10.0)], [("a", 20, 4.0)], [("a", 31, 8.0), (None, 33, 1.0)], [("b", 90, None)], [("end", 200, 0.0)], [("end", 300, 0.0)]]
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(batches):
        (tmp_path / "in" / f"{i}.json").write_text("".join(json.dumps({"k": k, "ts": minute(s), "size": v}) + "\n" for k, s, v in rows))
        time.sleep(0.02)
    stream = spark.readStream.schema("k string, ts timestamp, size double").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    out = reports.throttled(stream, "k", "size", every=30, ts="ts")
    told = []
    keep = lambda batch, number: told.extend((r["key"], r["n"], r["total"], r["at"].minute * 60 + r["at"].second) for r in batch.collect())
    out.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    by = {k: [r[1:] for r in told if r[0] == k] for k in ("a", "b", None)}
    # a's first report is due at 30, told with what had come by the batch in which the watermark passed
    assert [r[2] for r in by["a"]] == [30, 61] or [r[2] for r in by["a"]] == [30]
    assert by["a"][-1][:2] == (4, 15.0) and by["b"][-1][:2] == (2, 10.0) and by[None][-1][:2] == (1, 1.0)
    times = [r[2] for r in by["b"]]
    assert all(y - x >= 30 for x, y in zip(times, times[1:], strict=False))


def test_reports_by_processing_time(spark, tmp_path, data):
    events = spark.read.parquet(f"{data}/events.parquet").select("event_type", "value")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    told = {}

    def keep(batch, number):
        for r in batch.collect():
            told.setdefault(r["key"], []).append((r["n"], r["total"], r["at"]))

    want = {r["event_type"]: (r["n"], r["total"]) for r in events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).collect()}
    query = reports.throttled(stream, "event_type", "value", every=1.5).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(keep).start()
    try:
        end = time.time() + 120
        while time.time() < end and {k: v[-1][0] for k, v in told.items()} != {k: n for k, (n, _) in want.items()}:
            assert query.exception() is None
            time.sleep(0.3)
    finally:
        query.stop()
    for key, (n, total) in want.items():
        assert told[key][-1][0] == n and told[key][-1][1] == pytest.approx(total)
        assert all((y[2] - x[2]).total_seconds() >= 1.5 for x, y in zip(told[key], told[key][1:], strict=False))
