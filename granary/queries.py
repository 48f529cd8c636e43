"""The registered queries of the engine's own operators, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import film, paths, vectors
from granary.operators import flows, images, layers, matching, metrics, pairing, pyramids, scans
from granary.session import shared_path, table
from granary.sources import arrays, datasets, links, manifest
from granary.streaming import progress

#: Width of the small images that rows of ``embeddings`` stand for.
WIDTH = 8
SIGMA = 0.8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rounded(*columns: str, digits: int = 6) -> list:
    return [F.round(c, digits).alias(c) for c in columns]


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.pixels(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", WIDTH)


PIXELS = f"""p AS (
  SELECT vec_id AS image_id, CAST((i - 1) % {WIDTH} AS INTEGER) AS x, CAST((i - 1) // {WIDTH} AS INTEGER) AS y, CAST(embedding[i] AS DOUBLE) AS value
  FROM embeddings, range(1, {WIDTH * WIDTH + 1}) r(i))"""


def _kernel(kernel: dict[tuple[int, int], float]) -> str:
    return ", ".join(f"({dx}, {dy}, CAST({w!r} AS DOUBLE))" for (dx, dy), w in kernel.items())


def _convolution(name: str, source: str, kernel: dict[tuple[int, int], float]) -> str:
    """A table of SQL: ``source`` convolved."""
    return f"""{name} AS (
  SELECT a.image_id, a.x, a.y, coalesce(sum(b.value * k.w), 0) AS value
  FROM {source} a CROSS JOIN (VALUES {_kernel(kernel)}) k(dx, dy, w)
  LEFT JOIN {source} b ON a.image_id = b.image_id AND b.x = a.x + k.dx AND b.y = a.y + k.dy GROUP BY ALL)"""


# links, jobs and listings


@query(f"""
WITH l AS (SELECT page_id, regexp_extract_all(html, '{links.ANCHOR}', 1) AS h FROM pages),
e AS (SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, h[i] AS href FROM l, range(1, 10000) r(i) WHERE i <= len(h))
SELECT page_id, pos, href, 'https://example.org' || href AS url, 'index/' || split_part(href, '/', -1) AS dest FROM e WHERE starts_with(href, '/')""")
def index_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.jobs(links.matching(links.anchors(table(spark, sf_dir, "pages")), "/"), "https://example.org", "index")


@query(f"""
WITH l AS (SELECT page_id, regexp_extract_all(html, '{links.ANCHOR}', 1) AS h FROM pages)
SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, h[i] AS href FROM l, range(1, 10000) r(i) WHERE i <= len(h)""")
def strict_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.anchors_strict(table(spark, sf_dir, "pages"))


@query(f"SELECT page_id, CAST(len(regexp_extract_all(html, '{links.ANCHOR}', 1)) AS INTEGER) AS n FROM pages")
def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(links.ANCHOR), F.lit(1))).alias("n"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality > 0)")
def jobs_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("length"))
    return links.pending(table(spark, sf_dir, "documents").select("doc_id", "source"), done, "doc_id")


@query("SELECT page_id AS id, 'page' AS kind FROM pages UNION ALL SELECT doc_id, 'document' FROM documents")
def job_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind"))
    return pages.unionByName(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind")))


@query(f"""
WITH l AS (SELECT page_id, regexp_extract_all(html, '{links.ANCHOR}', 1) AS h FROM pages)
SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, h[i] AS href FROM l, range(1, 10000) r(i) WHERE i <= len(h) ORDER BY page_id, pos LIMIT 100""")
def index_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.first(links.anchors(table(spark, sf_dir, "pages")), 100, "page_id", "pos")


@query("SELECT CAST(props ->> '$.k' AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id AS n, CASE event_type WHEN 'error' THEN 'failed' ELSE 'ok' END AS status FROM events WHERE event_type = 'error' OR event_id % 25 = 0")
def progress_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").otherwise("ok")
    return links.outcomes(table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), status.alias("status")), "n")


@query("""
SELECT event_type, count(*) AS n, round(count(*) / greatest(epoch(max(ts)) - epoch(min(ts)), 1.0), 9) AS rate FROM events GROUP BY 1""")
def throughput_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.throughput(table(spark, sf_dir, "events"), "ts", "event_type").withColumn("rate", F.round("rate", 9))


@query("""
SELECT page_id, array_to_string(list_slice(string_split(url, '/'), 2, len(string_split(url, '/'))), '/') AS tail, split_part(url, '/', -1) AS name,
  replace(url_encode(url), '%2F', '/') AS quoted FROM pages""")
def job_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", paths.drop_first(url).alias("tail"), paths.base_name(url).alias("name"), paths.quote_path(url).alias("quoted"))


# manifests


@query("""
WITH b AS (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS bucket FROM documents)
SELECT doc_id, CASE WHEN bucket < 80 THEN 'train' WHEN bucket < 90 THEN 'val' ELSE 'test' END AS split FROM b""")
def manifest_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.with_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("""
WITH b AS (SELECT sha256(text) AS key, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS bucket FROM documents WHERE text IS NOT NULL)
SELECT count(*) AS n FROM (SELECT key FROM b GROUP BY key HAVING count(DISTINCT CASE WHEN bucket < 80 THEN 'train' WHEN bucket < 90 THEN 'val' ELSE 'test' END) > 1)""")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    # splits go by document: copies of a text may stand in several
    texts = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("key"))
    return manifest.overlap(manifest.with_split(texts, "doc_id"), "key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS weight FROM documents GROUP BY ROLLUP (source, lang)")
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.summary(table(spark, sf_dir, "documents"), "source", "lang", weight="n_chars")


@query("SELECT source, count(*) AS n FROM documents WHERE n_chars >= 512 GROUP BY source HAVING count(*) >= 20")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.gated(table(spark, sf_dir, "documents"), "source", F.col("n_chars") >= 512, 20)


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)")
def restricted_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.public(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' ELSE 'other' END AS canonical FROM documents")
def style_alias_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = links.constant(spark, [("en", "english"), ("de", "german")], "alias string, canonical string")
    return manifest.aliased(table(spark, sf_dir, "documents").select("doc_id", "lang"), names, "lang", "other").select("doc_id", "canonical")


@query("""
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left' ELSE 'right' END AS only_in
FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""")
def pair_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.orphans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("""
WITH f AS (SELECT source AS resource, count(*) AS found_files, CAST(sum(n_chars) AS BIGINT) AS found_bytes FROM documents GROUP BY 1)
SELECT resource, CAST(50 AS BIGINT) AS files, CAST(100000 AS BIGINT) AS bytes, found_files, found_bytes, found_files = 50 AND found_bytes = 100000 AS complete FROM f""")
def resource_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("resource"), F.col("n_chars").alias("length"))
    expected = files.select("resource").distinct().where("resource IS NOT NULL").select("resource", F.lit(50).cast("long").alias("files"), F.lit(100_000).cast("long").alias("bytes"))
    return manifest.integrity(expected, files)


@query("""
SELECT t.id, bool_and(d.dep IS NULL OR (SELECT status FROM (VALUES ('1.1', 'done'), ('1.2', 'open'), ('2.1', 'open'), ('2.2', 'done')) s(id, status) WHERE s.id = d.dep) = 'done') AS ready
FROM (VALUES ('1.1'), ('1.2'), ('2.1'), ('2.2')) t(id) LEFT JOIN (VALUES ('1.2', '1.1'), ('2.1', '1.1'), ('2.1', '1.2')) d(id, dep) ON t.id = d.id GROUP BY t.id""")
def tasks_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("1.1", "done", []), ("1.2", "open", ["1.1"]), ("2.1", "open", ["1.1", "1.2"]), ("2.2", "done", [])]
    return manifest.ready(links.constant(spark, rows, "id string, status string, deps array<string>"))


@query("""
WITH RECURSIVE t AS (SELECT l_orderkey * 8 + l_linenumber AS id, bool_or(l_linestatus = 'F') AS done, any_value(l_orderkey) AS o, any_value(l_linenumber) AS n, min(l_shipdate) AS ship FROM lineitem GROUP BY 1),
d AS (SELECT id, o * 8 + n - 1 AS dep FROM t WHERE n > 1 UNION SELECT id, dep FROM (SELECT id, lag(id) OVER (PARTITION BY o ORDER BY ship, n) AS dep FROM t) WHERE dep IS NOT NULL),
reach(id, dep) AS (SELECT id, dep FROM d UNION SELECT r.id, d.dep FROM reach r JOIN d ON r.dep = d.id),
ring AS (SELECT DISTINCT id FROM reach WHERE id = dep),
wait AS (SELECT DISTINCT r.id FROM reach r LEFT JOIN t ON r.dep = t.id WHERE NOT coalesce(t.done, false))
SELECT id, id NOT IN (SELECT id FROM wait) AS ready,
  id IN (SELECT id FROM ring) OR (id IN (SELECT r.id FROM reach r WHERE r.dep IN (SELECT id FROM ring)) AND id IN (SELECT r.dep FROM reach r WHERE r.id IN (SELECT id FROM ring))) AS cyclic FROM t""")
def lines_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a line of an order may stand in several rows
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("ship"), F.bool_or(F.col("l_linestatus") == "F").alias("done"))
    lines = lines.withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    # a line waits for the one numbered before it and for the one shipped before it
    before = F.lag("id").over(Window.partitionBy("l_orderkey").orderBy("ship", "l_linenumber"))
    deps = F.array(F.when(F.col("l_linenumber") > 1, F.col("id") - 1), before)
    # lines of one order are near each other
    return manifest.readiness(lines.select("id", "done", deps.alias("deps")), "deps", near=lambda line: F.shiftright(line, 3))


# vectors


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.col("embedding").alias("x0"), F.reverse("embedding").alias("x1"))


def _elements(rows: DataFrame, column) -> DataFrame:
    return rows.select("vec_id", F.posexplode(column).alias("i", "value")).select("vec_id", "i", F.round("value", 6).alias("value"))


def _by_element(expression: str) -> str:
    return f"""WITH e AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, CAST(embedding[i] AS DOUBLE) AS a, CAST(embedding[len(embedding) - i + 1] AS DOUBLE) AS b, len(embedding) AS n FROM embeddings, range(1, 4097) r(i) WHERE i <= len(embedding))
SELECT vec_id, i, round({expression}, 6) AS value FROM e"""


@query(_by_element("0.25 * b + 0.75 * a"))
def flow_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(_paired(spark, sf_dir), vectors.interpolate(F.col("x0"), F.col("x1"), F.lit(0.25)))


@query(_by_element("b - a"))
def flow_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(_paired(spark, sf_dir), vectors.minus(F.col("x1"), F.col("x0")))


@query(_by_element("a * pow(0.9, 10)"))
def ode_euler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(_paired(spark, sf_dir), vectors.euler(F.col("x0"), lambda x, t: F.transform(x, lambda a: -a), 10))


@query(_by_element("a * pow(1 - 0.1 + 0.005, 10)"))
def ode_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(_paired(spark, sf_dir), vectors.midpoint(F.col("x0"), lambda x, t: F.transform(x, lambda a: -a), 10))


@query(_by_element("1 + 0.7 * a + 0.3 * b"))
def style_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(_paired(spark, sf_dir), F.transform(layers.blended(F.col("x0"), F.col("x0"), F.col("x1"), 0.3), lambda v: v + 1))


@query("""
WITH q AS (SELECT vec_id AS id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT id, vec_id AS other, list_sum(list_transform(range(1, len(v) + 1), lambda i: pow(CAST(v[i] AS DOUBLE) - CAST(embedding[i] AS DOUBLE), 2))) AS distance FROM q, embeddings WHERE id <> vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS rank FROM d)
SELECT id, other, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def nearest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = pairing.search(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding", 5)
    return found.withColumn("distance", F.round("distance", 6))


@query()
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in the nearest seven tenths of the lists: these vectors have few clusters. A test holds the recall."""
    rows = table(spark, sf_dir, "embeddings")
    found = matching.searched(rows.where("vec_id % 100 = 0"), matching.indexed(rows, "vec_id", "embedding"), "vec_id", "embedding", 5, probes=0.7)
    return found.withColumn("distance", F.round("distance", 6))


#: Pairs that are nearest to each other, by all distances.
MATCHES = """
WITH q AS (SELECT vec_id AS id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT id, vec_id AS other, list_sum(list_transform(range(1, len(v) + 1), lambda i: pow(CAST(v[i] AS DOUBLE) - CAST(embedding[i] AS DOUBLE), 2))) AS distance FROM q, embeddings WHERE vec_id % 100 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS there, row_number() OVER (PARTITION BY other ORDER BY distance, id) AS back, lead(distance) OVER (PARTITION BY id ORDER BY distance, other) AS second FROM d)
SELECT id, other, round(sqrt(distance), 6) AS distance, round(sqrt(second), 6) AS second FROM r
WHERE there = 1 AND back = 1 AND (second IS NULL OR sqrt(distance) < 0.98 * sqrt(second))"""


@query(MATCHES)
def mutual_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = matching.matched(rows.where("vec_id % 100 = 0"), rows.where("vec_id % 100 <> 0"), "vec_id", "embedding", 0.98, exact=True)
    return found.select("id", "other", *_rounded("distance", "second"))


@query()
def ot_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = F.floor(F.col("vec_id") / 8)
    return pairing.transport(_paired(spark, sf_dir).withColumn("batch_id", batch), "batch_id", "vec_id", "x0", "x1").withColumn("cost", F.round("cost", 6))


def _turning(x, t, parameters):
    """Pairs of elements turn by 2 t times a rate."""
    out = np.empty_like(x)
    rate = (2 * t * parameters[0])[:, None]
    out[:, 0::2], out[:, 1::2] = -rate * x[:, 1::2], rate * x[:, 0::2]
    return out


@query("""
SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * (cos(1 + vec_id % 7) + CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END * sin(1 + vec_id % 7)))), 4) AS total,
  true AS arrived, true AS stepped FROM embeddings""")
def ode_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("rate", 1 + F.col("vec_id") % 7)
    moved = flows.integrated(rows, "vec_id", "embedding", _turning, ["rate"], atol=1e-10, rtol=1e-10)
    # faster rows take more steps than slower ones
    least = 8 * (1 + F.col("vec_id") % 7)
    return moved.select("vec_id", F.round(vectors.total(F.col("x")), 4).alias("total"), (F.col("reached") == 1).alias("arrived"), F.col("steps").between(least, 1000).alias("stepped"))


EPSILON, ROWS = 0.2, 64


@query(f"""
WITH RECURSIVE v AS (SELECT vec_id, vec_id // {ROWS} AS batch, embedding AS a, list_reverse(embedding) AS b FROM embeddings),
c AS (SELECT p.batch, p.vec_id, list(list_sum(list_transform(range(1, len(p.a) + 1), lambda i: pow(CAST(p.a[i] AS DOUBLE) - CAST(q.b[i] AS DOUBLE), 2))) ORDER BY q.vec_id) AS line FROM v p JOIN v q ON p.batch = q.batch GROUP BY p.batch, p.vec_id),
m AS (SELECT batch, count(*) AS n, list(vec_id ORDER BY vec_id) AS ids, list(line ORDER BY vec_id) AS c FROM c GROUP BY batch),
it(batch, k, f, g) AS (
  SELECT batch, 0, CAST([] AS DOUBLE[]), list_transform(range(n), lambda x: CAST(0 AS DOUBLE)) FROM m
  UNION ALL
  SELECT batch, k + 1, f, list_transform(range(1, n + 1), lambda j: -{EPSILON}::DOUBLE * ln(list_sum(list_transform(range(1, n + 1), lambda i: exp((f[i] - c[i][j]) / {EPSILON}::DOUBLE))) / n)) FROM (
    SELECT it.batch, k, n, c, list_transform(range(1, n + 1), lambda i: -{EPSILON}::DOUBLE * ln(list_sum(list_transform(range(1, n + 1), lambda j: exp((g[j] - c[i][j]) / {EPSILON}::DOUBLE))) / n)) AS f FROM it JOIN m ON it.batch = m.batch WHERE k < 200)
), w AS (SELECT it.batch, n, c, f, g, unnest(range(1, n + 1)) AS i, unnest(ids) AS vec_id FROM it JOIN m ON it.batch = m.batch WHERE k = 200)
SELECT batch, vec_id, round(n * list_sum(list_transform(range(1, n + 1), lambda j: exp((f[i] + g[j] - c[i][j]) / {EPSILON}::DOUBLE))) / n / n, 6) AS mass,
  round(n * list_sum(list_transform(range(1, n + 1), lambda j: exp((f[i] + g[j] - c[i][j]) / {EPSILON}::DOUBLE) * c[i][j])) / n / n, 5) AS cost FROM w""")
def entropic_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paired(spark, sf_dir).withColumn("batch", F.floor(F.col("vec_id") / ROWS))
    size = F.count(F.lit(1)).over(Window.partitionBy("batch"))
    return flows.entropic(rows, "batch", "vec_id", "x0", "x1", EPSILON).select("batch", "vec_id", F.round(F.col("mass") * size, 6).alias("mass"), F.round(F.col("cost") * size, 5).alias("cost"))


# sequences and matrices


@query("""
WITH RECURSIVE d AS (SELECT *, ln(1 + exp(value / 100 - 1)) AS dt FROM events),
r AS (SELECT user_id, event_id, exp(-dt) AS a, dt * value AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM d),
walk AS (SELECT user_id, event_id, i, b AS s FROM r WHERE i = 1 UNION ALL SELECT r.user_id, r.event_id, r.i, r.a * w.s + r.b FROM walk w JOIN r ON r.user_id = w.user_id AND r.i = w.i + 1)
SELECT user_id, event_id, round(s, 6) AS state FROM walk""")
def selective_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    dt = F.log1p(F.exp(F.col("value") / 100 - 1))
    return scans.scanned(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.exp(-dt), dt * F.col("value")).select("user_id", "event_id", *_rounded("state"))


@query(f"""
WITH RECURSIVE {PIXELS},
s AS (SELECT image_id, x, y, value, d, CASE WHEN d < 2 THEN y ELSE x END AS line, CASE d WHEN 0 THEN x WHEN 1 THEN {WIDTH - 1} - x WHEN 2 THEN y ELSE {WIDTH - 1} - y END AS i FROM p, range(4) r(d)),
walk AS (SELECT image_id, d, line, i, x, y, 0.1 * value AS s FROM s WHERE i = 0
  UNION ALL SELECT s.image_id, s.d, s.line, s.i, s.x, s.y, 0.9 * w.s + 0.1 * s.value FROM walk w JOIN s ON s.image_id = w.image_id AND s.d = w.d AND s.line = w.line AND s.i = w.i + 1)
SELECT image_id, x, y, round(avg(s), 6) AS state FROM walk GROUP BY image_id, x, y""")
def four_way_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.four_ways(_pixels(spark, sf_dir), F.lit(0.9), F.lit(0.1) * F.col("value")).select("image_id", "x", "y", *_rounded("state"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(table(spark, sf_dir, "embeddings"))


def _cells(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", F.posexplode("embedding").alias("i", "f")).select("vec_id", "i", F.col("f").cast("double").alias("v"))


POINTS = "e AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 4097) r(i) WHERE i <= len(embedding))"


@query(f"""WITH {POINTS} SELECT vec_id, i, round(0.2 * coalesce(lag(v, 2) OVER w, 0) + 0.3 * coalesce(lag(v, 1) OVER w, 0) + 0.5 * v, 6) AS conv FROM e WINDOW w AS (PARTITION BY vec_id ORDER BY i)""")
def causal_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.causal(_points(spark, sf_dir), "vec_id", "i", "v", [0.2, 0.3, 0.5]).select("vec_id", "i", *_rounded("conv"))


@query(f"""WITH {POINTS}, b AS (SELECT vec_id AS i, i AS r, v AS x FROM e WHERE i < 2), a AS (SELECT vec_id AS r, i AS j, v AS y FROM e WHERE vec_id < 2),
d AS (SELECT b.i, a.j, sum(x * y) AS delta FROM b JOIN a ON b.r = a.r GROUP BY ALL)
SELECT e.vec_id AS i, e.i AS j, round(v + 8.0 * delta, 6) AS value FROM e JOIN d ON e.vec_id = d.i AND e.i = d.j""")
def lora_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images.dealt(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", WIDTH * WIDTH)
    cells = _cells(rows).select(F.col("vec_id").alias("i"), F.col("i").cast("long").alias("j"), F.col("v").alias("value"))
    return layers.merged(cells, cells.where("i < 2"), cells.where("j < 2"), 16.0, 2).select("i", F.col("j").cast("int").alias("j"), *_rounded("value"))


@query(f"""WITH {POINTS} SELECT vec_id, i, round(CASE WHEN v > 0.1 THEN v ELSE 0 END, 6) AS value FROM e""")
def threshold_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("vec_id", "i", F.round(layers.threshold(F.col("v"), 0.1), 6).alias("value"))


@query(f"""WITH {POINTS} SELECT vec_id, round(avg(greatest(0.0, -0.1 - v) + greatest(0.0, v - 0.1)), 6) AS penalty FROM e GROUP BY vec_id""")
def range_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).groupBy("vec_id").agg(F.round(layers.out_of_range(F.col("v"), -0.1, 0.1), 6).alias("penalty"))


@query(f"""WITH q AS (SELECT vec_id, CAST((i - 1) % {WIDTH} AS INTEGER) AS x, CAST((i - 1) // {WIDTH} AS INTEGER) AS y, CAST(embedding[i] AS DOUBLE) AS a, CAST(embedding[len(embedding) - i + 1] AS DOUBLE) AS b FROM embeddings, range(1, {WIDTH * WIDTH + 1}) r(i)),
w AS (SELECT vec_id, ox, oy, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS c FROM q, range(0, 2) s(ox), range(0, 2) t(oy) WHERE x BETWEEN ox AND ox + 6 AND y BETWEEN oy AND oy + 6 GROUP BY ALL)
SELECT vec_id, round(avg((2 * ma * mb + 0.0001) * (2 * c + 0.0009) / ((ma * ma + mb * mb + 0.0001) * (va + vb + 0.0009))), 6) AS ssim FROM w GROUP BY vec_id""")
def structural_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.ssim(_paired(spark, sf_dir), "vec_id", "x0", "x1", WIDTH).select("vec_id", *_rounded("ssim"))


@query(f"""WITH {POINTS}, n AS (SELECT vec_id, max(i) AS m FROM e GROUP BY vec_id),
f AS (SELECT a.vec_id, a.i, sum(b.v * pow(0.9, a.i - b.i) * CASE WHEN b.i = 0 THEN 1 ELSE 0.1 END) AS s FROM e a JOIN e b ON a.vec_id = b.vec_id AND b.i <= a.i GROUP BY ALL),
g AS (SELECT a.vec_id, a.i, sum(b.v * pow(0.9, b.i - a.i) * CASE WHEN b.i = m THEN 1 ELSE 0.1 END) AS s FROM e a JOIN e b ON a.vec_id = b.vec_id AND b.i >= a.i JOIN n ON n.vec_id = a.vec_id GROUP BY ALL)
SELECT f.vec_id, f.i, round((f.s + g.s) / 2, 6) AS value FROM f JOIN g ON f.vec_id = g.vec_id AND f.i = g.i""")
def two_way_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(_paired(spark, sf_dir), layers.two_way(F.col("x0"), 0.9))


@query()
def spline_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    knots = [0.0] * 3 + [0.0, 25.0, 50.0, 75.0, 100.0] + [100.0] * 3
    return layers.spline(table(spark, sf_dir, "events").select("event_id", "value"), "value", knots, [0.0, 0.1, 0.4, 1.0, 1.6, 1.9, 2.0])


@query(_by_element("a * pow(1 - 0.1 + 0.005 - 0.001 / 6 + 0.0001 / 24, 10)"))
def ode_rk4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(_paired(spark, sf_dir), vectors.rk4(F.col("x0"), lambda x, t: F.transform(x, lambda a: -a), 10))


@query(_by_element("(1 / (1 + exp(-a))) * a + (1 - 1 / (1 + exp(-a))) * b"))
def gated_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = F.transform(vectors.wide(F.col("x0")), lambda v: 1 / (1 + F.exp(-v)))
    return _elements(_paired(spark, sf_dir), vectors.gated(gate, F.col("x0"), F.col("x1")))


@query("""SELECT event_id, CAST(j AS INTEGER) AS i, round(CASE WHEN j < 4 THEN sin(value / 100 * pow(10000, -j / 4.0)) ELSE cos(value / 100 * pow(10000, -(j - 4) / 4.0)) END, 6) AS value FROM events, range(0, 8) r(j) WHERE value IS NOT NULL""")
def time_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", F.posexplode(vectors.sinusoidal(F.col("value") / 100, 8)).alias("i", "value"))
    return rows.select("event_id", "i", *_rounded("value"))


@query("SELECT event_id, round(CAST('0x' || substr(md5('7:' || CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0, 9) AS t FROM events")
def random_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(layers.uniform(F.col("event_id"), 7), 9).alias("t"))


@query(f"""WITH {POINTS}, a AS (SELECT vec_id, i, v, coalesce((v + lag(v) OVER w) / 2, 0) AS area FROM e WINDOW w AS (PARTITION BY vec_id ORDER BY i))
SELECT vec_id, i, round(0.1 + sum(area) OVER (PARTITION BY vec_id ORDER BY i), 6) AS integral FROM a""")
def curve_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.integrated(_points(spark, sf_dir), "vec_id", "i", "v", 0.1).select("vec_id", "i", *_rounded("integral"))


@query("SELECT p_brand, CAST(sum(p_size) * 3.5 AS DOUBLE) AS needed, sum(p_size) * 3.5 <= 700.0 AS fits FROM part GROUP BY p_brand")
def memory_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.memory_estimate(table(spark, sf_dir, "part"), "p_brand", "p_size", 800, 100)


@query("SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 2 HOURS")
def stale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.stale(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).select("event_id", "ts")


@query("SELECT event_type, count(*) AS files, CAST(sum(event_id) AS BIGINT) AS bytes FROM events GROUP BY event_type")
def bytes_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.bytes_by(table(spark, sf_dir, "events").withColumn("length", F.col("event_id")), "event_type")


@query("""
SELECT n_name, stock, CAST(i AS INTEGER) AS sample FROM nation CROSS JOIN (VALUES ('colour'), ('tungsten'), ('mono')) t(stock) CROSS JOIN range(0, 20) s(i)""")
def render_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.grid(table(spark, sf_dir, "nation").select("n_name"), ["colour", "tungsten", "mono"], 20)


@query("SELECT doc_id, lang, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS idx FROM documents")
def sample_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.indexed(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


# small images


@query(f"WITH {PIXELS}, {_convolution('c', 'p', images.LAPLACIAN)} SELECT image_id, x, y, round(value, 6) AS value FROM c")
def edge_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.convolved(_pixels(spark, sf_dir), images.LAPLACIAN).select("image_id", "x", "y", *_rounded("value"))


@query(f"WITH {PIXELS}, {_convolution('c', 'p', images.gaussian(SIGMA))} SELECT image_id, x, y, round(value, 6) AS value FROM c")
def gaussian_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.blurred(_pixels(spark, sf_dir), SIGMA).select("image_id", "x", "y", *_rounded("value"))


HIGH = "h AS (SELECT image_id, avg(value) + 1.5 * stddev_samp(value) AS level FROM p GROUP BY image_id)"


@query(f"WITH {PIXELS}, {HIGH} SELECT p.image_id, x, y, round(value, 6) AS value FROM p JOIN h ON p.image_id = h.image_id WHERE value > level")
def highlight_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.highlights(_pixels(spark, sf_dir)).select("image_id", "x", "y", *_rounded("value"))


@query(f"""WITH {PIXELS}, {HIGH}, b AS (SELECT p.image_id, x, y, CASE WHEN value > level THEN value ELSE 0 END AS value FROM p JOIN h ON p.image_id = h.image_id),
{_convolution("g", "b", images.gaussian(SIGMA))} SELECT p.image_id, p.x, p.y, round(p.value + 0.3 * g.value, 6) AS value FROM p JOIN g ON p.image_id = g.image_id AND p.x = g.x AND p.y = g.y""")
def halation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.halation(_pixels(spark, sf_dir), SIGMA, 0.3).select("image_id", "x", "y", *_rounded("value"))


@query(f"""WITH {PIXELS}, {_convolution("e", "p", images.LAPLACIAN)}, {_convolution("b", "p", images.gaussian(SIGMA))}
SELECT p.image_id, p.x, p.y, round(p.value + 0.5 * (CASE WHEN abs(e.value) > 0.2 THEN 1 ELSE 0 END) * (p.value - b.value), 6) AS value
FROM p JOIN e ON p.image_id = e.image_id AND p.x = e.x AND p.y = e.y JOIN b ON p.image_id = b.image_id AND p.x = b.x AND p.y = b.y""")
def dir_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.dir_contrast(_pixels(spark, sf_dir), SIGMA, 0.5, 0.2).select("image_id", "x", "y", *_rounded("value"))


#: Images of 64 vectors, one below another.
SIDE = 64
SHEETS = f"""p AS (
  SELECT vec_id // {SIDE} AS image_id, CAST(i - 1 AS INTEGER) AS x, CAST(vec_id % {SIDE} AS INTEGER) AS y, CAST(embedding[i] AS DOUBLE) AS value
  FROM embeddings, range(1, {SIDE + 1}) r(i))"""


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    return rows.select(F.floor(F.col("vec_id") / SIDE).alias("image_id"), "x", (F.col("vec_id") % SIDE).cast("int").alias("y"), F.col("v").cast("double").alias("value"))


@query(f"WITH {SHEETS}, {_convolution('c', 'p', images.gaussian(1.0))} SELECT image_id, x, y, round(value, 6) AS value FROM c")
def tiled_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    kernel = images.gaussian(1.0)
    return pyramids.tiled(_sheets(spark, sf_dir), 16, 5, pyramids.convolve(kernel), margin=3).select("image_id", "x", "y", *_rounded("value"))


@query(f"""
WITH {SHEETS}, l1 AS (SELECT image_id, x // 2 AS x, y // 2 AS y, sum(value) / 2 AS ll, sum(CASE x % 2 WHEN 0 THEN value ELSE -value END) / 2 AS hl, sum(CASE y % 2 WHEN 0 THEN value ELSE -value END) / 2 AS lh, sum(CASE (x + y) % 2 WHEN 0 THEN value ELSE -value END) / 2 AS hh FROM p GROUP BY ALL),
l2 AS (SELECT image_id, x // 2 AS x, y // 2 AS y, sum(ll) / 2 AS ll, sum(CASE x % 2 WHEN 0 THEN ll ELSE -ll END) / 2 AS hl, sum(CASE y % 2 WHEN 0 THEN ll ELSE -ll END) / 2 AS lh, sum(CASE (x + y) % 2 WHEN 0 THEN ll ELSE -ll END) / 2 AS hh FROM l1 GROUP BY ALL),
l3 AS (SELECT image_id, x // 2 AS x, y // 2 AS y, sum(ll) / 2 AS ll, sum(CASE x % 2 WHEN 0 THEN ll ELSE -ll END) / 2 AS hl, sum(CASE y % 2 WHEN 0 THEN ll ELSE -ll END) / 2 AS lh, sum(CASE (x + y) % 2 WHEN 0 THEN ll ELSE -ll END) / 2 AS hh FROM l2 GROUP BY ALL),
u AS (SELECT image_id, 1 AS level, unnest(['hl', 'lh', 'hh']) AS band, unnest([hl, lh, hh]) AS value FROM l1 UNION ALL SELECT image_id, 2, unnest(['hl', 'lh', 'hh']), unnest([hl, lh, hh]) FROM l2 UNION ALL SELECT image_id, 3, unnest(['ll', 'hl', 'lh', 'hh']), unnest([ll, hl, lh, hh]) FROM l3)
SELECT image_id, CAST(level AS INTEGER) AS level, band, count(*) AS n, round(sum(value * value), 6) AS energy, round(avg(abs(value)), 6) AS l1 FROM u GROUP BY ALL""")
def haar_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pyramids.haar(_sheets(spark, sf_dir), 3).groupBy("image_id", "level", "band")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value") * F.col("value")).alias("energy"), F.avg(F.abs("value")).alias("l1")).select("image_id", "level", "band", "n", *_rounded("energy", "l1"))


def _similarity_sql() -> str:
    line = ", ".join(f"({i}, CAST({w!r} AS DOUBLE))" for i, w in enumerate(pyramids.window().tolist()))
    c1, c2 = 0.01**2, 0.03**2
    out = [f"""q AS (SELECT a.image_id, a.x, a.y, a.value AS a, b.value AS b FROM p a JOIN p b ON a.image_id = b.image_id AND a.y = b.y AND b.x = {SIDE - 1} - a.x),
whole AS (SELECT image_id FROM p GROUP BY image_id HAVING count(*) = {SIDE * SIDE}), k(i, w) AS (VALUES {line}), s0 AS (SELECT * FROM q WHERE image_id IN (FROM whole))"""]
    for s in range(3):
        side = SIDE >> s
        out.append(f"""h{s} AS (SELECT image_id, x - i AS x, y, sum(w * a) AS a, sum(w * b) AS b, sum(w * a * a) AS aa, sum(w * b * b) AS bb, sum(w * a * b) AS ab FROM s{s}, k WHERE x - i BETWEEN 0 AND {side - 11} GROUP BY ALL),
m{s} AS (SELECT image_id, x, y - i AS y, sum(w * a) AS a, sum(w * b) AS b, sum(w * aa) AS aa, sum(w * bb) AS bb, sum(w * ab) AS ab FROM h{s}, k WHERE y - i BETWEEN 0 AND {side - 11} GROUP BY ALL),
t{s} AS (SELECT image_id, avg((2 * (ab - a * b) + {c2}) / (aa - a * a + bb - b * b + {c2})) AS part, avg((2 * (ab - a * b) + {c2}) / (aa - a * a + bb - b * b + {c2}) * (2 * a * b + {c1}) / (a * a + b * b + {c1})) AS whole FROM m{s} GROUP BY image_id),
s{s + 1} AS (SELECT image_id, x // 2 AS x, y // 2 AS y, avg(a) AS a, avg(b) AS b FROM s{s} GROUP BY ALL)""")
    w = [x / sum(pyramids.SCALES[:3]) for x in pyramids.SCALES[:3]]
    return f"""WITH {SHEETS}, {", ".join(out)}
SELECT t0.image_id, round(t0.whole, 6) AS ssim, round(pow(greatest(t0.part, 0), {w[0]!r}) * pow(greatest(t1.part, 0), {w[1]!r}) * pow(greatest(t2.whole, 0), {w[2]!r}), 6) AS ms_ssim
FROM t0 JOIN t1 ON t0.image_id = t1.image_id JOIN t2 ON t0.image_id = t2.image_id"""


@query(_similarity_sql())
def multi_scale_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / SIDE).alias("image_id"), "vec_id", "embedding")
    lines = F.array_sort(F.collect_list(F.struct("vec_id", "embedding")))
    sheets = rows.groupBy("image_id").agg(lines.alias("l")).where(F.size("l") == SIDE)
    both = sheets.select("image_id", F.flatten("l.embedding").alias("a"), F.flatten(F.transform("l.embedding", lambda v: F.reverse(v))).alias("b"))
    return pyramids.ms_ssim(both, "image_id", "a", "b", SIDE, scales=3).select("image_id", *_rounded("ssim", "ms_ssim"))


@query(f"""WITH {PIXELS} SELECT image_id, CAST(x // 4 AS INTEGER) AS tile_x, CAST(y // 4 AS INTEGER) AS tile_y, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high FROM p GROUP BY ALL""")
def tile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.tiles(_pixels(spark, sf_dir), 4).select("image_id", "tile_x", "tile_y", "n", *_rounded("mean", "low", "high"))


@query(f"WITH {PIXELS} SELECT image_id, CAST(x - 2 AS INTEGER) AS x, CAST(y - 2 AS INTEGER) AS y, round(value * 2, 6) AS value FROM p WHERE x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5")
def augment_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = images.cropped(_pixels(spark, sf_dir), 2, 2, 4)
    return cut.select("image_id", "x", "y", F.round(film.exposure_shift(F.col("value"), F.lit(1.0)), 6).alias("value"))


@query(f"WITH {PIXELS} SELECT image_id, CAST(7 - x AS INTEGER) AS x, y, round(value, 6) AS value FROM p")
def augment_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.flipped(_pixels(spark, sf_dir), WIDTH).select("image_id", "x", "y", *_rounded("value"))


@query(f"WITH {PIXELS} SELECT image_id, round(1000 * stddev_pop(value), 6) AS rms FROM p GROUP BY image_id")
def rms_granularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.granularity(_pixels(spark, sf_dir)).select("image_id", *_rounded("rms"))


@query(f"""WITH {PIXELS}, f AS (SELECT CAST(a AS INTEGER) AS u, CAST(b AS INTEGER) AS v FROM range(0, {WIDTH}) s(a), range(0, {WIDTH}) t(b))
SELECT image_id, u, v, round((pow(sum(value * cos(2 * pi() * (u * x + v * y) / {WIDTH})), 2) + pow(sum(value * sin(2 * pi() * (u * x + v * y) / {WIDTH})), 2)) / {WIDTH * WIDTH}, 6) AS power FROM p, f GROUP BY image_id, u, v""")
def nps_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.power_spectrum(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", WIDTH).select("image_id", "u", "v", *_rounded("power"))


def _spectrum_sql(name: str, value: str) -> str:
    turn = f"2 * pi() * (u * x + v * y) / {WIDTH}"
    return f"{name} AS (SELECT image_id, u, v, (pow(sum({value} * cos({turn})), 2) + pow(sum({value} * sin({turn})), 2)) / {WIDTH * WIDTH} AS power FROM p, f GROUP BY image_id, u, v)"


FREQUENCIES = f"f AS (SELECT CAST(a AS INTEGER) AS u, CAST(b AS INTEGER) AS v FROM range(0, {WIDTH}) s(a), range(0, {WIDTH}) t(b))"
RING = f"CAST(ceil(sqrt(pow(least(u, {WIDTH} - u), 2) + pow(least(v, {WIDTH} - v), 2)) / {WIDTH}.0 * {WIDTH} - 1e-9) AS INTEGER)"


@query(f"""WITH {PIXELS}, {FREQUENCIES}, {_spectrum_sql("s", "value")}, r AS (SELECT *, {RING} AS ring FROM s)
SELECT image_id, ring, count(*) AS n, round(avg(power), 6) AS power FROM r WHERE ring BETWEEN 1 AND {WIDTH // 2} GROUP BY image_id, ring""")
def radial_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    spectrum = images.power_spectrum(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", WIDTH)
    return images.radial(spectrum, WIDTH, WIDTH).select("image_id", "ring", "n", *_rounded("power"))


@query(f"""WITH {PIXELS}, {FREQUENCIES}, {_spectrum_sql("s", "value")}, {_spectrum_sql("t", "abs(value)")}, r AS (SELECT *, {RING} AS ring FROM s), q AS (SELECT *, {RING} AS ring FROM t),
a AS (SELECT image_id, ring, avg(power) AS power FROM r WHERE ring BETWEEN 1 AND {WIDTH // 2} GROUP BY ALL), b AS (SELECT image_id, ring, avg(power) AS power FROM q WHERE ring BETWEEN 1 AND {WIDTH // 2} GROUP BY ALL)
SELECT a.image_id, round(corr(ln(a.power), ln(b.power)), 5) AS correlation FROM a JOIN b ON a.image_id = b.image_id AND a.ring = b.ring GROUP BY a.image_id""")
def spectrum_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.transform("embedding", lambda v: F.abs(v)).alias("other"))
    one, two = (images.power_spectrum(rows, "vec_id", c, WIDTH) for c in ("embedding", "other"))
    return images.radial_correlation(one, two, WIDTH, WIDTH).select("image_id", *_rounded("correlation", digits=5))


@query(f"""WITH {PIXELS}, d AS (SELECT *, CAST('0x' || substr(md5('0:' || CAST(image_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.5 AS f, CAST('0x' || substr(md5('1:' || CAST(image_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.3 AS s FROM p)
SELECT image_id, CASE WHEN f THEN CAST({WIDTH - 1} - x AS INTEGER) ELSE x END AS x, y, round(CASE WHEN s THEN value * 2 ELSE value END, 6) AS value FROM d""")
def augment_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [(lambda p: images.flipped(p, WIDTH), 0.5), (lambda p: p.withColumn("value", film.exposure_shift(F.col("value"), F.lit(1.0))), 0.3)]
    return layers.augmented(_pixels(spark, sf_dir), "image_id", steps).select("image_id", "x", "y", *_rounded("value"))


@query(f"""WITH {PIXELS} SELECT image_id, x, y, round(value * (1 - 0.4 * (pow((x - 3.5) / 4, 2) + pow((y - 3.5) / 4, 2)) / 2), 6) AS value FROM p""")
def vignetted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).select("image_id", "x", "y", F.round(film.vignette(F.col("value"), F.col("x"), F.col("y"), WIDTH, WIDTH, 0.4), 6).alias("value"))


@query("""SELECT event_id, round(value * sqrt(greatest(2500.0, least(10000.0, value * 120)) / 6500), 6) AS red, round(value / sqrt(greatest(2500.0, least(10000.0, value * 120)) / 6500), 6) AS blue, round(0.5 * value, 6) AS strength FROM events WHERE value IS NOT NULL""")
def white_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    red, _, blue = film.white_balance((v, v, v), v * 120)
    return table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", F.round(red, 6).alias("red"), F.round(blue, 6).alias("blue"), F.round(film.overrides(v, 0.5), 6).alias("strength"))


@query()
def grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.grain(_pixels(spark, sf_dir), WIDTH, WIDTH, 0.05, 0.12, 1.2)


# photographic response


@query("""
WITH l AS (SELECT event_id, log10(greatest(value / 100, 1e-6)) AS h FROM events WHERE value IS NOT NULL)
SELECT event_id, round(h, 6) AS log_exposure, round(least(greatest(0.65 * (least(h, 0.5) + 2.5), 0.0), 2.2), 6) AS density FROM l""")
def density_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = film.log_exposure(F.col("value") / 100)
    rows = table(spark, sf_dir, "events").where("value IS NOT NULL")
    return rows.select("event_id", F.round(h, 6).alias("log_exposure"), F.round(film.density(h, -2.5, 0.5, 0.65, 2.2), 6).alias("density"))


@query("""
SELECT event_id, round(1 - 2 * abs(value / 65535 - 0.5), 6) AS weight, round(exp(-0.5 * pow((400 + value - 550) / 40, 2)), 6) AS sensitivity,
  round(0.9 * value + 0.08 * value / 2 + 0.02 * value / 4, 6) AS red, round(value / 4 / 0.3, 6) AS blue, round(1 / pow(1 + pow(value / 0.12, 2), 0.6), 6) AS gain FROM events""")
def film_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    rgb = (v, v / 2, v / 4)
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.round(film.midtone(film.bit_depth(v, 16)), 6).alias("weight"),
        F.round(film.sensitivity(400 + v, 550, 40), 6).alias("sensitivity"),
        F.round(film.crosstalk(rgb, [(0.9, 0.08, 0.02)] * 3)[0], 6).alias("red"),
        F.round(film.channel_scale(rgb, 0.2)[2], 6).alias("blue"),
        F.round(film.spectrum_filter(v, 0.12, F.lit(1.2)), 6).alias("gain"),
    )


@query("""
SELECT i AS step, round(0.001 * least(1.0, (i + 1) / 10.0), 9) AS warm, round(0.001 * 0.5 * (1 + cos(pi() * least(1.0, i / 100.0))), 9) AS cosine, CAST(floor(floor(6 * (i + 1) + 1) / 2) * 2 + 1 AS BIGINT) AS size FROM range(0, 120) r(i)""")
def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.col("id")
    return spark.range(120).select(
        step.alias("step"), F.round(film.warmup(step, 10, 0.001), 9).alias("warm"), F.round(film.cosine_decay(step, 100, 0.001), 9).alias("cosine"), film.kernel_size(step + 1).alias("size")
    )


@query("SELECT o_orderstatus, round(regr_slope(o_totalprice, CAST(o_custkey AS DOUBLE)), 6) AS gamma FROM orders GROUP BY 1")
def curve_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    gamma = F.regr_slope("o_totalprice", F.col("o_custkey").cast("double"))
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.round(gamma, 6).alias("gamma"))


@query("""
WITH e AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 4097) r(i) WHERE i <= len(embedding)),
d AS (SELECT vec_id, lag(v) OVER w - 2 * v + lead(v) OVER w AS s FROM e WINDOW w AS (PARTITION BY vec_id ORDER BY i))
SELECT vec_id, round(avg(s * s), 6) AS roughness FROM d GROUP BY vec_id""")
def curve_roughness(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "f")).select("vec_id", "i", F.col("f").cast("double").alias("v"))
    return metrics.roughness(points, "vec_id", "i", "v").select("vec_id", *_rounded("roughness"))


# losses, scores and distributions


@query("""
WITH e AS (SELECT label, CAST(embedding[i] AS DOUBLE) AS mu, CAST(embedding[len(embedding) - i + 1] AS DOUBLE) AS lv FROM embeddings, range(1, 4097) r(i) WHERE i <= len(embedding))
SELECT label, round(-0.5 * avg(1 + lv - mu * mu - exp(lv)), 6) AS kl FROM e GROUP BY label""")
def kl_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", F.explode(F.arrays_zip(F.col("embedding").alias("m"), F.reverse("embedding").alias("r"))).alias("e"))
    return rows.groupBy("label").agg(F.round(metrics.kl(F.col("e")["m"].cast("double"), F.col("e")["r"].cast("double")), 6).alias("kl"))


@query("""
WITH e AS (SELECT label, CAST(embedding[i] AS DOUBLE) AS a, CAST(embedding[len(embedding) - i + 1] AS DOUBLE) AS b FROM embeddings, range(1, 4097) r(i) WHERE i <= len(embedding))
SELECT label, round(avg(abs(a - b)), 6) AS l1, round(avg((a - b) * (a - b)), 6) AS mse, round(sqrt(avg((a - b) * (a - b))), 6) AS rmse, round(-10 * log10(avg((a - b) * (a - b))), 6) AS psnr, round(avg((a - 1) * (a - 1)), 6) AS lsgan FROM e GROUP BY label""")
def reconstruction_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", F.explode(F.arrays_zip(F.col("embedding").alias("m"), F.reverse("embedding").alias("r"))).alias("e"))
    rows = rows.select("label", F.col("e")["m"].cast("double").alias("a"), F.col("e")["r"].cast("double").alias("b"))
    out = rows.groupBy("label").agg(*metrics.errors(F.col("a"), F.col("b")), metrics.lsgan(F.col("a")).alias("lsgan"))
    return out.select("label", *_rounded("l1", "mse", "rmse", "psnr", "lsgan"))


@query("""
WITH e AS (SELECT vec_id, label, sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) AS c FROM (
  SELECT vec_id, label, CAST(embedding[i] AS DOUBLE) AS a, CAST(embedding[len(embedding) - i + 1] AS DOUBLE) AS b FROM embeddings, range(1, 4097) r(i) WHERE i <= len(embedding)) GROUP BY 1, 2)
SELECT label, round(avg(1 - c), 6) AS loss FROM e GROUP BY label""")
def cosine_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("c", vectors.cosine(F.col("embedding"), F.reverse("embedding")))
    return rows.groupBy("label").agg(F.round(F.avg(1 - F.col("c")), 6).alias("loss"))


#: The weights of the total loss.
WEIGHTS = (("l1", 1.0), ("ssim", 0.5), ("click", 1.0), ("view", 0.5), ("error", 2.0))


@query(f"""
SELECT user_id, round(sum(coalesce(w.weight, 0) * e.value), 4) AS total FROM events e LEFT JOIN (VALUES {", ".join(f"('{n}', {w})" for n, w in WEIGHTS)}) w(name, weight) ON e.event_type = w.name GROUP BY user_id""")
def weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("name"), "value")
    return metrics.weighted_total(values, links.constant(spark, [*WEIGHTS], "name string, weight double"), "user_id").select("user_id", *_rounded("total", digits=4))


@query("""
WITH b AS (SELECT CAST(greatest(0, least(31, floor(value / (100.0 / 32)))) AS INTEGER) AS bin, event_type = 'click' AS click FROM events WHERE value IS NOT NULL),
c AS (SELECT i AS bin, count(*) FILTER (WHERE click) AS a, count(*) FILTER (WHERE NOT click) AS b FROM range(0, 32) r(i) LEFT JOIN b ON b.bin = i GROUP BY i),
s AS (SELECT sum(a) OVER (ORDER BY bin) / (sum(a) OVER ()) AS fa, sum(b) OVER (ORDER BY bin) / (sum(b) OVER ()) AS fb FROM c)
SELECT round(sum(abs(fa - fb)), 9) AS emd FROM s""")
def histogram_emd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("side", F.when(F.col("event_type") == "click", "a").otherwise("b"))
    return metrics.histogram_emd(rows, "side", "value", 0.0, 100.0).select(F.round("emd", 9).alias("emd"))


@query("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS back, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL)
SELECT user_id, max(n) AS n, round(sum(value * pow(0.9, back) * CASE WHEN back = n - 1 THEN 1 ELSE 0.1 END), 6) AS ema FROM r GROUP BY user_id""")
def ema_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("value IS NOT NULL").withColumn("day", F.to_date("ts"))
    return metrics.ema(rows, "user_id", "day", ["ts", "event_id"], "value", 0.9).select("user_id", "n", *_rounded("ema"))


@query("""
WITH t AS (SELECT toxic, count(quality) AS n, avg(quality) AS p FROM labels GROUP BY toxic)
SELECT toxic, n, round(p, 6) AS rate, round((p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS low,
  round((p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS high FROM t""")
def preference_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.preference(table(spark, sf_dir, "labels"), "toxic", "quality").select("toxic", "n", *_rounded("rate", "low", "high"))


@query("SELECT role, count(turn) AS n, round(avg(turn), 6) AS mos, round(stddev_samp(turn), 6) AS sd FROM conversations GROUP BY role")
def opinion_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.opinion(table(spark, sf_dir, "conversations"), "role", "turn").select("role", "n", *_rounded("mos", "sd"))


@query()
def fid_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.fid(table(spark, sf_dir, "embeddings"), "label", "embedding")


@query()
def kid_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.kid(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("label") % 2)


@query("""
WITH c AS (SELECT event_id, value / 100 AS r, CAST(event_id % 11 AS DOUBLE) / 10 AS g, CAST(event_id % 7 AS DOUBLE) / 6 AS b FROM events),
x AS (SELECT event_id, (0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047 AS x, 0.2126729 * r + 0.7151522 * g + 0.0721750 * b AS y, (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883 AS z FROM c),
f AS (SELECT event_id, CASE WHEN x > pow(6.0 / 29, 3) THEN cbrt(x) ELSE x / (3 * pow(6.0 / 29, 2)) + 4.0 / 29 END AS x, CASE WHEN y > pow(6.0 / 29, 3) THEN cbrt(y) ELSE y / (3 * pow(6.0 / 29, 2)) + 4.0 / 29 END AS y, CASE WHEN z > pow(6.0 / 29, 3) THEN cbrt(z) ELSE z / (3 * pow(6.0 / 29, 2)) + 4.0 / 29 END AS z FROM x)
SELECT event_id, round(116 * y - 16, 4) AS l, round(500 * (x - y), 4) AS a, round(200 * (y - z), 4) AS b, round(sqrt(pow(116 * y - 16 - 50, 2) + pow(500 * (x - y), 2) + pow(200 * (y - z), 2)), 4) AS delta FROM f""")
def lab_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    l, a, b = metrics.lab(F.col("value") / 100, F.col("event_id") % 11 / 10, F.col("event_id") % 7 / 6)  # noqa: E741
    grey = (F.lit(50.0), F.lit(0.0), F.lit(0.0))
    return rows.select("event_id", l.alias("l"), a.alias("a"), b.alias("b"), metrics.delta_e76((l, a, b), grey).alias("delta")).select("event_id", *_rounded("l", "a", "b", "delta", digits=4))


# array store


@query("SELECT vec_id, len(embedding[21:52]) AS n, round(list_sum(list_transform(embedding[21:52], lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings WHERE vec_id IN (SELECT user_id FROM events)")
def array_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors are stored; of the users' vectors the elements 20 to 51 are read."""
    path = shared_path(spark, "arrays")
    arrays.write(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", path, chunk_rows=256)
    rows = arrays.taken(spark, path, table(spark, sf_dir, "events"), "user_id", 20, 52)
    total = F.aggregate("elements", F.lit(0.0), lambda t, x: t + x)
    return rows.select(F.col("key").alias("vec_id"), F.size("elements").cast("long").alias("n"), F.round(total, 6).alias("total"))


# streams


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.totals(spark, sf_dir, "events").select("event_type", "n", *_rounded("total", digits=4))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.daily(spark, sf_dir, "events")
