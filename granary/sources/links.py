"""Link indexes and job lists: HTML anchors, listing pages, work still to do."""

from __future__ import annotations

import gzip
import tarfile
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from io import BytesIO

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.paths import base_name

ANCHOR = '<a href="([^"]*)"'


def anchors(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pos, href) of every anchor in document order, by pattern (SRC-05, WIN-01)."""
    found = F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit(ANCHOR), F.lit(1))).alias("pos", "href")
    return pages.select(F.col(id_col), found)


class _Hrefs(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.hrefs: list[str] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "a":
            self.hrefs += [value for name, value in attrs if name == "href" and value is not None][:1]


def anchors_strict(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The same with a real HTML parser: any quoting, attribute order and character references (UDF-01)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, hrefs = [], [], []
            for i, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parser = _Hrefs()
                parser.feed(html or "")
                ids += [i] * len(parser.hrefs)
                places += range(len(parser.hrefs))
                hrefs += parser.hrefs
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(hrefs, pa.string())], [id_col, "pos", "href"])

    return pages.select(F.col(id_col).cast("long"), html_col).mapInArrow(run, f"{id_col} long, pos int, href string")


def matching(links: DataFrame, prefix: str, suffix: str = "") -> DataFrame:
    """Links with the prefix and the suffix (FLT-01)."""
    return links.where(F.col("href").startswith(prefix) & F.col("href").endswith(suffix))


def jobs(links: DataFrame, base: str, folder: str) -> DataFrame:
    """``links`` with url (base joined with the href) and dest (folder and base name) (PRJ-03 to PRJ-05)."""
    return links.withColumn("url", resolved(F.lit(base), F.col("href"))).withColumn("dest", F.concat(F.lit(f"{folder}/"), base_name(F.col("href"))))


def resolved(base: Column, href: Column) -> Column:
    """The absolute URL of a link on a page: relative, rooted, scheme-relative and absolute ones (PRJ-04)."""
    root = F.regexp_extract(base, r"^([A-Za-z][\w+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^[A-Za-z][\w+.-]*://[^/?#]*(/(?:[^?#]*/)?)", 1)
    path = F.when(href.startswith("/"), href).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), href))
    bare, tail = F.regexp_replace(path, "[?#].*$", ""), F.regexp_extract(path, "[?#].*$", 0)
    parts = F.split(bare, "/")
    upward = lambda kept: F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))
    step = lambda kept, x: F.when(x == "..", upward(kept)).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))
    flat = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.slice(parts, F.lit(1), F.lit(1)), step)
    folders = F.when(F.element_at(parts, -1).isin("..", "."), F.concat(flat, F.array(F.lit("")))).otherwise(flat)
    absolute = href.rlike(r"^[A-Za-z][\w+.-]*:")
    return F.when(absolute, href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]*:)", 1), href)).when(href == "", base).otherwise(F.concat(root, F.array_join(folders, "/"), tail))


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """What was written to ``path`` before, else ``make()``, which is written there (SRC-06, SNK-04)."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.parquet(path)
        return spark.read.parquet(path)


def pending(work: DataFrame, present: DataFrame, on: str) -> DataFrame:
    """Work without a present, non-empty result (JOIN-01, FLT-03). ``present`` has ``on`` and length."""
    return work.join(present.where("length > 0").select(on), on, "left_anti")


def first(links: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in listing order; 0 means all (LIM-01)."""
    return links.orderBy(*order).limit(n) if n else links


def listing(pages: DataFrame, body: str = "body") -> DataFrame:
    """name of every file in JSON listing pages, empty names left out, with the next page's token (SRC-04, FLT-02)."""
    schema = "struct<datasetFiles:array<struct<name:string>>,nextPageToken:string>"
    parsed = pages.withColumn("parsed", F.from_json(F.col(body), schema))
    rows = parsed.select("*", F.explode("parsed.datasetFiles").alias("file"))
    return rows.where("file.name IS NOT NULL AND file.name <> ''").select(*pages.columns, F.col("file.name").alias("name"), F.col("parsed.nextPageToken").alias("next_token"))


def constant(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A stated relation, such as a fixed job list (SRC-07 to SRC-10)."""
    return spark.createDataFrame(rows, schema)


def numbered(spark: SparkSession, n: int, pattern: str) -> DataFrame:
    """name by pattern for 0 to n - 1 (SRC-11)."""
    return spark.range(n).select(F.format_string(pattern, "id").alias("name"))


def selected(work: DataFrame, key: Column, part: str) -> DataFrame:
    """One part, or with 'all' every one (FLT-04)."""
    return work if part == "all" else work.where(key == part)


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """text of binary files, invalid bytes replaced (SRC-06)."""

    @F.pandas_udf("string")
    def decode(values):
        return values.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))

    return files.withColumn("text", decode(F.col(content)))


def unpacked(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """(path, member, length, content) of the members of ZIP, TAR (packed or not) and GZ files (SRC-31)."""

    def members(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
        if zipfile.is_zipfile(BytesIO(data)):
            with zipfile.ZipFile(BytesIO(data)) as archive:
                yield from ((i.filename, archive.read(i)) for i in archive.infolist() if not i.is_dir())
            return
        try:
            with tarfile.open(fileobj=BytesIO(data)) as archive:
                yield from ((i.name, archive.extractfile(i).read()) for i in archive if i.isfile())
        except tarfile.ReadError:
            if data[:2] != b"\x1f\x8b":
                raise
            yield name.rsplit("/", 1)[-1].removesuffix(".gz"), gzip.decompress(data)

    def run(batches):
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for member, one in members(p, data):
                    yield pa.RecordBatch.from_pydict({"path": [p], "member": [member], "length": [len(one)], "content": [one]})

    return files.select(path, content).mapInArrow(run, "path string, member string, length long, content binary")


def outcomes(results: DataFrame, order: str, every: int = 25) -> DataFrame:
    """Results to report: whatever is neither ok nor present, and every 25th (FLT-05, AGG-02). ``results`` has n, status."""
    return results.where(~F.col("status").isin("ok", "exists") | (F.col("n") % every == 0)).orderBy(order)
