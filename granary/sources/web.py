"""Web sources for ``spark.read`` and ``spark.readStream``: paged JSON listings and plain GETs, one planned partition for each root or share of urls.

    web.register(spark)
    spark.read.format("paged_listing").option("roots", json.dumps(roots)).load().where("pos < 100")
    spark.readStream.format("paged_listing").option("roots", json.dumps(roots)).load()
    spark.read.format("http_get").option("urls", json.dumps(urls)).option("partitions", 16).load()

Nothing is fetched until a task reads; with ``spark.sql.python.filterPushdown.enabled`` (``register`` sets it) filters on ``root`` and ``url`` prune
partitions and ``pos < n`` ends the paging, so that no later page is asked for.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual

from granary.sources.fetch import opened

NAMES = pa.schema([("root", pa.string()), ("pos", pa.int64()), ("name", pa.string())])
BODIES = pa.schema([("url", pa.string()), ("status", pa.int32()), ("content", pa.binary()), ("error", pa.string())])


def pages(root: str, token: str | None, timeout: float) -> Iterator[tuple[str | None, list[str], str | None]]:
    """(token of a page, its names, token of the next) from a token on; empty names are left out (SRC-04)."""
    while True:
        url = root if token is None else f"{root}{'&' if '?' in root else '?'}{urllib.parse.urlencode({'pageToken': token})}"
        with opened(url, timeout) as answer:
            page = json.load(answer)
        following = page.get("nextPageToken") or None
        yield token, [x["name"] for x in page.get("datasetFiles", []) if x.get("name")], following
        if following is None:
            return
        token = following


def _names(root: str, begin: int, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([root] * len(names), pa.string()), pa.array(range(begin, begin + len(names)), pa.int64()), pa.array(names, pa.string())], schema=NAMES)


def _listed(options, several: str) -> list[str]:
    given = json.loads(options[several]) if several in options else [options["path"]] if "path" in options else []
    if not given:
        raise ValueError(f"no {several}: give a JSON list as option {several!r}, or one as the path")
    return list(dict.fromkeys(given))


@dataclass
class Root(InputPartition):
    root: str


@dataclass
class Stretch(InputPartition):
    """Names of a root from ``begin`` to ``end``; the page of ``token`` begins at ``before``."""

    root: str
    begin: int
    end: int
    token: str | None
    before: int


class _Pruned(DataSourceReader):
    """Keeps the values of one column that the filters ask for."""

    def __init__(self, column: str, values: list[str]):
        self.column, self.values = column, values

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == (self.column,):
                self.values = [v for v in self.values if v == f.value]
            elif isinstance(f, In) and f.attribute == (self.column,):
                self.values = [v for v in self.values if v in f.value]
            else:
                yield from self.other(f)

    def other(self, f: Filter):
        yield f


class ListingReader(_Pruned):
    def __init__(self, options):
        super().__init__("root", _listed(options, "roots"))
        self.limit, self.timeout = int(options.get("limit", 0)) or None, float(options.get("timeout", 120))

    def other(self, f: Filter):
        below = f.value if isinstance(f, LessThan) else f.value + 1 if isinstance(f, LessThanOrEqual) else None
        if below is None or f.attribute != ("pos",):
            yield f
        else:
            self.limit = below if self.limit is None else min(self.limit, below)

    def partitions(self):
        return [Root(x) for x in self.values]

    def read(self, partition: Root):
        n = 0
        if self.limit is not None and self.limit <= 0:
            return
        for _, names, _ in pages(partition.root, None, self.timeout):
            names = names if self.limit is None else names[: self.limit - n]
            yield _names(partition.root, n, names)
            n += len(names)
            if self.limit is not None and n >= self.limit:
                return


class ListingStream(DataSourceStreamReader):
    """Offsets are, for each root, the names listed so far, and the token and first position of the page where they end: a batch asks for new pages only."""

    def __init__(self, options):
        self.roots, self.timeout = _listed(options, "roots"), float(options.get("timeout", 120))
        self.seen: dict[str, list] = {}

    def initialOffset(self) -> dict:
        return {root: [0, None, 0] for root in self.roots}

    def latestOffset(self) -> dict:
        for root in self.roots:
            most, token, before = self.seen.get(root, [0, None, 0])
            at = before
            for token, names, following in pages(root, token, self.timeout):  # noqa: B020
                before, at = at, at + len(names)
                if following is None:
                    break
            # a listing that has become shorter stands still
            self.seen[root] = [max(at, most), token, before]
        return {root: list(x) for root, x in self.seen.items()}

    def partitions(self, start: dict, end: dict):
        begun = {root: start.get(root, [0, None, 0]) for root in end}
        return [Stretch(root, begun[root][0], n, *begun[root][1:]) for root, (n, _, _) in end.items() if n > begun[root][0]]

    def read(self, partition: Stretch):
        at = partition.before
        for _, names, _ in pages(partition.root, partition.token, self.timeout):
            begin = max(partition.begin, at)
            own = names[begin - at : partition.end - at]
            if own:
                yield _names(partition.root, begin, own)
            at += len(names)
            if at >= partition.end:
                return

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class PagedListing(DataSource):
    """root, pos, name of the files of paged JSON listings; options roots, limit (names of each root), timeout."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "root string, pos long, name string"

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)

    def streamReader(self, schema) -> ListingStream:
        return ListingStream(self.options)


@dataclass
class Share(InputPartition):
    urls: list


class GetReader(_Pruned):
    def __init__(self, options):
        super().__init__("url", _listed(options, "urls"))
        self.n, self.timeout = int(options.get("partitions", 8)), float(options.get("timeout", 120))

    def partitions(self):
        return [Share(self.values[i :: self.n]) for i in range(min(self.n, len(self.values)))]

    def read(self, partition: Share):
        for url in partition.urls:
            try:
                with opened(url, self.timeout) as answer:
                    row = [url, answer.status, answer.read(), None]
            except urllib.error.HTTPError as error:
                row = [url, error.code, None, f"HTTPError: {error}"]
            except Exception as error:  # noqa: BLE001  a failed request is a row
                row = [url, None, None, f"{type(error).__name__}: {error}"]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, BODIES.types, strict=True)], schema=BODIES)


class HttpGet(DataSource):
    """url, status, content, error of GETs (SRC-01); options urls, partitions, timeout."""

    @classmethod
    def name(cls) -> str:
        return "http_get"

    def schema(self) -> str:
        return "url string, status int, content binary, error string"

    def reader(self, schema) -> GetReader:
        return GetReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (PagedListing, HttpGet):
        spark.dataSource.register(source)
