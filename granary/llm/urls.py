"""URL filters: rules by host and path, and a list of domains held in a Bloom filter cascade.

Level 0 of a cascade encodes the listed keys, each further level those keys of the other side that passed the level before, until none
does. For every key of the universe it was built on, the first level that lacks it tells exactly whether it is listed. The universe
of a run is every domain at which some host of the pages stands or lies below, distinct over the whole table, so that the filter is exact for all
of it and pages are judged in place, without a join. Only bits reach the driver: about 1.44 log2(1.41 * unlisted / listed) + 4 for each
listed key. Beyond ``MOST_BITS`` the exact way is a shuffled join with the keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import forget, keep

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Verdict, host, beginning of the path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Domains of the default list: all names under all three parents.
LISTED = tuple(f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
#: Bits of a cascade that may be broadcast (32 MB).
MOST_BITS = 1 << 28


def parts(url: Column) -> tuple[Column, Column]:
    """host (A-Z lower-cased) and path of a url; both empty if it is null or has no "://"."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.char_length(url))).otherwise("")
    shape = r"^([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(rest, shape, 1), UPPER, UPPER.lower()), F.regexp_extract(rest, shape, 2)


def by_length(rules: Iterable[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Longest first, equal ones in the order of their text."""
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))


def below(host: Column, domain: str) -> Column:
    """Whether a host is a domain or lies below it."""
    return (host == domain) | host.endswith(f".{domain}")


def domains(host: Column, longest: int) -> Column:
    """The host and the domains above it, of at most ``longest`` characters; longer ones can't be listed. An empty host has none."""
    tail = F.split(F.right(host, F.lit(longest + 1)), r"\.")
    # of a longer host the first piece may be part of a label: the domains begin after its first dot
    whole = F.when(F.char_length(host) <= longest, F.sequence(F.lit(1), F.size(tail))).when(F.size(tail) > 1, F.sequence(F.lit(2), F.size(tail)))
    every = F.transform(whole, lambda i: F.array_join(F.slice(tail, i, F.size(tail)), "."))
    return F.when(host != "", every)


def hashes(key: Column) -> list[Column]:
    """Two 64-bit hashes of a key, from which all levels' places follow."""
    return [F.xxhash64(F.lit("first"), key), F.xxhash64(key, F.lit("second"))]


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Level:
    """One Bloom filter: its number, bits and hash functions, and once it is filled its words."""

    def __init__(self, number: int, keys: int, rate: float):
        self.number = number
        self.k = max(1, round(-math.log2(rate)))
        self.bits = max(64, math.ceil(keys * -math.log2(rate) / math.log(2)))
        self.words = np.zeros(-(-self.bits // 64), np.uint64)

    def places(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The bits of keys by their two hashes, a row for each hash function."""
        salt = _mixed(np.full(1, self.number + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        start, step = _mixed(one.astype(np.uint64) ^ salt), _mixed(two.astype(np.uint64) ^ salt) | np.uint64(1)
        return (start + np.arange(self.k, dtype=np.uint64)[:, None] * step) % np.uint64(self.bits)

    def holds(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        at = self.places(one, two)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


def member(levels: list[Level], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether keys of the universe are listed."""
    out = np.zeros(len(one), bool)
    inside = np.arange(len(one))
    for level in levels:
        inside = inside[level.holds(one[inside], two[inside])]
        out[inside] = level.number % 2 == 0
    return out


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _filled(level: Level, keys: DataFrame) -> Level:
    """A level with the bits of ``keys`` (one, two): each task sets its own, the words are joined by a sum of bits before they reach the driver."""

    def run(batches):
        for batch in batches:
            at = np.unique(level.places(_longs(batch.column(0)), _longs(batch.column(1))))
            word, begin = np.unique(at >> np.uint64(6), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), begin) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], ["word", "mask"])

    words = keys.select("one", "two").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    level.words[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return level


def universe(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """one, two, listed of the distinct ``keys`` (key) and ``listed`` (key), written."""
    both = keys.select("key", F.lit(False).alias("listed")).unionByName(listed.select("key", F.lit(True).alias("listed")))
    one, two = hashes(F.col("key"))
    return keep(both.groupBy("key").agg(F.bool_or("listed").alias("listed")).select(one.alias("one"), two.alias("two"), "listed"))


def bits(listed: int, unlisted: int) -> float:
    """Expected size of a cascade."""
    first = max(1.0, math.log2(max(2.0, math.sqrt(2) * unlisted / max(listed, 1))))
    return listed * (first / math.log(2) + 4.0)


def cascade(active: DataFrame, listed: int, unlisted: int) -> list[Level]:
    """The levels for a universe (one, two, listed), whose rows are so many. Each level is one pass over the keys that are still open, which about halve."""
    sizes, levels = {True: listed, False: unlisted}, []
    encoded = True
    while sizes[encoded]:
        rate = 0.5 if levels else min(0.5, listed / (math.sqrt(2) * max(unlisted, 1)))
        level = _filled(Level(len(levels), sizes[encoded], rate), active.where(F.col("listed") == encoded))
        levels.append(level)
        shared = active.sparkSession.sparkContext.broadcast(level)

        def run(batches, shared=shared, encoded=encoded):
            for batch in batches:
                one, two = _longs(batch.column(0)), _longs(batch.column(1))
                side = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
                yield batch.filter(pa.array((side == encoded) | shared.value.holds(one, two)))

        still = keep(active.mapInArrow(run, active.schema))
        counts = {r["listed"]: r["count"] for r in still.groupBy("listed").count().collect()}
        if len(levels) > 1:
            forget(active)
        shared.destroy()
        active, sizes, encoded = still, {s: counts.get(s, 0) for s in (True, False)}, not encoded
        if len(levels) == 200:
            raise ValueError("keys of both sides share their hashes")
    if levels:
        forget(active)
    return levels


def listing(spark: SparkSession, listed: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in sorted(set(listed))], "key string")


def judged(pages: DataFrame, listed: DataFrame | None = None, rules: Iterable[tuple[str, str, str]] = RULES, most_bits: int = MOST_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of ``pages`` (page_id, url): the longest rule's verdict, else block for hosts at or below a domain of ``listed`` (key), else allow.

    A null url or one without "://" has an empty host and path, fits no rule and is allowed. Null and empty keys of ``listed`` are no
    keys; an empty list blocks nothing. Repeated rows and null ids are judged like others; other columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    listed = (listing(spark, LISTED) if listed is None else listed).select(F.translate("key", UPPER, UPPER.lower()).alias("key")).where("key <> ''")
    longest = listed.agg(F.max(F.char_length("key"))).first()[0] or 0
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, domain, begin in reversed(by_length(rules)):
        fits = below(F.col("host"), domain) & F.startswith(F.col("path"), F.lit(begin))
        rule, verdict = F.when(fits, domain + begin).otherwise(rule), F.when(fits, what).otherwise(verdict)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"))
    every = domains(F.col("host"), longest)
    keys = universe(rows.select("host").distinct().select(F.explode(every).alias("key")), listed)
    counts = {r["listed"]: r["count"] for r in keys.groupBy("listed").count().collect()}
    inside, outside = counts.get(True, 0), counts.get(False, 0)
    out = "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict")
    if bits(inside, outside) > most_bits:
        forget(keys)
        hosts = rows.select("host").distinct().select("host", F.explode(every).alias("key"))
        hit = hosts.join(listed.distinct(), "key").select("host", F.lit(True).alias("hit")).distinct()
        return rows.join(hit, "host", "left").select(*out)
    shared = spark.sparkContext.broadcast(cascade(keys, inside, outside))
    forget(keys)

    @F.arrow_udf("boolean")
    def hit(one: pa.Array, two: pa.Array) -> pa.Array:
        lengths = one.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        found = member(shared.value, _longs(one.flatten()), _longs(two.flatten()))
        sums = np.concatenate([[0], np.cumsum(found)])
        stop = np.cumsum(lengths)
        return pa.array(sums[stop] > sums[stop - lengths])

    one, two = F.transform(every, lambda x: hashes(x)[0]), F.transform(every, lambda x: hashes(x)[1])
    return rows.withColumn("hit", hit(one, two)).select(*out)
