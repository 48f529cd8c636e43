"""Sharding by balanced label propagation.

Documents of one group are linked. In each round a join brings every document the shard that most of
its group is in, and documents move there under quotas: a shard takes as many from another as it gives
to it, plus a share of its room. At the end shards are evened to counts at most one apart, unlinked
documents first, and rows get gapless slots.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import forget, keep, located

SHARDS = 8
_PARTS = 1024


def nodes(documents: DataFrame, groups=None) -> DataFrame:
    """doc_id, size, text_crc32, group (a hash that linked rows share), order (a hash) of every row, and __file and __row if documents have them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    group = F.xxhash64(text) if groups is None else groups
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), group.alias("group"), *[c for c in ("__file", "__row") if c in documents.columns])
    return rows.withColumn("order", F.xxhash64("doc_id", "group"))


def _wishes(votes: DataFrame, room: dict[int, int], shards: int) -> DataFrame:
    """(group, shard, wish, n): the rows that a group has in a shard and the shard where they would rather be.

    That is the shard with the most rows of the group among those with room, else among all.
    """
    free = F.array(*[F.lit(room[s] > 0) for s in range(shards)])
    vote = F.struct("n", F.xxhash64("group", "shard").alias("tie"), "shard")
    all_votes = votes.groupBy("group").agg(F.collect_list(vote).alias("votes")).where(F.size("votes") > 1)
    best = F.array_max("votes")
    roomy = F.array_max(F.filter("votes", lambda v: F.element_at(free, v["shard"] + 1)))
    mine = all_votes.select("group", F.explode("votes").alias("mine"), best.alias("best"), roomy.alias("roomy"))
    wish = F.when(F.col("roomy") > F.col("mine"), F.col("roomy.shard")).when(F.col("best") > F.col("mine"), F.col("best.shard"))
    return mine.select("group", "mine.shard", wish.alias("wish"), "mine.n").where("wish IS NOT NULL")


def _quotas(wishes: DataFrame, room: dict[int, int], large: int, turn: int) -> DataFrame:
    """(shard, wish, last): for each pair of shards the last part of 1024 that may move.

    A shard takes as many rows from another as it gives to it, and of its room a share by demand.
    """
    part = F.pmod(F.xxhash64("group", F.lit(turn)), F.lit(_PARTS))
    whole = wishes.where(F.col("n") <= large).select("shard", "wish", part.alias("part"), F.col("n").cast("double").alias("n"))
    pieces = wishes.where(F.col("n") > large).groupBy("shard", "wish").agg((F.sum("n") / _PARTS).alias("n"))
    pieces = pieces.select("shard", "wish", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))).alias("part"), "n")
    moves = whole.union(pieces).groupBy("shard", "wish", "part").agg(F.sum("n").alias("n"))
    pair = moves.groupBy("shard", "wish").agg(F.sum("n").alias("m"))
    back = pair.select(F.col("wish").alias("shard"), F.col("shard").alias("wish"), F.col("m").alias("back"))
    into = pair.groupBy("wish").agg(F.sum("m").alias("asked"))
    free = F.element_at(F.array(*[F.lit(float(max(room[s], 0))) for s in sorted(room)]), F.col("wish") + 1)
    quota = F.least("m", F.coalesce("back", F.lit(0.0))) + F.ceil(free * F.col("m") / F.col("asked"))
    allowed = pair.join(back, ["shard", "wish"], "left").join(into, "wish").select("shard", "wish", quota.alias("quota"))
    running = F.sum("n").over(Window.partitionBy("shard", "wish").orderBy("part"))
    fits = moves.withColumn("running", running).join(allowed, ["shard", "wish"]).where("running <= quota")
    return fits.groupBy("shard", "wish").agg(F.max("part").alias("last"))


def propagated(rows: DataFrame, shards: int = SHARDS, rounds: int = 12) -> DataFrame:
    """``rows`` of ``nodes`` with ``shard`` and ``members`` (rows of the group) after the moves.

    Only linked rows move and count against a shard's capacity: the others make up the difference at the end.
    What a group has in a shard moves whole if it has 1 / 64 of the capacity at most (or 8 rows), else by parts.
    """
    capacity = rows.count() // shards
    # what a group has in a shard moves whole up to this size, beyond it row by row
    large = max(8, capacity // 64)
    groups = rows.groupBy("group").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    state = rows.join(groups, "group", "left").withColumn("members", F.coalesce("members", F.lit(1)))
    start = keep(state.withColumn("shard", F.pmod(F.xxhash64("order", F.lit("shard")), F.lit(shards)).cast("int")))
    state = keep(start.where("members > 1"))
    for turn in range(rounds):
        votes = keep(state.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n")))
        used = {r["shard"]: r["n"] for r in votes.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
        room = {s: capacity - used.get(s, 0) for s in range(shards)}
        wishes = keep(_wishes(votes, room, shards))
        last = F.broadcast(_quotas(wishes, room, large, turn))  # a row for each pair of shards
        part = lambda key: F.pmod(F.xxhash64(key, F.lit(turn)), F.lit(_PARTS))
        going = wishes.join(last, ["shard", "wish"]).where((F.col("n") > large) | (part("group") <= F.col("last")))
        going = keep(going.select("group", "shard", "wish", F.when(F.col("n") > large, F.col("last")).alias("last")))
        if going.isEmpty():
            break
        moved = state.join(going, ["group", "shard"], "left")
        goes = F.col("wish").isNotNull() & (F.col("last").isNull() | (part("order") <= F.col("last")))
        before, state = state, keep(moved.select(*[c for c in state.columns if c != "shard"], F.when(goes, F.col("wish")).otherwise(F.col("shard")).alias("shard")))
        forget(before, votes, wishes, going)
    return start.where("members = 1").unionByName(state)


def evened(state: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``state`` with final shard and slot: counts at most one apart, slots from 0 without gaps.

    Ranks are summed in two steps (hash buckets, then within them). Each shard keeps its first rows,
    linked ones before others; the rest fill the shards that are short, in order.
    """
    n = state.count()
    buckets = max(1, math.ceil(n**0.5))
    state = state.withColumn("lone", (F.col("members") == 1).cast("int")).withColumn("bucket", F.pmod("order", F.lit(buckets)))
    totals = state.groupBy("shard", "lone", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("lone", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", "lone", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "lone", "bucket").orderBy("order", "doc_id", "text_crc32"))
    ranked = state.withColumn("within", within).join(starts, ["shard", "lone", "bucket"]).withColumn("rank", F.col("start") + F.col("within") - 1)
    have = {r["shard"]: r["n"] for r in totals.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    quota = {s: n // shards + (s < n % shards) for s in range(shards)}
    spare, gap, over, short = 0, 0, [], []
    for s in range(shards):
        extra = have.get(s, 0) - quota[s]
        over.append((s, quota[s], spare))
        spare += max(extra, 0)
        if extra < 0:
            short.append((gap, gap - extra, s, have.get(s, 0)))
            gap -= extra
    place = F.lit(None).cast("long")
    for s, limit, first in over:
        place = F.when((F.col("shard") == s) & (F.col("rank") >= limit), F.col("rank") - limit + first).otherwise(place)
    ranked = ranked.withColumn("place", place)
    shard, slot = F.col("shard"), F.col("rank")
    for low, high, s, size in short:
        here = (F.col("place") >= low) & (F.col("place") < high)
        shard, slot = F.when(here, F.lit(s)).otherwise(shard), F.when(here, F.col("place") - low + size).otherwise(slot)
    return ranked.withColumn("slot", slot.cast("long")).withColumn("shard", shard.cast("int"))


def in_order(placed: DataFrame) -> DataFrame:
    """``placed`` with slots of each shard in the order of __file and __row: ranks are summed over files and within them."""
    placed = placed.select("doc_id", "size", "text_crc32", "shard", "__file", "__row")
    totals = placed.groupBy("shard", "__file").agg(F.count(F.lit(1)).alias("n"))
    # numbers of files grow in length beyond their padding
    earlier = Window.partitionBy("shard").orderBy(F.length("__file"), "__file").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", "__file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "__file").orderBy("__row")) - 1
    return placed.withColumn("within", within).join(starts, ["shard", "__file"]).withColumn("slot", F.col("start") + F.col("within"))


def assign(documents: DataFrame, shards: int = SHARDS, groups=None, rounds: int = 12) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, a row for each row of documents.

    law is 'rows': counts of rows are at most one apart. ``groups`` is a column whose equal values link
    rows, by default the text. Null texts count as empty ones (size 1, crc32 0) and are linked with
    each other; rows with a null doc_id are placed like others; repeated rows each get a slot; an
    empty table gives no rows. grown_shard is null. Extra columns are ignored.
    """
    rows = keep(nodes(documents, groups))
    out = evened(propagated(rows, shards, rounds), shards)
    return _told(out)


def _told(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(documents: DataFrame, shards: int = SHARDS, groups=None, rounds: int = 12) -> DataFrame:
    """``assign`` with the text of each row; rows of a file table keep their order: in a shard slots follow it."""
    # the columns of the work alone, so that others cannot clash
    documents = documents.select("doc_id", "text", *([] if groups is None else [groups.alias("linked")]))
    groups = None if groups is None else F.col("linked")
    table = located(documents)
    if table is None:
        table = located(keep(documents))
    rows = keep(nodes(table, groups))
    out = in_order(evened(propagated(rows, shards, rounds), shards))
    placed = keep(out.select(F.col("__file").alias("__in"), F.col("__row").alias("__of"), "doc_id", "size", "text_crc32", "shard", "slot"))
    texts = table.select("__file", "__row", F.col("text").cast("string").alias("text"))
    return texts.join(placed, (F.col("__file") == F.col("__in")) & (F.col("__row") == F.col("__of"))).select("text", "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot")
