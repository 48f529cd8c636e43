"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Targets share the words of all documents by source weight, a source being taken ``most`` times at
most. A source has a weight schedule over training time 0 to 1 (piecewise linear); its integral is the
source's cumulative demand. A document stands at its place in the source's running word count, and the
inverse of the demand at that place is its training position, by which documents are range-sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import free, keep, located

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Schedules likewise: knots (time, factor); early, late and flat.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def _schedule(knots: Sequence[tuple[float, float]]) -> tuple[list[float], list[float], list[float]]:
    """Times, densities and cumulative shares at the knots, with the integral scaled to 1."""
    times, factors = [float(t) for t, _ in knots], [float(w) for _, w in knots]
    if len(times) < 2 or times[0] != 0 or times[-1] != 1 or any(a >= b for a, b in zip(times, times[1:], strict=False)) or min(factors) <= 0:
        raise ValueError("a schedule needs rising times from 0 to 1 and factors above 0")
    area = [(b - a) * (u + v) / 2 for a, b, u, v in zip(times, times[1:], factors, factors[1:], strict=False)]
    total, cumulative = sum(area), [0.0]
    for x in area:
        cumulative.append(cumulative[-1] + x / total)
    return times, [w / total for w in factors], cumulative


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, schedules=SCHEDULES, most: float = 3.0, share: float = 1.0) -> DataFrame:
    """source, source_size, target, times, densities, shares of every source of ``sized`` (source, size).

    A target is ``level * weight`` or ``most`` times the source's size if that is less; the level that
    spends all words is found by sorting sources by the level at which each reaches its limit.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % n + 1).cast("int"))
    limit = F.lit(float(most)) * F.col("source_size")
    ranked = by_source.withColumn("rank", rank).withColumn("weight", weight).withColumn("limit", limit)
    place = F.row_number().over(Window.orderBy(F.col("limit") / F.col("weight"), "rank"))
    placed = ranked.withColumn("place", place)
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("place").rowsBetween(0, Window.unboundedFollowing)
    words = F.lit(float(share)) * F.sum("source_size").over(everything)
    level = (words - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    placed = placed.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("place", "level"))
    placed = placed.withColumn("found", F.min(fits).over(everything))
    target = F.when(F.col("found").isNull() | (F.col("place") < F.col("found.place")), F.col("limit")).otherwise(F.col("found.level") * F.col("weight"))
    out = placed.withColumn("target", target)
    curves = [_schedule(s) for s in schedules]
    for i, name in enumerate(("times", "densities", "shares")):
        choices = F.array(*[F.array(*[F.lit(v) for v in c[i]]) for c in curves])
        out = out.withColumn(name, F.element_at(choices, (F.col("rank") % len(curves) + 1).cast("int")))
    return out.select("source", "source_size", "target", "times", "densities", "shares")


def position(q: Column) -> Column:
    """The time at which the cumulative share of the schedule (times, densities, shares) reaches q."""
    i = F.greatest(F.lit(1), F.least(F.size(F.filter("shares", lambda s: s <= q)), F.size("shares") - 1))
    at = lambda name, j: F.element_at(F.col(name), j)
    slope = (at("densities", i + 1) - at("densities", i)) / (at("times", i + 1) - at("times", i))
    rest = q - at("shares", i)
    density = at("densities", i)
    step = 2 * rest / (density + F.sqrt(F.greatest(density * density + 2 * slope * rest, F.lit(0.0))))
    return F.least(F.lit(1.0), at("times", i) + step)


def sized(documents: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size and the order key of every document, and with ``carry`` row, a struct of those columns."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return documents.select(
        *[F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] * bool(carry),
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), key.alias("key"),
    )


def assigned(documents: DataFrame, carry: Sequence[str] = (), light: bool = False, **parameters) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and positions (one for each copy), a row for each document.

    With ``carry`` also ``row``, a struct of those columns (``light``: they are few and small). A source's target is that many whole
    passes over its words and a rest; the rest takes documents in the order of a hash of their ids while
    the middle of a document lies within it, so a source's taken words are within half a document of
    its target. Running counts are summed in two steps, over hash buckets and within them, so that no
    task holds a whole source.

    Null texts have size 0; null is a source of its own, the last; an empty table gives no rows.
    Documents with equal doc_id are ordered by size and are all mixed. Extra columns are carried or ignored.
    """
    table = sized(documents, carry)
    narrow = keep(table if light or not carry else table.drop("row"))
    n = narrow.count()
    digits = max(1, math.ceil(math.log(max(n, 1) ** 0.5, 16))) if n > 1 else 1
    plan = keep(targets(narrow, **parameters))
    bucket = F.substring("key", 1, digits)
    totals = narrow.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("in_bucket"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("source").alias("of"), F.col("bucket").alias("from"), F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("start"))
    starts = keep(starts.join(plan, F.col("of").eqNullSafe(F.col("source"))).drop("source"))
    rows = table if carry and not light else narrow
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("bucket", bucket).withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("from")))
    begin = F.col("start") + F.col("inside")
    passes = F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0))
    rows = rows.withColumn("begin", begin).withColumn("passes", passes)
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    extra = F.when((F.col("size") > 0) & (F.col("begin") + F.col("size") / 2 < rest), 1).otherwise(0)
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.col("passes") + extra).otherwise(F.least("passes", F.lit(1))).cast("int"))
    place = lambda copy: F.least(F.lit(1.0), ((copy - 1) * F.col("source_size") + F.col("begin") + F.col("size") / 2) / F.col("target"))
    positions = F.when((F.col("copies") > 0) & (F.col("target") > 0), F.transform(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))), lambda c: position(place(c))))
    rows = rows.withColumn("positions", F.coalesce(positions, F.array().cast("array<double>"))).withColumn("taken", F.col("size") * F.col("copies"))
    return rows.select(*["row"] * bool(carry), "doc_id", "source", "size", "source_size", "target", "copies", "taken", "positions")


def mixed(documents: DataFrame, **parameters) -> DataFrame:
    """The documents as they are to be trained on: a row for each copy, range-sorted by position, own columns only.

    Rows of a file table are found again by their place in the files, so that texts are moved twice only:
    to their positions, and by range. Other tables carry their columns along.
    """
    names = documents.columns
    file, row, of_file, of_row, of_id, at = free(documents, "__file", "__row", "__in", "__of", "__id", "__at")
    own = [F.col(f"`{c}`") for c in names]
    table = located(documents, file, row)
    if table is None:
        rows = assigned(documents, carry=names, **parameters).where("copies > 0").select("row", F.col("doc_id").alias(of_id), F.explode("positions").alias(at))
        rows = rows.select("row.*", of_id, at)
    else:
        placed = assigned(table, carry=[file, row], light=True, **parameters).where("copies > 0")
        placed = keep(placed.select(F.col(f"row.{file}").alias(of_file), F.col(f"row.{row}").alias(of_row), F.col("doc_id").alias(of_id), F.col("positions").alias(at)))
        rows = table.join(placed, (F.col(file) == F.col(of_file)) & (F.col(row) == F.col(of_row))).select(*own, of_id, F.explode(at).alias(at))
    return rows.repartitionByRange(at, of_id).sortWithinPartitions(at, of_id).select(*own)
