"""Substring dedup: MinHash banding of paragraphs, exact Jaccard, removals clustered by components.

Paragraphs are of two kinds. Lines are banded by MinHash coordinates (bands tuned for high recall),
lines that share a band key are joined and linked by exact Jaccard on their full shingle sets, and a
class is a component of them. Passages may also be set into the middle of a line, so texts are cut by
content too: at every shingle that is the MinHash of some window of ten shingles, which is the same
shingle in whatever text the window stands. Those paragraphs overlap by a shingle and collide in their
one band if they are equal.

Paragraphs with a copy in an earlier document are chained where they overlap, or where they lie
close by on both sides; a chain that is long enough is a passage, and passages whose copies overlap
are clustered by components.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm import kernels
from granary.llm.common import components, forget, keep, map_batches, small
from granary.llm.minhash import UNIVERSE, _lists, link, permutations

SHINGLE = 5
#: Shingles of a window, each of which has a cut: a paragraph begins every 5.5 words on average, and a
#: passage is covered but for 9 words at either end at most.
WINDOW = 10
#: In texts that repeat a few words for long no shingle is the least; there a cut follows so many words on.
LONGEST = 64
#: Bands of lines and coordinates of each: lines at 0.8 meet with probability 0.998, at 0.85 with 0.9998.
BANDS, ROWS = 9, 3
#: Words that a line has at least, to be a paragraph: in one of ten shingles a changed word at an end leaves 0.8 of them.
LINE = 14
#: Chains go on over so many words between paragraphs that lie alike (within DRIFT words) in the same earlier document.
HOLE, DRIFT = 40, 4
_LOW = np.uint64((1 << 44) - 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
HITS = ("doc", "text", "start", "size", "hub", "hub_start")
SCHEMA = "doc long, text int, level int, start int, size int, content long, keys array<long>"


def cuts(shingles: np.ndarray, limits: np.ndarray, window: int = WINDOW, longest: int = LONGEST) -> np.ndarray:
    """The shingles at which the texts of a chunk are cut; the first and the last of a text are always among them.

    A shingle is a cut if it alone is the least of a window of its own text.
    """
    n = len(shingles)
    text = kernels.owners(limits)
    at = np.arange(n)
    left, right = np.minimum(at - limits[:-1][text] + 1, window), np.minimum(limits[1:][text] - at, window)
    for d in range(1, min(window, n)):
        np.minimum(left[d:], np.where(shingles[:-d] <= shingles[d:], d, window), out=left[d:])
        np.minimum(right[:-d], np.where(shingles[d:] <= shingles[:-d], d, window), out=right[:-d])
    chosen = left + right > window
    filled = np.diff(limits) > 0
    chosen[limits[:-1][filled]] = True
    chosen[limits[1:][filled] - 1] = True
    at = np.flatnonzero(chosen)
    extra = (np.diff(np.concatenate((at, at[-1:]))) - 1) // longest
    extra = np.maximum(extra, 0)
    step = np.arange(int(extra.sum())) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    return np.sort(np.concatenate((at, np.repeat(at, extra) + step * longest)))


def lines(data: np.ndarray, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each line of a chunk that has words, and the index of each text's first line."""
    at = np.concatenate((first[:-1][np.diff(first) > 0], np.searchsorted(starts, np.flatnonzero(data == 10))))
    at = np.unique(at[at < len(starts)])
    return at, np.searchsorted(at, first)


def _sequence(shingles: np.ndarray, begins: np.ndarray, level: int) -> np.ndarray:
    """A hash of the sequence of shingles from each begin to the next."""
    place = np.arange(len(shingles)) - np.repeat(begins, np.diff(np.concatenate((begins, [len(shingles)]))))
    return kernels.mix(np.add.reduceat(kernels.mix(shingles + kernels.mix(place.astype(np.uint64))), begins) + np.uint64(level))


def _words(texts: pa.Array):
    for low, _, data, offsets in kernels.chunks(texts):
        data = kernels.lowered(data)
        starts, ends, first = kernels.spans(data, offsets)
        yield low, data, starts, first, kernels.span_hashes(data, starts, ends)


def _cut(words: np.ndarray, first: np.ndarray):
    """(rows of texts, first word, words, content) of the content-defined paragraphs of a chunk."""
    shingles, limits = kernels.window_hashes(words, first, SHINGLE)
    if not len(shingles):
        return
    at = cuts(shingles, limits)
    text = np.searchsorted(limits, at, "right") - 1
    pair = np.flatnonzero(text[1:] == text[:-1])
    content = kernels.mix(_sequence(shingles, at, 0)[pair] * _STEP + shingles[at[pair + 1]]).view(np.int64)
    row = text[pair]
    yield row, at[pair] - limits[row], at[pair + 1] - at[pair] + SHINGLE, content


def _lined(data: np.ndarray, starts: np.ndarray, words: np.ndarray, first: np.ndarray):
    """(rows of texts, first word, words, content, shingles, index of each line's first shingle) of the lines of a chunk."""
    at, limits = lines(data, starts, first)
    bounds = np.concatenate((at, [len(words)]))
    long = np.flatnonzero(np.diff(bounds) >= LINE)
    if not len(long):
        return
    shingles, inner = kernels.window_hashes(words, bounds, SHINGLE)
    wanted = np.repeat(np.diff(bounds) >= LINE, np.diff(inner))
    shingles, inner = shingles[wanted], np.concatenate(([0], np.cumsum(np.diff(inner)[long])))
    row = np.searchsorted(limits, long, "right") - 1
    yield row, at[long] - first[row], np.diff(bounds)[long], _sequence(shingles, inner[:-1], 1).view(np.int64), shingles, inner


def _bands(shingles: np.ndarray, inner: np.ndarray, seed: int) -> np.ndarray:
    """Band keys, a row for each line. A coordinate is the least shingle by one of the circulant permutations, with its whole hash."""
    sigma, shifted = permutations(BANDS * ROWS, seed)
    at = sigma[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    low = shingles & _LOW
    keys = np.empty((len(inner) - 1, BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(keys), band + 1, np.uint64)
        for j in range(band * ROWS, band * ROWS + ROWS):
            least = np.minimum.reduceat((shifted[at, j].astype(np.uint64) << np.uint64(44)) | low, inner[:-1]) & _LOW
            key = kernels.mix(key * _STEP + least)
        keys[:, band] = key
    return keys.view(np.int64)


def _units(batch: pa.RecordBatch, seed: int):
    """A row for each paragraph of SCHEMA; keys are null but for lines."""
    docs, texts = batch.column(0), batch.column(2)
    for low, data, starts, first, words in _words(batch.column(1)):
        found = [(0, *x, None) for x in _cut(words, first)] + [(1, *x[:4], _bands(*x[4:], seed)) for x in _lined(data, starts, words, first)]
        for level, row, start, size, content, keys in found:
            rows = pa.array(low + row)
            lists = pa.nulls(len(row), pa.list_(pa.int64())) if keys is None else pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            columns = [pa.array(np.full(len(row), level), pa.int32()), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(content), lists]
            yield pa.RecordBatch.from_arrays([docs.take(rows), texts.take(rows), *columns], ["doc", "text", "level", "start", "size", "content", "keys"])


def _sets(batch: pa.RecordBatch):
    """The shingle sets of the wanted lines: columns id (the content) and elements."""
    contents = batch.column(1)
    limits, wanted = contents.offsets.to_numpy(), contents.values.to_numpy()
    for low, data, starts, first, words in _words(batch.column(0)):
        for row, _, _, content, shingles, inner in _lined(data, starts, words, first):
            here = wanted[limits[low + row[0]] : limits[low + row[-1] + 1]]
            at = np.flatnonzero(np.isin(content, here))
            for part in np.array_split(at, 1 + int(np.diff(inner)[at].sum()) // 2_000_000):
                yield pa.RecordBatch.from_arrays([pa.array(content[part]), _lists([np.unique(shingles[inner[i] : inner[i + 1]]) for i in part])], ["id", "elements"])


def source(documents: DataFrame) -> DataFrame:
    """doc, words (the text) and text (a hash of it, 0 if no doc_id stands twice) of the rows with both."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("words")).where("doc IS NOT NULL AND words IS NOT NULL")
    alone = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return rows.withColumn("text", F.lit(0) if alone else F.hash("words"))


def line_classes(texts: DataFrame, units: DataFrame, percent: int) -> DataFrame:
    """content, class, low, high (smallest and largest document), n (rows) of all lines: equal lines and linked ones are of one class."""
    names = [f"k{j}" for j in range(BANDS)]
    keyed = units.where("level = 1").select("doc", "content", *[F.col("keys")[j].alias(k) for j, k in enumerate(names)])
    contents = keep(keyed.groupBy("content").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count(F.lit(1)).alias("n"), *[F.min(k).alias(k) for k in names]))
    buckets = contents.select(F.explode(F.array(*names)).alias("key"), F.col("content").alias("id"))
    shared = keep(buckets.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("key"))
    members = keep(buckets.join(small(shared), "key"))
    met = members.select(F.col("id").alias("content")).distinct()
    wanted = keep(contents.join(met, "content", "left_semi").groupBy(F.col("low").alias("doc")).agg(F.collect_set("content").alias("contents")))  # of one document
    sets = texts.join(small(wanted), "doc").select("words", "contents")
    sets = keep(map_batches(sets, _sets, "id long, elements array<long>").dropDuplicates(["id"]))
    labels = link(members.join(sets.select("id", F.size("elements").cast("long").alias("n")), "id"), sets, percent)
    told = contents.select("content", "low", "high", "n")
    if labels is None:
        return told.withColumn("class", F.col("content"))
    told = told.join(labels.select(F.col("node").alias("content"), "component"), "content", "left").withColumn("class", F.coalesce("component", "content"))
    ends = told.where("component IS NOT NULL").groupBy("class").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.sum("n").alias("all"))
    told = keep(told.join(ends, "class", "left").select("content", "class", F.coalesce("least", "low").alias("low"), F.coalesce("most", "high").alias("high"), F.coalesce("all", "n").alias("n")))
    forget(contents, shared, members, wanted, sets)
    return told


def line_copies(texts: DataFrame, units: DataFrame, percent: int, within: bool) -> DataFrame:
    """doc, text, start, size, hub, hub_start of the lines of a class that has a line in an earlier document, the hub, or (``within``) before them in the same one."""
    classes = line_classes(texts, units, percent)
    lined = units.where("level = 1").select("doc", "text", "start", "size", "content")
    lined = lined.join(classes.where("n > 1" if within else "low < high"), "content").select("doc", "text", "start", "size", "class", F.col("low").alias("hub"))
    firsts = lined.where("doc = hub").groupBy("class").agg(F.min("start").alias("hub_start"))
    return lined.join(firsts, "class").where(_later(within)).select(*HITS)


def _later(within: bool) -> Column:
    return (F.col("doc") != F.col("hub")) | (F.lit(within) & (F.col("start") >= F.col("hub_start") + F.col("size")))


def _sorted_copies(batches, within: bool):
    """Rows of sorted paragraphs with the first of their content as hub: kind 0, those that are copies of it.

    A content may be spread over partitions, so all rows of a partition's first content go out as kind 1, and
    the hubs of its first and last contents as kind 2. Nothing is held but the current hub.
    """
    names = ["kind", *HITS, "content"]
    first = last = None  # (content, doc, start, size, text) of the first row of the first and of the current content
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        doc, text, start, size, content = (batch.column(i).to_numpy() for i in range(5))
        row = lambda i: tuple(int(x[i]) for x in (content, doc, start, size, text))  # noqa: E731, B023
        first = first or row(0)
        last = last or first
        begins = np.concatenate(([content[0] != last[0]], content[1:] != content[:-1]))
        of = np.maximum.accumulate(np.where(begins, np.arange(n), -1))
        hub, hub_start = np.where(of >= 0, doc[of], last[1]), np.where(of >= 0, start[of], last[2])
        early = content == first[0]
        at = np.flatnonzero(early | (doc != hub) | (within & (start >= hub_start + size)))
        columns = [early.astype(np.int32), doc, text, start, size, hub, hub_start, content]
        yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in columns], names)
        if of[-1] >= 0:
            last = row(of[-1])
    for x in {first, last} - {None}:
        columns = [2, x[1], x[4], x[2], x[3], x[1], x[2], x[0]]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(columns, types, strict=True)], names)


def cut_copies(units: DataFrame, within: bool) -> DataFrame:
    """doc, text, start, size, hub, hub_start of the content-defined paragraphs that stand in an earlier document, the hub.

    One sort by content, dealt by ranges of (content, doc, start), so that a content of many rows lies in many partitions.
    """
    order = ["content", "doc", "start"]
    dealt = units.where("level = 0").select("doc", "text", "start", "size", "content").repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "kind int, doc long, text int, start int, size int, hub long, hub_start int, content long"
    found = keep(dealt.mapInArrow(partial(_sorted_copies, within=within), schema))
    # two rows for each partition
    ends = found.where("kind = 2").groupBy("content").agg(F.min(F.struct("hub", "hub_start")).alias("hub")).select("content", "hub.hub", "hub.hub_start")
    spread = found.where("kind = 1").drop("hub", "hub_start").join(F.broadcast(ends), "content").where(_later(within))
    return found.where("kind = 0").select(*HITS).union(spread.select(*HITS))


def _merged(group: np.ndarray, start: np.ndarray, end: np.ndarray, overlap: int) -> np.ndarray:
    """The number of the run of each interval; intervals are sorted by group and start, and those of a run overlap by so much."""
    top = np.int64(1) << 40
    reach = np.maximum.accumulate(group * top + end)
    begins = np.ones(len(start), bool)
    begins[1:] = (group[1:] != group[:-1]) | (start[1:] > reach[:-1] - group[1:] * top - overlap)
    return np.cumsum(begins) - 1


def _runs(batch: pa.RecordBatch, least: int, bridged: int):
    """The parts of each run of copied paragraphs, by the earlier document: where they lie here and there.

    A run has ``least`` words, or ``bridged`` if paragraphs that lie apart support each other, and a third of its words are in copies.
    """
    docs, units = batch.column(0), batch.column(1)
    if not len(units.values):
        return
    of = kernels.owners(units.offsets.to_numpy() - units.offsets[0].as_py())
    start, size, hub, there = (units.flatten().field(x).to_numpy().astype(np.int64) for x in ("start", "size", "hub", "hub_start"))
    end, drift = start + size, start - there
    # a part of its own for each earlier document, bridges over what differs included
    order = np.lexsort((end, start, hub, of))
    of, start, end, hub, there, drift = (x[order] for x in (of, start, end, hub, there, drift))
    fresh = np.ones(len(of), bool)
    fresh[1:] = (of[1:] != of[:-1]) | (hub[1:] != hub[:-1])
    group = np.cumsum(fresh) - 1
    top = np.int64(1) << 40
    reach = np.maximum.accumulate(group * top + end)
    before = np.concatenate(([0], reach[:-1])) - group * top
    near = np.zeros(len(of), bool)
    near[1:] = ~fresh[1:] & (start[1:] - before[1:] <= HOLE) & (np.abs(drift[1:] - drift[:-1]) <= DRIFT)
    begin = np.where(near, np.minimum(start, before - SHINGLE), start)
    own = np.maximum(end - np.maximum(start, np.where(fresh, 0, before)), 0)
    part = np.cumsum(fresh | (begin > before)) - 1
    head = np.flatnonzero(np.diff(part, prepend=-1))
    of, hub = of[head], hub[head]
    low, high = np.minimum.reduceat(begin, head), np.maximum.reduceat(end, head)
    there_low, there_high = np.minimum.reduceat(there, head), np.maximum.reduceat(there + (end - start), head)
    own, bridge = np.add.reduceat(own, head), np.logical_or.reduceat(near & (start > before), head)
    # parts that overlap by a shingle are one run, whatever documents they go to
    order = np.lexsort((high, low, of))
    of, hub, low, high, there_low, there_high, own, bridge = (x[order] for x in (of, hub, low, high, there_low, there_high, own, bridge))
    run = _merged(of, low, high, SHINGLE)
    head = np.flatnonzero(np.diff(run, prepend=-1))
    length = np.maximum.reduceat(high, head) - np.minimum.reduceat(low, head)
    enough = np.where(np.logical_or.reduceat(bridge, head), bridged, least)
    good = ((length >= enough) & (3 * np.add.reduceat(own, head) >= length))[run]
    at = np.flatnonzero(good)
    if len(at):
        columns = [low, high, hub, there_low, there_high, low[head][run]]
        yield pa.RecordBatch.from_arrays([docs.take(pa.array(of[at])), *[pa.array(x[at]) for x in columns]], ["doc", "low", "high", "hub_doc", "hub_low", "hub_high", "run"])


def _placed(runs: DataFrame) -> DataFrame:
    """``runs`` with node: the place in the earlier document that a part goes to; places that overlap are one."""
    spans = runs.select("hub_doc", "hub_low", "hub_high").distinct()
    order = Window.partitionBy("hub_doc").orderBy("hub_low", "hub_high")  # of one document
    reach = F.max("hub_high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(reach > F.col("hub_low"), 0).otherwise(1))
    spans = spans.withColumn("place", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.withColumn("node", F.xxhash64("hub_doc", "place")).drop("new", "place")
    return runs.join(spans, ["hub_doc", "hub_low", "hub_high"])


def _linked(placed: DataFrame) -> DataFrame:
    """(a, b) of the places that belong together: those of one run, and those whose words are part of a run themselves."""
    runs = placed.groupBy("doc", "text", "run").agg(F.min("node").alias("a"))
    within = placed.join(runs, ["doc", "text", "run"]).select("a", F.col("node").alias("b"))
    places = placed.groupBy("hub_doc", "node").agg(F.min("hub_low").alias("from"), F.max("hub_high").alias("to"))
    # both sides in order along a document: a part and the places open at its start, or opened within it
    parts = placed.select(F.col("doc").alias("at"), F.col("low").alias("from"), F.col("high").alias("to"), F.lit(0).alias("kind"), F.col("node"))
    spans = places.join(parts.select(F.col("at").alias("hub_doc")).distinct(), "hub_doc", "left_semi").select(F.col("hub_doc").alias("at"), "from", "to", F.lit(1).alias("kind"), "node")
    both = parts.union(spans)
    along = Window.partitionBy("at").orderBy("from", "to", "kind", "node")
    reach = F.max("to").over(along.rowsBetween(Window.unboundedPreceding, -1))
    swept = both.withColumn("stretch", F.sum(F.when(reach > F.col("from"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    ends = swept.groupBy("at", "stretch").agg(F.min("node").alias("a"))
    across = swept.join(ends, ["at", "stretch"]).select("a", F.col("node").alias("b"))
    return within.union(across).where("a <> b").distinct()


def repeated(documents: DataFrame, percent: int = 80, least: int = 26, bridged: int = 20, seed: int = 23, within: bool = False) -> DataFrame:
    """doc_id, first_word, n_words, kept_doc_id, cluster_id: the passages to remove, each but the copy that stays.

    Words are counted from 0. Paragraphs are content-defined ones, and lines of 14 words or more that
    are equal or linked at ``percent``. A passage is a run of at least ``least`` words of paragraphs that
    have a copy in an earlier document (by doc_id), whichever it is; they overlap by five words, or lie at most
    40 words apart and as far in one earlier document (then ``bridged`` words are enough, a third of them in paragraphs). A row is the
    part of a run that goes to one earlier document. Content-defined cuts take up to 9 words off either end,
    so every passage of more than 50 words is found and spans lie within it. The document with
    the smallest doc_id keeps its copy. With ``within`` a later copy in the same document is found too.
    cluster_id joins passages whose places overlap anywhere.

    Null and empty texts, texts of fewer than five words and rows with a null doc_id have no passages;
    rows that repeat a doc_id are one document, each with its own spans; extra columns are ignored.
    """
    texts = source(documents)
    units = keep(map_batches(texts, partial(_units, seed=seed), SCHEMA))
    hits = cut_copies(units, within).union(line_copies(texts, units, percent, within)).groupBy("doc", "text")
    hits = hits.agg(F.collect_list(F.struct("start", "size", "hub", "hub_start")).alias("units"))  # of one document
    runs = map_batches(hits.select(F.struct("doc", "text").alias("doc"), "units"), partial(_runs, least=least, bridged=bridged), "doc struct<doc: long, text: int>, low long, high long, hub_doc long, hub_low long, hub_high long, run long")
    runs = keep(runs.select("doc.doc", "doc.text", "low", "high", "hub_doc", "hub_low", "hub_high", "run").distinct())
    forget(units)
    placed = keep(_placed(runs))
    out = placed.select(F.col("doc").alias("doc_id"), F.col("low").alias("first_word"), (F.col("high") - F.col("low")).alias("n_words"), F.col("hub_doc").alias("kept_doc_id"), "node")
    edges = keep(_linked(placed))
    if edges.isEmpty():
        return out.withColumnRenamed("node", "cluster_id")
    labels = components(edges).select(F.col("node").alias("of"), "component")
    return out.join(labels, F.col("node") == F.col("of"), "left").select("doc_id", "first_word", "n_words", "kept_doc_id", F.coalesce("component", "node").alias("cluster_id"))
