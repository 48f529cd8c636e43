"""Benchmark decontamination by greedy string tiling over running Karp-Rabin hashes.

The benchmark is a stated query set: it is read in blocks of bounded size and each block is broadcast
and run against all documents, so no text is shuffled. Windows of ``min_match`` words, hashed by rolling
(Karp-Rabin), that a document shares with an item are seeds. Items of which seeds can cover too little
are left out; for the others seeds join along a diagonal into matches, which are compared word by word,
and the longest match that no earlier tile overlaps becomes the next tile, until none is left. Tiles may
stand in any order, so reordered passages count in full.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import kernels

#: Words of benchmark text that are broadcast at once (about 40 bytes a word).
BLOCK_WORDS = 2_000_000
_BITS = 1 << 22
#: Pairs of a seed and an item that are laid out at once.
_PAIRS = 1 << 22
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def rolled(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hashes of the windows of k words within a text, from running sums, and the index of each text's first window."""
    n = len(words)
    windows = np.maximum(np.diff(first) - k + 1, 0)
    limits = np.concatenate(([0], np.cumsum(windows)))
    at = np.arange(int(limits[-1]), dtype=np.int64) + np.repeat(first[:-1] - limits[:-1], windows)
    if not len(at):
        return np.zeros(0, np.uint64), limits
    up, down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, x, np.uint64)))) for x in (_BASE, _INVERSE))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[:n])))
    return kernels.mix((total[at + k] - total[at]) * down[at]), limits


def tile(pairs: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Tiles (document word, item word, length) from seeds (document word, item word) of k words.

    The longest match goes first; of equal ones the first in the item, then in the document.
    """
    order = np.lexsort((pairs[:, 0], pairs[:, 0] - pairs[:, 1]))
    at, of = pairs[order, 0], pairs[order, 1]
    breaks = np.flatnonzero((np.diff(at - of) != 0) | (np.diff(at) != 1)) + 1
    first = np.concatenate(([0], breaks))
    last = np.concatenate((breaks, [len(at)])) - 1
    heap = [(-int(at[b] - at[a] + k), int(of[a]), int(at[a])) for a, b in zip(first, last, strict=True)]
    heapq.heapify(heap)
    in_text, in_item, tiles = set(), set(), []
    while heap:
        n, j, i = heapq.heappop(heap)
        free = [x for x in range(-n) if i + x not in in_text and j + x not in in_item]
        if len(free) == -n:
            tiles.append((i, j, -n))
            in_text.update(range(i, i - n))
            in_item.update(range(j, j - n))
            continue
        run = 0
        for p, x in enumerate(free):
            run += 1
            if p + 1 == len(free) or free[p + 1] != x + 1:
                if run >= k:
                    heapq.heappush(heap, (-run, j + x - run + 1, i + x - run + 1))
                run = 0
    return tiles


def _words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, index of each text's first word) of chunks; words are lower-cased letters and digits."""
    for low, _, data, offsets in kernels.chunks(texts):
        data = kernels.lowered(data)
        starts, ends, first = kernels.spans(data, offsets, signs=True)
        yield low, kernels.span_hashes(data, starts, ends), first


class _Block:
    """Items of a block: their words, and their seeds in the order of the items and of the hashes."""

    def __init__(self, ids: list[int], words: list[np.ndarray], k: int) -> None:
        self.ids = np.array(ids)
        self.sizes = np.array([len(w) for w in words])
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.words = np.concatenate(words)
        seeds, self.limits = rolled(self.words, self.first, k)
        item = kernels.owners(self.limits)
        place = np.arange(len(seeds)) - self.limits[:-1][item]
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.items, self.places = seeds[order], item[order], place[order]
        self.marks = np.zeros(_BITS, bool)
        self.marks[(seeds & np.uint64(_BITS - 1)).astype(np.int64)] = True
        self.short: dict[bytes, list[int]] = {}
        for i in np.flatnonzero((self.sizes < k) & (self.sizes > 0)):
            self.short.setdefault(self.of(i).tobytes(), []).append(int(i))

    def of(self, item: int) -> np.ndarray:
        return self.words[self.first[item] : self.first[item + 1]]


def _blocks(benchmark: DataFrame, k: int, block_words: int) -> Iterator[_Block]:
    ids, words, total = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    for row in rows.toLocalIterator():
        for _, found, _ in _words(pa.array([row["text"]])):
            if len(found):
                ids.append(row["item_id"])
                words.append(found)
                total += len(found)
        if total >= block_words:
            yield _Block(ids, words, k)
            ids, words, total = [], [], 0
    if ids:
        yield _Block(ids, words, k)


def contamination(documents: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, n_words (of the item), n_covered, n_tiles, coverage: the pairs at or above the coverage.

    ``coverage`` is the share of the item's words in tiles of at least ``min_match`` words. An item with
    fewer words than that is found in texts that have its words and no others. Items without a word, null items and items
    with a null item_id are never found; null and empty texts contain nothing; a null doc_id is reported as null. Repeated rows of documents are each
    reported, repeated item_ids each compared. Extra columns are ignored.
    """
    spark = documents.sparkSession
    schema = "doc_id long, item_id long, n_words long, n_covered long, n_tiles long, coverage double"
    found = []
    for block in _blocks(benchmark, min_match, block_words):
        shared = spark.sparkContext.broadcast(block)
        find = _finder(shared, min_match, coverage)

        def run(batches, find=find):
            for batch in batches:
                rows = [(batch.column(0)[i].as_py(), *more) for i, *more in find(batch.column(1))]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = [pa.int64()] * 5 + [pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "n_words", "n_covered", "n_tiles", "coverage"])

        found.append(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema))
    if not found:
        return spark.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _hopeful(block: _Block, windows: np.ndarray, limits: np.ndarray, k: int, least: float) -> Iterator[tuple[int, int]]:
    """(text, item) where the item's words under seeds of the text are enough; each seed of a text counts once."""
    near = np.flatnonzero(block.marks[(windows & np.uint64(_BITS - 1)).astype(np.int64)])
    left = np.searchsorted(block.seeds, windows[near], "left")
    count = np.searchsorted(block.seeds, windows[near], "right") - left
    text = np.searchsorted(limits, near[count > 0], "right") - 1
    text, left = np.unique(np.stack((text, left[count > 0])), axis=1)
    count = np.searchsorted(block.seeds, block.seeds[left], "right") - left
    # whole texts at a time
    total = np.cumsum(count)
    edges = np.flatnonzero(np.diff(text)) + 1
    cuts = edges[np.flatnonzero(np.diff((total[edges - 1]) // _PAIRS, prepend=0))] if len(edges) else edges
    for part in np.split(np.arange(len(text)), cuts):
        n = count[part]
        seed = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left[part], n)
        of, item, place = np.repeat(text[part], n), block.items[seed], block.places[seed]
        order = np.lexsort((place, item, of))
        of, item, place = of[order], item[order], place[order]
        begins = np.ones(len(of), bool)
        begins[1:] = (of[1:] != of[:-1]) | (item[1:] != item[:-1])
        step = np.full(len(of), k)
        step[:-1] = np.where(begins[1:], k, np.minimum(np.diff(place), k))
        head = np.flatnonzero(begins)
        if len(head):
            good = np.add.reduceat(step, head) >= least * block.sizes[item[head]]
            yield from zip(of[head][good].tolist(), item[head][good].tolist(), strict=True)


def _finder(shared, k: int, least: float):
    """A function that gives (place, item_id, n_words, n_covered, n_tiles, coverage) of the texts of an array that contain an item."""

    def compared(block: _Block, item: int, words: np.ndarray, windows: np.ndarray):
        """The tiles of a text and an item, each equal word by word."""
        own, _ = rolled(block.of(item), np.array([0, block.sizes[item]]), k)
        order = np.argsort(own, kind="stable")
        left = np.searchsorted(own[order], windows, "left")
        count = np.searchsorted(own[order], windows, "right") - left
        at = np.repeat(np.arange(len(windows)), count)
        place = order[np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left, count)]
        same = np.ones(len(at), bool)
        for j in range(k):
            same &= words[at + j] == block.of(item)[place + j]
        return tile(np.stack((at[same], place[same]), axis=1), k) if same.any() else []

    def find(texts: pa.Array) -> Iterator[tuple]:
        block = shared.value
        for low, words, first in _words(texts):
            for t in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < k)) if block.short else ():
                for item in block.short.get(words[first[t] : first[t + 1]].tobytes(), ()):
                    n = int(block.sizes[item])
                    yield low + int(t), int(block.ids[item]), n, n, 1, 1.0
            windows, limits = rolled(words, first, k)
            for t, item in _hopeful(block, windows, limits, k, least) if len(windows) else ():
                n = int(block.sizes[item])
                tiles = compared(block, item, words[first[t] : first[t + 1]], windows[limits[t] : limits[t + 1]])
                covered = sum(x[2] for x in tiles)
                if covered and covered >= least * n:
                    yield low + t, int(block.ids[item]), n, covered, len(tiles), covered / n

    return find


def decontaminated(documents: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without those that contain an item, with all their columns.

    Each row goes or stays by its own text, in the task that reads it: null and repeated ids change nothing, and no column of another name is made. Where
    the benchmark has several blocks, the rows pass by one after another.
    """
    at, schema = documents.columns.index("text"), documents.schema
    for block in _blocks(benchmark, min_match, block_words):
        find = _finder(documents.sparkSession.sparkContext.broadcast(block), min_match, coverage)

        def run(batches, find=find):
            for batch in batches:
                keep_ = np.ones(batch.num_rows, bool)
                keep_[[i for i, *_ in find(batch.column(at))]] = False
                yield batch.filter(pa.array(keep_))

        documents = documents.mapInArrow(run, schema)
    return documents
