"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import kernels
from granary.llm.common import map_batches

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Bound of the training sample: about so many texts of each language are counted, chosen by a hash of doc_id.
TEXTS_PER_LANGUAGE = 4000
#: The log-probability matrix is broadcast: 4 bytes * BUCKETS * languages, 32 MB at most.
MOST_LANGUAGES = 128
#: So many log-probabilities are looked up at once.
SCORED = 1 << 23


def fold(doc_id) -> F.Column:
    """crc32 of the doc_id as text, modulo 5; fold 0 and null are held out."""
    return F.crc32(doc_id.cast("string")) % 5


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Lower case of every code point that is a letter, 32 for the others."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def grams(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS):
    """For each order: the buckets of all character n-grams and the index of each text's first one.

    Whatever is no letter counts as a space; n-grams of spaces alone are left out by the caller's
    weights, being the same for all languages' texts they carry little.
    """
    points = letters()[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    first = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    filled = np.concatenate(([0], np.cumsum(points != 32)))
    yield points, first, filled
    for k in orders:
        n = np.maximum(np.diff(first) - k + 1, 0)
        limits = np.concatenate(([0], np.cumsum(n)))
        key = np.zeros(max(len(points) - k + 1, 0), np.uint64)
        for j in range(k):
            key = key * np.uint64(0x9E3779B97F4A7C15) + points[j : j + len(key)]
        bucket = (kernels.mix(key + np.uint64(k)) & np.uint64(buckets - 1)).astype(np.int32)
        if len(n) > 1:
            inside = np.ones(len(key), bool)
            for edge in first[1:-1]:
                inside[max(edge - k + 1, 0) : edge] = False
            bucket = bucket[inside[: len(bucket)]]
        yield bucket[: limits[-1]], limits


def learn(documents: DataFrame, texts_per_language: int = TEXTS_PER_LANGUAGE, buckets: int = BUCKETS, smoothing: float = 0.5):
    """(languages, log priors, log-probability matrix of buckets x languages) from rows outside fold 0.

    Only text and a non-null lang are read. Class counts cover all rows; n-grams are counted over
    about ``texts_per_language`` texts of each language. No labelled row: no languages.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where((fold(F.col("id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError("too many languages for a broadcast matrix")
    languages = sorted(counts)
    if not languages:
        return [], np.zeros(0), np.zeros((buckets, 0), np.float32)
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, texts_per_language / counts[name]))])
    u = (F.xxhash64("id", F.lit("language")).bitwiseAND(F.lit((1 << 30) - 1))) / float(1 << 30)
    sample = rows.where(u < F.element_at(share, F.col("lang")))

    column = {name: i for i, name in enumerate(languages)}

    def count(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            for low, high, data, offsets in kernels.chunks(batch.column(0)):
                parts = grams(data, offsets, buckets)
                next(parts)
                for bucket, limits in parts:
                    for i in range(high - low):
                        total = totals.setdefault(column[names[low + i]], np.zeros(buckets, np.int64))
                        total += np.bincount(bucket[limits[i] : limits[i + 1]], minlength=buckets)
        for i, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["lang", "bucket", "n"])

    partial = sample.select("text", "lang").repartition(12).mapInArrow(count, "lang int, bucket int, n long")
    total = partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    matrix = np.full((buckets, len(languages)), smoothing)
    matrix[total["bucket"].to_numpy(), total["lang"].to_numpy()] += total["n"].to_numpy()
    matrix = np.log(matrix / matrix.sum(axis=0)).astype(np.float32)
    n = np.array([counts[name] for name in languages], float)
    return languages, np.log(n / n.sum()), matrix


def predict(documents: DataFrame, languages: list[str], priors: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score (posterior of lang_pred), a row for each row of documents.

    A null text, one without a letter, and every text if no language was learnt: 'und' with score 0.
    Ties go to the language whose name is smallest. A null doc_id counts as held out.
    """
    model = documents.sparkSession.sparkContext.broadcast((languages, priors, matrix))

    def run(batches):
        languages, priors, matrix = model.value
        names = np.array([*languages, "und"], object)
        step = SCORED // max(len(languages), 1)
        for batch in batches:
            for low, high, data, offsets in kernels.chunks(batch.column(2)):
                n = high - low
                parts = grams(data, offsets, len(matrix))
                _, first, filled = next(parts)
                worded = filled[first[1:]] > filled[first[:-1]]
                best, score = np.full(n, len(languages)), np.zeros(n)
                if languages and worded.any():
                    total = np.tile(priors, (n, 1))
                    for bucket, limits in parts:
                        for start in range(0, len(bucket), step):
                            part = np.clip(limits - start, 0, step)
                            have = np.flatnonzero(np.diff(part))
                            total[have] += np.add.reduceat(matrix[bucket[start : start + step]], part[:-1][have], axis=0, dtype=np.float64)
                    top = total.argmax(axis=1)
                    odds = np.exp(total - total.max(axis=1, keepdims=True))
                    best = np.where(worded, top, best)
                    score = np.where(worded, 1 / odds.sum(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, n), batch.column(1).slice(low, n), pa.array(names[best], pa.string()), pa.array(score)],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    rows = rows.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(documents: DataFrame, **parameters) -> DataFrame:
    """Learn from the rows outside fold 0 and predict every row."""
    return predict(documents, *learn(documents, **parameters))
