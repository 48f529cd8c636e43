"""Quality classifier by positive-unlabelled learning: non-negative unbiased risk of a linear model.

Trusted positives are labelled rows of quality 1; the unlabelled set is drawn from all web text,
whatever its labels. A first model of positives against unlabelled text yields the class prior, the
smallest ratio of the shares of unlabelled and of positive rows above a threshold; the scorer then
minimises the non-negative unbiased risk with that prior.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import kernels
from granary.llm.langid import fold
from granary.llm.quality import dup_lines, repeat_words, sums

#: Bound of the training sample: so many positives and so many unlabelled rows, the first by a hash of doc_id.
SAMPLE = 8000
PAIRS = 256


def _classes() -> np.ndarray:
    """Byte classes: lower, upper, digit, space, newline, not ASCII, control, and every ASCII sign by itself."""
    table = np.full(256, 6, np.int64)
    table[0x61:0x7B], table[0x41:0x5B], table[0x30:0x3A], table[0x80:] = 0, 1, 2, 5
    table[[0x20, 0x09]], table[[0x0A, 0x0D]] = 3, 4
    signs = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
    table[signs] = np.arange(len(signs)) + 7
    return table


_CLASS = _classes()
_WIDTH = int(_CLASS.max()) + 1
_PAIR = (kernels.mix(np.arange(_WIDTH * _WIDTH, dtype=np.uint64)) % np.uint64(PAIRS)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of features for each text: shares of hashed pairs of byte classes, and word statistics."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    text = np.repeat(np.arange(n), size)
    kind = _CLASS[data]
    pairs = np.zeros((n, PAIRS))
    if len(data) > 1:
        within = text[1:] == text[:-1]
        key = text[1:] * PAIRS + _PAIR[kind[:-1] * _WIDTH + kind[1:]]
        pairs = np.bincount(key[within], minlength=n * PAIRS).reshape(n, PAIRS).astype(float)
    starts, ends, first = kernels.spans(data, offsets)
    words = np.diff(first)
    hashes = kernels.span_hashes(data, starts, ends)
    owner = kernels.owners(first)
    length = ends - starts
    per_word = np.maximum(words, 1)
    distinct = np.zeros(n)
    if len(hashes):
        at = np.unique(kernels.mix(hashes ^ kernels.mix(owner.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
        distinct = np.bincount(owner[at], minlength=n)
    again = np.zeros(n)  # words equal to the word before
    if len(hashes) > 1:
        again = np.bincount(owner[1:][(hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])], minlength=n)
    per_byte = np.maximum(size, 1)
    share = lambda i: sums(kind == i, offsets) / per_byte
    stats = [
        np.log1p(words) / 10,
        sums(length, first) / per_word / 10,
        np.sqrt(np.maximum(sums(length * length, first) / per_word - (sums(length, first) / per_word) ** 2, 0)) / 10,
        distinct / per_word,
        repeat_words(hashes, first) / per_word,
        again / per_word,
        np.sqrt(again / per_word),
        again > 1 + per_word / 50,
        dup_lines(data, offsets, starts) / np.maximum(sums(data == 10, offsets) + 1, 1),
        share(1), share(2), share(3), share(4), share(5),
        sums(kind >= 7, offsets) / per_byte,
        sums((length == 1), first) / per_word,
        sums((length > 12), first) / per_word,
        (words == 0).astype(float),
        (words < 10).astype(float),
    ]
    return np.hstack((np.sqrt(pairs / per_byte[:, None]), np.stack(stats, axis=1)))


def _featured(rows: DataFrame, names: str) -> DataFrame:
    """``rows`` (tag, text) with their features."""

    def run(batches):
        for batch in batches:
            for low, high, data, offsets in kernels.chunks(batch.column(1)):
                x = features(data, offsets).astype(np.float32)
                limits = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.ListArray.from_arrays(limits, pa.array(x.ravel()))], ["tag", "x"])

    return rows.mapInArrow(run, names)


def _train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = 400, seed: int = 5) -> np.ndarray:
    """Weights (the last is the bias) by Adam on full batches with the logistic loss.

    prior None: plain positives against unlabelled. Else the non-negative risk: when the estimated
    negative part falls below 0, the step climbs it back instead of fitting it further.
    """
    p, u = (np.hstack((x, np.ones((len(x), 1)))) for x in (positive, unlabelled))
    w = np.zeros(p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        gp, gu = sigmoid(p @ w), sigmoid(u @ w)
        as_positive = p.T @ (gp - 1) / len(p)  # of the mean of log(1 + exp(-z)) over positives
        as_negative = p.T @ gp / len(p)
        free = u.T @ gu / len(u)
        if prior is None:
            gradient = as_positive + free
        else:
            loss = np.mean(np.logaddexp(0, u @ w)) - prior * np.mean(np.logaddexp(0, p @ w))
            gradient = prior * as_positive + (free - prior * as_negative if loss >= 0 else prior * as_negative - free)
        gradient = gradient + 1e-4 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.1) -> float:
    """The share of positives among unlabelled scores: the ratio of upper tails where its upper bound, with a margin for chance, is least."""
    at = np.quantile(positive, np.linspace(0, 1 - least, 91))
    up, uu = np.sort(positive), np.sort(unlabelled)
    tail_p = 1 - np.searchsorted(up, at) / len(up)
    tail_u = 1 - np.searchsorted(uu, at) / len(uu)
    margin = np.sqrt(np.log(100) / (2 * len(uu)))
    tail_p = np.maximum(tail_p, 1e-9)
    best = np.argmin((tail_u + margin) / tail_p)
    return float(np.clip(tail_u[best] / tail_p[best], 0.05, 0.97))


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray] | None:
    """Scaling and weights from rows outside fold 0, or None without a positive or unlabelled row.

    Reads text and labels.quality; lang, source and doc_id are no features. A document with several
    label rows is positive if one of them has quality 1.
    """
    spark = documents.sparkSession
    order = F.xxhash64("id", F.lit("quality"))
    pick = lambda ids: ids.where((fold(F.col("id")) != 0)).distinct().orderBy(order, "id").limit(sample)
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text"))
    sets = []
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("id"))
    for ids in (pick(good), pick(texts.select("id"))):
        chosen = spark.createDataFrame([(r["id"],) for r in ids.collect()], "id long")
        rows = texts.join(F.broadcast(chosen), "id").select(F.col("id").alias("tag"), "text").dropDuplicates(["tag"])
        frame = _featured(rows, "tag long, x array<float>").toPandas().sort_values("tag")
        if not len(frame):
            return None
        sets.append(np.stack(frame["x"].to_numpy()).astype(float))
    positive, unlabelled = sets
    mean, scale = unlabelled.mean(axis=0), np.maximum(unlabelled.std(axis=0), 1e-3)
    positive, unlabelled = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    first = _train(positive[::2], unlabelled[::2], None) if len(positive) > 1 and len(unlabelled) > 1 else _train(positive, unlabelled, None)
    prior = class_prior(positive[1::2] @ first[:-1], unlabelled[1::2] @ first[:-1]) if len(positive) > 1 and len(unlabelled) > 1 else 0.5
    return {"mean": mean, "scale": scale, "weights": _train(positive, unlabelled, prior), "prior": np.array(prior)}


def score(documents: DataFrame, model: dict[str, np.ndarray] | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold), a row for each row of documents.

    Null and empty texts are scored as texts without words. Without a model every score is 0. A null
    doc_id counts as held out.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for low, high, data, offsets in kernels.chunks(batch.column(2)):
                if model is None:
                    s = np.zeros(high - low)
                else:
                    x = np.clip((features(data, offsets).astype(np.float32) - model["mean"]) / model["scale"], -8, 8)
                    s = 1 / (1 + np.exp(-np.clip(x @ model["weights"][:-1] + model["weights"][-1], -40, 40)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    rows = rows.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(documents: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """Learn outside fold 0 and score every row."""
    return score(documents, learn(documents, labels, **parameters))
