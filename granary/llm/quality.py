"""Quality rules: counts over whole texts and tokeniser fertility with rejection bands per script.

Two public vocabularies measure every text: a piece vocabulary with byte fallback (characters per
token, share of byte-fallback tokens, token entropy) and a byte-level one for many languages
(characters per token). Each distinct word of a chunk of texts is tokenised once and its tokens are
spread over the texts by numpy. Vocabulary files reach the executors by broadcast.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.llm import kernels

#: Where the vocabulary files lie; both are parameters of ``measured``.
PIECES = os.environ.get("GRANARY_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
BYTE_PAIRS = os.environ.get("GRANARY_BYTE_PAIRS", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: A vocabulary file may be broadcast up to this size.
VOCABULARY_BYTES = 64 << 20
#: Fixed value: the split pattern that belongs to the byte-pair vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are measured in chunks of about so many bytes.
CHUNK = 4 << 20
#: Words tokenised at once, and tokens spread over their texts at once. The tokens of a longer text go by themselves.
WORDS, TOKENS = 1 << 14, 1 << 18

SCRIPTS = ("latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "cjk", "other")
#: Rejection bands per script: least and most characters per piece, least characters per byte-level token, most byte-fallback share, least entropy as a share of its maximum (for texts of 32 tokens or more).
BANDS = {
    "latin": (1.4, 8.0, 1.7, 0.10, 0.45),
    "greek": (0.5, 4.0, 0.5, 0.30, 0.35),
    "cyrillic": (1.0, 6.0, 0.8, 0.15, 0.35),
    "hebrew": (0.4, 4.0, 0.4, 0.30, 0.35),
    "arabic": (0.4, 4.0, 0.4, 0.30, 0.35),
    "indic": (0.2, 3.0, 0.2, 0.80, 0.35),
    "cjk": (0.2, 3.0, 0.2, 0.85, 0.35),
    "other": (0.2, 8.0, 0.2, 1.00, 0.25),
}
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, "
    "n_tokens long, n_byte_tokens long, chars_per_token double, chars_per_byte_pair double, byte_share double, entropy double, entropy_share double"
)


def _script_table() -> np.ndarray:
    """The script that a UTF-8 lead byte stands for; -1: no letter."""
    table = np.full(256, -1, np.int8)
    table[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 0
    for number, low, high in ((0, 0xC3, 0xCA), (1, 0xCE, 0xD0), (2, 0xD0, 0xD5), (3, 0xD6, 0xD8), (4, 0xD8, 0xDC), (5, 0xE0, 0xE1), (7, 0xE1, 0xE2), (6, 0xE3, 0xEE)):
        table[low:high] = number
    return table


_SCRIPT = _script_table()
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_loaded: dict[str, tuple] = {}


def _tokenizers(pieces: bytes, pairs: bytes):
    """Both tokenizers, loaded once in each Python worker."""
    import sentencepiece
    import tiktoken

    key = f"{hash(pieces)}-{hash(pairs)}"
    if key not in _loaded:
        model = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in pairs.splitlines() if line)}
        coding = tiktoken.Encoding("granary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        fallback = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
        _loaded.clear()
        _loaded[key] = model, coding, fallback
    return _loaded[key]


def sums(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Sums of the runs of values between limits; an empty run has 0."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[limits[1:]] - total[limits[:-1]]


def trues(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """How many values are true in the runs between limits, without a number for each value."""
    ends = limits.tolist()
    return np.fromiter((np.count_nonzero(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)), np.int64, len(ends) - 1)


def repeat_words(words: np.ndarray, first: np.ndarray, k: int = 5) -> np.ndarray:
    """Words of each text in k-word windows that its text has twice or more."""
    windows, limits = kernels.window_hashes(words, first, k)
    if not len(windows):
        return np.zeros(len(first) - 1, np.int64)
    text = kernels.owners(limits)
    keys = kernels.mix(windows ^ kernels.mix(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    often = np.zeros(len(keys), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    at = np.flatnonzero(often)
    start = at - limits[:-1][text[at]] + first[:-1][text[at]]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + k, -1)
    return trues(np.cumsum(edge[:-1]) > 0, first)


def dup_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Lines of each text that have a word and equal an earlier line of it."""
    newline = np.flatnonzero(data == 10)
    begins = np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], newline + 1)))
    begins = begins[begins < len(data)]
    if not len(begins):
        return np.zeros(len(offsets) - 1, np.int64)
    stops = np.concatenate((begins[1:], [len(data)]))
    ends = np.where(data[stops - 1] == 10, stops - 1, stops)
    worded = np.diff(np.concatenate((np.searchsorted(starts, begins), [len(starts)]))) > 0
    begins, ends = begins[worded], ends[worded]
    text = np.searchsorted(offsets, begins, "right") - 1
    keys = kernels.mix(kernels.span_hashes(data, begins, ends) ^ kernels.mix(text.astype(np.uint64) + np.uint64(1)))
    distinct = np.unique(keys, return_index=True)[1]
    n = len(offsets) - 1
    return np.bincount(text, minlength=n) - np.bincount(text[distinct], minlength=n)


def fertility(data, offsets, starts, ends, first, hashes, letters, tokenizers) -> dict[str, np.ndarray]:
    """Token measures of each text of a chunk."""
    model, coding, fallback = tokenizers
    n = len(offsets) - 1
    zero = np.zeros(n)
    if not len(starts):
        return {"n_tokens": zero.astype(int), "n_byte_tokens": zero.astype(int), "n_pairs": zero.astype(int), "entropy": zero}
    _, example, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    parts, sizes, pairs = [], np.zeros(len(example), np.int64), np.zeros(len(example), np.int64)
    # lists of tokens are Python objects: they go into an array every so many words
    for low in range(0, len(example), WORDS):
        own = example[low : low + WORDS]
        words = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
        ids = model.encode(words, num_threads=1)
        sizes[low : low + WORDS] = np.fromiter((len(x) for x in ids), np.int64, len(ids))
        pairs[low : low + WORDS] = [len(coding.encode_ordinary(f" {w}")) for w in words]
        parts.append(np.fromiter((t for x in ids for t in x), np.int32, int(sizes[low : low + WORDS].sum())))
    flat = np.concatenate(parts)
    head = np.cumsum(sizes) - sizes
    text = kernels.owners(first)
    counts = sizes[inverse]
    n_tokens = np.bincount(text, counts, n).astype(np.int64)
    limits = np.concatenate(([0], np.cumsum(n_tokens)))
    spread, n_byte_tokens = np.zeros(n), np.zeros(n, np.int64)
    low = 0
    while low < n:
        # the tokens of a chunk at once would take thirty times the text
        high = max(int(np.searchsorted(limits, limits[low] + TOKENS, "right")) - 1, low + 1)
        own = slice(first[low], first[high])
        size = counts[own]
        at = np.arange(int(size.sum())) + np.repeat(head[inverse[own]] - np.cumsum(size) + size, size)
        tokens = flat[at]
        keys, times = np.unique(np.repeat(np.arange(high - low), n_tokens[low:high]) * len(fallback) + tokens, return_counts=True)
        spread[low:high] = np.bincount(keys // len(fallback), times * np.log2(times), high - low)
        n_byte_tokens[low:high] = trues(fallback[tokens], limits[low : high + 1] - limits[low])
        low = high
    entropy = np.where(n_tokens > 0, np.log2(np.maximum(n_tokens, 1)) - spread / np.maximum(n_tokens, 1), 0.0)
    return {
        "n_tokens": n_tokens,
        "n_byte_tokens": n_byte_tokens,
        "n_pairs": np.bincount(text, pairs[inverse], n).astype(np.int64),
        "entropy": np.maximum(entropy, 0.0),
    }


def _shared(documents: DataFrame, pieces: str, byte_pairs: str):
    contents = []
    for path in (pieces, byte_pairs):
        if os.path.getsize(path) > VOCABULARY_BYTES:
            raise ValueError(f"{path} is too large to be broadcast")
        with open(path, "rb") as file:
            contents.append(file.read())
    return documents.sparkSession.sparkContext.broadcast(tuple(contents))


def measured(documents: DataFrame, pieces: str = PIECES, byte_pairs: str = BYTE_PAIRS) -> DataFrame:
    """The counts and token measures of every whole text (SCHEMA), a row for each row of ``documents``.

    Null and empty texts and texts of white space have no words: all counts and measures are 0 and
    the script is 'other'. Repeated rows and rows with a null doc_id are measured like any other;
    extra columns are ignored.
    """
    shared = _shared(documents, pieces, byte_pairs)

    def run(batches):
        tokenizers = _tokenizers(*shared.value)
        for batch in batches:
            for low, high, data, offsets in kernels.chunks(batch.column(1), CHUNK):
                measures = _measured(data, offsets, tokenizers)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *measures.values()], ["doc_id", *measures])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def _measured(data: np.ndarray, offsets: np.ndarray, tokenizers) -> dict[str, pa.Array]:
    """The columns of SCHEMA after doc_id."""
    starts, ends, first = kernels.spans(data, offsets)
    hashes = kernels.span_hashes(data, starts, ends)
    lead = (data & 0xC0) != 0x80
    filled = np.zeros(len(data), bool)
    if len(data):
        filled = ~kernels._SPACE[data]
    word_chars = trues(lead & filled, offsets)
    kinds = _SCRIPT[data]
    shares = np.stack([trues(kinds == i, offsets) for i in range(len(SCRIPTS))], axis=1)
    script = np.where(shares.sum(axis=1) > 0, shares.argmax(axis=1), len(SCRIPTS) - 1)
    tokens = fertility(data, offsets, starts, ends, first, hashes, word_chars, tokenizers)
    per = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
    most = np.log2(np.clip(tokens["n_tokens"], 2, len(tokenizers[2])))
    columns = {
        "n_words": np.diff(first),
        "word_chars": word_chars,
        "n_symbols": trues(_SYMBOL[data], offsets),
        "n_dup_lines": dup_lines(data, offsets, starts),
        "n_repeat_words": repeat_words(hashes, first),
        "script": np.array(SCRIPTS, object)[script],
        "n_tokens": tokens["n_tokens"],
        "n_byte_tokens": tokens["n_byte_tokens"],
        "chars_per_token": per(word_chars, tokens["n_tokens"]),
        "chars_per_byte_pair": per(word_chars, tokens["n_pairs"]),
        "byte_share": per(tokens["n_byte_tokens"], tokens["n_tokens"]),
        "entropy": tokens["entropy"],
        "entropy_share": tokens["entropy"] / most,
    }
    return {name: pa.array(column) for name, column in columns.items()}


def judged(measures: DataFrame, bands: Mapping[str, tuple[float, float, float, float, float]] = BANDS) -> DataFrame:
    """``measured`` with base_failed, reason (the first band that is left, else null) and kept.

    base_failed: fewer than 10 words, or more than a fifth of the words in repeated 5-word windows.
    A row of a script without bands takes those of 'other'.
    """
    rules = F.create_map(*[x for s, b in bands.items() for x in (F.lit(s), F.array(*[F.lit(float(v)) for v in b]))])
    band = F.coalesce(F.try_element_at(rules, F.col("script")), F.array(*[F.lit(float(v)) for v in bands["other"]]))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    reason = (
        F.when(F.col("chars_per_token") < band[0], "pieces too short")
        .when(F.col("chars_per_token") > band[1], "pieces too long")
        .when(F.col("chars_per_byte_pair") < band[2], "byte-level tokens too short")
        .when(F.col("byte_share") > band[3], "byte fallback")
        .when((F.col("n_tokens") >= 32) & (F.col("entropy_share") < band[4]), "low entropy")
    )
    return measures.withColumn("base_failed", failed).withColumn("reason", reason).withColumn("kept", ~F.col("base_failed") & F.col("reason").isNull())


def filtered(documents: DataFrame, pieces: str = PIECES, byte_pairs: str = BYTE_PAIRS, **bands) -> DataFrame:
    """The rows that are kept, with all their columns. Every row is judged by its own text, one with a null doc_id too.

    The columns pass through the measuring task, so that no text is shuffled.
    """
    shared = _shared(documents, pieces, byte_pairs)
    names = [f"c{i}" for i in range(len(documents.columns))]
    plain = documents.toDF(*names)
    source = plain.withColumn("text", F.col(names[documents.columns.index("text")]).cast("string"))
    extra = StructType.fromDDL(SCHEMA).fields[1:]

    def run(batches):
        tokenizers = _tokenizers(*shared.value)
        for batch in batches:
            own = batch.columns[:-1]
            for low, high, data, offsets in kernels.chunks(batch.columns[-1], CHUNK):
                measures = _measured(data, offsets, tokenizers)
                yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in own), *measures.values()], [*names, *measures])

    rows = judged(source.mapInArrow(run, StructType([*plain.schema.fields, *extra])), **bands)
    return rows.where("kept").select(*names).toDF(*documents.columns)
