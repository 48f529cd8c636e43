"""Fill-in-middle over an index of distinct texts: each text's token ends once, as an Elias-Fano list, and every document's seeded cut selected from it.

Texts are the same if their SHA-256 and their length agree (within a task the texts themselves are compared). A task lists each distinct
text that it meets once, and the shuffle keeps one list a text: some 0.2 bytes a character, without the texts. Documents meet it on
(SHA-256, length, part): a text with more than ``MOST`` documents has a copy of its list for each so many of them, and its documents are dealt over the
parts, so that no task gets more of one text. The cut is an element of the list, and everything else is done by column functions.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from granary.llm.common import keep, small

MARKS = ("<P>", "<S>", "<M>")
#: Of h3 % 100 and h4 % 100: documents from PLAIN on stay as they are, below SPM the suffix comes first.
PLAIN, SPM = 90, 20
#: Set bits between two sampled places of a list's upper part, and texts that a task remembers having listed.
SAMPLE, REMEMBERED = 256, 50_000
#: Documents of one text in one part.
MOST = 1_000


def ends(text: str) -> np.ndarray:
    """Code points up to the end of each token `[A-Za-z]+|[^A-Za-z]`."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = points | 32
    letter = (low >= 97) & (low <= 122) & (points < 128)
    inside = np.zeros(len(points), bool)
    inside[:-1] = letter[:-1] & letter[1:]
    return np.flatnonzero(~inside).astype(np.int64) + 1


def encode(values: np.ndarray) -> bytes:
    """An increasing list of positive numbers in Elias-Fano form: count, bits of the lower parts, sampled places, lower parts, upper parts in unary."""
    n = len(values)
    if not n:
        return struct.pack("<QB", 0, 0)
    width = max(0, int(values[-1] // n).bit_length() - 1)
    low = np.packbits(((values[:, None] >> np.arange(width)) & 1).astype(np.uint8).ravel(), bitorder="little")
    places = (values >> width) + np.arange(n)
    high = np.zeros(int(places[-1]) + 1, np.uint8)
    high[places] = 1
    return struct.pack("<QB", n, width) + places[::SAMPLE].astype("<u8").tobytes() + low.tobytes() + np.packbits(high, bitorder="little").tobytes()


def select(blob: bytes, k: int) -> int:
    """The k-th number of a list (from 1); 0 for k = 0. From the sampled place before it the upper part is scanned, a block at a time."""
    if not k:
        return 0
    n, width = struct.unpack_from("<QB", blob)
    samples, k = 9, k - 1
    low = samples + 8 * (-(-n // SAMPLE))
    high = low + (n * width + 7) // 8
    place = struct.unpack_from("<Q", blob, samples + 8 * (k // SAMPLE))[0]
    rest = k % SAMPLE
    first, block = place // 8, 4 * SAMPLE // 8
    bits = np.unpackbits(np.frombuffer(blob, np.uint8, min(block, len(blob) - high - first), high + first), bitorder="little")
    bits[: place % 8] = 0
    while (there := int(bits.sum())) <= rest:
        rest, first = rest - there, first + block
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, min(block, len(blob) - high - first), high + first), bitorder="little")
    place = first * 8 + int(np.flatnonzero(bits)[rest])
    part = 0
    if width:
        at = k * width
        part = int.from_bytes(blob[low + at // 8 : low + (at + width + 7) // 8], "little") >> (at % 8) & ((1 << width) - 1)
    return ((place - k) << width) | part


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), key, size, parts of each row; a text's parts follow from the number of its documents, counted over all of them."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"key": F.unhex(F.sha2("text", 256)), "size": F.octet_length("text").cast("long")})
    many = rows.groupBy("key", "size").count().where(F.col("count") > MOST)
    many = keep(many.select("key", "size", F.ceil(F.col("count") / MOST).alias("parts")))
    return rows.join(small(many), ["key", "size"], "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))


def index(docs: DataFrame) -> DataFrame:
    """key, size, part, n, list of each distinct text of ``docs`` (key, size, parts, text), dealt by the first three; n is the number of its tokens."""

    def run(batches):
        listed: set[tuple[bytes, int]] = set()
        for batch in batches:
            here: dict[tuple[bytes, int], tuple[int, str]] = {}
            for key, size, parts, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if here.setdefault((key, size), (parts, text))[1] != text:
                    raise ValueError("two texts of one SHA-256 and length")
            new = [k for k in here if k not in listed]
            lists = [encode(ends(here[k][1])) for k in new]
            listed.update(new)
            if len(listed) > REMEMBERED:
                listed.clear()
            longs = lambda values: pa.array(values, pa.int64())
            columns = [pa.array([k[0] for k in new], pa.binary()), longs([k[1] for k in new]), longs([here[k][0] for k in new]), longs([struct.unpack_from("<Q", x)[0] for x in lists]), pa.array(lists, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "size", "parts", "n", "list"])

    lists = docs.select("key", "size", "parts", "text").mapInArrow(run, "key binary, size long, parts long, n long, list binary")
    dealt = lists.select("key", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "n", "list")
    return dealt.repartition("key", "size", "part").distinct()


@F.arrow_udf(StructType().add("prefix", LongType()).add("middle", LongType()))
def cuts(lists: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    """Code points before and up to the end of the middle."""
    at = [[select(blob, k) for blob, k in zip(lists.to_pylist(), ks.to_pylist(), strict=True)] for ks in (first, second)]
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in at], ["prefix", "middle"])


def _draw(i: int) -> Column:
    return F.conv(F.substring("seeded", 8 * i + 1, 8), 16, 10).cast("long")


def transformed(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of each row of ``docs`` (doc_id, text): plain, psm or spm by draws from SHA-256 of "1:doc_id".

    A null or empty text gives an empty plain output with n = 0; a text that contains a mark stays plain. A null doc_id draws from "1:"; equal
    rows give equal rows. Other columns are ignored. An empty table gives an empty result.
    """
    rows = keyed(docs)
    dealt = rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.col("parts")))
    seeded = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    out = dealt.join(index(rows), ["key", "size", "part"]).withColumn("seeded", seeded)
    ends_ = [_draw(i) % (F.col("n") + 1) for i in range(2)]
    out = out.withColumn("cut", cuts("list", F.least(*ends_), F.greatest(*ends_)))
    marked = F.col("text").contains(MARKS[0]) | F.col("text").contains(MARKS[1]) | F.col("text").contains(MARKS[2])
    plain = (F.col("text") == "") | marked | (_draw(2) % 100 >= PLAIN)
    out = out.withColumn("form", F.when(plain, "plain").when(_draw(3) % 100 < SPM, "spm").otherwise("psm"))
    text, a, b = F.col("text"), F.col("cut.prefix").cast("int"), F.col("cut.middle").cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b - a), F.substring(text, b + 1, F.char_length(text))
    p, s, m = (F.lit(x) for x in MARKS)
    output = F.when(plain, text).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle))
    chars = lambda c: F.when(F.col("form") != "plain", c)
    return out.select("doc_id", "n", "form", chars(F.col("cut.prefix")).alias("prefix_chars"), chars(F.col("cut.middle") - F.col("cut.prefix")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text of an output: its parts stand between marks, which occur nowhere else."""
    p, s, m = MARKS
    part = lambda begin, end=None: F.substring_index(F.substring_index(output, begin, -1), end, 1) if end else F.substring_index(output, begin, -1)
    return F.when(form == "plain", output).when(form == "spm", F.concat(part(p, m), part(m), part(s, p))).otherwise(F.concat(part(p, s), part(m), part(s, m)))


def digests(made: DataFrame) -> DataFrame:
    """``made`` with the hashes of its outputs and of the texts rebuilt from them in place of the outputs."""
    return made.select(*[c for c in made.columns if c != "output"], F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
