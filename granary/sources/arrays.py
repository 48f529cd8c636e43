"""A chunked array store on Parquet (SRC-27): rows in chunks by key, each row's array in blocks.

A chunk is a partition folder of ``chunk_rows`` consecutive keys and a block is a column of ``block`` consecutive
elements, so that a slab (some keys, some elements) reads the folders and columns it lies in and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blocks of a row at most; a store of wider arrays takes larger blocks.
MOST_BLOCKS = 4096
#: Chunks of wanted keys that are named in a partition filter; beyond, the join with the keys alone decides.
NAMED_CHUNKS = 10_000


def _chunk(key: Column, rows: int) -> Column:
    return F.floor(key / F.lit(rows)).cast("long")


def write(rows: DataFrame, key: str, values: str, path: str, chunk_rows: int = 65_536, block: int = 16) -> None:
    """Writes ``rows`` (an integer key, an array of numbers) as a store.

    Arrays may differ in length; null and empty arrays stay what they are. Rows with a null key are kept in a chunk of their own, which
    no slab reads; keys that stand twice are two rows. Extra columns are not stored. One shuffle by ranges of the key.
    """
    data = rows.select(F.col(key).cast("long").alias("key"), F.col(values).alias("a"))
    width = data.agg(F.max(F.size("a"))).first()[0] or 0
    blocks = max(-(-max(width, 0) // block), 1)
    if blocks > MOST_BLOCKS:
        raise ValueError(f"arrays of {width} elements have more than {MOST_BLOCKS} blocks of {block}")
    parts = [F.slice("a", i * block + 1, block).alias(f"b{i}") for i in range(blocks)]
    # ranges keep a chunk in few files, and a chunk with many rows of one key in more than one task
    dealt = data.select(_chunk(F.col("key"), chunk_rows).alias("chunk"), "key", *parts).repartitionByRange("chunk", "key", F.xxhash64("b0")).sortWithinPartitions("chunk", "key")
    dealt.write.partitionBy("chunk").parquet(f"{path}/chunks")
    shape = rows.sparkSession.range(1).select(F.lit(chunk_rows).alias("chunk_rows"), F.lit(block).alias("block"), F.lit(blocks).alias("blocks"), F.lit(width).alias("width"), F.lit(data.schema["a"].dataType.simpleString()).alias("kind"))
    shape.coalesce(1).write.parquet(f"{path}/shape")


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    shape = spark.read.parquet(f"{path}/shape").first().asDict()
    blocks = ", ".join(f"b{i} {shape['kind']}" for i in range(shape["blocks"]))
    return spark.read.schema(f"chunk long, key long, {blocks}").parquet(f"{path}/chunks"), shape


def _elements(chunks: DataFrame, shape: dict, first: int, beyond: int | None) -> DataFrame:
    beyond = shape["width"] if beyond is None else beyond
    if not 0 <= first <= beyond:
        raise ValueError("elements are counted from 0, and end at or after their first")
    low = min(first // shape["block"], shape["blocks"] - 1)
    high = max(min(-(-beyond // shape["block"]), shape["blocks"]), low + 1)
    held = F.concat(*[F.col(f"b{i}") for i in range(low, high)])
    return chunks.select("key", F.slice(held, first - low * shape["block"] + 1, beyond - first).alias("elements"))


def slab(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, first: int = 0, beyond: int | None = None) -> DataFrame:
    """key and elements ``first`` up to ``beyond`` (from 0; None: all) of the rows with keys from ``low`` to ``high`` (None: unbounded).

    Chunks outside the keys are pruned as partitions, blocks outside the elements as columns. An array that ends earlier gives what it has.
    """
    chunks, shape = _opened(spark, path)
    if low is not None:
        chunks = chunks.where((F.col("chunk") >= low // shape["chunk_rows"]) & (F.col("key") >= low))
    if high is not None:
        chunks = chunks.where((F.col("chunk") <= high // shape["chunk_rows"]) & (F.col("key") <= high))
    return _elements(chunks, shape, first, beyond)


def taken(spark: SparkSession, path: str, keys: DataFrame, on: str, first: int = 0, beyond: int | None = None) -> DataFrame:
    """key and elements of the rows whose key is among ``keys``; null and repeated keys add nothing.

    The chunks of the keys are named in the scan's partition filter, then a semi-join on (chunk, key) picks the rows.
    """
    chunks, shape = _opened(spark, path)
    wanted = keys.select(_chunk(F.col(on).cast("long"), shape["chunk_rows"]).alias("chunk"), F.col(on).cast("long").alias("key")).where("key IS NOT NULL")
    named = [r["chunk"] for r in wanted.select("chunk").distinct().limit(NAMED_CHUNKS + 1).collect()]
    if len(named) <= NAMED_CHUNKS:
        chunks = chunks.where(F.col("chunk").isin(named))
    return _elements(chunks.join(wanted, ["chunk", "key"], "left_semi"), shape, first, beyond)
