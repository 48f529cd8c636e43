"""Resumable progress over a growing folder of files: totals, and counts by day under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import shared_path, table


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A file stream of one table of a data folder; a file is read once, also across restarts (STR-01, STR-04)."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet*")


def _drained(stream: DataFrame, out: str, mode: str, reduced=lambda batch: batch) -> DataFrame:
    """What the stream has now, reduced by batches and appended to ``out`` as Parquet."""
    spark = stream.sparkSession

    def append(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure overwrites its own folder
        reduced(batch).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").foreachBatch(append).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(reduced(spark.createDataFrame([], stream.schema)).schema).parquet(f"{out}/rows")


def totals(spark: SparkSession, folder: str, name: str, out: str | None = None) -> DataFrame:
    """event_type, n, total of all events so far. Every batch writes its partial sums; with the same ``out`` a rerun reads new files only (STR-02, STR-04)."""
    out = out or shared_path(spark, "totals")
    summed = lambda batch: batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    parts = _drained(stream(spark, folder, name).select("event_type", "value"), out, "append", summed)
    return parts.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def daily(spark: SparkSession, folder: str, name: str, out: str | None = None, late: str = "2 days") -> DataFrame:
    """day, event_type, n by tumbling windows of one day; events later than the watermark are left out (STR-03).

    Open windows are reported as they stand; the last report of a window counts.
    """
    out = out or shared_path(spark, "daily")
    timed = stream(spark, folder, name).select(F.col("ts").cast("timestamp").alias("ts"), "event_type").withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    rows = _drained(counts.select(F.col("w.start").alias("day"), "event_type", "n"), out, "update")
    return rows.groupBy("day", "event_type").agg(F.max("n").alias("n")).withColumn("day", F.col("day").cast("timestamp_ntz"))


def stale(rows: DataFrame, last: str, now, hours: int = 2) -> DataFrame:
    """Rows whose last sign of life is older than so many hours (STR-05)."""
    return rows.where(F.col(last) < now - F.expr(f"INTERVAL {int(hours)} HOURS"))
