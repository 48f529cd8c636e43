"""Helpers of the operators: written intermediate tables, bounded broadcasts, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few longs that may be broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 1_000_000


#: Open scratch scopes of this driver, the innermost last.
_scratch: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: spark.checkpoint.dir, or where that is unset (local tests) a temporary one."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        configured = tempfile.mkdtemp(prefix="granary-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(configured)
    return configured


def keep(df: DataFrame) -> DataFrame:
    """Write a table that is read more than once and read it back: its lineage ends in the shared folder. A scope of ``scratch`` deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/granary-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_path = path
    if _scratch:
        _scratch[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that ``keep`` writes within are deleted at the end, but those that ``outlive`` takes out."""
    _scratch.append([])
    try:
        yield
    finally:
        forget(*_scratch.pop())


def outlive(table: DataFrame) -> DataFrame:
    """``table``, which ``keep`` wrote, taken out of the scopes that would delete it."""
    for scope in _scratch:
        scope[:] = [one for one in scope if one is not table]
    return table


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until ``df`` has no column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def located(df: DataFrame, file: str = "__file", row: str = "__row") -> DataFrame | None:
    """``df`` with the place of each row in the files it is read from, or None if it is not a plain file table."""
    try:
        return df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    except AnalysisException:
        return None


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``keep`` wrote and nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.kept_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() of a small iterative table."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is. ``df`` is a kept table, which is counted by its footers."""
    return F.broadcast(df) if df.count() <= rows else df


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches):
        for batch in batches:
            yield from f(batch)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node that can be reached.

    Minimum labels over links, then over the label's own label, until nothing changes; a step is a
    few shuffled joins and the labels are checkpointed. Null ends are dropped.
    """
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = keep(edges.union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("component").alias("before"), F.least("component", "near").alias("component")
        )
        of = labels.select(F.col("node").alias("at"), F.col("component").alias("beyond"))
        step = cut(step.join(of, F.col("component") == F.col("at")).select("node", "before", F.least("component", "beyond").alias("component")))
        labels = step.select("node", "component")
        if step.where("before <> component").isEmpty():
            return labels
