"""Session builder and table readers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; on a cluster pass its master and own settings."""
    builder = SparkSession.builder.master(master).appName("granary")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; where that is unset (local tests), below a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        top = tempfile.mkdtemp(prefix="granary-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def kept(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its lineage ends there. ``forgotten`` deletes it."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def forgotten(*tables: DataFrame) -> None:
    """Deletes tables that ``kept`` wrote and nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
