"""Facts of a query's physical plan, for tests that keep plans as they should be."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def facts(df: DataFrame) -> dict[str, object]:
    """columns (read by the scans), filters (pushed to them), exchanges, python (nodes that leave the JVM), cartesian."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    columns = {c.split(":")[0] for schema in re.findall(r"ReadSchema: struct<([^>]*)", plan) for c in schema.split(",") if c}
    return {
        "columns": columns,
        "filters": re.findall(r"PushedFilters: \[([^\]]*)\]", plan),
        "exchanges": len(re.findall(r"(?<!Broadcast)Exchange (?!SinglePartition)", plan)),
        "python": re.findall(r"\b(\w*(?:Python|Pandas|Arrow)\w*)", plan),
        "cartesian": "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan,
    }
