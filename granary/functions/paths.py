"""Path and URL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def drop_first(path: Column) -> Column:
    """The path without its first component (PRJ-02)."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def base_name(path: Column) -> Column:
    """The last component (PRJ-03)."""
    return F.element_at(F.split(path, "/"), -1)


def quote_path(path: Column) -> Column:
    """Percent-encoding that keeps slashes; a space becomes %20 (PRJ-01)."""
    return F.array_join(F.transform(F.split(path, "/"), lambda p: F.replace(F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))), "/")


def query(**parts: Column) -> Column:
    """A query string of encoded values (PRJ-01)."""
    return F.concat_ws("&", *[F.concat(F.lit(f"{k}="), F.url_encode(v)) for k, v in parts.items()])
