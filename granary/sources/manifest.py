"""Sample manifests: schema, splits, policy, styles, licences, catalogue checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.session import forgotten, kept

#: Tasks and dependencies of one neighbourhood that are followed within one row; bits of a long stand for the tasks.
NEAR = 63

SCHEMA = "id string, source string, task string, input string, target string, style string, license string, weight double, split string, redistributable boolean"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A JSONL manifest under the full schema; fields that rows lack are null (SRC-21)."""
    return spark.read.schema(SCHEMA).json(path)


def with_split(rows: DataFrame, key: str, train: int = 80, val: int = 10) -> DataFrame:
    """``split`` by a hash of the key: 80, 10 and 10 of 100 (SNK-06; the shares are ours)."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % 100
    return rows.withColumn("split", F.when(bucket < train, "train").when(bucket < train + val, "val").otherwise("test"))


def write(rows: DataFrame, path: str) -> None:
    """Parquet by split, so that a split's reader skips the others (SNK-06, FLT-07)."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def violations(rows: DataFrame) -> DataFrame:
    """Rows without a field that policy asks for, and which."""
    needed = ["source", "license", "split", "task", "style", "redistributable"]
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in needed]), lambda x: x.isNotNull())
    return rows.withColumn("missing", missing).where(F.size("missing") > 0)


def public(rows: DataFrame, restricted: DataFrame, on: str) -> DataFrame:
    """Rows without those of a restricted key (FLT-08)."""
    return rows.join(restricted.select(on).distinct(), on, "left_anti")


def overlap(rows: DataFrame, key: str) -> DataFrame:
    """Keys that stand in more than one split (SET-04)."""
    return rows.groupBy(key).agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def aliased(rows: DataFrame, names: DataFrame, on: str, default: str) -> DataFrame:
    """``rows`` with ``canonical`` through an alias table (alias, canonical), or the default (JOIN-05)."""
    return rows.join(names, rows[on] == names["alias"], "left").withColumn("canonical", F.coalesce("canonical", F.lit(default))).drop("alias")


def summary(rows: DataFrame, *keys: str, weight: str | None = None) -> DataFrame:
    """Counts, and sums of a weight, by rollup of the keys (AGG-05, AGG-28, SNK-09)."""
    extra = [F.sum(weight).alias("weight")] if weight else []
    return rows.rollup(*keys).agg(F.count(F.lit(1)).alias("n"), *extra)


def orphans(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Keys that only one of two sides has (JOIN-03)."""
    a = left.select(F.col(on).alias("a")).distinct()
    b = right.select(F.col(on).alias("b")).distinct()
    side = F.when(F.col("b").isNull(), "left").otherwise("right")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").where("a IS NULL OR b IS NULL").select(F.coalesce("a", "b").alias(on), side.alias("only_in"))


def integrity(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Expected (resource, files, bytes) against found (resource, length): counts, bytes, complete (AGG-04)."""
    found = files.groupBy("resource").agg(F.count(F.lit(1)).alias("found_files"), F.sum("length").alias("found_bytes"))
    both = expected.join(found, "resource", "left").fillna(0, ["found_files", "found_bytes"])
    return both.withColumn("complete", (F.col("found_files") == F.col("files")) & (F.col("found_bytes") == F.col("bytes")))


def digests(files: DataFrame, content: str = "content") -> DataFrame:
    """SHA-1 and SHA-256 of binary files, in lower case (AGG-04)."""
    return files.withColumn("sha1", F.sha1(content)).withColumn("sha256", F.sha2(content, 256))


def ready(tasks: DataFrame) -> DataFrame:
    """Tasks (id, status, deps) all of whose dependencies are done (JOIN-11)."""
    done = tasks.select(F.col("id").alias("dep"), (F.col("status") == "done").alias("done"))
    need = tasks.select("id", F.explode_outer("deps").alias("dep")).join(done, "dep", "left")
    return need.groupBy("id").agg(F.bool_and(F.col("dep").isNull() | F.coalesce("done", F.lit(False))).alias("ready"))


def gated(rows: DataFrame, key: str, good: Column, least: int) -> DataFrame:
    """Keys with at least so many good rows, and their count (FLT-09)."""
    return rows.where(good).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def _united(items: Column, bits: Callable[..., Column]) -> Column:
    """All bits of a number that each item has."""
    return F.aggregate(items, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(bits(x)))


def _settled(groups: DataFrame) -> DataFrame:
    """``groups`` (cells, of id, known, done and deps) with ``answers``: id, ready and cyclic of each known task, by the closure of the dependencies among at most ``NEAR`` tasks."""
    none = F.lit(0).cast("long")
    names = F.array_distinct(F.flatten(F.transform("cells", lambda c: F.concat(F.array(c.id), c.deps))))
    groups = groups.withColumn("names", F.when(~F.col("open"), names)).withColumn("places", F.when(~F.col("open"), F.sequence(F.lit(0), F.size("names") - 1)))
    at = lambda x: _bit(F.array_position("names", x) - 1)
    own = lambda x: _united(F.col("cells"), lambda c: F.when(c.id == x, _united(c.deps, at)).otherwise(none))
    groups = groups.select("*", F.transform("names", own).alias("next"), *[_united(F.col("cells"), lambda c, f=f: F.when(c[f], at(c.id)).otherwise(none)).alias(f) for f in ("known", "done")])
    # through one task after another
    through = F.aggregate("places", F.col("next"), lambda m, k: F.transform(m, lambda x: F.when(F.getbit(x, k) == 1, x.bitwiseOR(F.get(m, k))).otherwise(x)))
    groups = groups.withColumn("far", through)
    groups = groups.withColumn("ring", _united(F.col("places"), lambda i: F.when(F.getbit(F.get("far", i), i) == 1, _bit(i)).otherwise(none)))
    groups = groups.withColumn("after", _united(F.col("places"), lambda i: F.when(F.getbit("ring", i) == 1, F.get("far", i)).otherwise(none)))

    def answer(i: Column) -> Column:
        far = F.get("far", i)
        ready = far.bitwiseAND(F.bitwise_not("done")) == 0
        return F.struct(F.get("names", i).alias("id"), ready.alias("ready"), ((F.getbit("after", i) == 1) & (far.bitwiseAND(F.col("ring")) != 0)).alias("cyclic"))

    return groups.withColumn("answers", F.transform(F.filter("places", lambda i: F.getbit("known", i) == 1), answer))


def _neighbours(rows: DataFrame, near: Callable[[Column], Column]) -> DataFrame:
    """open, answers, cells of ``rows`` (id, known, done, deps) by neighbourhoods, written: those within ``NEAR`` that no dependency enters or leaves have answers, the others, which are open, their rows."""
    ends = F.array_distinct(F.concat(F.array(near(F.col("id"))), F.transform("deps", near)))
    rows = rows.withColumn("ends", ends).select("*", F.explode("ends").alias("group"))
    # both ends of a dependency between neighbourhoods hold them open
    own = F.col("group").eqNullSafe(near(F.col("id")))
    rows = rows.select("group", ((F.size("ends") > 1) | F.col("group").isNull() | F.col("id").isNull()).alias("crossed"), F.when(own, F.struct("id", "known", "done", "deps")).alias("cell"))
    by = Window.partitionBy("group").orderBy("cell.id")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    size = F.sum(F.when(F.col("cell").isNotNull(), 1 + F.size("cell.deps")).otherwise(1)).over(whole)
    rows = rows.select("group", "cell", (F.bool_or("crossed").over(whole) | (size > NEAR)).alias("open"), F.row_number().over(by).alias("place"))
    part = F.when(F.col("open"), F.floor(F.col("place") / NEAR)).otherwise(0)
    groups = rows.groupBy("group", "open", part.alias("part")).agg(F.collect_list("cell").alias("cells"))
    return kept(_settled(groups).select("open", "answers", F.when(F.col("open"), F.col("cells")).alias("cells")), "tasks")


def readiness(tasks: DataFrame, deps: DataFrame | str, near: Callable[[Column], Column] | None = None) -> DataFrame:
    """id, ready, cyclic of each task of ``tasks`` (id, done) under ``deps`` (id, dep; or the name of an array column of ``tasks``), followed to the end (JOIN-11).

    A task is ready if everything it depends on, directly or not, is done; a null ``done`` and an unknown task are not. It is cyclic if it lies on a cycle
    of dependencies, or on a way from one cycle to another. Tasks with an open dependency are found level by level, each level joined to the dependencies and
    to nothing it has met before; cycles by taking away, again and again, dependencies whose ends do not go on. Levels are written, and as many as the longest chain.
    Repeated tasks count as one, done if any of them is; null ids have no dependencies, and rows of ``deps`` with a null end are left out.

    ``near`` gives an id's neighbourhood. It changes no result: neighbourhoods of at most ``NEAR`` rows and dependencies, of which none leads to another neighbourhood, are
    dealt out once and settled each by itself, and all others go level by level.
    """
    if near is not None:
        kind = tasks.select(F.array("id")).schema[0].dataType
        listed = F.array_compact(F.col(deps).cast(kind)) if isinstance(deps, str) else F.lit(None).cast(kind)
        rows = tasks.select("id", F.lit(True).alias("known"), F.coalesce("done", F.lit(False)).alias("done"), F.coalesce(listed, F.array().cast(kind)).alias("deps"))
        if not isinstance(deps, str):
            rows = rows.unionByName(deps.where("id IS NOT NULL AND dep IS NOT NULL").select("id", F.lit(False).alias("known"), F.lit(False).alias("done"), F.array("dep").cast(kind).alias("deps")))
        parts = _neighbours(rows, near)
        out = parts.where("NOT open").select(F.inline("answers"))
        left = parts.where("open").select(F.inline("cells"))
        if left.isEmpty():
            return out
        return out.unionByName(readiness(left.where("known"), left.select("id", F.explode("deps").alias("dep"))))
    if isinstance(deps, str):
        deps = tasks.select("id", F.explode(deps).alias("dep"))
    tasks = tasks.groupBy("id").agg(F.coalesce(F.bool_or("done"), F.lit(False)).alias("done"))
    edges = kept(deps.select("id", "dep").where("id IS NOT NULL AND dep IS NOT NULL").distinct(), "tasks")
    done = tasks.where("done").select(F.col("id").alias("dep"))
    level = kept(edges.join(done, "dep", "left_anti").select("id").distinct(), "tasks")
    waiting = [level]
    while not level.isEmpty():
        met = waiting[0]
        for x in waiting[1:]:
            met = met.unionByName(x)
        level = kept(edges.join(level.withColumnRenamed("id", "dep"), "dep", "left_semi").select("id").distinct().join(met, "id", "left_anti"), "tasks")
        waiting.append(level)
    rest, before = edges, None
    while (n := rest.count()) != before:
        ends = rest.select(F.col("dep").alias("id")).distinct(), rest.select(F.col("id").alias("dep")).distinct()
        fewer = kept(rest.join(ends[0], "id", "left_semi").join(ends[1], "dep", "left_semi"), "tasks")
        if rest is not edges:
            forgotten(rest)
        rest, before = fewer, n
    met = waiting[0]
    for x in waiting[1:]:
        met = met.unionByName(x)
    ring = rest.select("id").distinct().withColumn("cyclic", F.lit(True))
    out = tasks.join(met.withColumn("waits", F.lit(True)), "id", "left").join(ring, "id", "left")
    return out.select("id", F.col("waits").isNull().alias("ready"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
