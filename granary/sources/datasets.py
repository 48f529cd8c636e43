"""Dataset entries: job lists by name, manifest and metadata readers, sinks, and the command line over them."""

from __future__ import annotations

import argparse
import json
import posixpath
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.session import shared_path
from granary.sources import fetch, links

JOBS = "dataset string, part string, url string, dest string, pos int"
CAPTURE = "id string, iso int, aperture double, shutter_speed string, focal_length double, film_stock string, lighting_condition string, white_balance_k int"
CURVE = "stock string, channel string, log_exposure double, density double"
RESOURCE = "name string, status string, target_path string, expected_files long, expected_bytes long, license_note string"


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The job relation of all datasets, from JSON lines (SRC-07 to SRC-10, SRC-12 to SRC-19, SET-01)."""
    return spark.read.schema(JOBS).json(path)


def chosen(jobs: DataFrame, dataset: str, part: str = "all", limit: int = 0) -> DataFrame:
    """A dataset's jobs, of one part or all, in listing order; a limit of 0 means all (SRC-16, JOIN-02, LIM-01)."""
    return links.first(links.selected(jobs.where(F.col("dataset") == dataset), F.col("part"), part), limit, "pos", "url")


def run(jobs: DataFrame, present: DataFrame | None = None, workers: int = 8, resume: bool = False) -> DataFrame:
    """Outcomes of the jobs that have no present, non-empty result; ``present`` has dest and length (SRC-12 to SRC-19)."""
    return fetch.fetched(jobs if present is None else links.pending(jobs, present, "dest"), workers, resume)


def progress(outcomes: DataFrame) -> DataFrame:
    """n, changed, failed over all outcomes (AGG-01, AGG-03, SNK-05)."""
    return outcomes.agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("changed"), F.count_if(~F.col("status").isin("ok", "exists")).alias("failed"))


def bytes_by(files: DataFrame, *keys: str) -> DataFrame:
    """Files and bytes by key (AGG-03)."""
    return files.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def configs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, key (dotted), value (JSON) of YAML or JSON settings, those of the file that ``base`` names filled in (SRC-29, JOIN-10).

    The settings are a stated set of small files. A base is a path relative to its file; a file's own values win.
    """
    import yaml

    read = {row["path"]: yaml.safe_load(row["value"]) or {} for row in spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").collect()}

    def flat(tree, prefix: str = "") -> dict:
        if not isinstance(tree, dict):
            return {prefix: json.dumps(tree, sort_keys=True, default=str)}
        return {k: v for name, part in tree.items() for k, v in flat(part, f"{prefix}.{name}" if prefix else str(name)).items()}

    def whole(path: str, seen: tuple[str, ...] = ()) -> dict:
        if path in seen or path not in read:
            raise ValueError(f"{path} is missing or its own base")
        base = read[path].get("base")
        scheme, _, rest = path.rpartition(":")
        return (whole(f"{scheme}:{posixpath.normpath(posixpath.join(posixpath.dirname(rest), base))}", (*seen, path)) if base else {}) | flat(read[path])

    rows = [(path, key, value) for path in sorted(read) for key, value in whole(path).items()]
    return spark.createDataFrame(rows, "path string, key string, value string")


def write_trials(trials: DataFrame, path: str) -> None:
    """Answers of a study as Parquet by participant (SNK-10)."""
    trials.write.mode("append").partitionBy("participant").parquet(path)


def stored(spark: SparkSession, path: str, keys: DataFrame, on: str) -> DataFrame:
    """The rows of an array store (Parquet with array columns) for the wanted keys (SRC-27)."""
    return spark.read.parquet(path).join(keys.select(on).distinct(), on, "left_semi")


def capture_meta(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    """Capture metadata under a stated schema, from CSV with a header or JSON (SRC-26)."""
    return spark.read.schema(CAPTURE).csv(path, header=True) if form == "csv" else spark.read.schema(CAPTURE).json(path, multiLine=True)


def curves(spark: SparkSession, path: str) -> DataFrame:
    """Digitised curve points (SRC-28)."""
    return spark.read.schema(CURVE).csv(path, header=True)


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A row for each resource of a JSON object of resources by name (SRC-30)."""
    fields = RESOURCE.removeprefix("name string, ")
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.explode(F.from_json("value", f"map<string, struct<{', '.join(f.replace(' ', ': ', 1) for f in fields.split(', '))}>>")).alias("name", "r"))
    return parsed.select("name", "r.*")


def samples(manifest: DataFrame, split: str | None = None, task: str | None = None, source: str | None = None) -> DataFrame:
    """Manifest rows of a split, task and source (SRC-22, SRC-23, FLT-06, FLT-07)."""
    wanted = {"split": split, "task": task, "source": source}
    return reduce(lambda df, kv: df if kv[1] is None else df.where(F.col(kv[0]) == kv[1]), wanted.items(), manifest)


def indexed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with idx from 0 in order, for access by index (SRC-23).

    Rows are range-partitioned and numbered by partition offsets, so no task holds all of them.
    """
    spark = rows.sparkSession
    path = shared_path(spark, "indexed")
    rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)  # ranges depend on a sample: they are written once
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__start"))  # a row for each partition
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.withColumn("__within", within).join(starts, "__part").withColumn("idx", F.col("__start") + F.col("__within")).drop("__part", "__start", "__within")


def present(rows: DataFrame, files: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with ``<column>_ok``: whether the file that a column names exists and is not empty (JOIN-04, FLT-12)."""
    have = files.where("length > 0").select("path").distinct()
    for c in columns:
        found = have.select(F.col("path").alias(f"__{c}"), F.lit(True).alias(f"{c}_ok"))
        rows = rows.join(found, F.col(c) == F.col(f"__{c}"), "left").drop(f"__{c}").withColumn(f"{c}_ok", F.coalesce(f"{c}_ok", F.lit(False)))
    return rows


def grid(scenes: DataFrame, stocks: list[str], n: int) -> DataFrame:
    """Every scene with every stated stock and sample number below n (JOIN-08)."""
    numbers = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample")
    return scenes.withColumn("stock", F.explode(F.array(*[F.lit(s) for s in stocks]))).select("*", numbers)


def missing(documented: DataFrame, scripted: DataFrame) -> DataFrame:
    """Documented files that no job makes (SET-03)."""
    return documented.select("file").exceptAll(scripted.select("file"))


def selected_modules(modules: DataFrame, name: str, kind: Column, targets: list[str]) -> DataFrame:
    """Modules of a kind whose lower-cased name holds one of the targets (FLT-11, UDF-05)."""
    return modules.where(kind & F.exists(F.array(*[F.lit(t) for t in targets]), lambda t: F.contains(F.lower(F.col(name)), t)))


def write_list(rows: DataFrame, column: str, path: str) -> None:
    """One value a line, in order, with a trailing newline (SNK-03)."""
    rows.select(F.col(column).cast("string").alias("value")).orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def write_array(rows: DataFrame, column: str, path: str) -> None:
    """A JSON array of the values in order, for listings that a person reads; streamed row by row (SNK-02)."""
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for i, row in enumerate(rows.select(column).orderBy(column).toLocalIterator()):
            out.write(("," if i else "") + "\n  " + json.dumps(row[0], ensure_ascii=False))
        out.write("\n]\n")


def main(argv: list[str] | None = None) -> None:
    """``python -m granary.sources.datasets JOBS.jsonl DATASET``: fetch a dataset and print its progress (SRC-20)."""
    from granary.session import session

    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("jobs")
    parser.add_argument("dataset")
    parser.add_argument("--part", default="all")
    parser.add_argument("--workers", type=int, default=8)
    parser.add_argument("--limit", type=int, default=0)
    parser.add_argument("--resume", action="store_true", help="keep the bytes of failed transfers and go on after them")
    args = parser.parse_args(argv)
    spark = session()
    done = run(chosen(read_jobs(spark, args.jobs), args.dataset, args.part, args.limit), workers=args.workers, resume=args.resume)
    print(json.dumps(progress(done).collect()[0].asDict()))


if __name__ == "__main__":
    main()
