import gzip
import io
import os
import tarfile
import tracemalloc
import zipfile

import pytest
from pyspark.errors import PythonException

from granary.plans.checks import facts
from granary.sources import archives, arrays

NAMES = {"a/one.txt": b"abc", "empty": b"", "b ü.bin": bytes(range(256)) * 300, "a/same": b"x" * 50_000}


def packed(folder):
    """One archive of every kind with the same members."""
    for method, name in ((zipfile.ZIP_STORED, "stored.zip"), (zipfile.ZIP_DEFLATED, "de flated.zip")):
        with zipfile.ZipFile(folder / name, "w", method) as z:
            z.mkdir("folder")
            for n, data in NAMES.items():
                z.writestr(n, data)
    for mode, name in (("w", "plain.tar"), ("w:gz", "packed.tar.gz")):
        with tarfile.open(folder / name, mode) as t:
            t.addfile(tarfile.TarInfo("zero"), io.BytesIO())
            for n, data in NAMES.items():
                info = tarfile.TarInfo(n)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    (folder / "two.bin.gz").write_bytes(gzip.compress(NAMES["a/one.txt"]) + gzip.compress(NAMES["b ü.bin"]))
    (folder / "nothing.tar").write_bytes(b"")


def joined(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["member"], r["part"])):
        key = (r["path"].rsplit("/", 1)[-1], r["member"])
        assert r["first_byte"] == len(out.get(key, b""))
        out[key] = out.get(key, b"") + bytes(r["content"])
    return out


def test_members_of_every_kind(spark, tmp_path):
    packed(tmp_path)
    files = archives.archives(spark, str(tmp_path))
    assert files.count() == 5  # without the empty one
    directory = archives.members(files, rows=2)
    got = joined(archives.contents(directory, tasks=5, part_bytes=4096).collect())
    want = {(name, n): data for name in ("stored.zip", "de%20flated.zip") for n, data in NAMES.items()}
    want |= {(name, n): data for name in ("plain.tar", "packed.tar.gz") for n, data in (NAMES | {"zero": b""}).items()}
    want[("two.bin.gz", "two.bin")] = NAMES["a/one.txt"] + NAMES["b ü.bin"]
    assert {(k[0].replace("%20", " "), k[1]): v for k, v in got.items()} == {(k[0].replace("%20", " "), k[1]): v for k, v in want.items()}
    one = archives.contents(directory.where("member = 'b ü.bin' AND kind = 'deflated'"), part_bytes=10_000).collect()
    assert len(one) == 8 and len(joined(one)) == 1
    assert archives.members(spark.createDataFrame([(None,)], "path string")).count() == 0


def test_members_are_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "many.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(200):
            z.writestr(f"{i}.txt", str(i))
    parts = archives.contents(archives.members(archives.archives(spark, str(tmp_path / "many.zip"))), tasks=16)
    assert parts.selectExpr("spark_partition_id() AS p").distinct().count() > 12 and parts.count() == 200


def test_memory_is_bounded(tmp_path):
    path = str(tmp_path / "large.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("large", "w", force_zip64=True) as out:
        for _ in range(60):
            out.write(os.urandom(1 << 16) * 16)
    (row,) = archives._listed(path)
    assert row[5] == 60 << 20
    tracemalloc.start()
    total = sum(len(part) for _, _, part in archives._unpacked(path, "large", row[2], row[3], row[4], row[6], 1 << 20))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 60 << 20 and peak < 12 << 20


def test_damage_is_refused(spark, tmp_path):
    packed(tmp_path)
    data = bytearray((tmp_path / "stored.zip").read_bytes())
    data[data.index(b"xxxx")] = ord("y")
    (tmp_path / "stored.zip").write_bytes(data)
    directory = archives.members(archives.archives(spark, str(tmp_path / "stored.zip")))
    with pytest.raises(PythonException, match="checksum"):
        archives.contents(directory).collect()
    packing = (tmp_path / "two.bin.gz").read_bytes()
    (tmp_path / "two.bin.gz").write_bytes(packing[:-20])
    with pytest.raises(PythonException, match="ends within"):
        archives.contents(archives.members(archives.archives(spark, str(tmp_path / "two.bin.gz")))).collect()


@pytest.fixture(scope="module")
def store(spark, data, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("arrays") / "store")
    arrays.write(spark.read.parquet(f"{data}/embeddings.parquet"), "vec_id", "embedding", path, chunk_rows=32)
    return path


def test_slabs(spark, data, store):
    want = {r["vec_id"]: list(r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    for low, high, first, beyond in ((None, None, 0, None), (40, 99, 5, 41), (40, 40, 63, 64), (0, 10**9, 16, 16), (31, 32, 60, 200), (10**6, None, 0, 3)):
        got = {r["key"]: list(r["elements"]) for r in arrays.slab(spark, store, low, high, first, beyond).collect()}
        assert got == {k: v[first:beyond] for k, v in want.items() if (low is None or k >= low) and (high is None or k <= high)}
    keys = spark.createDataFrame([(3,), (3,), (70,), (None,), (10**7,)], "id int")
    assert {r["key"]: list(r["elements"]) for r in arrays.taken(spark, store, keys, "id", 30, 34).collect()} == {k: want[k][30:34] for k in (3, 70)}
    assert arrays.taken(spark, store, keys.where("id < 0"), "id").count() == 0


def test_unwanted_chunks_and_blocks_are_not_read(spark, store):
    some = arrays.slab(spark, store, 40, 99, 17, 30)
    assert facts(some)["columns"] == {"key", "b1"}
    assert sorted(r[0] for r in some.selectExpr("key DIV 32").distinct().collect()) == [1, 2, 3]
    plan = some._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    scan = plan.collectLeaves().apply(0)
    assert scan.metrics().apply("numPartitions").value() == 3 < spark.read.parquet(f"{store}/chunks").select("chunk").distinct().count()
    wanted = arrays.taken(spark, store, spark.createDataFrame([(3,), (70,)], "id int"), "id", 0, 16)
    assert facts(wanted)["columns"] == {"key", "b0"} and "chunk#" in wanted._jdf.queryExecution().executedPlan().toString()


def test_odd_arrays(spark, tmp_path, monkeypatch):
    rows = [(1, [1.0, None, 3.0], "x"), (2, [], "x"), (3, None, "x"), (None, [9.0], "x"), (4, [float(i) for i in range(40)], "x"), (4, [7.0], "x"), (-1, [5.0], "x")]
    path = str(tmp_path / "odd")
    arrays.write(spark.createDataFrame(rows, "key long, a array<double>, chunk string"), "key", "a", path, chunk_rows=2)
    got = sorted(((r["key"], r["elements"]) for r in arrays.slab(spark, path).collect()), key=repr)
    assert got == sorted(((k, a) for k, a, _ in rows), key=repr)
    assert sorted((r["key"], r["elements"]) for r in arrays.slab(spark, path, -5, 1).collect()) == [(-1, [5.0]), (1, [1.0, None, 3.0])]
    monkeypatch.setattr(arrays, "MOST_BLOCKS", 39)
    with pytest.raises(ValueError, match="blocks"):
        arrays.write(spark.createDataFrame(rows, "key long, a array<double>, chunk string"), "key", "a", str(tmp_path / "wide"), block=1)


def test_store_of_no_rows(spark, tmp_path):
    path = str(tmp_path / "none")
    arrays.write(spark.createDataFrame([], "key long, a array<double>"), "key", "a", path)
    assert arrays.slab(spark, path).count() == 0
