"""The vector index: recall, exactness, tiles of hot lists, odd rows, matches that hold both ways."""

import numpy as np
import pytest

from granary import queries
from granary.operators import matching, pairing


def near(q, rows, k, same=True):
    order = sorted((float(((np.array(v) - q[1]) ** 2).sum()), i) for i, v in rows if not (same and i == q[0]))
    out = []
    for d, i in order:
        if i not in [o for o, _ in out]:
            out.append((i, round(d, 6)))
    return out[:k]


def test_recall_on_the_tables(spark, data):
    for folder in (data, "/root/testdata/sf0.1"):
        rows = spark.read.parquet(f"{folder}/embeddings.parquet")
        asked = rows.where("vec_id % 100 = 0")
        want = {(r["id"], r["other"]) for r in pairing.search(asked, rows, "vec_id", "embedding", 5).collect()}
        found = queries.index_search(spark, folder)
        got = {(r["id"], r["other"]) for r in found.collect()}
        assert len(got & want) >= 0.95 * len(want)


@pytest.mark.parametrize("exact", [True, False])
def test_clusters_and_a_hot_list(spark, monkeypatch, exact):
    """A third of the rows in one place; tiles of 64 rows and 4 queries, in every partitioning."""
    monkeypatch.setattr(matching, "TILE_ROWS", 64)
    monkeypatch.setattr(matching, "TILE_QUERIES", 4)
    random = np.random.default_rng(5)
    at = random.normal(size=(12, 8)) * 6
    rows = [(i, [float(x) for x in (at[0] if i % 3 == 0 else at[i % 12] + random.normal(size=8))]) for i in range(900)]
    rows += rows[:40]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, v array<double>, list string").repartition(7)
    asked = df.where("id % 30 < 2")
    index = matching.indexed(df, "id", "v", lists=12)
    assert index.sizes.sum() == len(rows)
    found = matching.searched(asked, index, "id", "v", 4, probes=2, exact=exact).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r["id"], []).append((r["other"], round(r["distance"], 6)))
    want = {i: near((i, np.array(v)), rows, 4) for i, v in rows if i % 30 < 2}
    if exact:
        assert got == want
    else:
        assert np.mean([len({o for o, _ in got[i]} & {o for o, _ in want[i]}) / 4 for i in want]) >= 0.9


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, id string, part int, turn int"
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [5.0, 5.0]), (3, None), (4, []), (5, [1.0]), (6, [None, 1.0]), (7, [float("nan"), 0.0]), (None, [0.0, 0.0]), (1, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema)
    index = matching.indexed(df, "vec_id", "embedding")
    got = matching.searched(df, index, "vec_id", "embedding", 3, exact=True).collect()
    assert sorted((r["id"], r["other"], r["distance"]) for r in got if r["id"] == 1) == [(1, 2, 1.0)]
    assert {r["id"] for r in got} == {1, 2}
    none = df.where("false")
    assert matching.searched(df, matching.indexed(none, "vec_id", "embedding"), "vec_id", "embedding", 3, exact=True).count() == 0
    assert matching.searched(none, index, "vec_id", "embedding", 3).count() == 0
    assert matching.matched(df, none, "vec_id", "embedding").count() == 0


def test_matches_hold_both_ways(spark):
    left = spark.createDataFrame([(1, [0.0]), (2, [10.0]), (3, [10.4])], "k long, v array<double>")
    right = spark.createDataFrame([(1, [10.1]), (7, [0.3]), (8, [30.0])], "k long, v array<double>")
    got = {(r["id"], r["other"]): (round(r["distance"], 6), round(r["second"], 6)) for r in matching.matched(left, right, "k", "v", exact=True).collect()}
    assert got == {(1, 7): (0.3, 10.1), (2, 1): (0.1, 9.7)}


def test_mutual_matches(same):
    same(queries.mutual_matches, queries.MATCHES)


def test_search_holds_tiles_only():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    v, q = rng.standard_normal((6000, 8)), rng.standard_normal((600, 8))
    v[100:2100] = v[100]  # copies: ties go by id
    v[5, 2], v[6, 3] = np.nan, np.inf
    q[0], q[1] = v[100], 1e200
    ids, names = np.arange(6000), np.arange(600) * 10
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[a : a + 3000]), pa.array(list(v[a : a + 3000]))], ["id", "v"]) for a in (0, 3000)]
    tracemalloc.start()
    (out,) = pairing._nearest(iter(batches), names, q, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 600 * 3000 * 8 * 2, peak  # all distances of a batch, their order and its copies took five times as much
    found = {}
    for a, b, d in zip(*(c.to_pylist() for c in out.columns), strict=True):
        found.setdefault(a, []).append((d, b))
    for name, one in zip(names.tolist(), q, strict=True):
        distance = ((v - one) ** 2).sum(axis=1)
        good = np.flatnonzero(np.isfinite(distance) & (ids != name))
        assert found.get(name, []) == sorted(zip(distance[good].tolist(), ids[good].tolist(), strict=True))[:5]
