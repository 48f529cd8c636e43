import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import flows, pairing, scans


# a lambda goes to the workers by value
decay = lambda x, t, parameters: -parameters[0][:, None] * x


# integration


def test_rows_take_their_own_steps():
    rates = np.array([0.01, 1.0, 50.0, 400.0])
    x, t, steps, refused = flows.adaptive(np.ones((4, 3)), decay, [rates], (0, 1), 1e-10, 1e-8, 100_000)
    assert np.abs(x - np.exp(-rates)[:, None]).max() < 1e-8 and (t == 1).all()
    assert (np.diff(steps) > 0).all() and refused[3] > 0
    for i in range(4):  # alone as in company
        alone = flows.adaptive(np.ones((1, 3)), decay, [rates[i : i + 1]], (0, 1), 1e-10, 1e-8, 100_000)
        assert np.array_equal(alone[0][0], x[i]) and alone[2][0] == steps[i]


def test_tolerance_sets_the_error():
    errors, counts = [], []
    for tolerance in (1e-3, 1e-6, 1e-9):
        x, _, steps, _ = flows.adaptive(np.ones((1, 1)), lambda x, t, p: x * np.cos(t)[:, None], [], (0, 5), tolerance, tolerance, 10_000)
        errors.append(abs(x[0, 0] - np.exp(np.sin(5))))
        counts.append(steps[0])
    assert errors[0] > errors[1] > errors[2] and errors[2] < 1e-8 and counts[0] < counts[1] < counts[2]


def test_backwards_and_nowhere():
    x, t, _, _ = flows.adaptive(np.ones((2, 1)), decay, [np.ones(2)], (1, 0), 1e-9, 1e-9, 1000)
    assert x == pytest.approx(np.full((2, 1), np.e), abs=1e-7) and (t == 0).all()
    x, t, steps, _ = flows.adaptive(np.ones((2, 1)), decay, [np.ones(2)], (0, 0), 1e-9, 1e-9, 1000)
    assert (x == 1).all() and (steps == 0).all()


def test_what_does_not_arrive_says_so():
    blown = lambda x, t, p: x * x  # noqa: E731  infinite at t = 1
    x, t, steps, refused = flows.adaptive(np.array([[1.0], [0.1]]), blown, [], (0, 2), 1e-6, 1e-6, 5000)
    assert t[0] < 1.001 and t[1] == 2 and x[1, 0] == pytest.approx(0.1 / (1 - 0.2), abs=1e-5)
    _, t, steps, refused = flows.adaptive(np.ones((1, 1)), decay, [np.array([1e4])], (0, 1), 1e-9, 1e-9, 20)
    assert t[0] < 1 and steps[0] + refused[0] == 20


def test_integrated_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], 1.0), (2, None, 1.0), (3, [], 1.0), (4, [float("nan")], 1.0), (5, [4.0], 2.0), (5, [4.0], 2.0), (None, [1.0], 0.0)], "id long, x array<double>, reached double")
    out = {}
    for n in (1, 4):
        got = flows.integrated(rows.repartition(n), "id", "x", decay, ["reached"], atol=1e-9, rtol=1e-9).collect()
        out[n] = sorted(map(repr, got))
        by = {r["id"]: r for r in got}
        assert by[1]["x"] == pytest.approx([np.exp(-1), 2 * np.exp(-1)], abs=1e-8) and by[1]["steps"] > 3
        assert by[2]["x"] is None and by[2]["steps"] is None and by[3]["x"] == [] and by[None]["x"] == [1.0]
        assert by[4]["reached"] == 0 and by[5]["x"] == pytest.approx([4 * np.exp(-2)], abs=1e-8) and len(got) == 7
    assert out[1] == out[4]
    assert flows.integrated(rows.limit(0), "id", "x", decay, ["reached"]).collect() == []


# coupling


def clouds(spark, n, batches=1):
    draw = np.random.default_rng(7)
    rows = [(b if b else None, i, draw.random(3).tolist(), (draw.random(3) + 0.3).tolist(), "x") for b in range(batches) for i in range(n)]
    return rows, spark.createDataFrame(rows, "batch long, id long, x0 array<double>, x1 array<double>, n string")


def test_masses_and_blocks(spark):
    rows, df = clouds(spark, 20, 2)
    one = {(r["batch"], r["id"]): r for r in flows.entropic(df, "batch", "id", "x0", "x1", 0.5).collect()}
    many = {(r["batch"], r["id"]): r for r in flows.entropic(df.repartition(3), "batch", "id", "x0", "x1", 0.5, block=16).collect()}
    assert one.keys() == many.keys() and len(one) == 40
    for k, r in one.items():
        assert r["mass"] == pytest.approx(1 / 20, abs=1e-6) and many[k]["mass"] == pytest.approx(1 / 20, abs=1e-6)
        assert r["cost"] == pytest.approx(many[k]["cost"], abs=1e-6) and r["target"] == pytest.approx(many[k]["target"], abs=1e-4) and r["partner"] == many[k]["partner"]
    # the same by numpy, columns' masses included
    a, b = (np.array([r[c] for r in rows if r[0] is None]) for c in (2, 3))
    cost = ((a[:, None] - b[None]) ** 2).sum(2)
    kernel, v = np.exp(-cost / 0.5), np.ones(20)
    for _ in range(3000):
        u = 1 / 20 / (kernel @ v)
        v = 1 / 20 / (kernel.T @ u)
    plan = u[:, None] * kernel * v
    assert [one[None, i]["cost"] for i in range(20)] == pytest.approx((plan * cost).sum(1).tolist(), abs=1e-6)
    assert [one[None, i]["drawn"] for i in range(20)] == pytest.approx((plan.max(1) * 20).tolist(), abs=1e-4)
    # it costs no less than the exact pairing, and less than it does with a larger regulariser
    exact = pairing.transport(df.where("batch IS NULL").withColumn("batch", F.lit(0)), "batch", "id", "x0", "x1").agg(F.sum("cost")).first()[0] / 20
    assert exact - 1e-6 <= sum(one[None, i]["cost"] for i in range(20)) < cost.mean()


def test_batches_of_one_and_of_many_blocks(spark):
    rows, _ = clouds(spark, 40, 4)
    # a null batch of 40 rows and batches of 40, 16 and 1; floats where they are given, integers too
    rows = [(*r[:2], r[2], [round(10 * x) for x in r[3]]) for r in rows if r[1] < {None: 40, 1: 40, 2: 16, 3: 1}[r[0]]]
    df = spark.createDataFrame(rows, "batch long, id long, x0 array<float>, x1 array<int>")
    whole, mixed = ({(r["batch"], r["id"]): r for r in flows.entropic(df, "batch", "id", "x0", "x1", 20.0, block=n).collect()} for n in (256, 16))
    assert whole.keys() == mixed.keys() and len(whole) == 97
    for k, r in whole.items():
        assert r["partner"] == mixed[k]["partner"] and [r[c] for c in ("mass", "cost", "drawn", "potential")] == pytest.approx([mixed[k][c] for c in ("mass", "cost", "drawn", "potential")], rel=1e-4)
    assert whole[3, 0]["mass"] == pytest.approx(1) and whole[3, 0]["partner"] == 0


def test_rounds_of_small_batches_take_no_jobs(spark, data):
    from granary.queries import entropic_coupling

    spark.sparkContext.setJobGroup("coupling", "entropic_coupling")
    entropic_coupling(spark, data).write.format("noop").mode("overwrite").save()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("coupling"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs <= 16


def test_coupling_edges(spark):
    _, df = clouds(spark, 5)
    assert flows.entropic(df.limit(0), "batch", "id", "x0", "x1", 0.1).collect() == []
    with pytest.raises(ValueError, match="off by"):
        flows.entropic(df, "batch", "id", "x0", "x1", 0.001, most=2)


# scans


def by_loop(values):
    state, out = 0.0, []
    for a, b in values:
        state = a * state + b if a is not None and b is not None else state
        out.append(state)
    return out


@pytest.mark.parametrize("n", [1, 63, 64, 65, 4097, 20_000])
def test_prefixes(n):
    draw = np.random.default_rng(n)
    a, b = draw.random(n), draw.standard_normal(n)
    a[draw.random(n) < 0.01] = 0
    p, s = scans.prefixes(a, b)
    assert s == pytest.approx(by_loop(zip(a, b, strict=True)), abs=1e-12) and p == pytest.approx(np.cumprod(a), abs=1e-12)


@pytest.mark.parametrize("reverse", [False, True])
def test_a_sequence_spans_tasks(spark, reverse):
    draw = np.random.default_rng(8)
    # one key has most rows; null keys are one sequence
    rows = [(None if i % 17 == 0 else 5 if i % 3 else i % 11, i, float(draw.random()), None if i % 29 == 0 else float(draw.standard_normal()), "k") for i in range(6000)]
    df = spark.createDataFrame(rows, "key int, at long, c0 double, b double, block string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = scans.scanned(df.repartition(5), ["key"], ["at"], F.col("c0"), F.col("b"), keep=["block"], reverse=reverse).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 6000 and {r["block"] for r in got} == {"k"}
    by = {(r["key"], r["at"]): r["state"] for r in got}
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        own = own[::-1] if reverse else own
        assert [by[key, r[1]] for r in own] == pytest.approx(by_loop((r[2], r[3]) for r in own), abs=1e-9)


def test_scan_edges(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 2.0), ("a", None, 1.0), ("b", 1, None)], "k string, t int, state double")
    got = scans.scanned(df, ["k"], ["t"], F.lit(0.5), F.col("state")).orderBy("k", "t", "state").collect()
    assert [(r["k"], r["t"], r["state"]) for r in got] == [("a", None, 1.0), ("a", 1, 2.5), ("a", 1, 3.25), ("b", 1, 0.0)]
    assert scans.scanned(df.limit(0), ["k"], ["t"], F.lit(0.5), F.col("state")).collect() == []


def test_both_ways_and_four_ways(spark):
    draw = np.random.default_rng(9)
    cells = draw.random((2, 5, 9))
    image = spark.createDataFrame([(i, x, y, float(cells[i, y, x])) for i in range(2) for y in range(5) for x in range(9)], "image_id long, x int, y int, value double")

    def along(m, axis, back):
        m = np.flip(m, axis) if back else m
        out = np.apply_along_axis(lambda v: np.array(by_loop((0.7, 0.3 * x) for x in v)), axis, m)
        return np.flip(out, axis) if back else out

    want = sum(along(cells, axis, back) for axis in (1, 2) for back in (False, True)) / 4
    got = {(r["image_id"], r["y"], r["x"]): r["state"] for r in scans.four_ways(image, F.lit(0.7), 0.3 * F.col("value")).collect()}
    assert len(got) == 90 and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in got)
    lines = scans.both_ways(image, ["image_id", "y"], ["x"], F.lit(0.7), 0.3 * F.col("value")).collect()
    want = (along(cells, 2, False) + along(cells, 2, True)) / 2
    assert all(r["state"] == pytest.approx(want[r["image_id"], r["y"], r["x"]], abs=1e-12) for r in lines)
