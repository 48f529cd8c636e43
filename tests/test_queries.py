import pytest

from granary.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(same, name):
    same(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs_and_is_repeatable(spark, data, name):
    first, again = (QUERIES[name](spark, data) for _ in range(2))
    rows = sorted(map(repr, first.collect()))
    assert rows and rows == sorted(map(repr, again.repartition(3).collect()))


def test_partitioning_does_not_matter(spark, data):
    from granary.operators import images

    rows = spark.read.parquet(f"{data}/embeddings.parquet").limit(40)
    blur = lambda n: sorted((r[0], r[1], r[2], round(r[3], 9)) for r in images.convolved(images.pixels(rows.repartition(n), "vec_id", "embedding", 8), images.gaussian(0.8)).collect())
    assert blur(1) == blur(7)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
