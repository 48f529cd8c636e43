import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
# the Python workers import the package too
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
sys.path.insert(0, ROOT)

DATA = os.environ.get("GRANARY_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from granary.session import session

    out = session("local[4]", 4, **{"spark.driver.memory": "3g"})
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()


@pytest.fixture(scope="session")
def data() -> str:
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    from granary.session import TABLES

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows, columns):
    """Rows as sorted tuples by column name, numbers rounded."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if hasattr(x, "isoformat"):
            return x.isoformat()
        if isinstance(x, float):
            return None if x != x else round(x, 5) + 0.0
        return x

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same(spark, duck, data):
    """Whether a query and its SQL give the same columns and rows."""

    def check(query, sql):
        df = query(spark, data)
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(df.columns) == sorted(names)
        assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), names)

    return check
