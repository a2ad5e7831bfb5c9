"""Every query with SQL returns what DuckDB returns for it."""

import math

import duckdb
import pytest

from gridwake.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def key(row):
    return tuple((v is None, "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_duckdb(spark, duck, name):
    got = registry.QUERIES[name](spark, DIR)
    want = duck.sql(registry.ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a = sorted((tuple(r) for r in got.select(*cols).collect()), key=key)
    b = sorted(want.select(", ".join(f'"{c}"' for c in cols)).fetchall(), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for v, w in zip(x, y, strict=True):
            assert math.isclose(float(v), float(w), rel_tol=1e-9, abs_tol=2e-6) if isinstance(v, float) and w is not None else v == w


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_others_return_rows(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 60
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
