"""Every raster query against its DuckDB statement on the smallest tables; the others for a
stable schema and rows."""

import math

import duckdb
import pytest

from tessella.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(float(a), float(b), abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()))
    result = duck.execute(catalogue.oracle_sql()[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    want = sorted(tuple(r[order.index(c)] for c in columns) for r in result.fetchall())
    assert len(got) == len(want)
    assert all(same(x, y) for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True))


ROWS_ONLY = sorted(set(catalogue.queries()) - set(catalogue.oracle_sql()) - {"stylise_nearest", "stylise_bilinear", "stylise_weighted"})


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_has_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["y", "x", "shade"] and df.count() > 0


def test_driver_contract_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
