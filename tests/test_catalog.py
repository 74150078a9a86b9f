"""Every query with SQL gives the rows of its SQL in DuckDB."""

from pathlib import Path

import pytest

from tessera import catalog, catalog_records  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not Path(SF).exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    result = duck.sql(catalog.ORACLE_SQL[name])
    places = [result.columns.index(c) for c in columns]
    assert ours == sorted((tuple(r[i] for i in places) for r in result.fetchall()), key=str)


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
