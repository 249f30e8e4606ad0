"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(found):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in found), key=repr)


@pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    assert rows(map(tuple, df.select(*cols).collect())) == rows(want.select(*[f'"{c}"' for c in cols]).fetchall())


def test_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
