"""Each catalogue query gives the rows of its SQL on sf0.001."""

from pathlib import Path

import duckdb
import pytest

from corpusmill import plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, DATA)
    own = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)
    cursor = duck.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    other = sorted((tuple(x for _, x in sorted(zip(columns, row))) for row in cursor.fetchall()), key=str)
    assert sorted(columns) == sorted(df.columns)
    assert own == other
