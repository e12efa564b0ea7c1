"""Every registered query against its SQL twin on the smallest tables."""

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from quintavote.testbed import queries as registered  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in DATA.glob("*.parquet"):
        connection.sql(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return connection


def rows(table, columns):
    def order(row):
        return tuple((value is None, str(value)) for value in row)

    return sorted(zip(*[table[name].to_pylist() for name in columns]), key=order)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(entry.queries())
    without = registered.NO_SQL | (entry.corpus.NO_SQL if entry.corpus else set())
    assert set(entry.queries()) - set(ORACLE) == without


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, database, name):
    found = entry.queries()[name](spark, str(DATA)).toArrow()
    if name not in ORACLE:
        assert found.num_rows > 0
        return
    wanted = database.sql(ORACLE[name]).to_arrow_table()
    columns = sorted(found.column_names)
    assert columns == sorted(wanted.column_names)
    assert rows(found, columns) == rows(wanted, columns)


def test_flagship(spark):
    assert set(entry.entry(spark).columns) == {"query_id", "votes", "fraud_score", "approved"}
