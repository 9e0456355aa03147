"""Every query with SQL against DuckDB, on the smallest tables; all others run."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def _core():
    from gatewise import queries

    return queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(_core()[0]))
def test_query(spark, name):
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    sql = _core()[1].get(name)
    if sql is None:
        assert len(got)
        return
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = db.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = ", ".join(f'"{c}"' for c in sorted(got.columns))
    db.register("got", got)
    db.register("want", want)
    for a, b in (("got", "want"), ("want", "got")):
        assert not db.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b}").fetchall()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
