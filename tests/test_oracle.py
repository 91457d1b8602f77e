"""Every registered query of the library against its SQL, on the smallest tables; llm queries are in tests/llm."""

import os
from pathlib import Path

import duckdb
import pytest

from tesserine.plans import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def db(small_dir):
    con = duckdb.connect()
    for p in Path(small_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def rows(values):
    return sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in values], key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_query(name, spark, small_dir, db):
    got = QUERIES[name](spark, small_dir)
    columns = sorted(got.columns)
    mine = rows(got.select(columns).collect())
    if name not in ORACLE_SQL:
        assert mine or name == "benchmark_cited"
        return
    theirs = db.sql(f"SELECT * FROM ({ORACLE_SQL[name]})")
    assert sorted(theirs.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert mine == rows(db.sql(f"SELECT {quoted} FROM ({ORACLE_SQL[name]})").fetchall())


def test_entry(spark, small_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
