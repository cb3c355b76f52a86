"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from tidewell.queries import ORACLE_SQL, QUERIES
from tidewell.session import TABLES


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])

    def one(v):
        return "null" if v is None else str(v) if isinstance(v, bool | str) else f"{float(v):.9g}" if hasattr(v, "__float__") else str(v)

    return sorted([one(r[k]) for k in order] for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    result = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(rows, df.columns) == canonical(result.fetchall(), names)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(entry.queries())
