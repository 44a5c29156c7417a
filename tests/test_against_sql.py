"""Every registered query next to its SQL on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from check import TABLES, compare

NAMES = sorted(queries())


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    status, rows, note = compare(spark, con, name, sf, queries()[name], oracle_sql().get(name))
    assert status in ("ok", "rows-only"), f"{status} {note}"
    assert rows >= 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
