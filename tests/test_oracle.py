"""Every registered query with an oracle equals its DuckDB SQL at sf0.01 (rows, columns, values)."""

import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF01

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from oracle_check import digest  # noqa: E402

from lodestar.sources.tables import TABLES  # noqa: E402

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF01)
    srows = [tuple(r) for r in df.collect()]
    res = con.sql(ORACLE[name])
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(res.columns)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(res.columns, drows)[0]
