"""Every registered query next to its SQL, over whole tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import check_oracle
from evalweave.plans.catalog import BUILDERS, ORACLES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in check_oracle.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(BUILDERS))
def test_query(spark, con, name):
    frame = BUILDERS[name](spark, str(DATA))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    rows = check_oracle.rows_of(frame.columns, frame.collect())
    if name not in ORACLES:
        assert rows
        return
    cursor = con.execute(ORACLES[name])
    heads = [(d[0], str(d[1])) for d in cursor.description]
    assert sorted((c, check_oracle.KINDS.get(t, t)) for c, t in frame.dtypes) == sorted(heads)
    assert rows == check_oracle.rows_of([h[0] for h in heads], cursor.fetchall())
