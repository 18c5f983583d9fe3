"""Every query of the engine that has SQL, against DuckDB."""

import glob
import os

import duckdb
import pytest
from conftest import SF

from docgrid.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(rows):
    return sorted(tuple("null" if v is None else f"{v:.6g}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert found
        return
    result = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    wanted = [tuple(dict(zip(names, r))[c] for c in columns) for r in result.fetchall()]
    floats = {i for rs in (found, wanted) for r in rs for i, v in enumerate(r) if isinstance(v, float)}
    level = lambda rs: plain([tuple(float(v) if i in floats and v is not None else v for i, v in enumerate(r)) for r in rs])
    assert sorted(names) == columns
    assert level(found) == level(wanted)
