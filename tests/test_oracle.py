"""Every registered query equals its DuckDB oracle (row count, columns, values)."""

import math

import duckdb
import pytest

from autokpi.plans.fixtures import BASE_TABLES
from autokpi.plans.registry import ORACLES, QUERIES, load_all

from conftest import SF_SMALL

load_all()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _key(row):
    return tuple((0, "") if x is None else (1, str(x)) for x in row)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    srows = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=_key)
    res = duck.execute(ORACLES[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    drows = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=_key)
    assert srows == drows


def test_every_query_has_a_docstring_and_runs(spark):
    for name, fn in QUERIES.items():
        assert fn.__doc__ or name in ORACLES, name
    assert "l3_analyse_all" in QUERIES and QUERIES["l3_analyse_all"](spark, SF_SMALL).count() > 0


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
