"""List columns whose Spark type differs from the DuckDB oracle's type."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from autokpi.plans.fixtures import BASE_TABLES  # noqa: E402
from autokpi.plans.registry import ORACLES, QUERIES, load_all  # noqa: E402
from autokpi.session import get_spark  # noqa: E402

SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
                 "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "boolean": "BOOLEAN",
                 "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    load_all()
    spark = get_spark()
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    n = 0
    for name in sorted(ORACLES):
        sdf = QUERIES[name](spark, sf)
        st = dict(sdf.dtypes)
        rel = con.sql(ORACLES[name])
        dt = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        diff = {c: (st[c], dt.get(c)) for c in st if SPARK_TO_DUCK.get(st[c], st[c]) != dt.get(c)}
        if diff:
            n += 1
            print(name, diff)
    print("queries with type differences:", n)


if __name__ == "__main__":
    main()
