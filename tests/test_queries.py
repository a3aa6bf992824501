"""Every registered query against its SQL at the smallest scale."""

import duckdb
import pytest

from alnspark.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("events", "lineitem", "part", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tables, name):
    out = QUERIES[name](spark, SF)
    got = out.collect()
    if name not in ORACLE_SQL:
        assert got
        return
    want = tables.sql(ORACLE_SQL[name])
    assert {c: TYPES[t] for c, t in out.dtypes} == dict(zip(want.columns, map(str, want.types)))
    assert rows(out.columns, got) == rows(want.columns, want.fetchall())
