"""Every registered query of the ledger engine against its SQL, over whole small tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from ledgerweave.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in map(list, data)) if not any(None in tuple(r) for r in data) else sorted((tuple(plain(r[k]) for k in order) for r in map(list, data)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalogue.SQL:
        assert got
        return
    rel = duck.sql(catalogue.SQL[name])
    want = rows(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(got) == len(want)
    assert got == want
    kinds = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    for n, t in df.dtypes:
        if t in ("bigint", "int", "double", "string", "boolean"):
            assert kinds[n] == {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}[t], (n, t, kinds[n])


def test_no_global_sort_for_payments(spark):
    from ledgerweave.sources import views

    plan = views.payments(spark, SF)._jdf.queryExecution().executedPlan().toString()
    window = plan.index("row_number()")
    assert "SinglePartition" not in plan[window : window + 600]
