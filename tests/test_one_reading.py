"""Each table of operations is read, joined and dealt out once, however many questions are asked of it."""

import duckdb
import pytest

from ledgerweave.operators import admission, committed, recovery
from ledgerweave.plans import catalogue
from ledgerweave.sources import views

SF = "/root/testdata/sf0.001"


def readings(df, column):
    """Scans that read the column in the plan as it was run; a reused exchange shows none."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return sum("FileScan" in line and f"{column}#" in line for line in plan.splitlines())


@pytest.mark.parametrize("name", ["lsn_assignment", "checkpoints_due", "compaction_plan", "average_batch_size", "group_commit_batches", "file_names", "wal_monotonic_check", "segment_rotation", "log_round_trip", "recover_accounts", "snapshot_plus_tail", "recover_old_records", "running_balance", "payments_admission", "account_statement", "committed_balances", "conservation", "no_reject_proof"])
def test_lines_are_read_once(spark, name):
    assert readings(catalogue.QUERIES[name](spark, SF), "l_suppkey") == 1


def test_postings_read_transfers_once(spark, tmp_path):
    spark.createDataFrame([(1, "a", "b", 5), (2, "b", "a", 0)], "seq long, from_account string, to_account string, amount long").write.parquet(f"{tmp_path}/t")
    a = spark.createDataFrame([("a", 10), ("b", 0)], "id string, opening long")
    out = committed.running_balances(a, spark.read.parquet(f"{tmp_path}/t"))
    assert readings(out, "from_account") == 1
    assert {tuple(r) for r in out.collect()} == {("a", 0, 10), ("b", 0, 0), ("a", 1, 5), ("b", 1, 5), ("a", 2, 5), ("b", 2, 5)}


def test_old_records_are_read_once(spark, tmp_path):
    schema = "lsn long, kind string, request struct<from_account:string,to_account:string>, result struct<account_id:string,currency:string,balance:long,from_balance:long,to_balance:long>"
    rows = [(1, "create_account", None, ("a", "USD", 9, None, None)), (2, "create_account", None, ("b", "USD", 0, None, None)), (3, "transfer", ("a", "b"), (None, None, None, 7, 2)), (4, "cancel", None, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/r")
    out = recovery.recover_accounts(recovery.old_images(spark.read.parquet(f"{tmp_path}/r")))
    assert readings(out, "kind") == 1
    assert {tuple(r) for r in out.collect()} == {("a", "USD", 7, 0, 3), ("b", "USD", 2, 0, 3)}


def test_admission_loads_openings_without_a_join(spark):
    r = spark.createDataFrame([(2, "a", 6), (1, "a", 5), (3, "a", 5), (4, "none", 0)], "seq long, from_account string, amount long")
    a = spark.createDataFrame([("a", 10), ("idle", 3)], "id string, opening long")
    out = admission.reserve_admission(r, a)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [("a", 1, 5, True), ("a", 2, 6, False), ("a", 3, 5, True)]


def test_lines_without_a_date_come_last(spark, tmp_path):
    """As SQL sorts nulls; such lines got no number at all before."""
    duck = duckdb.connect()
    for t in ("customer", "supplier", "nation", "orders"):
        duck.sql(f"copy (select * from '{SF}/{t}.parquet') to '{tmp_path}/{t}.parquet' (format parquet)")
        duck.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    duck.sql(f"copy (select * replace (case when l_orderkey % 50 = 0 then null else l_shipdate end as l_shipdate) from '{SF}/lineitem.parquet') to '{tmp_path}/lineitem.parquet' (format parquet)")
    duck.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    got = sorted(tuple(r) for r in views.payments(spark, str(tmp_path), "key", "amount").collect())
    assert got == sorted(duck.sql(f"select seq, key, amount from ({views.PAYMENTS}) p").fetchall())
    got = sorted(tuple(r) for r in catalogue.QUERIES["lsn_assignment"](spark, str(tmp_path)).select("seq", "lsn").collect())
    assert got == sorted(duck.sql(f"select seq, lsn from ({catalogue.SQL['lsn_assignment']}) p").fetchall())
