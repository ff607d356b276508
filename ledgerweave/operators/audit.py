"""Invariants of recovered state.  Each violation is a row; `fail_closed` turns any into an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerweave.functions.validation import first_error, valid_account_id, valid_currency, valid_hold_id
from ledgerweave.plans.schema import HOLD_STATUS


def account_violations(accounts: DataFrame, holds: DataFrame, last_lsn: int | None = None) -> DataFrame:
    """id, violation: identity, currency, lsn range, 0 <= reserved <= balance, and reserved equal to the open holds' sum."""
    open_ = holds.where("status = 'reserved'").groupBy(F.col("from_account").alias("id")).agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("held"))
    both = accounts.join(open_, "id", "left")
    top = F.lit(2**63 - 1 if last_lsn is None else last_lsn)
    held = F.coalesce("held", F.lit(0).cast("decimal(38,0)"))
    bad = first_error(
        (~valid_account_id(F.col("id")), "account id"), (~valid_currency(F.col("currency")), "currency"), (~F.col("lsn").between(1, top), "account lsn"),
        ((F.col("reserved") < 0) | (F.col("reserved") > F.col("balance")), "reserved out of range"), (F.col("reserved") != held, "reserved differs from open holds"),
    )
    return both.select("id", bad.alias("violation")).where("violation is not null")


def hold_violations(holds: DataFrame, accounts: DataFrame, last_lsn: int | None = None) -> DataFrame:
    """hold_id, violation: identity, parties, lsn range, and what each status allows."""
    cur = accounts.select("id", "currency")
    both = holds.join(cur.toDF("from_account", "fc"), "from_account", "left").join(cur.toDF("to_account", "tc"), "to_account", "left")
    top = F.lit(2**63 - 1 if last_lsn is None else last_lsn)
    settled = F.col("settled_amount")
    bad = first_error(
        (~valid_hold_id(F.col("hold_id")), "hold id"), (F.col("from_account") == F.col("to_account"), "same account"), (F.col("amount") <= 0, "amount"),
        (~F.col("lsn").between(1, top), "hold lsn"), (F.col("fc").isNull() | F.col("tc").isNull(), "account missing"), (F.col("fc") != F.col("tc"), "currencies differ"),
        (~F.coalesce(F.col("status").isin(*HOLD_STATUS), F.lit(False)), "status"), ((F.col("status") != "settled") & (settled != 0), "unsettled but moved"),
        ((F.col("status") == "settled") & ~settled.between(0, F.col("amount")), "settled out of range"),
    )
    return both.select("hold_id", bad.alias("violation")).where("violation is not null")


def reconciliation(accounts: DataFrame, holds: DataFrame) -> DataFrame:
    """id, reserved, held for accounts on which the two differ, whichever side is missing."""
    open_ = holds.where("status = 'reserved'").groupBy(F.col("from_account").alias("id")).agg(F.sum("amount").alias("held"))
    both = accounts.select("id", "reserved").join(open_, "id", "full")
    zero = F.lit(0).cast("long")
    return both.select("id", F.coalesce("reserved", zero).alias("reserved"), F.coalesce("held", zero).alias("held")).where("reserved != held")


def fail_closed(df: DataFrame, violations: DataFrame) -> DataFrame:
    """df, or an error when it is read if there is any violation."""
    any_ = violations.limit(1).agg(F.count("*").alias("_n"))
    return df.crossJoin(F.broadcast(any_)).where(F.when(F.col("_n") > 0, F.raise_error(F.lit("CORRUPT")).cast("boolean")).otherwise(F.lit(True))).drop("_n")  # one row
