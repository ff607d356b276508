"""Questions about committed operations whose order doesn't matter, or only per account."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def entries(transfers: DataFrame, order: str) -> DataFrame:
    """id, order, delta, debit: a debit and a credit per transfer, from one reading of them."""
    side = lambda account, delta, debit: F.struct(F.col(account).alias("id"), F.col(order), delta.alias("delta"), F.lit(debit).alias("debit"))
    return transfers.select(F.inline(F.array(side("from_account", -F.col("amount"), True), side("to_account", F.col("amount"), False))))


def postings(accounts: DataFrame, transfers: DataFrame) -> DataFrame:
    """id, seq, delta, moved: the opening balance (seq 0) and a debit and a credit per transfer."""
    opened = accounts.select("id", F.lit(0).cast("long").alias("seq"), F.col("opening").alias("delta"), F.lit(0).alias("moved"))
    return opened.unionAll(entries(transfers, "seq").select("id", "seq", "delta", F.lit(1)))


def same_currency(payments: DataFrame, accounts: DataFrame, how: str = "inner") -> DataFrame:
    """payments with from_currency and to_currency; inner: only those that agree."""
    cur = accounts.select("id", "currency")
    out = payments.join(cur.toDF("from_account", "from_currency"), "from_account", how).join(cur.toDF("to_account", "to_currency"), "to_account", how)
    return out.where("from_currency = to_currency") if how == "inner" else out


def balances(accounts: DataFrame, transfers: DataFrame) -> DataFrame:
    """id, balance, entries."""
    if "seq" not in transfers.columns:
        transfers = transfers.withColumn("seq", F.lit(None).cast("long"))
    return postings(accounts, transfers).groupBy("id").agg(F.sum("delta").alias("balance"), F.sum("moved").alias("entries"))


def running_balances(accounts: DataFrame, transfers: DataFrame) -> DataFrame:
    """id, seq, balance after each entry of each account."""
    w = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return postings(accounts, transfers).select("id", "seq", F.sum("delta").over(w).alias("balance"))


def balance_as_of(accounts: DataFrame, transfers: DataFrame, seq: int) -> DataFrame:
    """Balances after the operations up to seq; the filter reaches the scan."""
    return balances(accounts, transfers.where(F.col("seq") <= seq)).drop("entries")


def conservation(accounts: DataFrame, states: DataFrame) -> DataFrame:
    """Per currency, what was put in and what is there: transfers only move money."""
    opened = accounts.groupBy("currency").agg(F.sum("opening").alias("opened"))
    held = states.join(accounts.select("id", "currency"), "id").groupBy("currency").agg(F.sum("balance").alias("held"))
    return opened.join(held, "currency").withColumn("conserved", F.col("opened") == F.col("held"))


def always_affordable(accounts: DataFrame, transfers: DataFrame) -> DataFrame:
    """id, opening, debits, credits, proven: whether every debit of the account is affordable, and every credit fits, in any order."""
    side = lambda account, debit, credit: F.struct(F.col(account).alias("id"), debit.cast("decimal(38,0)").alias("debit"), credit.cast("decimal(38,0)").alias("credit"))
    sides = transfers.select(F.inline(F.array(side("from_account", F.col("amount"), F.lit(None)), side("to_account", F.lit(None), F.col("amount")))))
    sums = sides.groupBy("id").agg(F.sum("debit").alias("debits"), F.sum("credit").alias("credits"))
    zero = F.lit(0).cast("decimal(38,0)")
    both = accounts.join(sums, "id", "left").select("id", "opening", F.coalesce("debits", zero).alias("debits"), F.coalesce("credits", zero).alias("credits"))
    return both.withColumn("proven", (F.col("opening") - F.col("debits") >= 0) & (F.col("opening") + F.col("credits") <= F.lit(2**63 - 1)))
