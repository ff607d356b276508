"""Sequential questions that stay within one key: first creations, reservations per source, the life of a hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerweave.operators import sequential


def first_creations(creates: DataFrame) -> DataFrame:
    """creates(seq, account_id, ...) with error_code: all but the first of an account are refused."""
    rank = F.row_number().over(Window.partitionBy("account_id").orderBy("seq"))
    return creates.withColumn("error_code", F.when(rank > 1, "ACCOUNT_EXISTS"))


def reserve_admission(reserves: DataFrame, accounts: DataFrame) -> DataFrame:
    """from_account, seq, amount, accepted: reservations judged in order against what the source has available.

    Only for sources that nothing is paid into meanwhile; a source that isn't
    among the accounts gives no rows.
    """

    def step(left: list, amount: int):
        ok = left[0] >= amount
        left[0] -= amount if ok else 0
        return amount, ok

    rows = reserves.select("from_account", "seq", F.col("amount").alias("_amount"))
    opening = accounts.select(F.col("id").alias("from_account"), F.col("opening").alias("_amount"))
    return sequential.fold(rows, "from_account", "seq", ["_amount"], "amount bigint, accepted boolean", lambda opening: [opening], step, opening)


def lifecycle(holds: DataFrame, terminals: DataFrame) -> DataFrame:
    """seq, hold_id, kind, amount, error_code, replayed for terminal operations on holds(hold_id, amount, seq).

    The first terminal operation that is valid decides; the same again is
    replayed, another one conflicts, and a settlement above the hold is invalid
    as long as the hold is open.
    """
    t = terminals.alias("t").join(holds.select("hold_id", F.col("amount").alias("held"), F.col("seq").alias("since")), "hold_id", "left")
    known = F.col("since").isNotNull() & (F.col("seq") > F.col("since"))
    valid = known & ((F.col("kind") == "cancel") | (F.col("amount") <= F.col("held")))
    first = F.min(F.when(valid, F.struct("seq", "kind", "amount"))).over(Window.partitionBy("hold_id"))
    t = t.withColumn("d", first)
    same = (F.col("kind") == F.col("d.kind")) & ((F.col("kind") == "cancel") | (F.col("amount") == F.col("d.amount")))
    late = F.col("d").isNotNull() & (F.col("seq") > F.col("d.seq"))
    error = F.when(~F.coalesce(known, F.lit(False)), "HOLD_NOT_FOUND").when(late & ~same, "HOLD_CONFLICT").when(~late & ~valid, "INVALID_AMOUNT")
    error = F.when(F.coalesce(late, F.lit(False)), F.when(~same, "HOLD_CONFLICT")).otherwise(error)
    return t.select("seq", "hold_id", "kind", "amount", error.alias("error_code"), F.coalesce(late & same, F.lit(False)).alias("replayed"))


def hold_effects(holds: DataFrame) -> DataFrame:
    """id, balance_delta, reserved_delta summed over holds: an open one reserves; a settled one moves its settled amount and releases all."""
    open_ = F.when(F.col("status") == "reserved", F.col("amount")).otherwise(F.lit(0).cast("long"))
    moved = F.when(F.col("status") == "settled", F.col("settled_amount")).otherwise(F.lit(0).cast("long"))
    rows = holds.select(F.col("from_account").alias("id"), (-moved).alias("b"), open_.alias("r")).unionAll(holds.select("to_account", moved, F.lit(0).cast("long")))
    return rows.groupBy("id").agg(F.sum("b").alias("balance_delta"), F.sum("r").alias("reserved_delta"))
