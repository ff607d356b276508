"""Operational statistics of a log and its state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerweave.functions.encoding import expired, nearest_rank


def ledger_stats(outcomes: DataFrame, holds: DataFrame, keys: DataFrame, now: int, lease: int, max_batch: int) -> DataFrame:
    """One row: last lsn, mutations, batches, duplicates, rejections, unexpired keys, open and closed holds, checkpoints due at every batch of 4096."""
    logged = F.col("wal_lsn").isNotNull()
    a = outcomes.agg(
        F.coalesce(F.max("wal_lsn"), F.lit(0)).alias("last_lsn"), F.count_if(logged).alias("mutations"),
        F.ceil(F.count_if(logged) / max_batch).alias("batches"), F.count_if(F.expr("replayed")).alias("duplicates"), F.count_if(F.expr("error_code is not null")).alias("rejections"),
    )
    b = holds.agg(F.count_if(F.expr("status = 'reserved'")).alias("active_holds"), F.count_if(F.expr("status != 'reserved'")).alias("terminal_holds"))
    c = keys.agg(F.count_if(~expired(F.col("committed_at"), F.lit(now), lease)).alias("idempotency_keys"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each


def average_batch(log: DataFrame) -> DataFrame:
    """Operations per group commit."""
    return log.agg((F.count("*") / F.count_distinct("batch")).alias("average_batch_size"))


def percentiles(df: DataFrame, value: str, *by: str, qs: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact values at ranks floor((n - 1) * q).

    Values are counted first, so that a group is as large as its distinct
    values, and the rank is found by a running sum over those counts.
    """
    from pyspark.sql import Window

    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    upto = F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(w))
    picks = [F.min(F.when(F.col("_upto") > F.floor((F.col("_all") - 1) * F.lit(q)), F.col(value))).alias(f"p{round(q * 100)}") for q in qs]
    return counts.groupBy(*by).agg(F.sum("_n").alias("n"), *picks)


def small_group_percentile(df: DataFrame, value: str, q: float, *by: str) -> DataFrame:
    """The same for groups that fit in an array."""
    return df.groupBy(*by).agg(nearest_rank(F.col(value), q).alias("value"))
