"""Idempotency keys: who wins, what is replayed, what conflicts, and when a key may be used again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerweave.functions.encoding import expired, shard_index
from ledgerweave.operators import sequential


def classify(ops: DataFrame, key: str = "key", fingerprint: str = "fingerprint", order: str = "seq") -> DataFrame:
    """ops with `outcome`: winner, replay or conflict, for logs in which each key's first operation commits and no lease ends.

    One shuffle by key; rows are compared with the first of their key, so no key is held in memory.
    """
    first = F.first(fingerprint).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return ops.withColumn("outcome", F.when(rank == 1, "winner").when(F.col(fingerprint) == first, "replay").otherwise("conflict"))


def winners(ops: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """The first operation of each key; pre-aggregated, so a key with very many retries costs one row per task."""
    rest = [c for c in ops.columns if c not in (key, order)]
    best = ops.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("w"))
    return best.select(F.col(f"w.{order}").alias(order), key, *(F.col(f"w.{c}").alias(c) for c in rest))


def with_leases(ops: DataFrame, lease: int, key: str = "key", fingerprint: str = "fingerprint", order: str = "seq", at: str = "ts_nanos") -> DataFrame:
    """key, order, outcome for logs whose keys are leased: once a lease has run out, the key's next operation commits anew.

    All operations are taken to be acceptable.  The fold of a key carries the
    fingerprint and the time of its last commit.
    """

    def step(held: list, now: int, fp: str):
        if held[1] is None or now - held[1] >= lease:
            held[:] = fp, now
            return ("winner",)
        return ("replay" if held[0] == fp else "conflict",)

    return sequential.fold(ops, key, order, [at, fingerprint], "outcome string", lambda *_: [None, None], step)


def retained(keys: DataFrame, now: int | Column, lease: int) -> DataFrame:
    """Committed keys whose lease still runs; the rest may be pruned."""
    return keys.where(~expired(F.col("committed_at"), F.lit(now) if isinstance(now, int) else now, lease))


def prune_shard(keys: DataFrame, shard: int, now: int, lease: int) -> DataFrame:
    """keys without the expired ones of one shard, as one pruning step leaves them."""
    return keys.where((shard_index(F.col("key")) != shard) | ~expired(F.col("committed_at"), F.lit(now), lease))


def alias_records(outcomes: DataFrame) -> DataFrame:
    """Late terminal retries under a new key: they have a log record of their own but repeat an older result."""
    return outcomes.where("replayed and wal_lsn is not null and commit_lsn < wal_lsn")
