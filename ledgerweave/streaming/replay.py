"""Replay of operations as they arrive, with Structured Streaming.

Each micro-batch is a replay from the state that the ones before have left.
Accounts and holds are written after each; a key is looked up among the
outcomes themselves, so no task holds more than the keys that come again, nor
the operations.  Micro-batches must arrive in the order of `seq`; within one,
operations are judged in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerweave.functions.encoding import fingerprint, request_json
from ledgerweave.operators import recovery, replay
from ledgerweave.plans.schema import OPS

_RESULT = ("status", "settled_amount", "amount", "from_account", "to_account", "hold_id", "from_balance", "from_reserved", "to_balance", "to_reserved", "currency")
_ACCOUNT = "id string, currency string, balance bigint, reserved bigint, lsn bigint"
_HOLD = f"hold_id string, from_account string, to_account string, amount bigint, status string, settled_amount bigint, lsn bigint, result struct<{','.join(f'{c}:' + ('bigint' if c.split('_')[-1] in ('amount', 'balance', 'reserved') else 'string') for c in _RESULT)}>, commit bigint"


def outcomes(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """What became of the operations (FOLD columns), of micro-batches before a number or of all."""
    rows = spark.read.schema(f"{replay.FOLD}, batch bigint").parquet(out)
    return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")


def _keys(past: DataFrame) -> DataFrame:
    """The keys that outcomes have used.  What was asked follows from the result, so it isn't stored again."""
    own = {"account_id": "from_account", "opening_balance": "amount"}
    asked = lambda c: F.when(F.col("kind") == "settle", F.col("settled_amount")).otherwise(F.col("amount")) if c == "amount" else F.col(own.get(c, c))
    # commit as the negative, as the fold takes numbers of a log for keys that it loads
    rows = past.where("logged").select("key", fingerprint(F.col("kind"), request_json(asked)).alias("fingerprint"), F.struct(*_RESULT).alias("result"), (-F.col("commit_seq")).alias("lsn"), F.col("ts_nanos").alias("committed_at"), "seq")
    return recovery.last_written(rows, "key", "seq").drop("seq")


def stream_replay(ops: DataFrame, lease: int, out: str, at: str) -> StreamingQuery:
    """Start to judge a stream of `ops` rows, as far as it has come: outcomes go to `out`, state and progress below `at`.

    A micro-batch that is done again after a failure overwrites what it had written.
    """
    spark, names = ops.sparkSession, OPS.names

    def judge(batch: DataFrame, k: int) -> None:
        batch.select(*names).write.mode("overwrite").parquet(f"{at}/operations/{k}")
        now = spark.read.schema(OPS).parquet(f"{at}/operations/{k}")
        accounts = holds = keys = None
        if k:
            accounts, holds = spark.read.schema(_ACCOUNT).parquet(f"{at}/accounts/{k - 1}"), spark.read.schema(_HOLD).parquet(f"{at}/holds/{k - 1}")
            used = now.select("key").distinct()
            keys = _keys(outcomes(spark, out, k).join(used, "key", "left_semi"))
        told = replay.replay(now, lease, accounts, holds, keys)
        told.write.mode("overwrite").parquet(f"{out}/batch={k}")
        told = spark.read.schema(replay.FOLD).parquet(f"{out}/batch={k}").withColumn("wal_lsn", F.when(F.col("logged"), F.col("seq")))
        images, held = replay.log_images(told)
        closed = F.col("status") != "reserved"
        held = told.where("wal_lsn is not null and not replayed and hold_id is not null").select(*held.columns[:-1], F.col("wal_lsn").alias("lsn"), F.when(closed, F.struct(*_RESULT)).alias("result"), F.when(closed, F.col("seq")).alias("commit"))
        recovery.recover_accounts(images, accounts).write.mode("overwrite").parquet(f"{at}/accounts/{k}")
        recovery.last_written(held if holds is None else holds.unionByName(held), "hold_id").write.mode("overwrite").parquet(f"{at}/holds/{k}")

    return ops.writeStream.foreachBatch(judge).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()


def stream_winners(ops: DataFrame, lease: str, at: str = "ts", key: str = "key") -> DataFrame:
    """The first operation of each key within its lease, for streams that only need those; it doesn't report replays or conflicts."""
    return ops.withWatermark(at, lease).dropDuplicatesWithinWatermark([key])
