"""State from a snapshot and the tail of the log: whoever was written last wins, key by key, in any order of reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerweave.functions.encoding import expired
from ledgerweave.operators import sequential

ACCOUNT = ("id", "currency", "balance", "reserved", "lsn")
HOLD = ("hold_id", "from_account", "to_account", "amount", "status", "settled_amount", "lsn")


def last_written(images: DataFrame, key: str, lsn: str = "lsn") -> DataFrame:
    """Of each key the row with the largest lsn; partial maxima are taken before the shuffle."""
    rest = [c for c in images.columns if c != key]
    return images.groupBy(key).agg(F.max_by(F.struct(*rest), lsn).alias("x")).select(key, *(F.col(f"x.{c}").alias(c) for c in rest)).select(*images.columns)


def account_images(wal: DataFrame) -> DataFrame:
    """What each record says of accounts: its post-images, or, in old records without any, what its result holds."""
    new = wal.where("state is not null").select(F.explode("state.accounts").alias("a")).select("a.*").select(*ACCOUNT)
    if "result" not in wal.columns or not str(wal.schema["result"].dataType.simpleString()).startswith("struct"):
        return new
    return new.unionByName(old_images(wal.where("state is null")).select(*ACCOUNT), allowMissingColumns=True)


def old_images(records: DataFrame) -> DataFrame:
    """Images from old records (lsn, kind, request, result as structs): nothing was reserved then; either side of a transfer counts by itself.

    A transfer's record has no currency: it is null here, and `recover_accounts` keeps that of the creation.
    """
    side = lambda account, currency, balance: F.struct(F.col(account).alias("id"), currency.alias("currency"), F.col(balance).alias("balance"))
    none = F.lit(None).cast("string")
    made = F.array(side("result.account_id", F.col("result.currency"), "result.balance"))
    moved = F.array(side("request.from_account", none, "result.from_balance"), side("request.to_account", none, "result.to_balance"))
    sides = records.select("lsn", F.inline(F.when(F.col("kind") == "create_account", made).when(F.col("kind") == "transfer", moved)))
    return sides.select("id", "currency", "balance", F.lit(0).cast("long").alias("reserved"), "lsn")


def recover_accounts(images: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """Accounts as the last image has them; a currency, once known, stays."""
    if snapshot is not None:
        images = snapshot.select(*ACCOUNT).unionByName(images.select(*ACCOUNT))
    state = F.max_by(F.struct("balance", "reserved", "lsn"), "lsn").alias("x")
    return images.groupBy("id").agg(F.max("currency").alias("currency"), state).select("id", "currency", "x.balance", F.coalesce("x.reserved", F.lit(0)).alias("reserved"), "x.lsn")


def recover_holds(images: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    if snapshot is not None:
        images = snapshot.select(*HOLD).unionByName(images.select(*HOLD))
    return last_written(images, "hold_id")


def hold_images(wal: DataFrame) -> DataFrame:
    return wal.where("state is not null").select(F.explode("state.holds").alias("h")).select("h.*").select(*HOLD)


def recover_keys(records: DataFrame, now: int, lease: int) -> DataFrame:
    """Idempotency keys whose lease still runs; of several commits under one key the newest."""
    return last_written(records.where(~expired(F.col("committed_at"), F.lit(now), lease)), "key")


def tail(wal: DataFrame, base_lsn: int) -> DataFrame:
    """Records that a snapshot doesn't cover; the filter reaches the scan."""
    return wal.where(F.col("lsn") > base_lsn)


def log_breaks(wal: DataFrame, base_lsn: int = 0, place: tuple[str, ...] = ("segment", "position")) -> DataFrame:
    """Records after base_lsn whose number doesn't rise over that of the record read before: such a log is corrupt.

    Records are compared within their segment, and the first of each segment
    with the last of those before it, so only one row per segment meets others.
    """
    seg, *inner = place
    kept = tail(wal, base_lsn)
    within = kept.withColumn("before", F.lag("lsn").over(Window.partitionBy(seg).orderBy(*inner)))
    ends = kept.groupBy(seg).agg(F.max_by("lsn", F.struct(*inner)).alias("end"))
    ends = ends.select(seg, F.lag("end").over(Window.orderBy(seg)).alias("end"))
    out = within.join(ends, seg).withColumn("before", F.coalesce("before", "end"))
    return out.where("before >= lsn").drop("end")


def segments(log: DataFrame, limit: int) -> DataFrame:
    """writer, lsn, size, segment of log(writer, lsn, size): a record that no longer fits opens the next one.

    Where a segment ends depends on where it began, so each writer's records
    are folded in order.
    """

    def step(held: list, size: int):
        if held[1] and held[1] + size > limit:
            held[0], held[1] = held[0] + 1, 0
        held[1] += size
        return size, held[0]

    rows = log.select("writer", "lsn", F.col("size").alias("_size"))
    return sequential.fold(rows, "writer", "lsn", ["_size"], "size bigint, segment bigint", lambda _: [1, 0], step, few=True)


def compactable(log: DataFrame, through: int) -> DataFrame:
    """Segments, but for the last, that hold nothing after `through`."""
    each = log.groupBy("segment").agg(F.max("lsn").alias("last_lsn"), F.count("*").alias("records"))
    newest = log.agg(F.max("segment").alias("newest"))
    return each.crossJoin(F.broadcast(newest)).where((F.col("segment") < F.col("newest")) & (F.col("last_lsn") <= through)).drop("newest")  # one row
