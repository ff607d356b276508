"""Dense numbers over a total order without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def dense_number(df: DataFrame, name: str, bucket: Column, *order: str | Column, also: dict[str, Column] | None = None, whole: bool = False) -> DataFrame:
    """df with `name`: 1, 2, ... in the order of the columns; `also`: further numbers, over the rows that satisfy a condition (null for others).

    bucket never falls along the order; rows are counted per bucket, counts
    are summed up, and only the rows of one bucket are sorted together.
    whole: rows are dealt by bucket before they are counted, and the count is
    made to read every column, so that counting and numbering share one
    exchange instead of computing df twice.  That holds if every column of df
    is used after it; else they are two, with the same result.
    """
    also = also or {}
    df = df.withColumn("_bucket", bucket).withColumns({f"_is_{k}": c for k, c in also.items()})
    number, counted = F.count_if, df
    if whole:
        df = counted = df.where("_bucket is not null").repartition("_bucket")  # the join below would say so on one side only
        mark = F.xxhash64(*df.columns)
        number = lambda c: F.count_if(c & (mark >= 0)) + F.count_if(c & (mark < 0))
    counts = counted.groupBy("_bucket").agg(number(F.lit(True)).alias("_n"), *(number(F.col(f"_is_{k}")).alias(f"_n_{k}") for k in also))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), *(F.coalesce(F.sum(f"_n_{k}").over(earlier), F.lit(0)).alias(f"_before_{k}") for k in also))
    w = Window.partitionBy("_bucket").orderBy(*order)
    placed = df.withColumns({name: F.row_number().over(w)} | {k: F.count_if(f"_is_{k}").over(w.rowsBetween(Window.unboundedPreceding, 0)) for k in also})
    placed = placed.join(offsets, "_bucket").withColumns({name: F.col(name) + F.col("_before")} | {k: F.when(F.col(f"_is_{k}"), F.col(k) + F.col(f"_before_{k}")) for k in also})
    return placed.drop("_bucket", "_before", *(f"{x}_{k}" for k in also for x in ("_is", "_before")))


def assign_lsn(committed: DataFrame, order: str = "seq", width: int = 1 << 16) -> DataFrame:
    """Committed operations with their log sequence numbers: +1 per operation in the order of arrival."""
    return dense_number(committed, "lsn", F.floor(F.col(order) / width), order)


def commit_batches(log: DataFrame, max_batch: int) -> DataFrame:
    """log(lsn, ...) with the number of the group commit that holds each record, when every group is full."""
    return log.withColumn("batch", F.floor((F.col("lsn") - 1) / max_batch))


def checkpoints_due(log: DataFrame, every: int) -> DataFrame:
    """The sequence numbers at which a checkpoint every so many operations falls due."""
    return log.where(F.col("lsn") % every == 0).select((F.col("lsn") / every).cast("long").alias("checkpoint"), F.col("lsn").alias("base_lsn"))
