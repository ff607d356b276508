"""Transfer workloads: accounts in pairs of their own, spread evenly, or all from one account."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

WORKLOADS = ("disjoint", "uniform", "hot")


def accounts(spark: SparkSession, n: int, operations: int) -> DataFrame:
    """Each can afford every operation."""
    return spark.range(n).select(F.concat(F.lit("account-"), F.col("id").cast("string")).alias("id"), F.lit("USD").alias("currency"), F.lit(operations + 1).cast("bigint").alias("opening"))


def transfers(spark: SparkSession, workload: str, operations: int, n: int = 64, workers: int = 16) -> DataFrame:
    """seq, key, from_account, to_account, amount (1)."""
    if workload not in WORKLOADS:
        raise ValueError(f"workload must be one of {WORKLOADS}")
    i = F.col("id")
    if workload == "disjoint":
        a = (i % workers) * 2 % n
        b = a + 1
    elif workload == "uniform":
        a = i * 31 % n
        b = (a + 1 + i * 17 % (n - 1)) % n
    else:
        a, b = F.lit(0).cast("bigint"), 1 + i % (n - 1)
    name = lambda c: F.concat(F.lit("account-"), c.cast("string"))
    return spark.range(operations).select((i + 1).alias("seq"), F.concat(F.lit("op-"), i.cast("string")).alias("key"), name(a).alias("from_account"), name(b).alias("to_account"), F.lit(1).cast("bigint").alias("amount"))
