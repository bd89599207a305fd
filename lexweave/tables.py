"""Reading the parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder``; column pruning and filters reach its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    A table that came as one small file is one task, however long its texts take; only then its rows are dealt out. Tables
    of more files than cores are left as they are, so nothing is shuffled where there is much to shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` to be sent to every task where it has at most ``rows`` rows; beyond that the optimiser chooses the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
