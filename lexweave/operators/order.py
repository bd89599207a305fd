"""Positions and running sums over a whole table, without bringing it into one task.

The table is sorted by ranges, each row notes its place within its range, and the ranges' totals, one number each, are
added up on the driver. Ties are split over ranges like other rows as long as the order is total.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.session import cut


def _sorted(df: DataFrame, order: tuple[Column, ...]) -> DataFrame:
    rows = cut(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    return rows.withColumn("_range", F.shiftright("_m", 33))


def _offsets(totals: list[tuple[int, float]], like) -> Column:
    starts = list(accumulate([v for _, v in totals], initial=0))
    return F.create_map(*[F.lit(x) for (k, _), s in zip(totals, starts) for x in (k, s)])[F.col("_range")] if totals else F.lit(like)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``position``, from 1, in a total order."""
    rows = _sorted(df, order)
    totals = sorted((r[0], r[1]) for r in rows.groupBy("_range").count().collect())
    within = F.col("_m").bitwiseAND((1 << 33) - 1)
    return rows.withColumn("position", _offsets(totals, 0) + within + 1).drop("_m", "_range")


def running_before(df: DataFrame, value: str, *order: Column) -> DataFrame:
    """``df`` with ``before``, the sum of ``value`` over all earlier rows."""
    rows = _sorted(df, order)
    totals = sorted((r[0], r[1]) for r in rows.groupBy("_range").agg(F.sum(value)).collect())
    w = Window.partitionBy("_range").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", _offsets(totals, 0) + F.coalesce(F.sum(value).over(w), F.lit(0))).drop("_m", "_range")
