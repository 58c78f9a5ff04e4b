"""Ranks within groups of any size, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.session import broadcast_if_small, materialise

#: Rows of one range.
RANGE_ROWS = 250_000


def ranked(df: DataFrame, keys: list[str], order: list[Column], out: str = "rango", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``out``, the rank from 1 of each row within its ``keys`` in the given order.

    Rows are cut into ranges of (keys, order); a row's rank is its place in its
    range after all rows of its keys in the ranges before. Only the counts of
    the ranges are summed in a window, one row a key and range. Rows that the
    order leaves equal get different ranks, in no stated order.
    """
    parts = max(1, -(-df.count() // range_rows))
    cut = materialise(df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*keys, "_range").agg(F.count("*").alias("_k")).withColumn("_start", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")
    names = {k: f"_key_{k}" for k in (*keys, "_range")}
    starts = starts.select(*[F.col(k).alias(n) for k, n in names.items()], "_start")
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    placed = cut.withColumn("_place", place).join(broadcast_if_small(starts), same)
    return placed.withColumn(out, (F.col("_place") + F.col("_start")).cast("int")).drop("_place", "_start", "_range", *names.values())
