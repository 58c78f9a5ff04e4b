"""Rows that meet under one key, in blocks of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.session import broadcast_if_small

#: Rows of one block of a key.
BLOCK = 512


def met(rows: DataFrame, key: str, item: str, wanted: str, *extra: str, block: int = BLOCK) -> DataFrame:
    """(item, other, extra, other_extra) of two rows with one ``key`` for which the SQL text ``wanted`` holds.

    The rows of a key are dealt to ceil(n / ``block``) blocks by their hash, and each
    pair of blocks is a group of its own, so no task holds a hot key, and every
    pair of rows comes up once in either order. Null keys meet nothing.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / block)
    placed = rows.join(broadcast_if_small(sizes), key).withColumn("_b", F.pmod(F.xxhash64(item), blocks))
    placed = placed.withColumn("_x", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    placed = placed.select(key, item, *extra, "_b", F.least("_b", "_x").alias("_p"), F.greatest("_b", "_x").alias("_q"))
    names = {c: f"other_{c}" for c in (item, *extra)}
    other = placed.select(key, "_p", "_q", F.col("_b").alias("_ob"), *[F.col(c).alias(n) for c, n in names.items()])
    both = placed.join(other, [key, "_p", "_q"]).where("_p = _q OR _b <> _ob").where(wanted)
    return both.select(item, names[item], *extra, *[names[c] for c in extra])
