"""Cap the records of dominant contributors, keeping those of best quality.

A contributor with n rows keeps its ``cap`` best rows in the order quality
descending (nulls last), identifier ascending. Only contributors above their
cap are ranked at all; their number is at most 1/share, so their list is a
proven-small broadcast. Their rows are salted by a range partition of (contributor,
quality, identifier): counts per salt give each salt its first rank, so salts
wholly inside or outside the cap are decided by a sum, and only the one salt
per contributor that the cap cuts through is ranked. No task ever holds a
contributor, however dominant.

Defined results: a null or (where asked) blank contributor is not capped; NaN
quality counts as null; rows that repeat an identifier are ranked one by one,
so an identifier goes if any of its rows does; an empty table gives no rows.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.session import materialise

#: Rows that one salt should hold.
SALT_ROWS = 50_000
MAX_SALTS = 4_096


def rows_beyond_caps(df: DataFrame, ident: str, quality: str, contributors: dict[str, tuple[Column, float]], floor: int = 1) -> DataFrame:
    """Identifiers of the rows that rank beyond any of the caps.

    ``contributors`` names each kind of contributor with its column and the
    share of all rows that one of them may hold; ranks are taken over all
    rows, independently for each kind. The cap is max(``floor``, share * n).
    """
    wanted = F.coalesce(F.when(~F.isnan(F.col(quality).cast("double")), F.col(quality).cast("double")), F.lit(float("-inf")))
    kinds = [
        F.struct(F.lit(kind).alias("kind"), column.cast("string").alias("who"), F.lit(float(share)).alias("share"))
        for kind, (column, share) in contributors.items()
    ]
    long = df.select(F.col(ident).alias("_id"), wanted.alias("_q"), F.explode(F.array(*kinds)).alias("_k")).where("_k.who IS NOT NULL")
    long = long.select("_id", "_q", "_k.kind", "_k.who", "_k.share")

    n = df.count()
    counted = long.groupBy("kind", "who", "share").agg(F.count("*").alias("rows"))
    # Decimal shares: 5 % of 140 rows is 7, with no binary rounding.
    caps = {kind: max(floor, int(Decimal(str(share)) * n)) for kind, (_, share) in contributors.items()}
    cap = F.coalesce(*[F.when(F.col("kind") == kind, F.lit(value)) for kind, value in caps.items()])
    dominant = counted.select("kind", "who", "rows", cap.alias("cap")).where("rows > cap")

    # More than n / cap contributors cannot be above their cap; with floor caps on tiny tables the list is as small as the table.
    heavy = dominant.agg(F.count("*").alias("c"), F.coalesce(F.sum("rows"), F.lit(0)).alias("r")).first()
    salts = max(1, min(MAX_SALTS, -(-heavy["r"] // SALT_ROWS)))
    small = F.broadcast(dominant) if heavy["c"] <= 1_000_000 else dominant
    ranked_in = long.drop("share").join(small.drop("rows"), ["kind", "who"])

    salted = ranked_in.repartitionByRange(salts, F.col("kind"), F.col("who"), F.col("_q").desc(), F.col("_id").asc())
    salted = materialise(salted.withColumn("_salt", F.spark_partition_id()), "salted")

    before = Window.partitionBy("kind", "who").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        salted.groupBy("kind", "who", "cap", "_salt")
        .agg(F.count("*").alias("held"))
        .withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0)))
        .select("kind", "who", "_salt", "start", (F.col("start") + F.col("held")).alias("end"))
    )
    # One row per contributor and salt: at most contributors + salts rows, as the salts are ranges.
    spans = F.broadcast(spans) if heavy["c"] + salts <= 1_000_000 else spans
    placed = salted.join(spans, ["kind", "who", "_salt"]).where("end > cap")
    outside = placed.where("start >= cap").select("_id")
    within = Window.partitionBy("kind", "who", "_salt").orderBy(F.col("_q").desc(), F.col("_id").asc())
    cut = placed.where("start < cap").withColumn("_r", F.row_number().over(within) + F.col("start")).where("_r > cap").select("_id")
    return outside.unionByName(cut).distinct().withColumnRenamed("_id", ident)
