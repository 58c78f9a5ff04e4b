"""Connected components of an edge table by rounds of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.session import materialise

#: Large-star and small-star rounds halve the depth of every tree: so many suffice for any graph that fits a disk.
MAX_ROUNDS = 100


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each node of an edge is connected with.

    Rounds of large-star and small-star: every node hands its least neighbour
    to the others, until no edge changes. Hot nodes cost what their edges cost,
    as each round is a grouped minimum with map-side combine and a join back on
    (node, least), never a list of neighbours. Each round is written to the
    shared folder, so no lineage grows. Self-loops and repeated edges are
    harmless; an empty table gives no rows.
    """
    current = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    loops = materialise(current.where("u = v").select("u"), "loops")
    current = materialise(current.where("u <> v"), "edges")
    signature = None
    for _ in range(MAX_ROUNDS):
        # Large star: larger neighbours of a node go to its least neighbour.
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours go to the least of them.
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small_least.select("u", F.col("m").alias("v"))).distinct()
        current = materialise(small, "edges")
        now = current.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == signature:
            break
        signature = tuple(now)
    else:
        raise RuntimeError(f"components not found in {MAX_ROUNDS} rounds")
    found = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return found.unionByName(roots).unionByName(loops.select(F.col("u").alias("node"), F.col("u").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
