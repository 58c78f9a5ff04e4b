"""Nearest neighbours of dense vectors, recommendations, and greedy groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamiz.session import materialise

#: Vectors of one block; two blocks are one matrix product.
BLOCK = 2048


def _blocks(df: DataFrame, ident: str, vector: str, size: int, prefix: str, kinds: tuple[str, str] = ("long", "float"), label: str | None = None) -> DataFrame:
    """Rows of up to ``size`` vectors each, as (prefix_ids, prefix_vectors), and prefix_labels where a label is named."""

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        rows: list[np.ndarray] = []
        labels: list = []
        for frame in frames:
            ids += frame[ident].tolist()
            rows += list(frame[vector])
            labels += frame[label].tolist() if label else []
            while len(ids) >= size:
                yield _row(ids[:size], rows[:size], prefix, dtype, labels[:size] if label else None)
                ids, rows, labels = ids[size:], rows[size:], labels[size:]
        if ids:
            yield _row(ids, rows, prefix, dtype, labels if label else None)

    dtype = np.float64 if kinds[1] == "double" else np.float32
    columns = [F.col(ident).cast(kinds[0]).alias(ident), F.col(vector).cast(f"array<{kinds[1]}>").alias(vector)]
    kept = df.where(F.col(ident).isNotNull() & (F.size(vector) > 0)).select(*columns, *([F.col(label).cast("string").alias(label)] if label else []))
    return kept.mapInPandas(gather, f"{prefix}_ids array<{kinds[0]}>, {prefix}_vectors array<{kinds[1]}>" + f", {prefix}_labels array<string>" * bool(label))


def _row(ids: list, rows: list[np.ndarray], prefix: str, dtype: type = np.float32, labels: list | None = None) -> pd.DataFrame:
    row = {f"{prefix}_ids": [ids], f"{prefix}_vectors": [np.concatenate([np.asarray(r, dtype=dtype) for r in rows])]}
    return pd.DataFrame(row | ({} if labels is None else {f"{prefix}_labels": [labels]}))


def _unit(vectors: np.ndarray, count: int) -> np.ndarray:
    """The vectors of a block as rows of length one; those of length zero stay so."""
    rows = np.asarray(vectors, dtype=np.float64).reshape(count, -1)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def meet(spark: SparkSession, asked: DataFrame, all_: DataFrame) -> DataFrame:
    """Every block with every block."""
    return all_.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))).join(F.broadcast(asked) if asked.count() <= 64 else asked)


def nearest_vectors(df: DataFrame, ident: str, vector: str, queries: DataFrame, n: int = 5, differ: str | None = None, later_first: bool = True) -> DataFrame:
    """(i, j, coseno, rango): the ``n`` nearest vectors of each query vector, itself left out, ties j descending (or ascending).

    Exact: every block of queries meets every block of vectors in one matrix
    product, of which only the best ``n`` a query leave the task. Where a column
    ``differ`` is named, vectors that have the query's value of it (null is a
    value) are left out before the best are taken. Vectors of length zero have
    cosine 0; all vectors must have one length.
    """
    asked, all_ = _blocks(queries, ident, vector, BLOCK, "q", label=differ), _blocks(df, ident, vector, BLOCK, "v", label=differ)
    sign = -1 if later_first else 1

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                cos = np.round(_unit(row.q_vectors, len(row.q_ids)) @ _unit(row.v_vectors, len(row.v_ids)).T, 9)
                v_ids, q_ids = np.asarray(row.v_ids), np.asarray(row.q_ids)
                cos[q_ids[:, None] == v_ids[None, :]] = -np.inf
                if differ:
                    codes = {x: k for k, x in enumerate({*row.q_labels, *row.v_labels})}
                    cos[np.array([codes[x] for x in row.q_labels])[:, None] == np.array([codes[x] for x in row.v_labels])[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(sign * v_ids, cos.shape), -cos), axis=1)[:, :n]
                best = np.take_along_axis(cos, order, axis=1)
                keep = np.isfinite(best)
                yield pd.DataFrame({"i": np.repeat(q_ids, order.shape[1])[keep.ravel()], "j": v_ids[order].ravel()[keep.ravel()], "coseno": best.ravel()[keep.ravel()]})

    partial = meet(df.sparkSession, asked, all_).mapInPandas(multiply, "i long, j long, coseno double")
    ranked = partial.withColumn("rango", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("coseno"), F.desc("j") if later_first else F.asc("j"))))
    return ranked.where(F.col("rango") <= n)


def profile_affinities(df: DataFrame, ident: str, vector: str, read: DataFrame, profile: str = "perfil") -> DataFrame:
    """(perfil, j, afinidad): the cosines of each vector with all that a profile (perfil, i) has read, summed.

    The sum of cosines is the product with the sum of the read unit vectors, so
    that no similarity is cut or listed: each profile is one vector, and blocks
    of them meet all blocks of vectors.
    """
    kind = read.schema[profile].dataType.simpleString()
    taken = read.select(profile, F.col("i").alias(ident)).where(F.col(profile).isNotNull())
    chosen = df.where(F.size(vector) > 0).select(ident, F.col(vector).cast("array<double>").alias("_v")).join(taken, ident)
    length = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    parts = chosen.select(profile, F.posexplode("_v").alias("_k", "_x"), length.alias("_n")).groupBy(profile, "_k").agg(F.sum(F.when(F.col("_n") > 0, F.col("_x") / F.col("_n")).otherwise(0.0)).alias("_x"))
    sums = parts.groupBy(profile).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_x"))), lambda e: e["_x"]).alias("_v"))

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                v = _unit(row.v_vectors, len(row.v_ids))
                for name, total in zip(row.q_ids, np.asarray(row.q_vectors).reshape(len(row.q_ids), -1), strict=True):
                    yield pd.DataFrame({profile: [name] * len(v), "j": row.v_ids, "afinidad": np.round(v @ total, 9)})

    met = meet(df.sparkSession, _blocks(sums, profile, "_v", BLOCK, "q", (kind, "double")), _blocks(df, ident, vector, BLOCK, "v"))
    return met.mapInPandas(multiply, f"{profile} {kind}, j long, afinidad double")


def similar_pairs(df: DataFrame, ident: str, vector: str, least: float) -> DataFrame:
    """(a, b), a before b: every pair of vectors whose cosine is ``least`` or more.

    Every block of vectors meets every block; the threshold is applied inside
    the product. Nothing else is left out, so the pairs may grow as the square
    of the vectors.
    """

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                a_ids, b_ids = np.asarray(row.q_ids), np.asarray(row.v_ids)
                if a_ids.min() >= b_ids.max():
                    continue
                a, b = _unit(row.q_vectors, len(a_ids)), _unit(row.v_vectors, len(b_ids))
                # In strips, so that a frame of pairs stays small.
                for k in range(0, len(a_ids), 256):
                    i, j = np.nonzero((a[k : k + 256] @ b.T >= least) & (a_ids[k : k + 256, None] < b_ids[None, :]))
                    yield pd.DataFrame({"a": a_ids[k + i], "b": b_ids[j]})

    return meet(df.sparkSession, _blocks(df, ident, vector, BLOCK, "q"), _blocks(df, ident, vector, BLOCK, "v")).mapInPandas(multiply, "a long, b long")


def recommend(similarities: DataFrame, docs: DataFrame, category: str = "categoria", n: int = 3, other_categories: bool = False) -> DataFrame:
    """(i, j, coseno, rango) of (i, j, coseno): the nearest items, ties j ascending; optionally of another category only."""
    rows = similarities
    if other_categories:
        a, b = docs.select(F.col("doc_id").alias("i"), F.col(category).alias("_a")), docs.select(F.col("doc_id").alias("j"), F.col(category).alias("_b"))
        rows = rows.join(a, "i").join(b, "j").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("i", "j", "coseno")
    ranked = rows.withColumn("rango", F.row_number().over(Window.partitionBy("i").orderBy(F.desc(F.round("coseno", 9)), "j")))
    return ranked.where(F.col("rango") <= n)


def recommend_for_profile(similarities: DataFrame, read: DataFrame, n: int = 3, profile: str = "perfil") -> DataFrame:
    """(perfil, j, afinidad, rango): items nearest to all that a profile (perfil, i) has read, read ones left out, ties j descending."""
    sums = similarities.join(read.select(profile, "i"), "i").groupBy(profile, "j").agg(F.round(F.sum("coseno"), 9).alias("afinidad"))
    return best_unread(sums, read, n, profile)


def best_unread(sums: DataFrame, read: DataFrame, n: int = 3, profile: str = "perfil") -> DataFrame:
    """(perfil, j, afinidad, rango) of (perfil, j, afinidad): the best that the profile has not read, above 0, ties j descending."""
    fresh = sums.join(read.select(profile, F.col("i").alias("j")), [profile, "j"], "left_anti").where("afinidad > 0")
    ranked = fresh.withColumn("rango", F.row_number().over(Window.partitionBy(profile).orderBy(F.desc("afinidad"), F.desc("j"))))
    return ranked.where(F.col("rango") <= n)


def greedy_groups(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(nodo, lider) of nodes (nodo) and edges (a, b): in order of nodo, a free node leads and takes its free later neighbours.

    Equals the lexicographically first maximal independent set, found in rounds:
    an undecided node without a smaller undecided neighbour leads, and its
    undecided neighbours follow. Members are dealt to their least leader after
    the last round. Each round is written to the shared folder.
    """
    both = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    both = materialise(both, "edges")
    undecided = nodes.select("nodo").distinct()
    leaders = undecided.limit(0)
    for _ in range(max_rounds):
        live = both.join(undecided.withColumnRenamed("nodo", "hi"), "hi", "left_semi").join(undecided.withColumnRenamed("nodo", "lo"), "lo", "left_semi")
        fresh = undecided.join(live.select(F.col("hi").alias("nodo")).distinct(), "nodo", "left_anti")
        fresh = materialise(fresh, "leaders")
        leaders = leaders.unionByName(fresh)
        followers = live.join(fresh.withColumnRenamed("nodo", "lo"), "lo", "left_semi").select(F.col("hi").alias("nodo")).distinct()
        undecided = materialise(undecided.join(fresh, "nodo", "left_anti").join(followers, "nodo", "left_anti"), "undecided")
        if undecided.isEmpty():
            break
    else:
        raise RuntimeError("no fixed point within the rounds allowed")
    leaders = materialise(leaders, "leaders")
    members = both.join(leaders.withColumnRenamed("nodo", "lo"), "lo", "left_semi").groupBy(F.col("hi").alias("nodo")).agg(F.min("lo").alias("lider"))
    members = members.join(leaders, "nodo", "left_anti")
    return leaders.select("nodo", F.col("nodo").alias("lider")).unionByName(members)
