"""Saved queries matched against articles, in batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.functions.text import query_pieces
from tamiz.session import broadcast_if_small, materialise

#: Saved queries of one block.
BLOCK_QUERIES = 100_000


def article_key(df: DataFrame):
    """Identifier of an article: its URL, or its title, in lower case without spaces around."""
    return F.lower(F.trim(F.coalesce(F.when(F.trim("url") != "", F.col("url")), F.col("titulo"))))


def register(queries: DataFrame, fresh: DataFrame) -> DataFrame:
    """Saved queries and new ones; an empty expression, which would match everything, is refused."""
    if not fresh.where(F.trim(F.coalesce("expresion", F.lit(""))) == "").isEmpty():
        raise ValueError("a saved query needs an expression")
    return queries.unionByName(fresh)


def matches(articles: DataFrame, queries: DataFrame) -> DataFrame:
    """(consulta, expresion, noticia_id, titulo): articles whose title and body hold every piece of a query.

    Pieces are substrings in lower case; accents matter. The saved queries meet
    the articles in blocks of about ``BLOCK_QUERIES``, each broadcast by itself.
    """
    prepared = queries.select(F.col("nombre").alias("consulta"), "expresion", query_pieces(F.col("expresion")).alias("_p"))
    text = F.lower(F.concat_ws(" ", F.coalesce("titulo", F.lit("")), F.coalesce("cuerpo", F.lit(""))))
    rows = articles.select(article_key(articles).alias("noticia_id"), "titulo", text.alias("_t"))
    blocks = -(-queries.count() // BLOCK_QUERIES)
    if blocks > 1:
        prepared = materialise(prepared.withColumn("_b", F.pmod(F.xxhash64("consulta", "expresion"), F.lit(blocks))), "queries")
        parts = [prepared.where(F.col("_b") == b).drop("_b") for b in range(blocks)]
    else:
        parts = [prepared]
    holds = F.expr("forall(_p, p -> contains(_t, p))")
    met = reduce(DataFrame.unionByName, [rows.join(broadcast_if_small(part), holds) for part in parts])
    return met.select("consulta", "expresion", "noticia_id", "titulo")


def alerts(articles: DataFrame, queries: DataFrame, emitted: DataFrame | None = None) -> DataFrame:
    """:func:`matches` once for each (consulta, noticia_id), those in ``emitted`` left out."""
    found = matches(articles, queries).groupBy("consulta", "expresion", "noticia_id").agg(F.min("titulo").alias("titulo"))
    return found if emitted is None else found.join(emitted.select("consulta", "noticia_id"), ["consulta", "noticia_id"], "left_anti")
