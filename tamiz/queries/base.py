"""Projections that the queries share, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.session import read_table, spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as (doc_id, titulo, cuerpo, categoria, fuente): the first line is the title."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return docs.select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("titulo"), F.col("text").alias("cuerpo"), F.coalesce("lang", F.lit("sin_categoria")).alias("categoria"), F.col("source").alias("fuente"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "noticias"))


#: The document projection for DuckDB, as a common table expression named ``docs``.
DOCS = "docs AS (SELECT doc_id, split_part(text, chr(10), 1) AS titulo, text AS cuerpo, coalesce(lang, 'sin_categoria') AS categoria, source AS fuente FROM documents)"
#: Folded words of title and body.
WORDS = r"regexp_extract_all(strip_accents(lower(coalesce(titulo, '') || ' ' || coalesce(cuerpo, ''))), '[\p{L}\p{N}_]+')"
HOST = r"regexp_extract(regexp_replace(lower(trim({0})), '^[a-z][a-z0-9+.-]*://', ''), '^(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)', 1)"
SOURCE = f"coalesce(nullif({HOST.format('fuente')}, ''), nullif({HOST.format('url')}, ''))"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def tfidf_sql(features: int | None, sublinear: bool, name: str = "docs") -> str:
    """Common table expressions of the TF-IDF of word and pair terms of a projection like ``docs``, up to ``voc`` and ``weights``."""
    limit = f" ORDER BY total DESC, term LIMIT {features}" if features else ""
    tf = "(1 + ln(tf))" if sublinear else "tf"
    return f"""
    long AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(titulo, '') || ' ' || coalesce(cuerpo, ''))), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS ws FROM {name}),
    grams AS (SELECT doc_id, unnest(ws) AS term FROM long UNION ALL
              SELECT doc_id, ws[i] || ' ' || ws[i + 1] FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM long WHERE len(ws) >= 2)),
    counted AS (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS tf FROM grams GROUP BY 1, 2),
    voc AS (SELECT term, df, ln((1.0 + (SELECT count(*) FROM {name})) / (1.0 + df)) + 1.0 AS idf FROM (
            SELECT term, count(*) AS df, sum(tf) AS total FROM counted GROUP BY term{limit})),
    raw AS (SELECT doc_id, term, {tf} * idf AS r FROM counted JOIN voc USING (term)),
    norms AS (SELECT doc_id, sqrt(sum(r * r)) AS norm FROM raw GROUP BY doc_id),
    weights AS (SELECT doc_id, term, r / norm AS w FROM raw JOIN norms USING (doc_id))"""
