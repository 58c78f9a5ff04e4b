"""Queries of the core: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions.urls import host_of, source_host
from tamiz.operators.timestamps import normalise_timestamps
from tamiz.session import broadcast_if_small, read_table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``noticias.fecha`` that gives an instant or a day, in normal form."""
    noticias = read_table(spark, sf_dir, "noticias").select("pos", "fecha", source_host(F.col("fuente"), F.col("url")).alias("host"))
    fuentes = read_table(spark, sf_dir, "fuentes").select(host_of(F.col("base_url")).alias("host"), "zona_horaria", "orden_fecha").dropDuplicates(["host"])
    joined = noticias.join(broadcast_if_small(fuentes), "host", "left")
    return normalise_timestamps(joined, "fecha", "zona_horaria", "orden_fecha").where("normal IS NOT NULL").select("pos", "normal").distinct()


def p4_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of ``noticias.fecha`` have each shape."""
    from tamiz.operators.timestamps import shape_of

    return (
        read_table(spark, sf_dir, "noticias")
        .where("fecha IS NOT NULL")
        .groupBy(shape_of(F.col("fecha")).alias("forma"))
        .agg(F.count("*").alias("n"), F.min("fecha").alias("ejemplo"))
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p4_found": p4_found,
    "p4_shapes": p4_shapes,
}

ORACLES: dict[str, str] = {
    "p4_shapes": r"""
        SELECT regexp_replace(regexp_replace(fecha, '\p{L}+', 'a', 'g'), '\p{Nd}', '9', 'g') AS forma,
               count(*) AS n, min(fecha) AS ejemplo
        FROM noticias WHERE fecha IS NOT NULL GROUP BY 1""",
}
