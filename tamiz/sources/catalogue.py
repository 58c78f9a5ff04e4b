"""The catalogue of sources: listing, lookup, validation, and new entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamiz.functions.text import fold, slug
from tamiz.functions.urls import host_of
from tamiz.session import broadcast_if_small


def active(catalogue: DataFrame) -> DataFrame:
    return catalogue.where(F.col("activo"))


def by_name(catalogue: DataFrame, name: str) -> DataFrame:
    """The source of a name, case and accents left aside; a missing one is an error."""
    found = catalogue.where(fold(F.col("nombre")) == fold(F.lit(name)))
    if found.isEmpty():
        raise KeyError(name)
    return found


def validation_errors(catalogue: DataFrame) -> DataFrame:
    """Add ``errores``: what is wrong with each source."""
    urls, domains = F.coalesce(F.size("urls"), F.lit(0)), F.coalesce(F.size("dominios_permitidos"), F.lit(0))
    errors = [
        F.when(~F.coalesce(F.col("tipo"), F.lit("")).isin("rss", "html"), "tipo debe ser 'rss' o 'html'"),
        F.when(urls <= 0, "urls debe ser una lista no vacia").when(F.exists("urls", lambda u: ~F.coalesce(u.rlike("^https?://"), F.lit(False))), "todas las urls deben ser http(s)"),
        F.when(domains <= 0, "dominios_permitidos debe ser una lista no vacia"),
        F.when(F.coalesce(F.col("limite_noticias"), F.lit(0)) <= 0, "limite_noticias debe ser un entero positivo"),
        F.when(F.coalesce(F.col("delay_segundos"), F.lit(-1.0)) < 0, "delay_segundos debe ser numerico y no negativo"),
    ]
    return catalogue.withColumn("errores", F.array_compact(F.array(*errors)))


def with_custom(catalogue: DataFrame, fresh: DataFrame) -> DataFrame:
    """The catalogue and new sources (nombre, base_url): known hosts are left out, identifiers get the first free suffix."""
    known = catalogue.select(host_of(F.col("base_url")).alias("_h")).distinct()
    named = fresh.withColumn("_h", host_of(F.col("base_url"))).where("_h IS NOT NULL").dropDuplicates(["_h"]).join(broadcast_if_small(known), "_h", "left_anti")
    named = named.withColumn("_s", slug(F.col("nombre"), "sin_valor"))
    taken = catalogue.select(F.regexp_replace("id", r"_\d+$", "").alias("_s")).groupBy("_s").agg(F.count("*").alias("_n"))
    numbered = named.join(broadcast_if_small(taken), "_s", "left").withColumn("_k", F.coalesce("_n", F.lit(0)) + F.row_number().over(Window.partitionBy("_s").orderBy("_h")))
    rows = numbered.select(F.when(F.col("_k") > 1, F.concat("_s", F.lit("_"), F.col("_k").cast("string"))).otherwise(F.col("_s")).alias("id"), "nombre", "base_url")
    return catalogue.unionByName(rows, allowMissingColumns=True)
