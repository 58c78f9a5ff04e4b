"""Counts and wording of categories over calendar periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.functions import lexicons
from tamiz.functions.text import fold, without


def month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def iso_week(date: Column) -> Column:
    """ISO year and week, as ``2024-W01``."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), date).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))


def valid_date(text: Column) -> Column:
    """The date of a ``yyyy-M-d`` text, null for anything else."""
    return F.try_to_date(F.trim(text), "yyyy-M-d")


def period_counts(df: DataFrame, category: str, period: str) -> DataFrame:
    """(categoria, periodo, n)."""
    return df.groupBy(F.col(category).alias("categoria"), F.col(period).alias("periodo")).agg(F.count("*").alias("n"))


def peak(df: DataFrame, category: str, period: str, order: str = "pos") -> DataFrame:
    """The busiest category and period; ties to the category that appears first, then the earlier period."""
    first = df.groupBy(F.col(category).alias("categoria")).agg(F.min(order).alias("_first"))
    counted = period_counts(df, category, period).join(first, "categoria")
    return counted.orderBy(F.desc("n"), "_first", "periodo").limit(1).drop("_first")


def bounds(df: DataFrame, category: str, period: str) -> DataFrame:
    """(categoria, primero, ultimo): first and last period of each category."""
    return df.groupBy(F.col(category).alias("categoria")).agg(F.min(period).alias("primero"), F.max(period).alias("ultimo"))


def trend_tokens(text: Column) -> Column:
    """Folded words of four ASCII letters or more, without the words that say nothing."""
    # A word with other letters or digits in it is no token, as its borders are word borders.
    found = F.regexp_extract_all(fold(text), F.lit(r"(?<![\p{L}\p{N}_])[a-z]{4,}(?![\p{L}\p{N}_])"), F.lit(0))
    return without(found, lexicons.TREND_STOPWORDS)


def term_changes(df: DataFrame, category: str, period: str, text: Column, n: int = 5) -> DataFrame:
    """(categoria, primero, ultimo, sentido, termino, cambio, rango): terms that gained or lost most.

    Difference of a term's count between the last and the first period of its
    category, by one conditional sum; categories of a single period have none;
    ties by term.
    """
    limits = bounds(df, category, period).where("primero < ultimo")
    small = F.broadcast(limits) if limits.count() <= 100_000 else limits
    rows = df.select(F.col(category).alias("categoria"), F.col(period).alias("_p"), text.alias("_text")).join(small, "categoria").where("_p = primero OR _p = ultimo")
    tokens = rows.select("categoria", "primero", "ultimo", F.when(F.col("_p") == F.col("ultimo"), 1).otherwise(-1).alias("_d"), F.explode(trend_tokens(F.col("_text"))).alias("termino"))
    changes = tokens.groupBy("categoria", "primero", "ultimo", "termino").agg(F.sum("_d").alias("cambio")).where("cambio <> 0")
    changes = changes.withColumn("sentido", F.when(F.col("cambio") > 0, "aumenta").otherwise("disminuye"))
    order = Window.partitionBy("categoria", "sentido").orderBy(F.desc(F.abs("cambio")), "termino")
    return changes.withColumn("rango", F.row_number().over(order)).where(F.col("rango") <= n)


def flat_table(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """(categoria, periodo, n, aumentan, disminuyen): counts beside the category's changed terms, comma-separated."""

    def joined(direction: str):
        picked = F.when(F.col("sentido") == direction, F.struct("rango", "termino"))
        return F.array_join(F.transform(F.array_sort(F.array_compact(F.collect_list(picked))), lambda x: x["termino"]), ", ")

    wording = changes.groupBy("categoria").agg(joined("aumenta").alias("aumentan"), joined("disminuye").alias("disminuyen"))
    return counts.join(wording, "categoria", "left").select("categoria", "periodo", "n", F.coalesce("aumentan", F.lit("")).alias("aumentan"), F.coalesce("disminuyen", F.lit("")).alias("disminuyen"))


def findings(df: DataFrame, changes: DataFrame, category: str, period: str, order: str = "pos") -> DataFrame:
    """One row: records, categories, periods, first and last period, the busiest category and period, categories whose wording changed, and ``estado``.

    ``completo`` needs three categories and a title in the busiest period.
    """
    counts = period_counts(df, category, period)
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("registros"), F.countDistinct("categoria").alias("categorias"), F.countDistinct("periodo").alias("periodos"), F.min("periodo").alias("primero"), F.max("periodo").alias("ultimo"))
    top = peak(df, category, period, order).select(F.col("categoria").alias("pico_categoria"), F.col("periodo").alias("pico_periodo"), F.col("n").alias("pico_n"))
    held = df.join(F.broadcast(top), (F.col(category) == F.col("pico_categoria")) & (F.col(period) == F.col("pico_periodo"))).agg(F.count_if(F.length("titulo") > 0).alias("pico_titulos"))
    changed = changes.agg(F.countDistinct("categoria").alias("con_cambios"))
    # Each of the four is one row.
    row = whole.join(top, F.lit(True), "left").crossJoin(held).crossJoin(changed)
    return row.withColumn("estado", F.when((F.col("categorias") >= 3) & (F.col("pico_titulos") > 0), "completo").otherwise("parcial"))


def bars(counts: DataFrame, width: int = 35) -> DataFrame:
    """Add ``barra``: marks in proportion to the greatest count."""
    most = counts.agg(F.max("n").alias("_max"))
    return counts.join(F.broadcast(most)).withColumn("barra", F.expr(f"repeat('#', int(bround(n / _max * {width})))")).drop("_max")
