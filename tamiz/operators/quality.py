"""Validation and first-wins deduplication of article records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamiz.functions.text import collapse

# Fields that every record must have.
REQUIRED = ["titulo", "cuerpo", "fecha", "url", "autor", "categoria_original", "fuente"]
MIN_TITLE, MIN_BODY = 5, 50


def with_motives(df: DataFrame, min_title: int = MIN_TITLE, min_body: int = MIN_BODY) -> DataFrame:
    """Add ``motivos``: why each record is rejected on its own fields.

    A present null counts as the text ``None`` for the checks of length and
    form, as a null of a JSON record does; an empty field is only missing.
    """

    def text(name: str):
        return F.coalesce(F.trim(F.col(name).cast("string")), F.lit("None"))

    missing = [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(f"Campo obligatorio ausente o vacío: '{c}'")) for c in REQUIRED]
    title, body, date = text("titulo"), text("cuerpo"), text("fecha")
    checks = [
        F.when((title != "") & (F.length(title) < min_title), F.format_string(f"Longitud del título insuficiente: %d < {min_title}", F.length(title))),
        F.when((body != "") & (F.length(body) < min_body), F.format_string(f"Longitud del cuerpo insuficiente: %d < {min_body}", F.length(body))),
        F.when((date != "") & ~date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(F.lit("Formato de fecha inválido: '"), date, F.lit("' (se esperaba YYYY-MM-DD)"))),
        *[F.when((text(c) != "") & ~text(c).rlike(r"(?i)^https?://"), F.concat(F.lit(f"URL inválida en campo '{c}': '"), text(c), F.lit("'"))) for c in ("url", "fuente")],
    ]
    return df.withColumn("motivos", F.array_compact(F.array(*missing, *checks)))


def validated(df: DataFrame, order: str = "pos") -> DataFrame:
    """:func:`with_motives`, and then the first record of each URL and, among those, of each title.

    Only records without a motive compete; the first one in ``order`` wins. Both
    passes keep one row number a key, so a hot key costs a sort, not a task's memory.
    """
    judged = with_motives(df)
    url = F.lower(F.trim("url"))
    title = collapse(F.lower(F.trim("titulo")))
    clean = F.size("motivos") == 0
    # Records out of the contest are partitioned by their number: a common missing key gathers nothing.
    first_url = F.row_number().over(Window.partitionBy(F.when(clean, url), F.when(~clean, F.col(order))).orderBy(order)) == 1
    judged = judged.withColumn("_first_url", clean & first_url)
    competes = F.col("_first_url")
    first_title = F.row_number().over(Window.partitionBy(F.when(competes, title), F.when(~competes, F.col(order))).orderBy(order)) == 1
    judged = judged.withColumn("_first_title", F.col("_first_url") & first_title)
    extra = F.when(clean & ~F.col("_first_url"), F.array(F.concat(F.lit("Registro duplicado exacto (URL repetida): '"), url, F.lit("'")))).when(
        F.col("_first_url") & ~F.col("_first_title"), F.array(F.concat(F.lit("Registro duplicado por título normalizado: '"), title, F.lit("'")))
    )
    return judged.withColumn("motivos", F.coalesce(extra, F.col("motivos"))).drop("_first_url", "_first_title")


def report(judged: DataFrame) -> DataFrame:
    """One row of counts: total, valid, rejected, incomplete, repeated URLs and titles."""

    def any_starts(*prefixes: str):
        return F.count_if(F.exists("motivos", lambda m: F.greatest(*[F.startswith(m, F.lit(p)) for p in prefixes]) if len(prefixes) > 1 else F.startswith(m, F.lit(prefixes[0]))))

    return judged.agg(
        F.count("*").alias("total"),
        F.count_if(F.size("motivos") == 0).alias("validos"),
        F.count_if(F.size("motivos") > 0).alias("rechazados"),
        any_starts("Campo", "Longitud", "Formato").alias("incompletos"),
        any_starts("Registro duplicado exacto").alias("url_repetida"),
        any_starts("Registro duplicado por").alias("titulo_repetido"),
    )


def usable(judged: DataFrame) -> DataFrame:
    """The valid records with ``estado`` ``completo``; where no record is valid, all of them with ``parcial``."""
    valid = judged.where(F.size("motivos") == 0)
    return judged.withColumn("estado", F.lit("parcial")) if valid.isEmpty() else valid.withColumn("estado", F.lit("completo"))


def summary(reported: DataFrame) -> DataFrame:
    """(resumen): one sentence on a report of :func:`report`."""
    reasons = F.concat_ws(
        "; ",
        F.when(F.col("incompletos") > 0, F.concat(F.col("incompletos").cast("string"), F.lit(" incompletos o mal formados"))),
        F.when(F.col("url_repetida") > 0, F.concat(F.col("url_repetida").cast("string"), F.lit(" con URL repetida"))),
        F.when(F.col("titulo_repetido") > 0, F.concat(F.col("titulo_repetido").cast("string"), F.lit(" con título repetido"))),
    )
    kept = F.concat(F.lit("De "), F.col("total").cast("string"), F.lit(" registros quedan "), F.col("validos").cast("string"), F.lit(" válidos"))
    return reported.select(F.concat(kept, F.when(F.col("rechazados") > 0, F.concat(F.lit("; se descartan "), F.col("rechazados").cast("string"), F.lit(": "), reasons)).otherwise(""), F.lit(".")).alias("resumen"))


def first_by_key(df: DataFrame, key, order: str = "pos") -> DataFrame:
    """The first row of each key in ``order``; rows of an empty or null key all stay."""
    value = F.coalesce(key, F.lit(""))
    keyed = df.withColumn("_key", value)
    numbered = keyed.withColumn("_first", F.row_number().over(Window.partitionBy("_key", F.when(F.col("_key") == "", F.col(order))).orderBy(order)))
    return numbered.where("_key = '' OR _first = 1").drop("_key", "_first")
