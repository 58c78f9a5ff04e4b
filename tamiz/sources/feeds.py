"""RSS items, paged sources, unions of sources, and labelled data sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamiz.functions import lexicons
from tamiz.functions.text import collapse
from tamiz.operators.quality import first_by_key
from tamiz.session import broadcast_if_small


def read_rss(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Items of RSS files as strings, by the built-in XML reader."""
    schema = "title string, link string, description string, summary string, author string, pubDate string, category array<string>"
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def plain_text(column: Column) -> Column:
    """Text of an HTML fragment: tags as spaces, the five basic entities resolved, spaces collapsed."""
    out = F.regexp_replace(column, r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(mark))
    return collapse(out)


def _present(*columns: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


# Date patterns of feeds.
FEED_DATES = ["EEE, d MMM yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]


def rss_articles(items: DataFrame, feed_url: str, default_category: str = "general", today: Column | None = None) -> DataFrame:
    """Articles of RSS items: items without a title are left out, other parts fall back one after another."""
    body = plain_text(F.coalesce(_present(F.col("summary"), F.col("description"), F.col("title")), F.lit("")))
    stamp = F.regexp_replace(F.substring(F.col("pubDate"), 1, 25), r"^\w{3}, 0", "")
    dates = [F.try_to_timestamp(F.regexp_extract("pubDate", r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss")), *[F.try_to_timestamp(F.substring(stamp, 1, len(p.replace("'", ""))), F.lit(p)) for p in FEED_DATES[1:]]]
    link = F.coalesce(_present(F.col("link")), F.lit(feed_url))
    tag = F.lower(F.trim(F.try_element_at("category", F.lit(1))))
    return items.where(F.trim("title") != "").select(
        F.trim("title").alias("titulo"),
        body.alias("cuerpo"),
        F.date_format(F.coalesce(*dates, today if today is not None else F.current_timestamp()), "yyyy-MM-dd").alias("fecha"),
        F.coalesce(_present(F.col("author")), F.lit("Redacción")).alias("autor"),
        F.coalesce(F.when(tag != "", tag), url_section(link), F.lit(default_category)).alias("categoria_original"),
        link.alias("url"),
        F.lit(feed_url).alias("fuente"),
    )


def url_section(url: Column) -> Column:
    """Category of the first path segment that names a section, else null."""
    known = F.create_map(*[F.lit(x) for pair in lexicons.URL_SECTIONS for x in pair])
    segments = F.split(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/")
    return F.try_element_at(F.filter(F.transform(segments, lambda s: known[F.trim(s)]), lambda c: c.isNotNull()), F.lit(1))


def in_scope(url: Column, seed: str, mode: str) -> Column:
    """Whether a crawl from ``seed`` may follow ``url``: same ``dominio``, below its ``directorio``, or in a ``subdominio``."""
    from urllib.parse import urlparse

    parts = urlparse(seed)
    host = F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))
    if mode == "dominio":
        return host == parts.netloc
    if mode == "directorio":
        base = parts.path.rstrip("/")
        path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
        return (host == parts.netloc) & ((path == base) | F.startswith(path, F.lit(base + "/")))
    if mode == "subdominio":
        return (host == parts.netloc) | F.endswith(host, F.lit("." + parts.netloc))
    return F.lit(False)


def frontier(seed: str, links: DataFrame, mode: str = "dominio", budget: int = 50) -> DataFrame:
    """(url, nivel): URLs that a breadth-first crawl over links (origen, destino) reaches within its budget.

    One join a level; a level beyond the budget is cut in order of URL. The
    budget bounds what is kept, so the visited side of the join is broadcast.
    """
    spark = links.sparkSession
    reached = [(seed, 0)]
    known = {seed}
    current, level = [seed], 0
    allowed = links.where(in_scope(F.col("destino"), seed, mode)).select("origen", "destino").distinct()
    while current and len(known) < budget:
        level += 1
        now = spark.createDataFrame([(u,) for u in current], "origen string")
        step = allowed.join(F.broadcast(now), "origen").select("destino").distinct()
        visited = spark.createDataFrame([(u,) for u in known], "destino string")
        fresh = [r[0] for r in step.join(F.broadcast(visited), "destino", "left_anti").orderBy("destino").limit(budget - len(known)).collect()]
        known |= set(fresh)
        reached += [(u, level) for u in fresh]
        current = fresh
    return spark.createDataFrame(reached, "url string, nivel int")


def union_sources(sources: list[DataFrame], order: str = "pos") -> DataFrame:
    """All sources by column name, the first record of each URL (or title) kept; records with neither all stay."""
    joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    return first_by_key(joined, F.lower(F.trim(_present(F.col("url"), F.col("titulo")))), order)


def limited(df: DataFrame, source: str, order: str, limits: DataFrame, limit: str) -> DataFrame:
    """At most the stated number of records of each source, first ones first: the limit is the feature here."""
    numbered = df.withColumn("_r", F.row_number().over(Window.partitionBy(source).orderBy(order)))
    return numbered.join(broadcast_if_small(limits.select(source, limit)), source).where(F.col("_r") <= F.col(limit)).drop("_r", limit)


def normalised_articles(df: DataFrame, base: str = "urn:noticia:", order: str = "pos") -> DataFrame:
    """(pos, titulo, cuerpo, fecha, autor, categoria, url) with a default for every part that is missing or blank."""
    def part(default: str, *names: str) -> Column:
        have = [F.col(n) for n in names if n in df.columns]
        return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in have], F.lit(default)) if have else F.lit(default)

    return df.select(
        order,
        part("", "titulo").alias("titulo"),
        part("", "cuerpo", "resumen", "texto").alias("cuerpo"),
        F.substring(part("sin_fecha", "fecha"), 1, 10).alias("fecha"),
        part("Autor desconocido", "autor").alias("autor"),
        part("sin_categoria", "categoria", "categoria_original").alias("categoria"),
        F.coalesce(F.when(F.trim("url") != "", F.trim("url")), F.concat(F.lit(base), F.col(order).cast("string"))).alias("url"),
    )


def labelled_texts(df: DataFrame, labels: tuple[str, ...] = ("categoria_original", "categoria", "fuente")) -> DataFrame:
    """(texto, etiqueta) of the records that have both: title, summary and body; the first label of the chain."""
    parts = [F.when(F.trim(c) != "", F.trim(c)) for c in ("titulo", "resumen", "cuerpo") if c in df.columns]
    found = F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in labels if c in df.columns])
    return df.select(F.concat_ws(" ", *parts).alias("texto"), found.alias("etiqueta")).where("texto <> '' AND etiqueta IS NOT NULL AND etiqueta <> 'sin_categoria'")


def thread_messages(df: DataFrame) -> DataFrame:
    """(pos, usuario, texto, marca): messages under their several field names; blank texts left out."""
    def part(*names: str) -> Column:
        have = [F.when(F.trim(F.col(n).cast("string")) != "", F.col(n).cast("string")) for n in names if n in df.columns]
        return F.coalesce(*have) if have else F.lit(None).cast("string")

    out = df.select("pos", F.coalesce(part("usuario", "user", "author"), F.lit("@desconocido")).alias("usuario"), part("texto", "text", "contenido").alias("texto"), part("timestamp", "fecha", "date").alias("marca"))
    return out.where("texto IS NOT NULL")
