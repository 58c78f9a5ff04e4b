"""Pages, links, feeds, the catalogue of sources, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz import sinks
from tamiz.functions import lexicons
from tamiz.functions.text import collapse
from tamiz.functions.urls import host_of, source_host
from tamiz.operators import nlp
from tamiz.queries import text as text_queries
from tamiz.queries.base import HOST, SOURCE, documents, news
from tamiz.session import read_table
from tamiz.sources import catalogue, feeds, html, robots


def _escaped(column: Column) -> Column:
    return F.replace(F.replace(F.replace(column, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of markup for every article: navigation, the article in its parts, an aside and a footer."""
    def part(name: str) -> Column:
        return _escaped(F.coalesce(F.col(name), F.lit("")))

    page = F.concat(
        F.lit("<html><head><title>Portal</title></head><body><nav><a href='/'>Inicio</a><a href='/c'>Cultura</a></nav><main><article class='noticia' data-categoria='"), F.coalesce("categoria_original", F.lit("sin_categoria")),
        F.lit("'><h2>"), part("titulo"), F.lit("</h2><p class='cuerpo'>"), part("cuerpo"), F.lit("<p>Aparte</p><span class=fecha>"), part("fecha"), F.lit("</span><span class='x autor'>"), part("autor"),
        F.lit("</span><a class='leer-mas' href='/n/"), F.col("pos").cast("string"), F.lit("'>Leer</a></article></main><aside><ul><li><a>Uno</a><li><a>Dos</a></ul></aside><footer>Pie</footer></body></html>"),
    )
    return news(spark, sf_dir).select("pos", F.concat(F.lit("https://portal.example/p/"), F.col("pos").cast("string")).alias("pagina"), page.alias("html"))


def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract_articles(_pages(spark, sf_dir), "html", "pagina").where("error IS NULL")
    return found.select("pagina", "titulo", "fecha", "autor", "categoria_original", "url")


def html_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_articles(_pages(spark, sf_dir), "html", "pagina").where("error IS NOT NULL").groupBy("error").agg(F.count("*").alias("n"))


def dom_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = html.dom_profile(_pages(spark, sf_dir), "html", "pos")
    return profile.select("pos", "titulo", F.array_join("navegacion", ",").alias("navegacion"), "articulos", "articulos_main", F.array_join("tendencias", ",").alias("tendencias"), "pie")


def feed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of feed items made of the listings."""
    items = read_table(spark, sf_dir, "noticias_paginadas").select(
        F.col("titulo").alias("title"), F.col("url").alias("link"), F.concat(F.lit("<p>"), "resumen", F.lit("</p>")).alias("description"), F.lit(None).cast("string").alias("summary"),
        F.col("autor").alias("author"), F.date_format("fecha_extraccion", "EEE, dd MMM yyyy HH:mm:ss").alias("pubDate"), F.when(F.col("categoria") != "", F.array("categoria")).alias("category"),
    )
    out = feeds.rss_articles(items, "https://feed.example/rss", today=F.lit("2000-01-01").cast("timestamp"))
    return out.select("titulo", "fecha", "autor", "categoria_original", "url")


def url_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = "https://lavozdepuertonevzalira.example/cultura/"
    url = F.col("url")
    return news(spark, sf_dir).select("pos", *(feeds.in_scope(url, seed, m).alias(m) for m in ("dominio", "directorio", "subdominio")))


def url_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news(spark, sf_dir).select("pos", F.coalesce(feeds.url_section(F.col("url")), F.lit("")).alias("categoria"))


def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news(spark, sf_dir).select("pos", host_of(F.col("url")).alias("host"), source_host(F.col("fuente"), F.col("url")).alias("origen"))


PAGE_ITEMS = 8


def _listings(spark: SparkSession, sf_dir: str, as_links: bool = False) -> DataFrame:
    """Listing pages of ``PAGE_ITEMS`` records each, the next one linked; ``as_links`` has bare links in place of items. Every seventh record lacks its title."""
    def part(name: str) -> Column:
        return _escaped(F.coalesce(F.col(name), F.lit("")))

    rows = read_table(spark, sf_dir, "noticias_paginadas").withColumn("n", F.floor((F.col("fila") - 1) / PAGE_ITEMS))
    title = F.when(F.col("fila") % 7 == 0, F.lit(" ")).otherwise(part("titulo"))
    link = F.concat(F.lit("<a href='"), part("url"), F.lit("'>"), title, F.lit("</a>"))
    entry = F.concat(F.lit("<div class='nota'><h2>"), title, F.lit("</h2><p>"), part("resumen"), link, F.lit("</div>"))
    pages = rows.groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fila", (link if as_links else entry).alias("x")))), lambda r: r["x"]), "\n").alias("body"))
    site = F.lit("https://lavozdepuertonevzalira.example/lista/")
    onward = F.concat(F.lit("<a rel='next' href='/lista/"), (F.col("n") + 1).cast("string"), F.lit("'>Siguiente</a>"))
    return pages.select("n", F.concat(site, F.col("n").cast("string")).alias("url"), F.concat(F.lit("<html><body>"), "body", onward, F.lit("</body></html>")).alias("html"))


def listing_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of all listing pages, each URL where it is listed first."""
    pages = _listings(spark, sf_dir)
    return html.first_listed(html.listing_table(pages, ".nota"), pages, "n").select("pagina", "titulo", "url")


def listing_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.listing_diagnostics(_listings(spark, sf_dir), ".nota")


def listing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages without items give: their links of twenty characters or more that stay on the site."""
    return html.listing_table(_listings(spark, sf_dir, True), ".nota").select("pagina", "titulo", "url")


def listing_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty articles along the links to the next page: the limit is the crawl's feature."""
    found = html.crawl_listing(_listings(spark, sf_dir), "https://lavozdepuertonevzalira.example/lista/0", ".nota", 5, 20)
    return found.select("pos", F.col("pagina_origen").alias("pagina"), "titulo", "url")


def listing_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a crawl gave enough: complete from twenty articles on."""
    found = listing_crawl(spark, sf_dir).agg(F.count("*").alias("articulos"), F.countDistinct("pagina").alias("paginas"))
    return found.withColumn("estado", F.when(F.col("articulos") >= 20, "completo").otherwise("parcial"))


def robots_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs that robots files allow: every second host keeps its culture pages closed, the last host has no file."""
    hosts = read_table(spark, sf_dir, "fuentes").select(host_of(F.col("base_url")).alias("host"), F.when(F.col("pais") == "México", "User-agent: *\nDisallow: /cultura").when(F.col("pais") != "Chile", "User-agent: *\nAllow: /").alias("texto"))
    return robots.with_permission(news(spark, sf_dir).select("pos", "url"), hosts).select("pos", "permitida")


def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs reached from a listing page: a crawl's budget is its feature."""
    pages = read_table(spark, sf_dir, "noticias_paginadas").where("pagina_origen IS NOT NULL AND url IS NOT NULL")
    links = pages.select(F.col("pagina_origen").alias("origen"), F.col("url").alias("destino"))
    seed = links.agg(F.min("origen")).first()[0] or "https://vacio.example"
    return feeds.frontier(seed, links, "dominio", 50)


def catalogue_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = catalogue.validation_errors(read_table(spark, sf_dir, "fuentes").withColumn("limite_noticias", F.when(F.col("pais") != "Chile", F.col("limite_noticias"))))
    return checked.select("id", F.array_join("errores", "; ").alias("errores"))


def catalogue_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = spark.createDataFrame([("La Voz de Puerto Nevzalira", "https://otra.example"), ("Nueva", "https://nueva.example"), ("Nueva", "https://nueva.example/x"), ("Gaceta", "https://www.lavozdepuertonevzalira.example")], "nombre string, base_url string")
    return catalogue.with_custom(read_table(spark, sf_dir, "fuentes"), fresh).select("id", "nombre", "base_url")


def csv_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.flattened(read_table(spark, sf_dir, "fuentes").select("id", "urls", "dominios_permitidos", "limite_noticias", "notas"))


def corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.corpus_rows(nlp.process(documents(spark, sf_dir), "cuerpo")).select("doc_id", "tokens", "terminos")


def normalised_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "noticias_paginadas").withColumn("pos", F.col("fila"))
    return feeds.normalised_articles(rows)


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.labelled_texts(news(spark, sf_dir)).groupBy("etiqueta").agg(F.count("*").alias("textos"), F.sum(F.length("texto")).alias("caracteres"))


def thread_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = news(spark, sf_dir).select("pos", F.nullif(F.trim("autor"), F.lit("")).alias("author"), F.col("titulo").alias("text"), F.col("fecha").alias("date"))
    return feeds.thread_messages(rows).select("pos", "usuario", "texto")


def collapsed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news(spark, sf_dir).select("pos", F.coalesce(collapse(F.col("titulo")), F.lit("")).alias("titulo"))


def answer_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each item of a questionnaire held as a map of answers."""
    events = read_table(spark, sf_dir, "events")
    answers = events.select("user_id", F.create_map("event_type", "value").alias("respuestas"))
    return answers.select(F.explode("respuestas").alias("item", "valor")).groupBy("item").agg(F.round(F.avg("valor"), 2).alias("media"), F.count("*").alias("n"))


def last_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each stage and how many it had."""
    events = read_table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("etapa")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("ultimo"), F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        html_extract, html_errors, dom_profile, feed_articles, url_scope, url_section, url_hosts, robots_gate, listing_articles, listing_diagnostics, listing_links, listing_crawl, listing_evidence, crawl_frontier, catalogue_validation, catalogue_custom,
        csv_flatten, corpus_rows, normalised_articles, labelled_texts, thread_messages, collapsed_titles, answer_averages, last_stage,
    )
}

_C = r"trim(regexp_replace({0}, '[\s\p{{Z}}]+', ' ', 'g'))"
_OK = f"{_C.format('titulo')} <> '' AND {_C.format('cuerpo')} <> '' AND {_C.format('fecha')} <> '' AND {_C.format('autor')} <> ''"
_PATH = "regexp_extract(url, '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_LOW_PATH = _PATH.replace("(url", "(lower(url)")
_SECTION_MAP = ", ".join(f"'{k}': '{c}'" for k, c in lexicons.URL_SECTIONS)
_AUTH = "coalesce(regexp_extract(url, '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '')"

_LIST = "https://lavozdepuertonevzalira.example/lista/"
_LISTED = f"""li AS (SELECT fila, CAST(floor((fila - 1) / {PAGE_ITEMS}) AS BIGINT) AS n, '{_LIST}' || CAST(floor((fila - 1) / {PAGE_ITEMS}) AS BIGINT) AS pagina, CASE WHEN fila % 7 = 0 THEN '' ELSE coalesce({_C.format('titulo')}, '') END AS t, url FROM noticias_paginadas)"""
_CRAWLED = f"""{_LISTED}, f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fila) AS r FROM li WHERE t <> '' AND n < 5), c AS (SELECT row_number() OVER (ORDER BY fila) - 1 AS pos, pagina, t AS titulo, url FROM f WHERE r = 1 QUALIFY row_number() OVER (ORDER BY fila) <= 20)"""

ORACLES = {
    "html_extract": f"""SELECT 'https://portal.example/p/' || pos AS pagina, {_C.format('titulo')} AS titulo, {_C.format('fecha')} AS fecha, {_C.format('autor')} AS autor, coalesce(categoria_original, 'sin_categoria') AS categoria_original,
        'https://portal.example/n/' || pos AS url FROM noticias WHERE {_OK}""",
    "html_errors": f"""WITH e AS (SELECT CASE WHEN coalesce({_C.format('titulo')}, '') = '' THEN 'titulo' WHEN coalesce({_C.format('cuerpo')}, '') = '' THEN 'cuerpo' WHEN coalesce({_C.format('fecha')}, '') = '' THEN 'fecha' WHEN coalesce({_C.format('autor')}, '') = '' THEN 'autor' END AS f FROM noticias)
        SELECT 'Artículo 1: falta ' || f AS error, count(*) AS n FROM e WHERE f IS NOT NULL GROUP BY 1""",
    "dom_profile": "SELECT pos, 'Portal' AS titulo, 'Inicio,Cultura' AS navegacion, 1 AS articulos, 1 AS articulos_main, 'Uno,Dos' AS tendencias, 'Pie' AS pie FROM noticias",
    "feed_articles": f"""WITH m AS (SELECT MAP {{{_SECTION_MAP}}} AS m) SELECT trim(titulo) AS titulo, strftime(fecha_extraccion, '%Y-%m-%d') AS fecha, coalesce(CASE WHEN trim(autor) <> '' THEN autor END, 'Redacción') AS autor,
        coalesce(nullif(lower(trim(categoria)), ''), list_filter(list_transform(string_split({_LOW_PATH}, '/'), lambda x: m[trim(x)]), lambda c: c IS NOT NULL)[1], 'general') AS categoria_original,
        coalesce(CASE WHEN trim(url) <> '' THEN url END, 'https://feed.example/rss') AS url FROM noticias_paginadas, m WHERE trim(titulo) <> ''""",
    "url_scope": f"""SELECT pos, {_AUTH} = 'lavozdepuertonevzalira.example' AS dominio, {_AUTH} = 'lavozdepuertonevzalira.example' AND ({_PATH} = '/cultura' OR starts_with({_PATH}, '/cultura/')) AS directorio,
        {_AUTH} = 'lavozdepuertonevzalira.example' OR ends_with({_AUTH}, '.lavozdepuertonevzalira.example') AS subdominio FROM noticias""",
    "url_section": f"""WITH s AS (SELECT pos, string_split({_LOW_PATH}, '/') AS seg FROM noticias), m AS (SELECT MAP {{{_SECTION_MAP}}} AS m)
        SELECT pos, coalesce(list_filter(list_transform(seg, lambda x: m[trim(x)]), lambda c: c IS NOT NULL)[1], '') AS categoria FROM s, m""",
    "url_hosts": f"SELECT pos, nullif({HOST.format('url')}, '') AS host, {SOURCE} AS origen FROM noticias",
    "listing_articles": f"WITH {_LISTED}, f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fila) AS r FROM li WHERE t <> '') SELECT pagina, t AS titulo, url FROM f WHERE r = 1",
    "listing_diagnostics": f"""WITH {_LISTED} SELECT pagina, CAST(count(*) AS INTEGER) AS elementos, CAST(count(*) FILTER (t = '') AS INTEGER) AS sin_titulo, CAST(count(*) FILTER (t <> '') - count(DISTINCT url) FILTER (t <> '') AS INTEGER) AS repetidos,
        CAST(count(DISTINCT url) FILTER (t <> '') AS INTEGER) AS articulos, '{_LIST}' || (n + 1) AS siguiente FROM li GROUP BY pagina, n""",
    "listing_links": f"""WITH {_LISTED}, s AS (SELECT *, {HOST.format('url')} AS h FROM li WHERE length(t) >= 20), k AS (SELECT *, row_number() OVER (PARTITION BY pagina, url ORDER BY fila) AS r FROM s WHERE h = 'lavozdepuertonevzalira.example' OR ends_with(h, '.lavozdepuertonevzalira.example'))
        SELECT pagina, t AS titulo, url FROM k WHERE r = 1""",
    "listing_crawl": f"""WITH {_CRAWLED} SELECT pos, pagina, titulo, url FROM c""",
    "listing_evidence": f"""WITH {_CRAWLED} SELECT count(*) AS articulos, count(DISTINCT pagina) AS paginas, CASE WHEN count(*) >= 20 THEN 'completo' ELSE 'parcial' END AS estado FROM c""",
    "robots_gate": f"""WITH h AS (SELECT {SOURCE.replace('fuente', 'base_url')} AS host, pais FROM (SELECT base_url, base_url AS url, pais FROM fuentes)), n AS (SELECT pos, {HOST.format('url')} AS host, {_PATH} AS ruta FROM noticias)
        SELECT pos, coalesce(CASE WHEN pais = 'México' THEN NOT starts_with(ruta, '/cultura') WHEN pais <> 'Chile' THEN true ELSE false END, false) AS permitida FROM n LEFT JOIN h USING (host)""",
    "crawl_frontier": f"""WITH seed AS (SELECT coalesce(min(pagina_origen), 'https://vacio.example') AS s FROM noticias_paginadas WHERE url IS NOT NULL),
        l AS (SELECT DISTINCT url FROM noticias_paginadas, seed WHERE pagina_origen = s AND url <> s AND regexp_extract(url, '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1) = regexp_extract(s, '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1))
        SELECT s AS url, 0 AS nivel FROM seed UNION ALL SELECT url, 1 FROM (SELECT url FROM l ORDER BY url LIMIT 49)""",
    "catalogue_custom": """WITH k AS (SELECT 'la_voz_de_puerto_nevzalira' AS s, 'La Voz de Puerto Nevzalira' AS nombre, 'https://otra.example' AS base_url UNION ALL SELECT 'nueva', 'Nueva', 'https://nueva.example'),
        n AS (SELECT s, 1 + (SELECT count(*) FROM fuentes WHERE regexp_replace(id, '_[0-9]+$', '') = s) AS c, nombre, base_url FROM k)
        SELECT id, nombre, base_url FROM fuentes UNION ALL SELECT CASE WHEN c > 1 THEN s || '_' || c ELSE s END, nombre, base_url FROM n""",
    "catalogue_validation": """WITH f AS (SELECT *, CASE WHEN pais <> 'Chile' THEN limite_noticias END AS lim FROM fuentes)
        SELECT id, array_to_string(list_filter([CASE WHEN coalesce(tipo, '') NOT IN ('rss', 'html') THEN 'tipo debe ser ''rss'' o ''html''' END, CASE WHEN coalesce(len(urls), 0) = 0 THEN 'urls debe ser una lista no vacia' WHEN len(list_filter(urls, lambda u: NOT regexp_matches(u, '^https?://'))) > 0 THEN 'todas las urls deben ser http(s)' END,
        CASE WHEN coalesce(len(dominios_permitidos), 0) = 0 THEN 'dominios_permitidos debe ser una lista no vacia' END, CASE WHEN coalesce(lim, 0) <= 0 THEN 'limite_noticias debe ser un entero positivo' END, CASE WHEN coalesce(delay_segundos, -1) < 0 THEN 'delay_segundos debe ser numerico y no negativo' END], lambda e: e IS NOT NULL), '; ') AS errores FROM f""",
    "csv_flatten": """SELECT id, CAST(to_json(urls) AS VARCHAR) AS urls, CAST(to_json(dominios_permitidos) AS VARCHAR) AS dominios_permitidos, coalesce(CAST(limite_noticias AS VARCHAR), '') AS limite_noticias, coalesce(notas, '') AS notas FROM fuentes""",
    "corpus_rows": f"WITH {text_queries._PROCESSED} SELECT doc_id, array_to_string(tokens[1:50], ' ') AS tokens, array_to_string(terminos[1:30], ' | ') AS terminos FROM pro",
    "normalised_articles": """SELECT fila AS pos, coalesce(nullif(trim(titulo), ''), '') AS titulo, coalesce(nullif(trim(resumen), ''), '') AS cuerpo, left(coalesce(nullif(trim(fecha), ''), 'sin_fecha'), 10) AS fecha, coalesce(nullif(trim(autor), ''), 'Autor desconocido') AS autor,
        coalesce(nullif(trim(categoria), ''), 'sin_categoria') AS categoria, coalesce(nullif(trim(url), ''), 'urn:noticia:' || fila) AS url FROM noticias_paginadas""",
    "labelled_texts": """WITH t AS (SELECT concat_ws(' ', nullif(trim(titulo), ''), nullif(trim(cuerpo), '')) AS texto, coalesce(nullif(trim(categoria_original), ''), nullif(trim(fuente), '')) AS etiqueta FROM noticias)
        SELECT etiqueta, count(*) AS textos, sum(length(texto)) AS caracteres FROM t WHERE texto <> '' AND etiqueta IS NOT NULL AND etiqueta <> 'sin_categoria' GROUP BY 1""",
    "thread_messages": "SELECT pos, coalesce(nullif(trim(autor), ''), '@desconocido') AS usuario, titulo AS texto FROM noticias WHERE trim(titulo) <> ''",
    "collapsed_titles": f"SELECT pos, coalesce({_C.format('titulo')}, '') AS titulo FROM noticias",
    "answer_averages": "SELECT event_type AS item, round(avg(value), 2) AS media, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1",
    "last_stage": "SELECT event_type AS etapa, arg_max(event_id, (ts, event_id)) AS ultimo, count(*) AS n FROM events GROUP BY 1",
}
