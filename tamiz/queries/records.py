"""Quality, trends, sentiment, threads and alerts over article records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions import lexicons
from tamiz.functions.text import fold
from tamiz.functions.urls import source_host
from tamiz.operators import alerts, quality, sentiment, threads, trends
from tamiz.queries.base import SOURCE, news, sql_list
from tamiz.session import read_table
from tamiz.sources import feeds

SAVED = [("economia", '"salario mínimo"'), ("salud", "vacuna hospital"), ("clima", 'río "calidad del aire"'), ("justicia", "fraude"), ("todo", '"medida alcanza" vecinos')]


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news(spark, sf_dir).select("pos", *quality.REQUIRED)


def quality_motives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.with_motives(_columns(spark, sf_dir)).select("pos", F.array_join("motivos", "; ").alias("motivos"))


def quality_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validated(_columns(spark, sf_dir)).select("pos", F.array_join("motivos", "; ").alias("motivos"))


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(quality.validated(_columns(spark, sf_dir)))


def quality_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that later stages work on."""
    return quality.usable(quality.validated(_columns(spark, sf_dir))).select("pos", "estado")


def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.summary(quality.report(quality.validated(_columns(spark, sf_dir))))


def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables of articles as one, the first record of each URL kept."""
    pages = read_table(spark, sf_dir, "noticias_paginadas").select((F.col("fila") + 1_000_000_000).alias("pos"), "titulo", "url", "resumen")
    union = feeds.union_sources([news(spark, sf_dir).select("pos", "titulo", "url"), pages])
    return union.select("pos", "titulo", "url")


def source_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first records of each source, as many as its entry in the catalogue allows: the limit is the feature."""
    from tamiz.functions.urls import host_of

    limits = read_table(spark, sf_dir, "fuentes").where("activo").select(host_of(F.col("base_url")).alias("host"), "limite_noticias")
    rows = news(spark, sf_dir).select("pos", source_host(F.col("fuente"), F.col("url")).alias("host"))
    return feeds.limited(rows, "host", "pos", limits, "limite_noticias").select("pos", "host")


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = news(spark, sf_dir).select("pos", "titulo", "cuerpo", F.coalesce(F.nullif("categoria_original", F.lit("")), F.lit("desconocido")).alias("categoria"), trends.valid_date(F.col("fecha")).alias("dia"))
    rows = rows.where("dia IS NOT NULL")
    return rows.withColumn("mes", trends.month(F.col("dia"))).withColumn("semana", trends.iso_week(F.col("dia")))


def trend_counts_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.period_counts(_dated(spark, sf_dir), "categoria", "mes")


def trend_counts_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.period_counts(_dated(spark, sf_dir), "categoria", "semana")


def trend_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.peak(_dated(spark, sf_dir), "categoria", "mes")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", F.coalesce("titulo", F.lit("")), F.coalesce("cuerpo", F.lit("")))
    return trends.term_changes(_dated(spark, sf_dir), "categoria", "mes", text, 5)


def trend_term_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)


def trend_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.flat_table(trend_counts_month(spark, sf_dir), _changes(spark, sf_dir))


def trend_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the months of the corpus show, in one row."""
    return trends.findings(_dated(spark, sf_dir), _changes(spark, sf_dir), "categoria", "mes")


def trend_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.bars(trend_counts_month(spark, sf_dir))


def event_counts_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").withColumn("dia", F.to_date("ts"))
    return trends.period_counts(events.withColumn("semana", trends.iso_week(F.col("dia"))), "event_type", "semana")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", F.coalesce("cuerpo", F.lit("")), F.coalesce("titulo", F.lit("")))
    out = news(spark, sf_dir).select("pos", F.coalesce(F.nullif("categoria_original", F.lit("")), F.lit("desconocido")).alias("categoria"), sentiment.lexicon_score(text).alias("compound"))
    return out.withColumn("etiqueta", sentiment.label(F.col("compound")))


def sentiment_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("pos", F.round("compound", 6).alias("compound"), "etiqueta")


def sentiment_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.corpus_tone(_scored(spark, sf_dir)).withColumn("promedio", F.round("promedio", 6))


def sentiment_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy("categoria").agg(F.round(F.avg("compound"), 6).alias("promedio"), F.count("*").alias("total"))


def _thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = news(spark, sf_dir).select("pos", source_host(F.col("fuente"), F.col("url")).alias("hilo"), F.coalesce(F.nullif(F.trim("autor"), F.lit("")), F.lit("@desconocido")).alias("usuario"), F.concat_ws(" ", "titulo", "cuerpo", F.concat(F.lit("#"), "categoria_original")).alias("texto"))
    return threads.scored(rows)


def thread_moving_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.moving_average(_thread(spark, sf_dir), "hilo", "pos").select("hilo", "pos", "score", "media_movil")


def thread_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.summary(_thread(spark, sf_dir), "hilo")


def hashtag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.hashtag_counts(_thread(spark, sf_dir))


def active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.active_users(_thread(spark, sf_dir), "usuario", 10)


def window_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = news(spark, sf_dir).select("pos", source_host(F.col("fuente"), F.col("url")).alias("hilo"), fold(F.coalesce("titulo", F.lit(""))).alias("texto"))
    return threads.window_topics(rows, "hilo", "pos").select("hilo", "pos", "tema", F.round("confianza", 6).alias("confianza"))


def _saved(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAVED, "nombre string, expresion string")


def alerts_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alerts(news(spark, sf_dir), _saved(spark)).select("consulta", "noticia_id", "titulo")


def alerts_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of all articles after those of the first half were sent."""
    rows = news(spark, sf_dir)
    sent = alerts.alerts(rows.where("pos % 2 = 0"), _saved(spark))
    return alerts.alerts(rows, _saved(spark), sent).select("consulta", "noticia_id")


def alert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alerts(news(spark, sf_dir), _saved(spark)).groupBy("consulta").agg(F.count("*").alias("n"))


def category_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    counted = news(spark, sf_dir).groupBy(F.coalesce("categoria_original", F.lit("general")).alias("categoria")).agg(F.count("*").alias("n"))
    return counted.withColumn("porcentaje", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news(spark, sf_dir).agg(F.count("*").alias("total"), F.countDistinct("categoria_original").alias("categorias"), F.countDistinct("autor").alias("autores"), F.min("fecha").alias("primera"), F.max("fecha").alias("ultima"))


def url_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles beside the last listing of their URL."""
    last = read_table(spark, sf_dir, "noticias_paginadas").groupBy("url").agg(F.max_by("titulo", "fila").alias("titulo_listado"), F.max("fila").alias("fila"))
    return news(spark, sf_dir).select("pos", "url").join(last, "url", "left").select("pos", F.coalesce("fila", F.lit(-1)).alias("fila"), F.coalesce("titulo_listado", F.lit("")).alias("titulo_listado"))


def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the given category is one of the labels set by hand."""
    labels = read_table(spark, sf_dir, "etiquetas").groupBy("pos").agg(F.collect_set("materia").alias("m"))
    joined = news(spark, sf_dir).select("pos", "categoria_original").join(labels, "pos")
    return joined.agg(F.count("*").alias("etiquetados"), F.count_if(F.array_contains("m", F.col("categoria_original"))).alias("coinciden"))


QUERIES = {
    f.__name__: f
    for f in (
        quality_motives, quality_validated, quality_report, quality_stage, quality_summary, trend_findings, source_union, source_limits, trend_counts_month, trend_counts_week, trend_peak, trend_term_changes, trend_table, trend_bars, event_counts_month,
        sentiment_documents, sentiment_corpus, sentiment_by_category, thread_moving_avg, thread_summary, hashtag_counts, active_users, window_topics,
        alerts_match, alerts_replayed, alert_counts, category_share, extraction_summary, url_join, label_agreement,
    )
}

_T = "coalesce(trim({0}), 'None')"
_MISSING = ", ".join(f"CASE WHEN coalesce(trim({c}), '') = '' THEN 'Campo obligatorio ausente o vacío: ''{c}''' END" for c in quality.REQUIRED)
_CHECKS = f"""CASE WHEN {_T.format('titulo')} <> '' AND length({_T.format('titulo')}) < 5 THEN 'Longitud del título insuficiente: ' || length({_T.format('titulo')}) || ' < 5' END,
    CASE WHEN {_T.format('cuerpo')} <> '' AND length({_T.format('cuerpo')}) < 50 THEN 'Longitud del cuerpo insuficiente: ' || length({_T.format('cuerpo')}) || ' < 50' END,
    CASE WHEN {_T.format('fecha')} <> '' AND NOT regexp_full_match({_T.format('fecha')}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'Formato de fecha inválido: ''' || {_T.format('fecha')} || ''' (se esperaba YYYY-MM-DD)' END,
    """ + ", ".join(f"CASE WHEN {_T.format(c)} <> '' AND NOT regexp_matches({_T.format(c)}, '(?i)^https?://') THEN 'URL inválida en campo ''{c}'': ''' || {_T.format(c)} || '''' END" for c in ("url", "fuente"))  # fmt: skip
_MOTIVES = f"mot AS (SELECT pos, titulo, url, list_filter([{_MISSING}, {_CHECKS}], lambda m: m IS NOT NULL) AS motivos FROM noticias)"
_VALIDATED = f"""{_MOTIVES},
    u AS (SELECT *, len(motivos) = 0 AS ok, lower(trim(url)) AS un, trim(regexp_replace(lower(trim(titulo)), '[\\s\\p{{Z}}]+', ' ', 'g')) AS tn FROM mot),
    a AS (SELECT *, ok AND row_number() OVER (PARTITION BY ok, un ORDER BY pos) = 1 AS fu FROM u),
    b AS (SELECT *, fu AND row_number() OVER (PARTITION BY fu, tn ORDER BY pos) = 1 AS ft FROM a),
    val AS (SELECT pos, CASE WHEN ok AND NOT fu THEN ['Registro duplicado exacto (URL repetida): ''' || un || ''''] WHEN fu AND NOT ft THEN ['Registro duplicado por título normalizado: ''' || tn || ''''] ELSE motivos END AS motivos FROM b)"""
_DATED = """dat AS (SELECT pos, titulo, cuerpo, coalesce(nullif(categoria_original, ''), 'desconocido') AS categoria, try_strptime(trim(fecha), '%Y-%m-%d') AS dia FROM noticias),
    fec AS (SELECT *, strftime(dia, '%Y-%m') AS mes, strftime(dia, '%G-W%V') AS semana FROM dat WHERE dia IS NOT NULL)"""
_CHANGES = rf"""lim AS (SELECT categoria, min(mes) AS primero, max(mes) AS ultimo FROM fec GROUP BY categoria HAVING min(mes) < max(mes)),
    wd AS (SELECT categoria, primero, ultimo, CASE WHEN mes = ultimo THEN 1 ELSE -1 END AS d, unnest(regexp_extract_all(strip_accents(lower(coalesce(titulo, '') || ' ' || coalesce(cuerpo, ''))), '[\p{{L}}\p{{N}}_]+')) AS termino
           FROM fec JOIN lim USING (categoria) WHERE mes IN (primero, ultimo)),
    chg AS (SELECT categoria, primero, ultimo, termino, sum(d) AS cambio FROM wd WHERE regexp_full_match(termino, '[a-z]{{4,}}') AND NOT list_contains({sql_list(lexicons.TREND_STOPWORDS)}, termino) GROUP BY ALL HAVING sum(d) <> 0),
    rnk AS (SELECT *, CASE WHEN cambio > 0 THEN 'aumenta' ELSE 'disminuye' END AS sentido FROM chg),
    top AS (SELECT *, row_number() OVER (PARTITION BY categoria, sentido ORDER BY abs(cambio) DESC, termino) AS rango FROM rnk QUALIFY rango <= 5)"""
_LEX = rf"""lex AS (SELECT pos, coalesce(nullif(categoria_original, ''), 'desconocido') AS categoria, list_distinct(regexp_extract_all(lower(coalesce(cuerpo, '') || ' ' || coalesce(titulo, '')), '[\p{{L}}\p{{N}}_]+')) AS w FROM noticias),
    gb AS (SELECT pos, categoria, len(list_intersect(w, {sql_list(lexicons.POSITIVE)})) AS g, len(list_intersect(w, {sql_list(lexicons.NEGATIVE)})) AS b FROM lex),
    sc AS (SELECT pos, categoria, CASE WHEN g + b > 0 THEN (g - b) / (g + b) ELSE 0.0 END AS compound FROM gb),
    sen AS (SELECT *, CASE WHEN compound >= 0.05 THEN 'positivo' WHEN compound <= -0.05 THEN 'negativo' ELSE 'neutral' END AS etiqueta FROM sc)"""
_THREAD = rf"""msg AS (SELECT pos, {SOURCE} AS hilo, coalesce(nullif(trim(autor), ''), '@desconocido') AS usuario, concat_ws(' ', titulo, cuerpo, '#' || categoria_original) AS texto FROM noticias),
    cnt AS (SELECT *, list_filter(regexp_extract_all(lower(texto), '[\p{{L}}\p{{N}}_]+'), lambda t: list_contains({sql_list(lexicons.THREAD_POSITIVE)}, t)) AS g,
            list_filter(regexp_extract_all(lower(texto), '[\p{{L}}\p{{N}}_]+'), lambda t: list_contains({sql_list(lexicons.THREAD_NEGATIVE)}, t)) AS b FROM msg),
    thr AS (SELECT pos, hilo, usuario, texto, CASE WHEN len(g) + len(b) > 0 THEN round((len(g) - len(b)) / (len(g) + len(b)), 4) ELSE 0.0 END AS score FROM cnt),
    ton AS (SELECT *, CASE WHEN score > 0.05 THEN 'positivo' WHEN score < -0.05 THEN 'negativo' ELSE 'neutral' END AS tono FROM thr)"""
_PIECES = {"economia": ["salario mínimo"], "salud": ["vacuna", "hospital"], "clima": ["río", "calidad del aire"], "justicia": ["fraude"], "todo": ["medida alcanza", "vecinos"]}
_QUERIES_SQL = ", ".join(f"('{name}', {sql_list(pieces)})" for name, pieces in _PIECES.items())
_ALERTS = f"""sq AS (SELECT * FROM (VALUES {_QUERIES_SQL}) AS v(consulta, ps)),
    art AS (SELECT pos, lower(trim(coalesce(CASE WHEN trim(url) <> '' THEN url END, titulo))) AS noticia_id, titulo, lower(coalesce(titulo, '') || ' ' || coalesce(cuerpo, '')) AS t FROM noticias),
    al AS (SELECT consulta, noticia_id, titulo, pos FROM art JOIN sq ON len(list_filter(ps, lambda p: contains(t, p))) = len(ps))"""

ORACLES = {
    "quality_motives": f"WITH {_MOTIVES} SELECT pos, array_to_string(motivos, '; ') AS motivos FROM mot",
    "quality_validated": f"WITH {_VALIDATED} SELECT pos, array_to_string(motivos, '; ') AS motivos FROM val",
    "quality_report": f"""WITH {_VALIDATED} SELECT count(*) AS total, count(*) FILTER (len(motivos) = 0) AS validos, count(*) FILTER (len(motivos) > 0) AS rechazados,
        count(*) FILTER (len(list_filter(motivos, lambda m: m LIKE 'Campo%' OR m LIKE 'Longitud%' OR m LIKE 'Formato%')) > 0) AS incompletos,
        count(*) FILTER (len(list_filter(motivos, lambda m: m LIKE 'Registro duplicado exacto%')) > 0) AS url_repetida,
        count(*) FILTER (len(list_filter(motivos, lambda m: m LIKE 'Registro duplicado por%')) > 0) AS titulo_repetido FROM val""",
    "quality_stage": f"WITH {_VALIDATED}, whole AS (SELECT count(*) FILTER (len(motivos) = 0) AS v FROM val) SELECT pos, CASE WHEN v > 0 THEN 'completo' ELSE 'parcial' END AS estado FROM val, whole WHERE v = 0 OR len(motivos) = 0",
    "quality_summary": f"""WITH {_VALIDATED}, r AS (SELECT count(*) AS total, count(*) FILTER (len(motivos) = 0) AS validos, count(*) FILTER (len(motivos) > 0) AS rechazados,
        count(*) FILTER (len(list_filter(motivos, lambda m: m LIKE 'Campo%' OR m LIKE 'Longitud%' OR m LIKE 'Formato%')) > 0) AS incompletos,
        count(*) FILTER (len(list_filter(motivos, lambda m: m LIKE 'Registro duplicado exacto%')) > 0) AS u, count(*) FILTER (len(list_filter(motivos, lambda m: m LIKE 'Registro duplicado por%')) > 0) AS t FROM val)
        SELECT 'De ' || total || ' registros quedan ' || validos || ' válidos' || CASE WHEN rechazados > 0 THEN '; se descartan ' || rechazados || ': ' || concat_ws('; ', CASE WHEN incompletos > 0 THEN incompletos || ' incompletos o mal formados' END,
            CASE WHEN u > 0 THEN u || ' con URL repetida' END, CASE WHEN t > 0 THEN t || ' con título repetido' END) ELSE '' END || '.' AS resumen FROM r""",
    "trend_findings": f"""WITH {_DATED}, {_CHANGES}, c AS (SELECT categoria, mes AS periodo, count(*) AS n FROM fec GROUP BY 1, 2), f AS (SELECT categoria, min(pos) AS p FROM fec GROUP BY 1),
        pk AS (SELECT categoria AS pico_categoria, periodo AS pico_periodo, n AS pico_n FROM c JOIN f USING (categoria) ORDER BY n DESC, p, periodo LIMIT 1), w AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS registros, count(DISTINCT categoria) AS categorias, count(DISTINCT periodo) AS periodos, min(periodo) AS primero, max(periodo) AS ultimo FROM c),
        t AS (SELECT count(*) FILTER (length(titulo) > 0) AS pico_titulos FROM fec JOIN pk ON categoria = pico_categoria AND mes = pico_periodo), g AS (SELECT count(DISTINCT categoria) AS con_cambios FROM top)
        SELECT w.*, pk.*, pico_titulos, con_cambios, CASE WHEN categorias >= 3 AND pico_titulos > 0 THEN 'completo' ELSE 'parcial' END AS estado FROM w LEFT JOIN pk ON true, t, g""",
    "source_union": """WITH a AS (SELECT pos, titulo, url FROM noticias UNION ALL SELECT fila + 1000000000, titulo, url FROM noticias_paginadas),
        k AS (SELECT *, coalesce(lower(trim(coalesce(CASE WHEN trim(url) <> '' THEN url END, CASE WHEN trim(titulo) <> '' THEN titulo END))), '') AS k FROM a)
        SELECT pos, titulo, url FROM k QUALIFY k = '' OR row_number() OVER (PARTITION BY k ORDER BY pos) = 1""",
    "source_limits": f"""WITH l AS (SELECT {SOURCE.replace('fuente', 'base_url').replace('url}', 'base_url}')} AS host, limite_noticias FROM (SELECT base_url, base_url AS url, limite_noticias FROM fuentes WHERE activo)),
        n AS (SELECT pos, {SOURCE} AS host FROM noticias), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY pos) AS r FROM n)
        SELECT pos, host FROM r JOIN l USING (host) WHERE r <= limite_noticias""",
    "trend_counts_month": f"WITH {_DATED} SELECT categoria, mes AS periodo, count(*) AS n FROM fec GROUP BY 1, 2",
    "trend_counts_week": f"WITH {_DATED} SELECT categoria, semana AS periodo, count(*) AS n FROM fec GROUP BY 1, 2",
    "trend_peak": f"""WITH {_DATED}, c AS (SELECT categoria, mes AS periodo, count(*) AS n FROM fec GROUP BY 1, 2), f AS (SELECT categoria, min(pos) AS p FROM fec GROUP BY 1)
        SELECT categoria, periodo, n FROM c JOIN f USING (categoria) ORDER BY n DESC, p, periodo LIMIT 1""",
    "trend_term_changes": f"WITH {_DATED}, {_CHANGES} SELECT categoria, primero, ultimo, termino, cambio, sentido, rango FROM top",
    "trend_table": f"""WITH {_DATED}, {_CHANGES}, c AS (SELECT categoria, mes AS periodo, count(*) AS n FROM fec GROUP BY 1, 2),
        g AS (SELECT categoria, coalesce(string_agg(termino, ', ' ORDER BY rango) FILTER (sentido = 'aumenta'), '') AS aumentan, coalesce(string_agg(termino, ', ' ORDER BY rango) FILTER (sentido = 'disminuye'), '') AS disminuyen FROM top GROUP BY 1)
        SELECT categoria, periodo, n, coalesce(aumentan, '') AS aumentan, coalesce(disminuyen, '') AS disminuyen FROM c LEFT JOIN g USING (categoria)""",
    "trend_bars": f"WITH {_DATED}, c AS (SELECT categoria, mes AS periodo, count(*) AS n FROM fec GROUP BY 1, 2) SELECT *, repeat('#', CAST(round_even(n / max(n) OVER () * 35, 0) AS INTEGER)) AS barra FROM c",
    "event_counts_month": "SELECT event_type AS categoria, strftime(ts, '%G-W%V') AS periodo, count(*) AS n FROM events GROUP BY 1, 2",
    "sentiment_documents": f"WITH {_LEX} SELECT pos, round(compound, 6) AS compound, etiqueta FROM sen",
    "sentiment_corpus": f"""WITH {_LEX}, g AS (SELECT count(*) FILTER (etiqueta = 'positivo') AS positivos, count(*) FILTER (etiqueta = 'negativo') AS negativos, count(*) FILTER (etiqueta = 'neutral') AS neutrales, coalesce(avg(compound), 0) AS p FROM sen),
        d AS (SELECT etiqueta FROM sen GROUP BY etiqueta ORDER BY count(*) DESC, etiqueta LIMIT 1)
        SELECT positivos, negativos, neutrales, round(p, 6) AS promedio, (SELECT etiqueta FROM d) AS dominante, CASE WHEN p > 0.05 THEN 'positivo' WHEN p < -0.05 THEN 'negativo' ELSE 'neutral' END AS tono FROM g""",
    "sentiment_by_category": f"WITH {_LEX} SELECT categoria, round(avg(compound), 6) AS promedio, count(*) AS total FROM sen GROUP BY 1",
    "thread_moving_avg": f"WITH {_THREAD} SELECT hilo, pos, score, round(avg(score) OVER (PARTITION BY hilo ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS media_movil FROM thr",
    "thread_summary": f"""WITH {_THREAD}, g AS (SELECT hilo, count(*) AS mensajes, count(DISTINCT usuario) AS usuarios, round(avg(score), 4) AS media,
        round(100.0 * count(*) FILTER (tono = 'positivo') / count(*), 1) AS pct_positivo, round(100.0 * count(*) FILTER (tono = 'negativo') / count(*), 1) AS pct_negativo, round(100.0 * count(*) FILTER (tono = 'neutral') / count(*), 1) AS pct_neutral FROM ton GROUP BY hilo)
        SELECT *, CASE WHEN media > 0.05 THEN 'positivo' WHEN media < -0.05 THEN 'negativo' ELSE 'mixto' END AS tono FROM g""",
    "hashtag_counts": rf"WITH {_THREAD} SELECT hashtag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(texto, '#([\p{{L}}\p{{N}}_]+)', 1)) AS hashtag FROM thr) GROUP BY 1",
    "active_users": f"WITH {_THREAD} SELECT usuario, count(*) AS mensajes FROM thr GROUP BY usuario ORDER BY count(*) DESC, min(pos) LIMIT 10",
    "alerts_match": f"WITH {_ALERTS} SELECT consulta, noticia_id, min(titulo) AS titulo FROM al GROUP BY 1, 2",
    "alerts_replayed": f"WITH {_ALERTS} SELECT consulta, noticia_id FROM al GROUP BY 1, 2 HAVING count(*) FILTER (pos % 2 = 0) = 0",
    "alert_counts": f"WITH {_ALERTS} SELECT consulta, count(DISTINCT noticia_id) AS n FROM al GROUP BY 1",
    "category_share": "WITH c AS (SELECT coalesce(categoria_original, 'general') AS categoria, count(*) AS n FROM noticias GROUP BY 1) SELECT *, round(100.0 * n / sum(n) OVER (), 6) AS porcentaje FROM c",
    "extraction_summary": "SELECT count(*) AS total, count(DISTINCT categoria_original) AS categorias, count(DISTINCT autor) AS autores, min(fecha) AS primera, max(fecha) AS ultima FROM noticias",
    "url_join": """WITH l AS (SELECT url, arg_max(titulo, fila) AS t, max(fila) AS f FROM noticias_paginadas GROUP BY url)
        SELECT pos, coalesce(f, -1) AS fila, coalesce(t, '') AS titulo_listado FROM noticias LEFT JOIN l USING (url)""",
    "label_agreement": """WITH m AS (SELECT pos, list(DISTINCT materia) AS m FROM etiquetas GROUP BY pos)
        SELECT count(*) AS etiquetados, count(*) FILTER (list_contains(m, categoria_original)) AS coinciden FROM noticias JOIN m USING (pos)""",
}
_PROF = ", ".join(f"({i}, '{name}', '{words}')" for i, (name, words) in enumerate(lexicons.TOPIC_PROFILES))
ORACLES["window_topics"] = rf"""WITH pf AS (SELECT * FROM (VALUES {_PROF}) AS v(k, tema, ws)), pw AS (SELECT k, tema, unnest(string_split(ws, ' ')) AS term FROM pf),
    ptf AS (SELECT k, tema, term, count(*) AS tf FROM pw GROUP BY ALL), idf AS (SELECT term, ln(5.0 / (1 + count(*))) + 1 AS idf FROM ptf GROUP BY term),
    pr AS (SELECT k, tema, term, tf * idf AS r FROM ptf JOIN idf USING (term)), pn AS (SELECT k, tema, term, r / sqrt(sum(r * r) OVER (PARTITION BY k)) AS w FROM pr),
    m AS (SELECT pos, {SOURCE} AS hilo, strip_accents(lower(coalesce(titulo, ''))) AS texto FROM noticias),
    win AS (SELECT pos, hilo, unnest(regexp_extract_all(string_agg(texto, ' ') OVER (PARTITION BY hilo ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM m),
    q AS (SELECT pos, term, count(*) * any_value(idf) AS r FROM win JOIN idf USING (term) GROUP BY pos, term), qn AS (SELECT pos, term, r / sqrt(sum(r * r) OVER (PARTITION BY pos)) AS r FROM q),
    d AS (SELECT pos, k, tema, sum(r * w) AS c FROM qn JOIN pn USING (term) GROUP BY ALL), b AS (SELECT pos, tema, c FROM d QUALIFY row_number() OVER (PARTITION BY pos ORDER BY round(c, 9) DESC, k) = 1)
    SELECT hilo, pos, CASE WHEN coalesce(c, 0) >= 0.08 THEN tema ELSE 'general' END AS tema, round(coalesce(c, 0), 6) AS confianza FROM m LEFT JOIN b USING (pos)"""
