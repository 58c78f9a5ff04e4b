"""Queries on corpora for language models: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions.urls import host_of, source_host
from tamiz.llm import capping, leakage, line_blocks, long_repeats, names, packing, page_content, subjects, truncation
from tamiz.session import broadcast_if_small, read_table

SOURCE_SHARE, AUTHOR_SHARE = 0.05, 0.01


def _with_site(spark: SparkSession, sf_dir: str, *columns: str) -> tuple[DataFrame, frozenset[str]]:
    """``noticias`` with the name of each record's site, and the names of all sites (the fixed table of sources)."""
    fuentes = read_table(spark, sf_dir, "fuentes").select(host_of(F.col("base_url")).alias("_host"), F.col("nombre").alias("_site"))
    names = frozenset(" ".join(r[0].lower().split()) for r in fuentes.select("_site").where("_site IS NOT NULL").distinct().collect())
    noticias = read_table(spark, sf_dir, "noticias").select(*columns, source_host(F.col("fuente"), F.col("url")).alias("_host"))
    return noticias.join(broadcast_if_small(fuentes.dropDuplicates(["_host"])), "_host", "left"), names


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = [r[0] for r in read_table(spark, sf_dir, "materias").select("materia").distinct().orderBy("materia").collect()]
    noticias, seeds = read_table(spark, sf_dir, "noticias"), read_table(spark, sf_dir, "etiquetas")
    return subjects.document_subjects(noticias.select("pos", "cuerpo"), "pos", "cuerpo", seeds, "pos", "materia", areas)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subject that a quarter or more of a record's article treats."""
    return _subjects(spark, sf_dir).select("pos", "materia").distinct()


def p1_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the corpus each subject makes up."""
    return subjects.corpus_composition(_subjects(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ``cuerpo`` (and line 0, the title) that hold page furniture."""
    noticias, names = _with_site(spark, sf_dir, "pos", "cuerpo", "titulo")
    noticias = page_content.with_recurring(noticias, "pos", "cuerpo", F.col("_host"), "_again")
    lines = page_content.furniture_lines(F.col("cuerpo"), F.col("titulo"), F.col("_site"), names, F.col("_again"))
    return noticias.select("pos", F.explode(lines).alias("linea")).distinct()


def p2_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page: its own lines, in order."""
    noticias, _ = _with_site(spark, sf_dir, "pos", "cuerpo")
    noticias = page_content.with_recurring(noticias, "pos", "cuerpo", F.col("_host"), "_again")
    return noticias.select("pos", page_content.article_text(F.col("cuerpo"), F.col("_again")).alias("articulo"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings in ``autor`` that name the same person or agency."""
    return names.name_pairs(read_table(spark, sf_dir, "noticias"), "autor")


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity with the number of its spellings and records and its most used spelling."""
    noticias = read_table(spark, sf_dir, "noticias")
    used = noticias.groupBy(F.col("autor").alias("valor")).agg(F.count("*").alias("n"))
    joined = names.name_clusters(noticias, "autor").join(used, "valor")
    return joined.groupBy("entidad").agg(F.count("*").alias("formas"), F.sum("n").alias("registros"), F.max_by("valor", F.struct("n", "valor")).alias("nombre"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records beyond the cap of their source or of their author."""
    noticias = read_table(spark, sf_dir, "noticias").select("pos", "calidad", "autor", "fuente", "url")
    author = F.when(F.trim("autor") != "", F.col("autor"))
    kinds = {"fuente": (source_host(F.col("fuente"), F.col("url")), SOURCE_SHARE), "autor": (author, AUTHOR_SHARE)}
    return capping.rows_beyond_caps(noticias, "pos", "calidad", kinds)


def _cut_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = source_host(F.col("fuente"), F.col("url")).alias("src")
    news = read_table(spark, sf_dir, "noticias").select(F.lit("noticias").alias("tabla"), F.col("pos").alias("id"), source, F.col("cuerpo").alias("text"))
    pages = read_table(spark, sf_dir, "noticias_paginadas").select(F.lit("noticias_paginadas").alias("tabla"), F.col("fila").alias("id"), source, F.col("resumen").alias("text"))
    return truncation.cut_texts(news.unionByName(pages))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of either table whose text was cut off inside a sentence."""
    return _cut_verdicts(spark, sf_dir).where("cortado").select("tabla", "id").distinct()


def p6_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source of either table the share of its records that is cut."""
    return truncation.share_by_source(_cut_verdicts(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ``cuerpo`` that occur in at least ten records of their source."""
    noticias = read_table(spark, sf_dir, "noticias").select("pos", "cuerpo", "fuente", "url")
    found, _ = line_blocks.repeated_lines(noticias, "pos", "cuerpo", source_host(F.col("fuente"), F.col("url")))
    return found


def p7_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many repeated blocks of each length there are, and in how many documents the most repeated one."""
    noticias = read_table(spark, sf_dir, "noticias").select("pos", "cuerpo", "fuente", "url")
    _, blocks = line_blocks.repeated_lines(noticias, "pos", "cuerpo", source_host(F.col("fuente"), F.col("url")))
    return blocks.groupBy("n_lines").agg(F.count("*").alias("bloques"), F.max("docs").alias("documentos_max"))


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``cuerpo`` without the repeated lines of its source."""
    noticias = read_table(spark, sf_dir, "noticias").select("pos", "cuerpo", "fuente", "url")
    found, _ = line_blocks.repeated_lines(noticias, "pos", "cuerpo", source_host(F.col("fuente"), F.col("url")))
    return line_blocks.without_lines(noticias.select("pos", "cuerpo"), "pos", "cuerpo", found)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each container of 2,048 tokens with its pieces and the space left."""
    return packing.containers(p8_placement(spark, sf_dir))


def p8_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every piece of every text."""
    return packing.pack(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of containers, the space left in all, and the least number that the tokens could need."""
    filled = p8_containers(spark, sf_dir).agg(F.count("*").alias("contenedores"), F.sum("tokens").alias("tokens"), F.sum("libre").alias("libre"))
    return filled.withColumn("minimo", F.ceil(F.col("tokens") / packing.CAPACITY))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items")
    return leakage.leaked_items(documents, "doc_id", "text", items, "item_id", "texto", "pregunta")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least twelve consecutive words of a test item, with the item."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked test item with the number of its documents and the longest passage."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(
        F.countDistinct("doc_id").alias("documentos"), F.max("palabras").alias("palabras_max"), F.round(F.avg("pregunta"), 6).alias("pregunta_media")
    )


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with a common span of at least 300 characters."""
    return long_repeats.repeated_pairs(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def p10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of each document that occur in others, as [inicio, fin) in characters."""
    spans = long_repeats.shared_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return spans.withColumnRenamed("doc", "doc_id")


def p10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the share of its characters that occurs elsewhere in a long span."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("caracteres"))
    covered = p10_spans(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.col("fin") - F.col("inicio")).alias("repetidos"))
    joined = documents.join(covered, "doc_id", "left").withColumn("repetidos", F.coalesce("repetidos", F.lit(0)))
    return joined.withColumn("proporcion", F.round(F.coalesce(F.try_divide("repetidos", "caracteres"), F.lit(0.0)), 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_composition": p1_composition,
    "p2_found": p2_found,
    "p2_article": p2_article,
    "p3_found": p3_found,
    "p3_entities": p3_entities,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_sources": p6_sources,
    "p7_found": p7_found,
    "p7_blocks": p7_blocks,
    "p7_cleaned": p7_cleaned,
    "p8_containers": p8_containers,
    "p8_placement": p8_placement,
    "p8_summary": p8_summary,
    "p9_found": p9_found,
    "p9_items": p9_items,
    "p10_found": p10_found,
    "p10_spans": p10_spans,
    "p10_share": p10_share,
}

_HOST = r"regexp_extract(regexp_replace(lower(trim({0})), '^[a-z][a-z0-9+.-]*://', ''), '^(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)', 1)"
_SOURCE = f"coalesce(nullif({_HOST.format('fuente')}, ''), nullif({_HOST.format('url')}, ''))"

# Every window of 300 characters of every document; those that several documents have.
_WINDOWS = """
    pl AS (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300),
    win AS (SELECT doc_id, i, hash(substring(text, i, 300)) AS h FROM pl),
    often AS (SELECT h FROM win GROUP BY h HAVING count(DISTINCT doc_id) > 1),
    held AS (SELECT doc_id, i, h FROM win JOIN often USING (h)),
    marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 300 THEN 0 ELSE 1 END AS fresh FROM held WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM marked),
    spans AS (SELECT doc_id, CAST(min(i) - 1 AS INTEGER) AS inicio, CAST(max(i) + 299 AS INTEGER) AS fin FROM runs GROUP BY doc_id, r)"""
_FOLDED = "regexp_extract_all(strip_accents(lower({0})), '[\\p{{L}}\\p{{N}}]+')"

ORACLES: dict[str, str] = {
    "p10_found": f"""WITH {_WINDOWS}, k AS (SELECT DISTINCT doc_id, h FROM held)
        SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM k a JOIN k b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p10_spans": f"WITH {_WINDOWS} SELECT doc_id, inicio, fin FROM spans",
    "p10_share": f"""WITH {_WINDOWS}, c AS (SELECT doc_id, CAST(sum(fin - inicio) AS BIGINT) AS repetidos FROM spans GROUP BY doc_id)
        SELECT doc_id, coalesce(length(text), 0) AS caracteres, coalesce(repetidos, 0) AS repetidos, round(CASE WHEN length(text) > 0 THEN coalesce(repetidos, 0) / length(text) ELSE 0 END, 6) AS proporcion FROM documents LEFT JOIN c USING (doc_id)""",
    "p9_found": f"""WITH d AS (SELECT doc_id, {_FOLDED.format('text')} AS w FROM documents), e AS (SELECT item_id, {_FOLDED.format('texto')} AS w FROM eval_items),
        dg AS (SELECT doc_id, hash(list_slice(w, i, i + 11)) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)), eg AS (SELECT item_id, hash(list_slice(w, i, i + 11)) AS h FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e WHERE len(w) >= 12))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (h)""",
    "p5_found": f"""
        WITH base AS (
            SELECT pos, calidad, {_SOURCE} AS src, CASE WHEN trim(autor) <> '' THEN autor END AS aut, count(*) OVER () AS n
            FROM noticias),
        ranked AS (
            SELECT pos, n, src, aut,
                   row_number() OVER (PARTITION BY src ORDER BY calidad DESC NULLS LAST, pos) AS rs,
                   row_number() OVER (PARTITION BY aut ORDER BY calidad DESC NULLS LAST, pos) AS ra
            FROM base)
        SELECT DISTINCT pos FROM ranked
        WHERE (src IS NOT NULL AND rs > greatest(1, floor({SOURCE_SHARE} * n)))
           OR (aut IS NOT NULL AND ra > greatest(1, floor({AUTHOR_SHARE} * n)))""",
    "p7_found": f"""
        WITH docs AS (SELECT pos, {_SOURCE} AS src, string_split(cuerpo, chr(10)) AS ls FROM noticias WHERE cuerpo <> ''),
        raw AS (SELECT pos, src, unnest(ls) AS l, generate_subscripts(ls, 1) AS linea FROM docs),
        folded AS (
            SELECT pos, src, CAST(linea AS INTEGER) AS linea,
                   trim(regexp_replace(regexp_replace(lower(l), '\\p{{Nd}}+', '0', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g')) AS l
            FROM raw),
        often AS (SELECT src, l FROM folded WHERE l <> '' GROUP BY src, l HAVING count(DISTINCT pos) >= 10)
        SELECT DISTINCT f.pos, f.linea FROM folded f JOIN often o ON f.src IS NOT DISTINCT FROM o.src AND f.l = o.l""",
    "p7_blocks": f"""
        WITH docs AS (SELECT pos, {_SOURCE} AS src, string_split(cuerpo, chr(10)) AS ls FROM noticias WHERE cuerpo <> ''),
        raw AS (SELECT pos, src, unnest(ls) AS l, generate_subscripts(ls, 1) AS linea FROM docs),
        folded AS (
            SELECT pos, src, linea, trim(regexp_replace(regexp_replace(lower(l), '\\p{{Nd}}+', '0', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g')) AS l
            FROM raw),
        held AS (SELECT pos, src, list(hash(l) ORDER BY linea) AS ls FROM folded WHERE l <> '' GROUP BY pos, src),
        starts AS (SELECT pos, src, ls, unnest(range(1, len(ls) + 1)) AS i FROM held),
        spans AS (SELECT pos, src, ls, i, unnest(range(i, len(ls) + 1)) AS j FROM starts),
        blocks AS (SELECT j - i + 1 AS n_lines, src, list_slice(ls, i, j) AS block, count(DISTINCT pos) AS docs FROM spans GROUP BY ALL HAVING count(DISTINCT pos) >= 10)
        SELECT CAST(n_lines AS INTEGER) AS n_lines, count(*) AS bloques, max(docs) AS documentos_max FROM blocks GROUP BY n_lines""",
}
