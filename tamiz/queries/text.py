"""Text statistics, search and similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions import lexicons
from tamiz.functions.text import clean, fold, words
from tamiz.operators import dialogue, nlp, search, similarity
from tamiz.queries.base import DOCS, WORDS, documents, sql_list, tfidf_sql
from tamiz.session import materialise, read_table

QUERY = "inflación y salario mínimo"


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", clean(F.col("cuerpo")).alias("limpio"))


def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return nlp.frequencies(docs.select(F.explode(words(fold(search.document_text(docs)))).alias("termino")), "termino", 50)


def _processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nlp.process(documents(spark, sf_dir), "cuerpo")


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nlp.corpus_stats(_processed(spark, sf_dir))


def ngrams_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nlp.top_ngrams(_processed(spark, sf_dir), 2, 30)


def trigrams_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nlp.top_ngrams(_processed(spark, sf_dir), 3, 30)


def lexical_richness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _processed(spark, sf_dir).select("doc_id", "num_tokens", "num_terminos", "num_oraciones", "vocabulario_unico", F.round("riqueza_lexica", 6).alias("riqueza_lexica"))


def richness_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nlp.richness_by_section(_processed(spark, sf_dir), "doc_id", "terminos").select("doc_id", "seccion", F.round("riqueza", 6).alias("riqueza"))


def entity_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nlp.entities(documents(spark, sf_dir), "doc_id", "cuerpo")


def discourse_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nlp.discourse(documents(spark, sf_dir), "doc_id", "cuerpo")
    return found.na.fill(0, ["oraciones", "palabras", "vocabulario"]).na.fill(0.0, ["riqueza", "promedio_oracion"])


def category_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nlp.top_per_group(_processed(spark, sf_dir).select("categoria", F.explode("terminos").alias("termino")), "categoria", "termino", 10)


def stems_es(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct term with its stem."""
    terms = _processed(spark, sf_dir).select(F.explode("terminos").alias("termino")).distinct()
    return terms.select("termino", F.element_at(nlp.stems(F.array("termino")), 1).alias("raiz"))


def index_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return search.index_info(search.postings(docs), docs)


def search_boolean_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.boolean_search(documents(spark, sf_dir), "Salario mínimo", "AND")


def search_boolean_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.boolean_search(documents(spark, sf_dir), "vacuna órbita inflación", "OR")


def _weights(spark: SparkSession, sf_dir: str, features: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = documents(spark, sf_dir)
    return (*search.tfidf_terms(docs, fold(search.document_text(docs)), features, 2, True), docs)


def tfidf_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, _, _ = _weights(spark, sf_dir)
    return search.top_terms(weights).select("doc_id", "rango", "term", F.round("w", 6).alias("w"))


def tfidf_matrix_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matrix_info(*_weights(spark, sf_dir)).select("documentos", "vocabulario", F.round("densidad", 9).alias("densidad"), F.round("terminos_por_documento", 6).alias("terminos_por_documento"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir)[1].select("term", "df", F.round("idf", 6).alias("idf"))


def search_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked search: the ten best documents for one query."""
    found = search.vector_search(documents(spark, sf_dir), QUERY, 10)
    return found.select("doc_id", F.round("relevancia", 6).alias("relevancia"), F.round("score", 6).alias("score"), "snippet")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    mood = F.when(F.col("doc_id") % 3 == 0, "positivo").when(F.col("doc_id") % 3 == 1, "negativo").otherwise("neutral")
    area = F.when(F.col("doc_id") % 2 == 0, "economia").otherwise("politica")
    return documents(spark, sf_dir).withColumn("sentimiento", mood).withColumn("categoria", area)


def search_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.natural_search(_judged(spark, sf_dir), "noticias positivas de economía sobre inflación y salario", 5)
    return found.select("doc_id", "categoria", "sentimiento", F.round("score", 6).alias("score"))


def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nearest documents of every document whose number is divisible by 50, among all."""
    weights, _, docs = _weights(spark, sf_dir)
    weights = materialise(weights, "weights")
    return search.similar_documents(weights, docs.where("doc_id % 50 = 0"), 3).select("i", "j", F.round("coseno", 6).alias("coseno"), "rango")


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "noticias_paginadas").select(F.col("fila").alias("doc_id"), "titulo", F.col("resumen").alias("cuerpo"))


def search_federated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked search over the documents and the listings as one corpus: the ten best are its feature."""
    found = search.federated_search({"documentos": documents(spark, sf_dir).select("doc_id", "titulo", "cuerpo"), "listados": _paged(spark, sf_dir)}, QUERY, 10)
    return found.select("fuente", "id", F.round("relevancia", 6).alias("relevancia"), F.round("score", 6).alias("score"))


def search_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query that the listings do not answer well enough goes to the documents."""
    found = search.search_with_fallback(_paged(spark, sf_dir).where("doc_id < 0"), QUERY, {"documentos": documents(spark, sf_dir).select("doc_id", "titulo", "cuerpo")}, 10)
    return found.select("fuente", "id", F.round("score", 6).alias("score"))


def search_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_answers(documents(spark, sf_dir), QUERY)
    return found.select("tipo", "rango", "doc_id", F.round("relevancia", 6).alias("relevancia"))


#: Settings of the weights by use: (accents folded, vocabulary, longest n-gram, stop words, text of empty documents).
TFIDF_SETTINGS: dict[str, tuple[bool, int | None, int, list[str], str]] = {
    "comparador": (True, None, 2, [], ""), "preguntas": (True, 2000, 2, dialogue.QUESTION_STOPWORDS, ""), "clasificador": (False, 3000, 2, [], ""), "hilo": (False, 500, 1, ["the", "and", "of", "to", "in"], ""),
    "anuncios": (False, None, 1, [], ""), "recomendador": (True, 2000, 2, [], "sin contenido"),
}


def tfidf_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and weight of the matrix of each use's settings."""
    docs, out = documents(spark, sf_dir), []
    for name, (folded, features, n, stop, empty) in TFIDF_SETTINGS.items():
        text = search.document_text(docs)
        text = F.when(F.trim(text) == "", F.lit(empty)).otherwise(text)
        weights, _ = search.tfidf_terms(docs, fold(text) if folded else F.lower(text), features, n, stopwords=stop)
        out.append(weights.agg(F.countDistinct("term").alias("terminos"), F.count("*").alias("celdas"), F.round(F.sum("w"), 3).alias("peso")).withColumn("uso", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


def _neighbours(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return similarity.nearest_vectors(vectors, "vec_id", "embedding", vectors.where("vec_id % 50 = 0"), n)


def embedding_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir, 5).select("i", "j", F.round("coseno", 6).alias("coseno"), "rango")


def recommend_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("categoria"))
    return similarity.recommend(_neighbours(spark, sf_dir, 50).drop("rango"), docs, n=3).select("i", "j", F.round("coseno", 6).alias("coseno"), "rango")


def recommend_exclude_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    found = similarity.nearest_vectors(vectors, "vec_id", "embedding", vectors.where("vec_id % 50 = 0"), 3, differ="label", later_first=False)
    return found.select("i", "j", F.round("coseno", 6).alias("coseno"), "rango")


def recommend_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    read = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("i"), (F.col("vec_id") % 3).alias("perfil"))
    sums = similarity.profile_affinities(vectors, "vec_id", "embedding", read)
    return similarity.best_unread(sums, read, 3).select("perfil", "j", F.round("afinidad", 6).alias("afinidad"), "rango")


def greedy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leader groups of all vectors over all pairs whose cosine is 0.15 or more."""
    vectors = read_table(spark, sf_dir, "embeddings")
    nodes = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").alias("nodo"))
    return similarity.greedy_groups(nodes, similarity.similar_pairs(vectors, "vec_id", "embedding", 0.15))


QUERIES = {
    f.__name__: f
    for f in (
        search_vector, search_natural, search_federated, search_fallback, search_answers, tfidf_settings, search_boolean_and, search_boolean_or, index_info, vocabulary, tfidf_top_terms, tfidf_matrix_info, similar_documents,
        clean_text, term_frequencies, corpus_stats, ngrams_top, trigrams_top, lexical_richness, richness_by_section, entity_context, discourse_analysis, category_terms, stems_es,
        embedding_neighbors, recommend_item, recommend_exclude_category, recommend_profile, greedy_groups,
    )
}

_LETTERS = r"list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-záéíóúñü\s]', ' ', 'g'), '[\s]+', ' ', 'g')), ' '), lambda t: length(t) > 0)"
_TERMS = f"list_filter(tokens, lambda t: length(t) >= 3 AND NOT list_contains({sql_list(lexicons.BASIC_STOPWORDS)}, t))"
_SENTENCES = "CASE WHEN length({0}) > 0 THEN greatest(1, len(regexp_extract_all({0}, '[.!?]+'))) ELSE 0 END"
_PROCESSED = f"""{DOCS},
    tok AS (SELECT doc_id, categoria, cuerpo, {_LETTERS.format('cuerpo')} AS tokens FROM docs),
    pro AS (SELECT doc_id, categoria, cuerpo, tokens, {_TERMS} AS terminos FROM tok)"""


def _grams(n: int) -> str:
    glued = " || ' ' || ".join(f"terminos[i{' + ' + str(k) if k else ''}]" for k in range(n))
    return f"""WITH {_PROCESSED}, pos AS (SELECT terminos, unnest(range(1, len(terminos) - {n - 2})) AS i FROM pro WHERE len(terminos) >= {n})
        SELECT {glued} AS ngrama, count(*) AS n FROM pos GROUP BY 1 ORDER BY n DESC, ngrama LIMIT 30"""


def _scored(terms: list[str], query: str, significant: list[str], name: str = "docs", features: int = 3000) -> str:
    grams = terms + [f"{a} {b}" for a, b in zip(terms, terms[1:], strict=False)]
    values = ", ".join(f"('{g}')" for g in grams)
    return f"""{tfidf_sql(features, False, name)},
    q AS (SELECT term, count(*) * any_value(idf) AS r FROM (VALUES {values}) AS v(term) JOIN voc USING (term) GROUP BY term),
    qn AS (SELECT term, r / sqrt(sum(r * r) OVER ()) AS qw FROM q),
    cos AS (SELECT doc_id, sum(w * qw) AS relevancia FROM weights JOIN qn USING (term) GROUP BY doc_id),
    parts AS (SELECT d.*, coalesce(relevancia, 0.0) AS relevancia, strip_accents(lower(coalesce(titulo, ''))) AS ft, strip_accents(lower(coalesce(cuerpo, ''))) AS fc FROM {name} d LEFT JOIN cos USING (doc_id)),
    hits AS (SELECT *, len(list_intersect({sql_list(significant)}, regexp_extract_all(ft, '[\\p{{L}}\\p{{N}}_]+'))) AS nt,
                    len(list_intersect({sql_list(significant)}, regexp_extract_all(ft || ' ' || fc, '[\\p{{L}}\\p{{N}}_]+'))) AS nx FROM parts),
    scored AS (SELECT *, relevancia + CASE WHEN contains(ft, '{query}') THEN 1.0 ELSE 0.0 END + nt / {len(significant)} * 0.7 + nx / {len(significant)} * 0.2 AS score FROM hits)"""


_NEAR = """
    v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    cosines AS (SELECT a.vec_id AS i, b.vec_id AS j, b.label AS lj, a.label AS li, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 9) AS coseno
                FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    near AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY coseno DESC, j DESC) AS rn FROM cosines)"""
_DISCOURSE = f"""long3 AS (SELECT doc_id, coalesce(cuerpo, '') AS c, list_filter({_LETTERS.format('cuerpo')}, lambda t: length(t) > 2) AS lw FROM docs),
    fil AS (SELECT doc_id, c, len(lw) AS palabras, list_filter(lw, lambda t: NOT list_contains({sql_list(lexicons.DISCOURSE_STOPWORDS)}, t)) AS ts FROM long3)"""

def _setting_sql(name: str, folded: bool, features: int | None, n: int, stop: list[str], empty: str) -> str:
    text = "lower(coalesce(titulo, '') || ' ' || coalesce(cuerpo, ''))"
    text = f"CASE WHEN trim({text}) = '' THEN '{empty}' ELSE {text} END"
    text = f"strip_accents({text})" if folded else text
    pairs = f"UNION ALL SELECT doc_id, ws[i] || ' ' || ws[i + 1] FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM l_{name} WHERE len(ws) >= 2)" if n == 2 else ""
    limit = f"ORDER BY sum(tf) DESC, term LIMIT {features}" if features else ""
    return f"""l_{name} AS (SELECT doc_id, list_filter(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: NOT list_contains(CAST({sql_list(stop)} AS VARCHAR[]), t)) AS ws FROM docs),
        g_{name} AS (SELECT doc_id, unnest(ws) AS term FROM l_{name} {pairs}), c_{name} AS (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS tf FROM g_{name} GROUP BY 1, 2),
        v_{name} AS (SELECT term, ln((1.0 + (SELECT count(*) FROM docs)) / (1.0 + count(*))) + 1.0 AS idf FROM c_{name} GROUP BY term {limit}), r_{name} AS (SELECT doc_id, term, tf * idf AS r FROM c_{name} JOIN v_{name} USING (term)),
        w_{name} AS (SELECT term, r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)) AS w FROM r_{name}), o_{name} AS (SELECT '{name}' AS uso, count(DISTINCT term) AS terminos, count(*) AS celdas, round(sum(w), 3) AS peso FROM w_{name})"""


_BOTH = "bo AS (SELECT doc_id * 2 AS doc_id, titulo, cuerpo, 'documentos' AS fuente, doc_id AS id FROM docs UNION ALL SELECT fila * 2 + 1, titulo, resumen, 'listados', fila FROM noticias_paginadas)"
_ASK = (["inflacion", "salario", "minimo"], "inflacion y salario minimo", ["inflacion", "salario", "minimo"])

ORACLES = {
    "clean_text": rf"""WITH {DOCS} SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(cuerpo), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\p{{N}}+', '', 'g'), '\s+', ' ', 'g')) AS limpio FROM docs""",
    "term_frequencies": f"WITH {DOCS} SELECT termino, count(*) AS n FROM (SELECT unnest({WORDS}) AS termino FROM docs) GROUP BY termino ORDER BY n DESC, termino LIMIT 50",
    "corpus_stats": f"""WITH {_PROCESSED},
        s AS (SELECT count(*) AS total_documentos, coalesce(sum(len(tokens)), 0) AS total_tokens, round(coalesce(avg(len(list_distinct(terminos)) / greatest(len(terminos), 1)), 0), 4) AS riqueza_promedio,
              round(coalesce(avg(len(tokens)), 0), 1) AS promedio_tokens_doc FROM pro)
        SELECT s.*, (SELECT count(DISTINCT t) FROM (SELECT unnest(terminos) AS t FROM pro)) AS vocabulario_total FROM s""",
    "ngrams_top": _grams(2),
    "trigrams_top": _grams(3),
    "lexical_richness": f"""WITH {_PROCESSED} SELECT doc_id, len(tokens) AS num_tokens, len(terminos) AS num_terminos, {_SENTENCES.format("coalesce(cuerpo, '')")} AS num_oraciones,
        len(list_distinct(terminos)) AS vocabulario_unico, round(len(list_distinct(terminos)) / greatest(len(terminos), 1), 6) AS riqueza_lexica FROM pro""",
    "richness_by_section": f"""WITH {_PROCESSED}, sec AS (SELECT doc_id, terminos, len(terminos) AS n, greatest(len(terminos) // 4, 1) AS s, unnest([0, 1, 2, 3]) AS k FROM pro WHERE len(terminos) > 0),
        cut AS (SELECT doc_id, k + 1 AS seccion, terminos[k * s + 1 : CASE WHEN k = 3 THEN n ELSE k * s + s END] AS part FROM sec WHERE k * s < n)
        SELECT doc_id, seccion, round(len(list_distinct(part)) / len(part), 6) AS riqueza FROM cut""",
    "entity_context": rf"""WITH {DOCS}, w AS (SELECT doc_id, regexp_extract_all(coalesce(cuerpo, ''), '[\p{{L}}\p{{N}}_]+') AS ws FROM docs),
        p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
        e AS (SELECT doc_id, ws[i] AS entidad, i, list_transform(ws[greatest(i - 3, 1) : i - 1], lambda t: lower(t)) AS b FROM p
              WHERE regexp_matches(ws[i], '^[A-Za-záéíóúÁÉÍÓÚñÑüÜ]+$') AND regexp_matches(ws[i], '^\p{{Lu}}') AND length(ws[i]) > 2 AND NOT list_contains({sql_list(lexicons.DISCOURSE_STOPWORDS)}, lower(ws[i]))),
        t AS (SELECT doc_id, entidad, i, CASE WHEN list_has_any(b, {sql_list(lexicons.PERSON_CONTEXT)}) THEN 'PERSONA' WHEN list_has_any(b, {sql_list(lexicons.PLACE_CONTEXT)}) THEN 'LUGAR'
              WHEN list_has_any(b, {sql_list(lexicons.ORGANISATION_CONTEXT)}) THEN 'ORG' ELSE 'DESCONOCIDO' END AS tipo FROM e)
        SELECT doc_id, entidad, arg_max(tipo, i) AS tipo, count(*) AS n FROM t GROUP BY doc_id, entidad""",
    "discourse_analysis": f"""WITH {DOCS}, {_DISCOURSE}, x AS (SELECT *, len(ts) >= 5 AS ok, {_SENTENCES.format('c')} AS o, len(list_distinct(ts)) AS v FROM fil)
        SELECT doc_id, CASE WHEN ok THEN 'ok' ELSE 'insuficiente' END AS estado, CASE WHEN ok THEN o ELSE 0 END AS oraciones, CASE WHEN ok THEN palabras ELSE 0 END AS palabras, CASE WHEN ok THEN v ELSE 0 END AS vocabulario,
               CASE WHEN ok THEN round(v / len(ts), 4) ELSE 0 END AS riqueza, CASE WHEN ok THEN round(palabras / greatest(o, 1), 1) ELSE 0 END AS promedio_oracion FROM x""",
    "category_terms": f"""WITH {_PROCESSED}, c AS (SELECT categoria, termino, count(*) AS n FROM (SELECT categoria, unnest(terminos) AS termino FROM pro) GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY categoria ORDER BY n DESC, termino) AS rango FROM c) SELECT * FROM r WHERE rango <= 10""",
    "index_info": f"""WITH {DOCS}, p AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({WORDS}) AS term FROM docs)), t AS (SELECT term, count(*) AS n FROM p GROUP BY term)
        SELECT count(*) AS terminos_en_indice, coalesce(avg(n), 0.0) AS tamano_promedio_posting, (SELECT count(*) FROM docs) AS documentos_indexados FROM t""",
    "search_boolean_and": f"WITH {DOCS} SELECT doc_id FROM docs WHERE list_has_all({WORDS}, ['salario', 'minimo'])",
    "search_boolean_or": f"WITH {DOCS} SELECT doc_id FROM docs WHERE list_has_any({WORDS}, ['vacuna', 'orbita', 'inflacion'])",
    "vocabulary": f"WITH {DOCS}, {tfidf_sql(1000, True)} SELECT term, df, round(idf, 6) AS idf FROM voc",
    "tfidf_top_terms": f"""WITH {DOCS}, {tfidf_sql(1000, True)}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, term DESC) AS rango FROM weights WHERE w > 0)
        SELECT doc_id, rango, term, round(w, 6) AS w FROM r WHERE rango <= 8""",
    "tfidf_matrix_info": f"""WITH {DOCS}, {tfidf_sql(1000, True)}, n AS (SELECT (SELECT count(*) FROM docs) AS documentos, (SELECT count(*) FROM voc) AS vocabulario, (SELECT count(*) FROM weights) AS celdas)
        SELECT documentos, vocabulario, round(celdas / (documentos * vocabulario), 9) AS densidad, round(celdas / documentos, 6) AS terminos_por_documento FROM n""",
    "search_vector": f"""WITH {DOCS}, {_scored(['inflacion', 'salario', 'minimo'], 'inflacion y salario minimo', ['inflacion', 'salario', 'minimo'])}
        SELECT doc_id, round(relevancia, 6) AS relevancia, round(score, 6) AS score, CASE WHEN length(cuerpo) > 500 THEN left(cuerpo, 500) || '...' ELSE coalesce(cuerpo, '') END AS snippet
        FROM scored WHERE score > 0 ORDER BY round(score, 9) DESC, doc_id LIMIT 10""",
    "search_federated": f"""WITH {DOCS}, {_BOTH}, {_scored(*_ASK, 'bo')}
        SELECT fuente, id, round(relevancia, 6) AS relevancia, round(score, 6) AS score FROM scored WHERE score > 0 ORDER BY round(scored.score, 9) DESC, doc_id LIMIT 10""",
    "search_fallback": f"""WITH {DOCS}, {_scored(*_ASK)} SELECT 'documentos' AS fuente, doc_id AS id, round(score, 6) AS score FROM scored WHERE score > 0 ORDER BY round(scored.score, 9) DESC, doc_id LIMIT 10""",
    "search_answers": f"""WITH {DOCS}, {_scored(*_ASK)}, b AS (SELECT doc_id, relevancia, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rango, count(*) OVER () AS n FROM scored WHERE score > 0)
        SELECT tipo, rango, doc_id, round(relevancia, 6) AS relevancia FROM b, (VALUES ('recomendacion', 3, 1), ('comparacion', 2, 2), ('busqueda', 1, 1)) AS k(tipo, most, least) WHERE rango <= most AND n >= least""",
    "tfidf_settings": f"""WITH {DOCS}, {', '.join(_setting_sql(name, *x) for name, x in TFIDF_SETTINGS.items())} {' UNION ALL '.join(f'SELECT * FROM o_{name}' for name in TFIDF_SETTINGS)}""",
    "search_natural": f"""WITH {DOCS}, jd AS (SELECT doc_id, titulo, cuerpo, CASE doc_id % 3 WHEN 0 THEN 'positivo' WHEN 1 THEN 'negativo' ELSE 'neutral' END AS sentimiento, CASE WHEN doc_id % 2 = 0 THEN 'economia' ELSE 'politica' END AS categoria FROM docs),
        {_scored(['noticias', 'positivas', 'de', 'economia', 'sobre', 'inflacion', 'salario'], 'noticias positivas de economia sobre inflacion y salario', ['noticias', 'positivas', 'economia', 'sobre', 'inflacion', 'salario'], 'jd')},
        b AS (SELECT *, 1 AS rama FROM scored WHERE score > 0 AND sentimiento = 'positivo' AND categoria = 'economia' UNION ALL BY NAME
              SELECT * REPLACE (0.0 AS score), 2 AS rama FROM scored WHERE sentimiento = 'positivo' AND categoria = 'economia' UNION ALL BY NAME SELECT *, 3 AS rama FROM scored WHERE score > 0)
        SELECT doc_id, categoria, sentimiento, round(score, 6) AS score FROM b WHERE rama = (SELECT min(rama) FROM b) ORDER BY round(score, 9) DESC, doc_id LIMIT 5""",
    "similar_documents": f"""WITH {DOCS}, {tfidf_sql(1000, True)}, c AS (SELECT a.doc_id AS i, b.doc_id AS j, sum(a.w * b.w) AS coseno FROM weights a JOIN weights b USING (term) WHERE a.doc_id % 50 = 0 AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(coseno, 9) DESC, j DESC) AS rango FROM c) SELECT i, j, round(coseno, 6) AS coseno, rango FROM r WHERE rango <= 3""",
    "embedding_neighbors": f"WITH {_NEAR} SELECT i, j, round(coseno, 6) AS coseno, rn AS rango FROM near WHERE rn <= 5",
    "recommend_item": f"""WITH {_NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY coseno DESC, j) AS rango FROM near WHERE rn <= 50) SELECT i, j, round(coseno, 6) AS coseno, rango FROM r WHERE rango <= 3""",
    "recommend_exclude_category": f"""WITH {_NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY coseno DESC, j) AS rango FROM near WHERE li IS DISTINCT FROM lj)
        SELECT i, j, round(coseno, 6) AS coseno, rango FROM r WHERE rango <= 3""",
    "recommend_profile": f"""WITH {_NEAR}, s AS (SELECT i % 3 AS perfil, j, round(sum(coseno), 9) AS afinidad FROM near GROUP BY 1, 2),
        f AS (SELECT * FROM s WHERE afinidad > 0 AND NOT EXISTS (SELECT 1 FROM near n WHERE n.i = s.j AND n.i % 3 = s.perfil)),
        r AS (SELECT *, row_number() OVER (PARTITION BY perfil ORDER BY afinidad DESC, j DESC) AS rango FROM f) SELECT perfil, j, round(afinidad, 6) AS afinidad, rango FROM r WHERE rango <= 3""",
}
