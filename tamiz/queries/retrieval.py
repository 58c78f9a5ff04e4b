"""Retrieval measures, question answering and dialogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamiz.functions import lexicons
from tamiz.functions.text import fold, words
from tamiz.operators import dialogue, evaluation, search
from tamiz.queries.base import DOCS, WORDS, documents, news, sql_list, tfidf_sql
from tamiz.session import read_table

# Queries of the comparison, with the category whose documents count as relevant.
JUDGED = [("q1", "banco deuda precio", "es"), ("q2", "the public hospital", "en"), ("q3", "partido gol torneo", "es"), ("q4", "da prefeitura para", "pt")]


def _rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings of each query: documents that hold all its words in order of number, and by TF-IDF cosine."""
    return search.rankings(documents(spark, sf_dir), {q: text for q, text, _ in JUDGED})


def _judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    relevant = spark.createDataFrame([(q, c) for q, _, c in JUDGED], "consulta string, categoria string")
    return documents(spark, sf_dir).select("doc_id", "categoria").join(F.broadcast(relevant), "categoria").select("consulta", "doc_id")


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.measures(_rankings(spark, sf_dir), _judgments(spark, sf_dir))


def ir_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).select("consulta", "modelo", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "p_at_k", "ap")))


def ir_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.macro(_measured(spark, sf_dir)).select("modelo", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "p_at_k", "map")))


def ir_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.winners(evaluation.macro(_measured(spark, sf_dir)), "booleano", "vectorial")


def ir_conclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.conclusion(evaluation.macro(_measured(spark, sf_dir)))


def ir_generated_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return evaluation.generated_queries(docs.withColumn("_t", words(fold(search.document_text(docs)))), "_t")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of sessions: the titles of each author's records, in order of arrival; a record without an author is a session of its own."""
    author = F.coalesce(F.nullif(F.trim("autor"), F.lit("")), F.concat(F.lit("@desconocido_"), F.col("pos").cast("string")))
    return news(spark, sf_dir).select(author.alias("sesion"), F.col("pos").alias("turno"), F.concat_ws(" ", F.when(F.col("pos") % 7 == 0, "dame mas sobre eso").when(F.col("pos") % 5 == 0, "¿cuántas noticias del tema?"), "titulo").alias("pregunta"))


def question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _questions(spark, sf_dir)
    return q.select("turno", dialogue.intent(F.col("pregunta")).alias("intencion"), dialogue.intent(F.col("pregunta"), lexicons.DIALOGUE_INTENTS).alias("intencion_dialogo"), dialogue.refers_back(F.col("pregunta")).alias("referencia"))


def question_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("turno", F.array_join(dialogue.topics(F.col("pregunta")), ",").alias("temas"))


def question_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    mood, category = search.query_filters(F.coalesce("titulo", F.lit("")))
    return news(spark, sf_dir).select("pos", F.coalesce(mood, F.lit("")).alias("sentimiento"), F.coalesce(category, F.lit("")).alias("categoria"))


def previous_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.previous_turn(_questions(spark, sf_dir), "sesion", "turno", "pregunta").select("sesion", "turno", "consulta")


def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.session_stats(_questions(spark, sf_dir), "sesion", "pregunta")


def running_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.running_topic(_questions(spark, sf_dir), "sesion", "turno", "pregunta").na.fill("", ["tema_dominante"])


def dialogue_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each question of a session is to be answered, given those before it."""
    return dialogue.dialogue_turns(_questions(spark, sf_dir), "sesion", "turno", "pregunta").na.fill("", ["tema"])


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("sentimiento", F.when(F.col("doc_id") % 2 == 0, "positivo"))


def question_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.question_pairs(_asked(spark, sf_dir))


def question_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dialogue.answer(_asked(spark, sf_dir), "qué dice la noticia sobre la inflación y el salario mínimo")
    return found.select("doc_id", "tipo", "respuesta", F.round("confianza", 6).alias("confianza"))


def category_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.category_answer(documents(spark, sf_dir))


def item_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "eval_items")
    return items.groupBy("conjunto", "tarea", dialogue.intent(F.col("pregunta")).alias("intencion")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        ir_measures, ir_averages, ir_winners, ir_conclusion, ir_generated_queries, question_intents, question_topics, question_filters, previous_turn, session_stats, running_topic, dialogue_turns,
        question_pairs, question_answer, category_answer, item_topics,
    )
}

_ASKED = ", ".join(f"('{q}', {sql_list(text.split())}, '{c}')" for q, text, c in JUDGED)
_MEASURES = f"""{DOCS}, jq AS (SELECT * FROM (VALUES {_ASKED}) AS v(consulta, q, categoria)),
    held AS (SELECT doc_id, list_distinct({WORDS}) AS w FROM docs), {tfidf_sql(None, False)},
    qg AS (SELECT consulta, unnest(q || list_transform(range(1, len(q)), lambda i: q[i] || ' ' || q[i + 1])) AS term FROM jq),
    qv AS (SELECT consulta, term, count(*) * any_value(idf) AS r FROM qg JOIN voc USING (term) GROUP BY 1, 2),
    qn AS (SELECT consulta, term, r / sqrt(sum(r * r) OVER (PARTITION BY consulta)) AS qw FROM qv),
    cs AS (SELECT consulta, doc_id, round(sum(w * qw), 9) AS s FROM weights JOIN qn USING (term) GROUP BY 1, 2),
    rk AS (SELECT consulta, 'booleano' AS modelo, doc_id, row_number() OVER (PARTITION BY consulta ORDER BY doc_id) AS rango FROM held JOIN jq ON list_has_all(w, q)
           UNION ALL SELECT consulta, 'vectorial', doc_id, row_number() OVER (PARTITION BY consulta ORDER BY s DESC, doc_id DESC) FROM cs WHERE s > 0),
    rel AS (SELECT consulta, doc_id FROM docs JOIN jq USING (categoria)), sz AS (SELECT consulta, count(*) AS r FROM rel GROUP BY 1),
    hit AS (SELECT rk.*, CASE WHEN rel.doc_id IS NULL THEN 0 ELSE 1 END AS h FROM rk LEFT JOIN rel USING (consulta, doc_id)),
    run AS (SELECT hit.*, sum(h) OVER (PARTITION BY consulta, modelo ORDER BY rango) AS f, max(rango) OVER (PARTITION BY consulta, modelo) AS n, r FROM hit LEFT JOIN sz USING (consulta)),
    agg AS (SELECT consulta, modelo, sum(h) / count(*) AS precision, coalesce(sum(h) / max(r), 0) AS recall,
            count(*) FILTER (h = 1 AND rango <= least(5, greatest(n, coalesce(r, 0), 1))) / max(least(5, greatest(n, coalesce(r, 0), 1))) AS p_at_k, coalesce(sum(f / rango) FILTER (h = 1) / max(r), 0) AS ap FROM run GROUP BY 1, 2),
    mea AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM agg)"""


def _intent_sql(column: str, rules: list[tuple[str, list[str]]]) -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains({column}, '{w}')" for w in ws) + f" THEN '{name}'" for name, ws in rules)
    return f"CASE {cases} ELSE 'busqueda' END"


_ASKING = """qs AS (SELECT coalesce(nullif(trim(autor), ''), '@desconocido_' || pos) AS sesion, pos AS turno, concat_ws(' ', CASE WHEN pos % 7 = 0 THEN 'dame mas sobre eso' WHEN pos % 5 = 0 THEN '¿cuántas noticias del tema?' END, titulo) AS pregunta FROM noticias),
    fq AS (SELECT *, strip_accents(lower(coalesce(pregunta, ''))) AS p FROM qs)"""
_BACK = rf"(list_has_any(regexp_extract_all(p, '[\p{{L}}\p{{N}}_]+'), {sql_list([w for w in lexicons.REFERENCES if ' ' not in w])}) OR " + " OR ".join(f"contains(p, '{w}')" for w in lexicons.REFERENCES if " " in w) + ")"
_TOPICS = ", ".join(rf"CASE WHEN list_has_any(regexp_extract_all(p, '[\p{{L}}\p{{N}}_]+'), {sql_list(ws)}) THEN '{name}' END" for name, ws in lexicons.DIALOGUE_TOPICS)


def _most_raised(frame: str) -> str:
    """The topic raised most within a window frame, ties to the first one raised."""
    rows = ", ".join(f"{{'n': -coalesce(sum(CAST(list_contains(tt, '{name}') AS INTEGER)) OVER {frame}, 0), 'f': min(CASE WHEN list_contains(tt, '{name}') THEN turno END) OVER {frame}, 'k': {k}, 't': '{name}'}}" for k, (name, _) in enumerate(lexicons.DIALOGUE_TOPICS))
    return f"list_sort(list_filter([{rows}], lambda e: e.n < 0))[1].t"


_RAISED = f"{_ASKING}, ra AS (SELECT *, trim(coalesce(pregunta, '')) = '' AS blank, CASE WHEN trim(coalesce(pregunta, '')) = '' THEN CAST([] AS VARCHAR[]) ELSE list_filter([{_TOPICS}], lambda t: t IS NOT NULL) END AS tt FROM fq)"
_BEFORE = "(PARTITION BY sesion ORDER BY turno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_FILTER_CATEGORY = " ".join(f"WHEN contains(t, '{w}') THEN '{c}'" for w, c in lexicons.FILTER_CATEGORY)

ORACLES = {
    "ir_measures": f"WITH {_MEASURES} SELECT consulta, modelo, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(p_at_k, 6) AS p_at_k, round(ap, 6) AS ap FROM mea",
    "ir_averages": f"WITH {_MEASURES} SELECT modelo, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(p_at_k), 6) AS p_at_k, round(avg(ap), 6) AS map FROM mea GROUP BY 1",
    "ir_winners": f"""WITH {_MEASURES}, a AS (SELECT modelo, avg(precision) AS p, avg(f1) AS f, avg(ap) AS m FROM mea GROUP BY 1), b AS (SELECT * FROM a WHERE modelo = 'booleano'), v AS (SELECT * FROM a WHERE modelo = 'vectorial')
        SELECT medida, CASE WHEN y > x THEN 'vectorial' ELSE 'booleano' END AS ganador FROM (SELECT 'precision' AS medida, (SELECT p FROM b) AS x, (SELECT p FROM v) AS y UNION ALL SELECT 'f1', (SELECT f FROM b), (SELECT f FROM v) UNION ALL SELECT 'map', (SELECT m FROM b), (SELECT m FROM v))""",
    "ir_conclusion": f"""WITH {_MEASURES}, a AS (SELECT max(f) FILTER (modelo = 'booleano') AS b, max(f) FILTER (modelo = 'vectorial') AS v FROM (SELECT modelo, avg(f1) AS f FROM mea GROUP BY 1))
        SELECT CASE WHEN abs(v - b) < 0.05 THEN printf('Ambos modelos tienen rendimiento similar (F1 Booleano=%.3f, Vectorial=%.3f). El modelo vectorial es preferible por su ranking graduado.', b, v)
            WHEN v > b THEN printf('El modelo vectorial supera al rival en F1 promedio (Booleano=%.3f, Vectorial=%.3f). El modelo vectorial captura similitud semantica parcial.', b, v)
            ELSE printf('El modelo booleano supera al rival en F1 promedio (Booleano=%.3f, Vectorial=%.3f). El modelo booleano ofrece mayor exactitud en este corpus.', b, v) END AS conclusion FROM a""",
    "ir_generated_queries": f"""WITH {DOCS}, l AS (SELECT categoria, count(*) AS documentos FROM docs WHERE categoria NOT IN ('', 'sin_categoria') GROUP BY 1 ORDER BY documentos DESC, categoria LIMIT 5),
        t AS (SELECT categoria, documentos, unnest({WORDS}) AS t FROM docs JOIN l USING (categoria)), c AS (SELECT categoria, documentos, t, count(*) AS n FROM t WHERE length(t) > 3 GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY categoria ORDER BY n DESC, t) AS r FROM c) SELECT categoria, documentos, string_agg(t, ' ' ORDER BY r) AS consulta FROM r WHERE r <= 3 GROUP BY 1, 2""",
    "question_intents": f"WITH {_ASKING} SELECT turno, {_intent_sql('p', lexicons.QUESTION_INTENTS)} AS intencion, {_intent_sql('p', lexicons.DIALOGUE_INTENTS)} AS intencion_dialogo, {_BACK} AS referencia FROM fq",
    "question_topics": f"WITH {_ASKING} SELECT turno, array_to_string(list_filter([{_TOPICS}], lambda t: t IS NOT NULL), ',') AS temas FROM fq",
    "question_filters": f"""WITH x AS (SELECT pos, lower(coalesce(titulo, '')) AS t FROM noticias) SELECT pos, CASE WHEN {" OR ".join(f"contains(t, '{w}')" for w in lexicons.FILTER_POSITIVE)} THEN 'positivo'
        WHEN {" OR ".join(f"contains(t, '{w}')" for w in lexicons.FILTER_NEGATIVE)} THEN 'negativo' ELSE '' END AS sentimiento, CASE {_FILTER_CATEGORY} ELSE '' END AS categoria FROM x""",
    "previous_turn": f"""WITH {_ASKING}, l AS (SELECT *, lag(pregunta) OVER (PARTITION BY sesion ORDER BY turno) AS antes FROM fq)
        SELECT sesion, turno, CASE WHEN {_BACK} AND antes IS NOT NULL THEN concat_ws(' ', antes, pregunta) ELSE pregunta END AS consulta FROM l""",
    "session_stats": f"WITH {_ASKING} SELECT sesion, {_intent_sql('p', lexicons.DIALOGUE_INTENTS)} AS tipo, count(*) AS n FROM fq GROUP BY 1, 2",
    "question_pairs": f"""WITH {DOCS}, a AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'positivo' ELSE 'sin sentimiento' END AS s FROM docs)
        SELECT doc_id, 'categoria' AS tipo, 'categoria tema tipo ' || categoria || ' ' || coalesce(titulo, '') AS contexto, 'Esa noticia pertenece a la categoria ''' || categoria || ''': ' || coalesce(titulo, '') AS respuesta FROM a
        UNION ALL SELECT doc_id, 'contenido', coalesce(titulo, '') || ' ' || coalesce(cuerpo, ''), coalesce(titulo, '') || '. ' || coalesce(cuerpo, '') FROM a
        UNION ALL SELECT doc_id, 'sentimiento', 'sentimiento opinion tono ' || s || ' ' || coalesce(titulo, ''), 'El tono de esa noticia es ' || s || ': ' || coalesce(titulo, '') FROM a""",
    "category_answer": f"WITH {DOCS} SELECT categoria, count(*) AS total, arg_min(titulo, doc_id) AS ejemplo FROM docs GROUP BY 1",
    "item_topics": f"WITH x AS (SELECT conjunto, tarea, strip_accents(lower(coalesce(pregunta, ''))) AS p FROM eval_items) SELECT conjunto, tarea, {_intent_sql('p', lexicons.QUESTION_INTENTS)} AS intencion, count(*) AS n FROM x GROUP BY 1, 2, 3",
    "running_topic": f"WITH {_RAISED} SELECT sesion, turno, coalesce({_most_raised('(PARTITION BY sesion ORDER BY turno ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')}, '') AS tema_dominante FROM ra",
    "dialogue_turns": f"""WITH {_RAISED}, b AS (SELECT *, {_intent_sql('p', lexicons.DIALOGUE_INTENTS)} AS i, {_BACK} AS r, last_value(CASE WHEN NOT blank THEN coalesce(pregunta, '') END IGNORE NULLS) OVER {_BEFORE} AS la, {_most_raised(_BEFORE)} AS mo FROM ra),
        t AS (SELECT *, coalesce(tt[1], mo) AS top, i = 'busqueda' AND r AND la IS NOT NULL AS bk FROM b),
        k AS (SELECT *, CASE WHEN blank THEN 'fallback' WHEN i <> 'busqueda' THEN i WHEN bk THEN 'contextual' WHEN top IS NOT NULL THEN 'personalizada' ELSE 'directa' END AS tipo FROM t)
        SELECT sesion, turno, tipo, CASE WHEN NOT blank AND bk THEN la || ' ' || pregunta ELSE coalesce(pregunta, '') END AS consulta, CASE WHEN tipo = 'personalizada' THEN top ELSE '' END AS tema FROM k""",
}
