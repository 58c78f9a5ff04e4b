"""Question answering over a corpus and dialogues with memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.functions import lexicons
from tamiz.functions.text import contains_any, fold, words
from tamiz.operators.search import query_vector, tfidf_terms

# Words that say nothing in a question.
QUESTION_STOPWORDS = [
    "a", "al", "algo", "cual", "cuando", "cuanto", "cuantos", "de", "del", "dice", "el", "en", "es", "esa",
    "ese", "hay", "la", "las", "lo", "los", "me", "noticia", "noticias", "que", "sobre", "un", "una",
]
FALLBACK_SHARE = 0.05


def intent(question: Column, rules: list[tuple[str, list[str]]] = lexicons.QUESTION_INTENTS) -> Column:
    """The first intent one of whose substrings the folded question holds, ``busqueda`` otherwise."""
    plain = fold(F.coalesce(question, F.lit("")))
    out = F.lit("busqueda")
    for name, needles in reversed(rules):
        out = F.when(contains_any(plain, needles), name).otherwise(out)
    return out


def refers_back(question: Column) -> Column:
    """Whether a question refers to what was said before: a word by itself, a phrase as a substring."""
    plain = fold(F.coalesce(question, F.lit("")))
    single = F.array(*[F.lit(w) for w in lexicons.REFERENCES if " " not in w])
    return F.arrays_overlap(words(plain), single) | contains_any(plain, [w for w in lexicons.REFERENCES if " " in w])


def topics(question: Column) -> Column:
    """Topics whose words a question holds, in their fixed order."""
    tokens = words(fold(F.coalesce(question, F.lit(""))))
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in ws])), F.lit(name)) for name, ws in lexicons.DIALOGUE_TOPICS]))


def question_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, tipo, contexto, respuesta): what can be asked of each article, three rows each."""
    title, body = F.coalesce("titulo", F.lit("")), F.coalesce("cuerpo", F.lit(""))
    category, mood = F.coalesce("categoria", F.lit("sin categoria")), F.coalesce("sentimiento", F.lit("sin sentimiento"))
    rows = [
        F.struct(F.lit("contenido").alias("tipo"), F.concat(title, F.lit(" "), body).alias("contexto"), F.concat(title, F.lit(". "), body).alias("respuesta")),
        F.struct(F.lit("categoria").alias("tipo"), F.concat(F.lit("categoria tema tipo "), category, F.lit(" "), title).alias("contexto"), F.concat(F.lit("Esa noticia pertenece a la categoria '"), category, F.lit("': "), title).alias("respuesta")),
        F.struct(F.lit("sentimiento").alias("tipo"), F.concat(F.lit("sentimiento opinion tono "), mood, F.lit(" "), title).alias("contexto"), F.concat(F.lit("El tono de esa noticia es "), mood, F.lit(": "), title).alias("respuesta")),
    ]
    return docs.select("doc_id", F.explode(F.array(*rows)).alias("x")).select("doc_id", "x.*")


def answer(docs: DataFrame, question: str, max_features: int = 2000) -> DataFrame:
    """(doc_id, tipo, respuesta, confianza): the pair nearest to a question, none below the least share; ties by order."""
    order = F.when(F.col("tipo") == "contenido", 0).when(F.col("tipo") == "categoria", 1).otherwise(2)
    pairs = question_pairs(docs).withColumn("_doc", F.col("doc_id")).withColumn("doc_id", F.col("doc_id") * 3 + order)
    weights, vocabulary = tfidf_terms(pairs, fold(F.col("contexto")), max_features, stopwords=QUESTION_STOPWORDS)
    vector = query_vector(docs.sparkSession, question, vocabulary, stopwords=QUESTION_STOPWORDS)
    cosines = weights.join(F.broadcast(vector), "term").groupBy("doc_id").agg(F.sum(F.col("w") * F.col("qw")).alias("confianza"))
    best = cosines.orderBy(F.desc(F.round("confianza", 9)), "doc_id").limit(1).where(F.col("confianza") >= FALLBACK_SHARE)
    return pairs.join(F.broadcast(best), "doc_id").select(F.col("_doc").alias("doc_id"), "tipo", "respuesta", "confianza")


def category_answer(docs: DataFrame, category: str = "categoria") -> DataFrame:
    """(categoria, total, ejemplo): size of each category and its first title."""
    return docs.groupBy(category).agg(F.count("*").alias("total"), F.min_by("titulo", "doc_id").alias("ejemplo"))


def previous_turn(turns: DataFrame, session: str, order: str, text: str) -> DataFrame:
    """Add ``consulta``: a question that refers back is put behind the one before it."""
    before = F.lag(text).over(Window.partitionBy(session).orderBy(order))
    expanded = F.concat_ws(" ", before, F.col(text))
    return turns.withColumn("consulta", F.when(refers_back(F.col(text)) & before.isNotNull(), expanded).otherwise(F.col(text)))


def _raised_so_far(frame, topic_array: Column, order: str) -> Column:
    """The topic raised most often within a window frame, ties to the one raised first; null before any.

    The topics are a fixed short list, so their counters are running sums of one
    window, and no session is ever gathered into memory.
    """
    entries = []
    for position, (name, _) in enumerate(lexicons.DIALOGUE_TOPICS):
        raised = F.array_contains(topic_array, name)
        count = F.coalesce(F.sum(raised.cast("int")).over(frame), F.lit(0))
        first = F.min(F.when(raised, F.col(order))).over(frame)
        entries.append(F.struct((-count).alias("n"), first.alias("first"), F.lit(position).alias("k"), F.lit(name).alias("name")))
    best = F.try_element_at(F.array_sort(F.filter(F.array(*entries), lambda e: e["n"] < 0)), F.lit(1))
    return best["name"]


def running_topic(turns: DataFrame, session: str, order: str, text: str) -> DataFrame:
    """(session, order, tema_dominante): topic most often raised so far, ties to the one raised first."""
    frame = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    raised = turns.select(session, order, topics(F.col(text)).alias("_t"))
    return raised.select(session, order, _raised_so_far(frame, F.col("_t"), order).alias("tema_dominante"))


def session_stats(turns: DataFrame, session: str, text: str) -> DataFrame:
    """(session, tipo, n): turns of each intent."""
    return turns.groupBy(session, intent(F.col(text), lexicons.DIALOGUE_INTENTS).alias("tipo")).agg(F.count("*").alias("n"))


def dialogue_turns(turns: DataFrame, session: str, order: str, text: str) -> DataFrame:
    """(session, order, tipo, consulta, tema): how each turn is to be answered, given those before it.

    A blank turn is a ``fallback`` and is not remembered; a structured intent
    comes before all else; a reference back, once something was said, is
    ``contextual`` and asked together with the question before it; other
    searches are ``personalizada`` with their own topic, or the one most raised
    so far, and ``directa`` without any. All of it is running windows of a
    session.
    """
    question = F.coalesce(F.col(text), F.lit(""))
    blank = F.trim(question) == ""
    read = turns.select(session, order, question.alias("_q"), blank.alias("_blank"), intent(F.col(text), lexicons.DIALOGUE_INTENTS).alias("_i"), refers_back(F.col(text)).alias("_r"), F.when(~blank, topics(F.col(text))).otherwise(F.array().cast("array<string>")).alias("_t"))
    before = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    read = read.withColumn("_last", F.last(F.when(~F.col("_blank"), F.col("_q")), True).over(before)).withColumn("_most", _raised_so_far(before, F.col("_t"), order))
    searched = F.col("_i") == "busqueda"
    topic = F.coalesce(F.try_element_at("_t", F.lit(1)), F.col("_most"))
    back = searched & F.col("_r") & F.col("_last").isNotNull()
    kind = F.when(F.col("_blank"), "fallback").when(~searched, F.col("_i")).when(back, "contextual").when(topic.isNotNull(), "personalizada").otherwise("directa")
    asked = F.when(~F.col("_blank") & back, F.concat_ws(" ", "_last", "_q")).otherwise(F.col("_q"))
    return read.select(session, order, kind.alias("tipo"), asked.alias("consulta"), F.when(kind == "personalizada", topic).alias("tema"))
