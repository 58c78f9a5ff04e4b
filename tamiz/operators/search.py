"""Inverted index, boolean and vector search, and natural-language filters over (doc_id, titulo, cuerpo, ...)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.functions import lexicons
from tamiz.functions.text import contains_any, fold, long_words, ngrams, snippet, without, words
from tamiz.operators.ranking import ranked
from tamiz.operators.similarity import BLOCK, meet
from tamiz.session import broadcast_if_small, materialise

#: Terms of one matrix product; more are added strip by strip.
STRIP = 4096


def document_text(docs: DataFrame) -> Column:
    """Title and body with a space between; a missing part is empty."""
    return F.concat(F.coalesce(docs["titulo"], F.lit("")), F.lit(" "), F.coalesce(docs["cuerpo"], F.lit("")))


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of the folded words of title and body. An empty corpus gives no rows."""
    tokens = docs.select("doc_id", F.explode(words(fold(document_text(docs)))).alias("term"))
    return tokens.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def index_info(index: DataFrame, docs: DataFrame) -> DataFrame:
    """(documentos_indexados, terminos_en_indice, tamano_promedio_posting)."""
    sizes = index.groupBy("term").agg(F.count("*").alias("n")).agg(F.count("*").alias("terminos_en_indice"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("tamano_promedio_posting"))
    return sizes.crossJoin(docs.agg(F.count("*").alias("documentos_indexados")))


def query_terms(query: str) -> list[str]:
    """Folded words of a query text."""
    import re
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", query.lower()) if not unicodedata.combining(c))
    return re.findall(r"\w+", plain)


def boolean_search(docs: DataFrame, query: str, mode: str = "AND") -> DataFrame:
    """doc_id of the documents that hold all (AND) or any (OR) of the query's words.

    The words are pushed into the scan of the tokens, so that only their
    postings are counted. A query without words finds nothing.
    """
    if mode.upper() not in ("AND", "OR"):
        raise ValueError("mode must be AND or OR")
    terms = sorted(set(query_terms(query)))
    tokens = F.array_distinct(words(fold(document_text(docs))))
    held = F.size(F.array_intersect(tokens, F.array(*[F.lit(t) for t in terms]))) if terms else F.lit(0)
    need = len(terms) if mode.upper() == "AND" else 1
    return docs.where(held >= max(need, 1)).select("doc_id")


def tfidf_terms(docs: DataFrame, text: Column, max_features: int | None = None, max_n: int = 2, sublinear: bool = False, stopwords: list[str] | None = None, only: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """((doc_id, term, w), (term, df, idf)): L2-normalised TF-IDF over 1..max_n-grams.

    idf = ln((1 + N) / (1 + df)) + 1; the vocabulary is the ``max_features``
    terms of greatest corpus count, ties by term. Documents without a term of
    the vocabulary have no rows. The vocabulary is counted over all documents,
    by term alone, so that every partition sends each of its terms once; a
    limited one is written once and cuts the terms of documents before they are
    shuffled. ``only`` restricts the weights, not the vocabulary, to the documents
    for which it holds.
    """
    tokens = long_words(text)
    if stopwords:
        tokens = without(tokens, stopwords)

    # The tokens are a column of their own, right below the explosion of the n-grams: inside their lambdas they would be cut anew for every position.
    cut = docs.select("doc_id", tokens.alias("_tok"))
    grams = F.col("_tok")
    for n in range(2, max_n + 1):
        grams = F.concat(grams, ngrams(F.col("_tok"), n))
    once = cut.select(F.explode(F.array_distinct(grams)).alias("term"), F.lit(1).alias("_d"), F.lit(0).alias("_t"))
    each = cut.select(F.explode(grams).alias("term"), F.lit(0).alias("_d"), F.lit(1).alias("_t"))
    vocabulary = once.unionByName(each).groupBy("term").agg(F.sum("_d").alias("df"), F.sum("_t").alias("total"))
    if max_features is not None:
        vocabulary = vocabulary.orderBy(F.desc("total"), "term").limit(max_features)
    total = docs.count()
    vocabulary = materialise(vocabulary.select("term", "df", (F.log((1.0 + total) / (1.0 + F.col("df"))) + 1.0).alias("idf")), "vocabulary")
    small = broadcast_if_small(vocabulary)
    chosen = cut if only is None else docs.where(only).select("doc_id", tokens.alias("_tok"))
    terms = chosen.select("doc_id", F.explode(grams).alias("term"))
    if max_features is not None:
        # The idf rides along, so that the vocabulary is met once.
        counted = terms.join(small, "term").groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("idf").alias("idf"))
    else:
        counted = terms.groupBy("doc_id", "term").agg(F.count("*").alias("tf")).join(small, "term")
    tf = (1.0 + F.log(F.col("tf").cast("double"))) if sublinear else F.col("tf").cast("double")
    weighted = counted.select("doc_id", "term", (tf * F.col("idf")).alias("raw"))
    norms = weighted.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return weighted.join(norms, "doc_id").select("doc_id", "term", (F.col("raw") / F.col("norm")).alias("w")), vocabulary


def query_vector(spark, query: str, vocabulary: DataFrame, max_n: int = 2, stopwords: list[str] | None = None) -> DataFrame:
    """(term, qw) of a query text with the vocabulary's idf; unknown terms are left aside."""
    stop = set(stopwords or [])
    tokens = [t for t in query_terms(query) if len(t) >= 2 and t not in stop]
    grams = list(tokens)
    for n in range(2, max_n + 1):
        grams += [" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1)]
    counts = {g: float(grams.count(g)) for g in grams}
    terms = spark.createDataFrame(list(counts.items()) or [("", 0.0)], "term string, tf double")
    raw = F.broadcast(terms).join(vocabulary, "term").select("term", (F.col("tf") * F.col("idf")).alias("raw"))
    # A query has a handful of terms: the sum over them is one row.
    return raw.withColumn("qw", F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(F.lit(1))))).select("term", "qw")


def adjusted_score(query: str, title: Column, body: Column, cosine: Column) -> Column:
    """Cosine, plus 1 for the whole query in the title, 0.7 and 0.2 of the share of its words in title and text."""
    phrase = F.lit(" ".join(query.split()))
    significant = without(words(fold(phrase)), lexicons.SEARCH_STOPWORDS, 3)
    wanted = F.array_distinct(significant)
    folded_title, folded_body = fold(title), fold(body)
    in_title = F.size(F.array_intersect(wanted, words(folded_title)))
    in_text = F.size(F.array_intersect(wanted, words(F.concat(folded_title, F.lit(" "), folded_body))))
    n = F.size(wanted)
    whole = F.when(F.contains(folded_title, fold(F.lit(query))) & (F.length(F.lit(query)) > 0), 1.0).otherwise(0.0)
    overlap = F.when(n > 0, in_title / n * 0.7 + in_text / n * 0.2).otherwise(0.0)
    return cosine + whole + overlap


def vector_search(docs: DataFrame, query: str, top_k: int | None = 5, max_features: int = 3000) -> DataFrame:
    """(doc_id, titulo, relevancia, score, snippet) of the best documents, ties by doc_id; only scores above 0."""
    text = fold(document_text(docs))
    asked = F.array(*[F.lit(t) for t in query_terms(query)] or [F.lit("")])
    # Only documents with a word of the query have a cosine above 0.
    weights, vocabulary = tfidf_terms(docs, text, max_features, only=F.arrays_overlap(long_words(text), asked))
    vector = query_vector(docs.sparkSession, query, vocabulary)
    cosines = weights.join(F.broadcast(vector), "term").groupBy("doc_id").agg(F.sum(F.col("w") * F.col("qw")).alias("relevancia"))
    joined = docs.join(cosines, "doc_id", "left").withColumn("relevancia", F.coalesce("relevancia", F.lit(0.0)))
    title, body = F.coalesce("titulo", F.lit("")), F.coalesce("cuerpo", F.lit(""))
    scored = joined.withColumn("score", adjusted_score(query, title, body, F.col("relevancia"))).where("score > 0")
    scored = scored.withColumn("snippet", snippet(body, 500))
    return scored.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(top_k) if top_k is not None else scored


def cosines(docs: DataFrame, queries: dict[str, str], max_features: int | None = None, max_n: int = 2) -> DataFrame:
    """(consulta, doc_id, coseno) of every query text (name -> text) and document with a term in common."""
    weights, vocabulary = tfidf_terms(docs, fold(document_text(docs)), max_features, max_n)
    grams: list[tuple[str, str, float]] = []
    for name, text in queries.items():
        tokens = [t for t in query_terms(text) if len(t) >= 2]
        held = [" ".join(tokens[i : i + n]) for n in range(1, max_n + 1) for i in range(len(tokens) - n + 1)]
        grams += [(name, g, float(held.count(g))) for g in sorted(set(held))]
    asked = docs.sparkSession.createDataFrame(grams, "consulta string, term string, tf double")
    # The queries are stated in the program: their terms are few, and only these postings meet them.
    vector = materialise(vocabulary.join(broadcast_if_small(asked), "term").select("consulta", "term", (F.col("tf") * F.col("idf")).alias("q")), "queries")
    norms = vector.groupBy("consulta").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("norm"))
    vector = vector.join(broadcast_if_small(norms), "consulta").select("consulta", "term", (F.col("q") / F.col("norm")).alias("q"))
    return weights.join(broadcast_if_small(vector), "term").groupBy("consulta", "doc_id").agg(F.sum(F.col("w") * F.col("q")).alias("coseno"))


def rankings(docs: DataFrame, queries: dict[str, str]) -> DataFrame:
    """(consulta, modelo, rango, doc_id): documents that hold all words of a query by number, and by cosine (ties by greater number)."""
    held = docs.select("doc_id", F.array_distinct(words(fold(document_text(docs)))).alias("_w"))
    asked = docs.sparkSession.createDataFrame([(q, query_terms(text)) for q, text in queries.items()], "consulta string, _q array<string>")
    all_ = held.join(broadcast_if_small(asked), (F.size("_q") > 0) & F.forall("_q", lambda t: F.array_contains("_w", t)))
    boolean = all_.select("consulta", F.lit("booleano").alias("modelo"), "doc_id", F.lit(0.0).alias("_s"), (-F.col("doc_id")).alias("_d"))
    near = cosines(docs, queries).where("coseno > 0").select("consulta", F.lit("vectorial").alias("modelo"), "doc_id", F.round("coseno", 9).alias("_s"), F.col("doc_id").alias("_d"))
    return ranked(boolean.unionByName(near), ["consulta", "modelo"], [F.desc("_s"), F.desc("_d")]).select("consulta", "modelo", "rango", "doc_id")


def federated_search(sources: dict[str, DataFrame], query: str, top_k: int = 10) -> DataFrame:
    """:func:`vector_search` over several sources (name -> (doc_id, titulo, cuerpo)) as one corpus; ``fuente`` names a result's source."""
    parts = [df.select((F.col("doc_id") * len(sources) + i).alias("doc_id"), "titulo", "cuerpo", F.lit(name).alias("fuente"), F.col("doc_id").alias("id")) for i, (name, df) in enumerate(sources.items())]
    found = vector_search(reduce(DataFrame.unionByName, parts), query, top_k)
    return found.select("fuente", "id", "titulo", "relevancia", "score", "snippet")


#: Least score of the best result for which the corpus at hand is enough.
ENOUGH = 0.18


def search_with_fallback(corpus: DataFrame, query: str, sources: dict[str, DataFrame], top_k: int = 10) -> DataFrame:
    """Results of the corpus if the best one scores ``ENOUGH`` and has a significant word of the query, else of the sources, else of the corpus."""
    own = vector_search(corpus, query, top_k)
    wanted = F.array(*[F.lit(t) for t in query_terms(query) if len(t) >= 3 and t not in lexicons.SEARCH_STOPWORDS] or [F.lit("")])
    held = words(fold(F.concat_ws(" ", "titulo", "snippet")))
    best = own.select("score", F.arrays_overlap(wanted, held).alias("covers")).limit(1).collect()
    own = own.select(F.lit("corpus_cargado").alias("fuente"), F.col("doc_id").alias("id"), "titulo", "relevancia", "score", "snippet")
    if best and best[0]["score"] >= ENOUGH and best[0]["covers"]:
        return own
    others = federated_search(sources, query, top_k) if sources else None
    return own if others is None or others.isEmpty() else others


#: Results that an answer of each kind is made of, and how many it needs.
ANSWERS = {"recomendacion": (3, 1), "comparacion": (2, 2), "busqueda": (1, 1)}


def search_answers(docs: DataFrame, query: str) -> DataFrame:
    """(tipo, rango, doc_id, titulo, relevancia): the results behind a recommendation, a comparison and a search answer."""
    best = vector_search(docs, query, max(n for n, _ in ANSWERS.values())).withColumn("rango", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "doc_id")))
    kinds = F.array(*[F.struct(F.lit(kind).alias("tipo"), F.lit(n).alias("n"), F.lit(least).alias("least")) for kind, (n, least) in ANSWERS.items()])
    rows = best.withColumn("_all", F.count("*").over(Window.partitionBy())).select("*", F.explode(kinds).alias("k"))
    return rows.where("rango <= k.n AND _all >= k.least").select("k.tipo", "rango", "doc_id", "titulo", "relevancia")


def query_filters(query: Column) -> tuple[Column, Column]:
    """(sentiment, category) that a question asks for, or null: the first of the fixed substrings found."""
    low = F.lower(query)
    sentiment = F.when(contains_any(low, lexicons.FILTER_POSITIVE), "positivo").when(contains_any(low, lexicons.FILTER_NEGATIVE), "negativo")
    category = F.coalesce(*[F.when(F.contains(low, F.lit(word)), F.lit(name)) for word, name in lexicons.FILTER_CATEGORY])
    return sentiment, category


def natural_search(docs: DataFrame, query: str, top_k: int = 3) -> DataFrame:
    """Ranked search with the question's filters on (sentimiento, categoria).

    Where no ranked document fits, the documents that fit the filters alone come
    in order of doc_id; where there are none either, the ranking as it is. The
    three branches are one plan: rows carry the number of their branch, and the
    least one is kept.
    """
    low = query.lower()
    sentiment = "positivo" if any(w in low for w in lexicons.FILTER_POSITIVE) else "negativo" if any(w in low for w in lexicons.FILTER_NEGATIVE) else None
    category = next((name for word, name in lexicons.FILTER_CATEGORY if word in low), None)
    fits = F.lit(True)
    if sentiment:
        fits = fits & F.col("sentimiento").eqNullSafe(sentiment)
    if category:
        fits = fits & F.col("categoria").eqNullSafe(category)
    ranked = vector_search(docs, query, None).select("doc_id", "titulo", "categoria", "sentimiento", "relevancia", "score")
    first = ranked.where(fits).withColumn("rama", F.lit(1))
    third = ranked.withColumn("rama", F.lit(3))
    rows = first.unionByName(third)
    if sentiment or category:
        second = docs.where(fits).select("doc_id", "titulo", "categoria", "sentimiento", F.lit(0.0).alias("relevancia"), F.lit(0.0).alias("score"), F.lit(2).alias("rama"))
        rows = rows.unionByName(second)
    best = rows.orderBy("rama", F.desc(F.round("score", 9)), "doc_id").limit(top_k)
    least = best.agg(F.min("rama").alias("_least"))
    return best.join(F.broadcast(least), F.col("rama") == F.col("_least")).drop("_least", "rama")


def top_terms(weights: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` heaviest terms of each document, ties by term descending."""
    ranked = weights.where("w > 0").withColumn("rango", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.round("w", 9)), F.desc("term"))))
    return ranked.where(F.col("rango") <= n)


def matrix_info(weights: DataFrame, vocabulary: DataFrame, docs: DataFrame) -> DataFrame:
    """(documentos, vocabulario, densidad, terminos_por_documento) of a TF-IDF matrix."""
    one = docs.agg(F.count("*").alias("documentos")).crossJoin(vocabulary.agg(F.count("*").alias("vocabulario"))).crossJoin(weights.agg(F.count("*").alias("celdas")))
    return one.select(
        "documentos",
        "vocabulario",
        F.coalesce(F.try_divide("celdas", F.col("documentos") * F.col("vocabulario")), F.lit(0.0)).alias("densidad"),
        F.coalesce(F.try_divide("celdas", "documentos"), F.lit(0.0)).alias("terminos_por_documento"),
    )


def _weight_blocks(rows: DataFrame, prefix: str, kind: str) -> DataFrame:
    """Rows (doc_id, _x: terms with weights) as blocks of up to ``BLOCK`` documents: ids, how many terms each has, and these in one list."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                ids, terms, weights = batch.slice(k, BLOCK).columns
                columns = [ids, pc.list_value_length(terms).cast(pa.int32()), terms.flatten(), weights.flatten()]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], names=names)

    names = [f"{prefix}_{x}" for x in ("ids", "sizes", "terms", "weights")]
    kinds = (kind, "int", "long", "double")
    return rows.select("doc_id", F.col("_x._t").alias("t"), F.col("_x.w").alias("w")).mapInArrow(gather, ", ".join(f"{n} array<{k}>" for n, k in zip(names, kinds, strict=True)))


def _dense(sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """A row of weights a document over the ``chosen`` terms, which are sorted."""
    out = np.zeros((len(sizes), len(chosen)))
    at = np.minimum(np.searchsorted(chosen, terms), len(chosen) - 1)
    held = chosen[at] == terms
    out[np.repeat(np.arange(len(sizes)), sizes)[held], at[held]] = weights[held]
    return out


def similar_documents(weights: DataFrame, queries: DataFrame, n: int = 3) -> DataFrame:
    """(i, j, coseno, rango): the ``n`` nearest documents of each document in ``queries`` (doc_id), ties j descending.

    Exact: the weights are held by document, in blocks, and every block of
    queries meets every block of documents in one matrix product, of which only
    the best ``n`` a query leave the task. So the pairs, which grow as the square
    of the documents, are never rows of a shuffle. Documents without a common
    term are no pair.
    """
    kind = weights.schema["doc_id"].dataType.simpleString()
    numbered = materialise(weights.select("term").distinct().withColumn("_t", F.monotonically_increasing_id()), "terms")
    listed = weights.where("doc_id IS NOT NULL").join(broadcast_if_small(numbered), "term").groupBy("doc_id").agg(F.collect_list(F.struct("_t", "w")).alias("_x"))
    listed = materialise(listed, "listed")
    asked = _weight_blocks(listed.join(broadcast_if_small(queries.select("doc_id")), "doc_id", "left_semi").repartition(1 + queries.count() // BLOCK), "q", kind)

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                q_ids, v_ids = np.asarray(row.q_ids), np.asarray(row.v_ids)
                common = np.intersect1d(row.q_terms, row.v_terms)
                cos = np.zeros((len(q_ids), len(v_ids)))
                for k in range(0, len(common), STRIP):
                    cos += _dense(row.q_sizes, row.q_terms, row.q_weights, common[k : k + STRIP]) @ _dense(row.v_sizes, row.v_terms, row.v_weights, common[k : k + STRIP]).T
                cos[q_ids[:, None] == v_ids[None, :]] = 0.0
                # What may be among the best after the rounding, then the order of these few.
                least = np.partition(cos, -min(n, len(v_ids)), axis=1)[:, -min(n, len(v_ids))]
                a, b = np.nonzero((cos >= least[:, None] - 2e-9) & (cos > 0))
                place = np.argsort(np.argsort(v_ids))
                order = np.lexsort((-place[b], -np.round(cos[a, b], 9), a))
                a, b = a[order], b[order]
                first = np.arange(len(a)) - np.searchsorted(a, a) < n
                a, b = a[first], b[first]
                yield pd.DataFrame({"i": q_ids[a], "j": v_ids[b], "coseno": cos[a, b]})

    partial = meet(weights.sparkSession, asked, _weight_blocks(listed, "v", kind)).mapInPandas(multiply, f"i {kind}, j {kind}, coseno double")
    ranked = partial.withColumn("rango", F.row_number().over(Window.partitionBy("i").orderBy(F.desc(F.round("coseno", 9)), F.desc("j"))))
    return ranked.where(F.col("rango") <= n)
