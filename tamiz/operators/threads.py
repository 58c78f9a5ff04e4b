"""Discussion threads: moving sentiment, summaries, topics of the last messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamiz.functions import lexicons
from tamiz.functions.text import fold, hashtags
from tamiz.operators.search import tfidf_terms
from tamiz.operators.sentiment import occurrence_score, tone


def scored(messages: DataFrame, text: str = "texto") -> DataFrame:
    """Add score and tono of each message."""
    out = messages.withColumn("score", occurrence_score(F.col(text)))
    return out.withColumn("tono", tone(F.col("score")))


def moving_average(messages: DataFrame, thread: str, order: str, score: str = "score", window: int = 3) -> DataFrame:
    """Add ``media_movil``: mean of the last ``window`` scores of the thread, this one included."""
    if window < 1:
        raise ValueError("window must be 1 or more")
    frame = Window.partitionBy(thread).orderBy(order).rowsBetween(1 - window, 0)
    return messages.withColumn("media_movil", F.round(F.avg(score).over(frame), 4))


def summary(messages: DataFrame, thread: str, user: str = "usuario", score: str = "score") -> DataFrame:
    """(thread, mensajes, usuarios, media, tono, pct_positivo, pct_negativo, pct_neutral)."""

    def share(kind: str):
        return F.round(100.0 * F.count_if(F.col("tono") == kind) / F.count("*"), 1).alias("pct_" + kind)

    out = messages.groupBy(thread).agg(
        F.count("*").alias("mensajes"), F.countDistinct(user).alias("usuarios"), F.round(F.avg(score), 4).alias("media"), share("positivo"), share("negativo"), share("neutral")
    )
    return out.withColumn("tono", tone(F.col("media"), "mixto"))


def hashtag_counts(messages: DataFrame, text: str = "texto") -> DataFrame:
    """(hashtag, n), every occurrence counted, case as written."""
    return messages.select(F.explode(hashtags(F.col(text))).alias("hashtag")).groupBy("hashtag").agg(F.count("*").alias("n"))


def active_users(messages: DataFrame, user: str, n: int = 5, order: str = "pos") -> DataFrame:
    """The users of most messages, ties to who wrote first."""
    return messages.groupBy(user).agg(F.count("*").alias("mensajes"), F.min(order).alias("_first")).orderBy(F.desc("mensajes"), "_first").limit(n).drop("_first")


def window_topics(messages: DataFrame, thread: str, order: str, text: str = "texto", window: int = 5, threshold: float = 0.08, profiles: list[tuple[str, str]] = lexicons.TOPIC_PROFILES) -> DataFrame:
    """Add ``tema`` and ``confianza``: the profile nearest to the last ``window`` messages, ``general`` below the threshold.

    The window's TF-IDF vector needs only the profiles' vocabulary, a fixed
    broadcast; its norm is over those terms, as unknown words weigh nothing.
    """
    spark = messages.sparkSession
    topics = spark.createDataFrame([(i, name, words_) for i, (name, words_) in enumerate(profiles)], "doc_id long, tema string, titulo string")
    weights, vocabulary = tfidf_terms(topics.withColumn("cuerpo", F.lit("")), F.col("titulo"), max_n=1)
    profile = weights.join(topics.select("doc_id", "tema"), "doc_id").join(vocabulary.select("term", "idf"), "term").select("term", "doc_id", "tema", "w", "idf")
    frame = Window.partitionBy(thread).orderBy(order).rowsBetween(1 - window, 0)
    joined = messages.withColumn("_text", F.array_join(F.collect_list(F.coalesce(text, F.lit(""))).over(frame), " "))
    tokens = joined.select(thread, order, F.explode(F.regexp_extract_all(F.lower("_text"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))).alias("term"))
    counted = tokens.groupBy(thread, order, "term").agg(F.count("*").alias("tf"))
    vocabulary_rows = F.broadcast(vocabulary.select("term", "idf"))
    known = counted.join(vocabulary_rows, "term").select(thread, order, "term", (F.col("tf") * F.col("idf")).alias("raw"))
    norms = known.groupBy(thread, order).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    dots = known.join(F.broadcast(profile.select("term", "doc_id", "tema", "w")), "term").groupBy(thread, order, "doc_id", "tema").agg(F.sum(F.col("raw") * F.col("w")).alias("dot"))
    best = dots.join(norms, [thread, order]).withColumn("cos", F.col("dot") / F.col("norm"))
    # Rounded before the comparison, so that equal cosines tie in any summation order; the first profile wins.
    best = best.groupBy(thread, order).agg(F.max_by(F.struct("tema", "cos"), F.struct(F.round("cos", 9), -F.col("doc_id"))).alias("_b"))
    out = messages.join(best, [thread, order], "left").withColumn("confianza", F.coalesce("_b.cos", F.lit(0.0)))
    return out.withColumn("tema", F.when(F.col("confianza") >= threshold, F.col("_b.tema")).otherwise("general")).drop("_b")


def folded(messages: DataFrame, text: str = "texto") -> DataFrame:
    """Add ``plano``, the text without case and accents."""
    return messages.withColumn("plano", fold(F.col(text)))
