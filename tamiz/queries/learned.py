"""Trained models and streams: results that SQL cannot express, or only in part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions.urls import source_host
from tamiz.operators import classify
from tamiz.queries.base import news
from tamiz.queries.records import _ALERTS, SAVED
from tamiz.session import materialise, read_table
from tamiz.streaming import alerts as streams
from tamiz.streaming.run import read_stream, run_available


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with a single label set by hand."""
    one = read_table(spark, sf_dir, "etiquetas").groupBy("pos").agg(F.countDistinct("materia").alias("k"), F.min("materia").alias("etiqueta")).where("k = 1")
    return news(spark, sf_dir).select("pos", F.concat_ws(" ", "titulo", "cuerpo").alias("texto")).join(one.select("pos", "etiqueta"), "pos")


def classify_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject of every article by a model trained on the labelled ones."""
    model, labels = classify.train(_labelled(spark, sf_dir), estimator=classify.candidates()["NaiveBayes"])
    rows = news(spark, sf_dir).select("pos", F.concat_ws(" ", "titulo", "cuerpo").alias("texto"))
    return classify.predict(model, labels, rows).select("pos", "prediccion")


def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures on the fifth of the labelled articles that the model has not seen."""
    rows = materialise(classify.folds(_labelled(spark, sf_dir), "etiqueta", 5, "pos"), "folds")
    model, labels = classify.train(rows.where("pliegue <> 0"), estimator=classify.candidates()["LogisticRegression"])
    return classify.classification_report(classify.predict(model, labels, rows.where("pliegue = 0")))


def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the estimators over stratified folds of the labelled texts, title and body."""
    return classify.select_model(_labelled(spark, sf_dir), "pos")


def subtopics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of whole texts, title and body."""
    return classify.clusters(news(spark, sf_dir).select("pos", F.concat_ws(" ", "titulo", "cuerpo").alias("texto")), "pos", "texto", 12)


def alerts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the stream of articles: the same as in batch."""
    saved = spark.createDataFrame(SAVED, "nombre string, expresion string")
    found = streams.alert_stream(read_stream(spark, f"{sf_dir}/noticias.parquet"), saved)
    return run_available(found.select("consulta", "noticia_id"))


def windowed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly counts of events by type, windows that the watermark has closed."""
    events = read_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = streams.windowed_counts(events, "ts", "event_type", "7 days", "1 day")
    return run_available(counted).select(F.col("inicio").cast("string").alias("inicio"), "event_type", "n")


def topic_memory_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and main topic of every session after the last batch: sessions are sources."""
    turns = read_stream(spark, f"{sf_dir}/noticias.parquet").select(source_host(F.col("fuente"), F.col("url")).alias("sesion"), F.col("titulo").alias("texto"))
    rows = run_available(streams.topic_memory(turns))
    return rows.groupBy("sesion").agg(F.max("turnos").alias("turnos"), F.max_by("tema", "turnos").alias("tema"))


QUERIES = {f.__name__: f for f in (classify_articles, classification_report, model_selection, subtopics, alerts_stream, windowed_stream, topic_memory_stream)}

ORACLES = {
    "windowed_stream": """WITH w AS (SELECT time_bucket(INTERVAL '7 days', CAST(ts AS TIMESTAMP), TIMESTAMP '1970-01-01 00:00:00') AS inicio, event_type, count(*) AS n, (SELECT max(CAST(ts AS TIMESTAMP)) FROM events) AS last FROM events GROUP BY ALL)
        SELECT strftime(inicio, '%Y-%m-%d %H:%M:%S') AS inicio, event_type, n FROM w WHERE inicio + INTERVAL '7 days' <= last - INTERVAL '1 day'""",
    "alerts_stream": f"WITH {_ALERTS} SELECT DISTINCT consulta, noticia_id FROM al",
}
