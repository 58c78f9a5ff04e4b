"""Structured Streaming: saved-query alerts, windowed counts, and sessions with memory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tamiz.operators.alerts import matches
from tamiz.operators.dialogue import topics
from tamiz.session import broadcast_if_small


def alert_stream(articles: DataFrame, queries: DataFrame) -> DataFrame:
    """Alerts of a stream of articles, each (consulta, noticia_id) once over the life of the checkpoint."""
    return matches(articles, queries).dropDuplicates(["consulta", "noticia_id"])


def alert_stream_within(articles: DataFrame, queries: DataFrame, event_time: str, delay: str) -> DataFrame:
    """The same with bounded state: repeats are known within ``delay`` of each other."""
    from tamiz.functions.text import query_pieces
    from tamiz.operators.alerts import article_key

    prepared = queries.select(F.col("nombre").alias("consulta"), query_pieces(F.col("expresion")).alias("_p"))
    text = F.lower(F.concat_ws(" ", F.coalesce("titulo", F.lit("")), F.coalesce("cuerpo", F.lit(""))))
    rows = articles.withWatermark(event_time, delay).select(event_time, article_key(articles).alias("noticia_id"), "titulo", text.alias("_t"))
    met = rows.join(broadcast_if_small(prepared), F.expr("forall(_p, p -> contains(_t, p))")).drop("_t", "_p")
    return met.dropDuplicatesWithinWatermark(["consulta", "noticia_id"])


def windowed_counts(events: DataFrame, event_time: str, key: str, width: str = "7 days", delay: str = "1 day", start: str | None = None) -> DataFrame:
    """(inicio, fin, key, n): events of each tumbling window, late ones up to ``delay``."""
    window = F.window(event_time, width, None, start) if start else F.window(event_time, width)
    counted = events.withWatermark(event_time, delay).groupBy(window.alias("_w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("_w.start").alias("inicio"), F.col("_w.end").alias("fin"), key, "n")


def topic_memory(turns: DataFrame, session: str = "sesion", text: str = "texto") -> DataFrame:
    """(sesion, turnos, tema): after each batch, the turns of a session so far and its most raised topic.

    State of a session is its counter of topics, kept for the life of the
    checkpoint, without a timeout: a pending one would keep a stream that is to
    process what is available from ever ending.
    """
    raised = turns.select(session, topics(F.col(text)).alias("temas"))

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, counts, seen = state.get if state.exists else ([], [], 0)
        counter = dict(zip(list(names), list(counts), strict=True))
        for frame in frames:
            seen += len(frame)
            for found in frame["temas"]:
                for name in found:
                    counter[name] = counter.get(name, 0) + 1
        state.update((list(counter), list(counter.values()), seen))
        yield pd.DataFrame({session: [key[0]], "turnos": [seen], "tema": [max(counter, key=counter.get) if counter else None]})

    return raised.groupBy(session).applyInPandasWithState(
        update, f"{session} string, turnos long, tema string", "nombres array<string>, cuentas array<long>, turnos long", "append", GroupStateTimeout.NoTimeout
    )
