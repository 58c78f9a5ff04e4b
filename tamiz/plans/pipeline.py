"""The whole chain over one corpus, stage by stage, with what each stage took in and gave out."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tamiz.operators import graph, nlp, quality, search, sentiment, trends
from tamiz.session import materialise
from tamiz.sinks import markdown_table


@dataclass
class Stage:
    """One entry of the trace."""

    etapa: str
    entrada: int
    salida: int
    estado: str
    marca: str
    detalle: str = ""


@dataclass
class Run:
    """The tables of a run and its trace; a stage that fails is recorded and the next ones go on without it."""

    clock: Callable[[], datetime] = field(default=lambda: datetime.now(UTC))
    tables: dict[str, DataFrame] = field(default_factory=dict)
    trace: list[Stage] = field(default_factory=list)

    def stage(self, name: str, source: str | None, make: Callable[[], DataFrame]) -> DataFrame | None:
        """Write one stage's table to shared storage, counted while it is written."""
        before = next((s.salida for s in reversed(self.trace) if s.etapa == source), 0)
        stamp = self.clock().strftime("%Y-%m-%dT%H:%M:%SZ")
        try:
            seen = Observation(name)
            table = materialise(make().observe(seen, F.count(F.lit(1)).alias("n")), name)
            count = seen.get["n"]
        except Exception as error:  # a stage must not end the run
            self.trace.append(Stage(name, before, 0, "error", stamp, str(error).splitlines()[0][:200]))
            return None
        self.tables[name] = table
        self.trace.append(Stage(name, before, count, "completo", stamp))
        return table

    def manifest(self) -> dict:
        """Rows that each stage gave out (the last entry of a name stands) and the trace."""
        return {"documentos": {s.etapa: s.salida for s in self.trace}, "eventos": [vars(s) for s in self.trace]}

    def write_log(self, path: str) -> None:
        """One JSON line an entry."""
        Path(path).write_text("".join(json.dumps(vars(s), ensure_ascii=False) + "\n" for s in self.trace), encoding="utf-8")


def run(articles: DataFrame, clock: Callable[[], datetime] | None = None) -> Run:
    """Quality, text statistics, sentiment, trends, index and graph of (pos, and the fields every record must have).

    Where no record is valid the corpus goes on as it came.
    """
    out = Run(**({"clock": clock} if clock else {}))
    out.stage("extraccion", None, lambda: articles)
    judged = out.stage("calidad", "extraccion", lambda: quality.validated(out.tables["extraccion"]))
    valid = judged.where(F.size("motivos") == 0).drop("motivos") if judged is not None else articles
    if valid.isEmpty():
        valid = articles
    text = F.concat_ws(". ", "titulo", "cuerpo")
    out.stage("corpus", "calidad", lambda: nlp.process(valid.withColumn("texto", text), "texto"))
    corpus = out.tables.get("corpus", valid)
    score = sentiment.lexicon_score(F.concat_ws(" ", "cuerpo", "titulo"))
    out.stage("sentimiento", "corpus", lambda: corpus.select("pos", "titulo", "cuerpo", "fecha", "autor", F.col("categoria_original").alias("categoria"), "fuente", "url", score.alias("score")).withColumn("etiqueta", sentiment.label(F.col("score"))))

    def counts() -> DataFrame:
        dated = corpus.withColumn("mes", trends.month(trends.valid_date(F.col("fecha")))).where("mes IS NOT NULL")
        return trends.period_counts(dated, "categoria_original", "mes")

    out.stage("tendencias", "corpus", counts)
    out.stage("indice", "corpus", lambda: search.postings(corpus.withColumn("doc_id", F.col("pos"))))
    out.stage("grafo", "sentimiento", lambda: graph.article_triples(out.tables["sentimiento"]))
    return out


def report(result: Run, title: str = "Informe del corpus") -> str:
    """A Markdown report: the trace, the corpus, its categories and tone."""
    spark_rows = [f"# {title}", "", "## Etapas", "", "| etapa | entrada | salida | estado |", "|---|---|---|---|"]
    spark_rows += [f"| {s.etapa} | {s.entrada} | {s.salida} | {s.estado} |" for s in result.trace]
    for heading, name, make in (
        ("Corpus", "corpus", nlp.corpus_stats),
        ("Categorías", "corpus", lambda t: t.groupBy("categoria_original").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "categoria_original")),
        ("Tono", "sentimiento", lambda t: sentiment.corpus_tone(t, "score", "etiqueta")),
        ("Calidad", "calidad", quality.report),
    ):
        if name in result.tables:
            spark_rows += ["", f"## {heading}", "", markdown_table(make(result.tables[name]), 50)]
    return "\n".join(spark_rows) + "\n"
