from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tamiz.operators import alerts, evaluation, quality, sentiment, threads, trends
from tamiz.plans.pipeline import report, run
from tamiz.sources import feeds

GOOD = ("Título válido", "c" * 50, "2026-01-05", "https://a.example/1", "Ana", "ciencia", "https://a.example")
SCHEMA = "pos long, titulo string, cuerpo string, fecha string, url string, autor string, categoria_original string, fuente string"


def record(pos, **changes):
    return (pos, *[changes.get(name, value) for name, value in zip(quality.REQUIRED, GOOD, strict=True)])


def test_quality(spark):
    rows = [record(1), record(2, url="HTTPS://A.example/1 "), record(3, url="https://a.example/3", titulo="título  VÁLIDO"), record(4, cuerpo="c" * 49, url="https://a.example/4"), record(5, fecha="05/01/2026"), record(6, autor=None), record(7, fuente="a.example"), record(8, titulo="")]
    got = {r.pos: r.motivos for r in quality.validated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == [] and "URL repetida" in got[2][0] and "título normalizado" in got[3][0] and "49 < 50" in got[4][0]
    assert "Formato" in got[5][0] and got[6] == ["Campo obligatorio ausente o vacío: 'autor'"] and "URL inválida" in got[7][0] and len(got[8]) == 1
    counts = quality.report(quality.validated(spark.createDataFrame(rows, SCHEMA))).first()
    assert (counts.total, counts.validos, counts.url_repetida, counts.titulo_repetido) == (8, 1, 1, 1)
    assert quality.report(quality.validated(spark.createDataFrame([], SCHEMA))).first().total == 0


def test_first_by_key(spark):
    df = spark.createDataFrame([(1, "a"), (2, "A"), (3, ""), (4, None), (5, "")], "pos long, k string")
    assert sorted(r.pos for r in quality.first_by_key(df, F.lower("k")).collect()) == [1, 3, 4, 5]


def test_trends(spark):
    rows = [(1, "c", "2026-01-05", "clima clima sequia"), (2, "c", "2026-02-01", "lluvia lluvia clima"), (3, "e", "2026-02-03", "banco"), (4, "e", "mala", "x"), (5, "c", "2026-1-6", "clima")]
    df = spark.createDataFrame(rows, "pos long, cat string, fecha string, texto string").withColumn("d", trends.valid_date(F.col("fecha"))).where("d IS NOT NULL")
    df = df.withColumn("mes", trends.month(F.col("d"))).withColumn("semana", trends.iso_week(F.col("d")))
    assert {(r.categoria, r.periodo): r.n for r in trends.period_counts(df, "cat", "mes").collect()} == {("c", "2026-01"): 2, ("c", "2026-02"): 1, ("e", "2026-02"): 1}
    assert df.where("pos = 1").first().semana == "2026-W02"
    best = trends.peak(df, "cat", "mes").first()
    assert (best.categoria, best.periodo, best.n) == ("c", "2026-01", 2)
    changed = {(r.termino, r.cambio) for r in trends.term_changes(df, "cat", "mes", F.col("texto")).collect()}
    assert changed == {("lluvia", 2), ("clima", -2), ("sequia", -1)}


def test_sentiment(spark):
    df = spark.createDataFrame([("avance mejora crisis",), ("crisis",), (None,), ("nada",)], "t string")
    assert [r.s for r in df.select(F.round(sentiment.lexicon_score(F.col("t")), 4).alias("s")).collect()] == [0.3333, -1.0, 0.0, 0.0]
    bounds = spark.createDataFrame([(0.05,), (-0.05,), (0.0,)], "s double").select(sentiment.label(F.col("s")).alias("l"), sentiment.tone(F.col("s")).alias("t")).collect()
    assert [tuple(r) for r in bounds] == [("positivo", "neutral"), ("negativo", "neutral"), ("neutral", "neutral")]


def test_threads(spark):
    df = spark.createDataFrame([("h", i, "u" + str(i % 2), x) for i, x in enumerate(["excelente #AI", "terrible", "nada #AI #ai", None])], "hilo string, pos long, usuario string, texto string")
    scored = threads.scored(df)
    assert [r.media_movil for r in threads.moving_average(scored, "hilo", "pos", window=2).orderBy("pos").collect()] == [1.0, 0.0, -0.5, 0.0]
    with pytest.raises(ValueError):
        threads.moving_average(scored, "hilo", "pos", window=0)
    assert {r.hashtag: r.n for r in threads.hashtag_counts(df).collect()} == {"AI": 2, "ai": 1}
    topics = threads.window_topics(df.withColumn("texto", F.lit("banco y bolsa")), "hilo", "pos").collect()
    assert {r.tema for r in topics} == {"economia"}


def test_alerts(spark):
    articles = spark.createDataFrame([("Sube el salario", "mínimo", "U1"), ("sube", "x", None), ("Sube", "el salario", "u1 ")], "titulo string, cuerpo string, url string")
    queries = spark.createDataFrame([("q", '"el salario"'), ("r", "sube")], "nombre string, expresion string")
    first = alerts.alerts(articles, queries)
    assert {(r.consulta, r.noticia_id) for r in first.collect()} == {("q", "u1"), ("r", "u1"), ("r", "sube")}
    assert alerts.alerts(articles, queries, first).count() == 0
    with pytest.raises(ValueError):
        alerts.register(queries, spark.createDataFrame([("v", " ")], "nombre string, expresion string"))


def test_measures(spark):
    ranking = spark.createDataFrame([("q", "m", i + 1, d) for i, d in enumerate([1, 9, 2])] + [("p", "m", 1, 5)], "consulta string, modelo string, rango int, doc_id long")
    judged = spark.createDataFrame([("q", 1), ("q", 2), ("p", 7), ("p", 8)], "consulta string, doc_id long")
    got = {r.consulta: r for r in evaluation.measures(ranking, judged, k=3).collect()}
    q = got["q"]
    assert (round(q.precision, 4), q.recall, round(q.f1, 4), round(q.p_at_k, 4), round(q.ap, 4)) == (0.6667, 1.0, 0.8, 0.6667, 0.8333)
    assert (got["p"].precision, got["p"].recall, got["p"].f1, got["p"].ap) == (0, 0, 0, 0)


def test_sources(spark):
    urls = spark.createDataFrame([("https://a.example/x/1",), ("https://a.example/xy",), ("https://b.a.example/x",), ("mal",)], "u string")
    scopes = urls.select(*(feeds.in_scope(F.col("u"), "https://a.example/x/", m).alias(m) for m in ("dominio", "directorio", "subdominio", "otro"))).collect()
    assert [tuple(r) for r in scopes] == [(True, True, True, False), (True, False, True, False), (False, False, True, False), (False, False, False, False)]
    links = spark.createDataFrame([("https://a.example/", "https://a.example/1"), ("https://a.example/1", "https://a.example/2"), ("https://a.example/1", "https://c.example/")], "origen string, destino string")
    assert {(r.url, r.nivel) for r in feeds.frontier("https://a.example/", links, "dominio", 10).collect()} == {("https://a.example/", 0), ("https://a.example/1", 1), ("https://a.example/2", 2)}


def test_pipeline(spark, tmp_path):
    rows = [record(i, url=f"https://a.example/{i}", titulo=f"Avance número {i}") for i in range(5)] + [record(9, titulo="")]
    result = run(spark.createDataFrame(rows, SCHEMA), clock=lambda: datetime(2026, 1, 1, tzinfo=UTC))
    assert result.manifest()["documentos"]["corpus"] == 5 and all(s.estado == "completo" for s in result.trace)
    assert "## Tono" in report(result)
    result.write_log(str(tmp_path / "log.jsonl"))
    assert len((tmp_path / "log.jsonl").read_text().splitlines()) == len(result.trace)
    broken = run(spark.createDataFrame(rows, SCHEMA).drop("fecha"))
    assert {s.etapa for s in broken.trace if s.estado == "error"} >= {"calidad"}
