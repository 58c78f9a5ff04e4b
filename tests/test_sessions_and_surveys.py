import pytest

from tamiz.operators import dialogue, surveys
from tamiz.sources import robots
from tamiz.streaming import alerts as streams
from tamiz.streaming.run import read_stream, run_available


def test_dialogue_turns(spark):
    rows = [("s", 1, "algo nuevo"), ("s", 2, "el banco y la bolsa"), ("s", 3, " "), ("s", 4, "dame más"), ("s", 5, "y qué pasó"), ("s", 6, "¿cuántas hay?"), ("t", 1, "eso")]
    got = {(r.sesion, r.turno): (r.tipo, r.tema) for r in dialogue.dialogue_turns(spark.createDataFrame(rows, "sesion string, turno int, q string"), "sesion", "turno", "q").collect()}
    assert got == {("s", 1): ("directa", None), ("s", 2): ("personalizada", "economia"), ("s", 3): ("fallback", None), ("s", 4): ("contextual", None), ("s", 5): ("personalizada", "economia"), ("s", 6): ("conteo", None), ("t", 1): ("directa", None)}


def test_robots(spark):
    urls = spark.createDataFrame([("https://a.example/x",), ("https://a.example/privado/1",), ("https://b.example/",), (None,)], "url string")
    files = spark.createDataFrame([("a.example", "User-agent: *\nDisallow: /privado"), ("b.example", None)], "host string, texto string")
    assert {r.url: r.permitida for r in robots.with_permission(urls, files).collect()} == {"https://a.example/x": True, "https://a.example/privado/1": False, "https://b.example/": False, None: False}


def test_surveys(spark):
    schema = "participante string, respuestas map<string,int>, problemas array<string>"
    old = spark.createDataFrame([("u1", {"a": 1, "b": 2}, ["x"]), ("u2", {"a": 3, "b": 4}, ["x", "y"])], schema)
    new = spark.createDataFrame([("u1", {"a": 5, "b": 5}, [])], schema)
    both = surveys.register(old, new, 2)
    assert dict(surveys.averages(both).collect()) == {"a": 4.0, "b": 4.5} and dict(surveys.problems(both).collect()) == {"x": 1, "y": 1}
    assert [r.codigo for r in surveys.anonymised(both).collect()] == ["P01", "P02"]
    with pytest.raises(ValueError):
        surveys.register(old, spark.createDataFrame([("u3", {"a": 1}, None)], schema), 2)


def test_streams(spark, tmp_path):
    path = str(tmp_path / "articulos.parquet")
    spark.createDataFrame([("Sube el banco", "u1", "a"), ("sube", "u1", "b"), ("otra", "u2", "a")], "titulo string, url string, sesion string").selectExpr("*", "'' AS cuerpo").write.parquet(path)
    saved = spark.createDataFrame([("q", "sube")], "nombre string, expresion string")
    found = run_available(streams.alert_stream(read_stream(spark, path), saved).select("consulta", "noticia_id"))
    assert [tuple(r) for r in found.collect()] == [("q", "u1")]
    memory = run_available(streams.topic_memory(read_stream(spark, path).selectExpr("sesion", "titulo AS texto")))
    assert {r.sesion: r.turnos for r in memory.collect()} == {"a": 2, "b": 1}
