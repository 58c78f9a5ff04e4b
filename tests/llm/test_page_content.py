import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tamiz.llm import page_content

from tamiz.llm.page_content import article_of, furniture_flags, furniture_lines, page_lines, title_has_furniture

PROSE = "La cosecha de este año superó las previsiones, según explicó ayer la cooperativa en una nota enviada a los medios."
PAGE = "\n".join(
    [
        "Portada | Deportes | Cultura", "Utilizamos cookies propias y de terceros para mejorar tu navegación.", "Por Ana Pérez Gil", "", PROSE, "PUBLICIDAD",
        "Lo que dejó la vendimia", PROSE, "- " + PROSE, "Más sobre este tema", "La uva regó el valle en Villa Alta", "El silo abrió la campaña de trigo", "© 2020 El Diario. Todos los derechos reservados.",
    ]
)


def test_sides_of_lines():
    (flags,) = furniture_flags([PAGE])
    assert [i + 1 for i, x in enumerate(flags) if x] == [1, 2, 3, 6, 10, 11, 12, 13]


@pytest.mark.parametrize("text", [None, "", "\n\n", " "])
def test_nothing(text):
    (flags,) = furniture_flags([text])
    assert not flags.any() and article_of([text]) == [[]]


def test_markup_keeps_line_numbers():
    page = f"<html><nav><a>Inicio</a> | <a>Cultura</a></nav>\n<script>var x = 1;\n</script><p>{PROSE}</p>\n<footer>Aviso legal</footer>"
    (flags,) = furniture_flags([page])
    assert list(flags) == [True, False, False, True]
    assert article_of([page]) == [[PROSE]]
    assert page_lines("a < b\nc") == [("a < b", 0, 1), ("c", 0, 2)]


def without_lists(monkeypatch):
    never = re.compile(r"(?!)")
    for name in ("_CUES", "_SITE_SECTIONS", "_BYLINE", "_BYLINE_LOWER"):
        monkeypatch.setattr(page_content, name, never)
    page_content._evidence.cache_clear()


def markup(one_line):
    nav = "<ul>" + "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("Huerta", "Astros", "Barrios", "Mapas", "Radio")) + "</ul>"
    aside = "<aside><h3>Otros</h3>" + "".join(f"<p><a href='/n{i}'>La villa {x} su feria</a> <span>{i}</span></p>" for i, x in enumerate(("abre", "cierra", "pinta", "mide"))) + "</aside>"
    page = f"<body><header>{nav}</header><div><a>Vale</a><a>Ahora no</a></div><main><h1>La uva</h1><p>{PROSE}</p><h2>Lo que dejó la vendimia</h2><p>{PROSE} <em>{PROSE}</em></p></main>{aside}<footer><a>Quejas</a> <a>Turnos</a></footer></body>"
    return page if one_line else page.replace("><", ">\n<")


@pytest.mark.parametrize("one_line", [True, False])
def test_markup_without_any_list(monkeypatch, one_line):
    # Only tag events, ratios, smoothing and the two clusters of the page decide.
    without_lists(monkeypatch)
    (lines,) = article_of([markup(one_line)])
    page_content._evidence.cache_clear()
    assert PROSE in lines and f"{PROSE} {PROSE}" in lines
    assert not {"Huerta", "Radio", "Vale", "Ahora no", "Otros", "Quejas", "Turnos", "Quejas Turnos"} & set(lines)
    assert not any("su feria" in x for x in lines)


def test_recurring_lines_without_any_list(spark, monkeypatch):
    # Wordings that no list has, in finished sentences, told by their recurring in the source.
    without_lists(monkeypatch)
    wordings = ["Vota en nuestra encuesta diaria.", "Llámanos al 555 1234 para anunciarte.", "Este diario pertenece a la red del valle y cumple su código."]
    rows = [(i, f"Historia {i} de la villa {chr(97 + i)}. {PROSE}\n{wordings[0]}\nOtra historia {chr(97 + i)} más larga. {PROSE}\n{wordings[1]}\n{wordings[2]}", "s") for i in range(14)]
    rows += [(90, f"{PROSE}\n{wordings[0]}", "t"), (91, None, "s"), (92, "", None)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "pos long, c string, src string, linea int")
    held = page_content.with_recurring(df, "pos", "c", F.col("src"), "again")
    assert held.columns == [*df.columns, "again"]
    got = {r.pos: sorted(r.again) if r.again is not None else None for r in held.collect()}
    assert got == {**{i: [2, 4, 5] for i in range(14)}, 90: None, 91: None, 92: None}
    flags = furniture_flags([rows[0][1], rows[14][1]], None, [[2, 4, 5], None])
    page_content._evidence.cache_clear()
    assert [list(x) for x in flags] == [[False, True, False, True, True], [False, False]]
    # Three of a thousand documents are no template.
    many = spark.range(30_000).selectExpr("id AS pos", "concat('único ', id % 3, chr(97 + cast(id % 26 AS int)), repeat('x', cast(id % 997 AS int)), if(id < 12, '\\nvuelve', '')) AS c", "'s' AS src")
    assert page_content.with_recurring(many, "pos", "c", F.col("src"), "again").where("pos < 12 AND again IS NOT NULL AND array_contains(again, 2)").count() == 0


def test_titles():
    sites = frozenset(["el diario de abajo"])
    assert title_has_furniture("La uva regó el valle | El Diario de Abajo", "El Diario de Abajo", sites)
    assert title_has_furniture("Cultura · La uva regó el valle", None, sites)
    assert not title_has_furniture("Villa Alta: la uva - y el vino - regó el valle", None, sites)
    assert not title_has_furniture(None, None, sites) and not title_has_furniture("  ", "x", sites)


def test_frame(spark):
    rows = [(1, PAGE, "T | El Diario", "El Diario"), (2, None, None, None), (3, PROSE * 2000, "T", None)]
    df = spark.createDataFrame(rows, "pos long, c string, t string, s string")
    got = {r.pos: r.l for r in df.select("pos", furniture_lines(F.col("c"), F.col("t"), F.col("s"), frozenset(["el diario"])).alias("l")).collect()}
    assert got == {1: [0, 1, 2, 3, 6, 10, 11, 12, 13], 2: [], 3: []}
    assert pd.Series(furniture_flags([])).empty
