import pytest
from pyspark.sql import functions as F

from tamiz import sinks
from tamiz.operators import dialogue, graph
from tamiz.sources import catalogue, feeds, html

PAGE = """<html><title>Portal</title><nav><a href=/>Inicio</a></nav><main>
<article class="noticia x" data-categoria="ciencia"><h2> Uno  &amp; dos </h2><p class=cuerpo>Texto <b>fuerte</b><br>sigue<span class="fecha">2026-01-01</span><span class=autor>Ana</span><a class="leer-mas" href="../n/1">más</a></article>
<article class="noticia"><h2>Sin enlace</h2><p class="cuerpo">x</p><span class="fecha">f</span><span class="autor">a</span></article></main><footer>Pie</footer>"""


def test_selectors():
    root = html.parse("<div id=a><p class='x y'>1</p><section><p data-k=v>2</p></section></div><p>3")
    assert [n.text() for n in root.select("div > p, p[data-k=v]")] == ["1", "2"]
    assert [n.text() for n in root.select("#a p")] == ["1", "2"] and root.first("p.y.x").text() == "1" and root.first("ul") is None
    with pytest.raises(ValueError):
        root.select("p:first")


def test_articles(spark):
    df = spark.createDataFrame([(PAGE, "https://a.example/s/"), (None, "https://b.example"), ("", None)], "html string, url string")
    rows = html.extract_articles(df, "html", "url").collect()
    good = [r for r in rows if r.error is None]
    assert [(r.titulo, r.categoria_original, r.url, r.fecha, r.autor) for r in good] == [("Uno & dos", "ciencia", "https://a.example/n/1", "2026-01-01", "Ana")]
    assert [r.error for r in rows if r.error] == ["Artículo 2: falta url"]
    profile = html.dom_profile(df, "html", "url").where("url = 'https://a.example/s/'").first()
    assert (profile.titulo, profile.articulos_main, profile.navegacion, profile.pie) == ("Portal", 2, ["Inicio"], "Pie")


def test_batches_of_errors_alone(spark):
    lacking = PAGE.replace("<h2> Uno  &amp; dos </h2>", "")
    df = spark.createDataFrame([(lacking, "https://a.example/s/")], "html string, url string").coalesce(1)
    rows = html.extract_articles(df, "html", "url").collect()
    assert [(r.pagina, r.orden, r.titulo, r.url, r.error) for r in rows] == [("https://a.example/s/", None, None, None, f"Artículo {i}: falta {part}") for i, part in ((1, "titulo"), (2, "url"))]


def test_batches_of_articles_alone(spark):
    df = spark.createDataFrame([(PAGE.replace("<article class=\"noticia\"><h2>Sin enlace", "<article><h2>Sin enlace"), "https://a.example/s/")], "html string, url string").coalesce(1)
    rows = html.extract_articles(df, "html", "url").where("error IS NULL").collect()
    assert [(r.pagina, r.orden, r.titulo, r.url, r.error) for r in rows] == [("https://a.example/s/", 1, "Uno & dos", "https://a.example/n/1", None)]


def test_odd_markup_and_links_end_no_batch(spark):
    odd = PAGE.replace("Texto", "Texto <![x[ y> <![ z>")
    unread = PAGE.replace("../n/1", "http://[1/n")
    df = spark.createDataFrame([(odd, "https://a.example/s/"), (unread, "https://b.example/"), (PAGE, "http://[1/")], "html string, url string").coalesce(1)
    rows = html.extract_articles(df, "html", "url").collect()
    assert [(r.pagina, r.titulo, r.url) for r in rows if r.error is None] == [("https://a.example/s/", "Uno & dos", "https://a.example/n/1")]
    assert [(r.pagina, r.error) for r in rows if r.error] == [("https://a.example/s/", "Artículo 2: falta url")] + [(u, f"Artículo {i}: falta url") for u in ("https://b.example/", "http://[1/") for i in (1, 2)]
    assert html.parse("a<![CDATA[b]]>c<![if x]>d").text() == "a c d" and html.parse("a<![ b").text().startswith("a")


def test_crawl(spark):
    def page(n, last=False):
        items = "".join(f"<li class=i><h3>T{n}{k}</h3><a href='/n/{n}{k}'>x</a></li>" for k in range(3))
        return f"<ul>{items}</ul>" + ("" if last else f"<a rel=next href='/p/{n + 1}'>Siguiente</a>")

    pages = spark.createDataFrame([(f"https://a.example/p/{n}", page(n, n == 4)) for n in range(1, 5)], "url string, html string")
    got = html.crawl_listing(pages, "https://a.example/p/1", "li.i", max_pages=5, minimum=8).collect()
    assert len(got) == 8 and got[0].titulo == "T10" and got[7].pagina_origen.endswith("/3")
    assert html.crawl_listing(pages, "https://a.example/none", "li.i").count() == 0
    links = html.listing_items("<a href='/a'>Un titular bastante largo aquí</a><a href='/b'>corto</a><a href='https://z.example/c'>Otro titular bastante largo</a>", "https://a.example/", "li.i")
    assert [x["url"] for x in links] == ["https://a.example/a"]


def test_rss(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>T</title><link>https://a.example/ciencia/1</link><description>&lt;p&gt;Hola &lt;b&gt;mundo&lt;/b&gt;&lt;/p&gt;</description><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate></item><item><link>x</link></item></channel></rss>")
    row = feeds.rss_articles(feeds.read_rss(spark, str(tmp_path)), "https://feed.example").collect()
    assert [(r.titulo, r.cuerpo, r.fecha, r.autor, r.categoria_original) for r in row] == [("T", "Hola mundo", "2026-01-05", "Redacción", "ciencia")]


def test_catalogue(spark):
    rows = [("a", "Álfa", "rss", ["https://a.example"], ["a.example"], True, 5, 1.0, "https://a.example"), ("b", "B", "xml", [], None, False, 0, -1.0, "https://b.example")]
    df = spark.createDataFrame(rows, "id string, nombre string, tipo string, urls array<string>, dominios_permitidos array<string>, activo boolean, limite_noticias int, delay_segundos double, base_url string")
    assert {r.id: len(r.errores) for r in catalogue.validation_errors(df).collect()} == {"a": 0, "b": 5}
    assert catalogue.by_name(df, "alfa").first().id == "a" and catalogue.active(df).count() == 1
    with pytest.raises(KeyError):
        catalogue.by_name(df, "zeta")
    fresh = spark.createDataFrame([("A", "https://c.example"), ("X", "https://www.a.example")], "nombre string, base_url string")
    assert sorted(r.id for r in catalogue.with_custom(df, fresh).collect()) == ["a", "a_2", "b"]


@pytest.fixture(scope="module")
def triples(spark):
    rows = [(1, "Uno", "c" * 300, "2026-01-01", "Ana", "Ciencia", "F", "https://a.example/1", -0.5, "negativo"), (2, "Dos", "x", "2026-01-02", "ana", "ciencia", None, None, 0.5, "positivo"), (3, None, None, None, None, None, None, None, None, None)]
    return graph.article_triples(spark.createDataFrame(rows, "pos long, titulo string, cuerpo string, fecha string, autor string, categoria string, fuente string, url string, score double, etiqueta string"))


def test_graph(triples, spark):
    assert {(r.titulo, r.autor) for r in graph.metadata(triples).collect()} == {("Uno", "Ana"), ("Uno", "ana"), ("Dos", "Ana"), ("Dos", "ana")}
    assert [r.titulo for r in graph.negative_articles(triples).collect()] == ["Uno"]
    assert {(r.recurso[-1], r.propiedad) for r in graph.shape_violations(triples).collect()} == {("2", "url"), *(("3", p) for p in graph.SHAPE)}
    assert triples.where(F.col("p") == graph.DC + "description").agg(F.max(F.length("o"))).first()[0] == 200
    with pytest.raises(ValueError):
        graph.match(triples, [("?a", "x", "?b"), ("?c", "y", "?d")])
    lines = graph.n_triples(triples)
    back = graph.read_n_triples(lines)
    assert back.exceptAll(triples).count() == triples.exceptAll(back).count() == 0
    odd = spark.createDataFrame([("urn:s", "urn:p", 'comillas " barra \\\\ y\nlínea', "literal", None)], triples.schema)
    assert graph.read_n_triples(graph.n_triples(odd)).collect() == odd.collect()


def test_links(spark):
    labels = spark.createDataFrame([("u1", "Inteligencia Artificial"), ("u2", "Otra")], "uri string, etiqueta string")
    candidates = spark.createDataFrame([("Q2", "inteligencia  artificial"), ("Q1", "Inteligencia-artificial"), ("Q3", None)], "item string, item_label string")
    links = graph.link_entities(labels, candidates)
    assert [tuple(r) for r in links.collect()] == [("u1", "Inteligencia Artificial", "Q1")] and graph.link_triples(links).count() == 2


def test_dialogue(spark):
    df = spark.createDataFrame([("s", 1, "¿Cuántas noticias hay?"), ("s", 2, "dame más sobre eso"), ("s", 3, "háblame de la inflación y el banco"), ("t", 1, None)], "sesion string, turno long, pregunta string")
    rows = df.select(dialogue.intent(F.col("pregunta")).alias("i"), dialogue.refers_back(F.col("pregunta")).alias("r")).collect()
    assert [(r.i, r.r) for r in rows] == [("conteo", False), ("busqueda", True), ("busqueda", False), ("busqueda", False)]
    assert [r.consulta for r in dialogue.previous_turn(df, "sesion", "turno", "pregunta").where("turno = 2").collect()] == ["¿Cuántas noticias hay? dame más sobre eso"]
    assert {(r.sesion, r.turno): r.tema_dominante for r in dialogue.running_topic(df, "sesion", "turno", "pregunta").collect()}[("s", 3)] == "economia"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], None), (2, None, "x|y")], "n int, l array<string>, t string")
    assert [tuple(r) for r in sinks.flattened(df).collect()] == [("1", '["a","b"]', ""), ("2", "", "x|y")]
    sinks.write_json_array(df, str(tmp_path / "a.json"))
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_json_lines(df, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2 and spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["n", "l", "t"]
    assert "x\\|y" in sinks.markdown_table(df)
    assert sinks.inventory([str(tmp_path / "a.json"), "/none"])[1]["existe"] is False


def test_listing_table_and_diagnostics(spark):
    item = "<div class='i'><h2>{}</h2><a href='{}'>x</a></div>"
    pages = [
        (0, "https://a.example/1", item.format("Uno", "/u") + item.format("", "/v") + item.format("Dos", "/d") + item.format("Otra vez", "/u") + "<a href='/2'>Siguiente</a>"),
        (1, "https://a.example/2", item.format("Uno de nuevo", "/u") + item.format("Tres", "/t")),
        (2, "https://a.example/3", None),
    ]
    df = spark.createDataFrame([(*p, "z") for p in pages], "n int, url string, html string, pagina string")
    items = html.listing_table(df, ".i")
    assert [(r.pagina[-1], r.titulo) for r in html.first_listed(items, df, "n").orderBy("pagina", "orden").collect()] == [("1", "Uno"), ("1", "Dos"), ("2", "Tres")]
    got = {r.pagina[-1]: (r.elementos, r.sin_titulo, r.repetidos, r.articulos, r.siguiente) for r in html.listing_diagnostics(df, ".i").collect()}
    assert got == {"1": (4, 1, 1, 2, "https://a.example/2"), "2": (2, 0, 0, 2, None), "3": (0, 0, 0, 0, None)}
