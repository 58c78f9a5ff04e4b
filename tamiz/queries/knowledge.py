"""The corpus as triples: construction, pattern queries, validation, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions.text import slug
from tamiz.operators import graph, sparql, turtle
from tamiz.operators.sentiment import label
from tamiz.queries.base import news
from tamiz.session import broadcast_if_small, read_table


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News for the graph: a score between -1 and 1 from the quality, and the label of it."""
    score = F.round(F.col("calidad") * 2 - 1, 3)
    return news(spark, sf_dir).select("pos", "titulo", "cuerpo", "fecha", "autor", F.nullif("categoria_original", F.lit("")).alias("categoria"), F.nullif(F.trim("fuente"), F.lit("")).alias("fuente"), "url", score.alias("score"), F.when(score.isNotNull(), label(score)).alias("etiqueta"))


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.article_triples(_articles(spark, sf_dir))


def kg_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many triples and subjects each property has."""
    return _triples(spark, sf_dir).groupBy("p", "tipo").agg(F.count("*").alias("n"), F.countDistinct("s").alias("sujetos"))


def kg_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ontology_triples(spark).groupBy("p").agg(F.count("*").alias("n"))


def kg_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.metadata(_triples(spark, sf_dir))


def kg_count_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.count_by_category(_triples(spark, sf_dir))


def kg_avg_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sentiment_by_category(_triples(spark, sf_dir)).withColumn("sentimiento_promedio", F.round("sentimiento_promedio", 6))


def kg_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.negative_articles(_triples(spark, sf_dir)).select("noticia", "titulo", "fecha", "score", "etiqueta")


def kg_author_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.author_output(_triples(spark, sf_dir))


def kg_optional_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with their source's label where they have one."""
    triples = _triples(spark, sf_dir)
    rows = graph.match(triples, [("?noticia", graph.RDF_TYPE, graph.ONTOLOGY + "Noticia")])
    more = [("?noticia", graph.ONTOLOGY + "provieneDe", "?f"), ("?f", graph.RDFS_LABEL, "?etiqueta")]
    return graph.optional(rows, triples, more).select("noticia", F.coalesce("etiqueta", F.lit("")).alias("etiqueta"))


def kg_union_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories and sources with their labels, as one list of entities."""
    triples = _triples(spark, sf_dir)
    parts = [graph.match(triples, [("?uri", graph.RDF_TYPE, graph.ONTOLOGY + kind), ("?uri", graph.RDFS_LABEL, "?etiqueta")]).withColumn("clase", F.lit(kind)) for kind in ("Categoria", "Fuente")]
    return parts[0].unionByName(parts[1]).distinct()


def kg_theta_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject areas whose description holds the label of a category, with the category's articles.

    The areas are a fixed small table, and only the distinct labels meet them.
    """
    counts = graph.count_by_category(_triples(spark, sf_dir))
    areas = read_table(spark, sf_dir, "materias").select("materia", F.lower("descripcion").alias("_d"))
    return counts.join(broadcast_if_small(areas), F.contains(F.col("_d"), F.lower("categoria"))).select("materia", "categoria", "total")


def kg_shape_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shape_violations(_triples(spark, sf_dir))


def kg_datatype_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.datatype_violations(_triples(spark, sf_dir)).groupBy("propiedad").agg(F.count("*").alias("n"))


def kg_entity_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category labels linked to the subject area of the same normalised name."""
    triples = _triples(spark, sf_dir)
    labels = graph.match(triples, [("?uri", graph.RDF_TYPE, graph.ONTOLOGY + "Categoria"), ("?uri", graph.RDFS_LABEL, "?etiqueta")])
    candidates = read_table(spark, sf_dir, "materias").select(F.concat(F.lit("urn:materia:"), "materia").alias("item"), F.col("nombre").alias("item_label"))
    return graph.link_entities(labels, candidates)


def kg_open_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of sources as records of an open dataset."""
    sources = read_table(spark, sf_dir, "fuentes").select("id", "nombre", "pais", "limite_noticias", "delay_segundos")
    return graph.record_triples(sources, "Catálogo de fuentes", "id").select("s", "p", "o", "tipo")


def kg_n_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip through N-Triples lines."""
    lines = graph.n_triples(_triples(spark, sf_dir))
    return graph.read_n_triples(lines).groupBy("p", "tipo").agg(F.count("*").alias("n"), F.countDistinct("s").alias("sujetos"))


def kg_json_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.json_ld(_triples(spark, sf_dir)).select("s", "json")


_PREFIXES = f"PREFIX o: <{graph.ONTOLOGY}> PREFIX dc: <{graph.DC}> PREFIX foaf: <http://xmlns.com/foaf/0.1/> PREFIX rdfs: <{graph.RDFS}>\n"


def sparql_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors by the number of their articles, from query text."""
    found = sparql.select(_triples(spark, sf_dir), _PREFIXES + "SELECT ?autor (COUNT(?noticia) AS ?total) WHERE { ?noticia a o:Noticia ; o:tieneAutor ?uri . ?uri foaf:name ?autor . } GROUP BY ?autor ORDER BY DESC(?total)")
    return found.select("autor", "total")


def sparql_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with a score below 0, the latest first."""
    return sparql.select(_triples(spark, sf_dir), _PREFIXES + "SELECT ?noticia ?titulo ?fecha ?score WHERE { ?noticia a o:Noticia ; dc:title ?titulo ; dc:date ?fecha ; o:sentimientoScore ?score . FILTER(?score < 0) } ORDER BY DESC(?fecha)")


def sparql_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score and number of the articles of each category."""
    text = "SELECT ?categoria (AVG(?score) AS ?media) (COUNT(?noticia) AS ?total) WHERE { ?noticia a o:Noticia ; o:tieneCategoria ?c ; o:sentimientoScore ?score . ?c rdfs:label ?categoria . } GROUP BY ?categoria ORDER BY ?categoria"
    return sparql.select(_triples(spark, sf_dir), _PREFIXES + text).select("categoria", F.round("media", 6).alias("media"), "total")


def sparql_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of an author's or source's name in capitals, with the source's label where there is one."""
    text = "SELECT DISTINCT ?noticia ?nombre ?f WHERE { ?noticia a o:Noticia { ?noticia o:tieneAutor ?a . ?a foaf:name ?n } UNION { ?noticia o:provieneDe ?s . ?s rdfs:label ?n } BIND(UCASE(?n) AS ?nombre) FILTER(STR(?n) = ?nombre && STRLEN(?n) > 3) OPTIONAL { ?noticia o:provieneDe ?s2 . ?s2 rdfs:label ?f } }"
    return sparql.select(_triples(spark, sf_dir), _PREFIXES + text).select("noticia", "nombre", F.coalesce("f", F.lit("")).alias("fuente"))


def kg_turtle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip through Turtle, a document a subject."""
    blocks = turtle.turtle(_triples(spark, sf_dir)).select(F.concat(F.lit(turtle.header()), "value").alias("value"))
    return turtle.read_turtle(blocks).groupBy("p", "tipo").agg(F.count("*").alias("n"), F.countDistinct("s").alias("sujetos"))


#: Shapes of the articles: what each must have, and the types of dates and addresses.
SHAPES = f"""
@prefix sh: <{turtle.SHACL}> . @prefix o: <{graph.ONTOLOGY}> . @prefix dc: <{graph.DC}> . @prefix xsd: <{graph.XSD}> .
o:FormaNoticia a sh:NodeShape ; sh:targetClass o:Noticia ;
    sh:property [ sh:path dc:title ; sh:minCount 1 ] ; sh:property [ sh:path dc:date ; sh:minCount 1 ; sh:datatype xsd:date ] ; sh:property [ sh:path o:tieneAutor ; sh:minCount 1 ] ;
    sh:property [ sh:path o:tieneCategoria ; sh:minCount 1 ] ; sh:property [ sh:path o:urlOriginal ; sh:minCount 1 ; sh:datatype xsd:anyURI ] .
"""


def kg_shapes_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the rules of a shapes document, by property and motive."""
    rules = turtle.shape_rules(turtle.read_turtle(spark.createDataFrame([(SHAPES,)], "value string")))
    return turtle.validate(_triples(spark, sf_dir), rules).groupBy("p", "motivo").agg(F.count("*").alias("n"))


def kg_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news(spark, sf_dir).select("pos", slug(F.col("autor"), "sin_valor").alias("slug"))


QUERIES = {
    f.__name__: f
    for f in (
        kg_triples, kg_ontology, kg_star_join, kg_count_by_category, kg_avg_by_category, kg_negative, kg_author_output, kg_optional_label, kg_union_entities, kg_theta_contains,
        kg_shape_violations, kg_datatype_violations, kg_entity_link, kg_open_data, kg_n_triples, kg_json_ld, kg_slugs, kg_turtle, kg_shapes_file, sparql_authors, sparql_negative, sparql_by_category, sparql_labels,
    )
}

_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(strip_accents(lower({0})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'sin_valor')"
_NEWS = f"""art AS (SELECT pos, titulo, cuerpo, fecha, autor, nullif(categoria_original, '') AS categoria, nullif(trim(fuente), '') AS fuente, url, round(calidad * 2 - 1, 3) AS score FROM noticias),
    kg AS (SELECT *, 'urn:datos:noticia_' || pos AS noticia, 'a_' || {_SLUG.format('autor')} AS a, 'c_' || {_SLUG.format('categoria')} AS c, 'f_' || {_SLUG.format('fuente')} AS f,
           CASE WHEN score IS NULL THEN NULL WHEN score >= 0.05 THEN 'positivo' WHEN score <= -0.05 THEN 'negativo' ELSE 'neutral' END AS etiqueta FROM art),
    an AS (SELECT DISTINCT a, autor FROM kg WHERE autor IS NOT NULL), cl AS (SELECT DISTINCT c, categoria FROM kg WHERE categoria IS NOT NULL), fl AS (SELECT DISTINCT f, fuente FROM kg WHERE fuente IS NOT NULL)"""
_XSD = graph.XSD
_COUNTS = f"""
    SELECT '{graph.RDF_TYPE}' AS p, 'uri' AS tipo, (SELECT count(*) FROM kg) + (SELECT count(DISTINCT a) FROM an) + (SELECT count(DISTINCT c) FROM cl) + (SELECT count(DISTINCT f) FROM fl) AS n,
           (SELECT count(*) FROM kg) + (SELECT count(DISTINCT a) FROM an) + (SELECT count(DISTINCT c) FROM cl) + (SELECT count(DISTINCT f) FROM fl) AS sujetos
    UNION ALL SELECT '{graph.DC}title', 'literal', count(titulo), count(titulo) FROM kg UNION ALL SELECT '{graph.DC}description', 'literal', count(cuerpo), count(cuerpo) FROM kg
    UNION ALL SELECT '{graph.DC}date', '{_XSD}date', count(fecha), count(fecha) FROM kg
    UNION ALL SELECT '{graph.ONTOLOGY}tieneAutor', 'uri', count(autor), count(autor) FROM kg UNION ALL SELECT '{graph.FOAF_NAME}', 'literal', count(*), count(DISTINCT a) FROM an
    UNION ALL SELECT '{graph.ONTOLOGY}tieneCategoria', 'uri', count(categoria), count(categoria) FROM kg
    UNION ALL SELECT '{graph.RDFS_LABEL}', 'literal', (SELECT count(*) FROM cl) + (SELECT count(*) FROM fl), (SELECT count(DISTINCT c) FROM cl) + (SELECT count(DISTINCT f) FROM fl)
    UNION ALL SELECT '{graph.ONTOLOGY}provieneDe', 'uri', count(fuente), count(fuente) FROM kg
    UNION ALL SELECT '{graph.ONTOLOGY}sentimientoScore', '{_XSD}float', count(score), count(score) FROM kg UNION ALL SELECT '{graph.ONTOLOGY}sentimientoEtiqueta', 'literal', count(score), count(score) FROM kg
    UNION ALL SELECT '{graph.ONTOLOGY}urlOriginal', '{_XSD}anyURI', count(url), count(url) FROM kg"""
_LABEL_KEY = "trim(regexp_replace(strip_accents(lower({0})), '[^a-z0-9]+', ' ', 'g'))"

ORACLES = {
    "kg_triples": f"WITH {_NEWS} {_COUNTS}",
    "kg_star_join": f"WITH {_NEWS} SELECT noticia, titulo, an.autor, cl.categoria, fecha FROM kg JOIN an USING (a) JOIN cl USING (c) WHERE titulo IS NOT NULL AND fecha IS NOT NULL AND kg.autor IS NOT NULL AND kg.categoria IS NOT NULL",
    "kg_count_by_category": f"WITH {_NEWS} SELECT cl.categoria, count(*) AS total FROM kg JOIN cl USING (c) WHERE kg.categoria IS NOT NULL GROUP BY 1",
    "kg_avg_by_category": f"WITH {_NEWS} SELECT cl.categoria, round(avg(score), 6) AS sentimiento_promedio, count(*) AS total FROM kg JOIN cl USING (c) WHERE kg.categoria IS NOT NULL AND score IS NOT NULL GROUP BY 1",
    "kg_negative": f"WITH {_NEWS} SELECT noticia, titulo, fecha, CAST(score AS VARCHAR) AS score, etiqueta FROM kg WHERE score < -0.05 AND titulo IS NOT NULL AND fecha IS NOT NULL",
    "kg_author_output": f"""WITH {_NEWS}, r AS (SELECT an.autor, titulo, noticia FROM kg JOIN an USING (a) WHERE kg.autor IS NOT NULL AND titulo IS NOT NULL),
        k AS (SELECT *, row_number() OVER (PARTITION BY autor ORDER BY titulo, noticia) AS k FROM r) SELECT autor, count(*) AS publicaciones, string_agg(titulo, '; ' ORDER BY k) FILTER (k <= 5) AS titulos FROM k GROUP BY 1""",
    "kg_optional_label": f"WITH {_NEWS} SELECT noticia, coalesce(fl.fuente, '') AS etiqueta FROM kg LEFT JOIN fl ON kg.f = fl.f AND kg.fuente IS NOT NULL",
    "kg_union_entities": f"WITH {_NEWS} SELECT DISTINCT 'urn:datos:categoria_' || substr(c, 3) AS uri, categoria AS etiqueta, 'Categoria' AS clase FROM cl UNION SELECT DISTINCT 'urn:datos:fuente_' || substr(f, 3), fuente, 'Fuente' FROM fl",
    "kg_theta_contains": f"""WITH {_NEWS}, t AS (SELECT cl.categoria, count(*) AS total FROM kg JOIN cl USING (c) WHERE kg.categoria IS NOT NULL GROUP BY 1)
        SELECT materia, categoria, total FROM t JOIN materias ON contains(lower(descripcion), lower(categoria))""",
    "kg_shape_violations": f"""WITH {_NEWS}, v AS (SELECT noticia, unnest([CASE WHEN titulo IS NULL THEN 'titulo' END, CASE WHEN fecha IS NULL THEN 'fecha' END, CASE WHEN autor IS NULL THEN 'autor' END, CASE WHEN categoria IS NULL THEN 'categoria' END, CASE WHEN url IS NULL THEN 'url' END]) AS propiedad FROM kg)
        SELECT noticia AS recurso, propiedad FROM v WHERE propiedad IS NOT NULL""",
    "kg_entity_link": f"""WITH {_NEWS}, m AS (SELECT {_LABEL_KEY.format('nombre')} AS k, min('urn:materia:' || materia) AS item FROM materias GROUP BY 1)
        SELECT DISTINCT 'urn:datos:categoria_' || substr(c, 3) AS uri, categoria AS etiqueta, item FROM cl JOIN m ON m.k = {_LABEL_KEY.format('categoria')} AND m.k <> ''""",
    "kg_open_data": f"""WITH r AS (SELECT 'urn:datos:registro/catalogo_de_fuentes_' || id AS s, unnest([['nombre', nombre, 'literal'], ['pais', pais, 'literal'], ['limite_noticias', CAST(limite_noticias AS VARCHAR), '{_XSD}float'], ['delay_segundos', CAST(delay_segundos AS VARCHAR), '{_XSD}float']]) AS x FROM fuentes)
        SELECT s, 'urn:datos:' || x[1] AS p, x[2] AS o, x[3] AS tipo FROM r WHERE x[2] IS NOT NULL""",
    "kg_n_triples": f"WITH {_NEWS} {_COUNTS}",
    "kg_turtle": f"WITH {_NEWS} {_COUNTS}",
    "kg_shapes_file": f"""WITH {_NEWS}, v AS (SELECT unnest([
            CASE WHEN titulo IS NULL THEN ['{graph.DC}title', 'minCount'] END, CASE WHEN fecha IS NULL THEN ['{graph.DC}date', 'minCount'] END, CASE WHEN autor IS NULL THEN ['{graph.ONTOLOGY}tieneAutor', 'minCount'] END,
            CASE WHEN categoria IS NULL THEN ['{graph.ONTOLOGY}tieneCategoria', 'minCount'] END, CASE WHEN url IS NULL THEN ['{graph.ONTOLOGY}urlOriginal', 'minCount'] END,
            CASE WHEN fecha IS NOT NULL AND NOT (regexp_full_match(fecha, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND try_strptime(fecha, '%Y-%m-%d') IS NOT NULL) THEN ['{graph.DC}date', 'datatype'] END,
            CASE WHEN NOT regexp_full_match(url, '[A-Za-z][A-Za-z0-9+.-]*:[^\\s<>]+') THEN ['{graph.ONTOLOGY}urlOriginal', 'datatype'] END]) AS x FROM kg)
        SELECT x[1] AS p, x[2] AS motivo, count(*) AS n FROM v WHERE x IS NOT NULL GROUP BY 1, 2""",
    "sparql_authors": f"WITH {_NEWS} SELECT an.autor, count(*) AS total FROM kg JOIN an USING (a) WHERE kg.autor IS NOT NULL GROUP BY 1",
    "sparql_negative": f"WITH {_NEWS} SELECT noticia, titulo, fecha, CAST(score AS VARCHAR) AS score FROM kg WHERE score < 0 AND titulo IS NOT NULL AND fecha IS NOT NULL",
    "sparql_by_category": f"WITH {_NEWS} SELECT cl.categoria, round(avg(score), 6) AS media, count(*) AS total FROM kg JOIN cl USING (c) WHERE kg.categoria IS NOT NULL AND score IS NOT NULL GROUP BY 1",
    "sparql_labels": f"""WITH {_NEWS}, n AS (SELECT noticia, an.autor AS n, kg.f, kg.fuente FROM kg JOIN an USING (a) WHERE kg.autor IS NOT NULL UNION ALL SELECT noticia, fl.fuente, kg.f, kg.fuente FROM kg JOIN fl ON kg.f = fl.f WHERE kg.fuente IS NOT NULL)
        SELECT DISTINCT noticia, n AS nombre, coalesce(fl.fuente, '') AS fuente FROM n LEFT JOIN fl ON n.f = fl.f AND n.fuente IS NOT NULL WHERE n = upper(n) AND length(n) > 3""",
    "kg_slugs": f"SELECT pos, {_SLUG.format('autor')} AS slug FROM noticias",
    "kg_datatype_violations": f"""WITH v AS (SELECT '{graph.DC}date' AS propiedad FROM noticias WHERE fecha IS NOT NULL AND NOT (regexp_full_match(fecha, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND try_strptime(fecha, '%Y-%m-%d') IS NOT NULL)
        UNION ALL SELECT '{graph.ONTOLOGY}urlOriginal' FROM noticias WHERE url IS NOT NULL AND NOT regexp_full_match(url, '[A-Za-z][A-Za-z0-9+.-]*:[^\\s<>]+')) SELECT propiedad, count(*) AS n FROM v GROUP BY 1""",
    "kg_ontology": f"""SELECT * FROM (VALUES ('{graph.RDF_TYPE}', 10), ('{graph.RDFS}subClassOf', 3), ('{graph.RDFS}domain', 6), ('{graph.RDFS}range', 6)) AS v(p, n)""",
}
