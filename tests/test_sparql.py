import pytest

from tamiz.operators import graph, sparql

PREFIXES = f"PREFIX o: <{graph.ONTOLOGY}> PREFIX dc: <{graph.DC}> PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>\n"


@pytest.fixture(scope="module")
def triples(spark):
    rows = []
    for i, (title, score, cat) in enumerate([("Uno", "0.5", "a"), ("Dos y más", "-0.2", "a"), ("Tres", "-0.9", "b"), ("Cuatro", None, None)]):
        s = f"urn:n{i}"
        rows += [(s, graph.RDF_TYPE, graph.ONTOLOGY + "Noticia", "uri", None), (s, graph.DC + "title", title, "literal", "es")]
        if score:
            rows += [(s, graph.ONTOLOGY + "score", score, "literal", None), (s, graph.ONTOLOGY + "cat", f"urn:{cat}", "uri", None)]
    rows += [("urn:a", graph.RDFS_LABEL, "Alfa", "literal", "es"), ("urn:b", graph.RDFS_LABEL, "Beta", "literal", "en")]
    return spark.createDataFrame(rows, "s string, p string, o string, tipo string, lengua string")


def run(triples, text):
    return [tuple(r) for r in sparql.select(triples, PREFIXES + text).collect()]


def test_patterns_filters_and_order(triples):
    assert run(triples, "SELECT ?t ?x WHERE { ?n a o:Noticia ; dc:title ?t ; o:score ?x . FILTER(?x < 0) } ORDER BY DESC(?t)") == [("Tres", "-0.9"), ("Dos y más", "-0.2")]
    assert run(triples, "SELECT ?t { ?n dc:title ?t FILTER(CONTAINS(LCASE(?t), 'más') || ?t = \"Uno\"@es) } ORDER BY ?t") == [("Dos y más",), ("Uno",)]
    assert run(triples, "SELECT ?n { ?n dc:title \"Uno\"@es }") == [("urn:n0",)] and run(triples, "SELECT ?n { ?n dc:title \"Uno\"@en }") == []
    assert run(triples, "SELECT ?t { ?n dc:title ?t } ORDER BY ?t LIMIT 1 OFFSET 2") == [("Tres",)]


def test_optional_union_minus_bind(triples):
    got = run(triples, "SELECT ?t ?l WHERE { ?n dc:title ?t OPTIONAL { ?n o:cat ?c . ?c rdfs:label ?l } } ORDER BY ?t")
    assert got == [("Cuatro", None), ("Dos y más", "Alfa"), ("Tres", "Beta"), ("Uno", "Alfa")]
    assert run(triples, "SELECT ?t { ?n dc:title ?t MINUS { ?n o:score ?x } }") == [("Cuatro",)]
    assert sorted(run(triples, "SELECT DISTINCT ?v { { ?n dc:title ?v } UNION { ?c rdfs:label ?v } FILTER(STRLEN(?v) = 4) }")) == [("Alfa",), ("Beta",), ("Tres",)]
    assert run(triples, "SELECT ?u { ?n dc:title ?t BIND(UCASE(?t) AS ?u) FILTER(!(?t != 'Uno')) }") == [("UNO",)]


def test_aggregates(triples):
    text = 'SELECT ?l (AVG(?x) AS ?m) (COUNT(?n) AS ?k) (GROUP_CONCAT(?t; SEPARATOR="|") AS ?ts) WHERE { ?n o:cat ?c ; o:score ?x ; dc:title ?t . ?c rdfs:label ?l } GROUP BY ?l ORDER BY ?l'
    got = run(triples, text)
    assert [(a, round(b, 6), c, d) for a, b, c, d in got] == [("Alfa", 0.15, 2, "Dos y más|Uno"), ("Beta", -0.9, 1, "Tres")]
    assert run(triples, "SELECT (COUNT(DISTINCT ?c) AS ?k) WHERE { ?n o:cat ?c }") == [(2,)]
    assert run(triples, "SELECT ?c (COUNT(*) AS ?k) WHERE { ?n o:cat ?c } GROUP BY ?c HAVING (COUNT(*) > 1)") == [("urn:a", 2)]


@pytest.mark.parametrize(
    "text",
    ["SELECT ?x WHERE { ?a dc:title ?x . ?b rdfs:label ?y }", "SELECT ?x { ?a nada:x ?x }", "SELECT ?z { ?a dc:title ?x }", "SELECT ?x { ?a dc:title ?x } %", "SELECT ?x (COUNT(?a) AS ?k) { ?a dc:title ?x ; o:cat ?c } GROUP BY ?c", "SELECT ?x { ?a dc:title ?x FILTER(RARA(?x)) }", "SELECT ?x {"],
)
def test_refused(triples, text):
    with pytest.raises(ValueError):
        run(triples, text)


def test_empty(triples):
    assert run(triples.limit(0), "SELECT ?t { ?n dc:title ?t }") == []
