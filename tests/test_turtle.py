import pytest

from tamiz.operators import graph, turtle

SHAPES = """
@prefix sh: <http://www.w3.org/ns/shacl#> .
@prefix o: <urn:ontologia:> .
@prefix dc: <http://purl.org/dc/elements/1.1/> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
# rules
o:Forma a sh:NodeShape ; sh:targetClass o:Noticia ;
    sh:property [ sh:path dc:title ; sh:minCount 1 ; sh:maxCount 1 ; sh:message "título" ; ] ;
    sh:property [ sh:path dc:date ; sh:minCount 1 ; sh:datatype xsd:date ] .
"""


def frame(spark, rows):
    return spark.createDataFrame(rows, "s string, p string, o string, tipo string, lengua string")


def test_round_trip(spark):
    rows = [
        ("urn:datos:n1", graph.RDF_TYPE, graph.ONTOLOGY + "Noticia", "uri", None), ("urn:datos:n1", graph.DC + "title", 'Dice "sí"\\no\n\tno; . # [', "literal", "es"), ("urn:datos:n1", graph.DC + "title", "Otro", "literal", None),
        ("urn:datos:n1", graph.DC + "date", "2023-01-02", graph.XSD + "date", None), ("http://x.example/a?b=1#c", graph.ONTOLOGY + "url", "http://x.example/é", graph.XSD + "anyURI", None), ("urn:datos:n-1.", graph.ONTOLOGY + "de", "urn:datos:n1", "uri", None),
    ]
    text = turtle.header() + "".join(r.value for r in turtle.turtle(frame(spark, rows)).collect())
    read = turtle.read_turtle(spark.createDataFrame([(text, 1)], "value string, s int"))
    assert sorted(map(tuple, read.collect()), key=str) == sorted(rows, key=str)
    assert turtle.turtle(frame(spark, rows).limit(0)).count() == 0


def test_reading(spark):
    text = "@prefix p: <urn:p:> .\np:a p:b 3 , -1.5 , true ; a p:C ; .\n_:x p:in [ p:y 'z'@en ; p:w [] ] ."
    rows = [tuple(r) for r in turtle.read_turtle(spark.createDataFrame([(text,), (None,), ("",)], "value string")).collect()]
    assert ("urn:p:a", "urn:p:b", "3", graph.XSD + "integer", None) in rows and ("urn:p:a", "urn:p:b", "-1.5", graph.XSD + "decimal", None) in rows
    assert ("urn:p:a", graph.RDF_TYPE, "urn:p:C", "uri", None) in rows and len(rows) == 7
    with pytest.raises(Exception, match="expected|unexpected|unknown"):
        turtle.read_turtle(spark.createDataFrame([("p:a p:b .",)], "value string")).collect()


def test_shapes(spark):
    rules = turtle.shape_rules(turtle.read_turtle(spark.createDataFrame([(SHAPES,)], "value string")))
    assert {(r.p[-5:], r.minimo, r.maximo, r.mensaje) for r in rules.collect()} == {("title", 1, 1, "título"), ("/date", 1, None, None)}
    rows = []
    for name, titles, date, kind in (("bien", ["T"], "2023-01-02", "date"), ("sin", [], "2023-01-02", "date"), ("dos", ["a", "b"], "2023-13-02", "date"), ("otro", ["T"], "2023-01-02", "string"), ("nada", ["T"], None, None)):
        rows += [(name, graph.RDF_TYPE, graph.ONTOLOGY + "Noticia", "uri", None), *((name, graph.DC + "title", t, "literal", "es") for t in titles)]
        rows += [(name, graph.DC + "date", date, graph.XSD + kind, None)] if date else []
    found = {(r.recurso, r.motivo) for r in turtle.validate(frame(spark, rows), rules).collect()}
    assert found == {("sin", "minCount"), ("dos", "maxCount"), ("dos", "datatype"), ("otro", "datatype"), ("nada", "minCount")}
