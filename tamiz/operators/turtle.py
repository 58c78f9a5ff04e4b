"""Turtle documents as tables of triples and back, and shapes read from them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.operators import graph
from tamiz.operators.sparql import Parser
from tamiz.session import broadcast_if_small

PREFIXES = {"d": graph.DATA, "o": graph.ONTOLOGY, "dc": graph.DC, "xsd": graph.XSD, "rdfs": graph.RDFS, "foaf": "http://xmlns.com/foaf/0.1/", "owl": graph.OWL, "skos": graph.SKOS}
#: Namespace of the shapes vocabulary (fixed value).
SHACL = "http://www.w3.org/ns/shacl#"

_TRIPLE = "s string, p string, o string, tipo string, lengua string"


class _Document(Parser):
    """The statements of one Turtle document."""

    def read(self) -> list[tuple]:
        self.rows: list[tuple] = []
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if text.lower() in ("@prefix", "@base", "prefix"):
                self.next()
                name = self.next()[1]
                self.prefixes[name.rstrip(":")] = self.next()[1][1:-1]
                if kind == "tag":
                    self.need(".")
                continue
            self.predicates(self.node())
            self.need(".")
        return self.rows

    def node(self) -> str:
        """A resource; a list of properties in brackets is one without a name."""
        if self.take("["):
            name = f"_:b{len(self.rows)}x{self.at}"
            if self.peek()[1] != "]":
                self.predicates(name)
            self.need("]")
            return name
        kind, text = self.peek()
        if kind == "name" and text.startswith("_:"):
            self.next()
            return text
        return self.term()[1]

    def predicates(self, subject: str) -> None:
        while True:
            if self.peek() == ("word", "a"):
                self.next()
                predicate = graph.RDF_TYPE
            else:
                predicate = self.term()[1]
            while True:
                self.rows.append((subject, predicate, *self.value()))
                if not self.take(","):
                    break
            while self.take(";"):
                pass
            if self.peek()[1] in (".", "]") or self.peek()[0] == "end":
                return

    def value(self) -> tuple[str, str, str | None]:
        kind, text = self.peek()
        if kind == "string":
            term = self.term()
            return term[1], self.datatype or "literal", term[2]
        if kind == "number":
            return self.next()[1], graph.XSD + ("integer" if text.lstrip("+-").isdigit() else "decimal"), None
        if kind == "word" and text in ("true", "false"):
            return self.next()[1], graph.XSD + "boolean", None
        return self.node(), "uri", None


def read_turtle(documents: DataFrame, text: str = "value") -> DataFrame:
    """Triples of Turtle documents, one a row of ``text`` (such as a source of whole text files); an ill-formed one is an error."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([row for x in frame[text] if x for row in _Document(x).read()], columns=["s", "p", "o", "tipo", "lengua"])

    return documents.select(text).mapInPandas(read, _TRIPLE)


def header(prefixes: dict[str, str] = PREFIXES) -> str:
    """The prefix lines of a document."""
    return "".join(f"@prefix {name}: <{iri}> .\n" for name, iri in prefixes.items())


def _named(iri: Column, prefixes: dict[str, str]) -> Column:
    """An IRI by its prefix where what follows is a plain name."""
    choices = []
    for name, start in prefixes.items():
        local = F.substring(iri, len(start) + 1, 1_000_000)
        choices.append(F.when(iri.startswith(start) & local.rlike(r"^[A-Za-z0-9_]([A-Za-z0-9_-]*[A-Za-z0-9_])?$"), F.concat(F.lit(name + ":"), local)))
    return F.coalesce(F.when(iri.startswith("_:"), iri), *choices, F.concat(F.lit("<"), iri, F.lit(">")))


def turtle(triples: DataFrame, prefixes: dict[str, str] = PREFIXES) -> DataFrame:
    """(value): a block of Turtle for each subject, to stand below :func:`header`."""
    escaped = F.col("o")
    for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(written))
    mark = F.when(F.col("lengua").isNotNull(), F.concat(F.lit("@"), "lengua")).when(F.col("tipo") != "literal", F.concat(F.lit("^^"), _named(F.col("tipo"), prefixes))).otherwise("")
    value = F.when(F.col("tipo") == "uri", _named(F.col("o"), prefixes)).otherwise(F.concat(F.lit('"'), escaped, F.lit('"'), mark))
    predicate = F.when(F.col("p") == graph.RDF_TYPE, "a").otherwise(_named(F.col("p"), prefixes))
    lines = triples.select("s", predicate.alias("p"), value.alias("v")).groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_set("v")), " , ").alias("v"))
    facts = F.array_join(F.array_sort(F.collect_list(F.concat("p", F.lit(" "), "v"))), " ;\n    ")
    return lines.groupBy("s").agg(facts.alias("f")).select(F.concat(_named(F.col("s"), prefixes), F.lit(" "), "f", F.lit(" .\n")).alias("value"))


def shape_rules(shapes: DataFrame) -> DataFrame:
    """(clase, p, minimo, maximo, tipo, mensaje): the property rules of the node shapes in a table of triples."""
    def of(name: str, alias: str) -> DataFrame:
        return shapes.where(F.col("p") == SHACL + name).select(F.col("s").alias("_s"), F.col("o").alias(alias))

    rules = of("targetClass", "clase").join(of("property", "_rule"), "_s").drop("_s").join(of("path", "p").withColumnRenamed("_s", "_rule"), "_rule")
    for name, alias in (("minCount", "minimo"), ("maxCount", "maximo"), ("datatype", "tipo"), ("message", "mensaje")):
        rules = rules.join(of(name, alias).withColumnRenamed("_s", "_rule"), "_rule", "left")
    return rules.select("clase", "p", F.col("minimo").cast("int").alias("minimo"), F.col("maximo").cast("int").alias("maximo"), "tipo", "mensaje")


def _fits(value: Column, datatype: Column) -> Column:
    """Whether the form of a literal is one of its datatype; unknown datatypes have any form."""
    forms = {
        "date": F.try_to_date(value, "yyyy-MM-dd").isNotNull() & value.rlike(r"^\d{4}-\d{2}-\d{2}$"), "anyURI": value.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>]+$"),
        "integer": value.rlike(r"^[+-]?\d+$"), "decimal": value.rlike(r"^[+-]?\d*\.?\d+$"), "float": value.try_cast("double").isNotNull(), "boolean": value.isin("true", "false", "0", "1"),
    }
    out = F.lit(True)
    for name, form in forms.items():
        out = F.when(datatype == graph.XSD + name, form).otherwise(out)
    return out


def validate(triples: DataFrame, rules: DataFrame) -> DataFrame:
    """(recurso, p, motivo, mensaje): what members of the rules' classes violate: ``minCount``, ``maxCount`` or ``datatype``."""
    rules = broadcast_if_small(rules)
    members = triples.where(F.col("p") == graph.RDF_TYPE).select("s", F.col("o").alias("clase")).distinct()
    wanted = members.join(rules, "clase")
    held = triples.join(broadcast_if_small(rules.select("p").distinct()), "p", "left_semi").select("s", "p", "o", F.col("tipo").alias("_t"))
    joined = wanted.join(held, ["s", "p"], "left")
    wrong = F.col("tipo").isNotNull() & F.col("o").isNotNull() & ((F.col("_t") != F.col("tipo")) | ~_fits(F.col("o"), F.col("tipo")))
    counted = joined.groupBy("s", "clase", "p", "minimo", "maximo", "tipo", "mensaje").agg(F.count("o").alias("_n"), F.count_if(wrong).alias("_wrong"))
    motives = F.array_compact(F.array(F.when(F.col("_n") < F.col("minimo"), "minCount"), F.when(F.col("_n") > F.col("maximo"), "maxCount"), F.when(F.col("_wrong") > 0, "datatype")))
    return counted.select(F.col("s").alias("recurso"), "p", F.explode(motives).alias("motivo"), "mensaje")
