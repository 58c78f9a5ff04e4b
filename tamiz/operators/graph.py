"""A corpus as a table of triples (s, p, o, tipo, lengua), pattern queries over it, and shape checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.functions.text import label_key, slug

DATA, ONTOLOGY = "urn:datos:", "urn:ontologia:"
# Public vocabularies.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
DC = "http://purl.org/dc/elements/1.1/"
FOAF_NAME = "http://xmlns.com/foaf/0.1/name"
XSD = "http://www.w3.org/2001/XMLSchema#"
OWL, SKOS, RDFS, SCHEMA = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2004/02/skos/core#", "http://www.w3.org/2000/01/rdf-schema#", "https://schema.org/"

CLASSES = ["Noticia", "Autor", "Categoria", "Fuente"]
#: Properties that every article must have, by name.
SHAPE = {"titulo": DC + "title", "fecha": DC + "date", "autor": ONTOLOGY + "tieneAutor", "categoria": ONTOLOGY + "tieneCategoria", "url": ONTOLOGY + "urlOriginal"}


def _uri(value: str | Column, of: Column | str) -> Column:
    return F.struct(F.lit(of).alias("p") if isinstance(of, str) else of.alias("p"), (F.lit(value) if isinstance(value, str) else value).alias("o"), F.lit("uri").alias("tipo"), F.lit(None).cast("string").alias("lengua"))


def _literal(value: Column, predicate: str, datatype: str | None = None, language: str | None = None) -> Column:
    return F.struct(F.lit(predicate).alias("p"), value.cast("string").alias("o"), F.lit(datatype or "literal").alias("tipo"), F.lit(language).cast("string").alias("lengua"))


def article_triples(df: DataFrame) -> DataFrame:
    """Triples of (pos, titulo, cuerpo, fecha, autor, categoria, fuente, url, score, etiqueta), as a set.

    A null field gives no triple; descriptions hold 200 characters; authors,
    categories and sources are resources named by the slug of their text.
    """
    author, category, source = (F.concat(F.lit(DATA + kind), slug(F.col(column), "sin_valor")) for kind, column in (("autor_", "autor"), ("categoria_", "categoria"), ("fuente_", "fuente")))
    subject = F.concat(F.lit(DATA + "noticia_"), F.col("pos").cast("string"))

    def of(s: Column, condition: Column, *facts: Column) -> Column:
        return F.when(condition, F.transform(F.array(*facts), lambda x: F.struct(s.alias("s"), x["p"].alias("p"), x["o"].alias("o"), x["tipo"].alias("tipo"), x["lengua"].alias("lengua"))))

    have = {c: F.col(c).isNotNull() for c in ("autor", "categoria", "fuente", "score", "etiqueta", "url")}
    facts = [
        of(subject, F.lit(True), _uri(ONTOLOGY + "Noticia", RDF_TYPE), _literal(F.col("titulo"), DC + "title", language="es"), _literal(F.substring("cuerpo", 1, 200), DC + "description", language="es"), _literal(F.col("fecha"), DC + "date", XSD + "date")),
        of(subject, have["autor"], _uri(author, ONTOLOGY + "tieneAutor")),
        of(author, have["autor"], _uri(ONTOLOGY + "Autor", RDF_TYPE), _literal(F.col("autor"), FOAF_NAME)),
        of(subject, have["categoria"], _uri(category, ONTOLOGY + "tieneCategoria")),
        of(category, have["categoria"], _uri(ONTOLOGY + "Categoria", RDF_TYPE), _literal(F.col("categoria"), RDFS_LABEL, language="es")),
        of(subject, have["fuente"], _uri(source, ONTOLOGY + "provieneDe")),
        of(source, have["fuente"], _uri(ONTOLOGY + "Fuente", RDF_TYPE), _literal(F.col("fuente"), RDFS_LABEL)),
        of(subject, have["score"], _literal(F.col("score"), ONTOLOGY + "sentimientoScore", XSD + "float")),
        of(subject, have["etiqueta"], _literal(F.col("etiqueta"), ONTOLOGY + "sentimientoEtiqueta")),
        of(subject, have["url"], _literal(F.col("url"), ONTOLOGY + "urlOriginal", XSD + "anyURI")),
    ]
    rows = df.select(F.explode(F.flatten(F.array_compact(F.array(*facts)))).alias("t")).select("t.*")
    return rows.where("s IS NOT NULL AND o IS NOT NULL").distinct()


def ontology_triples(spark) -> DataFrame:
    """Classes, super-classes, domains and ranges of the vocabulary."""
    rows = [(ONTOLOGY + c, RDF_TYPE, OWL + "Class") for c in CLASSES]
    rows += [(ONTOLOGY + c, RDFS + "subClassOf", parent) for c, parent in (("Noticia", SCHEMA + "NewsArticle"), ("Autor", "http://xmlns.com/foaf/0.1/Person"), ("Fuente", SCHEMA + "Organization"))]
    for name, range_ in (("tieneAutor", "Autor"), ("tieneCategoria", "Categoria"), ("provieneDe", "Fuente")):
        rows += [(ONTOLOGY + name, RDF_TYPE, OWL + "ObjectProperty"), (ONTOLOGY + name, RDFS + "domain", ONTOLOGY + "Noticia"), (ONTOLOGY + name, RDFS + "range", ONTOLOGY + range_)]
    for name, range_ in (("sentimientoScore", "float"), ("sentimientoEtiqueta", "string"), ("urlOriginal", "anyURI")):
        rows += [(ONTOLOGY + name, RDF_TYPE, OWL + "DatatypeProperty"), (ONTOLOGY + name, RDFS + "domain", ONTOLOGY + "Noticia"), (ONTOLOGY + name, RDFS + "range", XSD + range_)]
    return spark.createDataFrame([(*r, "uri", None) for r in rows], "s string, p string, o string, tipo string, lengua string")


def record_triples(df: DataFrame, dataset: str, ident: str, base: str = DATA) -> DataFrame:
    """Triples of the rows of an open dataset: one resource a row, one property a column, numbers as floats."""
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")}
    columns = [c for c in df.columns if c != ident]
    pairs = [F.struct(F.concat(F.lit(base), slug(F.lit(c))).alias("p"), F.col(c).cast("string").alias("o"), F.lit(XSD + "float" if c in numeric else "literal").alias("tipo")) for c in columns]
    subject = F.concat(F.lit(f"{base}registro/"), slug(F.lit(dataset)), F.lit("_"), F.col(ident).cast("string"))
    return df.select(subject.alias("s"), F.explode(F.array(*pairs)).alias("x")).select("s", "x.p", "x.o", "x.tipo", F.lit(None).cast("string").alias("lengua")).where("o IS NOT NULL")


def match(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Inner join of triple patterns; ``?name`` is a variable, anything else a constant.

    Constants become filters on the triple table before any join, and each join
    is on all variables that the pattern shares with those before it; a pattern
    that shares none is refused.
    """
    result: DataFrame | None = None
    for pattern in patterns:
        rows = triples
        names: dict[str, str] = {}
        for column, term in zip("spo", pattern, strict=True):
            if not term.startswith("?"):
                rows = rows.where(F.col(column) == term)
            elif term[1:] in names:
                rows = rows.where(F.col(column) == F.col(names[term[1:]]))
            else:
                names[term[1:]] = column
        rows = rows.select(*(F.col(column).alias(name) for name, column in names.items()))
        if result is None:
            result = rows
            continue
        shared = [n for n in names if n in result.columns]
        if not shared:
            raise ValueError(f"pattern {pattern} shares no variable with those before it")
        result = result.join(rows, shared)
    if result is None:
        raise ValueError("no pattern")
    return result


def optional(rows: DataFrame, triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Left join of further patterns on the variables they share."""
    more = match(triples, patterns)
    return rows.join(more, [c for c in more.columns if c in rows.columns], "left")


def metadata(triples: DataFrame) -> DataFrame:
    """(noticia, titulo, autor, categoria, fecha) of every article."""
    star = [("?noticia", RDF_TYPE, ONTOLOGY + "Noticia"), ("?noticia", DC + "title", "?titulo"), ("?noticia", DC + "date", "?fecha"), ("?noticia", ONTOLOGY + "tieneAutor", "?a"), ("?noticia", ONTOLOGY + "tieneCategoria", "?c"), ("?a", FOAF_NAME, "?autor"), ("?c", RDFS_LABEL, "?categoria")]
    return match(triples, star).select("noticia", "titulo", "autor", "categoria", "fecha")


def count_by_category(triples: DataFrame) -> DataFrame:
    rows = match(triples, [("?noticia", RDF_TYPE, ONTOLOGY + "Noticia"), ("?noticia", ONTOLOGY + "tieneCategoria", "?c"), ("?c", RDFS_LABEL, "?categoria")])
    return rows.groupBy("categoria").agg(F.count("noticia").alias("total"))


def sentiment_by_category(triples: DataFrame) -> DataFrame:
    rows = match(triples, [("?noticia", ONTOLOGY + "tieneCategoria", "?c"), ("?noticia", ONTOLOGY + "sentimientoScore", "?score"), ("?c", RDFS_LABEL, "?categoria")])
    return rows.groupBy("categoria").agg(F.avg(F.col("score").cast("double")).alias("sentimiento_promedio"), F.count("noticia").alias("total"))


def negative_articles(triples: DataFrame, below: float = -0.05) -> DataFrame:
    rows = match(triples, [("?noticia", RDF_TYPE, ONTOLOGY + "Noticia"), ("?noticia", DC + "title", "?titulo"), ("?noticia", DC + "date", "?fecha"), ("?noticia", ONTOLOGY + "sentimientoScore", "?score"), ("?noticia", ONTOLOGY + "sentimientoEtiqueta", "?etiqueta")])
    return rows.where(F.col("score").cast("double") < below)


def author_output(triples: DataFrame, most: int = 5) -> DataFrame:
    """(autor, publicaciones, titulos): the first ``most`` titles in order, joined by semicolons."""
    rows = match(triples, [("?n", RDF_TYPE, ONTOLOGY + "Noticia"), ("?n", DC + "title", "?titulo"), ("?n", ONTOLOGY + "tieneAutor", "?a"), ("?a", FOAF_NAME, "?autor")])
    from pyspark.sql import Window

    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("autor").orderBy("titulo", "n")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= most, F.struct("_r", "titulo")))), lambda x: x["titulo"]), "; ")
    return ranked.groupBy("autor").agg(F.count("*").alias("publicaciones"), joined.alias("titulos"))


def shape_violations(triples: DataFrame, shape: dict[str, str] = SHAPE) -> DataFrame:
    """(recurso, propiedad): articles that lack a required property; one aggregate, no join a property."""
    wanted = F.array(*[F.lit(p) for p in shape.values()])
    articles = triples.groupBy("s").agg(F.max((F.col("p") == RDF_TYPE) & (F.col("o") == ONTOLOGY + "Noticia")).alias("_is"), F.collect_set(F.when(F.array_contains(wanted, F.col("p")), F.col("p"))).alias("_have")).where("_is")
    named = F.create_map(*[x for name, p in shape.items() for x in (F.lit(p), F.lit(name))])
    lacking = F.explode(F.array_except(wanted, "_have")).alias("_p")
    return articles.select(F.col("s").alias("recurso"), lacking).select("recurso", named[F.col("_p")].alias("propiedad"))


def datatype_violations(triples: DataFrame) -> DataFrame:
    """(recurso, propiedad, valor): dates and URLs whose literal does not have the form of its type."""
    date = (F.col("p") == DC + "date") & F.try_to_date("o", "yyyy-MM-dd").isNull()
    url = (F.col("p") == ONTOLOGY + "urlOriginal") & ~F.col("o").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>]+$")
    return triples.where(date | url).select(F.col("s").alias("recurso"), F.col("p").alias("propiedad"), F.col("o").alias("valor"))


def link_entities(labels: DataFrame, candidates: DataFrame) -> DataFrame:
    """(uri, etiqueta, item): local labels that one candidate (item, item_label) has after normalisation; the least item wins."""
    known = candidates.select("item", label_key(F.col("item_label")).alias("_k")).where("_k <> ''").groupBy("_k").agg(F.min("item").alias("item"))
    return labels.select("uri", "etiqueta", label_key(F.col("etiqueta")).alias("_k")).join(known, "_k").select("uri", "etiqueta", "item")


def link_triples(links: DataFrame) -> DataFrame:
    """sameAs and exactMatch triples of accepted links."""
    both = F.explode(F.array(F.lit(OWL + "sameAs"), F.lit(SKOS + "exactMatch"))).alias("p")
    return links.select(F.col("uri").alias("s"), both, F.col("item").alias("o"), F.lit("uri").alias("tipo"), F.lit(None).cast("string").alias("lengua"))


def n_triples(triples: DataFrame) -> DataFrame:
    """(value): one N-Triples line each, for a text sink."""
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), "\r", r"\\r")
    literal = F.concat(F.lit('"'), escaped, F.lit('"'), F.when(F.col("lengua").isNotNull(), F.concat(F.lit("@"), "lengua")).when(F.col("tipo") != "literal", F.concat(F.lit("^^<"), "tipo", F.lit(">"))).otherwise(""))
    end = F.when(F.col("tipo") == "uri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(literal)
    return triples.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), end, F.lit(" .")).alias("value"))


def read_n_triples(lines: DataFrame) -> DataFrame:
    """Triples of a text source of N-Triples lines; comments and lines of another form are left out."""
    parts = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z-]+)|\^\^<([^>]*)>)?)\s*\.\s*$'
    g = [F.regexp_extract("value", parts, i) for i in range(7)]
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(g[4], r"\\n", "\n"), r"\\r", "\r"), r'\\"', '"'), r"\\\\", r"\\")
    is_uri = F.regexp_extract("value", r'^\s*<[^>]*>\s+<[^>]*>\s+(<)', 1) == "<"
    return lines.where(F.col("value").rlike(parts)).select(
        g[1].alias("s"), g[2].alias("p"), F.when(is_uri, g[3]).otherwise(text).alias("o"),
        F.when(is_uri, "uri").when(g[6] != "", g[6]).otherwise("literal").alias("tipo"), F.when(g[5] != "", g[5]).alias("lengua"),
    )


def json_ld(triples: DataFrame) -> DataFrame:
    """(s, json): each subject's properties as one compact JSON object; the keys are sorted."""
    values = triples.groupBy("s", "p").agg(F.array_sort(F.collect_list("o")).alias("o"))
    return values.groupBy("s").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "o"))))).alias("json"))
