import random

import pytest
from pyspark.sql import functions as F

from tamiz.functions import text as t
from tamiz.functions.urls import source_host
from tamiz.operators import nlp, search, similarity


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (0, "Avance en inteligencia artificial", "La inteligencia artificial crece en la industria.", "tecnologia", "positivo"),
        (1, "Caída de mercados", "Los mercados y la economía caen por la crisis.", "economia", "negativo"),
        (2, "Clima extremo", "Los científicos estudian el clima.", "ciencia", "neutral"),
        (3, None, None, None, None),
        (4, "", "x " * 50_000, "ciencia", "neutral"),
    ]
    return spark.createDataFrame(rows, "doc_id long, titulo string, cuerpo string, categoria string, sentimiento string")


def ids(df):
    return [r.doc_id for r in df.collect()]


def test_expressions(spark):
    df = spark.createDataFrame([("  Ñandú  ÁRBOL_1, 22 años! #Ia #ia ",)], "x string")
    row = df.select(t.fold("x").alias("f"), t.words(t.fold("x")).alias("w"), t.clean(F.col("x")).alias("c"), t.slug(F.col("x")).alias("s"), t.hashtags(F.col("x")).alias("h"), t.collapse(F.col("x")).alias("k")).first()
    assert row.w == ["nandu", "arbol_1", "22", "anos", "ia", "ia"] and row.c == "ñandú árbol_ años ia ia"
    assert row.s == "nandu_arbol_1_22_anos_ia_ia" and row.h == ["Ia", "ia"] and row.k == "Ñandú ÁRBOL_1, 22 años! #Ia #ia"
    grams = df.select(t.ngrams(F.array(F.lit("a")), 2).alias("n0"), t.ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2).alias("n2")).first()
    assert grams.n0 == [] and grams.n2 == ["a b", "b c"]
    assert df.select(t.query_pieces(F.lit('"Salario Mínimo" alza')).alias("p")).first().p == ["salario mínimo", "alza"]


def test_hosts(spark):
    rows = [("https://www.Uno.example/portada", "x"), (" ", "http://dos.example:80/a"), (None, "HTTPS://TRES.EXAMPLE?q"), ("cuatro.example", None), (None, None)]
    df = spark.createDataFrame(rows, "fuente string, url string")
    assert [r.h for r in df.select(source_host(F.col("fuente"), F.col("url")).alias("h")).collect()] == ["uno.example", "dos.example", "tres.example", "cuatro.example", None]


def test_boolean_search(docs):
    assert ids(search.boolean_search(docs, "mercados economia")) == [1]
    assert sorted(ids(search.boolean_search(docs, "inteligencia ECONOMÍA", "OR"))) == [0, 1]
    assert ids(search.boolean_search(docs, "")) == []
    with pytest.raises(ValueError):
        search.boolean_search(docs, "x", "XOR")


def test_vector_search(docs):
    rows = search.vector_search(docs, "inteligencia artificial", 5).collect()
    assert rows[0].doc_id == 0 and rows[0].score >= rows[0].relevancia > 0
    assert search.vector_search(docs, "zzz", 5).count() == 0
    assert search.vector_search(docs.limit(0), "zzz", 5).count() == 0


def test_natural_search_branches(docs):
    assert ids(search.natural_search(docs, "noticias positivas de tecnología")) == [0]
    assert ids(search.natural_search(docs, "malas noticias de economia"))[0] == 1
    assert ids(search.natural_search(docs, "algo bueno y positivo de ciencia sobre mercados"))[0] == 1


def test_tfidf_is_normalised(docs):
    weights, _ = search.tfidf_terms(docs, t.fold(search.document_text(docs)), 50)
    assert all(abs(r.n - 1) < 1e-9 for r in weights.groupBy("doc_id").agg(F.sum(F.col("w") ** 2).alias("n")).collect())


def test_statistics(docs):
    done = nlp.process(docs, "cuerpo")
    assert nlp.corpus_stats(done).first().total_documentos == 5
    rows = nlp.richness_by_section(done, "doc_id", "terminos").collect()
    assert {r.doc_id for r in rows} == {0, 1, 2} and all(0 < r.riqueza <= 1 for r in rows)
    assert nlp.corpus_stats(done.limit(0)).first().total_tokens == 0


def test_entities(spark):
    df = spark.createDataFrame([(1, "El presidente López viajó a la ciudad de Murcia. López habló."), (2, None)], "doc_id long, cuerpo string")
    got = {r.entidad: (r.tipo, r.n) for r in nlp.entities(df, "doc_id", "cuerpo").collect()}
    assert got == {"López": ("LUGAR", 2), "Murcia": ("LUGAR", 1)}


@pytest.mark.parametrize(("word", "root"), [("niños", "niñ"), ("cantando", "cant"), ("canciones", "cancion"), ("rápidamente", "rapid"), ("comió", "com"), ("felicidad", "felic"), ("gobierno", "gobiern"), ("sol", "sol"), ("", "")])
def test_stems(word, root):
    assert nlp.stem(word) == root


def test_recommendations(spark):
    sims = spark.createDataFrame([(0, 1, 0.7), (0, 2, 0.2), (1, 0, 0.7), (1, 2, 0.4), (2, 0, 0.2), (2, 1, 0.4)], "i long, j long, coseno double")
    items = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b")], "doc_id long, categoria string")
    assert [(r.j, r.coseno) for r in similarity.recommend(sims, items).where("i = 0").orderBy("rango").collect()] == [(1, 0.7), (2, 0.2)]
    assert [r.j for r in similarity.recommend(sims, items, other_categories=True).where("i = 1").collect()] == [0]
    read = spark.createDataFrame([("p", 0), ("p", 1)], "perfil string, i long")
    assert [(r.j, r.afinidad) for r in similarity.recommend_for_profile(sims, read).collect()] == [(2, 0.6)]


def test_greedy_groups_against_brute_force(spark):
    import random

    r = random.Random(4)
    edges = {(a, b) for a in range(30) for b in range(a + 1, 30) if r.random() < 0.08}
    lead: dict[int, int] = {}
    for i in range(30):
        if i not in lead:
            lead[i] = i
            for j in range(i + 1, 30):
                if j not in lead and (i, j) in edges:
                    lead[j] = i
    nodes = spark.createDataFrame([(i,) for i in range(30)], "nodo long")
    got = dict(similarity.greedy_groups(nodes, spark.createDataFrame(sorted(edges), "a long, b long")).collect())
    assert got == lead


def test_nearest_vectors_against_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr("tamiz.operators.similarity.BLOCK", 7)
    v = np.random.default_rng(1).normal(size=(40, 5)).astype("float32")
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(99, None)], "vec_id long, e array<float>")
    got = {(r.i, r.rango): r.j for r in similarity.nearest_vectors(df, "vec_id", "e", df.where("vec_id < 9"), 3).collect()}
    u = v.astype("float64") / np.linalg.norm(v.astype("float64"), axis=1, keepdims=True)
    cos = u @ u.T
    np.fill_diagonal(cos, -2)
    assert got == {(i, k + 1): int(j) for i in range(9) for k, j in enumerate(np.argsort(-cos[i])[:3])}


def _vector_table(folder, n=400, seed=5):
    """An ``embeddings`` table, its unit vectors and labels: all near vectors of a query have its label."""
    import numpy as np
    import pandas as pd

    r = np.random.default_rng(seed)
    labels = [f"c{i // 10 % 2}" for i in range(n)]
    centres = {"c0": np.array([3.0, 0, 0, 0]), "c1": np.array([0, 3.0, 0, 0])}
    v = np.stack([centres[x] + r.normal(size=4) for x in labels]).astype("float32")
    pd.DataFrame({"vec_id": np.arange(n), "label": labels, "embedding": [[float(x) for x in row] for row in v]}).to_parquet(f"{folder}/embeddings.parquet")
    u = v.astype("float64")
    return u / np.linalg.norm(u, axis=1, keepdims=True), labels


def test_profiles_sum_whole_similarity_rows(spark, tmp_path, monkeypatch):
    from tamiz.queries import text as queries

    monkeypatch.setattr("tamiz.operators.similarity.BLOCK", 64)
    u, _ = _vector_table(tmp_path)
    read = [i for i in range(len(u)) if i % 50 == 0]
    wanted = {}
    for p in range(3):
        sums = u @ u[[i for i in read if i % 3 == p]].sum(axis=0)
        left = sorted((j for j in range(len(u)) if not (j in read and j % 3 == p)), key=lambda j: (-round(sums[j], 9), -j))[:3]
        wanted |= {(p, k + 1): (j, round(sums[j], 6)) for k, j in enumerate(left)}
    got = {(r.perfil, r.rango): (r.j, r.afinidad) for r in queries.recommend_profile(spark, str(tmp_path)).collect()}
    assert {k: j for k, (j, _) in got.items()} == {k: j for k, (j, _) in wanted.items()}
    assert all(abs(got[k][1] - wanted[k][1]) < 2e-6 for k in wanted)


def test_other_categories_are_chosen_before_the_nearest(spark, tmp_path, monkeypatch):
    from tamiz.queries import text as queries

    monkeypatch.setattr("tamiz.operators.similarity.BLOCK", 64)
    u, labels = _vector_table(tmp_path)
    cos = u @ u.T
    wanted = {(i, k + 1): j for i in range(0, len(u), 50) for k, j in enumerate(sorted((j for j in range(len(u)) if labels[j] != labels[i]), key=lambda j: (-round(cos[i, j], 9), j))[:3])}
    assert {(r.i, r.rango): r.j for r in queries.recommend_exclude_category(spark, str(tmp_path)).collect()} == wanted


def test_groups_of_all_vectors(spark, tmp_path, monkeypatch):
    from tamiz.queries import text as queries

    monkeypatch.setattr("tamiz.operators.similarity.BLOCK", 64)
    u, _ = _vector_table(tmp_path, 250)
    cos = u @ u.T
    lead: dict[int, int] = {}
    for i in range(len(u)):
        if i not in lead:
            lead |= {j: i for j in range(i, len(u)) if j not in lead and (j == i or cos[i, j] >= 0.15)}
    assert dict(queries.greedy_groups(spark, str(tmp_path)).collect()) == lead


def test_question_pairs_hold_the_content(spark, tmp_path):
    from tamiz.queries import retrieval

    spark.createDataFrame([(1, "Uno\nDos.", "es", "x"), (2, None, None, "x")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.tipo): (r.contexto, r.respuesta) for r in retrieval.question_pairs(spark, str(tmp_path)).collect()}
    assert set(got) == {(i, tipo) for i in (1, 2) for tipo in ("contenido", "categoria", "sentimiento")}
    assert got[1, "contenido"] == ("Uno Uno\nDos.", "Uno. Uno\nDos.") and got[2, "contenido"] == (" ", ". ")


def test_similar_documents_by_blocks(spark, monkeypatch):
    monkeypatch.setattr("tamiz.operators.search.BLOCK", 16)
    monkeypatch.setattr("tamiz.operators.search.STRIP", 5)
    r = random.Random(5)
    held = {d: {f"t{t}": r.choice([0.2, 0.5, 0.7]) for t in r.sample(range(12), 4)} for d in range(60)} | {90: {"solo": 1.0}, 91: {"a": 0.6, "t1": 0.8}}
    weights = spark.createDataFrame([(d, t, w) for d, x in held.items() for t, w in x.items()], "doc_id long, term string, w double")
    queries = spark.createDataFrame([(d,) for d in (*range(0, 60, 3), 90, 91, 99, None)], "doc_id long")
    found = search.similar_documents(weights, queries, 3)
    expected = set()
    for i in {*range(0, 60, 3), 90, 91}:
        cos = [(round(sum(w * held[j][t] for t, w in held[i].items() if t in held[j]), 9), j) for j in held if j != i]
        expected |= {(i, j, k, c) for k, (c, j) in enumerate(sorted([x for x in cos if x[0] > 0], reverse=True)[:3], 1)}
    assert {(x.i, x.j, x.rango, round(x.coseno, 9)) for x in found.collect()} == expected
    # Pairs are never rows that are shuffled to be added up: only the best of each block leave their task.
    assert "HashAggregate(keys=[i" not in found._jdf.queryExecution().toString()
