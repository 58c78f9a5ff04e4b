import random

from pyspark.sql import functions as F

from tamiz.operators import evaluation, search
from tamiz.operators.ranking import ranked


def test_ranks_over_ranges(spark):
    r = random.Random(1)
    rows = [("hot" if i % 3 else None, i, r.random()) for i in range(400)] + [("cold", 1000, 0.5)]
    df = spark.createDataFrame(rows, "k string, id long, v double")
    for size in (37, 10_000):
        got = {x.id: x.rango for x in ranked(df, ["k"], [F.desc("v"), F.asc("id")], range_rows=size).collect()}
        for key in ("hot", None, "cold"):
            own = sorted((x for x in rows if x[0] == key), key=lambda x: (-x[2], x[1]))
            assert [got[x[1]] for x in own] == list(range(1, len(own) + 1))
    assert ranked(df.limit(0), ["k"], [F.asc("id")]).count() == 0


def test_measures_of_a_known_ranking(spark):
    rankings = spark.createDataFrame([("q", "m", i + 1, d) for i, d in enumerate([5, 1, 7, 2])] + [("z", "m", 1, 9)], "consulta string, modelo string, rango int, doc_id long")
    judged = spark.createDataFrame([("q", 1), ("q", 2), ("q", 3), ("q", 1)], "consulta string, doc_id long")
    rows = {x.consulta: x for x in evaluation.measures(rankings, judged).collect()}
    q = rows["q"]
    assert (q.precision, round(q.recall, 6), q.p_at_k) == (0.5, 0.666667, 0.5)
    assert abs(q.ap - (1 / 2 + 2 / 4) / 3) < 1e-12
    assert (rows["z"].precision, rows["z"].recall, rows["z"].ap) == (0.0, 0.0, 0.0)


def test_models_rank_differently(spark):
    docs = spark.createDataFrame([(1, "banco", "la deuda del banco"), (2, "río", "el banco de arena del río"), (3, None, "nada")], "doc_id long, titulo string, cuerpo string")
    rows = search.rankings(docs, {"a": "deuda banco", "b": "inexistente", "c": ""}).collect()
    got = {(x.consulta, x.modelo): [y.doc_id for y in sorted(rows, key=lambda y: y.rango) if (y.consulta, y.modelo) == (x.consulta, x.modelo)] for x in rows}
    assert got == {("a", "booleano"): [1], ("a", "vectorial"): [1, 2]}


def test_conclusion(spark):
    def text(a, b):
        averages = spark.createDataFrame([("booleano", a), ("vectorial", b)], "modelo string, f1 double")
        return evaluation.conclusion(averages).first()[0]

    assert text(0.5, 0.52).startswith("Ambos modelos") and "F1 Booleano=0.500, Vectorial=0.520" in text(0.5, 0.52)
    assert text(0.2, 0.9).startswith("El modelo vectorial supera") and text(0.9, 0.2).startswith("El modelo booleano supera")
