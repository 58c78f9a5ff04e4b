import random
import time

import pytest

from tamiz.llm import truncation
from tamiz.llm.truncation import BoundaryModel, cut_texts, examine, fitted, open_structures, share_by_source, source_limits

NOUNS = ["la cosecha", "el río", "la escuela", "el puerto", "la fábrica", "el museo"]
VERBS = ["cerró", "abrió", "perdió", "ganó", "mostró"]
ENDS = ["en la plaza mayor", "con poca gente", "durante toda la semana", "por falta de luz"]


def sentence(r):
    return f"{r.choice(NOUNS)} {r.choice(VERBS)} {r.choice(NOUNS)} {r.choice(ENDS)}.".capitalize()


def texts(n, seed=1):
    r = random.Random(seed)
    return [" ".join(sentence(r) for _ in range(r.randint(2, 6))) for _ in range(n)]


def test_model_on_held_out_texts():
    model, r, right = BoundaryModel(texts(400)), random.Random(3), 0
    held = texts(200, 9)
    for text in held:
        state, share, _ = examine(text[: r.randint(len(text) // 2, len(text) - 8)].rstrip(".") + "x", model)
        right += state == "cut" or (state == "open" and share < 0.08)
        state, share, _ = examine(text[:-1], model)
        right += state == "open" and share > 0.08
    assert right >= 0.95 * 2 * len(held)


@pytest.mark.parametrize(
    ("text", "open_"),
    [("abre (y cierra)", []), ("abre (y no", ["("]), ("«dice [algo", ["«", "["]), ("fin &hell", ["escape"]), ("con <em", ["tag"]), ("sube un 5 %", []), ("/ruta%2", ["escape"]), ("1) uno\nfin", []), ("mal�", ["escape"]), ("", []),
     ('Dijo "hola', ['"']), ('Dijo "hola" y «fue', ["«"]), ('un tubo de 5" y más', []), ("<b>negrita sin cerrar", ["<b>"]), ("<b>x</b><br><i>y", ["<i>"]), ("<p>uno<p>dos", []), ("<a href='x'>y", ["<a>"]),
     ("abre (uno\ndos\ntres sin", ["("]), ("abre (uno\ndos)\ntres sin", []), ("(" + "x" * 100_000, ["("]), ("<" * 50_000, [])],
)
def test_automaton(text, open_):
    assert open_structures(text) == open_


def test_marks():
    model = BoundaryModel(texts(50))
    assert examine("La escuela abr [...]", model)[0] == "cut"
    assert examine("La escuela abr... Leer más", model)[0] == "cut"
    assert examine("Y nada más se supo…", model)[0] == "dots"
    assert examine(None, model)[0] == examine(" \n ", model)[0] == "finished"


def test_ends_alone_are_read_for_marks():
    r, parts = random.Random(7), ["[", "]", "(", ")", "...", "…", " ", " " * 30, "más", "MÁS", "sigue", "Leer más", "continuar leyendo", "[+]", "a", "_", "»", "!", "\xa0"]
    lines = ["".join(r.choice(parts) for _ in range(r.randint(1, 8))).strip() for _ in range(20_000)]
    assert [truncation.has_mark(x) for x in lines] == [bool(truncation._MARK.search(x)) for x in lines]
    # The white space inside a line was gone over once for every place in it.
    began = time.process_time()
    assert examine("La escuela" + " " * 40_000 + "cerró en la plaza mayor de la villa", BoundaryModel(texts(20)))[0] == "open"
    assert time.process_time() - began < 1


def test_structures_of_earlier_lines_decide():
    model = BoundaryModel(texts(200))
    line = "La escuela abrió el museo en la plaza mayor"
    assert examine(f"Uno (dos.\nTres.\n{line}", model)[0] == "cut"
    assert examine(f"Uno (dos).\nTres.\n{line}", model)[0] == "open"
    assert examine(f'Uno "dos.\nTres.\n{line}', model)[0] == examine(f"<b>Uno.\n{line}", model)[0] == "cut"


def test_sample_is_the_same_in_any_order(spark):
    rows = [("t", i, "s", x[: len(x) - i % 7]) for i, x in enumerate(texts(300, 4))]
    schema = "tabla string, id long, src string, text string"
    verdicts = [{tuple(r) for r in cut_texts(spark.createDataFrame(part, schema).repartition(n), sample_texts=40).collect()} for part, n in ((rows, 3), (rows[::-1], 7))]
    assert verdicts[0] == verdicts[1]


def test_model_counts_all_texts(spark):
    # More texts than the sample of 8,000 that was once drawn, over several batches and partitions.
    many = texts(9000, 6) + ["Brisa (corta). La brisa cerró en la plaza", None, "", "Uno\n»”.\n"]
    asking = spark.createDataFrame([(x[: len(x) - 1 - i % 9],) for i, x in enumerate(many[:300])] + [(many[9000],)], "text string")
    one, all_ = BoundaryModel([x for x in many if x]), fitted(asking, spark.createDataFrame([(x,) for x in many], "text string").repartition(5))
    assert (one.base, one.wording.common, one.wording.function_words) == (all_.base, all_.wording.common, all_.wording.function_words)
    assert [examine(r.text, one) for r in asking.collect()] == [examine(r.text, all_) for r in asking.collect()]


def test_rare_ends_of_the_whole_count(spark):
    # One text teaches each of forty ends; a sample of 8,000 of the texts misses most of them.
    words = [f"zumb{chr(97 + i // 8)}{chr(97 + i % 8)}ó" for i in range(40)]
    rows = [("t", i, "s", x) for i, x in enumerate(texts(30_000, 8))] + [("t", 50_000 + i, "s", f"Vista así. La escuela {w}. Nadie más salió.") for i, w in enumerate(words)]
    rows += [("t", 60_000 + i, "s", f"Vista así. La escuela {w}") for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "tabla string, id long, src string, text string")
    assert cut_texts(df).where("cortado AND id >= 60000").count() == 0


def test_frame(spark):
    whole = texts(120)
    rows = [("t", i, "s" if i % 3 else None, x) for i, x in enumerate(whole)]
    rows += [("t", 500 + i, "s", x[:20]) for i, x in enumerate(whole[:9])] + [("t", 600 + i, "s", x + " Y ya se verá…") for i, x in enumerate(whole[:6])]
    rows += [("t", 700, "s", None), ("t", 701, None, ""), ("t", 702, "s", whole[0] * 3000), ("t", None, "s", "x"), ("t", 703, "s", whole[5] + " La escuela ab…")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "tabla string, id long, src string, text string, frase string")
    verdicts = cut_texts(df)
    found = {r.id for r in verdicts.where("cortado").collect()}
    assert found == {500 + i for i in range(9)} | {703}
    shares = {r.fuente: (r.registros, r.cortados) for r in share_by_source(verdicts).collect()}
    assert shares[None] == (41, 0)
    assert cut_texts(df.limit(0)).count() == 0


def test_chance_makes_no_limit_at_any_size(spark):
    r = random.Random(2)
    for size in (2_000, 40_000):
        rows = [("t", "chance", r.randint(200, 600)) for _ in range(size)] + [("t", None, r.randint(200, 600)) for _ in range(size // 20)] + [("t", "few", 40)] * 2
        rows += [("t", "real", r.randint(200, 600)) for _ in range(size)] + [("t", "real", 300)] * (40 + size // 100)
        found = source_limits(spark.createDataFrame(rows, "tabla string, src string, n_chars long"))
        assert [tuple(x) for x in found.collect()] == [("t", "real", 300)]


def test_open_ends_at_chance_lengths_stay_finished(spark, monkeypatch):
    # Three broken texts at every length: whole texts without full stop, of which the model is in doubt, stay whole.
    rows = [("t", 1000 + 3 * n + k, "s", n, "cut", 0.0, None) for n in range(100, 300) for k in range(3)] + [("t", n, "s", n, "open", 0.3, None) for n in range(100, 300)]
    scored = spark.createDataFrame(rows, "tabla string, id long, src string, n_chars long, estado string, p double, frase string")
    monkeypatch.setattr("tamiz.llm.truncation.score_texts", lambda df, model: scored)
    df = spark.createDataFrame([("t", 1, "s", "La escuela cerró.")], "tabla string, id long, src string, text string")
    assert cut_texts(df).where("cortado AND id < 1000").count() == 0
