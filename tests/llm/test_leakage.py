import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tamiz.llm.leakage import ItemIndex, fold_words, leaked_items, search_document

WORDS = ["uno", "dos", "tres", "el", "la", "Niño", "árbol", "x9", "casa"]


def brute(items, text, n):
    words = fold_words(text)
    grams = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    return {k for k, item in enumerate(items) if grams & {tuple(w[i : i + n]) for w in [fold_words(item)] for i in range(len(w) - n + 1)}}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS), min_size=3, max_size=9).map(" ".join), min_size=1, max_size=6), st.lists(st.sampled_from([*WORDS, "fuera", "—"]), max_size=40).map(" ".join))
def test_complete_against_brute_force(items, text):
    index = ItemIndex([(k, x, "q") for k, x in enumerate(items)], min_words=4)
    assert {k for k, _, _ in search_document(index, text)} == brute(items, text, 4)


def test_words():
    assert fold_words("¡El NIÑO, árbol_roto!") == ["el", "nino", "arbol", "roto"]


def test_items_in_blocks(spark, monkeypatch):
    r = random.Random(4)
    texts = [" ".join(f"w{r.randint(0, 300)}" for _ in range(20)) for _ in range(30)]
    docs = spark.createDataFrame([(i, "x " + texts[i] + " y " + texts[(i * 7) % 30]) for i in range(30)], "doc_id long, text string")
    items = spark.createDataFrame([(i, x, "p") for i, x in enumerate(texts)], "item_id long, texto string, pregunta string")
    whole = {tuple(x) for x in leaked_items(docs, "doc_id", "text", items, "item_id", "texto", "pregunta").collect()}
    monkeypatch.setattr("tamiz.llm.leakage.BLOCK_ITEMS", 7)
    assert {tuple(x) for x in leaked_items(docs, "doc_id", "text", items, "item_id", "texto", "pregunta").collect()} == whole and len(whole) == 54


def test_frame(spark):
    r = random.Random(1)
    item = " ".join(f"w{r.randint(0, 99)}" for _ in range(30))
    docs = [(1, "antes " + item.upper() + " después", "a"), (2, None, "a"), (3, "", None), (4, "w " * 300_000 + ", ".join(item.split()[5:17]), "b"), (5, " ".join(item.split()[:11]), "b"), (None, item, "c")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, lang string, item_id int")
    items = spark.createDataFrame([(7, item, "p"), (8, None, None), (9, "corto", "p"), (7, item, "p")], "item_id long, texto string, pregunta string")
    got = leaked_items(df, "doc_id", "text", items, "item_id", "texto", "pregunta").distinct().collect()
    assert {(x.doc_id, x.item_id, x.palabras) for x in got} == {(1, 7, 30), (4, 7, 12)}
    assert leaked_items(df.limit(0), "doc_id", "text", items, "item_id", "texto", "pregunta").count() == 0
    assert leaked_items(df, "doc_id", "text", items.limit(0), "item_id", "texto", "pregunta").count() == 0
