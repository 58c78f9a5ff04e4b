import random

from tamiz.llm.components import connected_components
from tamiz.llm.names import edits, jaro_winkler, name_pairs, phonetic, read_name

GIVEN = frozenset(["jose", "ana", "jesus", "maria", "luis"])


def test_reading():
    for value in ["José Polchi Durria", "POR JOSÉ POLCHI DURRIA", "Dr. José  Polchi-Durria", "Polchi Durria, José", "Polchi Durria José", "José «Pepe» Polchi Durria", "José N. Polchi Durria", "José Luis Polchi Durria"]:
        assert read_name(value, GIVEN) == ("person", ["jose", "polchi", "durria"]), value
    assert read_name("Polchi, J.", GIVEN) == ("person", ["j", "polchi", ""])
    assert read_name("José Polchi D.", GIVEN) == ("person", ["jose", "polchi", "d"])
    for letter in "DEYQ":
        assert read_name(f"{letter}. Polchi Durria", GIVEN) == ("person", [letter.lower(), "polchi", "durria"])
    assert read_name("José Polchi Y.", GIVEN) == ("person", ["jose", "polchi", "y"])
    assert read_name("Ag. Not. Alta Sur", GIVEN) == ("agency", ["alta", "sur"])
    for value in ["Redacción", "N/D", " ", "José Polchi Durria y Ana Tor Bel", "José Polchi Durria / Ana Tor Bel", "José Polchi Durria, Ana Tor Bel", "staff"]:
        assert read_name(value, GIVEN) is None, value


def test_measures():
    assert jaro_winkler("martha", "marhta") > 0.96 and jaro_winkler("a", "") == 0
    assert edits("casa", "csaa", 2) == 1 and edits("casa", "perro", 2) == 3
    assert phonetic("vaca") == phonetic("baca") and phonetic("queso") == phonetic("keso")


def test_pairs(spark):
    entities = [
        ["José Polchi Durria", "JOSÉ POLCHI DURRIA", "Pepe Polchi Durria", "Polchi Durria, José", "José Polhci Durria"],
        ["Ana Polchi Durria", "A. Polchi Durria", "ana polchi durria"],
        ["Agencia de Noticias Bragona Sur", "Ag. Not. Bragona Sur", "Agencia de Notiias Bragona Sur", "ANBRAS"],
        ["Agencia de Noticias Bragona Norte", "AGENCIA DE NOTICIAS BRAGONA NORTE"],
        ["Luis Mor Tel", "Luis Mor"],
    ]
    alone = ["J. Mor", "Redacción", "N/D", "", "José Polchi Durria y Luis Mor Tel", None, "x" * 5000]
    filler = [f"{g} {a}{b} Zum{b}" for g in ("José", "Ana", "Jesús", "María", "Luis") for a, b in zip("BCDFGLMN", ["agaro", "elisu", "omira", "uneta", "idalo", "avise", "oltiz", "erbun"], strict=True)]
    values = [v for e in entities for v in e] + alone + filler
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(i, v, "z") for i, v in enumerate(values * 2)], "pos long, autor string, valor string")
    got = {tuple(r) for r in name_pairs(df, "autor").collect()}
    want = {tuple(sorted((a, b), key=lambda x: x.encode())) for e in entities for a in e for b in e if a != b}
    assert got == want
    assert name_pairs(df.limit(0), "autor").count() == 0


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 200), (101, 100)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 200}
