"""Link the spellings of names typed by people to the person or agency they name.

Every distinct value is read once: titles and credits are taken off, order,
initials, nicknames and hyphens made regular; placeholders and joint bylines
name no one. Values then meet in blocks of the phonetic codes of pairs of their
sorted tokens (and a coarser code that a dropped, doubled or swapped letter
leaves alone) and are compared by Jaro-Winkler and the nickname table.

Accepted pairs are clustered by connected components, whole names first. A
shorter form (one surname, initials) never bridges two of them: in order of how
much it says, it joins the cluster of the fuller forms that it fits if these
are one cluster, and is left alone otherwise, so that relatives with common
surnames and agencies with a common stem stay apart.

Defined results: null, blank, placeholder and joint values are linked to
nothing; equal values are one; a form that fits several clusters joins none.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.components import connected_components
from tamiz.llm.pairs import met
from tamiz.session import broadcast_if_small, materialise

#: Least similarity of two tokens that are the same name mistyped, and most letters edited in a whole name.
SIMILAR, EDITS = 0.8, 2
#: A token that begins so many distinct names (and this share of them) is a given name.
GIVEN_NAMES, GIVEN_SHARE = 6, 0.003

# Nickname -> given names it stands for (folded).
NICKNAMES = {
    "ale": "alejandra alejandro", "beto": "alberto roberto", "bety": "beatriz", "betty": "beatriz", "chabela": "isabel", "charo": "rosario",
    "chema": "jose", "chepe": "jose", "chayo": "rosario", "chuy": "jesus", "chucho": "jesus", "concha": "concepcion", "conchita": "concepcion",
    "edu": "eduardo", "fer": "fernando fernanda", "fito": "adolfo", "fran": "francisco francisca", "gabo": "gabriel", "gabi": "gabriel gabriela",
    "goyo": "gregorio", "guille": "guillermo", "javi": "javier", "juancho": "juan", "kike": "enrique", "lalo": "eduardo", "leo": "leonor leonardo leonel",
    "lola": "dolores", "loli": "dolores", "luci": "lucia", "lucha": "lucia luisa", "lupe": "guadalupe", "lupita": "guadalupe", "manolo": "manuel",
    "manu": "manuel manuela", "maite": "maria", "mari": "maria", "marita": "maria", "memo": "guillermo", "merche": "mercedes", "meche": "mercedes",
    "moncho": "ramon", "nacho": "ignacio", "nando": "fernando", "nico": "nicolas", "pancho": "francisco", "paco": "francisco", "pepe": "jose",
    "pepa": "josefa", "pili": "pilar", "quico": "francisco", "quique": "enrique", "rafa": "rafael", "sandra": "alejandra", "santi": "santiago",
    "tere": "teresa", "teresita": "teresa", "tomasito": "tomas", "toni": "antonio", "tono": "antonio", "tona": "antonia", "vale": "valeria valentina",
    "vicky": "victoria", "yoli": "yolanda", "ximo": "joaquin", "xavi": "xavier javier", "tavo": "gustavo octavio", "neto": "ernesto", "rosarito": "rosario",
}
# What stands before a name without being part of it.
BEFORE = {
    "por", "by", "texto", "firma", "fotos", "foto", "escribe", "redacta", "dr", "dra", "lic", "licda", "mtro", "mtra", "ing", "prof", "profa", "arq", "abg",
    "don", "dona", "sr", "sra", "srta",
}
# Bylines that name no one.
PLACEHOLDERS = {
    "redaccion", "la redaccion", "redaccion central", "staff", "n d", "nd", "na", "n a", "s d", "sd", "autor desconocido", "desconocido", "anonimo", "sin autor",
    "sin firma", "sin datos", "admin", "administrador", "editor", "editorial", "agencias", "agencia", "corresponsal", "corresponsales", "varios", "varios autores",
    "mesa de redaccion", "equipo de redaccion", "newsroom", "none", "null", "unknown", "web", "internet", "colaborador", "especial", "archivo",
}
# Words that only say that a name is an agency's.
AGENCY_WORDS = {"agencia", "ag", "noticias", "not", "agcia", "news", "agency"}
_SMALL = {"de", "del", "la", "las", "los", "y", "e"}

_TOKEN = re.compile(r"[^\W\d_]+\.?")


@functools.lru_cache(maxsize=100_000)
def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


@functools.lru_cache(maxsize=200_000)
def phonetic(token: str) -> str:
    """Consonants of a folded token as they sound in Spanish, repeated ones once; a first vowel stays."""
    t = token.replace("qu", "k").replace("ch", "x").replace("ll", "y").replace("h", "")
    t = re.sub(r"c(?=[ei])", "s", t).replace("c", "k").replace("q", "k")
    t = re.sub(r"gu(?=[ei])", "g", re.sub(r"g(?=[ei])", "j", t))
    t = t.replace("v", "b").replace("w", "b").replace("z", "s")
    t = t[:1] + re.sub(r"[aeiou]", "", t[1:])
    return re.sub(r"(.)\1+", r"\1", t)


@functools.lru_cache(maxsize=200_000)
def letters(token: str) -> str:
    """Coarse code: the consonants of the phonetic code, each once, in alphabetic order."""
    return "".join(sorted(set(phonetic(token).replace("j", "g")) - set("aeiou")))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised for a common beginning of up to four letters."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(0, max(n, m) // 2 - 1)
    taken = [False] * m
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    k = len(left)
    swapped = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (k / n + k / m + (k - swapped) / k) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def edits(a: str, b: str, most: int) -> int:
    """Letters dropped, added, changed or swapped with their neighbour; ``most + 1`` if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
    return min(row[-1], most + 1)


@functools.lru_cache(maxsize=200_000)
def typed_apart(a: str, b: str) -> int:
    """Letters that two spellings of one token differ in; more than ``EDITS`` if they are no such spellings."""
    if a == b:
        return 0
    if min(len(a), len(b)) < 4 or jaro_winkler(a, b) < SIMILAR:
        return EDITS + 1
    far = edits(a, b, EDITS)
    return far if far < 2 or min(len(a), len(b)) > 6 else EDITS + 1


def _tokens(text: str) -> list[str]:
    return [fold(t) for t in _TOKEN.findall(text)]


def _is_initial(token: str) -> bool:
    return len(token.rstrip(".")) == 1


def _says_agency(word: str) -> bool:
    return word in AGENCY_WORDS or any(typed_apart(word, x) <= EDITS for x in ("agencia", "noticias"))


def read_name(value: str, given: frozenset[str]) -> tuple[str, list[str]] | None:
    """(``person``, [given or initial, surname, second surname or initial or ""]) or (``agency``, core words), or null."""
    text = re.sub(r"[«“\"(][^»”\")]*[»”\")]", " ", value)
    nickname = re.search(r"[«“\"(]([^»”\")]*)[»”\")]", value)
    if nickname and not _tokens(text):
        text = nickname.group(1)
    plain = " ".join(t.rstrip(".") for t in _tokens(text))
    if not plain or plain in PLACEHOLDERS:
        return None
    words = plain.split()
    if len(words) > 1 and words[0] in BEFORE:
        lead = next((i for i, w in enumerate(words) if w not in BEFORE), len(words))
    else:
        lead = 0
    if any(_says_agency(w) for w in words) and words[0] not in given:
        core = [w for w in words if not _says_agency(w) and w not in _SMALL]
        return ("agency", core) if core else None
    if re.search(r"[^\W\d_]\s*[/;&+]\s*[^\W\d_]", text) and len(words) > 3:
        return None
    parts = [p for p in re.split(r"\s+(?:y|e|and|con|&)\s+", text, flags=re.IGNORECASE) if p.strip()]
    if len(parts) > 1 and all(len([w for w in _tokens(p) if w.rstrip(".") not in BEFORE]) >= 2 for p in parts):
        return None
    first, comma, last = text.partition(",")
    if comma:
        family, rest = _tokens(first), _tokens(last)
        if not rest or not family or "," in last or len(family) > 2 or len([t for t in rest if not _is_initial(t)]) > 2 or (len(family) == 2 and family[0] in given and rest[0] not in given):
            return None
        tokens, inverted = rest[:1] + family, True
    else:
        tokens, inverted = _tokens(text)[lead:], False
    # With its full stop such a word is an initial.
    tokens = [t for t in tokens if t not in _SMALL]
    if not inverted and len(tokens) == 1:
        only = tokens[0].rstrip(".")
        return ("agency", ["", only]) if value.strip().isupper() and 4 <= len(only) <= 8 else None
    if not inverted and tokens and tokens[0] not in given and tokens[0] not in NICKNAMES and not _is_initial(tokens[0]):
        # Surnames first without a comma.
        at = next((i for i, t in enumerate(tokens[1:], 1) if t in given or t in NICKNAMES), None)
        if at is not None and at <= 2 and len(tokens) - at <= 2:
            tokens = [tokens[at], *tokens[:at]]
    if len(tokens) < 2:
        return None
    name, rest = tokens[0].rstrip("."), tokens[1:]
    # A middle name or initial before two surnames says nothing.
    while len(rest) > 2 and (_is_initial(rest[0]) or rest[0] in given):
        rest = rest[1:]
    if len(rest) == 3:
        rest = rest[1:]
    if len(rest) == 2 and _is_initial(rest[0]) and not _is_initial(rest[1]):
        rest = rest[1:]
    rest = [t.rstrip(".") for t in rest]
    if len(rest) > 2 or len(rest[0]) < 2:
        return None
    return "person", [name, rest[0], rest[1] if len(rest) > 1 else ""]


def fulness(kind: str, parts: list[str]) -> int:
    """How much a form says; 4 for a whole name."""
    if kind == "agency":
        return 0 if parts[0] == "" else 4
    name, _, second = parts
    whole = len(name) > 1
    return 4 if whole and len(second) > 1 else 3 if len(second) > 1 else 2 if second and whole else 1 if whole else 0


def acronyms(core: list[str]) -> list[str]:
    """Short forms of an agency: AN, three letters of its stem, the initials of what follows."""
    return ["an" + core[0][:n] + "".join(w[0] for w in core[1:]) for n in (2, 3, 4)]


def given_apart(a: str, b: str, given: frozenset[str]) -> int:
    """Letters that two spellings of a given name differ in: 0 for its initial and nicknames, too many for two known names."""
    if a == b:
        return 0
    if len(a) == 1 or len(b) == 1:
        names_a, names_b = [a, *NICKNAMES.get(a, "").split()], [b, *NICKNAMES.get(b, "").split()]
        return 0 if any(x[0] == y[0] for x in names_a for y in names_b) else EDITS + 1
    whole_a, whole_b = set(NICKNAMES.get(a, a).split()), set(NICKNAMES.get(b, b).split())
    if whole_a & whole_b:
        return 0
    if a in given and b in given or a in NICKNAMES or b in NICKNAMES:
        return EDITS + 1
    return typed_apart(a, b)


def same_entity(kind_a: str, a: list[str], kind_b: str, b: list[str], given: frozenset[str]) -> bool:
    """Whether two forms can name one person or agency."""
    if kind_a != kind_b:
        return False
    if kind_a == "agency":
        if a[0] == "" or b[0] == "":
            if a[0] == b[0]:
                return a == b
            short, core = (a[1], b) if a[0] == "" else (b[1], a)
            return short in acronyms(core)
        return len(a) == len(b) and sum(typed_apart(x, y) for x, y in zip(a, b, strict=True)) <= EDITS
    far = given_apart(a[0], b[0], given)
    if far > EDITS:
        return False
    if all(len(x) > 1 for x in (a[0], b[0], a[2], b[2])):
        return far + typed_apart(a[1], b[1]) + typed_apart(a[2], b[2]) <= EDITS
    if a[1] != b[1]:
        return False
    if not a[2] or not b[2]:
        return True
    if len(a[2]) == 1 or len(b[2]) == 1:
        return a[2][0] == b[2][0]
    return a[2] == b[2]


def block_keys(kind: str, parts: list[str]) -> list[str]:
    """Phonetic codes of the pairs of a form's sorted tokens, and of the first surname with the given name's initial."""
    if kind == "agency":
        if parts[0] == "":
            return ["q:" + parts[1]]
        tokens = sorted(parts)
        keys = ["a:" + " ".join(code(t) for t in tokens) for code in (phonetic, letters)]
        keys += [f"a{i}:" + " ".join(phonetic(t) for t in tokens[:i] + tokens[i + 1 :]) for i in range(len(tokens)) if len(tokens) > 1]
        return [*keys, *("q:" + x for x in acronyms(parts))]
    name, surname, second = parts
    keys = []
    names = NICKNAMES.get(name, name).split()
    for whole in names:
        keys.append("i:" + whole[0] + " " + phonetic(surname))
        if len(whole) > 1 and len(second) > 1:
            trio = sorted([whole, surname, second])
            keys += [f"{mark}:" + " ".join(sorted(code(t) for t in pair)) for mark, code in (("p", phonetic), ("l", letters)) for pair in (trio[:2], trio[1:], trio[::2])]
    return keys


def given_names(values: DataFrame, column: str) -> frozenset[str]:
    """Folded tokens that begin many distinct names: at most 1 / ``GIVEN_SHARE`` of them, learned from all values."""
    first = F.lower(F.regexp_extract(F.trim(column), r"^(\p{Lu}\p{Ll}{2,})\s+\p{L}", 1))
    counted = values.select(first.alias("t")).where("t <> ''").groupBy("t").count()
    total = counted.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    rows = counted.where(F.col("count") >= max(GIVEN_NAMES, GIVEN_SHARE * total)).select("t").collect()
    known = {fold(r[0]) for r in rows} - BEFORE - AGENCY_WORDS - set(NICKNAMES)
    return frozenset(known | {w for names in NICKNAMES.values() for w in names.split()})


def name_pairs(df: DataFrame, column: str) -> DataFrame:
    """(autor_a, autor_b), autor_a < autor_b by bytes: the values of ``column`` that name the same single entity."""
    return met(name_clusters(df, column).distinct(), "entidad", "valor", "valor < other_valor").toDF("autor_a", "autor_b").distinct()


def name_clusters(df: DataFrame, column: str) -> DataFrame:
    """(valor, entidad): every value that names one entity, and the least form of its cluster."""
    values = materialise(df.select(F.col(column).cast("string").alias("valor")).where("trim(valor) <> ''").distinct(), "values")
    given = given_names(values, "valor")
    shared = df.sparkSession.sparkContext.broadcast(given)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for value in frame["valor"]:
                form = read_name(value, shared.value)
                if form:
                    kind, parts = form
                    rows.append((value, kind + ":" + "|".join(parts), fulness(kind, parts), block_keys(kind, parts)))
            yield pd.DataFrame(rows, columns=["valor", "forma", "nivel", "claves"])

    read_values = materialise(values.mapInPandas(read, "valor string, forma string, nivel int, claves array<string>"), "forms")
    forms = materialise(read_values.select("forma", "nivel", "claves").dropDuplicates(["forma"]), "distinct")
    keyed = forms.select("forma", "nivel", F.explode("claves").alias("clave")).distinct()

    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            (kind_x, _, rest_x), (kind_y, _, rest_y) = x.partition(":"), y.partition(":")
            out.append(same_entity(kind_x, rest_x.split("|"), kind_y, rest_y.split("|"), shared.value))
        return pd.Series(out, dtype=bool)

    sides = met(keyed, "clave", "forma", "forma <> other_forma AND (nivel > other_nivel OR (nivel = other_nivel AND forma < other_forma))", "nivel")
    candidates = sides.toDF("a", "b", "na", "nb").select("a", "na", "b", "nb").distinct()
    pairs = materialise(candidates.where(same("a", "b")), "pairs")

    labels = connected_components(pairs.where("na = 4 AND nb = 4").select("a", "b"))
    labels = forms.where("nivel = 4").select("forma").join(labels, F.col("forma") == F.col("node"), "left").select("forma", F.coalesce("component", "forma").alias("entidad"))
    labels = materialise(labels, "labels")
    for level in (3, 2, 1, 0):
        # A shorter form joins the one cluster of fuller forms it fits; forms that fit none found their own.
        fits = pairs.where(F.col("nb") == level).select(F.col("b").alias("forma"), "a", "na").where(F.col("na") > level)
        reached = fits.join(labels.select(F.col("forma").alias("a"), "entidad"), "a").groupBy("forma").agg(F.min("entidad").alias("entidad"), F.max("entidad").alias("otra"))
        placed = forms.where(F.col("nivel") == level).select("forma").join(reached, "forma", "left")
        fresh = placed.select("forma", F.when(F.col("entidad") == F.col("otra"), F.col("entidad")).otherwise(F.col("forma")).alias("entidad"))
        labels = materialise(labels.unionByName(fresh), "labels")
    return read_values.join(broadcast_if_small(labels), "forma").select("valor", "entidad")
