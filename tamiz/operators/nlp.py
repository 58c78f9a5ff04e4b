"""Text statistics of a corpus: tokens, n-grams, lexical richness, entities, stems."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamiz.functions import lexicons
from tamiz.functions.text import clean, collapse, ngrams, sentence_count, without

_LETTERS = r"[A-Za-záéíóúÁÉÍÓÚñÑüÜ]+"


def letter_tokens(text: Column) -> Column:
    """Lower-case words of Spanish letters only; anything else separates them."""
    kept = collapse(F.regexp_replace(F.lower(text), r"[^a-záéíóúñü\s]", " "))
    return F.filter(F.split(kept, " "), lambda t: F.length(t) > 0)


def process(df: DataFrame, text: str, stopwords: list[str] = lexicons.BASIC_STOPWORDS) -> DataFrame:
    """Add limpio, tokens, terminos, num_tokens, num_terminos, num_oraciones, vocabulario_unico, riqueza_lexica.

    A null text counts as an empty one; riqueza_lexica of a text without terms is 0.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    tokens = letter_tokens(body)
    terms = without(tokens, stopwords, 3)
    out = df.withColumn("limpio", clean(body)).withColumn("tokens", tokens).withColumn("terminos", terms)
    out = out.withColumn("num_tokens", F.size("tokens")).withColumn("num_terminos", F.size("terminos")).withColumn("num_oraciones", sentence_count(body))
    out = out.withColumn("vocabulario_unico", F.size(F.array_distinct("terminos")))
    return out.withColumn("riqueza_lexica", F.col("vocabulario_unico") / F.greatest(F.col("num_terminos"), F.lit(1)))


def corpus_stats(processed: DataFrame) -> DataFrame:
    """One row: documents, tokens, vocabulary, average richness and tokens a document."""
    sums = processed.agg(
        F.count("*").alias("total_documentos"),
        F.coalesce(F.sum("num_tokens"), F.lit(0)).alias("total_tokens"),
        F.round(F.coalesce(F.avg("riqueza_lexica"), F.lit(0.0)), 4).alias("riqueza_promedio"),
        F.round(F.coalesce(F.avg("num_tokens"), F.lit(0.0)), 1).alias("promedio_tokens_doc"),
    )
    vocabulary = processed.select(F.explode("terminos").alias("t")).agg(F.countDistinct("t").alias("vocabulario_total"))
    return sums.crossJoin(vocabulary)


def frequencies(tokens: DataFrame, token: str = "termino", n: int | None = 20) -> DataFrame:
    """(token, n): how often each token occurs, most frequent first, ties by token."""
    counted = tokens.groupBy(token).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), token).limit(n) if n is not None else counted


def top_ngrams(processed: DataFrame, n: int, top: int = 10, terms: str = "terminos") -> DataFrame:
    """The most frequent runs of ``n`` terms."""
    return frequencies(processed.select(F.explode(ngrams(F.col(terms), n)).alias("ngrama")), "ngrama", top)


def richness_by_section(df: DataFrame, ident: str, terms: str, sections: int = 4) -> DataFrame:
    """(ident, seccion, riqueza): distinct share of each of the equal contiguous sections; the last takes the rest."""
    size = F.size(terms)
    step = F.greatest(F.floor(size / sections), F.lit(1))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(sections - 1))).alias("seccion")
    cut = df.select(ident, F.col(terms).alias("_t"), size.alias("_n"), step.alias("_s"), numbers).where("_n > 0 AND seccion * _s < _n")
    length = F.when(F.col("seccion") == sections - 1, F.col("_n")).otherwise(F.col("_s")).cast("int")
    part = F.slice("_t", (F.col("seccion") * F.col("_s") + 1).cast("int"), length)
    return cut.select(ident, (F.col("seccion") + 1).alias("seccion"), (F.size(F.array_distinct(part)) / F.size(part)).alias("riqueza"))


def entities(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, entidad, tipo, n): capitalised words, typed by the three words before their last occurrence.

    A type of an earlier context gives way to the last one; persons before
    places before organisations where the context fits several.
    """
    tokens = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    placed = df.select(ident, tokens.alias("_w")).select(ident, "_w", F.posexplode("_w").alias("_i", "entidad"))
    stop = [F.lit(w) for w in lexicons.DISCOURSE_STOPWORDS]
    capital = F.col("entidad").rlike(f"^{_LETTERS}$") & F.col("entidad").rlike(r"^\p{Lu}") & (F.length("entidad") > 2)
    placed = placed.where(capital & ~F.array_contains(F.array(*stop), F.lower("entidad")))
    before = F.transform(F.slice("_w", F.greatest(F.col("_i") - 2, F.lit(1)), F.least(F.col("_i"), F.lit(3))), lambda t: F.lower(t))
    kind = F.lit("DESCONOCIDO")
    for name, words_ in (("ORG", lexicons.ORGANISATION_CONTEXT), ("LUGAR", lexicons.PLACE_CONTEXT), ("PERSONA", lexicons.PERSON_CONTEXT)):
        kind = F.when(F.arrays_overlap(before, F.array(*[F.lit(w) for w in words_])), name).otherwise(kind)
    typed = placed.select(ident, "entidad", "_i", kind.alias("tipo"))
    return typed.groupBy(ident, "entidad").agg(F.max_by("tipo", "_i").alias("tipo"), F.count("*").alias("n"))


def discourse(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, estado, oraciones, palabras, vocabulario, riqueza, promedio_oracion); ``insuficiente`` below five terms."""
    body = F.coalesce(F.col(text), F.lit(""))
    long = F.filter(letter_tokens(body), lambda t: F.length(t) > 2)
    terms = without(long, lexicons.DISCOURSE_STOPWORDS)
    out = df.select(ident, sentence_count(body).alias("oraciones"), F.size(long).alias("palabras"), F.size(F.array_distinct(terms)).alias("vocabulario"), F.size(terms).alias("_n"))
    ok = F.col("_n") >= 5
    return out.select(
        ident,
        F.when(ok, "ok").otherwise("insuficiente").alias("estado"),
        F.when(ok, F.col("oraciones")).alias("oraciones"),
        F.when(ok, F.col("palabras")).alias("palabras"),
        F.when(ok, F.col("vocabulario")).alias("vocabulario"),
        F.when(ok, F.round(F.col("vocabulario") / F.col("_n"), 4)).alias("riqueza"),
        F.when(ok, F.round(F.col("palabras") / F.greatest(F.col("oraciones"), F.lit(1)), 1)).alias("promedio_oracion"),
    )


def top_per_group(tokens: DataFrame, group: str, token: str, n: int) -> DataFrame:
    """(group, token, n, rango): the most frequent tokens of each group, ties by token."""
    counted = tokens.groupBy(group, token).agg(F.count("*").alias("n"))
    return counted.withColumn("rango", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), token))).where(F.col("rango") <= n)


# --- Spanish stemmer, after the published Snowball rules -------------------------------------------------------------

_VOWELS = "aeiouáéíóúü"
# Suffixes of the Snowball algorithm for Spanish.
_PRONOUNS = ["selas", "selos", "sela", "selo", "las", "les", "los", "nos", "me", "se", "la", "le", "lo"]
_GERUNDS = [("iéndo", "iendo"), ("ándo", "ando"), ("ár", "ar"), ("ér", "er"), ("ír", "ir")]
_STANDARD = [
    (["anza", "anzas", "ico", "ica", "icos", "icas", "ismo", "ismos", "able", "ables", "ible", "ibles", "ista", "istas", "oso", "osa", "osos", "osas", "amiento", "amientos", "imiento", "imientos"], ""),
    (["adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias"], "ic"),
    (["logía", "logías"], "log"),
    (["ución", "uciones"], "u"),
    (["encia", "encias"], "ente"),
    (["amente"], "amente"),
    (["mente"], "mente"),
    (["idad", "idades"], "idad"),
    (["iva", "ivo", "ivas", "ivos"], "iv"),
]
_Y_VERBS = ["yeron", "yendo", "yamos", "yais", "yan", "yen", "yas", "yes", "ya", "ye", "yo", "yó"]
_VERBS = [
    "arían", "arías", "arán", "arás", "aríais", "aría", "aréis", "aríamos", "aremos", "ará", "aré", "erían", "erías", "erán", "erás", "eríais", "ería", "eréis", "eríamos", "eremos", "erá", "eré",
    "irían", "irías", "irán", "irás", "iríais", "iría", "iréis", "iríamos", "iremos", "irá", "iré", "aba", "ada", "ida", "ía", "ara", "iera", "ad", "ed", "id", "ase", "iese", "aste", "iste", "an", "aban", "ían", "aran", "ieran",
    "asen", "iesen", "aron", "ieron", "ado", "ido", "ando", "iendo", "ió", "ar", "er", "ir", "as", "abas", "adas", "idas", "ías", "aras", "ieras", "ases", "ieses", "ís", "áis", "abais", "íais", "arais", "ierais", "aseis", "ieseis",
    "asteis", "isteis", "ados", "idos", "amos", "ábamos", "íamos", "imos", "áramos", "iéramos", "iésemos", "ásemos",
]


def _regions(word: str) -> tuple[int, int, int]:
    """Starts of RV, R1 and R2."""
    n = len(word)

    def after(start: int) -> int:
        for i in range(start + 1, n):
            if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
                return i + 1
        return n

    r1 = after(0)
    r2 = after(r1) if r1 < n else n
    rv = n
    if n > 2:
        if word[1] not in _VOWELS:
            rv = next((i + 1 for i in range(2, n) if word[i] in _VOWELS), n)
        elif word[0] in _VOWELS:
            rv = next((i + 1 for i in range(2, n) if word[i] not in _VOWELS), n)
        else:
            rv = 3
    return rv, r1, r2


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem of a lower-case Spanish word."""
    rv, r1, r2 = _regions(word)

    def ends(suffixes, start):
        return next((s for s in sorted(suffixes, key=len, reverse=True) if word.endswith(s) and len(word) - len(s) >= start), None)

    # Attached pronouns.
    pronoun = next((p for p in sorted(_PRONOUNS, key=len, reverse=True) if word.endswith(p)), None)
    if pronoun and len(word) - len(pronoun) >= rv:
        base = word[: -len(pronoun)]
        for accented, plain in _GERUNDS:
            if base.endswith(accented) and len(base) - len(accented) >= rv:
                word = base[: -len(accented)] + plain
                break
        else:
            if any(base.endswith(e) and len(base) - len(e) >= rv for e in ("iendo", "ando", "ar", "er", "ir")) or (base.endswith("yendo") and base[-6:-5] == "u" and len(base) - 5 >= rv):
                word = base
    before = word
    # Standard suffixes: the longest one decides.
    found, rule = max(((s, r) for suffixes, r in _STANDARD for s in suffixes if word.endswith(s)), key=lambda x: len(x[0]), default=("", None))
    if rule is not None and len(word) - len(found) >= (r1 if rule == "amente" else r2):
        cut = word[: -len(found)]
        if rule in ("log", "u", "ente"):
            word = cut + rule
        else:
            word = cut
            if rule == "ic" and word.endswith("ic") and len(word) - 2 >= r2:
                word = word[:-2]
            elif rule == "amente":
                if word.endswith("iv") and len(word) - 2 >= r2:
                    word = word[:-2]
                    if word.endswith("at") and len(word) - 2 >= r2:
                        word = word[:-2]
                elif word.endswith(("os", "ic", "ad")) and len(word) - 2 >= r2:
                    word = word[:-2]
            elif rule == "mente":
                more = next((s for s in ("ante", "able", "ible") if word.endswith(s) and len(word) - len(s) >= r2), None)
                word = word[: -len(more)] if more else word
            elif rule == "idad":
                more = next((s for s in ("abil", "ic", "iv") if word.endswith(s) and len(word) - len(s) >= r2), None)
                word = word[: -len(more)] if more else word
            elif rule == "iv" and word.endswith("at") and len(word) - 2 >= r2:
                word = word[:-2]
    if word == before:
        verb = ends(_Y_VERBS, rv)
        if verb and word[: -len(verb)].endswith("u"):
            word = word[: -len(verb)]
        else:
            verb = ends(_VERBS, rv)
            soft = ends(["en", "es", "éis", "emos"], rv)
            if verb and (not soft or len(verb) >= len(soft)):
                word = word[: -len(verb)]
            elif soft:
                word = word[: -len(soft)]
                if word.endswith("gu") and len(word) - 1 >= rv:
                    word = word[:-1]
    last = ends(["os", "a", "o", "á", "í", "ó"], rv)
    if last:
        word = word[: -len(last)]
    else:
        last = ends(["e", "é"], rv)
        if last:
            word = word[:-1]
            if word.endswith("gu") and len(word) - 1 >= rv:
                word = word[:-1]
    return word.translate(str.maketrans("áéíóú", "aeiou"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(tokens: pd.Series) -> pd.Series:
    """Stems of arrays of lower-case words; a null array stays null."""
    return tokens.map(lambda ws: None if ws is None else [stem(w) for w in ws])
