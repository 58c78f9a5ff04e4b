"""Text expressions, all evaluated in the JVM inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTED = "áàâäãåāéèêëēíìîïīóòôöõōúùûüūñçýÿ"
_PLAIN = "aaaaaaaeeeeeiiiiioooooouuuuuncyy"

#: A word: letters, digits and underscore of any script (``\\w`` would be ASCII in the JVM).
WORD = r"[\p{L}\p{N}_]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a lambda an outer expression would be computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(text: Column) -> Column:
    """Lower case without accents; combining marks of decomposed letters are dropped too."""
    return F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _PLAIN), r"\p{M}+", "")


def words(text: Column) -> Column:
    """All words of an already folded text, in order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def long_words(text: Column) -> Column:
    """Words of two characters or more: the tokens of the TF-IDF vocabularies."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def without(tokens: Column, stopwords: Iterable[str], min_chars: int = 1) -> Column:
    """Tokens of at least ``min_chars`` that are no stopwords."""
    stop = F.array(*[F.lit(w) for w in sorted(set(stopwords))]) if stopwords else F.array().cast("array<string>")
    return F.filter(tokens, lambda t: (F.length(t) >= min_chars) & ~F.array_contains(stop, t))


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def clean(text: Column) -> Column:
    """Lower case, only letters, underscores and spaces, runs of spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\p{N}+", ""), r"\s+", " "))


def slug(text: Column, default: str | None = None) -> Column:
    """Folded text with everything but ASCII letters and digits as single underscores."""
    bare = F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.when(bare != "", bare), F.lit(default)) if default is not None else bare


def label_key(text: Column) -> Column:
    """Folded label with everything but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` tokens joined by a space; none where there are fewer tokens."""
    size = F.size(tokens)
    made = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(size >= n, made).otherwise(F.array().cast("array<string>"))


def sentence_count(text: Column) -> Column:
    """Runs of ``. ! ?``; at least one where there is text."""
    return F.when(F.length(text) > 0, F.greatest(F.lit(1), F.regexp_count(text, F.lit("[.!?]+")))).otherwise(F.lit(0))


def snippet(text: Column, length: int) -> Column:
    """The first ``length`` characters, with dots where there were more."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    """Whether one of the substrings occurs."""
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(text, F.lit(needle))
    return found


def hashtags(text: Column) -> Column:
    """Words after ``#``, as written."""
    return F.regexp_extract_all(text, F.lit(r"#([\p{L}\p{N}_]+)"), F.lit(1))


def query_pieces(expression: Column) -> Column:
    """Quoted phrases and single words of a saved query, in lower case."""
    pieces = F.regexp_extract_all(F.lower(expression), F.lit(r'"[^"]+"|\S+'), F.lit(0))
    return F.transform(pieces, lambda p: F.regexp_replace(p, r'^"([^"]+)"$', "$1"))
