"""Find texts that were cut off by a field limit or in transfer, and each source's share of them.

A stack automaton reads the whole of each text once: quotes (straight ones too),
brackets and elements of markup are pushed and popped, escapes and multibyte
sequences followed to their end. What is still open at the end of the text, in
whichever paragraph it was opened, an ellipsis mark of a teaser, or an end that
is no end of a sentence speaks for a cut. Three things settle the open ends:

* a *boundary model*: how often the last words of the text end a sentence or a
  line where they occur elsewhere. It is fitted on all texts, in which every
  inner boundary is a labelled case;
* *refrains*: a closing sentence with rhetorical dots is told from a teaser by its
  being repeated; counted over all texts;
* the *baseline of the source*: lengths at which more of its texts break off than
  at the neighbouring lengths, counted over all texts, decide the ends that the
  model leaves open.

Defined results: null and blank texts are not cut; records without identifier are left out; a finished text without its
full stop is not; a text ending in furniture of its page is not; equal texts get
equal results; a null source is a source of its own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamiz.llm.page_content import furniture_flags, is_furniture_wording
from tamiz.session import materialise

#: Texts whose places are looked at together (memory only; all are counted).
CHUNK = 2_000
#: Contexts of the model: up to so many tokens, kept if seen so often.
CONTEXT, SEEN = 4, 3
#: Tokens of a sentence's skeleton, and how many of the most frequent words belong to it.
SKELETON, FUNCTION_WORDS = 5, 60
#: Weight, in occurrences, of a context when the next longer one is judged.
PRIOR = 4
#: A share of ends at or below LOW means a cut, at or above HIGH a finished text.
LOW, HIGH = 0.02, 0.5
MIDDLE = 0.08
#: A closing sentence with dots is a refrain if at least so many texts (and this share of all) end in it.
REFRAIN_TEXTS, REFRAIN_SHARE = 5, 0.0003
#: Texts of one source that break off at one length before the length can count as its limit.
LIMIT_TEXTS = 3
#: Lengths on either side from which the chance count of a length is told, and the number of false limits to be expected in all of the input.
NEIGHBOURS, FALSE_LIMITS = 50, 0.01

_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|\w+|\n|\.\.\.|[^\w\s]")
_ENDS = frozenset([".", "?", "!", "\n"])
_CLOSERS = frozenset(["»", "”", '"', "'", ")", "]"])
_MARK = re.compile(r"(?:\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…|más|sigue)\s*\)|(?:\.\.\.|…)?\s*(?:leer más|seguir leyendo|ver más|continuar leyendo|read more|leia mais|\[\+\]))\W*$", re.IGNORECASE)
#: Characters of the longest wording of a mark.
LONGEST_MARK = len("continuar leyendo")
_ESCAPE = re.compile(r"(?:&[a-zA-Z]{0,9}|&#\d{0,6}|&#x[0-9a-fA-F]{0,5}|\\u[0-9a-fA-F]{0,3}|\\|(?<=[A-Za-z/])%[0-9A-F]?)$|�+$")
#: Characters of the longest unfinished escape and what must stand before it: the pattern is bound to the end and can't begin earlier.
LONGEST_ESCAPE = 16
_TAG = re.compile(r"<[/a-zA-Z!][^<>]*$")
_ELLIPSIS = re.compile(r"(?:\.\.\.|…|\.{2,})\s*$")
_SENTENCE_START = re.compile(r"(?:[.!?…][»”\")]*\s+|\n)(?=\S)")
_UP_TO_END = re.compile(r".*(?:[^.\d][.?!][»”\")]*(?=\s|$)|\n)", re.DOTALL)
_DOTS = re.compile(r"(?:\.{2,}|…)[^\n.]*$")
_PAIRS = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”"}
_CLOSE = {v: k for k, v in _PAIRS.items()}
_STRUCTURE = re.compile(r"</?[a-zA-Z][^<>]*>|[()\[\]{}«»“”\"]")
_NAME = re.compile(r"</?([a-zA-Z][\w:-]*)")
# Elements of HTML without an end tag, or whose end tag may be left out.
_UNCLOSED = frozenset("area base br col embed hr img input link meta source track wbr p li dt dd tr td th thead tbody tfoot option".split())


def open_structures(text: str) -> list[str]:
    """What is still open at the end of a text, innermost last: brackets, quotes, elements (``<b>``), ``tag``, ``escape``.

    A closing mark pops back to its opening one; one without is passed over (a
    list item such as ``1)`` opens nothing). A straight quote closes the
    straight quote that is open, and opens one otherwise; a mark of inches or
    seconds after a digit opens none.
    """
    stack: list[str] = []
    for found in _STRUCTURE.finditer(text):
        mark = found[0]
        if mark in _PAIRS:
            stack.append(mark)
            continue
        if mark == '"':
            before = text[found.start() - 1 : found.start()]
            if '"' not in stack:
                if not before.isdigit():
                    stack.append(mark)
                continue
            opening = mark
        elif mark[0] == "<":
            name = _NAME.match(mark)[1].lower()
            if name in _UNCLOSED or mark.endswith("/>"):
                continue
            opening = f"<{name}>"
            if mark[1] != "/":
                stack.append(opening)
                continue
        else:
            opening = _CLOSE[mark]
        if opening in stack:
            while stack.pop() != opening:
                pass
    ending = text.rstrip()
    if ending.rfind("<") > ending.rfind(">") and _TAG.search(ending, ending.rfind("<")):
        stack.append("tag")
    if _ESCAPE.search(ending, max(0, len(ending) - LONGEST_ESCAPE)):
        stack.append("escape")
    return stack


def has_mark(line: str) -> bool:
    """Whether a line ends in the mark of a teaser; only its end is read.

    A mark without letters begins after the last word, one in brackets no further
    before it than the white space and the bracket, any other is a wording that ends
    with it.
    """
    end = len(line)
    while end and not (line[end - 1].isalnum() or line[end - 1] == "_"):
        end -= 1
    word = end
    while word and (line[word - 1].isalnum() or line[word - 1] == "_"):
        word -= 1
    return bool(_MARK.search(line, max(0, min(end - LONGEST_MARK, len(line[:word].rstrip()) - 1))))


def _taught(text: str) -> list[str]:
    """Tokens of a text up to its last plain end: what follows may have been cut and teaches nothing."""
    text = text.replace("\r", "")
    found = _UP_TO_END.match(_DOTS.sub("", text) if ".." in text or "…" in text else text)
    return _TOKEN.findall(found[0]) if found else []


def _word_counts(texts: Iterable[list[str]]) -> Counter:
    """How many texts (of tokens) hold each capitalised word, and how often each small one occurs."""
    held, all_ = Counter(), Counter()
    for x in texts:
        held.update(set(x))
        all_.update(x)
    return Counter({t: n if t[0].isupper() else all_[t] for t, n in held.items() if t[0].isupper() or t[0].islower()})


_MASK, _FACTOR, _CONTEXT_SEED, _FRAME_SEED = (1 << 64) - 1, 0x9E3779B97F4A7C15, 1, 2


def _roll(key: int, code: int) -> int:
    """The number of a sequence of kinds, one kind longer; :func:`_rolled` for arrays."""
    key = (key * _FACTOR + code) & _MASK
    return key ^ key >> 29


def _rolled(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    keys = keys * np.uint64(_FACTOR) + codes
    return keys ^ keys >> np.uint64(29)


def _among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the keys that are in ``wanted``, which is sorted; a table of low bits spares most searches."""
    if not len(wanted):
        return np.zeros(0, dtype=np.int64)
    bits = np.uint64((1 << 22) - 1)
    table = np.zeros(1 << 22, dtype=bool)
    table[wanted & bits] = True
    likely = np.flatnonzero(table[keys & bits])
    found = keys[likely]
    return likely[wanted[np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)] == found]


class Wording:
    """Kinds of tokens: numbers and rare names made alike. A sentence's frame is its function words and marks."""

    def __init__(self, common: frozenset[str], function_words: frozenset[str]):
        self.common, self.function_words = common, function_words

    def kind(self, token: str) -> str:
        return "9" if token[0].isdigit() else token if not token[0].isupper() or token in self.common else "N"

    def in_frame(self, kind: str) -> bool:
        return kind in self.function_words or not kind[0].isalnum()

    def keys(self, tokens: list[str]) -> tuple[list[int], int, int]:
        """(numbers of the last 1, 2, .. ``CONTEXT`` tokens, number and length of the skeleton) at the end of ``tokens``."""
        kinds = [self.kind(t) for t in tokens[-CONTEXT:]]
        contexts, key = [], _CONTEXT_SEED
        for kind in reversed(kinds):
            contexts.append(key := _roll(key, xxhash.xxh3_64_intdigest(kind)))
        start = max((i for i, t in enumerate(tokens) if t in _ENDS), default=-1) + 1
        frame = [kind for t in tokens[start:] if self.in_frame(kind := self.kind(t))][-SKELETON:]
        return contexts, reduce(_roll, map(xxhash.xxh3_64_intdigest, frame), _FRAME_SEED), len(frame)

    def boundaries(self, texts: list[list[str]], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
        """(keys, how often seen, how often at an end, places, ends) of all inner places of texts of tokens; only of ``wanted`` keys, which are sorted, if given."""
        texts = [x for x in texts if len(x) > 1]
        empty = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0, 0
        if not texts:
            return empty
        sizes = np.array([len(x) for x in texts])
        number: dict[str, int] = {}
        at = np.fromiter((number.setdefault(t, len(number)) for x in texts for t in x), dtype=np.int64, count=int(sizes.sum()))
        kinds = [self.kind(t) for t in number]
        code = np.array([xxhash.xxh3_64_intdigest(k) for k in kinds], dtype=np.uint64)[at]
        is_end, is_closer, framed = (np.array([f(k) for k in kinds])[at] for f in (_ENDS.__contains__, _CLOSERS.__contains__, self.in_frame))
        framed &= ~is_end
        place = np.arange(len(at))
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        last = np.repeat(np.cumsum(sizes) - 1, sizes)
        # The next token that closes nothing, at most the last one of the text.
        onward = np.minimum.accumulate(np.where(~is_closer | (place == last), place, len(at))[::-1])[::-1]
        asked = np.flatnonzero((place < last) & ~is_end)
        if not len(asked):
            return empty
        end = is_end[onward[asked + 1]]
        keys, ends = [], []
        key = np.full(len(asked), _CONTEXT_SEED, dtype=np.uint64)
        live = np.arange(len(asked))
        for k in range(CONTEXT):
            inside = asked[live] - k >= first[asked[live]]
            live = live[inside]
            key = _rolled(key[inside], code[asked[live] - k])
            if wanted is not None:
                # Where a context is asked about the shorter ones are too: places without these are done.
                held = _among(key, wanted)
                live, key = live[held], key[held]
            keys.append(key)
            ends.append(end[live])
        count = np.cumsum(framed)
        # Frame tokens before the sentence of a place: those up to the last end, or before the text.
        begun = np.maximum(np.maximum.accumulate(np.where(is_end, place, -1)), first - 1)
        before = np.concatenate([[0], count])[begun + 1]
        frames = code[np.flatnonzero(framed)] if framed.any() else np.zeros(1, dtype=np.uint64)
        key = np.full(len(asked), _FRAME_SEED, dtype=np.uint64)
        for k in range(SKELETON, 0, -1):
            back = count[asked] - k
            key = np.where(back >= before[asked], _rolled(key, frames[np.maximum(back, 0)]), key)
        held = slice(None) if wanted is None else _among(key, wanted)
        keys, ends = np.concatenate([*keys, key[held]]), np.concatenate([*ends, end[held]])
        distinct, inverse = np.unique(keys, return_inverse=True)
        n = len(distinct)
        return distinct, np.bincount(inverse, minlength=n), np.bincount(inverse[ends], minlength=n), len(asked), int(end.sum())


def _wording(words: Counter, texts: int) -> Wording:
    common = frozenset(t for t, n in words.items() if t[0].isupper() and n >= max(5, texts // 200))
    small = sorted((x for x in words.items() if x[0][0].islower()), key=lambda x: (-x[1], x[0]))
    return Wording(common, frozenset(t for t, _ in small[:FUNCTION_WORDS]))


class BoundaryModel:
    """Probability that a text ends where its last words stand, from the inner boundaries of texts.

    Two views of each boundary, taken as independent: the last ``CONTEXT``
    tokens, and the *skeleton* of the sentence so far, its last function words
    and marks, which tells a clause that must go on from one that may end. The
    counts are held by the 64-bit numbers of these sequences; :func:`fitted`
    counts over tables and holds what is asked.
    """

    def __init__(self, texts: list[str]):
        taught = [_taught(x) for x in texts]
        words = _word_counts(taught)
        self.wording = _wording(words, len(texts))
        self.names = frozenset(t for t in words if t[0].isupper())
        self._hold(*self.wording.boundaries(taught))

    @classmethod
    def of(cls, wording: Wording, names: frozenset[str], *counts) -> BoundaryModel:
        model = cls.__new__(cls)
        model.wording, model.names = wording, names
        model._hold(*counts)
        return model

    def _hold(self, keys: np.ndarray, seen: np.ndarray, ended: np.ndarray, total: int, ends: int) -> None:
        self.keys, self.seen, self.ended = keys, seen, ended
        self.base = max(ends, 1) / max(total, 2)

    def _share(self, key: int, least: int) -> tuple[int, float] | None:
        """(how often seen, share of ends) of a key that was seen ``least`` times."""
        i = int(np.searchsorted(self.keys, np.uint64(key)))
        if i == len(self.keys) or int(self.keys[i]) != key or self.seen[i] < least:
            return None
        return int(self.seen[i]), float(self.ended[i] / self.seen[i])

    def end_share(self, tail: str) -> float:
        """How probably ``tail``, the line so far, ends a sentence or line; 0 for a broken word."""
        tokens = _TOKEN.findall(tail)
        if not tokens:
            return 1.0
        last = tokens[-1]
        if last[0].isupper() and last not in self.names or len(last) == 1 and last.isalpha() and last not in "aeoyuAEOYU":
            return 0.0
        contexts, skeleton, length = self.wording.keys(tokens)
        share = 0.0
        for k, key in enumerate(contexts):
            found = self._share(key, 1 if k == 0 else SEEN)
            if found is None:
                break
            n, ends = found
            # Longer contexts outweigh shorter ones as far as they were seen.
            share = ends if k == 0 else (n * ends + PRIOR * share) / (n + PRIOR)
        if not 0 < share < 1:
            return share
        n, ends = self._share(skeleton, 1 if length == 2 else SEEN) or (0, 0.0)
        prior = self.base / (1 - self.base)
        whole = (n * ends + PRIOR * self.base) / (n + PRIOR)
        odds = share / (1 - share) * min(1e3, whole / max(1e-9, 1 - whole)) / prior
        return odds / (1 + odds)


class _Recorder:
    """Stands for a model and keeps the tails it is asked about."""

    def __init__(self) -> None:
        self.tails: set[str] = set()

    def end_share(self, tail: str) -> float:
        self.tails.add(tail)
        return 0.5


def fitted(asking: DataFrame, teaching: DataFrame) -> BoundaryModel:
    """The model of the boundaries of all texts of ``teaching`` (text), as far as the ends of ``asking`` (text) need it.

    Three passes of partial counts a batch that are added up: words, the ends that
    the model is asked about, and their contexts. No text leaves its task; the
    driver gets the words that are common, the sums of the contexts asked about and
    the names that end a text.
    """

    def count_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            words = _word_counts(_taught(x) for x in frame["text"])
            # As objects: Arrow does not take the floats of an empty frame for text.
            yield pd.DataFrame([(t, t[0].isupper(), n) for t, n in words.items()], columns=["word", "capital", "n"], dtype=object)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            recorder = _Recorder()
            for x in frame["text"]:
                examine(x, recorder)
            yield pd.DataFrame([(x, (_TOKEN.findall(x) or [""])[-1]) for x in recorder.tails], columns=["tail", "word"], dtype=object)

    def key_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys: set[int] = set()
            for tail in frame["tail"]:
                contexts, skeleton, _ = wording.keys(_TOKEN.findall(tail))
                keys.update(contexts, [skeleton])
            yield pd.DataFrame({"k": np.array(list(keys), dtype=np.uint64).view(np.int64)})

    def count_boundaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for i in range(0, len(texts), CHUNK):
                keys, seen, ended, total, ends = wording.boundaries([_taught(x) for x in texts[i : i + CHUNK]], holder.value)
                # The sums of all places ride along without a key.
                yield pd.DataFrame({"k": pd.array([*keys.view(np.int64), None], dtype="Int64"), "n": [*seen, total], "e": [*ended, ends]})

    spark = teaching.sparkSession
    teaching = teaching.where(F.length("text") > 0).select("text")
    words = materialise(teaching.mapInPandas(count_words, "word string, capital boolean, n long").groupBy("word", "capital").agg(F.sum("n").alias("n")), "words")
    n = teaching.count()
    kept = words.where(F.col("capital") & (F.col("n") >= max(5, n // 200))).unionByName(words.where(~F.col("capital")).orderBy(F.desc("n"), "word").limit(FUNCTION_WORDS))
    wording = _wording(Counter({r["word"]: r["n"] for r in kept.collect()}), n)
    tails = materialise(asking.where(F.length("text") > 0).select("text").mapInPandas(ask, "tail string, word string").distinct(), "tails")
    wanted = tails.mapInPandas(key_of, "k long").distinct().toArrow().column("k").to_numpy()
    holder = spark.sparkContext.broadcast(np.sort(wanted.view(np.uint64)))
    sums = teaching.mapInPandas(count_boundaries, "k long, n long, e long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("e").alias("e")).toArrow()
    names = frozenset(r["word"] for r in words.where("capital").join(tails.select("word").distinct(), "word", "left_semi").select("word").collect())
    k, seen, ended = (sums.column(c) for c in ("k", "n", "e"))
    held = np.array(k.is_valid())
    keys, seen, ended = np.array(k.fill_null(0)).astype(np.int64).view(np.uint64), np.array(seen), np.array(ended)
    order = np.flatnonzero(held)[np.argsort(keys[held])]
    return BoundaryModel.of(wording, names, keys[order], seen[order], ended[order], int(seen[~held].sum()), int(ended[~held].sum()))


def examine(text: str | None, model: BoundaryModel) -> tuple[str, float, str | None]:
    """(``finished`` / ``cut`` / ``open`` / ``dots``, share of ends, closing sentence of a dotted text)."""
    if text is None or not text.strip():
        return "finished", 1.0, None
    body = text.rstrip()
    line = body[body.rfind("\n") + 1 :].strip()
    if has_mark(line):
        return "cut", 0.0, None
    structures = open_structures(body)
    if "escape" in structures or "tag" in structures or body[-1] in "([{«“¿¡":
        return "cut", 0.0, None
    # The line is stripped: dots at its end are its last characters.
    dots = line[-1] in ".…" and _ELLIPSIS.search(line)
    if dots:
        starts = list(_SENTENCE_START.finditer(line[: dots.start()]))
        return "dots", 0.0, line[starts[-1].end() if starts else 0 : dots.start()].strip()
    core = line.rstrip("»”\"')]")
    if core and core[-1] in ".!?":
        # A full stop after a number may be one inside it.
        if core[-1] == "." and core[-2:-1].isdigit() and model.end_share(core[:-1]) <= LOW:
            return "cut", 0.0, None
        return "finished", 1.0, None
    if line[-1] in ",;:-–—" or structures:
        return "cut", 0.0, None
    share = model.end_share(line)
    # A blank left at the end is what a cut between words leaves.
    return "open", share * (0.2 if text[-1] == " " and share < 0.9 else 1.0), None


def score_texts(df: DataFrame, model: BoundaryModel) -> DataFrame:
    """(tabla, id, src, n_chars, estado, p, frase) for every text of (tabla, id, src, text)."""
    holder = df.sparkSession.sparkContext.broadcast(model)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = holder.value
        for frame in frames:
            texts = frame["text"].tolist()
            results = [examine(x, model) for x in texts]
            # Only ends that are no end of a sentence can be furniture of the page.
            unclear = [i for i, r in enumerate(results) if r[0] == "open"]
            for i, flags in zip(unclear, furniture_flags([texts[i] for i in unclear]), strict=True):
                last = texts[i].rstrip().count("\n")
                if flags[last] and (results[i][1] > LOW or is_furniture_wording(texts[i].rstrip().rpartition("\n")[2])):
                    results[i] = ("finished", 1.0, None)
            out = frame[["tabla", "id", "src"]].copy()
            out["n_chars"] = [len(x) if isinstance(x, str) else 0 for x in texts]
            out["estado"], out["p"], out["frase"] = zip(*results, strict=True) if results else ([], [], [])
            yield out

    return df.select("tabla", "id", "src", "text").mapInPandas(score, "tabla string, id long, src string, n_chars long, estado string, p double, frase string")


def source_limits(broken: DataFrame) -> DataFrame:
    """(tabla, src, n_chars): the lengths at which more of a source's broken texts (tabla, src, n_chars) end than chance explains.

    Chance is Poisson about the mean of the neighbouring lengths of the source, the
    shorter or the longer ones, whichever is more (the texts of a source may begin
    or end at a length), with one count more for few texts; a length is
    its limit where the Chernoff bound of so many texts, times the number of
    lengths looked at, is ``FALSE_LIMITS`` or less. The bound rises with the
    counts of the neighbours, so chance makes no limit at any size.
    """
    cells = broken.groupBy("tabla", "src", "n_chars").agg(F.count("*").alias("k"))
    looked_at = cells.count()
    lengths = Window.partitionBy("tabla", "src").orderBy("n_chars")
    shorter, longer = (F.coalesce(F.sum("k").over(lengths.rangeBetween(*x)), F.lit(0)) for x in ((-NEIGHBOURS, -1), (1, NEIGHBOURS)))
    # Lengths below 1 do not exist and so are no neighbours.
    below = F.greatest(F.lit(1), F.least(F.col("n_chars") - 1, F.lit(NEIGHBOURS)))
    told = cells.withColumn("_mean", F.greatest((shorter + 1) / below, (longer + 1) / NEIGHBOURS))
    unlikely = F.col("k") * F.log(F.col("k") / F.col("_mean")) - (F.col("k") - F.col("_mean"))
    least = math.log(max(looked_at, 1) / FALSE_LIMITS)
    return told.where((F.col("k") >= LIMIT_TEXTS) & (F.col("k") > F.col("_mean")) & (unlikely >= least)).select("tabla", "src", "n_chars")


def cut_texts(df: DataFrame, sample_texts: int | None = None) -> DataFrame:
    """``df`` (tabla, id, src, text) as (tabla, id, src, cortado) with each text's verdict.

    The boundary model is fitted on all texts, or on ``sample_texts`` of them where
    a number is given.
    """
    df = df.where("id IS NOT NULL")
    n = df.count()
    teaching = df
    if sample_texts is not None:
        # By hash of the text: the least hashes, so that it is the same at every run and in any order.
        teaching = df.where(F.length("text") > 0).orderBy(F.pmod(F.xxhash64("text"), F.lit(1_000_003)), "text").limit(sample_texts)
    model = fitted(df, teaching)
    scored = materialise(score_texts(df, model), "scored")

    refrains = scored.where("estado = 'dots'").groupBy("frase").agg(F.count("*").alias("k"))
    refrains = refrains.where((F.col("k") >= max(REFRAIN_TEXTS, REFRAIN_SHARE * n)) & (F.size(F.split("frase", " ")) >= 3)).select("frase", F.lit(True).alias("estribillo"))
    broken = (F.col("estado") == "cut") | (F.col("estado") == "dots") | ((F.col("estado") == "open") & (F.col("p") <= LOW))
    limits = source_limits(scored.where(broken)).select(F.col("tabla").alias("_t"), F.col("src").alias("_s"), F.col("n_chars").alias("_n"), F.lit(True).alias("limite"))
    joined = scored.join(refrains, "frase", "left").join(
        limits, (F.col("tabla") == F.col("_t")) & F.col("src").eqNullSafe(F.col("_s")) & (F.col("n_chars") == F.col("_n")), "left"
    )
    bound = F.when(F.col("limite"), F.lit(HIGH)).otherwise(F.lit(MIDDLE))
    verdict = (
        F.when(F.col("estado") == "cut", True)
        .when(F.col("estado") == "dots", F.col("estribillo").isNull())
        .when(F.col("estado") == "open", F.col("p") <= bound)
        .otherwise(False)
    )
    return joined.select("tabla", "id", "src", verdict.alias("cortado"))


def share_by_source(verdicts: DataFrame) -> DataFrame:
    """For each table and source: its records, those cut, and their share."""
    return verdicts.groupBy("tabla", F.col("src").alias("fuente")).agg(
        F.count("*").alias("registros"), F.count_if("cortado").alias("cortados"), F.avg(F.col("cortado").cast("int")).alias("proporcion")
    )
