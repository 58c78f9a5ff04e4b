"""Find passages of held-out test items in a corpus, and the items that leaked.

The test items are dealt to blocks of bounded size: their inverted index (BM25 weights in
blocks of postings with a maximum for each) is broadcast, and *every* passage of every
document is a query against it. Retrieval is complete by its thresholds: each
item is cut into windows of ``MIN_WORDS`` words, the item's threshold is the least
BM25 score that any of its windows gives the item, so a passage that holds any
such window scores at least as much and is retrieved. Words that no item has can
score nothing and end a passage, so the passages are the runs of item words;
block-max WAND then skips items whose upper bound stays below their threshold.
Retrieved pairs are verified word by word; the overlap with the item's question
is reported beside the overlap with its text.

Words are maximal runs of letters and digits of the canonical decomposition
without combining marks, in lower case. Defined results: null and empty texts
and documents without identifier hold no passage; items of fewer than ``MIN_WORDS`` words cannot be found; a
document with several copies of an item counts once, equal items each count;
texts of any length are read in full.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12
K1, B = 1.2, 0.75
#: Postings of one block of the index.
BLOCK = 16
#: Items of one block; each block is an index of its own, which is broadcast.
BLOCK_ITEMS = 100_000

_WORD = re.compile(r"[^\W_]+")


def _combining_marks() -> str:
    marks = [c for c in range(0x10FFFF + 1) if unicodedata.category(chr(c))[0] == "M"]
    parts, start = [], None
    for c, following in zip(marks, [*marks[1:], -1], strict=True):
        start = c if start is None else start
        if following != c + 1:
            parts.append(f"{chr(start)}-{chr(c)}" if c > start else chr(c))
            start = None
    return "".join(parts)


_MARKS = re.compile(f"[{_combining_marks()}]+")
_MARK_SET = frozenset(chr(c) for c in range(0x10FFFF + 1) if unicodedata.category(chr(c))[0] == "M")


def fold_words(text: str) -> list[str]:
    """The words of a text without case and accents."""
    low = text.lower()
    if not low.isascii():
        low = _MARKS.sub("", unicodedata.normalize("NFD", low))
    return _WORD.findall(low)


class WordNumbers(dict):
    """Raw lower-case word -> its number in the vocabulary, -1 if no item has it, -2 if it folds to none or several words."""

    def __init__(self, vocabulary: dict[str, int], most: int = 500_000):
        super().__init__()
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, word: str) -> int:
        folded = fold_words(word)
        number = self.vocabulary.get(folded[0], -1) if len(folded) == 1 else -2
        if len(self) >= self.most:
            self.clear()
        self[word] = number
        return number

    def of(self, text: str) -> list[int]:
        """Numbers of the words of a text. A text with bare combining marks is folded as a whole."""
        if _MARK_SET.isdisjoint(set(text)):
            numbers = [self[w] for w in _WORD.findall(text.lower())]
            if -2 not in numbers:
                return numbers
        return [self.vocabulary.get(w, -1) for w in fold_words(text)]


class ItemIndex:
    """BM25 index of the items, with the maximum of each block of postings."""

    def __init__(self, items: list[tuple[int, str | None, str | None]], min_words: int = MIN_WORDS):
        self.min_words = min_words
        self.ids = [i for i, _, _ in items]
        words = [fold_words(text or "") for _, text, _ in items]
        self.questions = [frozenset(fold_words(q or "")) for _, _, q in items]
        self.vocabulary: dict[str, int] = {}
        for ws in words:
            for w in ws:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.numbers = WordNumbers(self.vocabulary)
        self.words = [np.array([self.vocabulary[w] for w in ws], dtype=np.int64) for ws in words]
        n = len(items)
        average = max(1.0, sum(map(len, words)) / max(1, n))
        frequency = Counter(t for ws in self.words for t in set(ws.tolist()))
        idf = {t: math.log(1 + (n - f + 0.5) / (f + 0.5)) for t, f in frequency.items()}
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        weights: list[dict[int, float]] = []
        for k, ws in enumerate(self.words):
            own = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(ws) / average)) for t, f in Counter(ws.tolist()).items()}
            weights.append(own)
            for t, w in own.items():
                postings[t].append((k, w))
        #: term -> (items ascending, their weights, the last item and the greatest weight of each block)
        self.postings = {
            t: (
                [k for k, _ in ps],
                [w for _, w in ps],
                [ps[min(i + BLOCK, len(ps)) - 1][0] for i in range(0, len(ps), BLOCK)],
                [max(w for _, w in ps[i : i + BLOCK]) for i in range(0, len(ps), BLOCK)],
            )
            for t, ps in postings.items()
        }
        self.greatest = {t: max(p[1]) for t, p in self.postings.items()}
        self.thresholds = [
            min((sum(weights[k][t] for t in set(ws[i : i + min_words].tolist())) for i in range(len(ws) - min_words + 1)), default=math.inf)
            for k, ws in enumerate(self.words)
        ]
        self.least = min(self.thresholds, default=math.inf)
        #: Greatest weight of each term as an array, for bounds of whole texts.
        self.bounds = np.array([self.greatest[t] for t in range(len(self.vocabulary))] + [-math.inf])
        self.windows: list[frozenset[tuple[int, ...]]] = [
            frozenset(tuple(ws[i : i + min_words].tolist()) for i in range(len(ws) - min_words + 1)) for ws in self.words
        ]

    def retrieve(self, terms: list[int]) -> list[int]:
        """Items that score at least their threshold for the set of ``terms`` (document-at-a-time block-max WAND)."""
        slack = 1e-9
        lists = [(self.postings[t], self.greatest[t]) for t in set(terms)]
        if sum(g for _, g in lists) < self.least - slack:
            return []
        cursors = [[p[0][0], 0, p, g] for p, g in lists]
        end = len(self.ids)
        found = []
        while True:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                if c[0] >= end:
                    break
                bound += c[3]
                if bound >= self.least - slack:
                    pivot = i
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # Upper bound from the blocks that could hold the item.
            block_bound = 0.0
            for c in cursors[: pivot + 1]:
                lasts, maxima = c[2][2], c[2][3]
                b = c[1] // BLOCK
                while b < len(lasts) and lasts[b] < item:
                    b += 1
                if b < len(lasts):
                    block_bound += maxima[b]
            if block_bound >= self.thresholds[item] - slack:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    self._advance(c, item, end)
                    if c[0] == item:
                        score += c[2][1][c[1]]
                        self._advance(c, item + 1, end)
                if score >= self.thresholds[item] - slack:
                    found.append(item)
            else:
                # Thresholds differ from item to item, so only this one is passed over.
                for c in cursors[: pivot + 1]:
                    self._advance(c, item + 1, end)

    @staticmethod
    def _advance(cursor: list, item: int, end: int) -> None:
        """Move a cursor to the first posting at or after ``item``, over whole blocks where it can."""
        items, _, lasts, _ = cursor[2]
        i = cursor[1]
        b = i // BLOCK
        while b < len(lasts) and lasts[b] < item:
            b += 1
            i = b * BLOCK
        while i < len(items) and items[i] < item:
            i += 1
        cursor[1], cursor[0] = i, items[i] if i < len(items) else end


def search_document(index: ItemIndex, text: str) -> list[tuple[int, int, float]]:
    """(item position, most consecutive words shared, share of the question's words in the document) of the items found."""
    n = index.min_words
    known = np.array(index.numbers.of(text), dtype=np.int64)
    if len(known) < n:
        return []
    # Passages: the windows of n item words whose upper bound reaches the least threshold, joined where they overlap.
    absent = np.concatenate([[0], np.cumsum(known < 0)])
    bound = np.concatenate([[0.0], np.cumsum(np.where(known < 0, 0.0, index.bounds[known]))])
    hopeful = (absent[n:] == absent[:-n]) & (bound[n:] - bound[:-n] >= index.least - 1e-9)
    if not hopeful.any():
        return []
    first = np.flatnonzero(hopeful)
    cut = np.flatnonzero(np.diff(first) > 1)
    edges = np.stack([first[np.concatenate([[0], cut + 1])], first[np.concatenate([cut, [len(first) - 1]])] + n], axis=1)
    best: dict[int, int] = {}
    for start, stop in edges:
        passage = known[start:stop].tolist()
        for item in index.retrieve(passage):
            longest = _longest_common_run(passage, index, item)
            if longest >= n:
                best[item] = max(best.get(item, 0), longest)
    if not best:
        return []
    own = set(fold_words(text))
    return [(item, run, len(index.questions[item] & own) / max(1, len(index.questions[item]))) for item, run in best.items()]


def _longest_common_run(passage: list[int], index: ItemIndex, item: int) -> int:
    """Most consecutive words that the passage and the item share, if at least ``min_words``."""
    n, windows = index.min_words, index.windows[item]
    best = run = 0
    previous = None
    for i in range(len(passage) - n + 1):
        if tuple(passage[i : i + n]) in windows:
            run = run + 1 if previous == i - 1 else 1
            previous = i
            best = max(best, n - 1 + run)
    return best


def leaked_items(documents: DataFrame, ident: str, text: str, items: DataFrame, item_id: str, item_text: str, question: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, palabras, pregunta): items found in each document.

    ``palabras`` is the length of the longest run of words counted in windows of
    the item, ``pregunta`` the share of the question's words in the document.
    """
    items = items.select(item_id, item_text, question).where(f"{item_id} IS NOT NULL")
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    parts = [items.where(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == b).collect() for b in range(blocks)]
    return reduce(DataFrame.unionByName, [_leaked_of(documents, ident, text, [tuple(r) for r in part], min_words) for part in parts])


def _leaked_of(documents: DataFrame, ident: str, text: str, rows: list[tuple], min_words: int) -> DataFrame:
    """:func:`leaked_items` for the items (id, text, question) of one block."""
    index = documents.sparkSession.sparkContext.broadcast(ItemIndex(rows, min_words))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = index.value
        for frame in frames:
            out = [
                (doc, own.ids[item], run, share)
                for doc, content in zip(frame[ident], frame[text], strict=True)
                if content
                for item, run, share in search_document(own, content)
            ]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "palabras", "pregunta"])

    return documents.select(ident, text).where(f"length({text}) > 0 AND {ident} IS NOT NULL").mapInPandas(search, "doc_id long, item_id long, palabras int, pregunta double")
