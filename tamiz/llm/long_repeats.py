"""Long spans that occur verbatim in several documents, by recompression.

Every text is rewritten as ever fewer symbols. First runs of one character are
named, then rounds put the symbols on two sides by a bit of their name and make
each pair left-right one new symbol. Names are hashes of what they stand for, so
all partitions name equal runs and pairs alike, and equal substrings come out as
equal symbols but for a few at either end. The spans of symbols are bounded
(``CAPS``), so it is known how many characters a border between symbols depends
on (``CONTEXT``); names of ``KEY_CHARS`` characters and windows of
``WINDOW_CHARS`` are chosen so that the following holds for *any* text:

    two equal substrings of ``MIN_CHARS`` characters have a common anchor,

an anchor being a border whose symbol has the least name in some window of
borders. The symbols from an anchor on, until they stand for ``KEY_CHARS``
characters or more, are the high-level symbol that all documents are compared by.

Rounds over all documents follow. One keeps the high-level symbols that occur in
several documents. One names the pairs of such symbols that overlap or touch: a
pair that occurs as often as either of its parts replaces both, and so a whole
chain of symbols that always occur together becomes one, however long the
repeat. What is left is verified: symbols of up to ``COLD`` occurrences
character by character on both sides; those that occur more often (a legal
notice, say) are divided into all windows of ``MIN_CHARS`` characters that hold
them, named by 128 bits, so that each document meets only documents with which
it shares such a window, in blocks of bounded size.

Documents with equal texts form a class; one of them stands for all. The
operator gives pairs of representatives and the members of the classes
(:func:`representative_pairs`), and spans without any pairs for hot symbols
(:func:`shared_spans`); :func:`repeated_pairs` spells all pairs out.

Defined results: null texts, texts without identifier and texts shorter than the length asked for share
nothing; a repeat inside one document is none; lengths are in code points.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.pairs import met
from tamiz.session import broadcast_if_small, materialise

MIN_CHARS = 300
#: Longest run of one character that becomes a symbol, and longest symbol of each round of pairs.
RUN_CAP, CAPS = 4, (4, 8, 8, 16)
#: Characters that a high-level symbol stands for at least, and that the borders an anchor is chosen from span.
KEY_CHARS, WINDOW_CHARS = 128, 80
#: Bits of a name that give way to the place of a symbol among those looked at together.
INDEX_BITS = 22
#: Occurrences of one name that are compared each with each.
COLD = 24

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def context() -> int:
    """Characters on either side that the existence of a border can depend on.

    A round of pairs looks at the symbols beside a border, each of at most the
    last cap and with borders of its own; the round of runs looks one character
    beyond the longest run.
    """
    reach, span = RUN_CAP + 1, RUN_CAP
    for cap in CAPS:
        reach, span = reach + span, cap
    return reach


#: By what the two ends, the first border, the window, the symbol of the anchor and the last symbol of its name take.
CONTEXT = context()
assert 2 * CONTEXT + 2 * max(CAPS) + WINDOW_CHARS + KEY_CHARS <= MIN_CHARS


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def recompress(codes: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, first positions) of the symbols after all rounds; ``doc_starts`` are the positions at which a text begins."""
    end = len(codes)
    begins = np.zeros(end, dtype=bool)
    begins[doc_starts[doc_starts < end]] = True
    names, at = _mix(codes.astype(np.uint64) + _M3), np.arange(end, dtype=np.int64)
    # Runs of one character; longer ones than the cap stay single characters.
    same = (codes[1:] == codes[:-1]) & ~begins[1:]
    if same.any():
        head = np.flatnonzero(np.concatenate([[True], ~same]))
        length = np.diff(np.concatenate([head, [end]]))
        joined = (length > 1) & (length <= RUN_CAP)
        keep = np.ones(end, dtype=bool)
        keep[1:] = ~(same & np.repeat(joined, length)[1:])
        names[head[joined]] = _mix(names[head[joined]] * _M3 + length[joined].astype(np.uint64))
        names, at, begins = names[keep], at[keep], begins[keep]
    for level, cap in enumerate(CAPS):
        if len(names) < 2:
            break
        right = (names >> np.uint64(7 + 5 * level)) & np.uint64(1) == 1
        pair = ~right[:-1] & right[1:] & ~begins[1:]
        first = np.flatnonzero(pair)
        stop = np.append(at, end)
        first = first[stop[first + 2] - at[first] <= cap]
        names[first] = _mix(names[first] * _M1 + names[first + 1] * _M3 + np.uint64(level + 1))
        keep = np.ones(len(names), dtype=bool)
        keep[first + 1] = False
        names, at, begins = names[keep], at[keep], begins[keep]
    return names, at


def _anchors(names: np.ndarray, at: np.ndarray, doc_end: np.ndarray) -> np.ndarray:
    """Indices of the borders whose symbol has the least name in some window of ``WINDOW_CHARS`` characters of their text."""
    n = len(names)
    stop = np.searchsorted(at, at + WINDOW_CHARS)
    whole = np.flatnonzero(at + WINDOW_CHARS <= doc_end)
    if not len(whole):
        return whole
    # The index is packed below the name: the least is found with its place, the first one of equal names.
    bits = np.uint64(max(INDEX_BITS, n.bit_length()))
    least = (names >> bits << bits) | np.arange(n, dtype=np.uint64)
    first, last = whole, stop[whole]
    power = np.frexp((last - first).astype(np.float64))[1] - 1
    found = np.empty(len(whole), dtype=np.uint64)
    for k in range(int(power.max()) + 1):
        own = power == k
        found[own] = np.minimum(least[first[own]], least[last[own] - (1 << k)])
        if len(least) > 1 << k:
            least = np.minimum(least[: -(1 << k)], least[1 << k :])
    place = (found & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    chosen = np.zeros(n, dtype=bool)
    chosen[place] = True
    return np.flatnonzero(chosen)


def _sequence_names(names: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Names of the sequences of symbols ``names[first:last]``, by prefix polynomials modulo 2**64."""
    powers, back = _powers(1 << max(16, len(names).bit_length()))
    # sum of name * base**i up to each symbol; dividing by base**p is multiplying by the inverse's power.
    sums = np.zeros(len(names) + 1, dtype=np.uint64)
    np.cumsum(names * powers[: len(names)], dtype=np.uint64, out=sums[1:])
    return _mix((sums[last] - sums[first]) * back[first])


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    base = 0xD6E8FEB86659FD93
    both = []
    for factor in (base, pow(base, -1, 2**64)):
        steps = np.full(n, factor, dtype=np.uint64)
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    return both[0], both[1]


def anchor_table(docs: DataFrame) -> DataFrame:
    """(name, doc, at) of every high-level symbol of (doc, text)."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            texts = batch.column("text").to_pylist()
            for low, high in _portions(texts):
                codes, starts = _code_points(texts[low:high])
                names, at = recompress(codes, starts[:-1])
                owner = np.searchsorted(starts, at, side="right") - 1
                doc_end = starts[owner + 1]
                chosen = _anchors(names, at, doc_end)
                chosen = chosen[at[chosen] + KEY_CHARS <= doc_end[chosen]]
                last = np.searchsorted(at, at[chosen] + KEY_CHARS)
                keys = _sequence_names(names, chosen, last)
                own = owner[chosen]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(ids[low:high][own]), pa.array((at[chosen] - starts[own]).astype(np.int32))], names=["name", "doc", "at"]
                )

    return docs.select("doc", "text").mapInArrow(anchors, "name long, doc long, at int")


def _portions(texts: list[str], chars: int = 60_000) -> Iterator[tuple[int, int]]:
    """Slices of a list of texts of about ``chars`` characters each (one text at least)."""
    low = total = 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= chars:
            yield low, i + 1
            low, total = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and where each text begins (and the last one ends)."""
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, dtype=np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)


def _shared_names(anchors: DataFrame) -> DataFrame:
    """(name, doc, at, times): the symbols that several documents have, with their occurrences; one pass over the sorted names."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
        for batch in _then_none(batches):
            if batch is None:
                now = kept
            else:
                both = [np.concatenate([a, b.to_numpy()]) for a, b in zip(kept, batch.columns, strict=True)]
                other = np.flatnonzero(both[0] != both[0][-1]) if len(both[0]) else np.empty(0, np.int64)
                last = int(other[-1]) + 1 if len(other) else 0
                now, kept = [x[:last] for x in both], [x[last:] for x in both]
            name, doc, at = now
            if not len(name):
                continue
            start = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            length = np.diff(np.concatenate([start, [len(name)]]))
            fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])])
            docs = np.add.reduceat(fresh.astype(np.int64), start)
            many = np.repeat(docs > 1, length)
            if many.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[many]), pa.array(doc[many]), pa.array(at[many]), pa.array(np.repeat(length, length)[many])], names=["name", "doc", "at", "times"]
                )

    ordered = anchors.repartition(F.col("name")).sortWithinPartitions("name", "doc", "at")
    return ordered.mapInArrow(groups, "name long, doc long, at int, times long")


def _then_none(items: Iterator) -> Iterator:
    yield from items
    yield None


def _chains(shared: DataFrame) -> DataFrame:
    """(name, doc, first, last, times): symbols that always occur together become one.

    The pair of a symbol and the next one of its document, if they overlap or
    touch, is named by both and their distance. Where the pair has as many
    occurrences as its left and its right part, neither ever occurs without the
    other, so what is compared through one is compared through the pair.
    """
    following = "OVER (PARTITION BY doc ORDER BY at, name)"
    paired = shared.select("*", F.expr(f"lead(name) {following}").alias("_n"), F.expr(f"lead(at) {following}").alias("_a"), F.expr(f"lead(times) {following}").alias("_t"))
    near = (F.col("_a") - F.col("at") <= KEY_CHARS) & (F.col("_a") > F.col("at"))
    paired = materialise(paired.withColumn("_pair", F.when(near & (F.col("times") == F.col("_t")), F.xxhash64("name", "_n", F.col("_a") - F.col("at")))), "paired")
    counted = paired.where("_pair IS NOT NULL").groupBy("_pair").agg(F.count("*").alias("_k"), F.first("times").alias("_t"))
    tight = counted.where("_k = _t").select("_pair", F.lit(True).alias("_tight"))
    linked = paired.join(broadcast_if_small(tight), "_pair", "left")
    broken = F.expr("CASE WHEN lag(_tight) OVER (PARTITION BY doc ORDER BY at, name) THEN 0 ELSE 1 END")
    numbered = linked.select("name", "doc", "at", "times", broken.alias("_new"))
    numbered = numbered.withColumn("_chain", F.expr("sum(_new) OVER (PARTITION BY doc ORDER BY at, name)"))
    return numbered.groupBy("doc", "_chain").agg(F.min_by("name", "at").alias("name"), F.min("at").alias("first"), F.max("at").alias("last"), F.first("times").alias("times")).drop("_chain")


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-32-le", "surrogatepass"))


def _with_places(chains: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, text, places) of the documents that hold any of ``chains``."""
    places = chains.groupBy("doc").agg(F.collect_list(F.struct("name", "first", "last")).alias("places"))
    return docs.join(broadcast_if_small(places), "doc").select("doc", "text", "places")


def _with_context(cold: DataFrame, docs: DataFrame, min_chars: int) -> DataFrame:
    """Add what stands left and right of each symbol, as far as a repeat through it could need, and a digest of what is between."""
    reach = min_chars - KEY_CHARS

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, text, places in zip(frame["doc"], frame["text"], frame["places"], strict=True):
                for place in places:
                    first, last = place["first"], place["last"]
                    rows.append((place["name"], doc, first, last, _digest(text[first:last]), text[max(0, first - reach) : first], text[last : last + KEY_CHARS + reach]))
            yield pd.DataFrame(rows, columns=["name", "doc", "first", "last", "inner", "before", "after"])

    schema = "name long, doc long, first int, last int, inner binary, before string, after string"
    return _with_places(cold, docs).mapInPandas(cut, schema)


def _agree(a: str, b: str, from_end: bool = False) -> int:
    """Length of the common prefix (or suffix)."""
    n = min(len(a), len(b))
    if from_end:
        a, b = a[len(a) - n :][::-1], b[len(b) - n :][::-1]
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def _cold_repeats(rows: DataFrame, min_chars: int) -> DataFrame:
    """(doc_a, doc_b, start_a, end_a, start_b, end_b) of verified repeats through a symbol of few occurrences."""

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for frame in _then_none(frames):
            if frame is None:
                now = kept
            else:
                both = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
                going = both["name"] == both["name"].iloc[-1] if len(both) else []
                now, kept = (both[~going], both[going]) if len(both) else (None, both)
            if now is None or not len(now):
                continue
            out = []
            rows = list(zip(*(now[c] for c in ("name", "doc", "first", "last", "inner", "before", "after")), strict=True))
            for i, (name, doc_i, first_i, last_i, inner_i, before_i, after_i) in enumerate(rows):
                for other, doc_j, first_j, last_j, inner_j, before_j, after_j in rows[i + 1 :]:
                    if other != name:
                        break
                    if doc_i == doc_j or inner_i != inner_j:
                        continue
                    right = _agree(after_i, after_j)
                    left = _agree(before_i, before_j, True) if right >= KEY_CHARS else 0
                    if right >= KEY_CHARS and left + last_i - first_i + right >= min_chars:
                        a, b = (first_i - left, last_i + right), (first_j - left, last_j + right)
                        out.append((doc_i, doc_j, *a, *b) if doc_i < doc_j else (doc_j, doc_i, *b, *a))
            yield pd.DataFrame(out, columns=["doc_a", "doc_b", "start_a", "end_a", "start_b", "end_b"])

    ordered = rows.repartition(F.col("name")).sortWithinPartitions("name")
    return ordered.mapInPandas(verify, "doc_a long, doc_b long, start_a int, end_a int, start_b int, end_b int")


def _hot_windows(hot: DataFrame, docs: DataFrame, min_chars: int) -> DataFrame:
    """(window, doc, start, prev): every stretch of ``min_chars`` characters that holds a symbol of many occurrences.

    ``prev`` is the character before it, and -1 where the stretch one character
    to the left is not listed.
    """

    def spell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, text, places in zip(frame["doc"], frame["text"], frame["places"], strict=True):
                coded = text.encode("utf-32-le", "surrogatepass")
                listed: set[int] = set()
                for place in places:
                    listed.update(range(max(0, place["first"] + KEY_CHARS - min_chars), min(place["last"], len(text) - min_chars) + 1))
                for start in sorted(listed):
                    rows.append((xxhash.xxh3_128_digest(coded[4 * start : 4 * (start + min_chars)]), doc, start, ord(text[start - 1]) if start - 1 in listed else -1))
            yield pd.DataFrame(rows, columns=["window", "doc", "start", "prev"])

    return _with_places(hot, docs).mapInPandas(spell, "window binary, doc long, start int, prev int")


def _hot_pairs(windows: DataFrame) -> DataFrame:
    """Documents that share a window, met at the first of the windows they share in a row."""
    once = windows.groupBy("window", "doc").agg(F.when(F.count("*") == 1, F.first("prev")).otherwise(F.lit(-1)).alias("prev"))
    once = materialise(once, "once")
    ends = once.groupBy("window").agg(F.min("prev").alias("low"), F.max("prev").alias("high")).where("low = -1 OR low <> high").select("window")
    rows = once.join(broadcast_if_small(ends), "window", "left_semi")
    pairs = met(rows, "window", "doc", "doc < other_doc AND (prev <> other_prev OR prev = -1 OR other_prev = -1)", "prev")
    return pairs.select(F.col("doc").alias("doc_a"), F.col("other_doc").alias("doc_b")).distinct()


def equal_texts(documents: DataFrame, ident: str, text: str, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """(one document a class as (doc, text), members as (doc, member)); texts shorter than ``min_chars`` are left out."""
    long = documents.where((F.length(text) >= min_chars) & F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("member"), F.col(text).alias("text"))
    keyed = long.select("member", F.xxhash64("text").alias("_h"), F.xxhash64(F.reverse("text"), F.length("text")).alias("_g"))
    heads = keyed.groupBy("_h", "_g").agg(F.min("member").alias("doc"), F.count("*").alias("_n"))
    several = heads.where("_n > 1").select("_h", "_g", "doc")
    members = materialise(keyed.join(several, ["_h", "_g"]).select("doc", "member").distinct(), "members")
    extra = members.where("doc <> member").select("member")
    docs = long.join(broadcast_if_small(extra), "member", "left_anti").select(F.col("member").alias("doc"), "text")
    return docs, members


def class_repeats(docs: DataFrame, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(verified repeats through symbols of few occurrences, windows that hold the other ones) of documents of different text."""
    if min_chars < MIN_CHARS:
        raise ValueError(f"spans of less than {MIN_CHARS} characters need shorter names")
    shared = materialise(_shared_names(anchor_table(docs)), "shared")
    chains = materialise(_chains(shared), "chains")
    cold = _cold_repeats(_with_context(chains.where(F.col("times") <= COLD), docs, min_chars), min_chars)
    return cold, _hot_windows(chains.where(F.col("times") > COLD), docs, min_chars)


def representative_pairs(documents: DataFrame, ident: str, text: str, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """((doc_a, doc_b) between representatives of different text that share a span, (doc, member) of the classes of equal texts)."""
    docs, members = equal_texts(documents, ident, text, min_chars)
    cold, windows = class_repeats(docs, min_chars)
    return materialise(cold.select("doc_a", "doc_b").unionByName(_hot_pairs(windows)).distinct(), "pairs"), members


def repeated_pairs(documents: DataFrame, ident: str, text: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: all documents that share a span of at least ``min_chars`` characters, copies included."""
    pairs, members = representative_pairs(documents, ident, text, min_chars)
    inside = met(members, "doc", "member", "member < other_member").select(F.col("member").alias("doc_a"), F.col("other_member").alias("doc_b"))
    a = broadcast_if_small(members.select(F.col("doc").alias("doc_a"), F.col("member").alias("_a")))
    b = broadcast_if_small(members.select(F.col("doc").alias("doc_b"), F.col("member").alias("_b")))
    full = pairs.join(a, "doc_a", "left").join(b, "doc_b", "left").select(F.coalesce("_a", "doc_a").alias("x"), F.coalesce("_b", "doc_b").alias("y"))
    full = full.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
    return full.unionByName(inside).distinct()


def shared_spans(documents: DataFrame, ident: str, text: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, inicio, fin): the spans of each document that occur elsewhere, merged; of equal texts all is shared."""
    docs, members = equal_texts(documents, ident, text, min_chars)
    cold, windows = class_repeats(docs, min_chars)
    repeats = materialise(cold, "repeats")
    spans = repeats.select(F.col("doc_a").alias("doc"), F.col("start_a").alias("inicio"), F.col("end_a").alias("fin")).unionByName(
        repeats.select(F.col("doc_b").alias("doc"), F.col("start_b").alias("inicio"), F.col("end_b").alias("fin"))
    )
    windows = materialise(windows, "windows")
    several = windows.groupBy("window").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high").select("window")
    hot = windows.join(broadcast_if_small(several), "window", "left_semi").select("doc", F.col("start").alias("inicio"), (F.col("start") + min_chars).alias("fin"))
    whole = members.join(documents.select(F.col(ident).cast("long").alias("member"), F.length(text).alias("fin")), "member").select(F.col("member").alias("doc"), F.lit(0).alias("inicio"), "fin")
    spans = spans.unionByName(hot).distinct()
    # The spans of a representative are those of its copies; these share all of their text anyway.
    spans = spans.unionByName(whole).distinct()
    return spans.groupBy("doc").applyInPandas(_merge_spans, "doc long, inicio int, fin int")


def _merge_spans(frame: pd.DataFrame) -> pd.DataFrame:
    """Overlapping or touching spans of one document as one; their number is bounded by its length."""
    frame = frame.sort_values(["inicio", "fin"])
    reach = frame["fin"].cummax()
    group = (frame["inicio"] > reach.shift(fill_value=-1)).cumsum()
    return frame.assign(fin=reach).groupby(group).agg(doc=("doc", "first"), inicio=("inicio", "first"), fin=("fin", "last"))[["doc", "inicio", "fin"]]
