"""Place texts, measured in tokens, into containers of fixed capacity (minimum bin slack).

Lengths are whole numbers up to the capacity, so the corpus enters the search
as a histogram of at most ``capacity`` classes, however many texts there are.
For each container the longest length left is set, and a subset-sum over the
available lengths, held as a bitset in one integer, finds the fullest feasible
combination; it is taken as often as its lengths last, so that a search uses up
a class of lengths. The combinations are then dealt to the texts by their rank
within their length, ranks being counted over salted ranges of each length.

A text is split only if it alone exceeds the capacity: into full containers and
one remainder. Defined results: null and empty texts have no tokens and need no
container; texts without identifier are left out; equal texts are placed one by one; ties go by identifier.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamiz.session import materialise

CAPACITY = 2_048
#: Vocabulary of a public tokenizer, as ranks of base64 pieces; must be there on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenizer of that vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that one salted range should hold.
SALT_ROWS = 50_000
MAX_SALTS = 2_048


@functools.lru_cache(maxsize=2)
def _encoder(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, ident: str, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(ident, tokens) of every text; 0 for null and empty ones."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(vocabulary, pattern)
        for frame in frames:
            sizes = [len(encoder.encode_ordinary(x)) if x else 0 for x in frame[text]]
            yield pd.DataFrame({ident: frame[ident], "tokens": np.array(sizes, dtype=np.int64)})

    return df.where(F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias(ident), text).mapInPandas(count, f"{ident} long, tokens long")


def fullest(room: int, counts: dict[int, int]) -> list[tuple[int, int]]:
    """Lengths and how often each: the combination that fills ``room`` best, long ones first.

    Bit i of the set says that i tokens can be reached; a length that occurs
    several times enters in powers of two. The search ends when ``room`` itself
    is reached.
    """
    reach, mask = 1, (1 << (room + 1)) - 1
    trail: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left:
            take = min(step, left)
            before, reach = reach, (reach | reach << (length * take)) & mask
            if reach != before:
                trail.append((length, take, before))
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(trail):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return sorted(chosen.items(), reverse=True)


def minimum_bin_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """(combination, containers filled so) for all lengths of the histogram (length -> texts), each in 1..capacity."""
    counts = {length: n for length, n in histogram.items() if n}
    out = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        rest = {length: n for length, n in counts.items() if n} if not counts[longest] else counts
        combination = dict(fullest(capacity - longest, rest))
        counts[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        times = min(counts[length] // k for length, k in combination.items())
        for length, k in combination.items():
            counts[length] -= k * times
            if not counts[length]:
                del counts[length]
        out.append((sorted(combination.items(), reverse=True), times))
    return out


def pieces(sizes: DataFrame, ident: str, capacity: int = CAPACITY) -> DataFrame:
    """(ident, pieza, tokens): one piece a text, or as many full ones as it exceeds the capacity by and a remainder."""
    full, rest = F.floor((F.col("tokens") - 1) / capacity), (F.col("tokens") - 1) % capacity + 1
    each = F.transform(F.sequence(F.lit(0).cast("long"), full), lambda i: F.struct(i.alias("pieza"), F.when(i < full, F.lit(capacity)).otherwise(rest).cast("long").alias("tokens")))
    return sizes.where("tokens > 0").select(ident, F.explode(each).alias("_p")).select(ident, F.col("_p.pieza").alias("pieza"), F.col("_p.tokens").alias("tokens"))


def pack(df: DataFrame, ident: str, text: str, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(ident, pieza, tokens, contenedor): the container of every piece of every text."""
    parts = materialise(pieces(token_counts(df, ident, text, vocabulary), ident, capacity), "pieces")
    salts = max(1, min(MAX_SALTS, -(-parts.count() // SALT_ROWS)))
    salted = parts.repartitionByRange(salts, "tokens", ident, "pieza").withColumn("_salt", F.spark_partition_id())
    salted = materialise(salted, "salted")
    # At most capacity + salts rows, as the salts are ranges of the lengths.
    held = salted.groupBy("tokens", "_salt").count().collect()
    histogram: dict[int, int] = {}
    offsets: dict[tuple[int, int], int] = {}
    for row in sorted(held, key=lambda r: (r["tokens"], r["_salt"])):
        offsets[row["tokens"], row["_salt"]] = histogram.get(row["tokens"], 0)
        histogram[row["tokens"]] = histogram.get(row["tokens"], 0) + row["count"]

    #: length -> (first rank, texts a container, first container) of each combination it is in
    dealt: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    container = 0
    for combination, times in minimum_bin_slack(histogram, capacity):
        for length, k in combination:
            dealt.setdefault(length, []).append((used.get(length, 0), k, container))
            used[length] = used.get(length, 0) + k * times
        container += times
    tables = {length: tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) for length, rows in dealt.items()}
    shared = df.sparkSession.sparkContext.broadcast((tables, offsets))

    @F.pandas_udf("long")
    def place(length: pd.Series, salt: pd.Series, rank: pd.Series) -> pd.Series:
        tables, offsets = shared.value
        out = np.empty(len(length), dtype=np.int64)
        sizes, salts = length.to_numpy(), salt.to_numpy()
        for size in np.unique(sizes):
            own = sizes == size
            ranks = rank.to_numpy()[own] - 1 + np.array([offsets[size, s] for s in salts[own]], dtype=np.int64)
            first, k, base = tables[size]
            row = np.searchsorted(first, ranks, side="right") - 1
            out[own] = base[row] + (ranks - first[row]) // k[row]
        return pd.Series(out)

    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("tokens", "_salt").orderBy(ident, "pieza")))
    return ranked.select(ident, "pieza", "tokens", place("tokens", "_salt", "_rank").alias("contenedor"))


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(contenedor, piezas, tokens, libre): how full each container is."""
    return packed.groupBy("contenedor").agg(F.count("*").alias("piezas"), F.sum("tokens").alias("tokens"), (F.lit(capacity) - F.sum("tokens")).alias("libre"))
