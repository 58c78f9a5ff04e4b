"""Lines and blocks of lines that recur across the documents of one source.

Lines are reduced to identifiers (letter case, amount of white space and digits
do not matter). The suffixes of each document's line identifiers, up to the end
of the document, form the suffix array of a source; it is built and kept as a
distributed table, never as one array per source:

1. *sorted suffixes* - every suffix, its first ``DEPTH`` lines packed into a binary
   key, is range-partitioned and sorted by (source, key, document): the order
   of a suffix array, in which a hot source or a hot first line is spread over
   many partitions;
2. *common prefixes* - the lengths of the prefixes that neighbours share cut each
   partition into runs for every number of lines; a run with suffixes of at
   least ``min_docs`` documents is a repeated block. Runs inside a partition are
   counted there; of those that touch its border the documents themselves go
   on, and are counted as distinct pairs over all partitions;
3. *longer blocks* - suffixes whose whole key is a repeated block and that go on
   are sorted again by what follows it, until none is left: blocks of any
   number of lines come out.

Blocks that span at least ``min_docs`` documents are deleted from each document:
all lines of repeated blocks of ``min_lines`` lines or more.

Defined results: null and empty texts and records without identifier hold no lines; blank lines are numbered
but never repeated content, nor do they interrupt a block; a null source forms one source of its own; a line
repeated inside one document counts once; ties need no order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamiz.session import broadcast_if_small, materialise

MIN_DOCS = 10
#: Lines of a suffix that are sorted at once: in the first pass, and in those over longer blocks.
DEPTH, FURTHER = 4, 16
#: Suffixes of one sorted partition.
SUFFIXES_PER_PARTITION = 250_000

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def line_identifiers(df: DataFrame, ident: str, text: str, source: Column) -> DataFrame:
    """(doc, src, ids): number and identifier of each document's non-blank lines, in order."""
    # The whole text is folded once; the pieces then only need the trimmed white space, as no fold crosses a line break.
    folded = F.regexp_replace(F.regexp_replace(F.lower(F.col(text)), r"\p{Nd}+", "0"), r"[\s\p{Z}&&[^\n]]+", " ")
    lines = F.split(folded, "\n", -1)
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).cast("int").alias("linea"), F.trim(x).alias("x")))
    ids = F.transform(F.filter(numbered, lambda p: F.length(p.x) > 0), lambda p: F.struct(p.linea.alias("linea"), F.xxhash64(p.x).alias("key")))
    return df.where((F.length(text) > 0) & F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("doc"), F.xxhash64(source).alias("src"), ids.alias("ids"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _longer(name: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Name of a block that is one line longer; the name of no line is the source."""
    return _mix(name * _M3 + line.view(np.uint64))


class _Lines:
    """The lines of a batch of documents as flat arrays."""

    def __init__(self, batch: pa.RecordBatch):
        ids = batch.column("ids")
        flat = ids.flatten()
        offsets = ids.offsets.to_numpy().astype(np.int64) - ids.offsets[0].as_py()
        lengths = np.diff(offsets)
        self.n = int(lengths.sum())
        self.row = np.repeat(np.arange(len(lengths)), lengths)
        self.doc = batch.column("doc").to_numpy()[self.row]
        self.src = batch.column("src").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[self.row]
        self.linea = flat.field("linea").to_numpy(zero_copy_only=False)
        self.key = flat.field("key").to_numpy(zero_copy_only=False).astype(np.int64)
        # Lines from each one to the end of its document.
        self.left = np.repeat(offsets[1:], lengths) - np.arange(self.n)

    def names(self, lines: int) -> np.ndarray:
        """Name of the block of so many lines that begins at each line; only those with enough lines ``left`` count."""
        name = self.src.copy()
        for h in range(min(lines, self.n)):
            name[: self.n - h] = _longer(name[: self.n - h], self.key[h:])
        return name


def _suffixes(docs: DataFrame, skip: int, depth: int) -> DataFrame:
    """(src, key, doc): of every suffix of more than ``skip`` lines the name of those and the next ``depth`` lines, packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = _Lines(batch)
            at = np.flatnonzero(lines.left > skip)
            matrix = np.zeros((len(at), depth), dtype=">i8")
            for h in range(depth):
                on = lines.left[at] > skip + h
                matrix[on, h] = lines.key[at[on] + skip + h]
            offsets = (np.arange(len(at) + 1, dtype=np.int64) * depth * 8).astype(np.int32)
            key = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(matrix.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(lines.names(skip)[at].view(np.int64)), key, pa.array(lines.doc[at])], names=["src", "key", "doc"])

    return docs.select("doc", "src", "ids").mapInArrow(pack, "src long, key binary, doc long")


_RUNS = T.StructType([T.StructField("name", T.LongType()), T.StructField("n_lines", T.IntegerType()), T.StructField("docs", T.LongType()), T.StructField("doc", T.LongType())])


def _common_prefixes(skip: int, depth: int, min_docs: int):
    """Runs of sorted suffixes that share skip + 1 .. skip + depth lines.

    ``docs`` is the number of documents of a run inside the partition; of a run at its border each document comes as ``doc``.
    """

    def rows(name: np.ndarray, lines: int, docs: np.ndarray | None, doc: np.ndarray | None) -> pa.RecordBatch:
        n = len(name)
        empty = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(name.view(np.int64)), pa.array(np.full(n, lines, np.int32)), empty if docs is None else pa.array(docs), empty if doc is None else pa.array(doc)],
            names=["name", "n_lines", "docs", "doc"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A partition is a range of the sorted suffixes of bounded size: its runs are found at once.
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        n = table.num_rows
        src, doc = (table.column(c).to_numpy() for c in ("src", "doc"))
        keys = np.concatenate([np.frombuffer(b.column("key").buffers()[2], dtype=">i8", count=(b.column("key").offset + b.num_rows) * depth)[b.column("key").offset * depth :] for b in held]).astype(np.int64).reshape(n, depth)
        known, dense = np.unique(doc, return_inverse=True)
        # The prefix that a suffix shares with the one before it, in lines.
        same = (keys[1:] == keys[:-1]) & (keys[1:] != 0) & (src[1:] == src[:-1])[:, None]
        lcp = np.concatenate([[0], np.cumprod(same, axis=1, dtype=np.int8).sum(axis=1)])
        name = src.view(np.uint64).copy()
        for h in range(1, depth + 1):
            name = _longer(name, keys[:, h - 1])
            head = np.flatnonzero(lcp < h)
            length = np.diff(np.concatenate([head, [n]]))
            border = np.zeros(len(head), dtype=bool)
            border[[0, -1]] = True
            wanted = (keys[head, h - 1] != 0) & (border | (length >= min_docs))
            member = np.repeat(wanted, length)
            pairs = np.unique(np.repeat(np.arange(len(head)), length)[member] * len(known) + dense[member])
            run = pairs // len(known)
            docs = np.bincount(run, minlength=len(head))
            inside = wanted & ~border & (docs >= min_docs)
            yield rows(name[head[inside]], skip + h, docs[inside].astype(np.int64), None)
            at_border = border[run]
            yield rows(name[head[run[at_border]]], skip + h, None, known[pairs[at_border] % len(known)])

    return scan


def repeated_blocks(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(name, n_lines, docs): all blocks of lines in at least ``min_docs`` documents of a source."""
    found, skip, depth, several = None, 0, DEPTH, None
    lines = docs.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lines // SUFFIXES_PER_PARTITION))
    while True:
        suffixes = _suffixes(docs, skip, depth)
        if several is not None:
            suffixes = suffixes.join(broadcast_if_small(several), "src", "left_semi")
        ordered = suffixes.repartitionByRange(parts, "src", "key", "doc").sortWithinPartitions("src", "key", "doc")
        runs = materialise(ordered.mapInArrow(_common_prefixes(skip, depth, min_docs), _RUNS), "runs")
        border = runs.where("doc IS NOT NULL").select("name", "n_lines", "doc").distinct().groupBy("name", "n_lines").agg(F.count("*").alias("docs"))
        blocks = materialise(runs.where("docs IS NOT NULL").select("name", "n_lines", "docs").unionByName(border.where(F.col("docs") >= min_docs)), "blocks")
        found = blocks if found is None else found.unionByName(blocks)
        skip += depth
        depth = FURTHER
        several = blocks.where(F.col("n_lines") == skip).select(F.col("name").alias("src"))
        if several.isEmpty():
            return found


def _block_lines(docs: DataFrame, lines: int) -> DataFrame:
    """(doc, linea, name): the lines of every block of so many lines, with the block's name."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = _Lines(batch)
            at = np.flatnonzero(held.left >= lines)
            name = held.names(lines)[at]
            for h in range(lines):
                yield pa.RecordBatch.from_arrays([pa.array(held.doc[at]), pa.array(held.linea[at + h]), pa.array(name.view(np.int64))], names=["doc", "linea", "name"])

    return docs.select("doc", "src", "ids").mapInArrow(spell, "doc long, linea int, name long")


def repeated_lines(df: DataFrame, ident: str, text: str, source: Column, min_docs: int = MIN_DOCS, min_lines: int = 1) -> tuple[DataFrame, DataFrame]:
    """((ident, linea) of the lines in repeated blocks of ``min_lines`` lines or more, all repeated blocks)."""
    docs = materialise(line_identifiers(df, ident, text, source), "lines")
    blocks = repeated_blocks(docs, min_docs)
    # A longer block consists of blocks of ``min_lines`` lines, which are as frequent.
    least = broadcast_if_small(blocks.where(F.col("n_lines") == min_lines).select("name"))
    return _block_lines(docs, min_lines).join(least, "name", "left_semi").select(F.col("doc").alias(ident), "linea").distinct(), blocks


def without_lines(df: DataFrame, ident: str, text: str, found: DataFrame) -> DataFrame:
    """``df`` with the lines in ``found`` removed from ``text``; a null text stays null, an emptied one is empty."""
    gone = found.groupBy(F.col(ident).alias("_gone_id")).agg(F.collect_set("linea").alias("_gone"))
    kept = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains("_gone", (i + 1).cast("int"))), "\n")
    joined = df.join(gone, df[ident] == gone["_gone_id"], "left")
    return joined.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept)).drop("_gone", "_gone_id")
