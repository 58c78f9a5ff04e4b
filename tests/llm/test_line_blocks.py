import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamiz.llm.line_blocks import repeated_lines, without_lines


def fold(line):
    return re.sub(r"\s+", " ", re.sub(r"\d+", "0", line.lower())).strip()


def brute(rows, least):
    held = {}
    for pos, text, src in rows:
        for line in (text or "").split("\n"):
            if fold(line):
                held.setdefault((src, fold(line)), set()).add(pos)
    return {(pos, i) for pos, text, src in rows for i, line in enumerate((text or "").split("\n"), 1) if fold(line) and len(held[src, fold(line)]) >= least}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "pos long, body string, src string, ord int, sym string")


LINES = st.sampled_from(["Aviso 12", "  aviso   7 ", "", "único", "PIE", "pie", "A\tB", "a b"])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.lists(LINES, max_size=6).map("\n".join)), st.sampled_from(["s", "t", None])), max_size=14))
def test_against_brute_force(spark, cells):
    rows = [(i, *c) for i, c in enumerate(cells)]
    found, _ = repeated_lines(frame(spark, rows), "pos", "body", F.col("src"), min_docs=3)
    assert {tuple(r) for r in found.collect()} == brute(rows, 3)


def brute_blocks(rows, least):
    """{n_lines: sorted document counts} and the positions in blocks of two lines or more."""
    held = {}
    lines = {pos: [(i, fold(x)) for i, x in enumerate((text or "").split("\n"), 1) if fold(x)] for pos, text, _ in rows}
    for pos, _, src in rows:
        own = lines[pos]
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                held.setdefault((src, tuple(x for _, x in own[i:j])), set()).add(pos)
    often = {k: v for k, v in held.items() if len(v) >= least}
    sizes = {}
    for (_, block), docs in often.items():
        sizes.setdefault(len(block), []).append(len(docs))
    two = {(pos, own[k][0]) for pos, _, src in rows for own in [lines[pos]] for i in range(len(own) - 1) if (src, tuple(x for _, x in own[i : i + 2])) in often for k in (i, i + 1)}
    return {k: sorted(v) for k, v in sizes.items()}, two


def test_blocks_of_any_length_against_brute_force(spark):
    r = random.Random(7)
    notice = [f"aviso {'abcdefghij'[i % 10]}{'klmnop'[i // 10]}" for i in range(45)]
    rows = []
    for i in range(24):
        start = r.randint(0, 10)
        own = [f"propio {chr(97 + i)}{chr(97 + k)}" for k in range(3)]
        rows.append((i, "\n".join([*own[:2], *notice[start : r.randint(20, 45)], "Publicidad", own[2], "Publicidad", "PIE", "", "fin"]), r.choice(["s", None])))
    # The suffixes of a block lie in many partitions and batches.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for least in (3, 8):
            _, blocks = repeated_lines(frame(spark, rows).repartition(5), "pos", "body", F.col("src"), min_docs=least)
            got = {}
            for b in blocks.collect():
                got.setdefault(b.n_lines, []).append(b.docs)
            sizes, two = brute_blocks(rows, least)
            assert {k: sorted(v) for k, v in got.items()} == sizes and max(sizes) > 16
            found, _ = repeated_lines(frame(spark, rows), "pos", "body", F.col("src"), min_docs=least, min_lines=2)
            assert {tuple(x) for x in found.collect()} == two
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # A single line that recurs everywhere is no block of two lines: only the common prefixes tell.
    alone = [(i, f"uno {chr(97 + i)}\nPublicidad\ndos {chr(97 + i)}", "s") for i in range(9)]
    assert repeated_lines(frame(spark, alone), "pos", "body", F.col("src"), 3, 2)[0].count() == 0
    assert repeated_lines(frame(spark, alone), "pos", "body", F.col("src"), 3)[0].count() == 9


def test_blocks_and_removal(spark):
    rows = [(i, f"texto {chr(97 + i)}\nuno\ndos {i}\ntres\nfin {chr(110 + i)}", "s") for i in range(4)] + [(9, None, "s"), (10, "", None), (11, "x " * 200_000, "s")]
    df = frame(spark, rows)
    found, blocks = repeated_lines(df, "pos", "body", F.col("src"), min_docs=4)
    assert {(r.n_lines, r.docs) for r in blocks.collect()} == {(1, 4), (2, 4), (3, 4)}
    clean = {r.pos: r.body for r in without_lines(df, "pos", "body", found).collect()}
    assert clean[0] == "texto a\nfin n" and clean[9] is None and clean[10] == "" and len(clean) == len(rows)
    assert without_lines(df, "pos", "body", found).columns == df.columns


def test_empty(spark):
    found, blocks = repeated_lines(frame(spark, [(1, "a", "s")]).limit(0), "pos", "body", F.col("src"))
    assert found.count() == blocks.count() == 0
