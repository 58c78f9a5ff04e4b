import random
from itertools import combinations

import numpy as np

from tamiz.llm.long_repeats import KEY_CHARS, _agree, _anchors, recompress, repeated_pairs, representative_pairs, shared_spans


def text(r, n):
    return "".join(r.choice("abcdefghij ñ😀") for _ in range(n))


def brute(docs, least):
    out = set()
    for (i, a), (j, b) in combinations(sorted(docs), 2):
        if a and b and i != j:
            windows = {a[p : p + least] for p in range(len(a) - least + 1)}
            if any(b[p : p + least] in windows for p in range(len(b) - least + 1)):
                out.add((i, j))
    return out


def corpus(seed):
    r = random.Random(seed)
    passages = [text(r, 300), text(r, 299), text(r, 800), "ab" * 200, "z" * 500]
    docs = []
    for i in range(60):
        parts = [text(r, r.randint(0, 120))]
        for p in r.sample(passages, r.randint(0, 2)):
            parts += [p, text(r, r.randint(0, 90))]
        docs.append((i, "".join(parts)))
    copy = text(r, 900)
    return docs + [(100 + i, copy) for i in range(5)] + [(200, "x" + copy), (201, None), (202, ""), (203, "corto")]


def test_pairs_against_brute_force(spark):
    docs = corpus(1)
    df = spark.createDataFrame([(*d, "z", 1) for d in docs], "doc_id long, text string, doc string, member int")
    assert {tuple(r) for r in repeated_pairs(df, "doc_id", "text").collect()} == brute(docs, 300)


def test_hot_names_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr("tamiz.llm.long_repeats.COLD", 3)
    r = random.Random(5)
    notice = text(r, 320)
    docs = [(i, text(r, 60) + notice[r.randint(0, 40) : 320 - r.randint(0, 40)] + text(r, 60)) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(x) for x in repeated_pairs(df, "doc_id", "text").collect()} == brute(docs, 300)


def test_binary_texts_against_brute_force(spark):
    # Every 300 characters that two texts of two letters have in common are found, wherever they stand.
    r = random.Random(11)
    docs = []
    for i in range(150):
        span = "".join(r.choice("01") for _ in range(r.choice([299, 300, 300, 301])))
        for k in range(2):
            docs.append((2 * i + k, "".join(r.choice("01") for _ in range(r.randint(0, 200))) + span + "".join(r.choice("01") for _ in range(r.randint(0, 200)))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(x) for x in repeated_pairs(df, "doc_id", "text").collect()} == brute(docs, 300)


def test_any_two_equal_substrings_have_an_anchor():
    r = random.Random(13)
    makers = [lambda: text(r, 300), lambda: "".join(r.choice("01") for _ in range(300)), lambda: ("ab" * 200)[:300], lambda: "z" * 300, lambda: ("0" * r.randint(1, 9) + "1") * 300, lambda: "".join(c * r.randint(1, 7) for c in text(r, 300))]
    for _ in range(200):
        inner = r.choice(makers)()[:300]
        held = []
        for _ in range(2):
            left, right = (r.choice(makers)()[: r.randint(0, 200)] for _ in range(2))
            codes = np.array([ord(c) for c in left + inner + right], dtype=np.uint32)
            names, at = recompress(codes, np.array([0]))
            chosen = _anchors(names, at, np.full(len(at), len(codes)))
            held.append({int(at[x]) - len(left) for x in chosen if 0 <= at[x] - len(left) <= 300 - KEY_CHARS})
        assert held[0] & held[1]


def test_one_notice_in_many_documents(spark):
    r = random.Random(17)
    notice = text(r, 330)
    docs = [(i, f"{i:05d}" * 3 + notice + f"{i:05d}" * 3) for i in range(10_000)] + [(20_000, text(r, 600))]
    spans = shared_spans(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    # The last or first digits around the notice are shared with others too.
    rows = spans.selectExpr("count(*) AS n", "count(DISTINCT doc) AS docs", "max(inicio) AS a", "min(fin) AS b").first()
    assert rows.n == rows.docs == 10_000 and rows.a <= 15 and rows.b >= 345
    few = docs[:700]
    pairs = repeated_pairs(spark.createDataFrame(few, "doc_id long, text string"), "doc_id", "text")
    assert pairs.count() == pairs.distinct().count() == 700 * 699 // 2


def test_representatives_and_members(spark):
    r = random.Random(19)
    one, other = text(r, 500), text(r, 400)
    docs = [(i, one) for i in range(4)] + [(10 + i, one + other) for i in range(3)] + [(20, other)]
    pairs, members = representative_pairs(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    assert {tuple(x) for x in pairs.collect()} == {(0, 10), (10, 20)}
    assert {tuple(x) for x in members.collect()} == {(0, i) for i in range(4)} | {(10, 10 + i) for i in range(3)}
    found = repeated_pairs(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    assert {tuple(x) for x in found.collect()} == brute(docs, 300)


def test_spans(spark):
    r = random.Random(2)
    shared = text(r, 700)
    docs = [(1, "a" * 10 + "Q" + shared + "R" + text(r, 50)), (2, text(r, 20) + "S" + shared), (3, text(r, 2000)), (4, "T" * 400), (5, "T" * 400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {tuple(x) for x in shared_spans(df, "doc_id", "text").collect()}
    assert got == {(1, 11, 711), (2, 21, 721), (4, 0, 400), (5, 0, 400)}


def test_equal_substrings_get_equal_symbols():
    r = random.Random(3)
    inner = text(r, 400)
    names = []
    for around in ("alfa", "otra cosa"):
        codes = np.array([ord(c) for c in around + inner + around[::-1]], dtype=np.uint32)
        name, at = recompress(codes, np.array([0]))
        names.append({(int(n), int(a) - len(around)) for n, a in zip(name, at, strict=True)})
    assert len(names[0] & names[1]) > 0.6 * len(names[0])


def test_agree_and_empty(spark):
    assert _agree("abcd", "abxd") == 2 and _agree("xbcd", "bcd", True) == 3 and _agree("", "a") == 0
    assert repeated_pairs(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
