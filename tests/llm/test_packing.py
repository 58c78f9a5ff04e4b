from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamiz.llm.packing import VOCABULARY, containers, fullest, minimum_bin_slack, pack


@given(st.integers(1, 40), st.lists(st.integers(1, 40), max_size=8))
@settings(max_examples=200, deadline=None)
def test_fullest_against_brute_force(room, lengths):
    best = max(sum(c) for k in range(len(lengths) + 1) for c in combinations(lengths, k) if sum(c) <= room)
    chosen = fullest(room, Counter(lengths))
    assert sum(length * k for length, k in chosen) == best
    assert all(k <= lengths.count(length) for length, k in chosen)


@given(st.dictionaries(st.integers(1, 50), st.integers(0, 30), max_size=20))
@settings(max_examples=100, deadline=None)
def test_all_lengths_are_placed_once(histogram):
    placed = Counter()
    for combination, times in minimum_bin_slack(histogram, 50):
        assert sum(length * k for length, k in combination) <= 50
        for length, k in combination:
            placed[length] += k * times
    assert placed == Counter({length: n for length, n in histogram.items() if n})


@pytest.fixture
def vocabulary(tmp_path):
    try:
        open(VOCABULARY).close()
    except OSError:
        pytest.skip("no public vocabulary here")
    return VOCABULARY


def test_frame(spark, vocabulary, monkeypatch):
    monkeypatch.setattr("tamiz.llm.packing.SALT_ROWS", 20)
    docs = [(i, "palabra " * (i % 40)) for i in range(120)] + [(500, "a b c " * 2000), (501, None), (502, ""), (None, "x")]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, tokens string")
    rows = pack(df, "doc_id", "text", capacity=100, vocabulary=vocabulary).collect()
    held = Counter()
    for r in rows:
        held[r.contenedor] += r.tokens
    assert max(held.values()) <= 100 and len({(r.doc_id, r.pieza) for r in rows}) == len(rows)
    full = [r for r in rows if r.doc_id == 500]
    assert sorted(r.pieza for r in full) == list(range(len(full))) and all(r.tokens == 100 for r in full[:-1] if r.pieza < len(full) - 1)
    assert {r.doc_id for r in rows} == {i for i, t in docs if i is not None and t}
    assert len(held) <= sum(held.values()) / 100 + 2
    assert {r.libre for r in containers(pack(df.limit(0), "doc_id", "text", vocabulary=vocabulary)).collect()} == set()
