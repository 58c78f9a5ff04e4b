from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamiz.llm.capping import rows_beyond_caps

SCHEMA = "pos long, q double, who string, other string, _id string, rows int"


def brute(rows, shares):
    gone = set()
    for column, share in shares.items():
        cap = max(1, int(Decimal(str(share)) * len(rows)))
        groups = {}
        for row in rows:
            if row[column] is not None:
                groups.setdefault(row[column], []).append(row)
        for group in groups.values():
            group.sort(key=lambda r: (-(r[1] if r[1] is not None and r[1] == r[1] else float("-inf")), r[0]))
            gone |= {r[0] for r in group[cap:]}
    return gone


def run(spark, rows, shares=((2, 0.3), (3, 0.2))):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    kinds = {name: (F.col(name), share) for name, (_, share) in zip(("who", "other"), shares, strict=True)}
    return {r.pos for r in rows_beyond_caps(df, "pos", "q", kinds).collect()}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, 0.1, 0.5, 0.9, float("nan")]), st.sampled_from([None, "a", "b", "c"]), st.sampled_from([None, "x", "y"])), max_size=40))
def test_against_brute_force(spark, cells):
    rows = [(i, *c) for i, c in enumerate(cells)]
    assert run(spark, rows) == brute(rows, {2: 0.3, 3: 0.2})


def test_hot_contributor_and_ties(spark, monkeypatch):
    monkeypatch.setattr("tamiz.llm.capping.SALT_ROWS", 7)
    rows = [(i, 0.5, "hot" if i % 3 else None, str(i)) for i in range(120)]
    assert run(spark, rows) == brute(rows, {2: 0.3, 3: 0.2})


def test_empty(spark):
    assert run(spark, []) == set()
