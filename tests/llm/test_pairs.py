from itertools import combinations

from tamiz.llm.pairs import met


def test_blocks_give_every_pair_once(spark):
    rows = [("hot", i) for i in range(60)] + [("cold", i) for i in range(3)] + [("one", 1), (None, 1), (None, 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "k string, v long, extra string")
    for block in (4, 100):
        got = sorted((r.v, r.other_v) for r in met(df, "k", "v", "v < other_v", block=block).collect())
        assert got == sorted([*combinations(range(60), 2), *combinations(range(3), 2)])
    assert met(df.limit(0), "k", "v", "v < other_v").count() == 0
