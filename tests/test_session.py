import pytest
from pyspark.sql import functions as F

from tamiz import session


class _Elsewhere:
    class conf:
        @staticmethod
        def get(name, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(_Elsewhere)


def test_rows_and_bytes_decide_on_a_broadcast(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("text"), F.array("id").alias("a b"))
    assert session.is_small(df)
    assert not session.is_small(df, rows=99)
    assert not session.is_small(df, size=100_000)


def test_materialised_tables_are_kept_until_released(spark):
    from tamiz.operators.alerts import matches

    table = session.materialise(spark.range(5).selectExpr("id", "cast(null as string) AS x"), "t")
    assert table.count() == 5 and table.schema["x"].dataType.simpleString() == "string"
    session.release(spark)
    with pytest.raises(Exception):  # noqa: B017
        table.collect()
    assert session.materialise(spark.range(3)).count() == 3
    assert matches  # the core goes on working


def test_saved_queries_in_blocks(spark, monkeypatch):
    from tamiz.operators import alerts

    articles = spark.createDataFrame([(i, f"u{i}", f"titulo {i}", "la casa") for i in range(6)], "pos long, url string, titulo string, cuerpo string")
    saved = spark.createDataFrame([(f"q{i}", f"titulo {i}") for i in range(5)] + [("todas", "casa")], "nombre string, expresion string")
    whole = {tuple(r) for r in alerts.matches(articles, saved).collect()}
    monkeypatch.setattr(alerts, "BLOCK_QUERIES", 2)
    assert {tuple(r) for r in alerts.matches(articles, saved).collect()} == whole and len(whole) >= 11
