"""Retrieval measures of rankings (consulta, modelo, rango, doc_id) against judgments (consulta, doc_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamiz.operators.ranking import ranked
from tamiz.session import broadcast_if_small


def measures(rankings: DataFrame, judgments: DataFrame, k: int | None = None, keys: tuple[str, ...] = ("consulta", "modelo")) -> DataFrame:
    """(keys, precision, recall, f1, p_at_k, ap) of every ranking.

    Set measures count distinct documents; average precision is taken rank by
    rank, so that a document returned twice counts twice. ``k`` defaults to
    min(5, max(returned, relevant, 1)) of each ranking. Nothing relevant or
    nothing returned gives 0.
    """
    relevant = judgments.select("consulta", "doc_id").distinct()
    sizes = relevant.groupBy("consulta").agg(F.count("*").alias("_rel"))
    returned = rankings.groupBy(*keys).agg(F.countDistinct("doc_id").alias("_docs"), F.max("rango").alias("_n"))
    # Only the hits are ranked once more: the place of a hit among the hits is how many were found up to it.
    hits = ranked(rankings.join(relevant, ["consulta", "doc_id"]), list(keys), [F.asc("rango"), F.asc("doc_id")], "_found")
    limit = F.lit(k) if k is not None else F.least(F.lit(5), F.greatest("_n", F.coalesce("_rel", F.lit(0)), F.lit(1)))
    sized = returned.join(broadcast_if_small(sizes), "consulta", "left").withColumn("_k", limit)
    names = {c: f"_key_{c}" for c in keys}
    ends = broadcast_if_small(sized.select(*[F.col(c).alias(n) for c, n in names.items()], "_k"))
    found = hits.join(ends, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]).groupBy(*keys).agg(
        F.countDistinct("doc_id").alias("_hits"), F.count_if(F.col("rango") <= F.col("_k")).alias("_first"), F.sum(F.col("_found") / F.col("rango")).alias("_sum")
    )
    joined = sized.join(found, list(keys), "left")
    out = joined.select(
        *keys,
        F.coalesce(F.try_divide("_hits", "_docs"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("_hits", "_rel"), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide("_first", "_k"), F.lit(0.0)).alias("p_at_k"),
        F.coalesce(F.try_divide("_sum", "_rel"), F.lit(0.0)).alias("ap"),
    )
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumn("f1", f1)


def macro(measured: DataFrame, model: str = "modelo") -> DataFrame:
    """Mean of every measure over the queries of each model; the mean of ``ap`` is the MAP."""
    return measured.groupBy(model).agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1", "p_at_k")), F.avg("ap").alias("map"))


def winners(averages: DataFrame, first: str, second: str) -> DataFrame:
    """(medida, ganador): ``second`` wins a measure only if strictly greater."""
    rows = averages.where(F.col("modelo").isin(first, second))
    long = rows.select("modelo", F.expr("stack(3, 'precision', precision, 'f1', f1, 'map', map) AS (medida, valor)"))
    pair = long.groupBy("medida").agg(F.max(F.when(F.col("modelo") == first, F.col("valor"))).alias("_a"), F.max(F.when(F.col("modelo") == second, F.col("valor"))).alias("_b"))
    return pair.select("medida", F.when(F.col("_b") > F.col("_a"), F.lit(second)).otherwise(F.lit(first)).alias("ganador"))


def conclusion(averages: DataFrame, first: str = "booleano", second: str = "vectorial") -> DataFrame:
    """(conclusion): one sentence on the mean F1 of two models; less than 0.05 apart they count as alike."""
    one = averages.agg(*(F.max(F.when(F.col("modelo") == m, F.col("f1"))).alias(n) for m, n in ((first, "_a"), (second, "_b"))))
    a, b = F.format_string("%.3f", "_a"), F.format_string("%.3f", "_b")
    wins = F.col("_b") > F.col("_a")
    # The texts of the conclusion.
    alike = F.concat(F.lit("Ambos modelos tienen rendimiento similar (F1 Booleano="), a, F.lit(", Vectorial="), b, F.lit("). El modelo vectorial es preferible por su ranking graduado."))
    apart = F.concat(
        F.lit("El modelo "), F.when(wins, second).otherwise(first), F.lit(" supera al rival en F1 promedio (Booleano="), a, F.lit(", Vectorial="), b, F.lit("). "),
        F.when(wins, "El modelo vectorial captura similitud semantica parcial.").otherwise("El modelo booleano ofrece mayor exactitud en este corpus."),
    )
    return one.select(F.when(F.abs(F.col("_b") - F.col("_a")) < 0.05, alike).otherwise(apart).alias("conclusion"))


def generated_queries(docs: DataFrame, terms: str, category: str = "categoria", most: int = 5, n: int = 3) -> DataFrame:
    """(categoria, documentos, consulta): the most frequent terms of more than three letters of the largest categories.

    Ties by name; documents without a category are left aside.
    """
    known = docs.where((F.col(category) != "") & (F.col(category) != "sin_categoria"))
    largest = known.groupBy(category).agg(F.count("*").alias("documentos")).orderBy(F.desc("documentos"), category).limit(most)
    tokens = known.join(F.broadcast(largest), category).select(category, "documentos", F.explode(terms).alias("_t")).where("length(_t) > 3")
    counted = tokens.groupBy(category, "documentos", "_t").agg(F.count("*").alias("_n"))
    ranked = counted.withColumn("_r", F.row_number().over(Window.partitionBy(category).orderBy(F.desc("_n"), "_t"))).where(F.col("_r") <= n)
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_t"))), lambda x: x["_t"]), " ")
    return ranked.groupBy(F.col(category).alias("categoria"), "documentos").agg(words.alias("consulta"))
