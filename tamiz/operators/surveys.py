"""Questionnaires: answers as maps of items, problems as lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def register(answers: DataFrame, fresh: DataFrame, items: int) -> DataFrame:
    """Answers with new ones (participante, respuestas, problemas); a participant's new answers replace the old, incomplete ones are refused."""
    if not fresh.where(F.coalesce(F.size("respuestas"), F.lit(0)) < items).isEmpty():
        raise ValueError(f"a questionnaire needs {items} answers")
    last = fresh.dropDuplicates(["participante"])
    return answers.join(last.select("participante"), "participante", "left_anti").unionByName(last)


def averages(answers: DataFrame) -> DataFrame:
    """(item, media): mean of each item, two places."""
    return answers.select(F.explode("respuestas").alias("item", "valor")).groupBy("item").agg(F.round(F.avg("valor"), 2).alias("media"))


def anonymised(answers: DataFrame) -> DataFrame:
    """Answers under numbered codes, in order of participant."""
    number = F.row_number().over(Window.orderBy("participante"))
    return answers.select(F.concat(F.lit("P"), F.lpad(number.cast("string"), 2, "0")).alias("codigo"), "respuestas", "problemas")


def problems(answers: DataFrame) -> DataFrame:
    """(problema, n): how often each problem was named."""
    return answers.select(F.explode("problemas").alias("problema")).groupBy("problema").agg(F.count("*").alias("n"))
