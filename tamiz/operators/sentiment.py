"""Sentiment by word lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.functions import lexicons
from tamiz.functions.text import WORD, let


def _array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def lexicon_score(text: Column, positive: list[str] = lexicons.POSITIVE, negative: list[str] = lexicons.NEGATIVE) -> Column:
    """(good - bad) / (good + bad) over the distinct words of a text, 0 without any."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)))
    good, bad = F.size(F.array_intersect(tokens, _array(positive))), F.size(F.array_intersect(tokens, _array(negative)))
    return F.when(good + bad > 0, (good - bad) / (good + bad)).otherwise(0.0)


def occurrence_score(text: Column, positive: list[str] = lexicons.THREAD_POSITIVE, negative: list[str] = lexicons.THREAD_NEGATIVE) -> Column:
    """The same over all occurrences, rounded to four places."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))

    def occurrences(found: Column, listed: list[str]) -> Column:
        # The few listed words of a text are found by hash; only they are then counted.
        return let(F.array_intersect(found, _array(listed)), lambda few: F.when(F.size(few) > 0, F.size(F.filter(found, lambda t: F.array_contains(few, t)))).otherwise(0))

    both = let(tokens, lambda found: F.struct(occurrences(found, positive).alias("good"), occurrences(found, negative).alias("bad")))
    return let(both, lambda x: F.when(x["good"] + x["bad"] > 0, F.round((x["good"] - x["bad"]) / (x["good"] + x["bad"]), 4)).otherwise(0.0))


def label(score: Column) -> Column:
    """``positivo`` from 0.05, ``negativo`` to -0.05, ``neutral`` between."""
    return F.when(score >= 0.05, "positivo").when(score <= -0.05, "negativo").otherwise("neutral")


def tone(score: Column, middle: str = "neutral") -> Column:
    """Tone of an average: the bounds themselves are in the middle."""
    return F.when(score > 0.05, "positivo").when(score < -0.05, "negativo").otherwise(middle)


def corpus_tone(scored: DataFrame, score: str = "compound", tag: str = "etiqueta") -> DataFrame:
    """One row: counts of each label, mean score, tone of the mean, and the most frequent label (ties by label)."""
    return scored.agg(
        F.count_if(F.col(tag) == "positivo").alias("positivos"),
        F.count_if(F.col(tag) == "negativo").alias("negativos"),
        F.count_if(F.col(tag) == "neutral").alias("neutrales"),
        F.coalesce(F.avg(score), F.lit(0.0)).alias("promedio"),
        F.mode(tag, True).alias("dominante"),
    ).withColumn("tono", tone(F.col("promedio")))
