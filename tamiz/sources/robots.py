"""Whether a crawl may read a URL, by the robots files held in a table."""

from __future__ import annotations

from functools import lru_cache
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.functions.urls import host_of
from tamiz.session import broadcast_if_small


@lru_cache(maxsize=10_000)
def _rules(text: str) -> RobotFileParser:
    rules = RobotFileParser()
    rules.parse(text.splitlines())
    return rules


def with_permission(urls: DataFrame, robots: DataFrame, url: str = "url", agent: str = "*") -> DataFrame:
    """Add ``permitida``: by the robots file (host, texto) of the URL's host. A file that could not be read allows nothing."""

    @F.pandas_udf("boolean")
    def allowed(addresses: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([isinstance(t, str) and isinstance(a, str) and _rules(t).can_fetch(agent, a) for a, t in zip(addresses, texts, strict=True)], dtype=bool)

    files = robots.select(F.col("host").alias("_host"), F.col("texto").alias("_robots")).dropDuplicates(["_host"])
    joined = urls.withColumn("_host", host_of(F.col(url))).join(broadcast_if_small(files), "_host", "left")
    return joined.withColumn("permitida", allowed(F.col(url), F.col("_robots"))).drop("_host", "_robots")
