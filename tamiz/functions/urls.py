"""URL and host expressions, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host of ``url`` without scheme, user, port, path and ``www.``; null for null or blank."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, r"^(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1)
    return F.when(F.length(host) > 0, host)


def source_host(fuente: Column, url: Column) -> Column:
    """The source of a record: the host in ``fuente``, or the host of ``url`` where ``fuente`` is null or blank."""
    return F.coalesce(host_of(fuente), host_of(url))
