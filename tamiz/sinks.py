"""Sinks: JSON arrays and lines, flat CSV, Markdown, and an inventory of what was written."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a single-file sink takes from a DataFrame; reports are small by nature.
MAX_REPORT_ROWS = 1_000_000


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, distributed."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """One indented UTF-8 array in a single file, for reports; larger tables belong to :func:`write_json_lines`."""
    rows = df.limit(MAX_REPORT_ROWS + 1).toJSON().collect()
    if len(rows) > MAX_REPORT_ROWS:
        raise ValueError("too many rows for one file; write JSON lines")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps([json.loads(r) for r in rows], ensure_ascii=False, indent=2), encoding="utf-8")


def flattened(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, null as an empty one: what a CSV file can hold."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.coalesce(F.to_json(f.name) if isinstance(f.dataType, nested) else F.col(f.name).cast("string"), F.lit("")).alias(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    flattened(df).write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def corpus_rows(processed: DataFrame) -> DataFrame:
    """Token arrays of a processed corpus as text: 50 tokens by spaces, 30 terms by bars."""
    return processed.withColumn("tokens", F.array_join(F.slice("tokens", 1, 50), " ")).withColumn("terminos", F.array_join(F.slice("terminos", 1, 30), " | "))


def markdown_table(df: DataFrame, most: int = 1_000) -> str:
    """A Markdown table of the first rows, bars and line breaks escaped."""
    def cell(value: object) -> str:
        return ("" if value is None else str(value)).replace("|", "\\|").replace("\n", " ")

    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(x) for x in row) + " |" for row in df.limit(most).collect()]
    return "\n".join(lines)


def inventory(paths: list[str]) -> list[dict]:
    """Existence and size of each artefact, the size also in words."""
    out = []
    for path in paths:
        there = os.path.exists(path)
        size = sum(f.stat().st_size for f in Path(path).rglob("*") if f.is_file()) if there and os.path.isdir(path) else os.path.getsize(path) if there else 0
        words, n = "B", float(size)
        for unit in ("KB", "MB", "GB", "TB"):
            if n < 1024:
                break
            n, words = n / 1024, unit
        out.append({"ruta": path, "existe": there, "bytes": size, "tamano": f"{n:.1f} {words}"})
    return out
