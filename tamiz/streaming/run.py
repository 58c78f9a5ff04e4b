"""Run a stream over what is there now and read its result back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tamiz.session import shared_dir


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the parquet file or folder at ``path``, with its own schema."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def run_available(stream: DataFrame) -> DataFrame:
    """Process all available input with a checkpoint in the shared folder; the rows of the sink.

    The sink is a parquet table in append mode, written exactly once for each batch.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/tamiz-stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    writer.format("parquet").option("path", f"{base}/rows").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
