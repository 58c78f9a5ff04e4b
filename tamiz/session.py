"""Session helpers: shared storage for cut lineage and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN_DIR: str | None = None

#: Rows and bytes up to which the side of a join may be broadcast; both are counted first.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: Bytes of input up to which :func:`spread` moves rows.
SPREAD_BYTES = 1 << 30


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tamiz")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where it is set.

    Only where the session names none and runs on this machine alone a temporary
    folder of our own is made, and removed when Python ends. A cluster without
    the setting is refused: its executors would write to disks of their own.
    """
    global _OWN_DIR
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _OWN_DIR is None:
        _OWN_DIR = tempfile.mkdtemp(prefix="tamiz-shared-")
        atexit.register(shutil.rmtree, _OWN_DIR, True)
    return _OWN_DIR


def _own_folder(spark: SparkSession) -> str:
    """The part of the shared folder that this application writes to, removed when its driver ends."""
    path = f"{shared_dir(spark)}/tamiz-{spark.sparkContext.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(folder):
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    return path


def release(spark: SparkSession) -> None:
    """Delete all tables that this application has materialised; frames that read them can't be used any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table survives the loss of executors and cuts the lineage, so
    an iterative plan stays short and an expensive stage is computed once.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: 8 for plain values, the length of strings, the text of anything nested."""
    size = F.lit(0)
    for field in df.schema.fields:
        column = F.col(f"`{field.name.replace('`', '``')}`")
        if isinstance(field.dataType, T.StringType | T.BinaryType):
            size = size + F.coalesce(F.octet_length(column), F.lit(0)) + 16
        elif isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType):
            size = size + F.coalesce(F.length(F.to_json(F.struct(column))), F.lit(0))
        else:
            size = size + 8
    return size


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most so many rows and bytes; reads no more than ``rows`` + 1 rows."""
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(_row_bytes(df)), F.lit(0)).alias("b")).first()
    return found["n"] <= rows and found["b"] <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast after counting its rows and bytes; a larger one is left to a shuffle join."""
    return F.broadcast(df) if is_small(df, rows, size) else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files make fewer partitions than there are.

    Only an input of at most ``SPREAD_BYTES`` is moved; anything larger, as on a
    cluster, stays as it was read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    held = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(held)) <= SPREAD_BYTES else df
