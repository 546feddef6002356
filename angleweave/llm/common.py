"""Helpers that every operator of this folder shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space (fixed by contract).
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of one Arrow batch; a longer row has a batch of its own.
ARROW_ROWS = 256
ARROW_BYTES = 32 << 20

#: Spark's setting by which an execution's shuffle files are removed when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: A side of a join is broadcast only when it was counted and has at most this many rows.
BROADCAST_ROWS = 100_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="angleweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cleanup(spark: SparkSession) -> None:
    """Removes the intermediate tables of all operators; to be called when no result is to be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/angleweave")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/angleweave/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage and survives lost executors. The write's shuffle files go when it ends."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    was = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, was)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch, so that a batch of very long texts fits in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a side whose counted rows are few; without it Spark shuffles, and AQE splits skewed keys."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def utf8(column) -> list[bytes]:
    """An Arrow string column as bytes, nulls as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
