"""Watching sources with Structured Streaming: new files once, and running summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import sinks


def new_rows(spark: SparkSession, path: str, schema, files_at_once: int = 100) -> DataFrame:
    """Unseen Parquet files of a folder; the checkpoint remembers which were seen."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def upsert(target: str):
    """A foreachBatch sink that adds each batch's rows once, however often the batch is told; earlier rows are not written again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        sinks.upsert(batch, target, batch_id)

    return write


def latest(spark: SparkSession, target: str, keys: list[str], order: str) -> DataFrame:
    """Of every key the row that is last by `order`, the later batch of equal ones."""
    rows = spark.read.parquet(target)
    by = Window.partitionBy(*keys).orderBy(F.col(order).desc(), F.col("__batch").desc())
    return rows.withColumn("__rank", F.row_number().over(by)).where("__rank = 1").drop("__rank", "__batch")


def unseen(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Stream-static or batch anti-join against what was done or failed."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def running_summary(rows: DataFrame, group: str = "organism", value: str = "bps_norm") -> DataFrame:
    """Regenerated in update or complete mode whenever counts change."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
