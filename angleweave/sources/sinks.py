"""Sinks and resumable files: CSV, JSON lines, manifests, keyed upserts, the stored W grid, status rows, text reports.

Everything goes through Spark's writers or Hadoop's file system, so paths may be in any store that Spark reads.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header. Columns that it lacks are null, others are left out."""
    found = spark.read.option("header", "true").csv(path)
    wanted = spark.createDataFrame([], schema).schema
    return found.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in found.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])


def write_csv(df: DataFrame, path: str, by: str | None = None, digits: int | None = None) -> None:
    """CSV with a header, a folder for each value of `by`; doubles rounded to digits."""
    if digits is not None:
        df = df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    writer = df.write.mode("overwrite").option("header", "true")
    (writer.partitionBy(by) if by else writer).csv(path)


def append_results(df: DataFrame, path: str) -> None:
    """Adds finished rows to a folder of JSON lines."""
    df.write.mode("append").json(path)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def remaining(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """The rows whose keys the JSON lines do not have yet; all of them before the first write."""
    at, fs = _files(df.sparkSession, path)
    if not fs.exists(at):
        return df
    done = df.sparkSession.read.schema(df.select(*keys).schema).json(path).distinct()
    return df.join(done, keys, "left_anti")


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside its place and renames it; what was there is kept as .bak."""
    at, fs = _files(spark, path)
    new, old = at.suffix(".new"), at.suffix(".bak")
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(at):
        fs.delete(old, False)
        fs.rename(at, old)
    fs.rename(new, at)


#: Lists of a manifest.
MANIFEST_LISTS = ("ids", "done", "failed_404", "failed_other")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Organism and its lists without repeats, in their order; an absent list is empty."""
    found = spark.read.schema("organism string, " + ", ".join(f"{c} array<string>" for c in MANIFEST_LISTS)).option("multiLine", "true").json(path)
    return found.select("organism", *[F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))).alias(c) for c in MANIFEST_LISTS])


def write_manifest(spark: SparkSession, path: str, organism: str, **lists: list[str]) -> None:
    replace_text(spark, path, json.dumps({"organism": organism} | {c: [*dict.fromkeys(lists.get(c, []))] for c in MANIFEST_LISTS}))


def upsert(df: DataFrame, path: str, batch: int) -> None:
    """Adds a batch of rows; a batch that is written again replaces itself, so a retried batch counts once."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/__batch={batch}")


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The latest row of every key."""
    rows = spark.read.parquet(path)
    last = Window.partitionBy(*keys).orderBy(F.col("__batch").desc())
    return rows.withColumn("__place", F.row_number().over(last)).where("__place = 1").drop("__place", "__batch")


def compacted(spark: SparkSession, path: str, keys: list[str], to: str, batch: int = 0) -> None:
    """Writes the latest rows as one batch of a new table."""
    upsert(current(spark, path, keys), to, batch)


def stored_grid(spark: SparkSession, path: str, make, **parameters) -> DataFrame:
    """The W grid of these parameters: made once, read afterwards. make(**parameters) gives a frame of gi, gj, w."""
    name = hashlib.md5(json.dumps(parameters, sort_keys=True).encode()).hexdigest()
    at, fs = _files(spark, f"{path.rstrip('/')}/grid-{name}")
    if not fs.exists(at.suffix("/_SUCCESS")):
        make(**parameters).write.mode("overwrite").parquet(at.toString())
    return spark.read.parquet(at.toString())


def status(registry: DataFrame, proteins: DataFrame, failures: DataFrame) -> DataFrame:
    """Organism, total, done, failed, status, derived where the reference rows are updated in place. registry: organism, total."""
    done = proteins.groupBy("organism").agg(F.count(F.lit(1)).alias("done"))
    failed = failures.groupBy("organism").agg(F.count(F.lit(1)).alias("failed"))
    rows = registry.join(done, "organism", "left").join(failed, "organism", "left").fillna(0, ["done", "failed"])
    ended = F.col("done") + F.col("failed")
    return rows.withColumn("status", F.when(ended == 0, "pending").when(ended < F.col("total"), "running").otherwise("complete"))


def report(sections: dict[str, DataFrame], path: str, most: int = 1000) -> None:
    """A text file with a table for each section of at most `most` rows, and a line that says how many there are beyond."""
    parts, spark = [], next(iter(sections.values())).sparkSession
    for title, df in sections.items():
        rows = df.limit(most + 1).collect()
        cells = [df.columns, *[["" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x) for x in r] for r in rows[:most]]]
        wide = [max(len(r[k]) for r in cells) for k in range(len(df.columns))]
        lines = ["  ".join(c.rjust(w) for c, w in zip(r, wide)) for r in cells]
        parts.append("\n".join([title, "-" * len(title), *lines, *([f"more than {most} rows"] if len(rows) > most else [])]))
    replace_text(spark, path, "\n\n".join(parts) + "\n")


def latest_files(files: DataFrame) -> DataFrame:
    """uniprot_id, version, path of the newest file of every id, from names such as AF-<id>-F1-model_v<k>.cif(.gz). files: path."""
    pattern = r"AF-([A-Za-z0-9]+)-F1-model_v(\d+)\.cif(?:\.gz)?$"
    named = files.select("path", F.regexp_extract("path", pattern, 1).alias("uniprot_id"), F.regexp_extract("path", pattern, 2).try_cast("int").alias("version")).where("uniprot_id <> ''")
    return named.groupBy("uniprot_id").agg(F.max("version").alias("version"), F.max_by("path", F.struct("version", "path")).alias("path"))
