"""Watching a folder of structure files (X01, X05): what arrives is read when complete, computed once, and told done or failed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import potential
from ..functions.basins import basin
from ..operators import chains, kinematics
from ..sources import reader, sinks

#: The name of a predicted structure's file and its parts; residues that a chain has at least.
NAME = r"AF-([A-Za-z0-9]+)-F\d+-model_v(\d+)\.cif(?:\.gz)?$"
LEAST_RESIDUES = 3


def computed(files: DataFrame, sign: int = -1) -> DataFrame:
    """uniprot_id, version, path, error, the chain's metrics where error is null, and processed_at (P18). files: uniprot_id, version, path, text."""
    spark = files.sparkSession
    rows = reader.residues_of(files, chain="merged", seqId="label").withColumn("chain_id", F.col("path")).withColumn("pos", F.col("resnum")).withColumn("organism", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    res = kinematics.angles(rows, sign).where("phi is not null and psi is not null")
    res = potential.with_nearest(res, potential.grid_table(spark, potential.build())).withColumn("basin", basin(F.col("phi"), F.col("psi")))
    rough = chains.roughness(chains.stepped(res)).join(chains.helix_sheet_transitions(res), "chain_id", "left").withColumnRenamed("chain_id", "path")
    size = rows.groupBy("path").agg(F.count(F.lit(1)).alias("residues"))
    out = files.select("uniprot_id", "version", "path").join(size, "path", "left").join(rough, "path", "left")
    error = F.when(F.col("residues").isNull(), "no backbone").when(F.col("residues") < LEAST_RESIDUES, "too few residues")
    return out.select("uniprot_id", "version", "path", error.alias("error"), "organism", "residues", "length", "bps", "bps_norm", F.coalesce("n_transitions", F.lit(0)).alias("n_transitions"), F.current_timestamp().alias("processed_at"))


def _told(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    """Ids of earlier batches; the batch itself may be told again after a failure."""
    at, fs = sinks._files(spark, path)
    if not fs.exists(at) or not any(s.getPath().getName().startswith("__batch=") for s in fs.listStatus(at)):
        return None
    return spark.read.parquet(path).where(F.col("__batch") != batch).select("uniprot_id")


def processed(target: str, compute: Callable[[DataFrame], DataFrame] = computed):
    """A foreachBatch sink: of the files that are neither done nor failed, the newest version of an id is computed and told in target/done or target/failed."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        named = batch.select(F.regexp_extract("path", NAME, 1).alias("uniprot_id"), F.regexp_extract("path", NAME, 2).try_cast("int").alias("version"), "path", "text").where("uniprot_id <> ''")
        for told in (_told(spark, f"{target}/{kind}", number) for kind in ("done", "failed")):
            if told is not None:
                named = named.join(told.distinct(), "uniprot_id", "left_anti")
        last = Window.partitionBy("uniprot_id").orderBy(F.col("version").desc(), F.col("path").desc())
        found = compute(named.withColumn("k", F.row_number().over(last)).where("k = 1").drop("k")).persist()
        try:
            sinks.upsert(found.where("error is null").drop("error"), f"{target}/done", number)
            sinks.upsert(found.where("error is not null").select("uniprot_id", "version", "path", "error"), f"{target}/failed", number)
        finally:
            found.unpersist()

    return write


def watch(spark: SparkSession, folder: str, target: str, checkpoint: str, min_age: float = 3.0, every: str | None = None, compute: Callable[[DataFrame], DataFrame] = computed):
    """Starts the watch: over and over at intervals of `every`, or once over all that is complete now."""
    reader.register(spark)
    files = spark.readStream.format("arriving_files").option("minAge", min_age).load(folder)
    stream = files.writeStream.foreachBatch(processed(target, compute)).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()
