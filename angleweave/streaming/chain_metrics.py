"""Chain metrics of a stream (X07): keyed state per chain, an event-time watermark, and timers that emit and drop the state.

Residues of a chain may come in any order and over many batches. They are kept until the watermark has passed the chain's last
residue by `gap`; then the chain's roughness (N01-N05) and transitions (N07) are emitted once and its state is dropped.
A row behind the watermark is late: Spark drops it and counts it in numRowsDroppedByWatermark. A row of a chain that was emitted already, but not
behind the watermark, opens a new run of the chain, which is emitted as a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

RESIDUE = "at bigint, tie bigint, phi double, psi double, w double, basin string"
METRICS = "chain_id bigint, organism string, first_at timestamp, length bigint, bps double, bps_norm double, mean_dw double, torus_l1 double, torus_l2 double, q_phi double, q_psi double, n_transitions bigint"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def metrics(rows) -> dict:
    """One chain's row from its residues (at, tie, phi, psi, w, basin) in any order, as chains.roughness and chains.helix_sheet_transitions give it."""
    import numpy as np

    rows = rows.sort_values(["at", "tie"])
    turn = lambda c: np.arctan2(np.sin(x := np.diff(rows[c].to_numpy(np.float64))), np.cos(x))
    dphi, dpsi, dw = turn("phi"), turn("psi"), np.abs(np.diff(rows["w"].to_numpy(np.float64)))
    mean = lambda x: float(np.nanmean(x)) if np.isfinite(x).any() else None
    major = rows["basin"][rows["basin"].isin(["alpha", "beta"])].to_numpy()
    bps = float(np.nansum(dw))
    return {
        "length": len(rows), "bps": bps, "bps_norm": bps / len(rows), "mean_dw": mean(dw), "torus_l1": mean(np.abs(dphi) + np.abs(dpsi)), "torus_l2": mean(np.hypot(dphi, dpsi)),
        "q_phi": float(np.nansum(dphi) / (2 * np.pi)), "q_psi": float(np.nansum(dpsi) / (2 * np.pi)), "n_transitions": int((major[1:] != major[:-1]).sum()),
    }


class ChainProcessor(StatefulProcessor):
    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.residues = handle.getListState("residues", RESIDUE)
        self.chain = handle.getValueState("chain", "organism string, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        last, organism = None, None
        for frame in rows:
            at = frame["at"]
            last = int(at.max()) if last is None else max(last, int(at.max()))
            organism = organism or frame["organism"].iloc[0]
            self.residues.appendList([tuple(r) for r in frame[["at", "tie", "phi", "psi", "w", "basin"]].astype(object).itertuples(index=False)])
        if last is None:
            return iter(())
        timer = last // 1000 + self.gap_ms
        known = self.chain.get() if self.chain.exists() else None
        if known is None or timer > known[1]:
            if known is not None:
                self.handle.deleteTimer(known[1])
            self.handle.registerTimer(timer)
            self.chain.update((known[0] if known else organism, timer))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        rows = pd.DataFrame([tuple(r) for r in self.residues.get()], columns=["at", "tie", "phi", "psi", "w", "basin"])
        organism = self.chain.get()[0]
        self.residues.clear()
        self.chain.clear()
        found = metrics(rows)
        yield pd.DataFrame([{"chain_id": key[0], "organism": organism, "first_at": pd.Timestamp(int(rows["at"].min()), unit="us"), **found}])

    def close(self) -> None:
        pass


def chain_stream(residues: DataFrame, delay: str = "10 minutes", gap_seconds: int = 1800) -> DataFrame:
    """A stream of METRICS from a stream of chain_id, organism, ts, tie, phi, psi, w, basin. Residues of a chain stand in the order of ts and tie.

    Needs the RocksDB state store: run it by run_until_now, or set PROVIDER to ROCKS before the stream starts.
    """
    rows = residues.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).select("chain_id", "organism", "ts", F.unix_micros("ts").alias("at"), F.col("tie").cast("bigint").alias("tie"), "phi", "psi", "w", "basin")
    return rows.groupBy("chain_id").transformWithStateInPandas(ChainProcessor(gap_seconds * 1000), METRICS, "Append", "EventTime")


def run_until_now(stream: DataFrame, path: str, checkpoint: str) -> dict:
    """Processes all that is there, appends to Parquet files exactly once, and ends; the last progress as a dict. A later call on the same checkpoint goes on."""
    spark = stream.sparkSession
    was = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if was is None else spark.conf.set(PROVIDER, was)
    progress = [p for p in query.recentProgress]
    return {"batches": len(progress), "late": sum(int(s.numRowsDroppedByWatermark) for p in progress for s in p.stateOperators), "kept": int(progress[-1].stateOperators[0].numRowsTotal) if progress and progress[-1].stateOperators else 0}


def event_stream(spark: SparkSession, path: str, schema, files_at_once: int | None = None) -> DataFrame:
    """New Parquet files of event rows as a stream; path may be a glob."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(path)
