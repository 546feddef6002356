"""Chain-sequential operators: windows over (chain_id, pos), then one row per chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.angles import wrap
from ..functions.basins import basin
from .shared import chainwise


def order():
    """A chain in its sequence. Made on call, as a window needs a session."""
    return Window.partitionBy("chain_id").orderBy("pos")


ORGANISMS = ("ecoli", "human", "yeast", "arabidopsis", "malaria")


def event_angles() -> list:
    """The columns chain_id, organism, plddt, resname, phi, psi of a residue, from an event row alone."""
    k = F.get_json_object("props", "$.k").cast("double")
    names = F.array(*map(F.lit, ORGANISMS))
    return [
        F.col("user_id").alias("chain_id"),
        F.get(names, F.pmod(F.col("user_id"), F.lit(5)).cast("int")).alias("organism"),
        F.pmod(F.col("event_id") * 37, F.lit(101)).cast("double").alias("plddt"),
        F.col("event_type").alias("resname"),
        F.radians((F.col("value") * 29.0) % 360.0 - 180.0).alias("phi"),
        F.radians((k * 7.0) % 360.0 - 180.0).alias("psi"),
    ]


def bind_events(events: DataFrame) -> DataFrame:
    """residues(chain_id, organism, pos, plddt, resname, phi, psi) from the event table."""
    chain, organism, *rest = event_angles()
    return events.select(chain, organism, F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("pos"), *rest)


def stepped(res: DataFrame) -> DataFrame:
    """Adds dphi, dpsi (wrapped) and, where w is there, dw to the step from the residue before. One window for all."""
    out = res.withColumn("dphi", wrap(F.col("phi") - F.lag("phi").over(order()))).withColumn("dpsi", wrap(F.col("psi") - F.lag("psi").over(order())))
    return out.withColumn("dw", F.col("w") - F.lag("w").over(order())) if "w" in res.columns else out


def _turns(c: str):
    return F.coalesce(F.sum(c) / (2 * F.pi()), F.lit(0.0))


def _sums() -> list:
    return [
        F.count(F.lit(1)).alias("length"),
        F.coalesce(F.sum(F.abs("dw")), F.lit(0.0)).alias("bps"),
        F.avg(F.abs("dw")).alias("mean_dw"),
        F.avg(F.abs("dphi") + F.abs("dpsi")).alias("torus_l1"),
        F.avg(F.sqrt(F.col("dphi") * F.col("dphi") + F.col("dpsi") * F.col("dpsi"))).alias("torus_l2"),
        _turns("dphi").alias("q_phi"),
        _turns("dpsi").alias("q_psi"),
    ]


def _normalised(out: DataFrame) -> DataFrame:
    out = out.withColumn("bps_norm", F.col("bps") / F.col("length")).withColumn("q_mag", F.hypot("q_phi", "q_psi"))
    return out.withColumn("q_norm", F.col("q_mag") / F.sqrt("length"))


def roughness(steps: DataFrame) -> DataFrame:
    """N01-N05 by chain: BPS, BPS/L, mean |dW|, torus L1 and L2, winding numbers."""
    return _normalised(steps.groupBy("chain_id", "organism").agg(*_sums()))


def segments(res: DataFrame, label: str = "basin") -> DataFrame:
    """Runs of equal labels; seg, start, end (inclusive), length."""
    change = F.when(F.lag(label).over(order()) == F.col(label), 0).otherwise(1)
    marked = res.withColumn("__new", change).withColumn("seg", F.sum("__new").over(order().rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("chain_id", "seg", F.col(label).alias("label")).agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count(F.lit(1)).alias("length"))


def helix_sheet_transitions(res: DataFrame) -> DataFrame:
    """Changes between alpha and beta once all else is left out."""
    kept = res.where(F.col("basin").isin("alpha", "beta")).withColumn("changed", (F.lag("basin").over(order()) != F.col("basin")).cast("int"))
    return kept.groupBy("chain_id").agg(F.coalesce(F.sum("changed"), F.lit(0)).alias("n_transitions"))


def transition_counts(res: DataFrame, label: str = "basin") -> DataFrame:
    """Counts and row-normalised shares of steps between labels."""
    pairs = res.select(F.lag(label).over(order()).alias("source"), F.col(label).alias("target")).where("source is not null").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("source")))


def trigram_counts(res: DataFrame, label: str = "basin") -> DataFrame:
    """Order-2 counts."""
    return res.select(F.lag(label, 2).over(order()).alias("a"), F.lag(label).over(order()).alias("b"), F.col(label).alias("c")).where("a is not null").groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n"))


def successor_pairs(res: DataFrame) -> DataFrame:
    """N17."""
    return res.select("chain_id", "organism", "pos", "phi", "psi", F.lead("phi").over(order()).alias("next_phi"), F.lead("psi").over(order()).alias("next_psi")).where("next_phi is not null and next_psi is not null and phi is not null and psi is not null")


def kinks_simple(steps: DataFrame) -> DataFrame:
    """N06 without peak finding: steps above mean + 2 sd."""
    by = Window.partitionBy("chain_id")
    a = F.abs(F.col("dw"))
    return steps.withColumn("hi", F.avg(a).over(by) + 2 * F.stddev_pop(a).over(by)).groupBy("chain_id").agg(F.count_if(F.abs(F.col("dw")) > F.col("hi")).alias("n_kinks"))


def kinks(steps: DataFrame) -> DataFrame:
    """Chains of over 8 steps by peaks, others by mean + 2 sd."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        from angleweave.functions.peaks import peaks

        x = np.abs(pdf["dw"].dropna().to_numpy())
        n = peaks(x) if len(x) > 8 else int((x > x.mean() + 2 * x.std()).sum()) if len(x) else 0
        return pd.DataFrame({"chain_id": [pdf["chain_id"].iloc[0]], "n_kinks": [n]})

    return chainwise(steps.select("chain_id", "pos", "dw"), run, "chain_id bigint, n_kinks bigint")


def proteins(res: DataFrame, shape: DataFrame | None = None) -> DataFrame:
    """One row per chain for the report queries; res carries w. shape: chain_id, rg, contact_order from coordinates (kinematics.shape);
    without it they are bound to the id, as the version always is."""
    # One pass of windows and one aggregation: the basin before is the last major one among all earlier residues.
    steps = stepped(res.withColumn("basin", basin(F.col("phi"), F.col("psi"))))
    major = F.when(F.col("basin").isin("alpha", "beta"), F.col("basin"))
    before = F.last(major, ignorenulls=True).over(order().rowsBetween(Window.unboundedPreceding, -1))
    steps = steps.withColumn("changed", (major != before).cast("int"))
    share = lambda b: (100.0 * F.avg((F.col("basin") == b).cast("double")))
    more = [
        share("alpha").alias("pct_helix"), share("beta").alias("pct_sheet"), share("other").alias("pct_coil"), F.avg("plddt").alias("plddt_mean"), F.percentile("plddt", F.lit(0.5)).alias("plddt_median"),
        F.avg((F.col("plddt") < 50).cast("double")).alias("plddt_below50"), F.coalesce(F.sum("changed"), F.lit(0)).alias("n_transitions"),
    ]
    out = _normalised(steps.groupBy("chain_id", "organism").agg(*_sums(), *more))
    c = F.col("chain_id")
    if shape is not None:
        return out.join(shape, "chain_id", "left").withColumn("af_version", F.pmod(c, F.lit(2)) + 3)
    return out.withColumns({"rg": 2.2 * F.pow(F.col("length").cast("double"), F.lit(0.38)) * (1 + F.pmod(c, F.lit(7)) / 50), "contact_order": 0.05 + F.pmod(c, F.lit(13)) / 100, "af_version": F.pmod(c, F.lit(2)) + 3})
