"""Decomposition of a chain's roughness by null models (M14): three, four or five levels over repeated trials."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import potential
from . import nulls
from .chains import segments
from .shared import kept

#: Null models by level; each takes residues and a number of trials.
MODELS: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    "segment": nulls.basin_pools,
    "within_segment": nulls.segment_shuffled,
    "markov1": lambda res, trials: nulls.markov(res, trials, 1),
    "markov2": lambda res, trials: nulls.markov(res, trials, 2),
    "shuffled": nulls.shuffled,
}
THREE, FOUR, FIVE = ("segment", "shuffled"), ("segment", "markov1", "shuffled"), ("segment", "markov1", "markov2", "shuffled")


def _bps(rows: DataFrame, grid: DataFrame, *by: str) -> DataFrame:
    """BPS/L of every chain, over its defined residues."""
    scored = potential.with_bilinear(rows.where("phi is not null and psi is not null"), grid)
    step = F.abs(F.col("w") - F.lag("w").over(Window.partitionBy("chain_id", *by).orderBy("pos")))
    return scored.withColumn("step", step).groupBy("chain_id", *by).agg((F.coalesce(F.sum("step"), F.lit(0.0)) / F.count(F.lit(1))).alias("bps_norm"))


def decomposed(res: DataFrame, grid: DataFrame, models: tuple[str, ...] = FIVE, trials: int = 10, least: int = 50) -> DataFrame:
    """chain_id, organism, n_residues, n_segments, mean_segment, alpha, beta, other (shares), real, and the mean over the trials of each
    model, for chains of `least` defined residues or more. res carries basin."""
    whole = res.where("phi is not null and psi is not null")
    share = lambda b: F.avg((F.col("basin") == b).cast("double")).alias(b)
    size = whole.groupBy("chain_id", "organism").agg(F.count(F.lit(1)).alias("n_residues"), *map(share, ("alpha", "beta", "other"))).where(F.col("n_residues") >= least)
    size = kept(size, "levels")
    whole = kept(whole.join(size.select("chain_id"), "chain_id"), "levels")
    runs = segments(whole).groupBy("chain_id").agg(F.count(F.lit(1)).alias("n_segments"), F.avg("length").alias("mean_segment"))
    out = size.join(runs, "chain_id").join(_bps(whole, grid).withColumnRenamed("bps_norm", "real"), "chain_id")
    for name in models:
        each = _bps(MODELS[name](whole, trials), grid, "trial").groupBy("chain_id").agg(F.avg("bps_norm").alias(name))
        out = out.join(kept(each, "level"), "chain_id")
    return out


def shares(levels: DataFrame, models: tuple[str, ...] = FIVE) -> DataFrame:
    """One row: chains, the mean of every level, and of the distance from shuffled to real the percentage that each model explains."""
    means = levels.agg(F.count(F.lit(1)).alias("chains"), *[F.avg(c).alias(c) for c in ("real", *models)])
    whole = F.nullif(F.col("shuffled") - F.col("real"), F.lit(0.0))
    return means.select("*", *[(100 * (F.col("shuffled") - F.col(m)) / whole).alias(f"{m}_pct") for m in models if m != "shuffled"])
