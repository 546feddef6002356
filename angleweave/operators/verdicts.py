"""Verdicts on summaries (C14), outcomes of processing (C15), and gaps by class (T22). All limits are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_RESIDUES = 30


def _graded(*steps: tuple[Column, str], rest: str) -> Column:
    out = F.lit(rest)
    for test, name in reversed(steps):
        out = F.when(test, name).otherwise(out)
    return out


def shuffled(p: Column, effect: Column) -> Column:
    """Real chains against shuffled ones: p-value and Cohen's d."""
    return _graded(((p < 0.001) & (F.abs(effect) > 0.5), "PASS"), ((p < 0.05) & (F.abs(effect) > 0.2), "MARGINAL"), rest="FAIL")


def variants(most_cv: Column) -> Column:
    """The largest coefficient of variation (percent) over the potential's variants; null fails."""
    return _graded((most_cv <= 4, "PASS"), (most_cv <= 6, "MARGINAL"), rest="FAIL")


def fold_classes(most_cv: Column, mean_cv: Column) -> Column:
    """The largest and the mean coefficient of variation over the fold classes of 20 proteins or more."""
    return _graded((most_cv.isNull(), "INCONCLUSIVE"), (most_cv <= 5, "PASS"), (mean_cv <= 5, "MARGINAL"), rest="FAIL")


def composition(glycine: Column, proline: Column) -> Column:
    """Spread of the mean over the composition quartiles; a null spread counts as none."""
    most = F.greatest(F.coalesce(glycine, F.lit(0.0)), F.coalesce(proline, F.lit(0.0)))
    return _graded((most < 0.02, "PASS"), (most < 0.04, "MARGINAL"), rest="NOTABLE")


def derivation(error: Column) -> Column:
    """Percent by which a derived mean misses the observed one."""
    return _graded((error.isNull(), "INCONCLUSIVE"), (error <= 5, "PASS"), (error <= 15, "MARGINAL"), rest="FAIL")


def markov(real_mean: Column, model_mean: Column, real_cv: Column, model_cv: Column) -> Column:
    """Does the model give the mean within 5 percent, and the variation (percent) within 2 points?"""
    mean = (real_mean > 0) & (F.abs(real_mean - model_mean) / F.nullif(real_mean, F.lit(0.0)) * 100 < 5)
    return _graded((mean & (F.abs(real_cv - model_cv) < 2), "PASS"), (mean, "PARTIAL"), rest="FAIL")


def stability(ari: Column) -> Column:
    """The mean adjusted Rand index over pairs of subsamples."""
    return _graded((ari > 0.8, "EXCELLENT"), (ari > 0.6, "GOOD"), (ari > 0.4, "MODERATE"), rest="POOR")


def outcome(residues: Column, length: Column, bps: Column, least: int = LEAST_RESIDUES) -> Column:
    """Null where a chain is fine, else parse or short, in this precedence: nothing read; too few residues; no finite value; too short."""
    return F.when(residues.isNull(), "parse").when(residues < least, "short").when(bps.isNull() | F.isnan(bps) | (F.abs(bps) == float("inf")), "parse").when(length < least, "short")


def split(chains: DataFrame, least: int = LEAST_RESIDUES) -> tuple[DataFrame, DataFrame]:
    """The chains that are fine, and the others with their error_type. chains: residues, length, bps and more."""
    told = chains.withColumn("error_type", outcome(F.col("residues"), F.col("length"), F.col("bps"), least))
    return told.where("error_type is null").drop("error_type"), told.where("error_type is not null")


def complete(df: DataFrame, columns: tuple[str, ...] = ("bps_norm", "plddt_mean", "rg", "contact_order"), least_plddt: float = 0.0, least_length: int = 0) -> DataFrame:
    """Complete cases over nullable columns, of a mean pLDDT and a length at least."""
    return df.dropna(subset=list(columns)).where((F.col("plddt_mean") >= least_plddt) & (F.col("length") >= least_length))


def class_gaps(chains: DataFrame) -> DataFrame:
    """By class, n, both means, the gap of the means and the mean gap of the chains (percent of the real value), and their correlation. chains: class, real, model."""
    gap = lambda a, b: 100 * (b - a) / F.nullif(a, F.lit(0.0))
    return chains.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), F.avg("real").alias("real_mean"), F.avg("model").alias("model_mean"), gap(F.avg("real"), F.avg("model")).alias("agg_gap"), F.avg(gap(F.col("real"), F.col("model"))).alias("chain_gap"), F.corr("real", "model").alias("r"),
    )


def overall_gap(gaps: DataFrame) -> DataFrame:
    """The classes' gaps, weighted by their chains."""
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum(F.when(F.col(c).isNotNull(), F.col("n")))
    return gaps.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes"), mean("agg_gap").alias("agg_gap"), mean("chain_gap").alias("chain_gap"))
