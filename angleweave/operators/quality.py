"""Sign of the angles, sanity limits, experimental methods, and the two-level null model of a chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import potential
from ..functions.angles import grid_index
from . import nulls

#: Degrees between which helices lie, and the share of residues that a vote needs there.
HELIX = (-100.0, -20.0)
LEAST_SHARE = 0.15


def sign_vote(raw: DataFrame, files: int = 10) -> DataFrame:
    """One row: n, plus, minus (residues of the first chains that lie among helices as they are, and negated), sign, share, clear (twice as many
    as the other sign has), decided. raw: chain_id, phi."""
    chosen = raw.select("chain_id").distinct().orderBy("chain_id").limit(files)
    phi = F.degrees("phi")
    within = lambda a: (a > HELIX[0]) & (a < HELIX[1])
    votes = raw.where("phi is not null").join(F.broadcast(chosen), "chain_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(within(phi)).alias("plus"), F.count_if(within(-phi)).alias("minus"))
    most, least = F.greatest("plus", "minus"), F.least("plus", "minus")
    votes = votes.withColumn("sign", F.when(F.col("plus") >= F.col("minus"), 1).otherwise(-1)).withColumn("share", F.when(F.col("n") > 0, most / F.col("n")).otherwise(0.0))
    return votes.withColumn("clear", most >= 2 * least).withColumn("decided", F.col("share") > LEAST_SHARE)


def signed(raw: DataFrame, files: int = 10) -> DataFrame:
    """Both angles by the voted sign; an undecided vote is an error."""
    vote = sign_vote(raw, files).select(F.when(F.col("decided"), F.col("sign")).otherwise(F.raise_error(F.lit("the sign of phi is undecided")).cast("int")).alias("__sign"))
    return raw.crossJoin(F.broadcast(vote)).withColumns({c: F.col(c) * F.col("__sign") for c in ("phi", "psi")}).drop("__sign")


def sane(proteins: DataFrame) -> DataFrame:
    """Values out of their limits become null; rows whose shares do not sum to 99 to 101 go. The limits are fixed values."""
    keep = lambda c, ok: F.when(ok, F.col(c)).alias(c)
    limits = {
        "plddt_mean": F.col("plddt_mean").between(0, 100),
        "rg": (F.col("rg") > 0) & (F.col("rg") <= 500),
        "contact_order": (F.col("contact_order") > 0) & (F.col("contact_order") <= 1),
    }
    rows = proteins.select(*[keep(c, limits[c]) if c in limits else F.col(c) for c in proteins.columns])
    total = F.col("pct_helix") + F.col("pct_sheet") + F.col("pct_coil")
    return rows.where((total > 99) & (total < 101))


def method_class(method: Column) -> Column:
    """C13."""
    m = F.upper(F.coalesce(method, F.lit("")))
    return F.when(m.contains("X-RAY"), "xray").when(m.contains("ELECTRON MICROSCOPY") | m.contains("CRYO"), "em").when(m.contains("NMR"), "nmr").otherwise("other")


def experimental(chains: DataFrame, least: int = 50) -> DataFrame:
    """X-ray and microscopy chains of least residues or more. chains: method, length."""
    return chains.where(method_class(F.col("method")).isin("xray", "em") & (F.col("length") >= least))


def is_nmr(lines: DataFrame) -> DataFrame:
    """Path, models, nmr: a file of two MODEL records or more. lines: path, value."""
    return lines.groupBy("path").agg(F.count_if(F.col("value").startswith("MODEL ")).alias("models")).withColumn("nmr", F.col("models") >= 2)


def mean_b_factor(atoms: DataFrame) -> DataFrame:
    """The mean over all ATOM rows of a file, whatever their chain."""
    return atoms.where("grp = 'ATOM'").groupBy("path").agg(F.avg("b").alias("mean_b"))


def _per_residue(rows: DataFrame, grid: DataFrame, by: list[str]) -> DataFrame:
    step = F.abs(F.col("w") - F.lag("w").over(Window.partitionBy(*by).orderBy("pos")))
    return potential.with_nearest(rows, grid).select(*by, step.alias("step")).groupBy(*by).agg((F.coalesce(F.sum("step"), F.lit(0.0)) / F.count(F.lit(1))).alias("rough"))


def two_level(res: DataFrame, grid: DataFrame, trials: int = 10) -> DataFrame:
    """chain_id, real, markov (pairs of the chain's own basin pools), shuffled: roughness a residue, the null ones averaged over trials.
    Chains of fewer than three residues have 0 for both. res carries basin and no w."""
    real = _per_residue(res, grid, ["chain_id"]).select("chain_id", F.col("rough").alias("real"))
    size = res.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n"))
    out = real.join(size, "chain_id")
    for name, model in (("markov", nulls.basin_pools), ("shuffled", nulls.shuffled)):
        drawn = model(res, trials).select("chain_id", "trial", "pos", "phi", "psi")
        mean = _per_residue(drawn, grid, ["chain_id", "trial"]).groupBy("chain_id").agg(F.avg("rough").alias(name))
        out = out.join(mean, "chain_id", "left").withColumn(name, F.when(F.col("n") < 3, 0.0).otherwise(F.col(name)))
    return out.select("chain_id", "real", "markov", "shuffled")


def composition_quartiles(res: DataFrame, rough: DataFrame, name: str, least: int = 10) -> DataFrame:
    """Name, quartile, n, mean, sd of chains by their percentage of a residue; limits by linear interpolation, a limit belongs below.
    rough: chain_id, bps_norm."""
    share = res.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n"), (100.0 * F.count_if(F.col("resname") == name) / F.count(F.lit(1))).alias("pct")).where(F.col("n") >= least).join(rough, "chain_id")
    limits = share.agg(F.percentile("pct", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    quartile = F.when(F.col("pct") <= F.col("q")[0], 1).when(F.col("pct") <= F.col("q")[1], 2).when(F.col("pct") <= F.col("q")[2], 3).otherwise(4)
    rows = share.crossJoin(F.broadcast(limits)).withColumn("quartile", quartile)
    return rows.groupBy("quartile").agg(F.count(F.lit(1)).alias("n"), F.avg("bps_norm").alias("mean"), F.coalesce(F.stddev_samp("bps_norm"), F.lit(0.0)).alias("sd")).select(F.lit(name).alias("resname"), "*")


#: Confidence limits of the published sweep, and the residues that a chain keeps at least.
SWEEP, SWEEP_LEAST = (70.0, 80.0, 85.0, 90.0), 50


def plddt_sweep(scored: DataFrame, limits: tuple[float, ...] = SWEEP, least: int = SWEEP_LEAST) -> DataFrame:
    """least_plddt, chains, mean, sd (by n - 1) and cv_pct of BPS/L when residues below a limit are dropped before the steps are taken.
    scored: chain_id, pos, plddt, w."""
    rows = scored.withColumn("least_plddt", F.explode(F.array(*map(F.lit, limits)))).where("plddt >= least_plddt")
    step = F.abs(F.col("w") - F.lag("w").over(Window.partitionBy("least_plddt", "chain_id").orderBy("pos")))
    per = rows.withColumn("step", step).groupBy("least_plddt", "chain_id").agg((F.coalesce(F.sum("step"), F.lit(0.0)) / F.count(F.lit(1))).alias("b"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return per.groupBy("least_plddt").agg(F.count(F.lit(1)).alias("chains"), F.avg("b").alias("mean"), F.stddev_samp("b").alias("sd"), (100 * F.stddev_samp("b") / F.nullif(F.avg("b"), F.lit(0.0))).alias("cv_pct"))


def transferred(res: DataFrame, grids: DataFrame, by: str = "organism", n: int = 360) -> DataFrame:
    """Train, chains, mean, sd (by n - 1) and cv_pct of BPS/L of all other groups' chains under the W of one group. grids: as potential.grids_by gives them."""
    placed = res.where("phi is not null and psi is not null").select(by, "chain_id", "pos", grid_index(F.col("phi"), n).alias("gi"), grid_index(F.col("psi"), n).alias("gj"))
    rows = placed.join(grids, ["gi", "gj"]).where(F.col("train") != F.col(by))
    step = F.abs(F.col("w") - F.lag("w").over(Window.partitionBy("train", "chain_id").orderBy("pos")))
    per = rows.withColumn("step", step).groupBy("train", "chain_id").agg((F.coalesce(F.sum("step"), F.lit(0.0)) / F.count(F.lit(1))).alias("b"))
    return per.groupBy("train").agg(F.count(F.lit(1)).alias("chains"), F.avg("b").alias("mean"), F.stddev_samp("b").alias("sd"), (100 * F.stddev_samp("b") / F.nullif(F.avg("b"), F.lit(0.0))).alias("cv_pct"))
