"""Reports whose DataFrame side is written on its own, so that SQL is an independent statement of the same formula."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.basins import kingdom
from ..operators import significance, stats
from ..operators.shared import kept
from . import catalogue, organism_reports
from .catalogue import QUERIES, rounded

DEFAULTS, FITTED = organism_reports.DEFAULTS, organism_reports.FITTED


def replaces(*names: str, **parameters):
    """Registers f(proteins, **parameters) for reports that have SQL."""

    def keep(f):
        for name in names:
            assert name in catalogue.SQL, name
            p = {"p": FITTED if name.endswith("_fitted") else DEFAULTS} if parameters.get("fitted") else {}
            QUERIES[name] = lambda spark, sf_dir, p=p: rounded(f(catalogue.protein_table(spark, sf_dir), **p))
        return f

    return keep


def moments(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """n, means, variances and covariance by differences from the means, in two passes."""
    means = df.groupBy(*by).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"))
    rows = df.join(means, list(by)) if by else df.crossJoin(means)
    dx, dy = F.col(x) - F.col("mx"), F.col(y) - F.col("my")
    return rows.groupBy(*by, "mx", "my").agg(F.count(F.lit(1)).alias("n"), F.avg(dx * dx).alias("vx"), F.avg(dy * dy).alias("vy"), F.avg(dx * dy).alias("cxy"))


@replaces("g05_length_regression", "g05_length_regression_fitted", fitted=True)
def length_regression(proteins: DataFrame, p: dict) -> DataFrame:
    m = moments(proteins, "length", "bps", "organism").where(F.col("n") >= p["least_regression"])
    slope = F.col("cxy") / F.nullif(F.col("vx"), F.lit(0.0))
    sure = (F.col("n") >= 5) & (F.sqrt("vx") > 1e-12) & (F.sqrt("vy") > 1e-12)
    r = F.col("cxy") / F.sqrt(F.nullif(F.col("vx") * F.col("vy"), F.lit(0.0)))
    return m.select("organism", "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), F.when(sure, r).alias("r"), (r * r).alias("r2"))


@replaces("g10_distribution_distances")
def distribution_distances(proteins: DataFrame) -> DataFrame:
    found = kept(significance.distances(proteins.select("organism", "bps_norm"), "organism", "bps_norm"), "distances")
    # As many rows as pairs of organisms.
    place = lambda order: F.row_number().over(Window.orderBy(order, "a", "b"))
    ranked = found.select(F.col("a").alias("org_a"), F.col("b").alias("org_b"), F.col("wasserstein").alias("distance"), place(F.col("wasserstein")).alias("near_rank"), place(F.col("wasserstein").desc()).alias("far_rank"))
    return ranked.where("near_rank <= 15 or far_rank <= 15")


@replaces("t13_t14_distances")
def one_distance(proteins: DataFrame) -> DataFrame:
    pair = proteins.where(F.col("organism").isin("ecoli", "human"))
    return significance.distances(pair, "organism", "bps_norm").select("wasserstein", "ks")


@replaces(*[n for n in ("g16_integrity", "g16_integrity_fitted") if n in catalogue.SQL], fitted=True)
def integrity(proteins: DataFrame, p: dict) -> DataFrame:
    """One row a chain and failed check, counted; checks that nothing fails are named by the list of checks."""
    lo, hi = p["extreme"]
    nulls = {f"null {c}": F.col(c).isNull() for c in proteins.columns if f"'null {c}'" in catalogue.SQL["g16_integrity"]}
    hard = {
        "plddt out of range": ~F.col("plddt_mean").between(0, 100), "shares not 100": F.abs(F.col("pct_helix") + F.col("pct_sheet") + F.col("pct_coil") - 100) > 1,
        "rg not positive": F.col("rg") <= 0, "contact order not positive": F.col("contact_order") <= 0,
    }
    info = {"extreme roughness": (F.col("bps_norm") < lo) | (F.col("bps_norm") > hi)}
    checks = nulls | hard | info
    failed = proteins.select(F.explode(F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in checks.items()]))).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("bad"))
    names = proteins.sparkSession.createDataFrame([(name, "null" if name in nulls else "hard" if name in hard else "info") for name in checks], "item string, kind string")
    total = proteins.agg(F.count(F.lit(1)).alias("total"))
    rows = names.join(failed, "item", "left").fillna(0, ["bad"]).crossJoin(total)
    graded = F.when(100 * F.col("bad") < F.col("total"), "OK").when(20 * F.col("bad") < F.col("total"), "WARN").otherwise("BAD")
    status = F.when(F.col("kind") == "null", graded).when(F.col("kind") == "info", "INFO").when(F.col("bad") == 0, "OK").otherwise("BAD")
    shared = proteins.groupBy("chain_id").agg(F.count_distinct("organism").alias("k")).agg(F.count_if(F.col("k") > 1).alias("bad")).select(F.lit("ids of several organisms").alias("item"), "bad", F.lit("INFO").alias("status"))
    small = proteins.groupBy("organism").count().where(F.col("count") < p["least_audit"]).select(F.concat(F.lit("small: "), "organism"), "count", F.lit("WARN"))
    return rows.select("item", "bad", status.alias("status")).union(shared).union(small)


def _by_fold(proteins: DataFrame, p: dict) -> DataFrame:
    """fold, organisms, n, mean and cv (percent) of the organisms' means, of cells with enough chains."""
    a, b, c, d, e, f, g = p["fold"]
    h, s = F.col("pct_helix") / 100, F.col("pct_sheet") / 100
    fold = F.when((h >= a) & (s < b), "all-alpha").when((s >= c) & (h < d), "all-beta").when((h >= e) & (s >= f), "alpha/beta").when((h >= g) & (s >= g), "alpha+beta").otherwise("other")
    cells = proteins.select(fold.alias("fold"), "organism", "bps_norm").groupBy("fold", "organism").agg(F.count(F.lit(1)).alias("k"), F.avg("bps_norm").alias("m")).where(F.col("k") >= p["least_cell"])
    means = F.collect_list("m")  # one number an organism
    mean = F.aggregate("ms", F.lit(0.0), lambda t, x: t + x) / F.size("ms")
    folds = cells.groupBy("fold").agg(means.alias("ms"), F.sum("k").alias("n")).withColumn("mean", mean)
    sd = F.sqrt(F.aggregate("ms", F.lit(0.0), lambda t, x: t + (x - F.col("mean")) * (x - F.col("mean"))) / F.size("ms"))
    return kept(folds.select("fold", F.size("ms").cast("bigint").alias("organisms"), "n", "mean", (100 * sd / F.nullif(F.col("mean"), F.lit(0.0))).alias("cv")), "folds")


@replaces("g20_within_fold_cv", "g20_within_fold_cv_fitted", fitted=True)
def within_fold(proteins: DataFrame, p: dict) -> DataFrame:
    folds = _by_fold(proteins, p)
    return folds.crossJoin(folds.agg(F.sum("n").alias("all"))).select("fold", "organisms", "n", "mean", "cv", (100.0 * F.col("n") / F.col("all")).alias("composition"))


@replaces("g20_summary", "g20_summary_fitted", fitted=True)
def fold_summary(proteins: DataFrame, p: dict) -> DataFrame:
    folds = _by_fold(proteins, p)
    return folds.agg(F.count(F.lit(1)).alias("folds"), (F.sum(F.col("cv") * F.col("n")) / F.sum("n")).alias("weighted_cv"), F.avg("cv").alias("plain_cv"), (F.max("mean") - F.min("mean")).alias("separation"))


@replaces("t05_variance_split")
def variance_split(proteins: DataFrame) -> DataFrame:
    """Squares of the chains around their organism's mean, of that around the kingdom's, of that around all, chain by chain."""
    rows = proteins.select(kingdom(F.col("organism")).alias("kingdom"), "organism", "bps_norm")
    mean = lambda name, *by: rows.groupBy(*by).agg(F.avg("bps_norm").alias(name))
    rows = rows.join(mean("om", "kingdom", "organism"), ["kingdom", "organism"]).join(mean("km", "kingdom"), "kingdom").crossJoin(mean("am"))
    square = lambda a, b: F.sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))
    s = rows.agg(square("km", "am").alias("kingdom_ss"), square("om", "km").alias("organism_ss"), square("bps_norm", "om").alias("within_ss"), square("om", "am").alias("between"), F.count(F.lit(1)).alias("n"), F.count_distinct("organism").alias("k"))
    return s.select("kingdom_ss", "organism_ss", "within_ss", F.round((F.col("between") / (F.col("k") - 1)) / (F.col("within_ss") / (F.col("n") - F.col("k"))), 4).alias("f"))


@replaces("t11_mann_whitney")
def mann_whitney(proteins: DataFrame) -> DataFrame:
    u, _ = significance.mann_whitney(proteins, "length", "organism", "ecoli", "human")
    return proteins.sparkSession.createDataFrame([(float(u),)], "u double")


@replaces("t12_wilcoxon")
def wilcoxon(proteins: DataFrame) -> DataFrame:
    return significance.signed_ranks(proteins.select(F.round(F.col("q_phi") - F.col("q_psi"), 4).alias("d")), "d")


@replaces("t16_spearman")
def spearman(proteins: DataFrame) -> DataFrame:
    rho, _ = significance.spearman(proteins, "length", "n_transitions")
    return proteins.sparkSession.createDataFrame([(float(rho),)], "rho double")


@replaces("t10_two_sample_t")
def two_sample_t(proteins: DataFrame) -> DataFrame:
    t, _ = significance.two_sample_t(proteins, "bps_norm", "organism", "ecoli", "human")
    n = proteins.where(F.col("organism").isin("ecoli", "human")).count()
    return proteins.sparkSession.createDataFrame([(float(t), n - 2)], "t double, df bigint")


@replaces("t17_model_comparison")
def model_comparison(proteins: DataFrame) -> DataFrame:
    """Least squares of standardised predictors, by their normal equations."""
    names = {"co": "contact_order", "bps": "bps", "norm": "bps_norm", "len": "length"}
    scale = proteins.agg(*[f(c).alias(f"{k}_{c}") for c in (*names.values(), "plddt_mean") for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = kept(proteins.select((F.col("plddt_mean") - scale["m_plddt_mean"]).alias("y"), *[((F.col(c) - scale[f"m_{c}"]) / (scale[f"s_{c}"] or 1.0)).alias(k) for k, c in names.items()]), "standardised")
    fits = [(name, stats.least_squares(z, "y", xs)) for name, xs in organism_reports._MODELS.items()]
    return proteins.sparkSession.createDataFrame([(name, float(f["r2"]), float(f["adj_r2"]), float(f["rmse"])) for name, f in fits], "model string, r2 double, adj_r2 double, rmse double")


@replaces("t18_leave_one_out")
def leave_one_out(proteins: DataFrame) -> DataFrame:
    x = significance.leave_one_out(kept(proteins.select("bps_norm", "length"), "fit"), "bps_norm", ["length"])
    return proteins.sparkSession.createDataFrame([(x["n"], float(x["mae"]), float(x["rmse"]), float(x["r2_cv"]))], "n bigint, mae double, rmse double, r2_cv double")


@replaces("t19_histogram_kl")
def histogram_kl(proteins: DataFrame) -> DataFrame:
    """Shares of two organisms by bin; bins that neither has do not count."""
    bins = proteins.where(F.col("organism").isin("ecoli", "human")).groupBy(F.floor(F.col("bps_norm") * 20).alias("bin"), "organism").count()
    wide = kept(bins.groupBy("bin").pivot("organism", ["ecoli", "human"]).agg(F.first("count")).fillna(0), "bins")
    total = wide.agg(F.sum("ecoli").alias("a"), F.sum("human").alias("b"))
    rows = wide.crossJoin(total).select((F.col("ecoli") / F.col("a")).alias("p"), (F.col("human") / F.col("b")).alias("q"))
    return rows.agg(F.sum(F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("p") * F.log(F.col("p") / F.col("q"))).otherwise(0.0)).alias("kl"), F.sum(F.abs(F.col("p") - F.col("q"))).alias("l1"), F.corr("p", "q").alias("r"))


@replaces("t15_cohens_d")
def cohens_d(proteins: DataFrame) -> DataFrame:
    """From sums of squares of each side around its mean."""
    side = proteins.where(F.col("organism").isin("ecoli", "human")).select("organism", "bps_norm")
    mean = side.groupBy("organism").agg(F.avg("bps_norm").alias("m"))
    ss = side.join(mean, "organism").groupBy("organism", "m").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("bps_norm") - F.col("m")) * (F.col("bps_norm") - F.col("m"))).alias("ss")).orderBy("organism").collect()
    a, b = ss
    equal = ((a.ss / (a.n - 1) + b.ss / (b.n - 1)) / 2) ** 0.5
    pooled = ((a.ss + b.ss) / (a.n + b.n - 2)) ** 0.5
    return proteins.sparkSession.createDataFrame([((a.m - b.m) / equal, (a.m - b.m) / pooled)], "d_equal double, d_pooled double")


@replaces("g27_quartiles")
def quartiles(proteins: DataFrame) -> DataFrame:
    q1, q2, q3 = significance.quantiles(proteins, "pct_helix", (0.25, 0.5, 0.75))
    h = F.col("pct_helix")
    return proteins.groupBy(F.when(h <= q1, 1).when(h <= q2, 2).when(h <= q3, 3).otherwise(4).alias("quartile")).agg(F.count(F.lit(1)).alias("n"), F.avg("bps_norm").alias("mean"))


@replaces("o06_global_sample")
def global_sample(proteins: DataFrame) -> DataFrame:
    """The least 200 by hash: each task keeps its own least ones."""
    return proteins.orderBy(F.md5(F.concat_ws("|", F.col("chain_id").cast("string"), F.lit("42"))), "chain_id").limit(200).select("organism", "chain_id")


@replaces("o11_train_test")
def train_test(proteins: DataFrame) -> DataFrame:
    """The tenth of least hashes builds, by ranks without one ordered task."""
    rows = kept(proteins.select("chain_id", F.concat_ws("|", F.md5(F.concat_ws("|", F.col("chain_id").cast("string"), F.lit("split"))), F.format_string("%020d", "chain_id")).alias("h")), "split")
    ranks = significance.average_ranks(rows, "h").select("h", "rank")
    n = rows.count()
    return rows.join(ranks, "h").select("chain_id", F.when(10 * F.col("rank") <= n, "build").otherwise("test").alias("part"))
