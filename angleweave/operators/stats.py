"""Statistics: moments and ranks as aggregations, p-values on one-row results."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson r, null for fewer than five pairs or a spread below 1e-12."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    n = F.count_if(both)
    sx, sy = F.stddev_pop(a), F.stddev_pop(b)
    cov = F.covar_pop(a, b)
    return F.when((n >= 5) & (sx > 1e-12) & (sy > 1e-12), cov / F.when((sx > 1e-12) & (sy > 1e-12), sx * sy))


def partial_corr(rxy: Column, rxz: Column, ryz: Column) -> Column:
    """r(x, y | z) in closed form."""
    return (rxy - rxz * ryz) / F.nullif(F.sqrt((1 - rxz * rxz) * (1 - ryz * ryz)), F.lit(0.0))


def cohens_d(m1: Column, s1: Column, m2: Column, s2: Column) -> Column:
    """T15, equal weights."""
    return (m1 - m2) / F.nullif(F.sqrt((s1 * s1 + s2 * s2) / 2), F.lit(0.0))


def ranks(df: DataFrame, value: str, group: list[str], name: str = "rank") -> DataFrame:
    """Average ranks, for Spearman (T16), Mann-Whitney (T11) and Wilcoxon."""
    by = Window.partitionBy(*group)
    return df.withColumn(name, F.rank().over(by.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*group, value)) - 1) / 2.0)


def wasserstein(df: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """The integral of |F1 - F2| by running counts over the union."""
    rows = df.where(F.col(group).isin(a, b)).select(F.col(value).alias("x"), (F.col(group) == a).cast("double").alias("in_a"))
    n = rows.agg(F.sum("in_a").alias("na"), F.sum(1 - F.col("in_a")).alias("nb"))
    by = Window.partitionBy(F.lit(1)).orderBy("x")
    steps = rows.groupBy("x").agg(F.sum("in_a").alias("ca"), F.sum(1 - F.col("in_a")).alias("cb")).crossJoin(F.broadcast(n))
    steps = steps.withColumn("gap", F.abs(F.sum("ca").over(by) / F.col("na") - F.sum("cb").over(by) / F.col("nb"))).withColumn("width", F.lead("x").over(by) - F.col("x"))
    return steps.agg(F.sum(F.col("gap") * F.col("width")).alias("wasserstein"), F.max("gap").alias("ks"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h


def t_p_value(t: float, df: float) -> float:
    """Two-sided."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_p_value(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def normal_p_value(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def least_squares(df: DataFrame, y: str, xs: list[str]) -> dict:
    """OLS with an intercept from one aggregation of moments; coefficients, R2, adjusted R2, n."""
    import numpy as np

    cols = ["__one", *xs, y]
    d = df.select(F.lit(1.0).alias("__one"), *[F.col(c).cast("double").alias(c) for c in (*xs, y)]).dropna()
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = d.agg(*[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"m{i}_{j}") for i, j in pairs]).first()
    m = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        m[i, j] = m[j, i] = row[f"m{i}_{j}"] or 0.0
    k, n = len(xs) + 1, m[0, 0]
    beta = np.linalg.lstsq(m[:k, :k], m[:k, k], rcond=None)[0]
    total = m[k, k] - m[0, k] ** 2 / max(n, 1)
    rest = m[k, k] - beta @ m[:k, k]
    r2 = 1 - rest / total if total > 0 else 0.0
    return {"n": int(n), "coefficients": dict(zip(["intercept", *xs], beta.tolist())), "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / (n - k) if n > k else r2, "rmse": math.sqrt(max(rest, 0) / max(n, 1))}


def dominant_component(found: dict, columns: list[str], column: str, first: int = 3) -> tuple[int, float]:
    """Which of the first components (from 1) a variable loads most strongly on, and its loading there. found: as principal() gives it."""
    at = columns.index(column)
    loadings = [float(found["loadings"][k][at]) for k in range(min(first, len(columns)))]
    best = max(range(len(loadings)), key=lambda k: (abs(loadings[k]), -k))
    return best + 1, loadings[best]


def poisson_weights(keys, rounds: int, seed: int):
    """How often each row counts in each round, Poisson with mean 1: a function of the row's key, the round and the seed alone. keys: int64; (rows, rounds)."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(rounds, dtype=np.uint64)[None, :] + np.uint64(seed) * np.uint64(1 << 32)) * np.uint64(0xD1B54A32D192ED03)
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
        x ^= x >> np.uint64(31)
    u = (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    chance = math.exp(-1) / np.cumprod([1, *range(1, 20)])
    return np.searchsorted(np.cumsum(chance), u, side="right")


def bootstrap_rounds(df: DataFrame, group: str, value: str, key: str, rounds: int, seed: int) -> DataFrame:
    """group, round, n, total: number and sum of the rows of every resampling round.

    Each row counts a Poisson number of times in each round, so a partition adds up its own rows, all rounds at once, and Spark merges
    one row a group, round and partition. No task holds a group. Keys tell rows apart.
    """
    name = df.schema[group].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pandas as pd

        sums: dict = {}
        for b in batches:
            for g, x in b.groupby("g", dropna=False):
                n, total = sums.setdefault(g, (np.zeros(rounds), np.zeros(rounds)))
                keys, values = x["k"].to_numpy(np.int64), x["v"].to_numpy(np.float64)
                for s in range(0, len(x), 256):
                    w = poisson_weights(keys[s : s + 256], rounds, seed)
                    n += w.sum(axis=0)
                    total += values[s : s + 256] @ w
        for g, (n, total) in sums.items():
            yield pd.DataFrame({"g": pd.Series([None if pd.isna(g) else g] * rounds, dtype=object), "round": np.arange(rounds, dtype="int32"), "n": n, "total": total})

    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.xxhash64(key).alias("k"), F.col(value).cast("double").alias("v"))
    parts = rows.mapInPandas(run, f"g {name}, round int, n double, total double")
    return parts.groupBy(F.col("g").alias(group), "round").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def bootstrap_mean(df: DataFrame, group: str, value: str, rounds: int = 10_000, seed: int = 42, key: str = "chain_id") -> DataFrame:
    """Percentile interval of a group's mean over resampling rounds."""
    means = bootstrap_rounds(df, group, value, key, rounds, seed).where("n > 0").select(group, (F.col("total") / F.col("n")).alias("m"))
    # rounds rows a group, whatever the group's size.
    limits = means.groupBy(group).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    own = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return own.join(limits, own[group].eqNullSafe(limits[group]), "left").select(own[group], "n", "mean", "lo", "hi")


def principal(df: DataFrame, columns: list[str]) -> dict:
    """Eigenvalues (largest first) and loadings of standardised columns; spread by n, covariance by n - 1. One aggregation."""
    import numpy as np

    d = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = d.agg(F.count(F.lit(1)).alias("n"), *[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    k, n = len(columns), row["n"]
    m = np.zeros((k, k))
    for i, j in pairs:
        m[i, j] = m[j, i] = row[f"c{i}_{j}"] or 0.0
    sd = np.sqrt(np.maximum(np.diag(m) * (n - 1) / max(n, 1), 0))
    sd[sd < 1e-12] = 1.0
    values, vectors = np.linalg.eigh(m / np.outer(sd, sd))
    vectors = vectors[:, ::-1].T
    signs = np.sign(vectors[np.arange(k), np.abs(vectors).argmax(axis=1)])
    return {"eigenvalues": values[::-1], "loadings": vectors * np.where(signs == 0, 1, signs)[:, None]}


def bootstrap_ratio(df: DataFrame, kind: str, value: str, rounds: int = 1000, seed: int = 99, key: str = "chain_id") -> DataFrame:
    """mean(null) / mean(real) and its interval; the values of both sides are resampled independently."""
    rows = df.where(F.col(value).isNotNull() & F.col(kind).isin("real", "null")).withColumn("__key", F.concat_ws("|", kind, F.col(key).cast("string")))
    means = bootstrap_rounds(rows, kind, value, "__key", rounds, seed).where("n > 0").groupBy("round").pivot(kind, ["real", "null"]).agg(F.first(F.col("total") / F.col("n")))
    ratio = means.select((F.col("null") / F.nullif(F.col("real"), F.lit(0.0))).alias("ratio")).agg(F.percentile("ratio", F.lit(0.025)).alias("lo"), F.percentile("ratio", F.lit(0.975)).alias("hi"))
    own = rows.agg(F.avg(F.when(F.col(kind) == "null", F.col(value))).alias("a"), F.avg(F.when(F.col(kind) == "real", F.col(value))).alias("b"))
    # Two tables of one row each.
    return own.crossJoin(ratio).select((F.col("a") / F.nullif(F.col("b"), F.lit(0.0))).alias("ratio"), "lo", "hi")


def sweep_variation(df: DataFrame, group: str, value: str) -> DataFrame:
    """Number, mean, coefficient of variation and range of a value over the settings of a sweep."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("settings"), F.avg(value).alias("mean"), (100 * F.stddev_pop(value) / F.nullif(F.avg(value), F.lit(0.0))).alias("cv_pct"), (F.max(value) - F.min(value)).alias("spread"))


def rejections(log: DataFrame) -> DataFrame:
    """By position, proposals, the share of them that were rejected, and that share in chains whose first or second half the position is in. log: chain_id, pos, attempts, rejected."""
    rows = log.withColumn("len", F.max("pos").over(Window.partitionBy("chain_id")))
    early = 2 * F.col("pos") <= F.col("len")
    rate = lambda when: F.sum(F.when(when, F.col("rejected"))) / F.sum(F.when(when, F.col("attempts")))
    return rows.groupBy("pos").agg(F.sum("attempts").alias("attempts"), F.sum("rejected").alias("rejected"), rate(F.lit(True)).alias("rate"), rate(early).alias("early"), rate(~early).alias("late"))
