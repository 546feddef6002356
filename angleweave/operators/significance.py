"""P-values of the two-sample and paired tests, correlations and the one-way F; ranks without a single ordered task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .shared import kept
from .stats import f_p_value, normal_p_value, t_p_value


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """value, n, rank of the distinct values. Values are dealt by range; a range's rows before it come from one row a range."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    parts = kept(counts.repartitionByRange(value).withColumn("part", F.spark_partition_id()), "ranks")
    sums = parts.groupBy("part").agg(F.sum("n").alias("own"))
    before = sums.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy(value)) - F.col("n")
    return parts.join(F.broadcast(before), "part").select(value, "n", (F.col("before") + inside + (F.col("n") + 1) / 2).alias("rank"))


def distances(df: DataFrame, group: str, value: str) -> DataFrame:
    """A, b (groups, a < b), wasserstein (the integral of |F_a - F_b|) and ks (its maximum), of all pairs of groups.

    A pair's values are dealt by range and summed within a range; what lies before a range comes from one row a range.
    """
    rows = kept(df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("n")), "masses")
    names = rows.groupBy("g").agg(F.sum("n").alias("size"))
    pairs = names.select(F.col("g").alias("a"), F.col("size").alias("na")).join(names.select(F.col("g").alias("b"), F.col("size").alias("nb")), F.col("a") < F.col("b"))
    sides = kept(pairs, "sides")
    both = rows.join(sides.select("*", F.explode(F.array("a", "b")).alias("g")), "g")
    masses = both.groupBy("a", "b", "na", "nb", "x").agg(F.sum(F.when(F.col("g") == F.col("a"), F.col("n")).otherwise(0)).alias("ca"), F.sum(F.when(F.col("g") == F.col("b"), F.col("n")).otherwise(0)).alias("cb"))
    parts = kept(masses.repartitionByRange("a", "b", "x").withColumn("part", F.spark_partition_id()), "parts")
    of_pair = Window.partitionBy("a", "b").orderBy("part")
    sums = parts.groupBy("a", "b", "part").agg(F.sum("ca").alias("own_a"), F.sum("cb").alias("own_b"), F.min("x").alias("first"))
    before = sums.select("a", "b", "part", *[(F.sum(f"own_{k}").over(of_pair) - F.col(f"own_{k}")).alias(f"before_{k}") for k in "ab"], F.lead("first").over(of_pair).alias("next"))
    inside = Window.partitionBy("a", "b", "part").orderBy("x")
    level = lambda k: (F.col(f"before_{k}") + F.sum(f"c{k}").over(inside)) / F.col(f"n{k}")
    steps = parts.join(F.broadcast(kept(before, "before")), ["a", "b", "part"]).select("a", "b", F.abs(level("a") - level("b")).alias("gap"), (F.coalesce(F.lead("x").over(inside), "next") - F.col("x")).alias("width"))
    return steps.groupBy("a", "b").agg(F.sum(F.col("gap") * F.col("width")).alias("wasserstein"), F.max("gap").alias("ks"))


def signed_ranks(df: DataFrame, difference: str) -> DataFrame:
    """w_plus and w_minus, the rank sums of the positive and the negative differences; zeros are left out."""
    d = df.select(F.col(difference).alias("d")).where("d <> 0").withColumn("size", F.abs("d"))
    ranked = d.join(average_ranks(d, "size").select("size", "rank"), "size")
    return ranked.agg(F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"))


def quantiles(df: DataFrame, value: str, shares: tuple[float, ...]) -> list[float | None]:
    """Interpolated percentiles of a column from its ranges' ranks: two neighbouring values a share reach the driver."""
    ranks = kept(average_ranks(df, value), "ranks").select(F.col(value).alias("x"), (F.col("rank") - (F.col("n") + 1) / 2).alias("first"), (F.col("rank") + (F.col("n") + 1) / 2 - 1).alias("last"))
    n = ranks.agg(F.max("last")).first()[0]
    if n is None:
        return [None] * len(shares)
    out = []
    for q in shares:
        at = q * (n - 1)
        low, high = math.floor(at), math.ceil(at)
        # The value that holds place k (from 0) has first <= k < last.
        a, b = (ranks.where((F.col("first") <= k) & (F.col("last") > k)).first().x for k in (low, high))
        out.append(a + (b - a) * (at - low))
    return out


def _ties(ranks: DataFrame) -> float:
    return float(ranks.agg(F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n"))).first()[0] or 0.0)


def pearson(df: DataFrame, x: str, y: str) -> tuple[float, float]:
    """R and its two-sided p."""
    n, r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count(F.lit(1)), F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))).first()
    return _of_r(r, n - 2)


def _of_r(r: float | None, df: int) -> tuple[float, float]:
    if r is None or df < 1:
        return math.nan, math.nan
    r = max(-1.0, min(1.0, r))
    return r, 0.0 if abs(r) == 1 else t_p_value(r * math.sqrt(df / (1 - r * r)), df)


def partial(df: DataFrame, x: str, y: str, z: str) -> tuple[float, float]:
    """T02."""
    d = df.select(*[F.col(c).cast("double").alias(c) for c in (x, y, z)]).dropna()
    n, xy, xz, yz = d.agg(F.count(F.lit(1)), F.corr(x, y), F.corr(x, z), F.corr(y, z)).first()
    return _of_r((xy - xz * yz) / math.sqrt((1 - xz * xz) * (1 - yz * yz)), n - 3)


def spearman(df: DataFrame, x: str, y: str) -> tuple[float, float]:
    """T16."""
    d = df.select(x, y).dropna()
    a, b = average_ranks(d, x).select(x, F.col("rank").alias("a")), average_ranks(d, y).select(y, F.col("rank").alias("b"))
    return pearson(d.join(a, x).join(b, y), "a", "b")


def two_sample_t(df: DataFrame, value: str, group: str, a: str, b: str) -> tuple[float, float]:
    """Equal variances."""
    rows = {r[0]: r for r in df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).collect()}
    x, y = rows[a], rows[b]
    free = x.n + y.n - 2
    t = (x.m - y.m) / math.sqrt(((x.n - 1) * x.v + (y.n - 1) * y.v) / free * (1 / x.n + 1 / y.n))
    return t, t_p_value(t, free)


def mann_whitney(df: DataFrame, value: str, group: str, a: str, b: str) -> tuple[float, float]:
    """U of a; p from the normal approximation with the correction for ties and continuity."""
    d = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).select(value, group)
    ranks = kept(average_ranks(d, value), "ranks")
    sizes = {r[0]: r[1] for r in d.groupBy(group).count().collect()}
    n1, n2 = sizes[a], sizes[b]
    total = d.where(F.col(group) == a).join(ranks, value).agg(F.sum("rank")).first()[0]
    u, n = total - n1 * (n1 + 1) / 2, n1 + n2
    spread = math.sqrt(n1 * n2 / 12 * (n + 1 - _ties(ranks) / (n * (n - 1))))
    z = (abs(u - n1 * n2 / 2) - 0.5) / spread if spread else 0.0
    return u, min(1.0, normal_p_value(max(z, 0.0)))


def wilcoxon(df: DataFrame, x: str, y: str) -> tuple[float, float]:
    """The smaller signed rank sum of x - y without zeros; p from the normal approximation with ties."""
    d = df.select((F.col(x) - F.col(y)).alias("d")).where("d <> 0").withColumn("size", F.abs("d"))
    ranks = kept(average_ranks(d, "size"), "ranks")
    n = d.count()
    plus, minus = d.join(ranks.drop("n"), "size").agg(F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0))).first()
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - _ties(ranks) / 48)
    w = min(plus, minus)
    return w, normal_p_value((w - n * (n + 1) / 4) / spread) if spread else 1.0


def one_way_f(df: DataFrame, value: str, group: str) -> tuple[float, float]:
    """T05."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count(F.lit(1))).alias("ss"))
    k, n, mean, within = g.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.col("n") * F.col("m")) / F.sum("n"), F.sum("ss")).first()
    between = g.agg(F.sum(F.col("n") * (F.col("m") - F.lit(mean)) * (F.col("m") - F.lit(mean)))).first()[0]
    f = (between / (k - 1)) / (within / (n - k))
    return f, f_p_value(f, k - 1, n - k)


def verdict(p: float, d: float) -> str:
    """C14. The limits are fixed values."""
    return "PASS" if p < 0.001 and abs(d) > 0.5 else "MARGINAL" if p < 0.05 and abs(d) > 0.2 else "FAIL"


def leave_one_out(df: DataFrame, y: str, xs: list[str]) -> dict:
    """MAE, RMSE and R2 of leave-one-out predictions of a least-squares fit, from its hat matrix: two aggregations, no refits."""
    import numpy as np

    cols = ["__one", *xs]
    d = df.select(F.lit(1.0).alias("__one"), *[F.col(c).cast("double").alias(c) for c in (*xs, y)]).dropna()
    # Centred and scaled, so that the moments are well conditioned.
    at = d.agg(*[F.avg(c).alias(f"m_{c}") for c in xs], *[F.stddev_pop(c).alias(f"s_{c}") for c in xs], F.avg(y).alias("my")).first()
    d = d.select("__one", *[((F.col(c) - at[f"m_{c}"]) / (at[f"s_{c}"] or 1.0)).alias(c) for c in xs], (F.col(y) - at["my"]).alias(y))
    k = len(cols)
    row = d.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"c{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate([*cols, y])]).first()
    m = np.array([[row[f"c{i}_{j}"] for j in range(k + 1)] for i in range(k)], float)
    inverse = np.linalg.pinv(m[:, :k])
    beta = inverse @ m[:, k]
    fit = sum((F.col(c) * float(b) for c, b in zip(cols, beta)), F.lit(0.0))
    hat = sum((F.col(a) * F.col(b) * float(inverse[i, j]) for i, a in enumerate(cols) for j, b in enumerate(cols)), F.lit(0.0))
    e = (F.col(y) - fit) / (1 - hat)
    n, mae, sse, total = d.agg(F.count(F.lit(1)), F.avg(F.abs(e)), F.sum(e * e), F.sum(F.col(y) * F.col(y))).first()
    return {"n": n, "mae": mae, "rmse": math.sqrt(sse / n), "r2_cv": 1 - sse / total}
