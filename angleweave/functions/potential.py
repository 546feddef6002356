"""The periodic potential W on an n x n grid, built once on the driver (a constant-size table), and its lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .angles import grid_index

#: Weight, centre phi, centre psi (degrees), kappa phi, kappa psi, rho.
COMPONENTS = (
    (0.35, -63, -43, 12.0, 10.0, 2.0),
    (0.05, -60, -27, 8.0, 6.0, 1.0),
    (0.25, -120, 135, 4.0, 3.5, -1.5),
    (0.05, -140, 155, 5.0, 4.0, -1.0),
    (0.12, -75, 150, 8.0, 5.0, 0.5),
    (0.05, -95, 150, 3.0, 4.0, 0.0),
    (0.03, 57, 40, 6.0, 6.0, 1.5),
    (0.03, 60, -130, 5.0, 4.0, 0.0),
    (0.01, 75, -65, 5.0, 5.0, 0.0),
    (0.06, 0, 0, 0.01, 0.01, 0.0),
)
FLOOR = 1e-6


def smoothed(w, sigma: float, boundary: str = "wrap"):
    """Separable Gaussian with a radius of four sigmas."""
    import numpy as np

    if sigma <= 0:
        return w
    r = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        padded = np.pad(w, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="wrap" if boundary == "wrap" else "symmetric")
        w = sum(k * np.take(padded, range(i, i + w.shape[axis]), axis=axis) for i, k in enumerate(kernel))
    return w


def from_density(p, sigma: float = 1.5, floor: float | None = None, boundary: str = "wrap"):
    """W = -sqrt(P) from any non-negative grid: normalise to an integral of 1, floor, root, smooth (W01 tail, W05, W06)."""
    import numpy as np

    step = 2 * np.pi / p.shape[0]
    p = p / (p.sum() * step * step)
    p = np.maximum(p, p.max() * FLOOR if floor is None else floor)
    return smoothed(-np.sqrt(p), sigma, boundary)


def build(n: int = 360, sigma: float = 1.5, kappa_scale: float = 1.0, floor: float | None = None, boundary: str = "wrap"):
    """The mixture (components are summed without their normalising constants) as a W grid."""
    import numpy as np

    g = -np.pi + np.arange(n) * 2 * np.pi / n
    phi, psi = g[:, None], g[None, :]
    p = np.zeros((n, n))
    for weight, mp, ms, kp, ks, rho in COMPONENTS:
        dp, ds = phi - np.radians(mp), psi - np.radians(ms)
        p = p + weight * np.exp(kappa_scale * (kp * np.cos(dp) + ks * np.cos(ds) + rho * np.sin(dp) * np.sin(ds)))
    return from_density(p, sigma, floor, boundary)


def grid_table(spark: SparkSession, w) -> DataFrame:
    """gi, gj, w and the three neighbours of the cell: n * n rows whatever the data."""
    import numpy as np
    import pyarrow as pa

    n = w.shape[0]
    gi, gj = np.divmod(np.arange(n * n), n)
    a, b = (gi + 1) % n, (gj + 1) % n
    # An Arrow table goes over as it is; a pandas frame would go row by row.
    return spark.createDataFrame(pa.table({"gi": gi.astype("int32"), "gj": gj.astype("int32"), "w00": w[gi, gj], "w10": w[a, gj], "w01": w[gi, b], "w11": w[a, b]}))


def with_nearest(df: DataFrame, grid: DataFrame, n: int = 360, name: str = "w") -> DataFrame:
    """Nearest node, by a broadcast of the constant grid."""
    keyed = df.withColumn("__gi", grid_index(F.col("phi"), n)).withColumn("__gj", grid_index(F.col("psi"), n))
    g = F.broadcast(grid.select(F.col("gi").alias("__gi"), F.col("gj").alias("__gj"), F.col("w00").alias(name)))
    return keyed.join(g, ["__gi", "__gj"], "left").drop("__gi", "__gj")


def with_bilinear(df: DataFrame, grid: DataFrame, n: int = 360, name: str = "w", edge: str = "wrap") -> DataFrame:
    """Bilinear with wrap; edge="extrapolate" keeps the last cell and lets its weight pass 1."""
    def cell(angle: Column) -> tuple[Column, Column]:
        x = (angle + F.pi()) * n / (2 * F.pi())
        k = F.floor(x)
        k = F.pmod(k, F.lit(n)) if edge == "wrap" else F.least(F.greatest(k, F.lit(0)), F.lit(n - 2))
        return k.cast("int"), (x - F.floor(x)) if edge == "wrap" else x - k

    (i, u), (j, v) = cell(F.col("phi")), cell(F.col("psi"))
    keyed = df.withColumns({"gi": i, "gj": j, "__u": u, "__v": v})
    u, v = F.col("__u"), F.col("__v")
    value = (1 - u) * (1 - v) * F.col("w00") + u * (1 - v) * F.col("w10") + (1 - u) * v * F.col("w01") + u * v * F.col("w11")
    return keyed.join(F.broadcast(grid), ["gi", "gj"], "left").withColumn(name, value).drop("gi", "gj", "__u", "__v", "w00", "w10", "w01", "w11")


def histogram(res: DataFrame, n: int = 360) -> DataFrame:
    """Counts of observed angles by nearest cell (W05 input)."""
    return res.where("phi is not null and psi is not null").groupBy(grid_index(F.col("phi"), n).alias("gi"), grid_index(F.col("psi"), n).alias("gj")).agg(F.count(F.lit(1)).alias("n"))


def from_counts(hist: DataFrame, n: int = 360, sigma: float = 1.5):
    """The W grid of observed angles, from gi, gj, n of the occupied cells (at most n * n rows); None where nothing was observed."""
    import numpy as np

    rows = hist.select("gi", "gj", "n").toPandas()
    if rows.empty:
        return None
    p = np.zeros((n, n))
    p[rows["gi"], rows["gj"]] = rows["n"]
    return from_density(p, sigma)


def grids_by(res: DataFrame, by: str, n: int = 360, sigma: float = 1.5) -> DataFrame:
    """W05 for every group: train (the group), gi, gj, w of all nodes. A task holds one group's occupied cells, n * n at most."""
    kind = res.schema[by].dataType.simpleString()
    whole = res.where("phi is not null and psi is not null")
    cells = whole.groupBy(F.col(by).alias("train"), grid_index(F.col("phi"), n).alias("gi"), grid_index(F.col("psi"), n).alias("gj")).agg(F.count(F.lit(1)).alias("n"))

    def run(pdf):
        import numpy as np
        import pandas as pd

        p = np.zeros((n, n))
        p[pdf["gi"], pdf["gj"]] = pdf["n"]
        gi, gj = np.divmod(np.arange(n * n), n)
        return pd.DataFrame({"train": pd.Series([pdf["train"].iloc[0]] * (n * n), dtype=object), "gi": gi.astype("int32"), "gj": gj.astype("int32"), "w": from_density(p, sigma).ravel()})

    return cells.groupBy("train").applyInPandas(run, f"train {kind}, gi int, gj int, w double")


def log_potential(hist: DataFrame, eps: float, n: int = 360) -> DataFrame:
    """-ln(count / (total d d) + eps) of the occupied cells."""
    import math

    d = 2 * math.pi / n
    total = hist.agg(F.sum("n").alias("total"))
    return hist.crossJoin(F.broadcast(total)).select("gi", "gj", (-F.log(F.col("n") / (F.col("total") * d * d) + eps)).alias("w"))


def flat(basin: Column) -> Column:
    """W08."""
    return F.when(basin == "alpha", 0.0).when(basin == "beta", 1.0).otherwise(2.0)


#: Grid rows and columns (degrees from -180) of the two basins' rectangles, their centres, and the line on which the saddle is sought.
RECTANGLES = {"alpha": ((80, 140), (120, 180)), "beta": ((30, 100), (280, 350))}
CENTRES, SADDLE = {"alpha": (117, 137), "beta": (60, 310)}, 90


def landscape(grid: DataFrame) -> DataFrame:
    """Extremes, mean, saddle (least on its line) and its place, both basins' centres, their depth below the saddle, the means over
    their rectangles and the depth of these below the mean. grid: gi, gj, w of 360 x 360 nodes."""
    at = lambda i, j: F.max(F.when((F.col("gi") == i) & (F.col("gj") == j), F.col("w")))
    line = F.when(F.col("gi") == SADDLE, F.col("w"))
    mean = lambda i, j: F.avg(F.when(F.col("gi").between(i[0], i[1] - 1) & F.col("gj").between(j[0], j[1] - 1), F.col("w")))
    out = grid.agg(F.min("w").alias("w_min"), F.max("w").alias("w_max"), F.avg("w").alias("w_mean"), F.min(line).alias("w_saddle"), F.min(F.when(F.col("gi") == SADDLE, F.struct("w", "gj")))["gj"].alias("saddle_gj"),
        *[at(*c).alias(f"w_{k}") for k, c in CENTRES.items()], *[mean(*r).alias(f"mean_{k}") for k, r in RECTANGLES.items()])
    return out.select("*", *[(F.col("w_saddle") - F.col(f"w_{k}")).alias(f"depth_{k}") for k in CENTRES], *[(F.col("w_mean") - F.col(f"mean_{k}")).alias(f"below_{k}") for k in RECTANGLES])
