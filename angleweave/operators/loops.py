"""Loops between helix and sheet runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.angles import wrap
from .chains import order, segments


def stratum(length: Column) -> Column:
    """L07."""
    return F.when(length <= 7, "short").when(length <= 10, "medium").when(length <= 15, "long").otherwise("very long")


def extract(res: DataFrame, least_run: int = 2, most: int = 20) -> DataFrame:
    """Between consecutive different alpha/beta runs of at least least_run, 1 to most residues.

    res carries basin and w. One row per loop: start, end, length, direction, delta_w, path_len (N14), residues (P16).
    """
    runs = segments(res).where(F.col("label").isin("alpha", "beta") & (F.col("length") >= least_run))
    by = Window.partitionBy("chain_id").orderBy("start")
    gaps = runs.select("chain_id", "label", F.col("end").alias("before"), F.lead("label").over(by).alias("next_label"), F.lead("start").over(by).alias("after"))
    gaps = gaps.where((F.col("label") != F.col("next_label")) & (F.col("after") - F.col("before") - 1).between(1, most))
    gaps = gaps.select("chain_id", (F.col("before") + 1).alias("start"), (F.col("after") - 1).alias("end"), F.concat("label", F.lit("->"), "next_label").alias("direction"))
    steps = res.select("chain_id", "pos", "resname", "phi", "psi", "w", F.sqrt(F.pow(wrap(F.col("phi") - F.lag("phi").over(order())), 2) + F.pow(wrap(F.col("psi") - F.lag("psi").over(order())), 2)).alias("step"))
    # A loop's places and its flanks, at most `most` + 2, meet their residues by an equi-join.
    places = gaps.withColumn("pos", F.explode(F.sequence(F.col("start") - 1, F.col("end") + 1)))
    hit = steps.join(places, ["chain_id", "pos"]).select(*gaps.columns, "pos", "resname", "phi", "psi", "w", "step")
    inside = F.col("pos").between(F.col("start"), F.col("end"))
    out = hit.groupBy("chain_id", "start", "end", "direction").agg(
        F.abs(F.max(F.when(F.col("pos") > F.col("end"), F.col("w"))) - F.max(F.when(F.col("pos") < F.col("start"), F.col("w")))).alias("delta_w"),
        F.coalesce(F.sum(F.when(inside & (F.col("pos") > F.col("start")), F.col("step"))), F.lit(0.0)).alias("path_len"),
        F.array_sort(F.collect_list(F.when(inside, F.struct("pos", F.substring("resname", 1, 1).alias("letter"), "phi", "psi", "w", "resname")))).alias("path"),
    )
    return out.withColumn("length", F.col("end") - F.col("start") + 1).withColumn("residues", F.array_join(F.transform("path", lambda x: x["letter"]), ""))


def extract_narrow(res: DataFrame, least_run: int = 3, most: int = 20) -> DataFrame:
    """As N10 over narrow basins (res carries them), runs of three; a loop with an undefined angle is left out."""
    return extract(res, least_run, most).where(~F.exists("path", lambda x: x["phi"].isNull() | x["psi"].isNull()))


def extract_flanked(res: DataFrame, flank: int = 3, most: int = 20, ahead: int = 5) -> DataFrame:
    """From a run of flank or more to the first such run of the other major basin within `ahead` runs, unless a run of the same
    basin comes before it. The path takes `flank` residues of both runs; delta_w is the sum of |dW| along it. Undefined angles are
    left out of the path."""
    by = Window.partitionBy("chain_id").orderBy("start")
    major = lambda c: c.isin("alpha", "beta")
    later = [F.struct(F.lit(k).alias("k"), F.lead("label", k).over(by).alias("label"), F.lead("start", k).over(by).alias("start"), F.lead("end", k).over(by).alias("end")) for k in range(1, ahead + 1)]
    runs = segments(res).withColumn("later", F.array(*later)).where(major(F.col("label")) & (F.col("length") >= flank))
    first = F.greatest(F.col("start"), F.col("end") - flank + 1)
    last = lambda x: F.least(x["end"], x["start"] + flank - 1)
    same = F.array_min(F.transform(F.filter("later", lambda x: x["label"] == F.col("label")), lambda x: x["k"]))
    fits = lambda x: major(x["label"]) & (x["label"] != F.col("label")) & (x["end"] - x["start"] + 1 >= flank) & (last(x) - first + 1).between(2 * flank + 1, most) & (x["k"] < F.coalesce(same, F.lit(ahead + 1)))
    picked = runs.withColumn("to", F.get(F.filter("later", fits), 0)).where("to is not null")
    spans = picked.select("chain_id", first.alias("start"), last(F.col("to")).alias("end"), F.concat("label", F.lit("->"), F.col("to.label")).alias("direction"))
    rows = res.where("phi is not null and psi is not null").select("chain_id", "pos", "phi", "psi", "w")
    inside = rows.join(spans.withColumn("pos", F.explode(F.sequence("start", "end"))), ["chain_id", "pos"]).select(*spans.columns, "pos", "phi", "psi", "w")
    along = Window.partitionBy("chain_id", "start", "end").orderBy("pos")
    step = lambda c: wrap(F.col(c) - F.lag(c).over(along))
    inside = inside.withColumn("step", F.sqrt(F.pow(step("phi"), 2) + F.pow(step("psi"), 2))).withColumn("dw", F.abs(F.col("w") - F.lag("w").over(along)))
    out = inside.groupBy("chain_id", "start", "end", "direction").agg(F.count(F.lit(1)).alias("defined"), F.sum("dw").alias("delta_w"), F.sum("step").alias("path_len"))
    return out.where(F.col("defined") >= 2 * flank + 1).withColumn("length", F.col("end") - F.col("start") + 1).drop("defined")


def features(res: DataFrame, least: int = 3) -> DataFrame:
    """Eight features of runs of "other" of at least least residues."""
    runs = segments(res).where((F.col("label") == "other") & (F.col("length") >= least)).select("chain_id", "seg", "start", "end", "length")
    # Runs do not overlap: as many places as residues.
    inner = res.join(runs.withColumn("pos", F.explode(F.sequence("start", "end"))), ["chain_id", "pos"]).select(*runs.columns, "pos", "phi", "psi", "w")
    by = Window.partitionBy("chain_id", "seg").orderBy("pos")
    inner = inner.withColumn("adw", F.abs(F.col("w") - F.lag("w").over(by)))
    return inner.groupBy("chain_id", "seg", "start", "length").agg(
        F.avg("adw").alias("bps_mean"), F.stddev_pop("adw").alias("bps_std"), F.first(F.least("length", F.lit(50)) / 50.0).alias("norm_len"),
        F.avg(F.sin("phi")).alias("sin_phi"), F.avg(F.cos("phi")).alias("cos_phi"), F.avg(F.sin("psi")).alias("sin_psi"), F.avg(F.cos("psi")).alias("cos_psi"), (F.max("w") - F.min("w")).alias("w_range"),
    )


def resampled(path: Column, n: int | Column = 20) -> Column:
    """N points by circular interpolation; a path of one point is repeated."""
    n = F.lit(n) if isinstance(n, int) else n

    def point(k: Column) -> Column:
        x = k * (F.size(path) - 1) / F.greatest(n - 1, F.lit(1))
        a = F.get(path, F.floor(x).cast("int"))
        b = F.get(path, F.least(F.floor(x).cast("int") + 1, F.size(path) - 1))
        t = x - F.floor(x)
        mix = lambda f: F.atan2((1 - t) * F.sin(a[f]) + t * F.sin(b[f]), (1 - t) * F.cos(a[f]) + t * F.cos(b[f]))
        return F.struct(mix("phi").alias("phi"), mix("psi").alias("psi"))

    return F.transform(F.sequence(F.lit(0), n - 1), point)


def path_distance(a: Column, b: Column) -> Column:
    """Mean torus distance point by point."""
    each = F.zip_with(a, b, lambda p, q: F.sqrt(F.pow(wrap(p["phi"] - q["phi"]), 2) + F.pow(wrap(p["psi"] - q["psi"]), 2)))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def distances(loops: DataFrame, n: int = 20) -> DataFrame:
    """Pairs of loops of one stratum and direction. Strata bound the groups; the pairs are the result asked for."""
    pts = loops.select(F.concat_ws(":", "chain_id", "start").alias("loop_id"), "direction", stratum(F.col("length")).alias("stratum"), resampled(F.col("path"), n).alias("pts"))
    a, b = pts.alias("a"), pts.alias("b")
    joined = a.join(b, (F.col("a.direction") == F.col("b.direction")) & (F.col("a.stratum") == F.col("b.stratum")) & (F.col("a.loop_id") < F.col("b.loop_id")))
    return joined.select(F.col("a.stratum").alias("stratum"), F.col("a.direction").alias("direction"), F.col("a.loop_id").alias("loop_a"), F.col("b.loop_id").alias("loop_b"), path_distance(F.col("a.pts"), F.col("b.pts")).alias("distance"))
