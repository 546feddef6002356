"""Null models whose draws are hashes of (chain, model, trial, pos): no result depends on partitioning.

Joins of rows with rows are merge joins by hint: trials multiply the rows, which Spark's estimate does not see, so that it would broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .chains import segments
from .shared import chainwise


def key(model: str, *parts: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(model), *[F.col(p).cast("string") for p in parts]))


def draw(model: str, *parts: str) -> Column:
    """An integer from the first eight hex digits."""
    return F.conv(F.substring(key(model, *parts), 1, 8), 16, 10).cast("bigint")


def with_trials(res: DataFrame, trials: int) -> DataFrame:
    return res.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))


def _reordered(rows: DataFrame, group: list[str], model: str) -> DataFrame:
    by = Window.partitionBy(*group)
    ranked = rows.withColumn("slot", F.row_number().over(by.orderBy("pos"))).withColumn("rank", F.row_number().over(by.orderBy(key(model, "chain_id", "trial", "pos"), "pos")))
    values = ranked.select(*group, F.col("rank").alias("slot"), F.col("phi").alias("new_phi"), F.col("psi").alias("new_psi"))
    return ranked.drop("rank").join(values.hint("merge"), [*group, "slot"]).drop("slot", "phi", "psi").withColumnRenamed("new_phi", "phi").withColumnRenamed("new_psi", "psi")


def shuffled(res: DataFrame, trials: int = 1) -> DataFrame:
    """The chain's pairs in hash order."""
    return _reordered(with_trials(res, trials), ["chain_id", "trial"], "M01")


def segment_shuffled(res: DataFrame, trials: int = 1) -> DataFrame:
    """Pairs change places inside their segment. res carries basin."""
    runs = segments(res).select("chain_id", "seg", "start", "end")
    places = runs.select("chain_id", "seg", F.explode(F.sequence("start", "end")).alias("pos"))
    inner = res.join(places.hint("merge"), ["chain_id", "pos"]).select(*res.columns, "seg")
    return _reordered(with_trials(inner, trials), ["chain_id", "trial", "seg"], "M03")


def basin_pools(res: DataFrame, trials: int = 1) -> DataFrame:
    """Every residue takes a pair of its chain's pool of the same basin, with replacement."""
    by = Window.partitionBy("chain_id", "basin")
    pool = res.select("chain_id", "basin", (F.row_number().over(by.orderBy("pos")) - 1).alias("pick"), F.col("phi").alias("new_phi"), F.col("psi").alias("new_psi"))
    asked = with_trials(res.withColumn("size", F.count(F.lit(1)).over(by)), trials).withColumn("pick", F.pmod(draw("M02", "chain_id", "trial", "pos"), F.col("size")).cast("int"))
    return asked.drop("phi", "psi", "size").join(pool.hint("merge"), ["chain_id", "basin", "pick"]).drop("pick").withColumnRenamed("new_phi", "phi").withColumnRenamed("new_psi", "psi")


def local_windows(res: DataFrame, k: int = 5, trials: int = 1) -> DataFrame:
    """A pair of the same basin within k places; with fewer than two candidates the chain's pool."""
    # Every residue asks for the 2 k + 1 places around it.
    near = res.select("chain_id", "basin", F.col("pos").alias("p"), F.col("phi").alias("f"), F.col("psi").alias("s"))
    asked = res.select("chain_id", "basin", "pos", F.explode(F.sequence(F.col("pos") - k, F.col("pos") + k)).alias("p"))
    local = asked.join(near.hint("merge"), ["chain_id", "basin", "p"]).groupBy("chain_id", "pos").agg(F.array_sort(F.collect_list(F.struct("p", "f", "s"))).alias("near"))
    whole = basin_pools(res, trials).select("chain_id", "trial", "pos", F.col("phi").alias("pool_phi"), F.col("psi").alias("pool_psi"))
    rows = with_trials(res.join(local.hint("merge"), ["chain_id", "pos"]), trials).withColumn("one", F.get("near", F.pmod(draw("M05", "chain_id", "trial", "pos"), F.size("near")).cast("int")))
    rows = rows.join(whole.hint("merge"), ["chain_id", "trial", "pos"])
    few = F.size("near") < 2
    return rows.withColumn("phi", F.when(few, F.col("pool_phi")).otherwise(F.col("one.f"))).withColumn("psi", F.when(few, F.col("pool_psi")).otherwise(F.col("one.s"))).drop("near", "one", "pool_phi", "pool_psi")


def markov(res: DataFrame, trials: int = 1, order: int = 1, seed: int = 42) -> DataFrame:
    """A Markov chain of basins from the chain's own counts; an unseen context draws uniformly. Pairs come from the chain's pools."""

    def run(pdf):
        import zlib
        from bisect import bisect_right
        from collections import Counter, defaultdict

        import numpy as np
        import pandas as pd

        pdf = pdf.reset_index(drop=True)
        labels, n = pdf["basin"].tolist(), len(pdf)
        names = sorted({*labels})
        follow = defaultdict(Counter)
        for k in range(order, n):
            follow[tuple(labels[k - order : k])][labels[k]] += 1
        pools, out = {b: pdf.index[pdf["basin"] == b].to_numpy() for b in names}, []
        # What Generator.choice() does for every draw, with the running shares made once a context.
        edges = {}
        for context, c in follow.items():
            shares = (np.array([*c.values()]) / sum(c.values())).cumsum()
            edges[context] = ([*c], (shares / shares[-1]).tolist())
        phi, psi = pdf["phi"].to_numpy(), pdf["psi"].to_numpy()
        for t in range(trials):
            rng = np.random.default_rng([seed, order, t, zlib.crc32(str(pdf["chain_id"].iloc[0]).encode())])
            path = labels[:order]
            while len(path) < n:
                to = edges.get(tuple(path[-order:]))
                path.append(names[rng.integers(len(names))] if to is None else to[0][bisect_right(to[1], rng.random())])
            place = rng.integers(0, np.array([len(pools[b]) for b in path]))
            at = np.array([pools[b][k] for b, k in zip(path, place)])
            out.append(pd.DataFrame({"chain_id": pdf["chain_id"].to_numpy(), "organism": pdf["organism"].to_numpy(), "trial": t, "pos": pdf["pos"].to_numpy(), "basin": path, "phi": phi[at], "psi": psi[at]}))
        return pd.concat(out)

    return chainwise(res.select("chain_id", "organism", "pos", "basin", "phi", "psi"), run, "chain_id bigint, organism string, trial int, pos int, basin string, phi double, psi double")
