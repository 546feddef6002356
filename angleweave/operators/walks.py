"""Neighbour walks over whole pools (M09): every step goes to the successor of one of the k nearest pairs of the organism.

The neighbour that a step takes is drawn before it is searched, so only that one is searched, exactly, and no list of neighbours is
kept. All walks of all chains and all k take their steps together: a step moves the walks to the blocks of pairs that surround their places
(places.py); the pairs stay where they are. No pool is sampled, broadcast or gathered.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .chains import order
from .generators import nearest
from .places import Ground, blocks
from .shared import kept, shared_dir

BUCKETS = 64
#: Positions of a chain are below this.
PLACES = 100_000
#: Neighbours that a sweep tries; percentage points below which the result is robust, and moderately sensitive.
SWEEP = (5, 10, 20, 50, 100, 200)
ROBUST, MODERATE = 10.0, 25.0


def _id(chain: str, pos: str) -> Column:
    return (F.col(chain) * PLACES + F.col(pos)).cast("bigint")


def successor_lists(res: DataFrame, k: int) -> DataFrame:
    """organism, id, succ: for every residue the successors of its organism's k nearest pairs, nearest first; fewer where there are fewer."""
    whole = F.col("phi").isNotNull() & F.col("psi").isNotNull()
    after = lambda c: F.lead(c).over(order())
    pairs = res.select("organism", "chain_id", "phi", "psi", after("pos").alias("pos"), (after("phi").isNotNull() & after("psi").isNotNull()).alias("followed")).where(whole & F.col("followed"))
    asked = res.where(whole).select(_id("chain_id", "pos").alias("query_id"), "organism", "phi", "psi")
    near = nearest(asked, pairs.drop("followed"), k).select("query_id", "rank", _id("chain_id", "pos").alias("next"))
    lists = near.groupBy(F.col("query_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "next"))), lambda x: x["next"]).alias("succ"))
    return kept(lists, "walk-lists")


def starts(res: DataFrame, walks: DataFrame) -> DataFrame:
    """Adds at: a residue with a successor, drawn uniformly from the organism's. walks: k, chain_id, organism. Organisms without one drop out."""
    after = F.lead("phi").over(order()).isNotNull() & F.lead("psi").over(order()).isNotNull()
    pool = res.withColumn("followed", after).where("phi is not null and psi is not null and followed").select("organism", _id("chain_id", "pos").alias("at"))
    pool = kept(pool.withColumn("bucket", F.pmod(F.xxhash64(F.lit("M09"), "at"), F.lit(BUCKETS)).cast("int")), "walk-pool")
    sizes = pool.groupBy("organism", "bucket").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("organism")
    places = kept(sizes.withColumn("before", F.sum("n").over(by.orderBy("bucket")) - F.col("n")).withColumn("total", F.sum("n").over(by)), "walk-sizes")
    totals = places.select("organism", "total").distinct()
    drawn = walks.join(totals, "organism").withColumn("draw", F.pmod(F.xxhash64(F.lit("M09 start"), "chain_id", "k"), F.col("total")))
    # An organism has at most BUCKETS rows of places.
    found = drawn.join(places.drop("total"), "organism").where((F.col("before") <= F.col("draw")) & (F.col("draw") < F.col("before") + F.col("n")))
    numbered = pool.withColumn("place", F.row_number().over(Window.partitionBy("organism", "bucket").orderBy("at")) - 1)
    return found.withColumn("place", F.col("draw") - F.col("before")).join(numbered, ["organism", "bucket", "place"]).select(*walks.columns, "at")


def grounds(res: DataFrame, most: int) -> DataFrame:
    """g, chain_id, pos, phi, psi, next_phi, next_psi: every pair of a residue and its successor (pos); of equal pairs of angles of an organism the first `most`."""
    whole = F.col("phi").isNotNull() & F.col("psi").isNotNull()
    after = lambda c: F.lead(c).over(order())
    pairs = res.select(F.col("organism").alias("g"), "chain_id", "phi", "psi", after("pos").alias("pos"), after("phi").alias("next_phi"), after("psi").alias("next_psi"))
    pairs = pairs.where(whole & F.col("g").isNotNull() & F.col("next_phi").isNotNull() & F.col("next_psi").isNotNull())
    first = Window.partitionBy("g", "phi", "psi").orderBy("chain_id", "pos")
    return kept(pairs.withColumn("r", F.row_number().over(first)).where(F.col("r") <= most).drop("r"), "walk-pairs")


STEP = "k int, chain_id bigint, organism string, length int, block bigint, phi double, psi double"


def _held(shared):
    def run(batches):
        for b in batches:
            rows, block = shared.value.holders(b["g"].to_numpy(), b["phi"].to_numpy(), b["psi"].to_numpy())
            yield b.drop(columns="g").iloc[rows].assign(block=block)

    return run


def _placed(shared):
    def run(batches):
        for b in batches:
            yield b.assign(block=shared.value.of(b["organism"].to_numpy(), b["phi"].to_numpy(), b["psi"].to_numpy()))

    return run


def _stepped(shared):
    """Every walk of a block goes on to the successor of the pair that is its rank-th nearest."""

    def run(held, asks):
        import numpy as np

        if not len(held) or not len(asks):
            return asks.iloc[:0].drop(columns="rank")
        ground = Ground(shared.value, int(asks["block"].iloc[0]), *(held[c].to_numpy() for c in ("phi", "psi", "chain_id", "pos")))
        at = ground.nearest(asks["phi"].to_numpy(), asks["psi"].to_numpy(), asks["rank"].to_numpy(np.int64))
        phi, psi = held["next_phi"].to_numpy()[at], held["next_psi"].to_numpy()[at]
        return asks.drop(columns="rank").assign(phi=phi, psi=psi, block=shared.value.of(asks["organism"].to_numpy(), phi, psi))

    return run


def neighbour_walks(res: DataFrame, chains: DataFrame, ks: tuple[int, ...] = (50,)) -> DataFrame:
    """k, chain_id, organism, pos, phi, psi: a walk of every chain's length for every k. res: residues; chains: chain_id, organism, length.

    A chain of an organism without a pair has no walk; k beyond the number of pairs means all of them.
    """
    spark, most = res.sparkSession, max(ks)
    walks = chains.select("chain_id", "organism", F.col("length").cast("int").alias("length"), F.explode(F.array(*map(F.lit, ks))).alias("k")).where("length > 0")
    res = kept(res.select("chain_id", "organism", "pos", "phi", "psi"), "walk-residues")
    pairs = grounds(res, most)
    found = blocks(pairs, res.where("organism is not null and phi is not null and psi is not null").select(F.col("organism").alias("g"), "phi", "psi"), most)
    shared = spark.sparkContext.broadcast(found)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A stated number of partitions, sorted once, as Spark would else deal and sort the pairs anew at every step.
    held = pairs.mapInPandas(_held(shared), "chain_id bigint, pos int, phi double, psi double, next_phi double, next_psi double, block bigint")
    held = held.repartition(n, "block").sortWithinPartitions("block").persist(StorageLevel.MEMORY_AND_DISK)
    root, longest = f"{shared_dir(spark)}/angleweave/walks-{uuid.uuid4().hex}", walks.agg(F.max("length")).first()[0] or 0
    angles = res.select(_id("chain_id", "pos").alias("at"), "phi", "psi")
    begun = starts(res, walks).join(angles, "at").select("k", "chain_id", "organism", "length", F.lit(0).cast("bigint").alias("block"), "phi", "psi")
    begun.mapInPandas(_placed(shared), STEP).write.parquet(f"{root}/pos=1")
    # As the lists would be: all pairs where an organism has fewer than k.
    sizes = pairs.groupBy("g").agg(F.count(F.lit(1)).alias("pairs"))
    few = F.broadcast(kept(sizes.withColumnRenamed("g", "organism"), "walk-totals"))
    try:
        for t in range(2, longest + 1):
            now = spark.read.schema(STEP).parquet(f"{root}/pos={t - 1}").where(F.col("length") >= t).join(few, "organism")
            rank = F.pmod(F.xxhash64(F.lit("M09 step"), "chain_id", "k", F.lit(t)), F.least("k", "pairs").cast("int"))
            asks = now.select("k", "chain_id", "organism", "length", "block", "phi", "psi", rank.alias("rank"))
            held.groupBy("block").cogroup(asks.groupBy("block")).applyInPandas(_stepped(shared), STEP).write.parquet(f"{root}/pos={t}")
    finally:
        held.unpersist()
    return spark.read.schema(STEP + ", pos int").parquet(root).select("k", "chain_id", "organism", "pos", "phi", "psi")


def k_sweep(real: DataFrame, walked: DataFrame) -> DataFrame:
    """Organism, k, n, real_mean, real_sd, markov_mean, markov_sd, gap_pct. real: chain_id, organism, value; walked: also k."""
    one = lambda df, name, *by: df.groupBy("organism", *by).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias(f"{name}_mean"), F.stddev_pop("value").alias(f"{name}_sd"))
    both = one(walked, "markov", "k").join(one(real, "real").drop("n"), "organism")
    gap = F.when(F.col("real_mean") > 0, 100 * (F.col("markov_mean") - F.col("real_mean")) / F.col("real_mean")).otherwise(0.0)
    return both.select("organism", "k", "n", "real_mean", "real_sd", "markov_mean", "markov_sd", gap.alias("gap_pct"))


def sweep_verdict(sweep: DataFrame) -> DataFrame:
    """least_gap, most_gap (of the organisms' mean gaps by k), their range and the verdict on it."""
    means = sweep.groupBy("k").agg(F.avg("gap_pct").alias("gap"))
    out = means.agg(F.min("gap").alias("least_gap"), F.max("gap").alias("most_gap")).withColumn("gap_range", F.col("most_gap") - F.col("least_gap"))
    return out.withColumn("verdict", F.when(F.col("gap_range") < ROBUST, "robust").when(F.col("gap_range") < MODERATE, "moderate").otherwise("sensitive"))
