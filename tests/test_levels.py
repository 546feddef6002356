"""Levels of null models against means by hand."""

import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from angleweave.functions import basins, potential
from angleweave.operators import chains, generators, levels, nulls


def test_levels_by_hand(spark):
    few = spark.range(1, 7).withColumnRenamed("id", "chain_id")
    res = generators.mixture(few.select("chain_id", F.explode(F.sequence(F.lit(1), F.when(F.col("chain_id") == 6, 20).otherwise(50 + 3 * F.col("chain_id")))).alias("pos")))
    res = res.withColumn("pos", F.col("pos").cast("int")).withColumn("organism", F.lit("x")).withColumn("basin", basins.basin(F.col("phi"), F.col("psi"))).cache()
    grid = potential.grid_table(spark, potential.build()).cache()
    found = {r.chain_id: r for r in levels.decomposed(res, grid, trials=3).collect()}
    assert sorted(found) == [1, 2, 3, 4, 5]

    def value(rows):
        steps = chains.stepped(potential.with_bilinear(rows.withColumn("organism", F.lit("x")), grid))
        return {r.chain_id: r.bps_norm for r in chains.roughness(steps).collect()}

    real = value(res)
    for name, f in (("shuffled", nulls.shuffled), ("segment", nulls.basin_pools)):
        rows = f(res.where("chain_id < 6"), 3).cache()
        each = [value(rows.where(F.col("trial") == t).drop("trial")) for t in range(3)]
        for c, r in found.items():
            assert r[name] == pytest.approx(sum(e[c] for e in each) / 3) and r.real == pytest.approx(real[c])
    for c, r in found.items():
        labels = [x.basin for x in res.where(F.col("chain_id") == c).orderBy("pos").collect()]
        runs = 1 + sum(a != b for a, b in zip(labels, labels[1:]))
        assert (r.n_residues, r.n_segments) == (len(labels), runs) and r.mean_segment == pytest.approx(len(labels) / runs) and r.alpha == pytest.approx(labels.count("alpha") / len(labels))
        assert r.markov1 > 0 and r.markov2 > 0
    share = levels.shares(levels.decomposed(res, grid, levels.THREE, 2), levels.THREE).first()
    assert share.chains == 5 and share.segment_pct == pytest.approx(100 * (share.shuffled - share.segment) / (share.shuffled - share.real))


def drawn_one_by_one(rows, trials, order, seed=42):
    """The Markov null with one call of choice() a draw."""
    labels, n = [r.basin for r in rows], len(rows)
    names = sorted({*labels})
    follow = defaultdict(Counter)
    for k in range(order, n):
        follow[tuple(labels[k - order : k])][labels[k]] += 1
    pools = {b: np.array([k for k in range(n) if labels[k] == b]) for b in names}
    for t in range(trials):
        rng = np.random.default_rng([seed, order, t, zlib.crc32(str(rows[0].chain_id).encode())])
        path = labels[:order]
        while len(path) < n:
            c = follow.get(tuple(path[-order:]))
            path.append(names[rng.integers(len(names))] if not c else str(rng.choice([*c], p=np.array([*c.values()]) / sum(c.values()))))
        for r, b, k in zip(rows, path, [rng.choice(pools[b]) for b in path]):
            yield r.chain_id, t, r.pos, b, rows[k].phi, rows[k].psi


def test_markov_draws_are_those_of_choice_and_fast(spark):
    rng = np.random.default_rng(4)
    res = [(c, "x", p, str(rng.choice(["alpha", "beta", "other"][: 1 + c % 3])), float(c), float(p)) for c, n in ((1, 3), (2, 40), (3, 97), (5, 60), (6, 1)) for p in range(1, n + 1)]
    df = spark.createDataFrame(res, "chain_id bigint, organism string, pos int, basin string, phi double, psi double")
    rows = df.orderBy("chain_id", "pos").collect()
    for order in (1, 2):
        want = [x for c in (1, 2, 3, 5) for x in drawn_one_by_one([r for r in rows if r.chain_id == c], 3, order)]
        have = [(r.chain_id, r.trial, r.pos, r.basin, r.phi, r.psi) for r in nulls.markov(df.where("chain_id <> 6"), 3, order).collect()]
        assert sorted(have) == sorted(want)
    # 300 chains of 100 residues in 100 trials: 6 million draws, which took minutes one call at a time.
    many = spark.range(300).selectExpr("id as chain_id", "'x' as organism", "explode(sequence(1, 100)) as pos").withColumn("pos", F.col("pos").cast("int"))
    many = many.withColumn("basin", F.element_at(F.array(*map(F.lit, ("alpha", "beta", "other"))), (F.pmod(F.xxhash64("chain_id", "pos"), F.lit(3)) + 1).cast("int"))).withColumns({"phi": F.lit(0.0), "psi": F.lit(0.0)})
    began = time.time()
    assert nulls.markov(many, 100).count() == 3_000_000 and time.time() - began < 30
