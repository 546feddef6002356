"""Neighbour walks, contacts, resampling and draws from observed cells against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from angleweave.operators import chains, generators, kinematics, nulls, stats, walks
from angleweave.operators.shared import kept


@pytest.fixture(scope="module")
def res(spark):
    rng = np.random.default_rng(11)
    rows = [(c, "xyz"[c % 3 if c < 12 else 2], p, float(a), float(b)) for c in range(13) for p, (a, b) in enumerate(rng.uniform(-np.pi, np.pi, (30 + c if c != 12 else 1, 2)), 1)]
    rows = [(c, "w" if c == 12 else o, p, None if (c, p) in ((1, 1), (2, 9)) else a, b) for c, o, p, a, b in rows]
    return spark.createDataFrame(rows, "chain_id bigint, organism string, pos int, phi double, psi double").cache()


def pairs_of(rows):
    at = {(r.chain_id, r.pos): r for r in rows}
    return [r for r in rows if r.phi is not None and (n := at.get((r.chain_id, r.pos + 1))) is not None and n.phi is not None]


def embed(r):
    return np.array([np.cos(r.phi), np.sin(r.phi), np.cos(r.psi), np.sin(r.psi)])


def test_lists_hold_the_successors_of_the_nearest_pairs(res):
    rows = res.collect()
    have = {r.id: r.succ for r in walks.successor_lists(res, 9).collect()}
    for r in rows:
        key = r.chain_id * walks.PLACES + r.pos
        pool = [p for p in pairs_of(rows) if p.organism == r.organism]
        if r.phi is None or not pool:
            assert key not in have
            continue
        near = sorted(pool, key=lambda p: ((embed(p) - embed(r)) ** 2).sum())[:9]
        assert have[key] == [p.chain_id * walks.PLACES + p.pos + 1 for p in near]


def test_walks_step_to_successors_of_neighbours(spark, res):
    rows = res.collect()
    lengths = res.groupBy("chain_id", "organism").agg(F.count(F.lit(1)).cast("int").alias("length"))
    found = walks.neighbour_walks(res, lengths, (4, 9)).collect()
    assert len(found) == 2 * sum(30 + c for c in range(12))  # the organism of one residue has no pair, hence no walk
    own = {(r.organism, r.phi, r.psi): r for r in rows if r.phi is not None}
    lists = {k: {r.id: set(r.succ) for r in walks.successor_lists(res, k).collect()} for k in (4, 9)}
    at = {(r.k, r.chain_id, r.pos): own[r.organism, r.phi, r.psi] for r in found}
    name = lambda r: r.chain_id * walks.PLACES + r.pos
    starts = {name(p) for p in pairs_of(rows)}
    for (k, c, p), r in at.items():
        if p == 1:
            assert name(r) in starts
        else:
            assert name(r) in lists[k][name(at[k, c, p - 1])]
    again = walks.neighbour_walks(res.repartition(3), lengths.repartition(5), (4, 9)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_starts_and_steps_are_even(spark, res):
    """Many walks: every pair of the organism starts equally often, every neighbour is taken equally often."""
    many = spark.range(20_000).select((F.col("id") + 100).alias("chain_id"), F.lit("x").alias("organism"), F.lit(2).alias("length"))
    found = walks.starts(res, many.select("chain_id", "organism", F.lit(3).alias("k"))).groupBy("at").count().collect()
    pool = [p for p in pairs_of(res.collect()) if p.organism == "x"]
    each = 20_000 / len(pool)
    assert len(found) == len(pool) and all(abs(r["count"] - each) < 5 * each**0.5 for r in found)
    lists = {r.id: r.succ for r in walks.successor_lists(res, 3).collect()}
    both = walks.neighbour_walks(res, many, (3,))
    one, two = both.where("pos = 1").alias("a"), both.where("pos = 2").alias("b")
    angles = res.select((F.col("chain_id") * walks.PLACES + F.col("pos")).alias("at"), "phi", "psi")
    place = lambda df, n: df.join(angles, ["phi", "psi"]).select(F.col("chain_id"), F.col("at").alias(n))
    seen = place(one.select("a.*"), "one").join(place(two.select("b.*"), "two"), "chain_id").groupBy("one", "two").count().collect()
    ranks = np.zeros(3)
    for r in seen:
        ranks[lists[r.one].index(r.two)] += r["count"]
    assert ranks.sum() == 20_000 and (abs(ranks - 20_000 / 3) < 5 * (20_000 * 2 / 9) ** 0.5).all()


def test_sweep(spark):
    real = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 4.0)], "organism string, value double")
    walked = spark.createDataFrame([("x", 5, 3.0), ("x", 9, 2.0), ("y", 5, 4.0), ("y", 9, 4.4)], "organism string, k int, value double")
    sweep = walks.k_sweep(real, walked)
    got = {(r.organism, r.k): (r.real_mean, r.real_sd, r.gap_pct) for r in sweep.collect()}
    assert got["x", 5] == (2.0, 1.0, 50.0) and got["x", 9][2] == 0.0 and got["y", 9][2] == pytest.approx(10)
    v = walks.sweep_verdict(sweep).first()
    assert (v.least_gap, v.most_gap, v.verdict) == (pytest.approx(5), 25.0, "moderate")


def test_contacts_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    x = {c: np.cumsum(rng.normal(0, 2.2, (n, 3)), axis=0) - 5 for c, n in ((1, 220), (2, 3), (3, 60))}
    x[4] = np.arange(12)[:, None] * np.array([[100.0, 0, 0]])
    x[5] = np.zeros((9, 3))
    rows = [(c, p, *map(float, v)) for c, v_ in x.items() for p, v in enumerate(v_, 1)]
    atoms = spark.createDataFrame(rows, "chain_id bigint, pos int, cax double, cay double, caz double")
    want = {(c, i + 1, j + 1): np.linalg.norm(v[i] - v[j]) for c, v in x.items() for i in range(len(v)) for j in range(i + 4, len(v)) if np.linalg.norm(v[i] - v[j]) < 8}
    have = {(r.chain_id, r.a, r.b): r.distance for r in kinematics.contacts(atoms).collect()}
    assert have.keys() == want.keys() and len(want) > 500 and all(abs(have[k] - want[k]) < 1e-9 for k in want)
    shape = {r.chain_id: r for r in kinematics.shape(atoms).collect()}
    for c, v in x.items():
        mine = [k for k in want if k[0] == c]
        order = sum(b - a for _, a, b in mine) / (len(v) * len(mine)) if len(v) >= 5 and mine else None
        assert shape[c].contact_order == (pytest.approx(order) if order is not None else None)
        assert shape[c].rg == pytest.approx(np.sqrt(((v - v.mean(axis=0)) ** 2).sum(axis=1).mean()))
    p = chains.proteins(spark.createDataFrame([(1, "o", k, 0.1 * k, -0.1 * k, -0.5, 80.0) for k in range(1, 9)], "chain_id bigint, organism string, pos int, phi double, psi double, w double, plddt double"), kinematics.shape(atoms)).first()
    assert p.rg == shape[1].rg and p.contact_order == shape[1].contact_order


def test_resampling_agrees_with_the_exact_resampler(spark):
    rng = np.random.default_rng(7)
    x = {"a": rng.gamma(2, 1, 150), "b": rng.normal(5, 2, 400), None: np.array([1.0, 1.0, 4.0])}
    rows = [(f"{g}{k}", g, float(v)) for g, vs in x.items() for k, v in enumerate(vs)] + [("z", "a", None)]
    df = spark.createDataFrame(rows, "chain_id string, g string, v double").repartition(7)
    found = {r.g: r for r in stats.bootstrap_mean(df, "g", "v", 4000).collect()}
    for g in ("a", "b"):
        v = x[g]
        exact = np.percentile(v[rng.integers(0, len(v), (20_000, len(v)))].mean(axis=1), [2.5, 97.5])
        sd = v.std() / len(v) ** 0.5
        assert found[g].n == len(v) and found[g].mean == pytest.approx(v.mean())
        # The error of a 2.5 % quantile of 4,000 draws is about 0.042 standard deviations; the number of rows drawn varies too.
        assert abs(found[g].lo - exact[0]) < 0.2 * sd and abs(found[g].hi - exact[1]) < 0.2 * sd
    assert found[None].n == 3 and 1.0 <= found[None].lo <= 2.0 <= found[None].hi <= 4.0
    assert [tuple(r) for r in stats.bootstrap_mean(df.repartition(2), "g", "v", 50).orderBy("g").collect()][1][3] == pytest.approx([tuple(r) for r in stats.bootstrap_mean(df, "g", "v", 50).orderBy("g").collect()][1][3])


def test_weights_are_poisson():
    w = stats.poisson_weights(np.arange(2000, dtype=np.int64) - 1000, 500, 3)
    share = np.bincount(w.ravel(), minlength=6) / w.size
    want = [np.exp(-1) / f for f in (1, 1, 2, 6, 24)]
    assert all(abs(share[k] - p) < 5 * (p / w.size) ** 0.5 for k, p in enumerate(want))
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.12 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.25


def test_ratio_interval(spark):
    rng = np.random.default_rng(9)
    a, b = rng.gamma(3, 1, 300), rng.gamma(3, 1.2, 250)
    rows = [(k, "real", float(v)) for k, v in enumerate(a)] + [(k, "null", float(v)) for k, v in enumerate(b)]
    r = stats.bootstrap_ratio(spark.createDataFrame(rows, "chain_id bigint, kind string, v double"), "kind", "v", 2000).first()
    exact = b[rng.integers(0, 250, (20_000, 250))].mean(axis=1) / a[rng.integers(0, 300, (20_000, 300))].mean(axis=1)
    assert r.ratio == pytest.approx(b.mean() / a.mean())
    lo, hi = np.percentile(exact, [2.5, 97.5])
    assert abs(r.lo - lo) < 0.2 * exact.std() and abs(r.hi - hi) < 0.2 * exact.std()


def test_observed_cells_are_drawn_as_often_as_seen(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.4, (4000, 2)).clip(-3, 3)
    res = spark.createDataFrame([(1, k, float(a), float(b)) for k, (a, b) in enumerate(x)] + [(1, -1, None, 0.1)], "chain_id bigint, pos int, phi double, psi double")
    times = {(r.gi, r.gj): r.times for r in generators.observed_cells(res, 24).collect()}
    table = generators.alias_table(spark, generators.observed_cells(res, 24)).collect()
    share = dict.fromkeys(times, 0.0)
    for r in table:
        share[r.gi, r.gj] += r.share / len(table)
        share[r.other_gi, r.other_gj] += (1 - r.share) / len(table)
    assert all(share[k] == pytest.approx(n / 4000) for k, n in times.items())
    asked = spark.range(60_000).select((F.col("id") % 300).alias("chain_id"), (F.col("id") / 300).cast("int").alias("pos"))
    drawn = {(r.gi, r.gj): r["count"] for r in generators.from_observed(asked, res, 24).groupBy("gi", "gj").count().collect()}
    assert sum(drawn.values()) == 60_000 and drawn.keys() <= times.keys()
    assert all(abs(drawn.get(k, 0) - 15 * n) < 5 * (15 * n) ** 0.5 + 1 for k, n in times.items())
    assert generators.from_observed(asked, res.limit(0)).count() == 0


def test_chainwise_equals_one_group_a_chain(spark):
    """Chains cut over Arrow batches, a null chain, one longer than a batch, an empty table."""
    from angleweave.operators.shared import chainwise

    rng = np.random.default_rng(3)
    rows = [(c, p, float(rng.normal())) for c, n in ((1, 3), (2, 57), (3, 1), (None, 9), (5, 25)) for p in rng.permutation(n).tolist()]
    df = spark.createDataFrame(rows, "chain_id bigint, pos int, x double")

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("pos")
        return pd.DataFrame({"chain_id": [pdf["chain_id"].iloc[0]], "first": [pdf["pos"].iloc[0]], "n": [len(pdf)], "sum": [float((pdf["x"] * np.arange(len(pdf))).sum())]})

    schema, key = "chain_id bigint, first int, n bigint, sum double", "spark.sql.execution.arrow.maxRecordsPerBatch"
    want = sorted(map(str, df.groupBy("chain_id").applyInPandas(run, schema).collect()))
    was = spark.conf.get(key)
    try:
        for size in ("1", "4", "10000"):
            spark.conf.set(key, size)
            assert sorted(map(str, chainwise(df, run, schema).collect())) == want
        assert chainwise(df.limit(0), run, schema).count() == 0
    finally:
        spark.conf.set(key, was)


def test_row_sized_joins_are_not_broadcast(spark, res):
    """Trials and cells multiply rows unseen by Spark's estimate; at 6 times sf0.1 the broadcast of them ended the driver."""
    # A written table has a size that Spark knows.
    rows = kept(res.withColumn("basin", F.lit("alpha")), "rows")
    atoms = rows.select("chain_id", "pos", *[F.col("phi").alias(f"ca{d}") for d in "xyz"])
    for df in (nulls.shuffled(rows, 3), nulls.basin_pools(rows, 3), nulls.segment_shuffled(rows, 3), nulls.local_windows(rows, 2, 3), kinematics.contacts(atoms)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_clashes_build_the_chains_once(spark):
    """r04 reads its atoms three times; they were rebuilt in Python each time."""
    from angleweave.plans import catalogue, extended  # noqa: F401

    plan = catalogue.QUERIES["r04_clashes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan
