"""Steps that grow with the table: copies as classes, chains side by side, many families."""

import numpy as np
from pyspark.sql import functions as F

from angleweave.functions import geometry
from angleweave.operators import families, generators, loops


def _paths(spark, copies):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(24):
        base = rng.uniform(-3, 3, 2) if k % 6 == 0 else base
        path = base + rng.normal(0, 0.08, (families.POINTS, 2))
        rows += [(f"g{k % 2}", f"{c}:{k:02d}", [(float(p), float(s)) for p, s in path]) for c in range(copies)]
    return spark.createDataFrame(rows, "g string, id string, pts array<struct<phi: double, psi: double>>")


def test_copies_meet_once_and_change_nothing(spark):
    """F1, F15-F18, F20, F23, F24, F26."""
    df = _paths(spark, 4).cache()
    found = families.classes(df).cache()
    one = families.folded(found, "pts").cache()
    assert one.count() == 24 and one.agg(F.sum("m")).first()[0] == 96
    pairs = families.near_pairs(one, 0.5)
    every = families.near_pairs(df, 0.5)
    assert pairs.count() < every.count() / 10
    for how in ({}, {"fallback": "noise", "least": 5}, {"fallback": "last", "least": 9}):
        want = {(r.g, r.id): (r.eps, r.clusters, r.cluster) for r in families.search(df, every, **how).collect()}
        have = found.join(families.search(one, pairs, **how).withColumnRenamed("id", "rep"), ["g", "rep"])
        assert {(r.g, r.id): (r.eps, r.clusters, r.cluster) for r in have.collect()} == want
    assert any(c >= 0 for _, _, c in want.values())


def test_components_both_ways(spark):
    links = spark.createDataFrame([(f"{k:03d}", f"{k + 1:03d}") for k in range(60) if k % 7] + [("000", "060")], "a string, b string").repartition(5)
    found = [{r.node: r.component for r in families.components(links, local=n).collect()} for n in (0, 1000)]
    assert found[0] == found[1] and len(found[0]) == 61


def test_distances_of_classes_and_their_copies(spark):
    """F13."""
    path = lambda x: [(p, "A", x + 0.1 * p, -x, 0.0, "ALA") for p in (1, 2, 3)]
    rows = [(c, 4, "alpha->beta", 3, path(x)) for c, x in ((1, 0.1), (2, 0.5), (3, 0.1), (4, 2.0))]
    df = spark.createDataFrame(rows, "chain_id bigint, start int, direction string, length int, path array<struct<pos: int, letter: string, phi: double, psi: double, w: double, resname: string>>")
    want = {(r.loop_a, r.loop_b): r.distance for r in loops.distances(df).collect()}
    have = {(r.loop_a, r.loop_b): r.distance for r in families.class_distances(df).collect()}
    assert set(have) == {("1:4", "2:4"), ("1:4", "4:4"), ("2:4", "4:4"), ("1:4", "3:4")}
    assert all(abs(want[k] - v) < 1e-9 for k, v in have.items())


def test_forest_of_more_than_a_hundred_families(spark):
    """Spark infers a hundred classes at most."""
    rows = [(f"f{k:03d}", f"{k}:{c}", float(k), float(c)) for k in range(110) for c in range(3)]
    found = families.forest(spark.createDataFrame(rows, "family string, id string, f0 double, f1 double"), "family", ["f0", "f1"], trees=2)
    assert found.agg(F.sum("n")).first()[0] == 330


def test_chains_side_by_side_equal_single_ones():
    """F11, F25, F28, F29."""
    sizes, rng = [1, 2, 40, 7, 40], np.random.default_rng(3)
    rngs = lambda: [np.random.default_rng(generators.chain_seed(k)) for k in range(len(sizes))]
    for bonded, tries in ((False, 50), (True, 4)):
        pairs, counts = generators.steric_walks(sizes, rngs(), tries, bonded=bonded)
        for n, r, p, c in zip(sizes, rngs(), pairs, counts):
            want, times = generators.steric_walk(n, r, tries, bonded=bonded)
            assert np.allclose(p, want, atol=1e-12) and [tuple(x) for x in c] == times
    phi, psi, at = rng.uniform(-3, 3, sum(sizes)), rng.uniform(-3, 3, sum(sizes)), np.cumsum([0, *sizes])
    x = geometry.build_many(phi, psi, sizes)
    one = [geometry.build(phi[a:b], psi[a:b]) for a, b in zip(at, at[1:])]
    assert np.allclose(x, np.concatenate(one), atol=1e-9)
    p, q = x[:, 1], x[:, 1] + rng.normal(size=(len(x), 3))
    r = geometry.superposed_many(p, q, sizes)
    assert np.isnan(r[:2]).all() and np.allclose(r[2:], [geometry.superposed_rmsd(p[a:b], q[a:b]) for a, b in zip(at[2:], at[3:])])


def test_generators_run_in_many_tasks(spark):
    few = spark.range(40).select(F.col("id").alias("chain_id"), F.lit(5).alias("length")).groupBy("chain_id").agg(F.first("length").alias("length"))
    for made in (generators.steric(few), generators.steric_attempts(few)):
        assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_weighted_vectors_equal_copies(spark):
    """a class of equal vectors goes through the rounds as one row."""
    from angleweave.operators import density

    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.1, (60, 2)) for c in (0.0, 3.0)] + [rng.uniform(-9, 9, (20, 2))])
    rows = [(0, k * 10 + c, float(a), float(b)) for k, (a, b) in enumerate(x) for c in range(1 + k % 3)]
    df = spark.createDataFrame(rows, "g int, id bigint, a double, b double")
    want = {r.id: r.label for r in density.clustered(df, ["a", "b"], 50, 10).collect()}
    one = df.groupBy("g", "a", "b").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("m"))
    have = {r.id: r.label for r in density.clustered(one, ["a", "b"], 50, 10).collect()}
    assert len(set(want.values())) == 3 and all(have[k - k % 10] == v for k, v in want.items()) and len(have) == len(x)


def test_classifier_is_fitted_on_every_trusted_document_of_its_half():
    """no bound unless one is asked for."""
    import inspect

    from angleweave.llm import quality_classifier

    for f in (quality_classifier.fit, quality_classifier.classified):
        assert inspect.signature(f).parameters["train_docs"].default is None


def test_angles_look_at_each_neighbour_once(spark):
    """one window function for each coordinate of the atom before and of the one after."""
    from angleweave.operators import kinematics

    atoms = spark.createDataFrame([], "chain_id bigint, pos int, " + ", ".join(f"{a}{d} double" for a in ("n", "ca", "c") for d in "xyz"))
    plan = kinematics.angles(atoms)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lag(") == plan.count("lead(") == 3


def test_both_reconstructions_meet_the_truth_together(spark):
    """the deviations of each, in one pass over chains; places, chains and coordinates may be missing."""
    from angleweave.operators import kinematics

    rng = np.random.default_rng(9)
    cols = "chain_id bigint, pos int, cax double, cay double, caz double"
    made = lambda drop: spark.createDataFrame([(c, k, *map(float, rng.normal(size=3))) for c, n in ((1, 30), (2, 2), (3, 12), (4, 9), (5, 8)) for k in range(n) if (c, k) not in drop], cols)
    truth, a, b = made({(1, 3)}), made({(1, 7), (3, 0)} | {(4, k) for k in range(9)}), made({(3, 5), (1, 29)})
    b = b.withColumn("cax", F.when((F.col("chain_id") != 5) | (F.col("pos") != 2), F.col("cax")))
    found = kinematics.compared(truth, a, b)
    have = {r.chain_id: (r.observed, r.canonical, r.delta) for r in found.collect()}
    one, two = ({r.chain_id: r.rmsd for r in kinematics.deviations(truth, x).collect()} for x in (a, b))
    assert set(have) == {1, 2, 3, 5} and have[2] == (None, None, None) and have[5][1:] == (None, None)
    assert all(have[c][:2] == (one[c], two[c]) for c in have) and all(have[c][2] == two[c] - one[c] for c in (1, 3))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def test_nearest_paths_are_measured_in_blocks(spark, monkeypatch):
    """many families and asking paths; ties go to the first name, an undefined path is near none."""
    from angleweave.operators import kinematics

    met, blocks = families.met, []
    monkeypatch.setattr(families, "BLOCK", 8)
    monkeypatch.setattr(families, "MEASURED", 20)
    monkeypatch.setattr(families, "met", lambda *a: blocks.append(met(*a)) or blocks[-1])
    rng = np.random.default_rng(4)
    wide = [rng.uniform(-3, 3, (families.POINTS, 2)) for _ in range(30)]
    library, asked = [*wide, wide[5]], [wide[5], *[wide[k % 30] + rng.normal(0, 0.1, wide[0].shape) for k in range(20)], *[rng.uniform(-3, 3, wide[0].shape) for _ in range(9)]]
    kind, path = "array<struct<phi:double,psi:double>>", lambda x: [(float(a), float(b)) for a, b in x]
    lib = spark.createDataFrame([(f"f{99 - k}", path(x)) for k, x in enumerate(library)], f"family string, pts {kind}")
    ask = spark.createDataFrame([(k, path(x)) for k, x in enumerate(asked)] + [(99, path([(np.nan, 0.0)] * families.POINTS))], f"q int, pts {kind}")
    found = {r.q: r for r in kinematics.nearest_paths(ask, ["q"], lib).collect()}
    turn = lambda d: np.arctan2(np.sin(d), np.cos(d))
    far = [[np.sqrt((turn(x - y) ** 2).sum(axis=1)).mean() for y in library] for x in asked]
    assert set(found) == set(range(len(asked))) and found[0].family == "f69" and found[0].distance == 0
    assert all(abs(found[k].distance - min(d)) < 1e-9 and (k == 0 or d[99 - int(found[k].family[1:])] == min(d)) for k, d in enumerate(far))
    assert blocks and max(b.rdd.getNumPartitions() for b in blocks) > 1
