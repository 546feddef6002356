"""Loop families, generators and neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from angleweave.functions.density import hdbscan
from angleweave.operators import families, generators, kinematics, loops, walks


def torus(p, q):
    d = p - q
    return np.sqrt((np.arctan2(np.sin(d), np.cos(d)) ** 2).sum(axis=1)).mean()


@pytest.fixture(scope="module")
def bundle(spark):
    """Forty paths around three courses, some stray ones, in two groups."""
    rng = np.random.default_rng(3)
    courses = [rng.uniform(-3, 3, (families.POINTS, 2)) for _ in range(3)]
    paths = [courses[k % 3] + rng.normal(0, 0.12, (families.POINTS, 2)) * (0.5 + k % 4) for k in range(40)] + [rng.uniform(-3, 3, (families.POINTS, 2)) for _ in range(8)]
    rows = [("ab"[k % 2], f"{k:03d}", [(float(a), float(b)) for a, b in p]) for k, p in enumerate(paths)]
    return paths, spark.createDataFrame(rows, "g string, id string, pts array<struct<phi:double,psi:double>>").cache()


def near(paths, g, eps):
    ids = [k for k in range(len(paths)) if "ab"[k % 2] == g]
    return ids, {(a, b): torus(paths[a], paths[b]) for a in ids for b in ids if a < b and torus(paths[a], paths[b]) <= eps}


def clusters(paths, g, eps, least=3):
    ids, d = near(paths, g, eps)
    around = {i: {j for p in d for j in p if i in p and j != i} for i in ids}
    core = [i for i in ids if len(around[i]) + 1 >= least]
    label, k = {}, 0
    for i in core:
        if i not in label:
            todo = [i]
            while todo:
                x = todo.pop()
                if label.setdefault(x, k) == k:
                    todo += [j for j in around[x] if j in core and j not in label]
            k += 1
    border = {i: min(label[j] for j in around[i] if j in core) for i in ids if i not in core and any(j in core for j in around[i])}
    return {i: (label | border).get(i, -1) for i in ids}, k


def test_near_pairs(bundle):
    paths, df = bundle
    for eps in (0.2, 0.5):
        have = {(int(r.a), int(r.b)): r.distance for r in families.near_pairs(df, eps).collect()}
        want = near(paths, "a", eps)[1] | near(paths, "b", eps)[1]
        assert have.keys() == want.keys() and len(want) > 5
        assert all(abs(have[p] - want[p]) < 1e-9 for p in want)


def test_search_takes_the_first_good_radius(bundle):
    paths, df = bundle
    have = {int(r.id): (r.eps, r.clusters, r.cluster) for r in families.search(df, families.near_pairs(df, 0.5)).collect()}
    for g in "ab":
        best, chosen = 0, (families.EPS[-1], 0, {})
        for eps in families.EPS:
            label, k = clusters(paths, g, eps)
            if k >= 2 and sum(x < 0 for x in label.values()) / len(label) < 0.5:
                chosen = (eps, k, label)
                break
            if k > best:
                best, chosen = k, (eps, k, label)
        for i, x in chosen[2].items():
            assert have[i] == (chosen[0], chosen[1], x)


def test_refined_families_split(spark):
    rng = np.random.default_rng(5)
    # A chain of two dense knots joined by a bridge: one family at 0.4, two at 0.1; the two knots differ in |dW|.
    at = [0.0] * 6 + [0.3, 0.6] + [0.9] * 6
    rows = [("g", f"{k:02d}", [(float(x + rng.normal(0, 0.003)), 0.0) for _ in range(families.POINTS)], 1.0 + 9 * (x > 0.5), 1.0, 5, "alpha->beta", 0) for k, x in enumerate(at)]
    df = spark.createDataFrame(rows, "g string, id string, pts array<struct<phi:double,psi:double>>, inner_dw double, path_len double, length int, direction string, cluster int")
    label = {r.id: r.cluster for r in families.refined(df, families.near_pairs(df, 0.5)).collect()}
    assert {label[f"{k:02d}"] for k in range(6)} == {"0.0"} and {label[f"{k:02d}"] for k in range(8, 14)} == {"0.1"} and label["06"] == "-1"


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(f"{k:04d}", f"{k + 1:04d}") for k in range(60)] + [("x", "y")], "a string, b string")
    assert {(r.node, r.component) for r in families.components(edges).collect()} == {(f"{k:04d}", "0000") for k in range(61)} | {("x", "x"), ("y", "x")}


def test_hdbscan_on_blobs():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (80, 2)) for c in ((0, 0), (5, 0), (0, 5))] + [rng.uniform(-20, 20, (10, 2))])
    label = hdbscan(x, 50, 10)
    found = [label[s : s + 80] for s in (0, 80, 160)]
    assert all((f == np.bincount(f[f >= 0]).argmax()).mean() > 0.9 for f in found) and len({np.bincount(f[f >= 0]).argmax() for f in found}) == 3
    assert (label[240:] == -1).sum() >= 8 and (hdbscan(x[:60], 50, 10) == -1).all()


def test_agreement(spark):
    df = spark.createDataFrame([(0, "x"), (0, "x"), (1, "y"), (1, "y")], "a int, b string")
    assert tuple(families.agreement(df, "a", "b").first()) == (1.0, 1.0)
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (1, 1)], "a int, b int")
    r = families.agreement(df, "a", "b").first()
    assert abs(r.ari) < 1e-12 and abs(r.jaccard - 0.25) < 1e-12


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(-3, 3, (300, 2))
    index = spark.createDataFrame([("xy"[k % 2], k, 1, float(a), float(b)) for k, (a, b) in enumerate(p)], "organism string, chain_id bigint, pos int, phi double, psi double")
    asked = index.where("chain_id < 40").select(F.col("chain_id").alias("query_id"), "organism", "phi", "psi")
    e = np.column_stack([np.cos(p[:, 0]), np.sin(p[:, 0]), np.cos(p[:, 1]), np.sin(p[:, 1])])
    have = {(r.query_id, r["rank"]): r.chain_id for r in generators.nearest(asked, index.repartition(5), 4).collect()}
    assert len(have) == 160
    for q in range(40):
        d = ((e - e[q]) ** 2).sum(axis=1) + 99 * (np.arange(300) % 2 != q % 2)
        assert [have[q, r] for r in range(1, 5)] == np.argsort(d)[:4].tolist()


def test_sequential_generators_do_not_depend_on_partitions(spark):
    res = generators.protein_like(spark, 6).withColumn("organism", F.when(F.col("chain_id") < 3, "x").otherwise("y")).withColumn("basin", F.when(F.col("phi") < -1.5, "beta").otherwise("alpha"))
    few = res.groupBy("chain_id", "organism").agg(F.least(F.count(F.lit(1)), F.lit(30)).cast("int").alias("length"))
    for f in (generators.pooled_markov, lambda r, c: walks.neighbour_walks(r, c, (7,)), generators.conditional, lambda r, c: generators.steric(c, 5)):
        one = sorted(map(tuple, f(res, few).collect()))
        assert len(one) == 180 and one == sorted(map(tuple, f(res.repartition(3), few.repartition(4)).collect()))


def test_steric_model_has_fewer_clashes(spark):
    # Not none: the place of N and CA follows from the residue before, which no retry changes.
    few = spark.range(60).select(F.col("id").alias("chain_id"), F.lit(40).alias("length"))
    free = generators.mixture(few.select("chain_id", F.explode(F.sequence(F.lit(1), "length")).alias("pos")))
    count = lambda rows: kinematics.clashes(kinematics.reconstructed(rows)).agg(F.sum("clashing")).first()[0]
    assert count(generators.steric(few)) < count(free)
    bonds = kinematics.clashes(kinematics.reconstructed(free), bonded=True).agg(F.min("clashing")).first()[0]
    assert bonds == 39


def test_loops_of_protein_like_chains_have_families(spark):
    res = generators.protein_like(spark, 60).withColumn("resname", F.element_at(F.array(*map(F.lit, families.RESIDUES)), (F.col("pos") % 20 + 1).cast("int"))).withColumn("w", F.sin("phi")).withColumn("organism", F.lit("x"))
    res = res.withColumn("basin", F.when(F.degrees("phi").between(-80, -40) & F.degrees("psi").between(-67, -7), "alpha").when(F.degrees("phi").between(-160, -90) & (F.degrees("psi") > 95), "beta").otherwise("other"))
    found = families.bound_loops(loops.extract_narrow(res)).cache()
    pairs = families.near_pairs(found, 0.5).cache()
    members = found.join(families.search(found, pairs), ["g", "id"]).cache()
    assert members.count() == found.count() > 20
    s = families.statistics(members).collect()
    assert sum(r.n for r in s) == members.where("cluster >= 0").count() and all(r.n_ab + r.n_ba == r.n for r in s)
    c = families.centroids(members)
    assert c.count() == len(s) and c.where(F.size("centroid") != families.POINTS).isEmpty()
    new = kinematics.canonical(res, members, c)
    assert new.count() == res.count()
    kinds = {r.kind: r.n for r in new.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds["basin"] == new.where("kind = 'basin' and (abs(degrees(phi) + 63) < 1e-6 or abs(degrees(phi) + 120) < 1e-6)").count()
    control = {(r.g, r.kind): r.loops for r in families.control(found).collect()}
    assert all(control[g, "null"] == n for (g, k), n in control.items() if k == "real")
    rows = families.loop_features(members).withColumn("family", F.substring_index("g", "|", -1))
    out = families.forest(rows, "family", [f"f{k}" for k in range(26)], trees=5).collect()
    assert sum(r.n for r in out) == members.count() and sum(r.correct for r in out) > 0.9 * members.count()


def test_flanked_loops(spark):
    labels = "aaaaooobbbboooaabbbb"
    rows = [(1, k + 1, {"a": "alpha", "b": "beta", "o": "other"}[x], 0.1 * k, 0.0, 0.5 * k) for k, x in enumerate(labels)]
    df = spark.createDataFrame(rows, "chain_id bigint, pos int, basin string, phi double, psi double, w double")
    out = [(r.start, r.end, r.direction, r.length) for r in loops.extract_flanked(df).collect()]
    # The second sheet run sees only a short helix run, then a sheet run, which ends the search.
    assert out == [(2, 10, "alpha->beta", 9)]
    assert abs(loops.extract_flanked(df).first().delta_w - 4.0) < 1e-9


def test_nearest_of_many_copies_moves_few_rows(spark):
    """A hot place: 3,000 equal rows and 3,000 equal queries gave 9 million pairs; only the first k rows can be among the nearest."""
    rng = np.random.default_rng(8)
    rows = [(c, 1, "x", 0.5, 0.5) for c in range(3000)] + [(5000 + c, 1, "x", float(a), float(b)) for c, (a, b) in enumerate(rng.uniform(-3, 3, (200, 2)))] + [(9000, 1, None, 0.1, 0.1)]
    index = spark.createDataFrame(rows, "chain_id bigint, pos int, organism string, phi double, psi double")
    found = generators.nearest(index.withColumn("query_id", F.col("chain_id")), index, 4)
    have = {}
    for r in found.collect():
        have.setdefault(r.query_id, {})[r["rank"]] = (r.chain_id, r.distance)
    assert have.keys() == {r[0] for r in rows[:-1]}
    at = {r[0]: np.array([np.cos(r[3]), np.sin(r[3]), np.cos(r[4]), np.sin(r[4])]) for r in rows[:-1]}
    for q in (0, 2999, *range(5000, 5200, 20)):
        want = sorted(at, key=lambda c: (round(np.linalg.norm(at[c] - at[q]), 12), c))[:4]
        assert [have[q][k][0] for k in (1, 2, 3, 4)] == want
    # No task is handed more than k of the equal rows.
    assert held_rows(index, 4) <= 4 + 200


def held_rows(index, k):
    """The index rows that the search keeps."""
    seen, was = {}, generators.kept

    def spy(df, name):
        out = was(df, name)
        if name == "points":
            seen[name] = out.count()
        return out

    generators.kept = spy
    try:
        generators.nearest(index.withColumn("query_id", F.col("chain_id")), index, k)
    finally:
        generators.kept = was
    return seen["points"]
