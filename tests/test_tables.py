"""Table functions beside the DataFrame operators, rejected proposals, the metric index of paths and its verdict."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from angleweave.functions import tables
from angleweave.operators import chains, families, generators, kinematics, stats


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    tables.register(spark)


@pytest.fixture(scope="module")
def lengths(spark):
    df = spark.createDataFrame([(k, 5 + 3 * k, "xy"[k % 2]) for k in range(9)] + [(20, 1, "x")], "chain_id bigint, length int, organism string")
    df.createOrReplaceTempView("lengths")
    return df


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_lateral_calls_equal_the_operators(spark, lengths):
    sql = spark.sql("SELECT l.chain_id, s.pos, s.phi, s.psi FROM lengths l, LATERAL steric_chain(l.chain_id, l.length) s")
    assert rows(sql) == rows(generators.steric(lengths).select("chain_id", "pos", "phi", "psi"))
    sql = spark.sql("SELECT l.chain_id, s.* FROM lengths l, LATERAL steric_attempts(l.chain_id, l.length) s")
    assert rows(sql) == rows(generators.steric_attempts(lengths))
    sql = spark.sql("SELECT l.id + 1 AS chain_id, s.* FROM range(3) l, LATERAL protein_like(l.id + 1) s")
    assert sorted(map(tuple, sql.collect()), key=lambda r: r[:2]) == sorted(map(tuple, generators.protein_like(spark, 3).collect()), key=lambda r: r[:2])
    assert spark.sql("SELECT * FROM steric_chain(NULL, 5)").count() == 0 and spark.sql("SELECT * FROM steric_chain(1, 0)").count() == 0


def test_metrics_by_partition(spark, lengths):
    res = generators.mixture(lengths.select("chain_id", F.explode(F.sequence(F.lit(1), "length")).alias("pos"))).withColumn("w", F.sin("phi")).withColumn("organism", F.lit("x"))
    res = res.withColumn("basin", F.when(F.col("phi") < -1.5, "beta").when(F.col("psi") < 0, "alpha").otherwise("other"))
    res.createOrReplaceTempView("residues")
    found = {r.chain_id: r for r in spark.sql("SELECT * FROM chain_metrics(TABLE(residues) PARTITION BY chain_id ORDER BY pos)").collect()}
    rough = chains.roughness(chains.stepped(res)).join(chains.helix_sheet_transitions(res), "chain_id", "left").fillna(0, ["n_transitions"]).collect()
    assert len(rough) == len(found) == 10
    for r in rough:
        for c in ("length", "bps", "bps_norm", "mean_dw", "torus_l1", "torus_l2", "q_phi", "q_psi", "n_transitions"):
            assert found[r.chain_id][c] == (pytest.approx(r[c]) if r[c] is not None else None), c


def test_rejections_are_those_of_the_generator(spark, lengths):
    log = generators.steric_attempts(lengths)
    want = {}
    for r in lengths.collect():
        counts = generators.steric_walk(r.length, np.random.default_rng(generators.chain_seed(r.chain_id)))[1]
        for k, (a, b) in enumerate(counts, 2):
            want.setdefault(k, []).append((a, b, 2 * k <= r.length))
    found = {r.pos: r for r in stats.rejections(log).collect()}
    assert found.keys() == want.keys() and sum(r.rejected for r in found.values()) > 0
    for k, x in want.items():
        rate = lambda y: pytest.approx(sum(b for _, b, _ in y) / sum(a for a, _, _ in y)) if y else None
        assert (found[k].attempts, found[k].rejected) == (sum(a for a, _, _ in x), sum(b for _, b, _ in x))
        assert found[k].rate == rate(x) and found[k].early == rate([y for y in x if y[2]]) and found[k].late == rate([y for y in x if not y[2]])
    # The bond to the residue before is always shorter than the radius: every proposal but the last is a rejection.
    all_ = generators.steric_attempts(lengths, tries=6, bonded=True).agg(F.min("attempts").alias("a"), F.min("rejected").alias("r")).first()
    assert (all_.a, all_.r) == (6, 5)


def torus(p, q):
    d = p - q
    return np.sqrt((np.arctan2(np.sin(d), np.cos(d)) ** 2).sum(axis=1)).mean()


def test_nearest_paths_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    courses = [rng.uniform(-3, 3, (families.POINTS, 2)) for _ in range(4)]
    library = [courses[k % 4] + rng.normal(0, 0.2, (families.POINTS, 2)) for k in range(60)] + [rng.uniform(-3, 3, (families.POINTS, 2)) for _ in range(10)]
    asked = [courses[k % 4] + rng.normal(0, 0.05 + 0.1 * (k % 5), (families.POINTS, 2)) for k in range(50)] + [rng.uniform(-3, 3, (families.POINTS, 2)) for _ in range(15)] + [library[3]]
    path = lambda x: [(float(a), float(b)) for a, b in x]
    kind = "array<struct<phi:double,psi:double>>"
    lib = spark.createDataFrame([(f"f{k:03d}", path(x)) for k, x in enumerate(library)], f"family string, pts {kind}")
    ask = spark.createDataFrame([(k, path(x)) for k, x in enumerate(asked)], f"q int, pts {kind}")
    found = {r.q: r for r in kinematics.nearest_paths(ask, ["q"], lib).collect()}
    assert len(found) == len(asked)
    for k, x in enumerate(asked):
        d = [torus(x, y) for y in library]
        assert found[k].family == f"f{int(np.argmin(d)):03d}" and found[k].distance == pytest.approx(min(d), abs=1e-9)
    assert kinematics.nearest_paths(ask, ["q"], lib.limit(0)).count() == 0


def test_loops_are_replaced_and_the_loss_is_judged(spark):
    """A chain of helix, loop and sheet whose loop has a family: it is replaced, and the rebuilt chains are compared."""
    rng = np.random.default_rng(2)
    course = np.radians(np.column_stack([np.linspace(-80, 60, 8), np.linspace(-40, 100, 8)]))
    rows = []
    for c in range(4):
        x = np.concatenate([np.tile(np.radians([-63.0, -43.0]), (12, 1)), course + rng.normal(0, 0.02, (8, 2)), np.tile(np.radians([-120.0, 130.0]), (10, 1))])
        rows += [(c, k, float(a), float(b), "alpha" if k <= 12 else "other" if k <= 20 else "beta") for k, (a, b) in enumerate(x, 1)]
    res = spark.createDataFrame(rows, "chain_id bigint, pos int, phi double, psi double, basin string")
    from angleweave.operators.loops import resampled

    inner = res.where("basin = 'other'").groupBy("chain_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "phi", "psi"))), lambda p: F.struct(p["phi"].alias("phi"), p["psi"].alias("psi"))).alias("path"))
    found = inner.select("chain_id", F.lit(13).alias("start"), F.lit(8).alias("length"), F.lit("ab").alias("g"), F.lit(0).alias("cluster"), resampled(F.col("path"), families.POINTS).alias("pts"))
    new = kinematics.canonical(res, found, families.centroids(found))
    assert {r.kind: r["count"] for r in new.groupBy("kind").count().collect()} == {"loop": 32, "basin": 88}
    atoms = kinematics.reconstructed(res)
    verdict = kinematics.reconstruction_verdict(kinematics.compared(atoms, kinematics.reconstructed(kinematics.angles(atoms)), kinematics.reconstructed(new))).first()
    assert verdict.chains == 4 and verdict.observed < 1e-3 and 0 < verdict.delta < 1 and verdict.verdict == "captured"
    made = lambda d: kinematics.reconstruction_verdict(spark.createDataFrame([(1, 0.1, 0.1 + d, d)], "chain_id int, observed double, canonical double, delta double")).first().verdict
    assert (made(1.0), made(2.9), made(3.0)) == ("moderate loss", "moderate loss", "significant loss")
