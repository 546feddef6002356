"""Sinks, significance, quality operators and the whole-table searches, against plain versions."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from angleweave.functions import potential
from angleweave.operators import families, generators, quality, significance, stats
from angleweave.sources import sinks


def t_density(x, df):
    return math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)


def test_p_values_by_integration():
    for t, df in ((0.5, 3), (2.1, 12), (4.0, 40)):
        x = np.linspace(-t, t, 200_001)
        y = np.array([t_density(v, df) for v in x])
        assert stats.t_p_value(t, df) == pytest.approx(1 - float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum()), abs=1e-8)
        assert stats.f_p_value(t * t, 1, df) == pytest.approx(stats.t_p_value(t, df), abs=1e-12)


def plain_ranks(x):
    x = np.asarray(x, float)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(7)
    rows = [("a" if k % 3 else "b", float(rng.integers(0, 12)), float(rng.normal()), float(rng.normal())) for k in range(90)]
    return rows, spark.createDataFrame(rows, "g string, x double, y double, z double").repartition(5)


def test_tests(sample):
    rows, df = sample
    g, x, y, z = (np.array(c) for c in zip(*rows))
    assert significance.pearson(df, "x", "y")[0] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert significance.spearman(df, "x", "y")[0] == pytest.approx(np.corrcoef(plain_ranks(x), plain_ranks(y))[0, 1])
    res = lambda a, b: a - np.polyval(np.polyfit(b, a, 1), b)
    assert significance.partial(df, "x", "y", "z")[0] == pytest.approx(np.corrcoef(res(x, z), res(y, z))[0, 1])
    u = sum((p > q) + (p == q) / 2 for p in x[g == "a"] for q in x[g == "b"])
    found, p = significance.mann_whitney(df, "x", "g", "a", "b")
    assert found == pytest.approx(u) and 0 < p <= 1
    d = x - 5
    d = d[d != 0]
    r = plain_ranks(np.abs(d))
    assert significance.wilcoxon(df.withColumn("five", F.lit(5.0)), "x", "five")[0] == pytest.approx(min(r[d > 0].sum(), r[d < 0].sum()))
    t, p = significance.two_sample_t(df, "y", "g", "a", "b")
    f, q = significance.one_way_f(df, "y", "g")
    assert t * t == pytest.approx(f) and p == pytest.approx(q)


def test_leave_one_out(sample):
    rows, df = sample
    _, x, y, z = (np.array(c) for c in zip(*rows))
    wide = df.withColumn("big", F.col("x") * 1e4 + 1e6)
    have = significance.leave_one_out(wide, "y", ["big", "z"])
    errors = []
    for k in range(len(x)):
        m = np.column_stack([np.ones(len(x)), x, z])
        beta = np.linalg.lstsq(np.delete(m, k, 0), np.delete(y, k), rcond=None)[0]
        errors.append(y[k] - m[k] @ beta)
    errors = np.array(errors)
    assert have["mae"] == pytest.approx(np.abs(errors).mean()) and have["rmse"] == pytest.approx(math.sqrt((errors**2).mean()))
    assert have["r2_cv"] == pytest.approx(1 - (errors**2).sum() / ((y - y.mean()) ** 2).sum())


def test_nearest_on_uneven_points(spark):
    """Dense and empty places, equal points, groups smaller than k."""
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal((-1, -0.7), 0.01, (300, 2)), rng.uniform(-math.pi, math.pi, (60, 2)), [[3.1, -3.1]] * 4])
    rows = [("x" if k % 50 else "y", k, 1, *map(float, p)) for k, p in enumerate(points)]
    df = spark.createDataFrame(rows, "organism string, chain_id bigint, pos int, phi double, psi double").repartition(4)
    have = {}
    for r in generators.nearest(df.withColumn("query_id", F.col("chain_id")), df, 10).collect():
        have.setdefault(r.query_id, {})[r["rank"]] = r
    four = lambda p: np.array([math.cos(p[3]), math.sin(p[3]), math.cos(p[4]), math.sin(p[4])])
    for q in rows:
        want = sorted((float(np.linalg.norm(four(q) - four(p))), p[1]) for p in rows if p[0] == q[0])[:10]
        found = have[q[1]]
        assert len(found) == len(want)
        for k, (d, _) in enumerate(want):
            assert found[k + 1].distance == pytest.approx(d, abs=1e-7)


def test_pooled_markov_draws_from_whole_pools(spark):
    rng = np.random.default_rng(2)
    rows = [(c, "x", k, float(rng.normal()), float(rng.normal()), ["alpha", "beta", "other"][int(rng.integers(3))]) for c in range(30) for k in range(1, 41)]
    res = spark.createDataFrame(rows, "chain_id bigint, organism string, pos int, phi double, psi double, basin string")
    few = spark.createDataFrame([(c, 50) for c in range(40)], "chain_id bigint, length int")
    out = generators.pooled_markov(res, few, buckets=8).collect()
    own = {(p, s): b for _, _, _, p, s, b in rows}
    assert len(out) == 2000 and all((r.phi, r.psi) in own for r in out) and len({(r.phi, r.psi) for r in out}) > 500
    at = {(r.chain_id, r.pos): own[r.phi, r.psi] for r in out}
    steps = [(b, at[c, k + 1]) for (c, k), b in at.items() if (c, k + 1) in at]
    seen = [(a[5], b[5]) for a, b in itertools.pairwise(rows) if a[0] == b[0]]
    for pair in set(seen):
        rate = lambda s: s.count(pair) / sum(x[0] == pair[0] for x in s)  # noqa: E731, B023
        assert abs(rate(steps) - rate(seen)) < 0.1


def test_density_labels_every_row(spark):
    rng = np.random.default_rng(3)
    centres = np.array([[0.0] * 8, [4.0] * 8, [-4.0, 4.0] * 4])
    x = np.concatenate([c + rng.normal(0, 0.2, (400, 8)) for c in centres])
    rows = [(k, 1, *map(float, v)) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "chain_id bigint, seg bigint, " + ", ".join(f"{c} double" for c in families.VECTOR)).repartition(3)
    found = {r.chain_id: r.label for r in families.density_clusters(df, rounds=0).collect()}
    assert len(found) == 1200
    for k in range(3):
        labels = [found[i] for i in range(400 * k, 400 * k + 400)]
        most = max(set(labels), key=labels.count)
        assert most >= 0 and labels.count(most) > 340


def test_two_level_by_hand(spark):
    rng = np.random.default_rng(4)
    rows = [(1, k, float(rng.uniform(-3, 3)), float(rng.uniform(-3, 3)), ["alpha", "other"][k % 2]) for k in range(1, 10)] + [(2, k, 0.1, 0.2, "other") for k in (1, 2)]
    res = spark.createDataFrame(rows, "chain_id bigint, pos int, phi double, psi double, basin string")
    w = potential.build()
    grid = potential.grid_table(spark, w)
    have = {r.chain_id: r for r in quality.two_level(res, grid, trials=2).collect()}
    at = lambda p, s: w[round((math.degrees(p) + 180)) % 360, round((math.degrees(s) + 180)) % 360]
    rough = lambda pairs: sum(abs(at(*a) - at(*b)) for a, b in itertools.pairwise(pairs)) / len(pairs)
    chain = [r for r in rows if r[0] == 1]
    assert have[1].real == pytest.approx(rough([r[2:4] for r in chain]))
    drawn = []
    for trial in range(2):
        pairs = []
        for _, k, _, _, b in chain:
            pool = [r for r in chain if r[4] == b]
            pairs.append(pool[int(hashlib.md5(f"M02|1|{trial}|{k}".encode()).hexdigest()[:8], 16) % len(pool)][2:4])
        drawn.append(rough(pairs))
    assert have[1].markov == pytest.approx(sum(drawn) / 2) and have[2].markov == 0.0 == have[2].shuffled


def test_sign_vote(spark):
    rows = [(c, math.radians(60 if k % 2 else 150)) for c in range(3) for k in range(20)]
    raw = spark.createDataFrame(rows, "chain_id bigint, phi double").withColumn("psi", F.col("phi"))
    r = quality.sign_vote(raw).first()
    assert (r.sign, r.plus, r.minus, r.decided) == (-1, 0, 30, True)
    assert quality.signed(raw).agg(F.min("phi")).first()[0] == pytest.approx(math.radians(-150))
    with pytest.raises(Exception, match="undecided"):
        quality.signed(raw.withColumn("phi", F.lit(3.0))).collect()


def test_methods(spark):
    rows = [("X-RAY DIFFRACTION", 60), ("x-ray diffraction", 40), ("SOLUTION NMR", 90), ("ELECTRON MICROSCOPY", 50), (None, 70)]
    df = spark.createDataFrame(rows, "method string, length int")
    assert sorted(r.length for r in quality.experimental(df).collect()) == [50, 60]
    lines = spark.createDataFrame([("p", "MODEL        1"), ("p", "MODEL        2"), ("q", "ATOM")], "path string, value string")
    assert {r.path: r.nmr for r in quality.is_nmr(lines).collect()} == {"p": True, "q": False}
    atoms = spark.createDataFrame([("p", "ATOM", 10.0), ("p", "ATOM", 20.0), ("p", "HETATM", 90.0)], "path string, grp string, b double")
    assert quality.mean_b_factor(atoms).first().mean_b == 15.0
    assert [significance.verdict(*x) for x in ((1e-4, 0.6), (0.01, -0.3), (0.2, 2.0))] == ["PASS", "MARGINAL", "FAIL"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.123456), ("b", 2, None)], "organism string, id int, x double")
    sinks.write_csv(df, f"{tmp_path}/csv", by="organism", digits=3)
    assert sorted(map(tuple, sinks.read_csv(spark, f"{tmp_path}/csv", "id int, x double, organism string, extra string").collect()), key=str) == [(1, 0.123, "a", None), (2, None, "b", None)]
    assert sinks.remaining(df, f"{tmp_path}/done", ["id"]).count() == 2
    sinks.append_results(df.where("id = 1"), f"{tmp_path}/done")
    assert [r.id for r in sinks.remaining(df, f"{tmp_path}/done", ["id"]).collect()] == [2]
    sinks.append_results(df.where("id = 2"), f"{tmp_path}/done")
    assert sinks.remaining(df, f"{tmp_path}/done", ["id"]).isEmpty()
    for ids in (["p", "q", "p"], ["r"]):
        sinks.write_manifest(spark, f"{tmp_path}/m.json", "ecoli", ids=ids, done=["q"])
    assert tuple(sinks.read_manifest(spark, f"{tmp_path}/m.json").first()) == ("ecoli", ["r"], ["q"], [], [])
    assert sinks.read_manifest(spark, f"{tmp_path}/m.json.bak").first().ids == ["p", "q"]
    sinks.upsert(df, f"{tmp_path}/t", 1)
    sinks.upsert(df.where("id = 2").withColumn("x", F.lit(9.0)), f"{tmp_path}/t", 2)
    sinks.upsert(df.where("id = 2").withColumn("x", F.lit(7.0)), f"{tmp_path}/t", 2)
    assert {r.id: r.x for r in sinks.current(spark, f"{tmp_path}/t", ["organism", "id"]).collect()} == {1: 0.123456, 2: 7.0}
    sinks.compacted(spark, f"{tmp_path}/t", ["organism", "id"], f"{tmp_path}/u")
    assert sinks.current(spark, f"{tmp_path}/u", ["id"]).count() == 2
    made = []
    make = lambda n: made.append(n) or spark.range(n)
    assert [sinks.stored_grid(spark, f"{tmp_path}/g", make, n=n).count() for n in (3, 3, 4)] == [3, 3, 4] and made == [3, 4]
    registry = spark.createDataFrame([("a", 1), ("b", 5), ("c", 2)], "organism string, total int")
    assert {r.organism: r.status for r in sinks.status(registry, df, df.where("id = 9")).collect()} == {"a": "complete", "b": "running", "c": "pending"}
    sinks.report({"Chains": df, "Many": spark.range(10)}, f"{tmp_path}/r.txt", most=5)
    text = (tmp_path / "r.txt").read_text()
    assert "0.1235" in text and "more than 5 rows" in text
    files = spark.createDataFrame([("x/AF-P1-F1-model_v3.cif",), ("x/AF-P1-F1-model_v4.cif.gz",), ("x/other.cif",)], "path string")
    assert [tuple(r) for r in sinks.latest_files(files).collect()] == [("P1", 4, "x/AF-P1-F1-model_v4.cif.gz")]
