"""Rules on summaries, the second refinement of families, importances and discovery."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from angleweave.functions import basins
from angleweave.operators import families, stats, verdicts
from angleweave.sources import structures


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "rule, args, want",
    [
        ("shuffled", (0.0005, -0.6), "PASS"), ("shuffled", (0.0005, 0.5), "MARGINAL"), ("shuffled", (0.04, 0.3), "MARGINAL"), ("shuffled", (0.05, 3.0), "FAIL"), ("shuffled", (None, 3.0), "FAIL"),
        ("variants", (4.0,), "PASS"), ("variants", (6.0,), "MARGINAL"), ("variants", (6.1,), "FAIL"), ("variants", (None,), "FAIL"),
        ("fold_classes", (5.0, 2.0), "PASS"), ("fold_classes", (7.0, 5.0), "MARGINAL"), ("fold_classes", (7.0, 5.1), "FAIL"), ("fold_classes", (None, None), "INCONCLUSIVE"),
        ("composition", (0.019, 0.0), "PASS"), ("composition", (0.02, 0.039), "MARGINAL"), ("composition", (0.0, 0.04), "NOTABLE"), ("composition", (None, None), "PASS"),
        ("derivation", (5.0,), "PASS"), ("derivation", (15.0,), "MARGINAL"), ("derivation", (15.1,), "FAIL"), ("derivation", (None,), "INCONCLUSIVE"),
        ("markov", (1.0, 1.04, 9.0, 10.9), "PASS"), ("markov", (1.0, 1.04, 9.0, 11.0), "PARTIAL"), ("markov", (1.0, 1.05, 9.0, 9.0), "FAIL"), ("markov", (0.0, 0.0, 9.0, 9.0), "FAIL"),
        ("stability", (0.81,), "EXCELLENT"), ("stability", (0.8,), "GOOD"), ("stability", (0.5,), "MODERATE"), ("stability", (0.4,), "POOR"),
    ],
)
def test_rules(spark, rule, args, want):
    assert value(spark, getattr(verdicts, rule)(*[F.lit(a).cast("double") for a in args])) == want


@pytest.mark.parametrize(
    "n, m, s, pm, ps, want",
    [(2, 1.0, 0.1, 1.0, 0.1, ("degenerate", "tight", "tight")), (3, 1.0, 0.29, 1.0, 0.31, ("tight", "catch-all", "catch-all")), (3, 1.0, 0.29, 2.0, 0.58, ("tight", "tight", "tight")), (9, 0.0, 0.0, 1.0, 0.1, ("degenerate", "tight", "tight")), (9, 1.0, 0.3, 1.0, 0.0, ("catch-all", "catch-all", "catch-all"))],
)
def test_tightness(spark, n, m, s, pm, ps, want):
    x = [F.lit(v) for v in (n, m, s, pm, ps)]
    assert tuple(value(spark, basins.tightness(*x, k)) for k in ("change", "both", "largest")) == want


def test_split(spark):
    rows = [(1, 100, 98, 5.0), (2, None, None, None), (3, 29, 27, 1.0), (4, 40, 29, 1.0), (5, 40, 38, float("inf")), (6, 40, 29, None), (7, 40, 38, float("nan"))]
    done, failed = verdicts.split(spark.createDataFrame(rows, "id int, residues int, length int, bps double"))
    assert [r.id for r in done.collect()] == [1]
    assert {r.id: r.error_type for r in failed.collect()} == {2: "parse", 3: "short", 4: "short", 5: "parse", 6: "parse", 7: "parse"}


def test_dominant_component():
    found = {"loadings": np.array([[0.1, 0.9], [-0.8, 0.2]])}
    assert stats.dominant_component(found, ["a", "b"], "a") == (2, -0.8) and stats.dominant_component(found, ["a", "b"], "b") == (1, 0.9)


def torus(p, q):
    d = p - q
    return np.sqrt((np.arctan2(np.sin(d), np.cos(d)) ** 2).sum(axis=1)).mean()


def test_second_refinement_by_hand(spark):
    """Groups, noise and loose families are searched again, against a plain recursion."""
    rng = np.random.default_rng(12)
    courses = [rng.uniform(-3, 3, (families.POINTS, 2)) for _ in range(5)]
    paths, values = [], []
    for k in range(64):
        c = courses[k % 3]
        if k % 3 == 0:  # a loose family of two near halves
            c = c + (0.16 if k % 2 else 0.0)
        paths.append(c + rng.normal(0, 0.03, c.shape))
        values.append((1.0 + 0.05 * rng.random() + (k % 3 == 0) * (k % 2) * 2.0, 2.0 + 0.1 * rng.random()))
    paths += [courses[3 + k % 2] + rng.normal(0, 0.42, courses[0].shape) for k in range(14)] + [rng.uniform(-3, 3, courses[0].shape) for _ in range(5)]
    values += [(float(rng.uniform(0.2, 3)), float(rng.uniform(1, 4))) for _ in range(19)]
    g = ["big"] * len(paths)
    paths += [courses[0]] * 3
    values += [(1.0, 1.0)] * 3
    g += ["few"] * 3
    ids = [f"{k:03d}" for k in range(len(paths))]
    kind = "array<struct<phi:double,psi:double>>"
    found = spark.createDataFrame([(g[k], ids[k], [(float(a), float(b)) for a, b in paths[k]], *values[k]) for k in range(len(paths))], f"g string, id string, pts {kind}, inner_dw double, path_len double").cache()
    have = {r.id: (r.family, r.kind, r.depth) for r in families.refined_again(found, families.near_pairs(found, max(families.EPS))).collect()}

    def scan(members, eps, least):
        near = {i: [j for j in members if torus(paths[i], paths[j]) <= eps] for i in members}
        core = [i for i in members if len(near[i]) >= least]
        label = {}
        for i in core:
            if i not in label:
                todo = [i]
                while todo:
                    x = todo.pop()
                    if label.setdefault(x, i) == i:
                        todo += [j for j in near[x] if j in core and j not in label]
        out = dict(label)
        for i in members:
            if i not in out and (c := [label[j] for j in near[i] if j in core]):
                out[i] = min(c)
        return out

    def tight(members):
        if len(members) < 3:
            return "tight"
        v = np.array([values[i] for i in members])
        return "tight" if (v.std(axis=0) / np.maximum(v.mean(axis=0), 1e-6)).max() < 0.30 else "catch-all"

    want = []

    def search(members, depth):
        if len(members) < 5 or depth > 3:
            want.append((frozenset(members), tight(members), depth))
            return
        for eps in families.EPS:
            out = scan(members, eps, max(2, int(len(members) * 0.05)))
            if len(set(out.values())) >= 2 and len(members) - len(out) < len(members) * 0.5:
                break
        else:
            want.append((frozenset(members), tight(members), depth))
            return
        for c in {*out.values()}:
            part = [i for i in members if out.get(i) == c]
            if tight(part) == "catch-all" and len(part) >= 10 and depth < 3:
                search(part, depth + 1)
            else:
                want.append((frozenset(part), tight(part), depth))
        noise = [i for i in members if i not in out]
        if len(noise) >= 8:
            search(noise, depth + 1)
        elif noise:
            want.append((frozenset(noise), "noise", depth))

    search([k for k in range(len(paths)) if g[k] == "big"], 0)
    want.append((frozenset(k for k in range(len(paths)) if g[k] == "few"), "small", 0))
    by_family = {}
    for k, i in enumerate(ids):
        by_family.setdefault(have[i], []).append(k)
    assert {(frozenset(m), kind, depth) for (_, kind, depth), m in by_family.items()} == set(want)
    assert max(depth for _, _, depth in want) >= 1 and len(want) > 4


def test_importances(spark):
    rng = np.random.default_rng(3)
    rows = [("ab"[k % 2], float(k % 2 + rng.normal(0, 0.1)), float(rng.normal())) for k in range(60)] + [("c", 0.0, 0.0)]
    found = families.importances(spark.createDataFrame(rows, "y0 string, f0 double, f1 double"), "y0", ["f0", "f1"], 10).collect()
    assert found[0].feature == "f0" and found[0].importance > 0.8 and sum(r.importance for r in found) == pytest.approx(1)
    assert families.importances(spark.createDataFrame(rows[:1], "y0 string, f0 double, f1 double"), "y0", ["f0", "f1"], 10).count() == 0


def test_discovery(spark, tmp_path):
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "ecoli").mkdir()
    for name, size, age in (("a.cif", 500, 100), ("b.cif.gz", 500, 100), ("b.cif", 500, 100), ("c.cif", 50, 100), ("d.cif", 500, 0), ("ecoli/e.cif.gz", 500, 100), ("ecoli/f.txt", 500, 100)):
        at = tmp_path / "flat" / name
        at.write_bytes(b"x" * size)
        os.utime(at, (time.time() - age,) * 2)
    found = structures.discover(spark, str(tmp_path / "flat"), least_age=30)
    assert sorted((os.path.basename(r.path), r.organism) for r in found.collect()) == [("a.cif", "unknown"), ("b.cif", "unknown"), ("e.cif.gz", "ecoli")]
    assert structures.discover(spark, str(tmp_path / "flat")).count() == 4


def test_coverage(spark):
    rows = [("a", 0)] * 4 + [("a", 1)] * 2 + [("a", 2)] + [("a", -1)] * 3 + [("b", -1)] * 2
    found = {r.g: tuple(r)[1:] for r in families.coverage(spark.createDataFrame(rows, "g string, cluster int")).collect()}
    assert found == {"a": (10, 3, 4, 2.0, 60.0, 40.0), "b": (2, 0, None, None, 0.0, 0.0)}


def test_kingdoms_by_join(spark):
    df = spark.createDataFrame([("human",), ("nobody",), (None,), ("ecoli",)], "organism string")
    assert sorted((r.organism or "", r.kingdom) for r in basins.with_kingdom(df).collect()) == [("", "?"), ("ecoli", "Bacteria"), ("human", "Metazoa"), ("nobody", "?")]
