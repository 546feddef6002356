"""Density clusters of whole tables against the plain algorithm, and the agreement of labels."""

import itertools

import numpy as np
import pandas as pd
import pytest

from angleweave.functions.density import core_distances, hdbscan, spanning_tree
from angleweave.operators import density, families

NAMES = [f"f{j}" for j in range(8)]


def made(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 3, (6, 8))
    return np.concatenate([centres[k] + rng.normal(0, 0.3 + 0.2 * k, (n // 8, 8)) for k in range(6)] + [rng.normal(0, 4, (n - 6 * (n // 8), 8))])


def frame(spark, xs):
    return spark.createDataFrame(pd.concat([pd.DataFrame(x, columns=NAMES).assign(g=g, id=range(len(x))) for g, x in xs.items()])).repartition(5)


@pytest.fixture(scope="module")
def case(spark):
    xs = {0: made(3000, 1), 1: made(700, 2), 2: made(60, 3)}
    xs[1][500:700] = xs[1][:200]  # copies
    was = density.LEAF, density.SLICE, density.LOCAL_ROWS
    density.LEAF, density.SLICE, density.LOCAL_ROWS = 150, 500, 400
    yield xs, frame(spark, xs)
    density.LEAF, density.SLICE, density.LOCAL_ROWS = was


def test_every_row_is_labelled_as_by_the_plain_algorithm(case):
    """Many leaves, sliced askers and pointers resolved both ways, in groups side by side."""
    xs, df = case
    found = density.clustered(df, NAMES).toPandas()
    for g, x in xs.items():
        labels = found[found.g == g].sort_values("id").label.to_numpy()
        want = hdbscan(x)
        assert len(labels) == len(x)
        assert len(set(zip(want, labels))) == len(set(want)) == len(set(labels))
        assert ((want < 0) == (labels < 0)).all()
        firsts = [np.flatnonzero(labels == c)[0] for c in range(labels.max() + 1)]
        assert firsts == sorted(firsts)
    assert (found[found.g == 2].label == -1).all()


def test_the_tree_is_the_least_one(case):
    xs, df = case
    points = density.neighbour_lists(density.indexed(df.where("g = 0"), NAMES), NAMES, 10)
    core = core_distances(xs[0], 10)
    have = {r.id: r.core for r in points.collect()}
    assert all(have[k] == core[k] for k in range(len(core)))
    tree = density.spanning_tree(points, NAMES).collect()
    assert sorted((r.w, r.lo, r.hi) for r in tree) == sorted(spanning_tree(xs[0], core))


def test_equal_vectors_and_few_rows(spark):
    rows = [(0, k, *[float(k % 2)] * 8) for k in range(140)] + [(1, k, *[float(k)] * 8) for k in range(5)]
    df = spark.createDataFrame(rows, "g int, id bigint, " + ", ".join(f"{c} double" for c in NAMES))
    found = {(r.g, r.id): r.label for r in density.clustered(df, NAMES).collect()}
    assert all(found[0, k] == k % 2 for k in range(140)) and all(found[1, k] == -1 for k in range(5))
    assert density.clustered(df.where("id < 0"), NAMES).count() == 0


def test_landing_order():
    """The cluster that held a component is found by edges in order, ties by ids."""
    tree = density.Clusters([(0, 1), (0, 5), (0, 9)], [((1.0, 1, 5), 0, 1, 5), ((2.0, 5, 9), 0, 5, 9)])
    at = tree.landing(np.array([0, 0, 0, 2]), np.array([1.0, 1.0, 2.5, 1.5]), np.array([0, 1, 5, 5]), np.array([3, 6, 9, 9]))
    assert at.tolist() == [0, 3, 4, 2]


def pair_index(a, b):
    both = either = 0
    for i, j in itertools.combinations(range(len(a)), 2):
        x, y = a[i] == a[j] != -1, b[i] == b[j] != -1
        both, either = both + (x and y), either + (x or y)
    return both, either


def test_stability_without_noise(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(-1, 4, 400)
    b = np.where(rng.random(400) < 0.7, a, rng.integers(-1, 4, 400))
    rows = [(k, 1, 0, int(x)) for k, x in enumerate(a)] + [(k, 1, 1, int(x)) for k, x in enumerate(b) if k % 3]
    r = families.stability(spark.createDataFrame(rows, "chain_id bigint, seg bigint, round int, label int")).collect()
    keep = [k for k in range(400) if k % 3]
    both, either = pair_index(a[keep], b[keep])
    assert len(r) == 1 and (r[0].a, r[0].b, r[0].shared) == (0, 1, len(keep)) and abs(r[0].jaccard - both / either) < 1e-12
    df = spark.createDataFrame([(k, int(a[k]), int(b[k])) for k in keep], "k bigint, a int, b int")
    drawn = families.sampled_jaccard(df, "k", "a", "b", 30_000).first()
    share = both / either
    assert abs(drawn.jaccard - share) < 5 * (share * (1 - share) / drawn.either) ** 0.5
    assert families.sampled_jaccard(df.limit(1), "k", "a", "b").count() == 0
