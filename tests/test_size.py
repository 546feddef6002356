"""Steps that stay small on tables whose angles differ."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from angleweave.operators import places, walks


@pytest.mark.parametrize("kind", ["even", "copies", "dense", "edge"])
@pytest.mark.parametrize("n, most, size", [(5, 9, 4), (300, 20, 50), (3000, 200, 400)])
def test_the_pair_of_a_rank_is_found_in_its_block(kind, n, most, size):
    """As by sorting all pairs by distance, chain and place."""
    rng = np.random.default_rng(n)
    p, q = rng.uniform(-np.pi, np.pi, (2, n))
    if kind == "copies":
        p, q = np.tile(p[: n // 5], 5), np.tile(q[: n // 5], 5)
    if kind == "dense":
        p[n // 9 :], q[n // 9 :] = rng.normal(-1, 0.05, n - n // 9), (rng.normal(3.1, 0.1, n - n // 9) + np.pi) % (2 * np.pi) - np.pi
    if kind == "edge":
        p, q = np.round(p, 1), np.full(n, -np.pi)
    n, ties, pos = len(p), rng.integers(0, 50, len(p)), np.arange(len(p))
    f, s = (np.concatenate([v[rng.integers(0, n, 60)], rng.uniform(-np.pi, np.pi, 20)]) for v in (p, q))
    k = max(1, int((n / 12) ** 0.5))
    cell = lambda v: np.floor((v + np.pi) / (2 * np.pi / k)).astype(int) % k
    cells = pd.concat([pd.DataFrame({"g": "a", "x": cell(a), "y": cell(b), "pairs": x, "places": 1 - x}) for a, b, x in ((p, q, 1), (f, s, 0))])
    found = places.Blocks(cells.groupby(["g", "x", "y"], as_index=False).sum(), most, size, k)
    rows, of = found.holders(np.array(["a"] * n, object), p, q)
    asked, rank = found.of(np.array(["a"] * len(f), object), f, s), rng.integers(0, min(most, n), len(f))
    for b in set(asked):
        held, mine = rows[of == b], np.flatnonzero(asked == b)
        have = held[places.Ground(found, b, p[held], q[held], ties[held], pos[held]).nearest(f[mine], s[mine], rank[mine])]
        for i, got in zip(mine, have):
            d = 2 * np.sqrt(np.sin((p - f[i]) / 2) ** 2 + np.sin((q - s[i]) / 2) ** 2)
            assert got == np.lexsort((pos, ties, d))[rank[i]]


def test_walks_keep_no_lists(spark, monkeypatch):
    """A step is the drawn neighbour's successor, and no list of neighbours is made."""
    rng = np.random.default_rng(8)
    rows = [(c, "xy"[c % 2], k, float(p), float(s)) for c in range(6) for k, (p, s) in enumerate(rng.uniform(-3, 3, (20, 2)), 1)]
    res = spark.createDataFrame(rows, "chain_id bigint, organism string, pos int, phi double, psi double")
    lists = {r.id: r.succ for r in walks.successor_lists(res, 9).collect()}
    monkeypatch.setattr(walks, "nearest", None)
    lengths = res.groupBy("chain_id", "organism").agg(F.lit(8).alias("length"))
    found = {(r.k, r.chain_id, r.pos): r for r in walks.neighbour_walks(res, lengths, (4, 9)).withColumn("draw", F.pmod(F.xxhash64(F.lit("M09 step"), "chain_id", "k", "pos"), F.col("k"))).collect()}
    own = {(r[3], r[4]): r[0] * walks.PLACES + r[2] for r in rows}
    assert len(found) == 2 * 6 * 8
    for (k, c, p), r in found.items():
        if p > 1:
            before = found[k, c, p - 1]
            assert own[r.phi, r.psi] == lists[own[before.phi, before.psi]][r.draw]


def test_neighbours_are_listed_without_questions(spark, monkeypatch):
    """leaves are read where they are needed; lists, cores and reach are those of all pairs, copies counted."""
    from angleweave.operators import density

    monkeypatch.setattr(density, "LEAF", 40)
    monkeypatch.setattr(density, "SHELF_ROWS", 100)
    monkeypatch.setattr(density, "_by_leaf", None)
    rng, names, k = np.random.default_rng(6), ["a", "b", "c"], 5
    x = {g: np.concatenate([rng.normal(0, 0.01, (n // 2, 3)), rng.normal(0, 9, (n - n // 2, 3))]) + 1e4 * g for g, n in ((0, 300), (1, 4), (2, 150))}
    m = {g: rng.integers(1, 8, len(v)) for g, v in x.items()}
    df = spark.createDataFrame([(g, i, int(m[g][i]), *map(float, r)) for g, v in x.items() for i, r in enumerate(v)], "g int, id bigint, m bigint, a double, b double, c double")
    found = density.neighbour_lists(density.indexed(df, names), names, k).collect()
    assert len(found) == 454 and len({(r.g, r.leaf) for r in found}) > 8
    for r in found:
        d = np.sqrt(((x[r.g][r.id] - x[r.g]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((np.arange(len(d)), d)) if j != r.id][: k + density.MORE]
        assert [(n.b, n.mb) for n in r.near] == [(j, m[r.g][j]) for j in order] and [n.d for n in r.near] == [d[j] for j in order]
        sums = m[r.g][r.id] - 1 + np.cumsum([m[r.g][j] for j in order])
        assert r.core == (0.0 if m[r.g][r.id] > k else d[order[np.argmax(sums >= k)]] if (sums >= k).any() else np.inf)
        assert r.reach == (d[order[-1]] if len(order) == k + density.MORE else np.inf)
