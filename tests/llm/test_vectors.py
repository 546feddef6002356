"""Centroid clustering and vector codes against plain Python and SQL."""

import hashlib
import math
import random

import duckdb
import pytest

from angleweave.llm import centroid_clustering, vector_codes
from angleweave.llm import queries as Q

DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, v string, code string"


def ints(rows, scale, dims=64):
    out = []
    for i, e, label in rows:
        if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e):
            out.append((i, label, [math.floor(scale * x) for x in e]))
    return out


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def fit(vs, start, rounds):
    """Plain Lloyd: centroids and the last (distance, index) of every vector."""
    cs = [list(c) for c in start]
    for r in range(rounds + 1):
        best = [min((far(v, c), k) for k, c in enumerate(cs)) for v in vs]
        if r < rounds:
            for k in range(len(cs)):
                mine = [v for v, b in zip(vs, best) if b[1] == k]
                if mine:
                    cs[k] = [sum(col) // len(mine) for col in zip(*mine)]
    return cs, best


def lloyd_by_hand(rows):
    kept = ints(rows, 1024)
    order = sorted(kept, key=lambda r: hashlib.sha256(f"3:{r[0]}".encode()).hexdigest())[:8]
    cs, best = fit([v for _, _, v in kept], [v for _, _, v in order], 10)
    own = {k: sum(d for d, j in best if j == k) for k in range(len(cs))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted((i, k, d, own[k], sum(own.values()), sha[k]) for (i, _, _), (d, k) in zip(kept, best))


def codes_by_hand(rows):
    kept = sorted(ints(rows, 256), key=lambda r: r[0])
    books, found = [], []
    for p in range(16):
        vs = [v[4 * p : 4 * p + 4] for _, _, v in kept]
        cs, best = fit(vs, vs[:64], 2)
        books.append(cs)
        found.append(best)
    codes = ["".join(f"{found[p][n][1]:02x}" for p in range(16)) for n in range(len(kept))]
    errors = [sum(found[p][n][0] for p in range(16)) for n in range(len(kept))]
    labels = {}
    for (_, label, _), e in zip(kept, errors):
        labels[label] = labels.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((i, c, e, labels[label], sha) for (i, label, _), c, e in zip(kept, codes, errors))


def odd_rows():
    """Ties, copies, few distinct values, wrong lengths, nulls, non-finite and large components, null labels."""
    rng = random.Random(4)
    rows = [(k, [rng.choice([-0.02, -0.01, 0.0, 0.01]) for _ in range(64)], k % 3 or None) for k in range(150)]
    rows += [(200 + k, rows[7][1], 5) for k in range(80)]
    rows += [(400, None, 1), (401, [0.1] * 63, 1), (402, [0.1] * 65, None), (403, [0.1] * 63 + [None], 1), (404, [0.1] * 63 + [float("nan")], 1), (405, [float("inf")] + [0.1] * 63, 1), (406, [], 1)]
    rows += [(500 + k, [200.0 * (k + 1)] * 32 + [-150.5] * 32, 9) for k in range(3)]
    return rows


@pytest.fixture(scope="module", params=["few", "odd", "copies"])
def case(request, spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("vectors"))
    rows = {"few": odd_rows()[:5], "odd": odd_rows(), "copies": [(k, [0.25] * 64, None) for k in range(90)]}[request.param]
    spark.createDataFrame([(i, e, label, "x", "y", "z") for i, e, label in rows], SCHEMA).repartition(5).write.parquet(f"{d}/embeddings.parquet")
    return d, rows


def got(spark, name, d):
    return sorted(map(tuple, Q.queries()[name](spark, d).collect()))


def test_op11_by_hand(spark, case):
    assert got(spark, "op11_centroids", case[0]) == lloyd_by_hand(case[1])


def test_op13_by_hand(spark, case):
    assert got(spark, "op13_vector_codes", case[0]) == codes_by_hand(case[1])


@pytest.mark.parametrize("name", ["op11_centroids", "op13_vector_codes"])
def test_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DIR}/embeddings.parquet'")
    found = Q.queries()[name](spark, DIR)
    want = db.execute(Q.oracle_sql()[name])
    assert found.columns == [c[0] for c in want.description]
    assert got(spark, name, DIR) == sorted(want.fetchall())


@pytest.mark.parametrize("name", ["op11_centroids", "op13_vector_codes"])
def test_empty(spark, name, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert got(spark, name, str(tmp_path)) == []
    spark.createDataFrame([(1, None, 1, "", "", "")], SCHEMA).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert got(spark, name, f"{tmp_path}/none") == []


def test_repeated_and_null_ids(spark):
    rows = [(None, [0.5] * 64, 1), (None, [0.5] * 64, 1), (3, [0.25] * 64, 2), (3, [0.25] * 64, 2), (3, [0.75] * 64, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for f in (centroid_clustering.clustered, vector_codes.compressed):
        assert sorted((r.vec_id for r in f(df).collect()), key=str) == [3, 3, 3, None, None]


def test_bounds_skip_scans_and_change_nothing():
    """After a small move most parts keep their entry without a scan; entries equal a full scan's, ties included."""
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.r_[rng.integers(-300, 300, (3000, 4)), rng.integers(-2, 2, (500, 4))]
    books = np.concatenate([rng.integers(-300, 300, (1, 40, 4)), rng.integers(-2, 2, (1, 20, 4))], axis=1)
    at, least, second = vector_codes.scan(x, books[0])
    upper, lower = vector_codes._up(np.sqrt(least.astype(float))), vector_codes._down(np.sqrt(second))
    now = books + rng.integers(-6, 7, books.shape)
    moves = vector_codes.Moves(books, now)
    code, upper, lower, scanned = vector_codes.settled(x, 0, at, upper, lower, moves)
    want, least, second = vector_codes.scan(x, now[0])
    assert (code == want).all() and 0 < scanned < len(x) * 0.6
    assert (upper.astype(float) ** 2 >= least).all() and (np.maximum(lower, 0).astype(float) ** 2 <= second).all()


def test_codes_give_vectors_near_the_first(spark):
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet")
    books, codes = vector_codes.fitted(rows)
    back = {r.vec_id: r.embedding for r in vector_codes.decompressed(codes, books).collect()}
    errors = {r.vec_id: r.error for r in codes.collect()}
    for r in rows.collect():
        exact = sum((math.floor(256 * x) - (256 * y - 0.5)) ** 2 for x, y in zip(r.embedding, back[r.vec_id]))
        assert abs(exact - errors[r.vec_id]) < 1e-6


def test_centroids_assign_new_rows(spark):
    table = centroid_clustering.centroid_table(spark.read.parquet(f"{DIR}/embeddings.parquet"), clusters=4, rounds=3).collect()
    assert [r.cluster for r in table] == [0, 1, 2, 3] and all(len(r.centroid) == 64 for r in table)
