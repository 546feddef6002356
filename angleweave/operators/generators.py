"""Synthetic chains: independent draws as expressions, sequential ones chain by chain with generators seeded by the chain.

What a sequential generator learns from the data is broadcast, so it is bounded: transition tables have at most (72 * 72)^2 cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.angles import grid_index
from .chains import successor_pairs, transition_counts
from .nulls import draw
from .shared import kept, spread

BLOCK = 10_000
#: Share, centre phi and psi, spread (degrees) of the two basins; the rest is uniform.
MIXTURE = ((0.60, -63.0, -43.0, 12.0), (0.25, -120.0, 130.0, 15.0))
#: Share, centre phi and psi, spread (degrees), shortest and longest segment.
SEGMENTS = {"alpha": (0.40, -63.0, -43.0, 3.0, 6, 24), "beta": (0.30, -120.0, 130.0, 4.0, 4, 13), "other": (0.30, -80.0, 60.0, 15.0, 2, 5)}


def cumulative(w):
    """Running shares of W squared over cells, row by row; the last is 1."""
    import numpy as np

    p = np.cumsum((w * w).ravel() / (w * w).sum())
    p[-1] = 1.0
    return p


def sampling_table(spark: SparkSession, w) -> DataFrame:
    """Gi, gj, cdf; n * n rows whatever the data."""
    import numpy as np
    import pyarrow as pa

    gi, gj = np.divmod(np.arange(w.size), w.shape[0])
    return spark.createDataFrame(pa.table({"gi": gi.astype("int32"), "gj": gj.astype("int32"), "cdf": cumulative(w)}))


def _unit(model: str, *parts: str) -> Column:
    return draw(model, *parts) / F.lit(float(1 << 32))


def from_table(rows: DataFrame, w) -> DataFrame:
    """Every row of (chain_id, pos) draws a cell with probability W squared and a place in it."""
    n, shared = w.shape[0], rows.sparkSession.sparkContext.broadcast(cumulative(w))

    def run(batches):
        import numpy as np

        for b in batches:
            cell = np.minimum(np.searchsorted(shared.value, b["u"].to_numpy(), side="left"), n * n - 1)
            yield b[["chain_id", "pos"]].assign(gi=(cell // n).astype("int32"), gj=(cell % n).astype("int32"), phi=-np.pi + (cell // n + b["a"]) * 2 * np.pi / n, psi=-np.pi + (cell % n + b["b"]) * 2 * np.pi / n)

    asked = rows.select("chain_id", "pos", *[_unit(m, "chain_id", "pos").alias(c) for c, m in (("u", "M10"), ("a", "M10a"), ("b", "M10b"))])
    return asked.mapInPandas(run, "chain_id bigint, pos int, gi int, gj int, phi double, psi double")


def observed_cells(res: DataFrame, n: int = 360) -> DataFrame:
    """gi, gj, times: how often the cells of an n x n grid were observed; at most n * n rows."""
    whole = res.where("phi is not null and psi is not null")
    return whole.groupBy(grid_index(F.col("phi"), n, "floor").alias("gi"), grid_index(F.col("psi"), n, "floor").alias("gj")).agg(F.count(F.lit(1)).alias("times"))


def alias_table(spark: SparkSession, cells: DataFrame) -> DataFrame:
    """k, share, gi, gj, other_gi, other_gj: one of k rows is taken evenly, then its own cell with probability share, else the other.

    Every row holds one cell's remaining weight and fills up from one that has too much, so each draw is one lookup.
    """
    import numpy as np

    found = cells.orderBy("gi", "gj").toPandas()
    m = len(found)
    weight = found["times"].to_numpy(np.float64) * m / max(found["times"].sum(), 1)
    share, other = np.ones(m), np.arange(m)
    few, many = [k for k in range(m) if weight[k] < 1], [k for k in range(m) if weight[k] >= 1]
    while few and many:
        a, b = few.pop(), many[-1]
        share[a], other[a] = weight[a], b
        weight[b] -= 1 - weight[a]
        if weight[b] < 1:
            few.append(many.pop())
    gi, gj = found["gi"].to_numpy(), found["gj"].to_numpy()
    rows = [(k, float(share[k]), int(gi[k]), int(gj[k]), int(gi[other[k]]), int(gj[other[k]])) for k in range(m)]
    return spark.createDataFrame(rows, "k int, share double, gi int, gj int, other_gi int, other_gj int")


def from_observed(rows: DataFrame, res: DataFrame, n: int = 360) -> DataFrame:
    """M11 with a histogram: every row of (chain_id, pos) draws a cell as often as it was observed in res, and a place in it. No row if nothing was observed."""
    table = alias_table(rows.sparkSession, observed_cells(res, n))
    m = table.count()
    if not m:
        return rows.select("chain_id", "pos", *[F.lit(None).cast(t).alias(c) for c, t in (("gi", "int"), ("gj", "int"), ("phi", "double"), ("psi", "double"))]).limit(0)
    asked = rows.select("chain_id", "pos", F.floor(_unit("M11h", "chain_id", "pos") * m).cast("int").alias("k"), *[_unit(f"M11{c}", "chain_id", "pos").alias(c) for c in ("u", "x", "y")])
    own = F.col("u") < F.col("share")
    # At most n * n rows.
    met = asked.join(F.broadcast(table), "k").withColumn("gi", F.when(own, F.col("gi")).otherwise(F.col("other_gi"))).withColumn("gj", F.when(own, F.col("gj")).otherwise(F.col("other_gj")))
    angle = lambda g, x: F.radians((F.col(g) + F.col(x)) * (360.0 / n) - 180.0)
    return met.select("chain_id", "pos", "gi", "gj", angle("gi", "x").alias("phi"), angle("gj", "y").alias("psi"))


def mixture(rows: DataFrame) -> DataFrame:
    """M11, and model 1 of M12: two Gaussian basins and a uniform rest, by three hashes a row."""
    u = (draw("M11a", "chain_id", "pos") + 1) / F.lit(float((1 << 32) + 1))
    v, pick = _unit("M11b", "chain_id", "pos"), _unit("M11", "chain_id", "pos")
    r = F.sqrt(-2 * F.log("__u"))
    a, b = MIXTURE
    place = lambda i, z, flat: F.when(F.col("__k") < a[0], a[i] + a[3] * z).when(F.col("__k") < a[0] + b[0], b[i] + b[3] * z).otherwise(360 * flat - 180)
    out = rows.select("chain_id", "pos", u.alias("__u"), v.alias("__v"), pick.alias("__k"))
    turn = 2 * math.pi * F.col("__v")
    return out.select("chain_id", "pos", F.radians(place(1, r * F.cos(turn), F.col("__u"))).alias("phi"), F.radians(place(2, r * F.sin(turn), F.col("__v"))).alias("psi"))


#: Chains of one call of a generator.
TOGETHER = 512


def _together(chains: DataFrame, columns: list[str], many: Callable, schema: str) -> DataFrame:
    """Runs many(rows) -> frame for lists of TOGETHER chains or fewer, in a stated number of tasks."""

    def run(batches):
        for b in batches:
            for s in range(0, len(b), TOGETHER):
                yield many(list(b.iloc[s : s + TOGETHER].itertuples(index=False)))

    return spread(chains.select("chain_id", *columns), "chain_id").mapInPandas(run, schema)


def _placed_frame(rows: list, sizes: list[int], first: int, **columns):
    """chain_id and pos (from first on) of every chain's rows, and the columns."""
    import numpy as np
    import pandas as pd

    ids = pd.Series([r.chain_id for r in rows]).repeat(sizes).reset_index(drop=True)
    pos = np.concatenate([np.arange(first, first + n, dtype="int32") for n in sizes]) if len(sizes) else np.zeros(0, "int32")
    return pd.DataFrame({"chain_id": ids, "pos": pos, **columns})


def _chains(chains: DataFrame, columns: list[str], one: Callable) -> DataFrame:
    """Runs one(row, generator) -> (phi, psi) for every row of chains, many chains a task; the generator is seeded by the chain."""

    def many(rows):
        import numpy as np

        made = [one(row, np.random.default_rng(chain_seed(row.chain_id))) for row in rows]
        return _placed_frame(rows, [len(p) for p, _ in made], 1, phi=np.concatenate([p for p, _ in made]), psi=np.concatenate([s for _, s in made]))

    return _together(chains, columns, many, "chain_id bigint, pos int, phi double, psi double")


def pooled_markov(res: DataFrame, chains: DataFrame, buckets: int = 256) -> DataFrame:
    """One Markov chain of basins for all, started from their occupancy; pairs come from pools of all chains. res carries basin.

    The walk over basins needs counts alone. A pool is numbered in buckets of its hash, whose counts are broadcast (buckets rows a
    basin), so that a draw names a bucket and a place in it, and pairs come from the whole pool by an equi-join.
    """
    whole = res.where("phi is not null and psi is not null")
    bucket = F.pmod(F.xxhash64(F.lit("M08"), "chain_id", "pos"), F.lit(buckets)).cast("int")
    pool = whole.select("basin", bucket.alias("bucket"), "chain_id", "pos", "phi", "psi")
    pool = kept(pool.withColumn("at", F.row_number().over(Window.partitionBy("basin", "bucket").orderBy("chain_id", "pos")) - 1).select("basin", "bucket", "at", "phi", "psi"), "pool")
    sizes: dict[str, dict[int, int]] = {}
    for r in pool.groupBy("basin", "bucket").agg(F.count(F.lit(1)).alias("n")).orderBy("basin", "bucket").collect():
        sizes.setdefault(r.basin, {})[r.bucket] = r.n
    steps = {(r.source, r.target): r.n for r in transition_counts(whole).collect()}
    shared = res.sparkSession.sparkContext.broadcast((sizes, steps))

    def run(batches):
        import zlib

        import numpy as np
        import pandas as pd

        sizes, steps = shared.value
        names = sorted(sizes)
        start = np.array([sum(sizes[b].values()) for b in names], float)
        table = np.array([[steps.get((a, b), 0) for b in names] for a in names], float)
        table = np.where(table.sum(axis=1, keepdims=True) > 0, table, start)
        edges = np.cumsum(table / table.sum(axis=1, keepdims=True), axis=1)
        places = [(np.array([*sizes[b]]), np.cumsum([*sizes[b].values()])) for b in names]
        for rows in batches:
            for row in rows.itertuples(index=False):
                rng = np.random.default_rng([42, zlib.crc32(str(row.chain_id).encode())])
                path = [int(rng.choice(len(names), p=start / start.sum()))]
                for u in rng.random(row.length - 1):
                    path.append(min(int(np.searchsorted(edges[path[-1]], u, side="right")), len(names) - 1))
                at = [int(rng.integers(places[s][1][-1])) for s in path]
                which = [int(np.searchsorted(places[s][1], a, side="right")) for s, a in zip(path, at)]
                yield pd.DataFrame({"chain_id": row.chain_id, "pos": np.arange(1, len(path) + 1, dtype="int32"), "basin": [names[s] for s in path], "bucket": np.array([places[s][0][w] for s, w in zip(path, which)], "int32"), "at": np.array([a - (places[s][1][w - 1] if w else 0) for s, a, w in zip(path, at, which)], "int32")})

    walk = spread(chains.select("chain_id", "length"), "chain_id").mapInPandas(run, "chain_id bigint, pos int, basin string, bucket int, at int")
    return walk.join(pool, ["basin", "bucket", "at"]).select("chain_id", "pos", "phi", "psi")


#: Places that ask one cell in one task.
SLICE = 2_000


def _nearest_in_cell(k: int):
    """All held rows that may be among the k nearest of every place asked; the allowance covers other rounding of the sine."""

    def run(held, asks):
        import numpy as np
        import pandas as pd

        a, b = held["phi"].to_numpy(), held["psi"].to_numpy()
        f, s = asks["f"].to_numpy(), asks["s"].to_numpy()
        few, rows, cols = min(k, len(held)), [], []
        step = max(1, 2_000_000 // max(len(held), 1))
        for z in range(0, len(asks) if few else 0, step):
            d = np.sin((a[None, :] - f[z : z + step, None]) / 2) ** 2 + np.sin((b[None, :] - s[z : z + step, None]) / 2) ** 2
            last = np.partition(d, few - 1, axis=1)[:, few - 1 : few]
            r, c = np.nonzero(d <= last * (1 + 1e-12))
            rows.append(r + z), cols.append(c)
        r, c = (np.concatenate(x) if x else np.zeros(0, int) for x in (rows, cols))
        return pd.DataFrame({"id": asks["id"].to_numpy()[r], "f": f[r], "s": s[r], **{x: held[x].to_numpy()[c] for x in ("chain_id", "pos", "phi", "psi")}})

    return run


def nearest(queries: DataFrame, index: DataFrame, k: int, group: str = "organism") -> DataFrame:
    """query_id, rank, distance, chain_id, pos of the k nearest index rows of the query's group in R4, exactly.

    Places (equal angles of a group) are asked once. Of equal index rows only the first k can be among the nearest. Index rows go to
    their cell of a grid on the torus and to those around it, so that a place meets all of its candidates in its own cell and only the nearest
    leave it. Rows outside differ by a cell's width or more in one angle, so a place whose k-th neighbour is nearer than that is done; the
    others go on to cells of twice the width, until four cells hold everything. The first grid has about k rows a cell or a few times that.
    """
    whole = F.col(group).isNotNull() & F.col("phi").isNotNull() & F.col("psi").isNotNull()
    first = Window.partitionBy(group, "phi", "psi").orderBy("chain_id", "pos")
    points = kept(index.where(whole).select(group, "chain_id", "pos", "phi", "psi").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).drop("r"), "points")
    every = kept(queries.where(whole).select("query_id", group, F.col("phi").alias("f"), F.col("psi").alias("s")), "asked")
    places = kept(every.groupBy(group, "f", "s").agg(F.min("query_id").alias("id")), "places")
    asked, largest = places, points.groupBy(group).count().agg(F.max("count")).first()[0] or 1
    types = {f.name: f.dataType.simpleString() for f in (*points.schema, *places.schema)}
    schema = ", ".join(f"{c} {types[c]}" for c in ("id", "f", "s", "chain_id", "pos", "phi", "psi"))
    out, cells = None, [group, "x", "y"]
    for level in range(max(1, int(math.log2(max(largest / k, 1)) / 2)), 0, -1):
        n = 1 << level
        cell = lambda c: F.pmod(F.floor((F.col(c) + math.pi) * (n / (2 * math.pi))), F.lit(n)).cast("int")  # noqa: B023, E731
        steps = (0, 1) if n == 2 else (-1, 0, 1)
        around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in steps for j in steps])
        asks = asked.withColumns({"x": cell("f"), "y": cell("s")})
        slices = kept(asks.groupBy(*cells).agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices")), "slices")
        asks = asks.join(slices, cells).withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")).drop("slices")
        held = points.withColumn("o", F.explode(around)).withColumns({"x": F.pmod(cell("phi") + F.col("o.i"), F.lit(n)), "y": F.pmod(cell("psi") + F.col("o.j"), F.lit(n))}).drop("o")
        held = held.join(slices, cells).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
        met = held.groupBy(*cells, "slice").cogroup(asks.groupBy(*cells, "slice")).applyInPandas(_nearest_in_cell(k), schema)
        half = lambda a, b: F.sin((F.col(a) - F.col(b)) / 2)
        met = met.withColumn("distance", 2 * F.sqrt(half("phi", "f") * half("phi", "f") + half("psi", "s") * half("psi", "s")))
        by = Window.partitionBy("id").orderBy("distance", "chain_id", "pos")
        best = kept(met.select("id", "distance", "chain_id", "pos").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k), "nearest")
        if n > 2:
            safe = 2 * math.sin(math.pi / n) * (1 - 1e-9)
            ended = best.where((F.col("rank") == k) & (F.col("distance") <= safe)).select("id")
            done = best.join(ended, "id", "left_semi")
            asked = kept(asked.join(ended, "id", "left_anti"), "asked")
        else:
            done = best
        out = done if out is None else out.unionByName(done)
        if n > 2 and asked.isEmpty():
            break
    named = every.join(places.hint("merge"), [group, "f", "s"]).select("query_id", "id")
    return out.join(named.hint("merge"), "id").select("query_id", "rank", "distance", "chain_id", "pos")


def steric_walk(length: int, rng, tries: int = 50, radius: float = 2.0, lookback: int = 6, bonded: bool = False):
    """Angles (length, 2) of one chain of model 2, and for every residue after the first the number of proposals and of rejections.

    A proposal is rejected if one of its atoms is nearer than radius to one of the lookback residues before; the bond to the residue
    before counts only if bonded. The last of `tries` proposals is taken as it is, and counts as no rejection.
    """
    import numpy as np

    from angleweave.functions.geometry import ANGLES, LENGTHS, build, place

    def pair():
        u = rng.random()
        for share, p, s, sd in MIXTURE:
            if u < share:
                return np.radians(rng.normal(p, sd)), np.radians(rng.normal(s, sd))
            u -= share
        return tuple(np.radians(rng.uniform(-180, 180, 2)))

    a1, a2, a3 = np.radians(ANGLES)
    pairs, atoms, counts = [pair()], [build(np.zeros(1), np.zeros(1))[0]], []
    for _ in range(1, length):
        last = atoms[-1]
        n = place(*last, LENGTHS[2], a2, pairs[-1][1])
        ca = place(last[1], last[2], n, LENGTHS[0], a3, np.pi)
        before = np.concatenate(atoms[-lookback:])
        for k in range(tries):
            new = pair()
            c = place(last[2], n, ca, LENGTHS[1], a1, new[0])
            d = ((np.array([n, ca, c])[:, None, :] - before[None, :, :]) ** 2).sum(axis=2)
            if not bonded:
                d[0, -1] = np.inf
            if d.min() >= radius * radius:
                break
        counts.append((k + 1, k))
        pairs.append(new)
        atoms.append(np.array([n, ca, c]))
    return np.array(pairs), counts


def _proposals(rng):
    """The angles that a chain's generator proposes, one after another, as steric_walk() draws them."""
    from math import radians

    (s1, p1, q1, d1), (s2, p2, q2, d2) = MIXTURE
    flat, normal = rng.random, rng.standard_normal
    while True:
        u = flat()
        if u < s1:
            yield radians(p1 + d1 * normal()), radians(q1 + d1 * normal())
        elif u - s1 < s2:
            yield radians(p2 + d2 * normal()), radians(q2 + d2 * normal())
        else:
            yield radians(-180 + 360 * flat()), radians(-180 + 360 * flat())


def steric_walks(lengths: list[int], rngs: list, tries: int = 50, radius: float = 2.0, lookback: int = 6, bonded: bool = False):
    """steric_walk() of many chains side by side: each draws from its own generator as it would alone, the atoms of all are placed together.
    Angles (length, 2) and counts (length - 1, 2) of every chain."""
    import numpy as np

    from angleweave.functions.geometry import ANGLES, LENGTHS, build, placed

    a1, a2, a3 = np.radians(ANGLES)
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    size = np.array([lengths[k] for k in order])
    streams = [_proposals(rngs[k]) for k in order]
    m, most = len(order), max(int(size.max(initial=0)), 1)
    pairs, counts = np.zeros((most, m, 2)), np.zeros((most, m, 2), "int32")
    pairs[0] = np.array([next(s) for s in streams]).reshape(m, 2)
    atoms = np.zeros((most, m, 3, 3))
    atoms[0] = build(np.zeros(1), np.zeros(1))[0]
    for i in range(1, most):
        k = int((size > i).sum())
        last = atoms[i - 1, :k]
        n = placed(last[:, 0], last[:, 1], last[:, 2], LENGTHS[2], a2, pairs[i - 1, :k, 1])
        ca = placed(last[:, 1], last[:, 2], n, LENGTHS[0], a3, np.full(k, np.pi))
        atoms[i, :k, 0], atoms[i, :k, 1] = n, ca
        before = atoms[max(0, i - lookback) : i, :k].transpose(1, 0, 2, 3).reshape(k, -1, 3)

        def gaps(x, y):
            return ((x[:, None, :] - y) ** 2).sum(axis=2)

        # The new N and CA are the same in every proposal.
        d = gaps(n, before)
        if not bonded:
            d[:, -1] = np.inf
        fixed = np.minimum(d.min(axis=1), gaps(ca, before).min(axis=1))
        left = np.arange(k)
        for t in range(tries):
            new = np.array([next(streams[c]) for c in left]).reshape(-1, 2)
            c = placed(last[left, 2], n[left], ca[left], LENGTHS[1], a1, new[:, 0])
            near = np.minimum(fixed[left], gaps(c, before[left]).min(axis=1)) < radius * radius
            pairs[i, left], atoms[i, left, 2] = new, c
            counts[i, left] = t + 1, t
            left = left[near]
            if not len(left):
                break
    back = np.argsort(order)
    return [pairs[: lengths[k], back[k]] for k in range(m)], [counts[1 : lengths[k], back[k]] for k in range(m)]


def chain_seed(chain_id) -> list[int]:
    """What a chain's generator starts from, wherever it runs."""
    import zlib

    return [42, zlib.crc32(str(chain_id).encode())]


def _steric(chains: DataFrame, schema: str, frame: Callable, *how) -> DataFrame:
    def many(rows):
        import numpy as np

        return frame(rows, *steric_walks([max(r.length, 1) for r in rows], [np.random.default_rng(chain_seed(r.chain_id)) for r in rows], *how))

    return _together(chains, ["length"], many, schema)


def steric(chains: DataFrame, tries: int = 50, radius: float = 2.0, lookback: int = 6, bonded: bool = False) -> DataFrame:
    """M12, model 2: draws of the mixture that are repeated while the new residue clashes; after `tries` the last is accepted.
    bonded=True also tests the bond to the residue before, which every proposal fails."""

    def frame(rows, pairs, _):
        import numpy as np

        every = np.concatenate(pairs)
        return _placed_frame(rows, [len(x) for x in pairs], 1, phi=every[:, 0], psi=every[:, 1])

    return _steric(chains, "chain_id bigint, pos int, phi double, psi double", frame, tries, radius, lookback, bonded)


ATTEMPTS = "chain_id bigint, pos int, attempts int, rejected int"


def steric_attempts(chains: DataFrame, tries: int = 50, radius: float = 2.0, lookback: int = 6, bonded: bool = False) -> DataFrame:
    """chain_id, pos, attempts, rejected of every residue after a chain's first, as steric() makes them."""

    def frame(rows, _, counts):
        import numpy as np

        every = np.concatenate(counts)
        return _placed_frame(rows, [len(x) for x in counts], 2, attempts=every[:, 0], rejected=every[:, 1])

    return _steric(chains, ATTEMPTS, frame, tries, radius, lookback, bonded)


def conditional(res: DataFrame, chains: DataFrame, n: int = 72) -> DataFrame:
    """M12, model 3: cells of an n x n grid follow each other as observed; a cell never left draws from all cells."""
    import numpy as np

    cell = lambda p, s: grid_index(F.col(p), n, "floor") * n + grid_index(F.col(s), n, "floor")
    rows = successor_pairs(res).groupBy(cell("phi", "psi").alias("a"), cell("next_phi", "next_psi").alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("a", "b").toArrow()
    marginal = res.where("phi is not null and psi is not null").groupBy(cell("phi", "psi").alias("a")).agg(F.count(F.lit(1)).alias("n")).orderBy("a").toArrow()
    a, b, times, cells, size = (t.column(c).to_numpy() for t, c in ((rows, "a"), (rows, "b"), (rows, "n"), (marginal, "a"), (marginal, "n")))
    lo, total = np.searchsorted(a, np.arange(n * n)), np.bincount(a.astype(int), times, n * n).astype(np.int64) if len(a) else np.zeros(n * n, np.int64)
    shared = res.sparkSession.sparkContext.broadcast((lo, total, b, np.cumsum(times), cells, np.cumsum(size)))

    def one(row, rng):
        import numpy as np

        lo, total, b, ends, cells, size = shared.value
        if not len(cells):
            return np.zeros(0), np.zeros(0)
        every, path = int(size[-1]), []
        for _ in range(row.length):
            k = path[-1] if path else -1
            # Running counts: those before a cell's first pair are added, so that one search serves all cells.
            if k >= 0 and total[k]:
                path.append(int(b[np.searchsorted(ends, (ends[lo[k] - 1] if lo[k] else 0) + rng.integers(total[k]), side="right")]))
            else:
                path.append(int(cells[np.searchsorted(size, rng.integers(every), side="right")]))
        path = np.array(path)
        return tuple(-np.pi + (x + rng.random(len(path))) * 2 * np.pi / n for x in (path // n, path % n))

    return _chains(chains, ["length"], one)


def protein_like_walk(rng):
    """Angles (length, 2) of one chain of M13, NaN where undefined."""
    import numpy as np

    length = int(rng.integers(80, 351))
    names, shares = [*SEGMENTS], np.array([x[0] for x in SEGMENTS.values()])
    parts, at = [], 0
    while at < length:
        _, p, s, sd, lo, hi = SEGMENTS[names[rng.choice(len(names), p=shares)]]
        size = min(int(rng.integers(lo, hi + 1)), length - at)
        steps = rng.normal(0, sd * 0.3, (size, 2))
        steps[0] = rng.normal(0, sd, 2)
        parts.append(np.array([p, s]) + np.cumsum(steps, axis=0))
        at += size
    out = np.radians(np.concatenate(parts))
    out[0, 0], out[-1, 1] = np.nan, np.nan
    return out


def protein_like(spark: SparkSession, n: int) -> DataFrame:
    """N chains of 80 to 350 residues made of helix, sheet and coil segments that drift; the first phi and last psi are undefined."""

    def one(row, rng):
        return protein_like_walk(rng).T

    made = _chains(spark.range(1, n + 1).withColumnRenamed("id", "chain_id"), [], one)
    return made.withColumn("phi", F.nanvl("phi", F.lit(None).cast("double"))).withColumn("psi", F.nanvl("psi", F.lit(None).cast("double")))
