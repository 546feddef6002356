"""Density clusters of whole tables (L08): a spanning tree of mutual reachability and its condensed tree, by Spark joins.

Neighbours. Rows fall into the leaves of a k-d tree whose splits come from a bounded sample; the splits change the work,
never the result. A leaf's rows are compared with each other first, then with other leaves from the nearest box on, until no box left may hold a
nearer row. Leaves are read from files where they are needed, a bounded number at a time; neither rows nor questions are moved or written.

Tree. In every Boruvka round each component takes its lightest edge that leaves it: from the neighbour lists
where these prove it, else from a search of the leaves that hold other components and are near enough. Edges are ordered by weight and then by
ids, so the tree is unique.

Condensed tree. A component below the least size only matters by the edge at which it joins a larger one. Every
small component points along its lightest edge; trees of such pointers are contracted in one round, so few rounds are
needed. What remains are the components that reached the least size: at most rows / least of them, whose tree is built on the driver.

No row is left out, no group of rows is sampled, and no task holds more than a leaf and a slice of those who ask it.
Equal vectors are one weighted point; they join each other before any other edge of the same weight.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .shared import kept

#: Rows of a leaf, about; leaves at most (their boxes are broadcast, 150 bytes each); rows that the splits are taken from.
LEAF = 1_000
MOST_LEAVES = 1 << 16
SPLIT_ROWS = 100_000
#: Rows that ask one leaf in one task.
SLICE = 20_000
#: Neighbours listed beyond the k that the density needs.
MORE = 6
#: Pointer tables of at most this many rows are resolved on the driver.
LOCAL_ROWS = 100_000
MOST_ROUNDS = 200
TINY = 1e-12


def gap2(a, b):
    """Squared distances of all rows of a to all of b."""
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)


def matrix(frame, names: list[str]):
    """Vectors row by row: one layout, so that a distance is the same number wherever it is taken."""
    import numpy as np

    return np.ascontiguousarray(frame[names].to_numpy(np.float64))


def splits(sample, depth: int):
    """A k-d tree of 2^depth leaves by medians of the widest direction: axis and value of every inner node, level by level."""
    import numpy as np

    axis, value = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    held = [sample]
    for node in range(len(axis)):
        x = held[node]
        if len(x):
            axis[node] = (x.max(axis=0) - x.min(axis=0)).argmax()
            value[node] = np.median(x[:, axis[node]])
        right = x[:, axis[node]] > value[node]
        held += [x[~right], x[right]]
    return axis, value


def _leafed(names: list[str], axis, value, depth: int):
    def run(batches):
        import numpy as np

        for b in batches:
            x, node = matrix(b, names), np.zeros(len(b), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), axis[node]] > value[node])
            yield b.assign(leaf=(node - len(axis)).astype("int32"))

    return run


def indexed(points: DataFrame, names: list[str]) -> DataFrame:
    """g, id (the least of equal vectors), m (how many are equal), leaf and the vector of every distinct vector."""
    distinct = points.select("g", "id", "m", *names) if "m" in points.columns else points.groupBy("g", *names).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("m"))
    distinct = kept(distinct, "density-distinct")
    count = distinct.count()
    depth = min(max(0, math.ceil(math.log2(max(count, 1) / LEAF))), int(math.log2(MOST_LEAVES)))
    # By a bound on the hash: an ordered limit would send as many rows from every partition to the driver.
    drawn = F.pmod(F.xxhash64("id", "g"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SPLIT_ROWS / max(count, 1)))
    sample = distinct.where(drawn & F.lit(depth > 0)).select(*names).toPandas()[names].to_numpy()
    axis, value = splits(sample, depth)
    schema = "g int, id bigint, m bigint, " + ", ".join(f"{c} double" for c in names) + ", leaf int"
    return kept(distinct.select("g", "id", "m", *names).mapInPandas(_leafed(names, axis, value, depth), schema), "density-leaves")


def boxes(points: DataFrame, names: list[str], *more: Column) -> dict:
    """g -> leaf numbers, least and greatest corner, and further aggregates; one row a leaf."""
    import numpy as np

    rows = points.groupBy("g", "leaf").agg(*[f(c) for f in (F.min, F.max) for c in names], *more).orderBy("g", "leaf").toPandas()
    d = len(names)
    return {int(g): (x["leaf"].to_numpy(), x.iloc[:, 2 : 2 + d].to_numpy(np.float64), x.iloc[:, 2 + d : 2 + 2 * d].to_numpy(np.float64), x.iloc[:, 2 + 2 * d :].to_numpy(np.float64)) for g, x in rows.groupby("g")}


def _box_gaps(x, low, high):
    """Least distance of every row to every box, never rounded above the truth."""
    import numpy as np

    outside = np.maximum(np.maximum(low[None] - x[:, None, :], x[:, None, :] - high[None]), 0.0)
    return np.sqrt((outside**2).sum(axis=2)) * (1 - 1e-12)


def _by_leaf(points: DataFrame, asked: DataFrame, run, schema: str) -> DataFrame:
    """Cogroups the points of a leaf with those who ask it, in slices of bounded size."""
    slices = F.broadcast(kept(asked.groupBy("g", "leaf").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices")), "density-slices"))
    held = points.join(slices, ["g", "leaf"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    asks = asked.join(slices, ["g", "leaf"]).withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")).drop("slices")
    by = ["g", "leaf", "slice"]
    asks = asks.select(*[F.col(c).alias(c) for c in asks.columns])
    return held.groupBy(*by).cogroup(asks.groupBy(*by)).applyInPandas(run, schema)


#: Rows of a file of leaves, about, and bytes of files that a worker keeps at hand.
SHELF_ROWS = 20_000
AT_HAND = 128 << 20
_shelf: dict = {}


def _leaf_of(path: str, g: int, leaf: int, names: list[str]):
    """Vectors, ids and numbers of rows of a leaf. A worker keeps the files that it read last."""
    import numpy as np
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSystem

    if path not in _shelf:
        fs, inner = FileSystem.from_uri(path)
        b = pq.read_table(inner, filesystem=fs, partitioning=None, columns=["g", "leaf", "id", "m", *names]).to_pandas()
        while _shelf and sum(x[1].nbytes for x in _shelf.values()) + 8 * len(names) * len(b) > AT_HAND:
            del _shelf[next(iter(_shelf))]
        key = b["g"].to_numpy(np.int64) << 32 | b["leaf"].to_numpy(np.int64)
        _shelf[path] = key, matrix(b, names), b["id"].to_numpy(), b["m"].to_numpy()
    _shelf[path] = key, x, ids, m = _shelf.pop(path)
    at = slice(*np.searchsorted(key, [g << 32 | leaf, (g << 32 | leaf) + 1]))
    return x[at], ids[at], m[at]


class Nearest:
    """The nearest rows so far of the rows of a leaf: each list by distance and id."""

    def __init__(self, q, ids, count: int):
        import numpy as np

        self.q, self.ids, self.count, self.norm = q, ids, count, (q**2).sum(axis=1)
        self.d, self.b, self.mb = np.full((len(q), count), np.inf), np.full((len(q), count), -1, np.int64), np.zeros((len(q), count), np.int64)

    def meet(self, rows, x, ids, m):
        """Distances by matrix product tell which pairs may be among the nearest; these are measured exactly."""
        import numpy as np

        norm, n = (x**2).sum(axis=1), self.count
        step = max(1, 1_000_000 // max(len(x), 1))
        for s in range(0, len(rows), step):
            z = rows[s : s + step]
            near = self.norm[z, None] + norm[None, :] - 2 * (self.q[z] @ x.T)
            reach, slack = self.d[z, -1] ** 2, 1e-12 * (self.norm[z] + norm.max(initial=0.0)) + 1e-300
            if len(x) > n + 1 and not np.isfinite(reach).all():
                reach = np.minimum(reach, np.partition(near, n, axis=1)[:, n] + 2 * slack)
            r, c = np.nonzero(near <= (reach * (1 + 1e-9) + slack)[:, None])
            keep = self.ids[z[r]] != ids[c]
            r, c = r[keep], c[keep]
            d = np.sqrt(((self.q[z[r]] - x[c]) ** 2).sum(axis=1))
            hit = np.unique(r)
            if not len(hit):
                continue
            old = z[hit]
            row = np.concatenate([np.repeat(hit, n), r])
            every, b, mb = (np.concatenate([have[old].ravel(), new]) for have, new in ((self.d, d), (self.b, ids[c]), (self.mb, m[c])))
            order = np.lexsort((b, every, row))
            first = np.searchsorted(row[order], hit)[:, None] + np.arange(n)
            at = order[first]
            self.d[old], self.b[old], self.mb[old] = every[at], b[at], mb[at]


def _lists(names: list[str], found: dict, paths: dict, k: int):
    """For whole leaves: their own rows first, then other leaves from the nearest on, until none can hold a nearer row."""

    def run(batches):
        import numpy as np

        for batch in batches:
            for g, leaf in zip(batch["g"].tolist(), batch["leaf"].tolist()):
                leaves, low, high, _ = found[g]
                x, ids, m = _leaf_of(paths[g, leaf], g, leaf, names)
                near, every, own = Nearest(x, ids, k + MORE), np.arange(len(x)), int(np.searchsorted(leaves, leaf))
                near.meet(every, x, ids, m)
                apart = np.maximum(np.maximum(low - high[own], low[own] - high), 0.0)
                apart = np.sqrt((apart**2).sum(axis=1)) * (1 - 1e-12)
                for j in np.argsort(apart, kind="stable"):
                    if apart[j] > near.d[:, -1].max():
                        break
                    rows = every[_box_gaps(x, low[j : j + 1], high[j : j + 1])[:, 0] <= near.d[:, -1]] if j != own else every[:0]
                    if len(rows):
                        other = int(leaves[j])
                        near.meet(rows, *_leaf_of(paths[g, other], g, other, names))
                yield _listed(g, leaf, names, x, ids, m, near, k)

    return run


def _listed(g: int, leaf: int, names: list[str], x, ids, m, near: Nearest, k: int):
    import numpy as np
    import pandas as pd

    sums = (m - 1)[:, None] + np.cumsum(near.mb, axis=1)
    enough = np.isfinite(near.d) & (sums >= k)
    core = np.where(enough.any(axis=1), near.d[np.arange(len(x)), enough.argmax(axis=1)], np.inf)
    sizes = np.isfinite(near.d).sum(axis=1)
    lists = {c: [v[i, :n] for i, n in enumerate(sizes)] for c, v in (("near_d", near.d), ("near_b", near.b), ("near_mb", near.mb))}
    out = pd.DataFrame({"g": np.full(len(x), g, np.int32), "id": ids, "m": m, "leaf": np.full(len(x), leaf, np.int32), **dict(zip(names, x.T)), **lists})
    return out.assign(core=np.where(m > k, 0.0, core), reach=near.d[:, -1])


def neighbour_lists(points: DataFrame, names: list[str], k: int) -> DataFrame:
    """Adds near (the nearest distinct vectors: d, b, mb), core (distance to the k-th other row) and reach (no vector off the list is nearer).

    Rows do not move to those who ask: leaves lie in files that all share, and a task reads those that its own leaves need.
    """
    spark = points.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = max(1, math.ceil(points.count() / SHELF_ROWS))
    shelf = kept(points.repartitionByRange(files, "g", "leaf").sortWithinPartitions("g", "leaf"), "density-shelf")
    found = boxes(shelf, names)
    where = shelf.select("g", "leaf", F.col("_metadata.file_path").alias("path")).distinct().toPandas()
    paths = {(int(g), int(leaf)): p for g, leaf, p in zip(where["g"], where["leaf"], where["path"])}
    held = spark.createDataFrame(where[["g", "leaf"]], "g int, leaf int").repartitionByRange(4 * tasks, "g", "leaf").sortWithinPartitions("g", "leaf")
    schema = f"g int, id bigint, m bigint, leaf int, {', '.join(f'{c} double' for c in names)}, near_d array<double>, near_b array<bigint>, near_mb array<bigint>, core double, reach double"
    out = held.mapInPandas(_lists(names, found, paths, k), schema)
    return kept(out.select("g", "id", "m", "leaf", *names, F.arrays_zip("near_d", "near_b", "near_mb").cast("array<struct<d:double,b:bigint,mb:bigint>>").alias("near"), "core", "reach"), "density-near")


def roots(pointers: DataFrame) -> DataFrame:
    """g, c, root: the end of every chain of pointers (g, c, to); an end points to itself."""
    pointers = kept(pointers.select("g", "c", "to"), "density-pointers")
    if pointers.count() <= LOCAL_ROWS:
        import numpy as np

        rows = pointers.toPandas()
        keys = {key: k for k, key in enumerate(zip(rows["g"], rows["c"]))}
        at = np.array([keys[key] for key in zip(rows["g"], rows["to"])], int)
        while (at[at] != at).any():
            at = at[at]
        rows["root"] = rows["c"].to_numpy()[at] if len(at) else rows["c"]
        return pointers.sparkSession.createDataFrame(rows[["g", "c", "root"]], "g int, c bigint, root bigint")
    while True:
        onward = pointers.select("g", F.col("c").alias("to"), F.col("to").alias("next"))
        new = kept(pointers.join(onward, ["g", "to"]).select("g", "c", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "density-pointers")
        pointers = new.select("g", "c", "to")
        if new.where("moved").isEmpty():
            return pointers.withColumnRenamed("to", "root")


def _foreign_bounds(names: list[str], found: dict):
    """For points of components without a listed edge: no lighter edge to another component is heavier than ub."""

    def run(batches):
        import numpy as np

        for b in batches:
            ub = b["bound"].to_numpy(np.float64).copy()
            for g in b["g"].unique():
                _, low, high, more = found[int(g)]
                lo_c, hi_c, _, most_core = more.T
                at = np.flatnonzero((b["g"] == g).to_numpy() & ~np.isfinite(ub))
                for s in range(0, len(at), 512):
                    k = at[s : s + 512]
                    x, c = matrix(b, names)[k], b["c"].to_numpy()[k]
                    away = np.maximum(np.abs(x[:, None, :] - low[None]), np.abs(x[:, None, :] - high[None]))
                    reach = np.maximum(np.sqrt((away**2).sum(axis=2)) * (1 + 1e-12), np.maximum(most_core[None, :], b["core"].to_numpy()[k][:, None]))
                    reach[(lo_c[None, :] == c[:, None]) & (hi_c[None, :] == c[:, None])] = np.inf
                    ub[k] = reach.min(axis=1)
            yield b.assign(bound=ub)

    return run


def _foreign_leaves(names: list[str], found: dict):
    """The leaves that may hold an edge to another component within the bound."""

    def run(batches):
        import numpy as np

        for b in batches:
            for g, rows in b.groupby("g"):
                leaves, low, high, more = found[int(g)]
                lo_c, hi_c, least_core, _ = more.T
                for s in range(0, len(rows), 512):
                    some = rows.iloc[s : s + 512]
                    c = some["c"].to_numpy()[:, None]
                    reach = np.maximum(_box_gaps(matrix(some, names), low, high), np.maximum(least_core[None, :], some["core"].to_numpy()[:, None]))
                    r, k = np.nonzero((reach <= some["bound"].to_numpy()[:, None]) & ~((lo_c[None, :] == c) & (hi_c[None, :] == c)))
                    yield some.iloc[r].assign(leaf=leaves[k].astype("int32"))

    return run


def _lightest_in_leaf(names: list[str]):
    def run(held, asks):
        import numpy as np
        import pandas as pd

        x, ids, comp, core = matrix(held, names), held["id"].to_numpy(), held["c"].to_numpy(), held["core"].to_numpy()
        q, own, c, mine = matrix(asks, names), asks["id"].to_numpy(), asks["c"].to_numpy(), asks["core"].to_numpy()
        rows = []
        for s in range(0, len(q) if len(x) else 0, 256):
            z = slice(s, s + 256)
            w = np.maximum(np.maximum(np.sqrt(gap2(q[z], x)), core[None, :]), mine[z, None])
            w[c[z, None] == comp[None, :]] = np.inf
            least = w.min(axis=1)
            for k in np.flatnonzero(np.isfinite(least)):
                ties = np.flatnonzero(w[k] == least[k])
                a = own[s + k]
                j = min(ties, key=lambda t: (min(a, ids[t]), max(a, ids[t])))
                rows.append((c[s + k], least[k], min(a, ids[j]), max(a, ids[j]), comp[j]))
        out = pd.DataFrame(rows, columns=["c", "w", "lo", "hi", "to"]).sort_values(["c", "w", "lo", "hi"]).drop_duplicates("c")
        return out.assign(g=asks["g"].iloc[0] if len(asks) else 0)[["g", "c", "w", "lo", "hi", "to"]].astype({"g": "int32", "c": "int64", "w": "float64", "lo": "int64", "hi": "int64", "to": "int64"})

    return run


EDGE = ("w", "lo", "hi")


def spanning_tree(points: DataFrame, names: list[str]) -> DataFrame:
    """g, w, lo, hi: the tree of mutual reachability over the points of every g. points: as neighbour_lists gives them."""
    listed = points.select("g", F.col("id").alias("a"), "core", F.explode("near").alias("n")).select("g", "a", "core", F.col("n.d").alias("d"), F.col("n.b").alias("b"))
    cores = points.select("g", F.col("id").alias("b"), F.col("core").alias("core_b"))
    edges = listed.join(cores, ["g", "b"]).select("g", F.greatest("core", "core_b", "d").alias("w"), F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.col("a").alias("ca"), F.col("b").alias("cb"))
    edges = kept(edges.unionByName(edges.select("g", *EDGE, F.col("cb").alias("ca"), F.col("ca").alias("cb"))).distinct(), "density-edges")
    now = kept(points.select("g", "id", "leaf", *names, "core", F.greatest("core", "reach").alias("reach"), F.col("id").alias("c")), "density-components")
    vector = ", ".join(f"{c} double" for c in names)
    tree = None
    for _ in range(MOST_ROUNDS):
        listed = kept(edges.groupBy("g", F.col("ca").alias("c")).agg(F.min(F.struct(*EDGE, F.col("cb").alias("to"))).alias("e")).select("g", "c", "e.*"), "density-listed")
        found = boxes(now, names, F.min("c").alias("lo_c"), F.max("c").alias("hi_c"), F.min("core").alias("least_core"), F.max("core").alias("most_core"))
        split = [g for g, (_, _, _, more) in found.items() if more[:, 0].min() != more[:, 1].max()]
        if not split:
            break
        unsure = now.where(F.col("g").isin(split)).join(listed.select("g", "c", "w"), ["g", "c"], "left").where(F.col("w").isNull() | (F.col("reach") <= F.col("w")))
        unsure = unsure.select("g", "leaf", "id", *names, "core", "c", F.coalesce("w", F.lit(float("inf"))).alias("bound"))
        schema = f"g int, leaf int, id bigint, {vector}, core double, c bigint, bound double"
        unsure = kept(unsure.mapInPandas(_foreign_bounds(names, found), schema), "density-unsure")
        bound = unsure.groupBy("g", "c").agg(F.min("bound").alias("bound"))
        asks = kept(unsure.drop("bound").join(kept(bound, "density-bounds"), ["g", "c"]).select("g", "leaf", "id", *names, "core", "c", "bound").mapInPandas(_foreign_leaves(names, found), schema), "density-asks")
        wide = _by_leaf(now.select("g", "leaf", "id", *names, "core", "c"), asks, _lightest_in_leaf(names), "g int, c bigint, w double, lo bigint, hi bigint, to bigint")
        chosen = listed.unionByName(wide).groupBy("g", "c").agg(F.min(F.struct(*EDGE, "to")).alias("e")).select("g", "c", "e.*")
        chosen = kept(chosen, "density-chosen")
        back = chosen.select("g", F.col("c").alias("to"), F.col("to").alias("back"))
        ends = chosen.join(back, ["g", "to"]).select("g", "c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to"))
        top = kept(roots(ends), "density-roots")
        new = chosen.select("g", *EDGE).distinct()
        tree = new if tree is None else tree.unionByName(new)
        now = kept(now.join(top, ["g", "c"], "left").withColumn("c", F.coalesce("root", "c")).drop("root"), "density-components")
        ends = lambda c: top.select("g", F.col("c").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
        edges = edges.join(ends("ca"), ["g", "ca"]).join(ends("cb"), ["g", "cb"]).where("ca_root <> cb_root")
        edges = kept(edges.select("g", *EDGE, F.col("ca_root").alias("ca"), F.col("cb_root").alias("cb")), "density-edges")
    else:
        raise RuntimeError("the tree did not settle")
    return tree if tree is not None else points.sparkSession.createDataFrame([], "g int, w double, lo bigint, hi bigint")


def condensed(points: DataFrame, tree: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Landings and edges. A landing (g, id, m, big, e) says by which edge a point first was in a component of the least size, and which;
    the edges (g, u, v, e) join these components. Points that never were in one have a null big."""
    e = F.struct(*[F.col(c).alias(c) for c in EDGE])
    alone = F.struct(F.col("core").alias("w"), F.col("id").alias("lo"), F.col("id").alias("hi"))
    whole = F.col("m") >= least
    places = kept(points.select("g", "id", "m", F.col("id").alias("node"), F.when(whole, F.col("id")).alias("big"), F.when(whole, alone).alias("e")), "density-places")
    nodes = kept(points.select("g", F.col("id").alias("node"), F.col("m").alias("size"), whole.alias("is_big")), "density-nodes")
    edges = kept(tree.select("g", F.col("lo").alias("u"), F.col("hi").alias("v"), e.alias("e")), "density-links")
    landed = places.where("big is not null").select("g", "id", "m", "big", "e")
    places = places.where("big is null").select("g", "id", "m", "node")
    for _ in range(MOST_ROUNDS):
        small = nodes.where("not is_big").select("g", "node", "size")
        both = edges.select("g", F.col("u").alias("node"), F.col("v").alias("to"), "e").unionByName(edges.select("g", F.col("v").alias("node"), F.col("u").alias("to"), "e"))
        light = both.join(small, ["g", "node"]).groupBy("g", "node").agg(F.min(F.struct("e", "to")).alias("x"), F.first("size").alias("size"))
        light = kept(light.select("g", "node", "size", "x.e", "x.to"), "density-light")
        if light.isEmpty():
            break
        back = light.select("g", F.col("node").alias("to"), F.col("to").alias("back"))
        up = light.select("g", F.col("node").alias("c"), "to").join(back, ["g", "to"], "left")
        up = kept(up.select("g", "c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to"), F.col("back").isNull().alias("to_big")), "density-up")
        top = kept(roots(up.select("g", "c", "to").unionByName(up.where("to_big").select("g", F.col("to").alias("c"), "to").distinct())), "density-tops")
        bigs = nodes.where("is_big").select("g", F.col("node").alias("root"), F.lit(True).alias("root_big"))
        hung = kept(light.join(top.withColumnRenamed("c", "node"), ["g", "node"]).join(bigs, ["g", "root"], "left").select("g", "node", "size", "e", "root", F.coalesce("root_big", F.lit(False)).alias("root_big")), "density-hung")
        of = lambda c: hung.select("g", F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
        crossing = edges.join(of("u"), ["g", "u"], "left").join(of("v"), ["g", "v"], "left").select("g", F.coalesce("u_root", "u").alias("a"), F.coalesce("v_root", "v").alias("b"), "e").where("a <> b")
        out = crossing.select("g", F.col("a").alias("root"), "e").unionByName(crossing.select("g", F.col("b").alias("root"), "e")).groupBy("g", "root").agg(F.min("e").alias("out"))
        # What joins a growing component before its first edge to another tree.
        merged = kept(hung.join(kept(out, "density-out"), ["g", "root"], "left").where(F.col("root_big") | F.col("out").isNull() | (F.col("e") < F.col("out"))).drop("out"), "density-merged")
        by = Window.partitionBy("g", "root").orderBy("e", "node")
        # As many as the least size tell when it is reached; the ranking keeps that many before the shuffle.
        first = merged.where("not root_big").withColumn("k", F.row_number().over(by)).where(F.col("k") <= least)
        sums = first.withColumn("sum", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        born = kept(sums.where(F.col("sum") >= least).groupBy("g", "root").agg(F.min("e").alias("birth")), "density-born")
        fate = merged.join(born, ["g", "root"], "left").select("g", "node", "root", F.col("root_big") | F.col("birth").isNotNull(), F.when(F.col("root_big"), F.col("e")).when(F.col("birth").isNotNull(), F.greatest("e", "birth")).alias("land")).toDF("g", "node", "root", "now_big", "land")
        fate = kept(fate, "density-fate")
        moved = places.join(fate, ["g", "node"], "left").select("g", "id", "m", F.coalesce("root", "node").alias("node"), F.when(F.col("now_big"), F.col("root")).alias("big"), "land")
        moved = kept(moved, "density-places")
        landed = landed.unionByName(moved.where("big is not null").select("g", "id", "m", "big", F.col("land").alias("e")))
        places = moved.where("big is null").select("g", "id", "m", "node")
        grown = nodes.join(fate, ["g", "node"], "left").select("g", F.coalesce("root", "node").alias("node"), "size", (F.col("is_big") | F.coalesce("now_big", F.lit(False))).alias("is_big"))
        nodes = kept(grown.groupBy("g", "node").agg(F.sum("size").alias("size"), F.max("is_big").alias("is_big")), "density-nodes")
        to = lambda c: fate.select("g", F.col("node").alias(c), F.col("root").alias(f"{c}_to"))  # noqa: B023, E731
        edges = edges.join(to("u"), ["g", "u"], "left").join(to("v"), ["g", "v"], "left").select("g", F.coalesce("u_to", "u").alias("u"), F.coalesce("v_to", "v").alias("v"), "e").where("u <> v")
        edges = kept(edges, "density-links")
    else:
        raise RuntimeError("the condensed tree did not settle")
    rest = places.select("g", "id", "m", F.lit(None).cast("bigint").alias("big"), F.lit(None).cast(landed.schema["e"].dataType).alias("e"))
    return landed.unionByName(rest), edges


class Clusters:
    """The tree of the components of the least size: first they themselves, then every union of two. Built from at most rows / least rows."""

    def __init__(self, bigs, edges):
        import numpy as np

        self.leaf = {key: k for k, key in enumerate(bigs)}
        n, parent, at = len(bigs), [-1] * len(bigs), [(math.inf, 0, 0)] * len(bigs)
        top, holder = list(range(n)), list(range(n))

        def find(k):
            while top[k] != k:
                top[k] = top[top[k]]
                k = top[k]
            return k

        for e, g, u, v in sorted(edges):
            a, b = find(self.leaf[g, u]), find(self.leaf[g, v])
            parent[holder[a]] = parent[holder[b]] = len(parent)
            at[holder[a]] = at[holder[b]] = e
            top[b], holder[a] = a, len(parent)
            parent.append(-1), at.append((math.inf, 0, 0))
        self.parent, self.w, self.lo, self.hi = np.array(parent, int), np.array([x[0] for x in at], float), np.array([x[1] for x in at], int), np.array([x[2] for x in at], int)

    def landing(self, start, w, lo, hi):
        """The cluster that held the component `start` when the edge (w, lo, hi) came."""
        import numpy as np

        at = start.copy()
        while True:
            pw, plo, phi = self.w[at], self.lo[at], self.hi[at]
            earlier = (self.parent[at] >= 0) & ((pw < w) | ((pw == w) & ((plo < lo) | ((plo == lo) & (phi < hi)))))
            if not earlier.any():
                return at
            at = np.where(earlier, self.parent[at], at)

    def chosen(self, counts, masses):
        """The cluster that each cluster's points count to by excess of mass, -1 for noise. counts, masses: points that landed there and their sum of 1 / w."""
        import numpy as np

        n = len(self.parent)
        size, lam = counts.astype(float).copy(), 1.0 / np.maximum(self.w, TINY)
        below, taken = np.zeros(n), np.zeros(n, bool)
        birth = np.where(self.parent >= 0, lam, 0.0)
        mass = masses - counts * birth
        for c in range(n):  # children come before their parents
            p = self.parent[c]
            if p >= 0:
                taken[c] = mass[c] >= below[c]
                below[p] += max(mass[c], below[c])
                size[p] += size[c]
                mass[p] += size[c] * (lam[c] - birth[p])
        out = np.full(n, -1)
        for c in range(n - 1, -1, -1):
            p = self.parent[c]
            out[c] = out[p] if p >= 0 and out[p] >= 0 else c if taken[c] else -1
        return out


def clustered(points: DataFrame, names: list[str], least: int = 50, k: int = 10) -> DataFrame:
    """g, id, label of every row: clusters of each g by excess of mass, numbered by their least id; -1 is noise. A root is never chosen.

    points: g, id (unique within g), and the vector's columns, none null. Groups are clustered side by side. With a column m the vectors of a group
    differ, a row stands for m equal ones, and id is their least.
    """
    import numpy as np

    spark = points.sparkSession
    weighted = "m" in points.columns
    more = [F.col("m").cast("bigint").alias("m")] if weighted else []
    points = kept(points.select(F.col("g").cast("int").alias("g"), F.col("id").cast("bigint").alias("id"), *[F.col(c).cast("double").alias(c) for c in names], *more), "density-points")
    distinct = neighbour_lists(indexed(points, names), names, k)
    sizes = points.groupBy("g").agg((F.sum("m") if weighted else F.count(F.lit(1))).alias("rows")).where((F.col("rows") >= 2 * least) & (F.col("rows") > k)).select("g")
    distinct = kept(distinct.join(F.broadcast(sizes), "g"), "density-groups")
    landed, edges = condensed(distinct, spanning_tree(distinct, names), least)
    landed = kept(landed, "density-landed")
    bigs = [(r.g, r.big) for r in landed.where("big is not null").select("g", "big").distinct().orderBy("g", "big").collect()]
    tree = Clusters(bigs, [(tuple(r.e), r.g, r.u, r.v) for r in edges.collect()])
    shared = spark.sparkContext.broadcast(tree)

    def place(batches):
        t = shared.value
        for b in batches:
            start = np.array([t.leaf[key] for key in zip(b["g"], b["big"])], int)
            at = t.landing(start, b["w"].to_numpy(), b["lo"].to_numpy(), b["hi"].to_numpy())
            yield b[["g", "id", "m"]].assign(cluster=at, mass=b["m"] / np.maximum(b["w"].to_numpy(), TINY))

    asked = landed.where("big is not null").select("g", "id", "m", "big", "e.*")
    placed = kept(asked.mapInPandas(place, "g int, id bigint, m bigint, cluster bigint, mass double"), "density-placed")
    found = placed.groupBy("cluster").agg(F.sum("m").alias("n"), F.sum("mass").alias("mass"), F.min("id").alias("first"), F.first("g").alias("g")).collect()
    counts, masses, first = np.zeros(len(tree.parent)), np.zeros(len(tree.parent)), {}
    for r in found:
        counts[r.cluster], masses[r.cluster] = r.n, r.mass
    final = tree.chosen(counts, masses)
    for r in found:
        c = int(final[r.cluster])
        if c >= 0:
            first[c] = min(first.get(c, (r.g, r.first)), (r.g, r.first))
    number: dict[int, int] = {}
    names_of: dict[int, int] = {}
    for c, (g, _) in sorted(first.items(), key=lambda x: x[1]):
        names_of[c] = number.get(g, 0)
        number[g] = names_of[c] + 1
    labels = spark.createDataFrame([(int(r.cluster), names_of.get(int(final[r.cluster]), -1)) for r in found], "cluster bigint, label int")
    small = F.broadcast(labels) if len(found) <= LOCAL_ROWS else labels
    of = kept(placed.join(small, "cluster").select("g", "id", "label"), "density-labels")
    if weighted:
        return points.select("g", "id").join(of, ["g", "id"], "left").select("g", "id", F.coalesce("label", F.lit(-1)).alias("label"))
    each = kept(distinct.join(of, ["g", "id"], "left").select("g", *names, F.coalesce("label", F.lit(-1)).alias("label")), "density-each")
    return points.join(each, ["g", *names], "left").select("g", "id", F.coalesce("label", F.lit(-1)).alias("label"))
