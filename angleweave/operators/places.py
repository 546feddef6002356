"""The r-th nearest pair of a place on the torus, exactly, without lists of neighbours.

Blocks. Counts of a grid of cells tell how far from a cell its nearest `most` pairs can be. Cells are joined to blocks of bounded numbers of pairs,
and a block holds the pairs of its own cells and of all cells that one of its places may need. So a place is answered in its own block,
and nothing but the answer leaves it. Within a block the same rule runs over a finer grid of the block's own pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of the grid in either direction at most (their counts come to the driver, those of a group at a time are few), pairs of a cell and of a block, about.
MOST_CELLS = 256
CELL = 12
LEAST_BLOCK, BLOCK = 4_000, 50_000
#: Distances that are held at once.
MEASURED = 1_000_000


def _squares(counts, m: int, wraps: tuple[bool, bool]):
    """How many pairs lie within m cells of every cell in both directions."""
    import numpy as np

    out = counts.astype(np.int64)
    for axis in (0, 1):
        n = out.shape[axis]
        if wraps[axis] and 2 * m + 1 >= n:
            out = np.broadcast_to(out.sum(axis=axis, keepdims=True), out.shape)
            continue
        out = np.concatenate([np.take(out, range(n - m, n), axis), out, np.take(out, range(m), axis)], axis) if wraps[axis] else np.pad(out, [(m, m) if k == axis else (0, 0) for k in (0, 1)])
        ends = np.concatenate([np.zeros_like(np.take(out, [0], axis)), np.cumsum(out, axis)], axis)
        out = np.take(ends, range(2 * m + 1, 2 * m + 1 + n), axis) - np.take(ends, range(n), axis)
    return out


def rings(counts, asked, need: int, widths: tuple[float, float], wraps: tuple[bool, bool] = (True, True)):
    """For every asked cell: a number of cells, beyond which in either direction no pair is among the `need` nearest of any of its places."""
    import numpy as np

    out, wide = np.zeros(counts.shape, np.int64), max(counts.shape)
    need, left, m = min(need, int(counts.sum())), asked.copy(), 0
    while left.any():
        done = left & (_squares(counts, m, wraps) >= need) if m < wide else left
        # As far as all `need` may be, by the chord; whatever lies R cells away is at least as far.
        chord = sum(math.sin(min((m + 1) * w, math.pi) / 2) ** 2 for w in widths)
        far = math.ceil(2 * math.asin(math.sqrt(chord)) / min(widths) * (1 + 1e-9) + 1e-6) if chord < 1 and m < wide else wide
        out[done] = min(far, wide)
        left &= ~done
        m += 1 if m < 8 else m // 4
    return out


class Blocks:
    """Cells, their block, and the blocks that hold each cell's pairs; all by group."""

    def __init__(self, cells, most: int, size: int, n: int):
        import numpy as np

        self.n, self.w, self.groups, self.total = n, 2 * math.pi / n, {}, {}
        self.corner = []
        for g, rows in cells.groupby("g"):
            pairs, asked = np.zeros((n, n), np.int64), np.zeros((n, n), bool)
            pairs[rows["x"], rows["y"]], asked[rows["x"], rows["y"]] = rows["pairs"], rows["places"] > 0
            far, block, todo, held = rings(pairs, asked, most, (self.w, self.w)), np.zeros((n, n), np.int64), [(0, n, 0, n)], []
            while todo:
                a, b, c, d = todo.pop()
                part = pairs[a:b, c:d]
                if part.sum() > size and part.size > 1:
                    axis = int(b - a < d - c)
                    sums = np.cumsum(part.sum(axis=1 - axis))
                    at = min(max(int(np.searchsorted(sums, sums[-1] / 2)) + 1, 1), len(sums) - 1)
                    todo += [(a, a + at, c, d), (a + at, b, c, d)] if axis == 0 else [(a, b, c, c + at), (a, b, c + at, d)]
                    continue
                r = int(far[a:b, c:d].max(initial=0))
                k = len(self.corner)
                block[a:b, c:d] = k
                x0, nx = (0, n) if b - a + 2 * r >= n else (a - r, b - a + 2 * r)
                y0, ny = (0, n) if d - c + 2 * r >= n else (c - r, d - c + 2 * r)
                self.corner.append((x0, nx, y0, ny))
                x, y = np.meshgrid(np.arange(x0, x0 + nx) % n, np.arange(y0, y0 + ny) % n, indexing="ij")
                held.append(((x * n + y).ravel(), np.full(nx * ny, k)))
            cell, k = (np.concatenate(v) for v in zip(*held))
            order = np.argsort(cell, kind="stable")
            self.groups[g] = block.ravel(), np.searchsorted(cell[order], np.arange(n * n + 1)), k[order]
            self.total[g] = int(pairs.sum())

    def cell(self, phi, psi):
        import numpy as np

        x, y = (np.floor((v + math.pi) / self.w).astype(np.int64) % self.n for v in (phi, psi))
        return x * self.n + y

    def of(self, group, phi, psi):
        """The block of every place."""
        import numpy as np

        cell, out = self.cell(phi, psi), np.zeros(len(phi), np.int64)
        for g in set(group):
            at = group == g
            out[at] = self.groups[g][0][cell[at]]
        return out

    def holders(self, group, phi, psi):
        """Row and block for every block that a pair belongs to."""
        import numpy as np

        cell, rows, blocks = self.cell(phi, psi), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for g in set(group):
            at = np.flatnonzero(group == g)
            _, start, k = self.groups[g]
            first, times = start[cell[at]], start[cell[at] + 1] - start[cell[at]]
            rows.append(np.repeat(at, times))
            blocks.append(k[np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())])
        return np.concatenate(rows), np.concatenate(blocks)


def blocks(pairs: DataFrame, places: DataFrame, most: int) -> Blocks:
    """pairs, places: g, phi, psi, all defined. What comes to the driver is a count a cell, at most MOST_CELLS squared of a group."""
    total = pairs.groupBy("g").count().agg(F.max("count").alias("m"), F.sum("count").alias("n")).first()
    n = min(MOST_CELLS, max(1, math.isqrt((total.m or 0) // CELL)))
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = min(BLOCK, max(LEAST_BLOCK, (total.n or 0) // (2 * tasks)))
    cell = lambda c: F.pmod(F.floor((F.col(c) + math.pi) / F.lit(2 * math.pi / n)), F.lit(n)).cast("int")
    both = pairs.select("g", cell("phi").alias("x"), cell("psi").alias("y"), F.lit(1).alias("p"), F.lit(0).alias("q")).unionByName(places.select("g", cell("phi").alias("x"), cell("psi").alias("y"), F.lit(0).alias("p"), F.lit(1).alias("q")))
    return Blocks(both.groupBy("g", "x", "y").agg(F.sum("p").alias("pairs"), F.sum("q").alias("places")).toPandas(), most, size, n)


class Ground:
    """The pairs of one block in a grid of their own."""

    #: Pairs of a cell, about.
    FINE = 3

    def __init__(self, found: Blocks, block: int, phi, psi, chain, pos):
        import numpy as np

        x0, nx, y0, ny = found.corner[block]
        self.wraps, self.w, self.n, self.low = (nx >= found.n, ny >= found.n), found.w, found.n, (x0, y0)
        side = (nx * found.w, ny * found.w)
        fine = math.sqrt(side[0] * side[1] * self.FINE / max(len(phi), 1))
        self.shape = tuple(max(1, min(2048, int(s / fine))) for s in side)
        self.widths, self.side = tuple(s / k for s, k in zip(side, self.shape)), side
        cx, cy = self.at(phi, psi)
        cell = cx * self.shape[1] + cy
        # Of one cell in the order of chain and place, so that ties are met in it.
        self.order = np.lexsort((pos, chain, cell))
        self.phi, self.psi = phi[self.order], psi[self.order]
        rank = np.empty(len(phi), np.int64)
        rank[np.lexsort((pos, chain))] = np.arange(len(phi))
        self.rank = rank[self.order]
        self.counts = np.bincount(cell, minlength=self.shape[0] * self.shape[1]).reshape(self.shape)
        self.start = np.concatenate([[0], np.cumsum(self.counts.ravel())])

    def at(self, phi, psi):
        import numpy as np

        out = []
        for v, low, w, side, k in zip((phi, psi), self.low, self.widths, self.side, self.shape):
            coarse = np.floor((v + math.pi) / self.w)
            inside = (coarse.astype(np.int64) - low) % self.n * self.w + (v + math.pi - coarse * self.w)
            out.append(np.clip((inside / w).astype(np.int64), 0, k - 1))
        return out

    def _spans(self, low: int, high: int, axis: int) -> list[tuple[int, int]]:
        n = self.shape[axis]
        if not self.wraps[axis]:
            return [(max(low, 0), min(high, n))]
        if high - low >= n:
            return [(0, n)]
        low, high = low % n, low % n + high - low
        return [(low, high)] if high <= n else [(low, n), (0, high - n)]

    def nearest(self, phi, psi, rank):
        """For every place the pair that is rank-th (from 0) by distance, chain and place; as a row number of the block."""
        import numpy as np

        out, ranks = np.zeros(len(phi), np.int64), [8, 32, 128]
        cx, cy = self.at(phi, psi)
        while ranks[-1] <= rank.max(initial=0):
            ranks.append(4 * ranks[-1])
        for least, need in zip([0, *ranks], ranks):
            asks = np.flatnonzero((rank >= least) & (rank < need))
            if not len(asks):
                continue
            asked = np.zeros(self.shape, bool)
            asked[cx[asks], cy[asks]] = True
            far = rings(self.counts, asked, need, self.widths, self.wraps)
            reach = far[cx[asks], cy[asks]]
            # Places of one tile ask together; a tile is about as wide as what they need.
            tile = max(1, int(np.median(reach)))
            tx, ty = cx[asks] // tile, cy[asks] // tile
            order = np.lexsort((ty, tx))
            cuts = np.flatnonzero(np.diff(tx[order]) | np.diff(ty[order])) + 1
            for part in np.split(order, cuts):
                who, r = asks[part], int(reach[part].max())
                xs = [x for a, b in self._spans(int(cx[who].min()) - r, int(cx[who].max()) + r + 1, 0) for x in range(a, b)]
                ys = self._spans(int(cy[who].min()) - r, int(cy[who].max()) + r + 1, 1)
                near = np.concatenate([np.arange(self.start[x * self.shape[1] + a], self.start[x * self.shape[1] + b]) for x in xs for a, b in ys])
                step = max(1, MEASURED // max(len(near), 1))
                for s in range(0, len(who), step):
                    out[who[s : s + step]] = self.order[self._ranked(near, phi[who[s : s + step]], psi[who[s : s + step]], rank[who[s : s + step]])]
        return out

    def _ranked(self, near, phi, psi, rank):
        import numpy as np

        half = [np.sin((a[None, :] - b[:, None]) / 2) for a, b in ((self.phi[near], phi), (self.psi[near], psi))]
        d = 2 * np.sqrt(half[0] * half[0] + half[1] * half[1])
        rows = np.arange(len(d))
        last = np.sort(d, axis=1)[rows, rank][:, None]
        ties = d == last
        out = near[ties.argmax(axis=1)]
        more = np.flatnonzero(ties.sum(axis=1) > 1)
        if len(more):
            order = np.argsort(self.rank[near], kind="stable")
            before = rank[more] - (d[more] < last[more]).sum(axis=1)
            out[more] = near[order[(np.cumsum(ties[more][:, order], axis=1) == before[:, None] + 1).argmax(axis=1)]]
        return out
