"""Vector code compression: a codebook for each of a vector's parts, fitted by Hamerly's form of Lloyd.

Every part keeps, in a written table, its entry, one upper bound of its distance to
that entry and one lower bound of its distance to the second-nearest. When the entries
have moved, the upper bound grows by its own entry's move and the lower one shrinks by
the largest move of another. While the upper bound lies strictly below the lower one, or
below half the distance from its entry to the nearest other entry, the entry is the only nearest and stays
without a look at the others. Else the upper bound is made exact, and if the test still
fails, all entries are scanned in integers, which gives ties to the lower index. Bounds are rounded
outwards, so they never hide a tie.

Codebooks (parts x entries x components, all parameters) travel with the tasks; entry sums
are taken per partition and merged by Spark. Integer arithmetic makes results
independent of partitions, order and retries.

Defined cases: vectors that are null, hold a null or non-finite component or have another length than dims have
no row; scaled components beyond 2^26 count as 2^26 (so do negative ones); entries start as the rows of the least ids, a null
id last, equal ids by their bytes; with fewer kept rows there are as many entries; equal
entries are never both used; unused ones stay; repeated rows have a row each; null labels
form one label; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored
from .vectors import by_rows, integer_table, summed, unpacked

PARTS = 16
ENTRIES = 64
ROUNDS = 2
DIMS = 64
SCALE = 256


def _up(x):
    import numpy as np

    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x):
    import numpy as np

    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def scan(x, entries):
    """Entry, squared distance and squared distance of the second-nearest. x: rows of one part; entries: its codebook."""
    import numpy as np

    d = np.zeros((len(x), len(entries)), np.int64)
    for j in range(x.shape[1]):
        diff = x[:, j, None] - entries[None, :, j]
        d += diff * diff
    at, rows = d.argmin(axis=1), np.arange(len(x))
    least = d[rows, at]
    if len(entries) == 1:
        return at, least, np.full(len(x), np.inf)
    d[rows, at] = np.iinfo(np.int64).max
    return at, least, d.min(axis=1).astype(np.float64)


class Moves:
    """What the tasks need of the last step: the codebooks, each entry's move, the largest move of another entry, and half the distance to the nearest other entry."""

    def __init__(self, before, now):
        import numpy as np

        self.books = now
        self.own = np.sqrt(((now - before) ** 2).sum(axis=2).astype(np.float64))
        parts, m = self.own.shape
        self.other, self.half = np.zeros((parts, m)), np.full((parts, m), np.inf)
        if m > 1:
            top = np.argsort(self.own, axis=1)
            for p in range(parts):
                first, second = top[p, -1], top[p, -2]
                self.other[p] = self.own[p, first]
                self.other[p, first] = self.own[p, second]
                gaps = ((now[p][:, None, :] - now[p][None, :, :]) ** 2).sum(axis=2).astype(np.float64)
                np.fill_diagonal(gaps, np.inf)
                self.half[p] = _down(np.sqrt(gaps.min(axis=1)) / 2)


def settled(x, p: int, code, upper, lower, moves: Moves):
    """One part of some rows after a move: new entries and bounds, and how many were scanned."""
    import numpy as np

    code = code.astype(np.int64)
    upper = _up(upper.astype(np.float64) + moves.own[p][code])
    lower = _down(lower.astype(np.float64) - moves.other[p][code])
    limit = np.maximum(lower, moves.half[p][code])
    open_ = np.flatnonzero(~(upper < limit))
    if len(open_):
        diff = x[open_] - moves.books[p][code[open_]]
        upper[open_] = _up(np.sqrt((diff * diff).sum(axis=1).astype(np.float64)))
        open_ = open_[~(upper[open_] < limit[open_])]
    if len(open_):
        code[open_], least, second = scan(x[open_], moves.books[p])
        upper[open_], lower[open_] = _up(np.sqrt(least.astype(np.float64))), _down(np.sqrt(second))
    return code, upper, lower, len(open_)


def _arrays(batch, at: int, kind: str, parts: int):
    import numpy as np

    return np.frombuffer(b"".join(batch.column(at).to_pylist()), kind).reshape(-1, parts).copy()


def _blobs(a, kind: str) -> list[bytes]:
    return [r.tobytes() for r in a.astype(kind)]


STATE = "v binary, code binary, upper binary, lower binary"
NAMES = ["v", "code", "upper", "lower"]


def _state_batch(batch, v, code, upper, lower):
    import pyarrow as pa

    blobs = [batch.column("v"), *(pa.array(_blobs(a, kind), pa.binary()) for a, kind in ((code, "<u2"), (upper, "<f4"), (lower, "<f4")))]
    return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *blobs], names=["vec_id", "label", *NAMES])


def _first(books, parts: int, dims: int):
    def run(batches):
        import numpy as np

        for whole in batches:
            for batch in by_rows(whole):
                v = unpacked(batch.column("v").to_pylist(), dims)
                x = v.reshape(len(v), parts, -1)
                code, upper, lower = np.zeros((len(v), parts), np.int64), np.zeros((len(v), parts), np.float32), np.zeros((len(v), parts), np.float32)
                for p in range(parts):
                    code[:, p], least, second = scan(x[:, p], books[p])
                    upper[:, p], lower[:, p] = _up(np.sqrt(least.astype(np.float64))), _down(np.sqrt(second))
                yield _state_batch(batch, v, code, upper, lower)

    return run


def _again(moves: Moves, parts: int, dims: int):
    def run(batches):
        for whole in batches:
            for batch in by_rows(whole):
                v, code, upper, lower = _settled_batch(batch, moves, parts, dims)
                yield _state_batch(batch, v, code, upper, lower)

    return run


def _settled_batch(batch, moves: Moves, parts: int, dims: int):
    v = unpacked(batch.column("v").to_pylist(), dims)
    x = v.reshape(len(v), parts, -1)
    code, upper, lower = _arrays(batch, 3, "<u2", parts), _arrays(batch, 4, "<f4", parts), _arrays(batch, 5, "<f4", parts)
    for p in range(parts):
        code[:, p], upper[:, p], lower[:, p], _ = settled(x[:, p], p, code[:, p], upper[:, p], lower[:, p], moves)
    return v, code, upper, lower


def _final(moves: Moves, parts: int, dims: int):
    """Codes and exact errors after the last move."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for batch in by_rows(whole):
                v, code, _, _ = _settled_batch(batch, moves, parts, dims)
                diff = v.reshape(len(v), parts, -1) - moves.books[np.arange(parts)[None, :], code]
                error = (diff * diff).sum(axis=(1, 2))
                names = [bytes(r).hex() for r in code.astype(np.uint8)] if moves.books.shape[1] <= 256 else [r.astype(">u2").tobytes().hex() for r in code]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(names, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def _sums(parts: int, entries: int, dims: int):
    """One row per part, entry and component of a partition: what its parts sum to."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        width = dims // parts
        total, n = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        place = np.arange(parts) * entries
        for whole in batches:
            for batch in by_rows(whole):
                x = unpacked(batch.column(0).to_pylist(), dims).reshape(-1, width)
                at = (_arrays(batch, 1, "<u2", parts) + place).reshape(-1)
                order = np.argsort(at, kind="stable")
                used, starts = np.unique(at[order], return_index=True)
                if len(used):
                    total[used] += np.add.reduceat(x[order], starts, axis=0)
                    n += np.bincount(at, minlength=len(n))
        used = np.flatnonzero(n)
        columns = [np.repeat(used, width), np.tile(np.arange(width), len(used)), total[used].reshape(-1), np.repeat(n[used], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(columns, ("i4", "i4", "i8", "i8"))], names=["entry", "place", "total", "n"])

    return run


def moved(state: DataFrame, books, dims: int):
    """Every used entry at the floor of the mean of its parts."""
    parts, entries, _ = books.shape
    new = books.copy()
    sums = state.select("v", "code").mapInArrow(_sums(parts, entries, dims), "entry int, place int, total bigint, n bigint")
    for r in summed(sums, ["entry", "place"]):
        new[r.entry // entries, r.entry % entries, r.place] = r.total // r.n
    return new


def starting_codebooks(vectors: DataFrame, parts: int, entries: int, dims: int):
    """(parts, entries, components): the parts of the rows with the least ids."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    return unpacked([bytes(r.v) for r in rows], dims).reshape(len(rows), parts, dims // parts).swapaxes(0, 1).copy()


def fitted(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE):
    """The codebooks as an int64 array (parts, entries, components), and vec_id, label, code, error of every kept row (None without a kept row)."""
    if dims % parts:
        raise ValueError(f"{dims} components cannot be cut into {parts} equal parts")
    small = rows.select(F.col(id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("embedding"))
    vectors = integer_table(small, "vec_id", "embedding", dims, scale, "label")
    books = starting_codebooks(vectors, parts, entries, dims)
    if not books.shape[1]:
        return books, None
    kind = vectors.schema["label"].dataType.simpleString()
    schema = f"vec_id bigint, label {kind}, {STATE}"
    state, before = stored(vectors.mapInArrow(_first(books, parts, dims), schema), "codes"), books
    for k in range(rounds):
        if k:
            state = stored(state.mapInArrow(_again(Moves(before, books), parts, dims), schema), "codes")
        before, books = books, moved(state, books, dims)
    done = state.mapInArrow(_final(Moves(before, books), parts, dims), f"vec_id bigint, label {kind}, code string, error bigint")
    return books, stored(done, "codes-final")


def codebooks_digest(books) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compressed(rows: DataFrame, **options) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    books, codes = fitted(rows, **options)
    if codes is None:
        return rows.sparkSession.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    # Written and counted before it is joined: few labels are broadcast, many are shuffled, where Spark splits a hot one.
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    labels = stored(codes.groupBy("label").agg(F.least(total, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("bigint").alias("label_error")).withColumnRenamed("label", "__aw_label"), "codes-labels")
    joined = codes.join(broadcast_if_small(labels, labels.count()), F.col("label").eqNullSafe(F.col("__aw_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def decompressed(codes: DataFrame, books, scale: int = SCALE) -> DataFrame:
    """vec_id, embedding: the vectors that the codes stand for, at the middle of their integer cells."""
    parts, entries, width = books.shape
    digits = 2 if entries <= 256 else 4

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            at = np.frombuffer(bytes.fromhex("".join(batch.column(1).to_pylist())), np.uint8 if digits == 2 else ">u2").reshape(-1, parts).astype(np.int64)
            v = ((books[np.arange(parts)[None, :], at] + 0.5) / scale).reshape(-1)
            offsets = np.arange(0, len(v) + 1, parts * width, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(v))], names=["vec_id", "embedding"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id bigint, embedding array<double>")
