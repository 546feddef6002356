"""Vectors as integers, packed into bytes for tables that are read again and again."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Scaled components are held within this bound, so that squared distances of 64 components fit in a long.
MOST = 1 << 26
ROWS = 4096


def integers(column, dims: int, scale: int):
    """A mask of the rows that have exactly dims components, none null or non-finite, and their floor(scale * x), an int64 row each. column: an Arrow list of doubles."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    right = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    flat = column.filter(right).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    whole = np.isfinite(flat).all(axis=1)
    mask = right.to_numpy(zero_copy_only=False).astype(bool)
    mask[mask] = whole
    with np.errstate(over="ignore"):
        return mask, np.clip(np.floor(flat[whole] * scale), -MOST, MOST).astype(np.int64)


def packed(v) -> list[bytes]:
    """A row's components as little-endian integers of 16 bits, or of 32 where one needs them."""
    import numpy as np

    narrow = ((v >= -(1 << 15)) & (v < 1 << 15)).all(axis=1).tolist()
    wide, thin = v.astype("<i4"), v.astype("<i2")
    return [(thin if n else wide)[k].tobytes() for k, n in enumerate(narrow)]


def unpacked(blobs: list[bytes], dims: int):
    import numpy as np

    out = np.empty((len(blobs), dims), np.int64)
    sizes = np.array([len(b) for b in blobs], np.int64)
    for size, kind in ((2 * dims, "<i2"), (4 * dims, "<i4")):
        rows = np.flatnonzero(sizes == size)
        if len(rows):
            out[rows] = np.frombuffer(b"".join(blobs if len(rows) == len(blobs) else [blobs[k] for k in rows.tolist()]), kind).reshape(-1, dims)
    return out


def by_rows(batch) -> list:
    """An Arrow batch in slices that bound the memory of a computation."""
    return [batch.slice(k, ROWS) for k in range(0, batch.num_rows, ROWS)]


def integer_table(rows: DataFrame, id: str, vector: str, dims: int, scale: int, label: str | None = None) -> DataFrame:
    """id, (label,) v: the rows that integers() keeps, packed and written once."""
    others = [id] if label is None else [id, label]
    source = rows.select(*[F.col(c) for c in others], F.col(vector).cast("array<double>").alias("v"))
    fields = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in others)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in by_rows(whole):
                mask, v = integers(batch.column(len(others)), dims, scale)
                keep = pa.array(mask)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).filter(keep) for k in range(len(others))), pa.array(packed(v), pa.binary())], names=[*others, "v"])

    return stored(source.mapInArrow(run, f"{fields}, v binary"), "integer-vectors")


def summed(parts: DataFrame, keys: list[str]) -> list:
    """Per-partition sums (keys, total, n) merged by Spark; the caller bounds the number of keys."""
    return parts.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()


