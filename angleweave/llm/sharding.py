"""Sharding by extendible hashing, in DataFrame operations only.

A key's hash gives 60 bits from its md5 and, after them, 60 bits of a number that
tells rows of equal keys apart. A bucket is a prefix of these bits. A bucket whose
rows exceed the byte limit is split on its next bit, and no other bucket is. The
directory maps the prefixes of a global depth to buckets; it is kept as a table of
the non-empty prefixes, so it grows with the shards, not as a power of the depth.

Rather than splitting bit by bit, one round sums bytes for cells of G more bits,
adds them up for every shorter prefix, and reads all splits from these sums: a
bucket ends at the first prefix that fits. Only the rows of cells that are still
too large enter another round, eight bits deeper.

The directory is counted; only up to BROADCAST_ROWS cells are broadcast to the rows.

Defined cases: a null key hashes as the string "null"; a null text has 0 bytes; an
empty table gives no rows; repeated rows share a bucket until it is too large and
are then told apart by the second 60 bits; one row above the limit gets a shard of
its own, which is the only way a shard exceeds the limit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stored

BITS = 60


def hash_bits(value: Column) -> Column:
    """The first 60 bits of the md5 of a string."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("bigint")


def _prefix(depth: Column, high: str = "h1", low: str = "h2") -> tuple[Column, Column]:
    d1 = F.least(depth, F.lit(BITS))
    d2 = F.greatest(depth - F.lit(BITS), F.lit(0))
    return F.call_function("shiftright", F.col(high), (F.lit(BITS) - d1).cast("int")), F.call_function("shiftright", F.col(low), (F.lit(BITS) - d2).cast("int"))


def _name(depth: Column, p1: Column, p2: Column) -> Column:
    high = F.when(depth > 0, F.lpad(F.bin(p1), F.least(depth, F.lit(BITS)), "0")).otherwise(F.lit(""))
    low = F.when(depth > BITS, F.lpad(F.bin(p2), depth - BITS, "0")).otherwise(F.lit(""))
    return F.concat(high, low)


def keyed_rows(df: DataFrame, key: str, size: Column, row: str | None = None) -> DataFrame:
    """key (or the row's own number, where a column holds one), its hash, its bytes. Without such a column the number is drawn once, in a written table."""
    k = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    rows = df.select(F.col(row or key).alias("key"), hash_bits(k).alias("h1"), size.cast("bigint").alias("bytes"), number.alias("rid"))
    rows = rows.withColumn("h2", hash_bits(F.col("rid").cast("string"))).drop("rid")
    return stored(rows, "sharding-keys")


def _round(rows: DataFrame, base: int, bits: int, limit: int) -> DataFrame:
    """The directory of the cells at depth base + bits: c1, c2, depth, p1, p2, shard_bytes, shard_rows, open."""
    deep = base + bits
    c1, c2 = _prefix(F.lit(deep))
    cells = stored(rows.groupBy(c1.alias("c1"), c2.alias("c2")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")), "sharding-cells")
    # A cell's prefix of depth d, from its own bits.
    d = F.col("depth")
    up1 = F.call_function("shiftright", F.col("c1"), (F.lit(min(deep, BITS)) - F.least(d, F.lit(BITS))).cast("int"))
    up2 = F.call_function("shiftright", F.col("c2"), (F.lit(max(deep - BITS, 0)) - F.greatest(d - BITS, F.lit(0))).cast("int"))
    low2 = F.when(d > BITS, up2).otherwise(F.lit(0).cast("bigint"))
    paths = cells.select("*", F.explode(F.sequence(F.lit(base), F.lit(deep))).alias("depth")).select("*", up1.alias("p1"), low2.alias("p2"))
    nodes = stored(paths.groupBy("depth", "p1", "p2").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows")), "sharding-nodes")
    inner = nodes.filter((F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)).select("depth", "p1", "p2")
    split = paths.join(inner.hint("merge"), ["depth", "p1", "p2"]).groupBy("c1", "c2").agg((F.max("depth") + 1).alias("leaf"))
    leaves = cells.join(split.hint("merge"), ["c1", "c2"], "left").select("c1", "c2", F.coalesce("leaf", F.lit(base)).alias("depth"))
    leaves = leaves.withColumn("open", d > deep).withColumn("depth", F.least(d, F.lit(deep)))
    leaves = leaves.select("c1", "c2", "depth", "open", up1.alias("p1"), low2.alias("p2"))
    # Cells and nodes grow with the shards; both sides of these joins are of their size, so neither is broadcast.
    return leaves.join(nodes.hint("merge"), ["depth", "p1", "p2"])


def assign_shards(df: DataFrame, key: str = "doc_id", size: Column | None = None, limit: int = 1 << 20, row: str | None = None) -> DataFrame:
    """One row per input row: the key (or row, a column of unique numbers), shard (the bits of its bucket), depth, bytes, shard_bytes, shard_rows.
    Rows of one key stay together until the key's own bits are used up; then their numbers part them."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) if size is None else F.coalesce(size, F.lit(0))
    rows = keyed_rows(df, key, size, row)
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    base, bits, done = 0, max(4, math.ceil(math.log2(max(1, total / limit))) + 4), None
    while True:
        bits = min(bits, 2 * BITS - base)
        directory = stored(_round(rows, base, bits, limit), "sharding-directory")
        c1, c2 = _prefix(F.lit(base + bits))
        # About 16 cells a shard: beyond the counted limit rows of a key, two hashes and a size are shuffled to them.
        side = F.broadcast(directory) if directory.count() <= BROADCAST_ROWS else directory.hint("merge")
        placed = rows.select("*", c1.alias("c1"), c2.alias("c2")).join(side, ["c1", "c2"])
        last = base + bits >= 2 * BITS or directory.filter("open").isEmpty()
        ended = placed if last else placed.filter(~F.col("open"))
        ended = ended.select("key", _name(F.col("depth"), F.col("p1"), F.col("p2")).alias("shard"), F.col("depth").cast("int").alias("depth"), "bytes", "shard_bytes", "shard_rows")
        done = ended if done is None else done.unionByName(ended)
        if last:
            return done.withColumnRenamed("key", row or key)
        rows = stored(placed.filter("open").select("key", "h1", "h2", "bytes"), "sharding-open")
        base, bits = base + bits, 8


def write_shards(df: DataFrame, path: str, key: str = "doc_id", limit: int = 1 << 20) -> DataFrame:
    """Writes every row once, into its shard's folder (__shard=b<bits>), and returns the assignment.

    Rows are numbered in a written table and go by these numbers, so that ids that repeat or are null neither multiply nor lose rows. A user column named shard is kept.
    """
    rows = stored(df.withColumn("__aw_row", F.monotonically_increasing_id()), "sharding-rows")
    placed = stored(assign_shards(rows, key, limit=limit, row="__aw_row"), "sharding-placed")
    to = placed.select("__aw_row", F.concat(F.lit("b"), F.col("shard")).alias("__shard"))
    rows.join(to, "__aw_row").drop("__aw_row").repartition("__shard").write.partitionBy("__shard").parquet(path)
    return placed.join(rows.select("__aw_row", key), "__aw_row").drop("__aw_row")
