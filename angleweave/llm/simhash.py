"""Near-dedup by SimHash and pigeonhole blocks.

Fingerprints are taken from whole texts. Equal fingerprints collapse first (map-side
combined), so copies never meet as pairs. Two fingerprints that differ in at most D
of 64 bits agree in at least m - D of m blocks: every choice of m - D blocks is a
join key, and pairs that share a key are verified by their Hamming distance.

Groups are not expanded into all their pairs. First every key's fingerprints are
compared with the key's least fingerprint only, and components are formed from these
links. What is left are pairs of different components under one key; keys whose
fingerprints are already in one component drop out. If mixed keys still hold many
candidate pairs, further rounds compare with other pivots. At last all remaining
candidate pairs of different components are verified, so no link is lost.

m grows with the number of fingerprints, which changes the work, never the result.

Defined cases: null and empty texts and texts without words have fingerprint 0 and
link like any other; fewer words than a shingle give one shingle of all words;
repeated rows fall together; a null doc_id is carried, but an id that is not null is
preferred as component_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, small_batches, stored, utf8
from .graph import components

WORDS = 4
SEED = 42
DISTANCE = 4
CHUNK = 255 * 400
PAIRS_A_ROW = 20
PIVOT_ROUNDS = 4


def shingle_hashes(text: bytes, words: int = WORDS) -> Iterator[list[int]]:
    """XXH64 of every shingle, in chunks. bytes.lower() changes A-Z alone; bytes.split() parts at ASCII white space."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    parts = text.lower().split()
    if not parts:
        return
    line = b" ".join(parts)
    if len(parts) < words:
        yield [digest(line, SEED)]
        return
    ends = [e - 1 for e in accumulate(len(p) + 1 for p in parts)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    ends = ends[words - 1 :]
    for k in range(0, len(ends), CHUNK):
        yield [digest(line[s:e], SEED) for s, e in zip(starts[k : k + CHUNK], ends[k : k + CHUNK])]


def simhash(text: bytes, words: int = WORDS) -> int:
    """The fingerprint: a bit is 1 if it is set in over half of the hashes."""
    import numpy as np

    total, ones = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(text, words):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255  # sums of 255 bits fit in a byte, which adds fastest
        if whole:
            ones += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += np.add.reduce(bits[whole:], axis=0, dtype=np.uint8)
        total += len(bits)
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little")


def _fingerprints(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        found = np.array([simhash(t) for t in utf8(batch.column(1))], "u8").view("i8")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def blocks_for(count: int, distance: int = DISTANCE) -> int:
    """The fewest blocks whose keys have room for the fingerprints."""
    for m in range(distance + 2, distance + 7):
        if 2 ** (64 * (m - distance) // m) >= 4 * count:
            return m
    return distance + 6


def masks(m: int, distance: int = DISTANCE) -> list[int]:
    """One mask for every choice of m - distance of m blocks, as signed numbers."""
    edges = [64 * k // m for k in range(m + 1)]
    blocks = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(m)]
    found = [sum(blocks[k] for k in c) for c in combinations(range(m), m - distance)]
    return [x - (1 << 64) if x >> 63 else x for x in found]


def _near(a: str, b: str, distance: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def _labelled(keyed: DataFrame, labels: DataFrame) -> DataFrame:
    """Keys with each fingerprint's component, without the keys that hold a single component."""
    rows = stored(_relabelled(keyed, labels), "simhash-labelled")
    mixed = rows.groupBy("t", "k").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("t", "k")
    return stored(_joined(rows, mixed, ["t", "k"], "simhash-mixed-keys"), "simhash-mixed")


def _joined(rows: DataFrame, made: DataFrame, on: list[str], name: str) -> DataFrame:
    """Joins an aggregate of the rows themselves: written first and counted, it is broadcast if small; else Spark splits the join of a hot key."""
    made = stored(made, name)
    return rows.join(broadcast_if_small(made, made.count()), on)


def _relabelled(keyed: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with their fingerprint's component, itself where it has none."""
    names = labels.select(F.col("node").alias("fp"), "component")
    return keyed.join(broadcast_if_small(names, labels.count()), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links (a, b) between them: only the components that the links name are worked on again."""
    new = stored(components(links, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("now")), "simhash-merges")
    named = labels.join(broadcast_if_small(new, new.count()), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    # A fingerprint that had no link so far is a component of itself.
    fresh = new.select(F.col("component").alias("node"), F.col("now").alias("component")).join(labels.select("node"), "node", "left_anti")
    return stored(named.unionByName(fresh), "simhash-labels")


def linked(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """node, component over the distinct fingerprints (column fp) that link to another one."""
    count = distinct.count()
    keys = masks(blocks_for(count, distance), distance)
    every = F.array(*[F.struct(F.lit(t).cast("smallint").alias("t"), F.col("fp").bitwiseAND(F.lit(x)).alias("k")) for t, x in enumerate(keys)])
    keyed = distinct.select("fp", F.explode(every).alias("key")).select("fp", "key.t", "key.k")
    shared = keyed.groupBy("t", "k").agg(F.min("fp").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    keyed = stored(_joined(keyed, shared, ["t", "k"], "simhash-pivots"), "simhash-keys")
    links = keyed.filter((F.col("fp") != F.col("pivot")) & _near("fp", "pivot", distance)).select("fp", F.col("pivot").alias("other"))
    labels = stored(components(links, "fp", "other"), "simhash-labels")
    for k in range(PIVOT_ROUNDS):
        keyed = _labelled(keyed.select("fp", "t", "k"), labels)
        sizes = keyed.groupBy("t", "k", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("t", "k").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("own"))
        rows, pairs = sizes.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).first()
        if not rows:
            return labels
        if pairs <= PAIRS_A_ROW * rows or k == PIVOT_ROUNDS - 1:
            break
        pivot = keyed.groupBy("t", "k").agg(F.min_by(F.struct("fp", "component"), F.xxhash64("fp", F.lit(k))).alias("pivot"))
        met = _joined(keyed, pivot, ["t", "k"], "simhash-pivots").select("component", "fp", F.col("pivot.fp").alias("other"), F.col("pivot.component").alias("to"))
        labels = _merged(labels, met.filter((F.col("component") != F.col("to")) & _near("fp", "other", distance)).select(F.col("component").alias("a"), F.col("to").alias("b")))
    left = keyed.select("t", "k", "fp", F.col("component").alias("c1"))
    right = keyed.select("t", "k", F.col("fp").alias("other"), F.col("component").alias("c2"))
    last = left.join(right, ["t", "k"]).filter((F.col("c1") < F.col("c2")) & _near("fp", "other", distance)).select(F.col("c1").alias("a"), F.col("c2").alias("b"))
    last = stored(last.distinct(), "simhash-last")
    return labels if last.isEmpty() else _merged(labels, last)


def _components(rows: DataFrame, distance: int) -> DataFrame:
    """fp, component, first of the distinct fingerprints; first is the component's least row. rows: fp, doc_id, rid."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("rid").alias("rid"))
    distinct = stored(rows.groupBy("fp").agg(F.min(order).alias("least")), "simhash-distinct")
    labels = linked(distinct.select("fp"), distance).select(F.col("node").alias("fp"), "component")
    own = stored(distinct.join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "simhash-own")
    # Written before it is joined: the join then reads two plain shuffles, of which Spark splits a giant component.
    least = stored(own.groupBy("component").agg(F.min("least").alias("first")), "simhash-least")
    return stored(own.join(least, "component").select("fp", "component", "first"), "simhash-components")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    rows = stored(fingerprints(docs), "simhash-fingerprints")
    ids = _components(rows.withColumn("rid", F.lit(0).cast("bigint")), distance).select("fp", F.col("first.id").alias("component_id"))
    return rows.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _marked(at: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = np.array([simhash(t) for t in utf8(batch.column(at))], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, "__aw_fp"])

    return run


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The documents with one row of each group, with their columns: that of the smallest doc_id, a null one last.

    Rows whose id is their own go or stay by it; only ids are joined. Rows without an id or with one that repeats, normally none, are told
    apart by id and fingerprint, which is taken once more for them alone; of rows equal in both one stays.
    """
    columns = docs.columns
    rows = stored(fingerprints(docs), "simhash-fingerprints")
    order = rows.withColumn("rid", F.lit(0).cast("bigint"))
    first = _components(order, distance).select("fp", F.col("first.id").alias("first"), "component")
    unclear = stored(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("doc_id is null or n > 1").select(F.col("doc_id").alias("__aw_id")), "simhash-unclear")
    away = rows.filter("doc_id is not null").join(first, "fp").filter(~F.col("doc_id").eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("__aw_id")).distinct()
    dropped = stored(away.unionByName(unclear.filter("__aw_id is not null")).distinct(), "simhash-dropped")
    # 8 bytes an id: a million are 8 MB.
    n, mine = dropped.count(), F.col("doc_id").cast("bigint")
    kept = docs.filter(mine.isNotNull()).join(F.broadcast(dropped) if n <= 1_000_000 else dropped, mine == F.col("__aw_id"), "left_anti")
    if unclear.isEmpty():
        return kept
    schema = T.StructType([*docs.schema.fields, T.StructField("__aw_fp", T.LongType())])
    small_batches(docs.sparkSession)
    again = docs.join(unclear, mine.eqNullSafe(F.col("__aw_id")), "left_semi").mapInArrow(_marked(columns.index("text")), schema)
    # The row that stays is one of its component's whose id is the component's first; several of these are cut to one.
    again = again.join(first.select(F.col("fp").alias("__aw_fp"), F.col("first").alias("__aw_first"), F.col("component").alias("__aw_component")), "__aw_fp")
    again = again.filter(mine.eqNullSafe(F.col("__aw_first"))).dropDuplicates(["__aw_component"])
    return kept.unionByName(again.select(*[F.col(f"`{c}`") for c in columns]))
