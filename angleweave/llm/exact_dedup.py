"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

First pass: every row's hash falls into one of M slots, a counting Bloom filter of one
hash that is kept sparse and sharded, as rows of a slot and its count (a dense filter of every task would
send ten bits for every row of the corpus, task by task); slots met twice or more go into Bloom filters whose size and
number follow these slots. Second pass: a row whose slot the filter does not hold is unique and
passes straight through; only the others are shuffled by their full SHA-256.

A group of copies that holds a large share of all rows is joined by broadcast: there
are at most SHARES groups of a SHARES-th of all rows, which bounds the broadcast. All
other groups are small, so their shuffle has no hot key.

Defined cases: null text is empty text, equal to other empty texts; a null doc_id
sorts after all others; of repeated rows with one id and one text exactly one stays;
an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn
from pyspark.sql.internal import InternalFunction

from .common import SPACE_CLASS, stored, text_of

#: A filter has 2^26 bits (8 MB) at most, as many shards as the repeated slots need, and MOST_SHARDS (256 MB in all, 200 million repeated slots).
#: Beyond that more unique rows are shuffled; results stay exact.
MOST_BITS = 1 << 26
MOST_SHARDS = 32
BITS_A_SLOT = 10
LEAST_BITS = 1 << 16
SLOTS = 1 << 40
SHARES = 10_000


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_of(column), F.lit(SPACE_CLASS), F.lit(" "))


def _slot(sha: Column) -> Column:
    return F.pmod(F.xxhash64(sha), F.lit(SLOTS).cast("bigint"))


class Filters:
    """Bloom filters of the slots that were met at least twice, one a shard of slots."""

    def __init__(self, slots: DataFrame):
        again = stored(slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("slot"), "exact-again")
        repeats = again.count()
        self.shards = max(1, min(MOST_SHARDS, -(-BITS_A_SLOT * repeats // MOST_BITS)))
        bits = LEAST_BITS
        while bits < min(MOST_BITS, BITS_A_SLOT * repeats // self.shards):
            bits *= 2
        internal = InternalFunction._invoke_internal_function_over_columns
        bloom = internal("bloom_filter_agg", F.xxhash64("slot"), F.lit(max(1, bits // BITS_A_SLOT)).cast("bigint"), F.lit(bits).cast("bigint"))
        self.table = stored(again.groupBy(self._shard(F.col("slot")).alias("shard")).agg(bloom.alias("bloom")), "exact-bloom")

    def _shard(self, slot: Column) -> Column:
        return F.pmod(slot, F.lit(self.shards).cast("bigint"))

    def maybe_repeated(self, slot: Column) -> Column:
        """True where the slot's filter may hold it; an empty filter (no repeats) holds none."""
        # Spark runs this expression for its own run-time filters but gives it no name in SQL.
        jvm = self.table.sparkSession._jvm
        utils, probe = jvm.org.apache.spark.sql.classic.ExpressionUtils, jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain
        out = F.lit(False)
        for k in range(self.shards):
            bloom = self.table.filter(F.col("shard") == k).select("bloom").scalar()
            held = F.coalesce(ClassicColumn(utils.column(probe(utils.expression(bloom._jc), utils.expression(F.xxhash64(slot)._jc)))), F.lit(False))
            out = F.when(self._shard(slot) == k, held).otherwise(out) if self.shards > 1 else held
        return out


def _order(doc_id: str, rid: str) -> Column:
    return F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.col(rid).alias("rid"))


def duplicate_groups(keyed: DataFrame, filters: Filters) -> DataFrame:
    """sha, first (the row that stays), group_size of all texts that occur more than once."""
    candidates = keyed.filter(filters.maybe_repeated(F.col("slot")))
    return candidates.groupBy("sha").agg(F.min(_order("doc_id", "rid")).alias("first"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")


def _sha() -> Column:
    return F.unhex(F.sha2(F.encode(normalised(), "UTF-8"), 256))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keyed = stored(docs.select("doc_id", _sha().alias("sha"), F.monotonically_increasing_id().alias("rid")).withColumn("slot", _slot(F.col("sha"))), "exact-keys")
    rows = keyed.count()
    filters = Filters(keyed.select("slot"))
    groups = stored(duplicate_groups(keyed, filters), "exact-groups")
    hit = filters.maybe_repeated(F.col("slot"))
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    one = F.lit(1).cast("bigint").alias("group_size")
    straight = keyed.filter(~hit).select("doc_id", F.col("doc_id").alias("keep_id"), one, F.lit(True).alias("kept"), sha)
    large = F.col("group_size") * SHARES >= rows
    hot, rest = F.broadcast(groups.filter(large)), groups.filter(~large)
    stays = F.col("rid") == F.col("first.rid")
    in_group = ["doc_id", F.col("first.id").alias("keep_id"), "group_size", stays.alias("kept"), sha]
    candidates = keyed.filter(hit)
    hot_rows = candidates.join(hot, "sha").select(*in_group)
    others = candidates.join(hot.select("sha"), "sha", "left_anti").join(rest, "sha", "left")
    alone = F.col("group_size").isNull()
    others = others.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"), (alone | stays).alias("kept"), sha)
    return straight.unionByName(hot_rows).unionByName(others)


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns: of equal texts the row with the smallest doc_id, a null one last.

    Decisions go by text and id together; of rows equal in both one stays. Texts are not copied to disk: they are hashed
    where they lie, once for the table of hashes and once where they are read for the result. Unique rows are not shuffled; of the
    rest only candidates move. Null texts are equal to empty ones.
    """
    columns = docs.columns
    keyed = stored(docs.select("doc_id", _sha().alias("sha"), F.lit(0).cast("bigint").alias("rid")).withColumn("slot", _slot(F.col("sha"))), "exact-keys")
    rows = keyed.count()
    filters = Filters(keyed.select("slot"))
    groups = duplicate_groups(keyed, filters)
    groups = stored(groups.select(F.col("sha").alias("__aw_sha"), F.col("first.id").alias("__aw_keep"), F.col("group_size").alias("__aw_size")), "exact-groups")
    # Ids that repeat inside their own group: there one row of several equal ones must be chosen.
    tied = keyed.join(groups, (F.col("sha") == F.col("__aw_sha")) & F.col("doc_id").eqNullSafe(F.col("__aw_keep"))).groupBy("sha").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    tied = stored(tied.select(F.col("sha").alias("__aw_tied")), "exact-tied")
    marked = docs.withColumn("__aw_h", _sha())
    hit = filters.maybe_repeated(_slot(F.col("__aw_h")))
    straight = marked.filter(~hit).select(*columns)
    maybe = marked.filter(hit)
    large = F.col("__aw_size") * SHARES >= rows
    hot = F.broadcast(groups.filter(large))
    first = F.col("__aw_keep").eqNullSafe(F.col("doc_id"))
    kept = maybe.join(hot, F.col("__aw_h") == F.col("__aw_sha")).filter(first).select(*columns, "__aw_h")
    others = maybe.join(hot.select("__aw_sha"), F.col("__aw_h") == F.col("__aw_sha"), "left_anti")
    others = others.join(groups.filter(~large), F.col("__aw_h") == F.col("__aw_sha"), "left").filter(F.col("__aw_size").isNull() | first).select(*columns, "__aw_h")
    kept = kept.unionByName(others)
    if tied.isEmpty():
        return straight.unionByName(kept.select(*columns))
    tied_join = F.col("__aw_h") == F.col("__aw_tied")
    single = kept.join(tied, tied_join, "left_anti").select(*columns)
    chosen = kept.join(tied, tied_join, "left_semi").dropDuplicates(["__aw_h"]).select(*columns)
    return straight.unionByName(single).unionByName(chosen)
