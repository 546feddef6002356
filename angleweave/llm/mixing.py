"""Mixing sources to target weights, in DataFrame operations only.

Tokens are summed per source; targets share all tokens by weight, a source's target
stops at ``most`` times its tokens and the excess goes to the others by weight until
none is above. That is water-filling: with sources in ascending order of ceiling over
weight, the level after closing the first k is (all - ceilings closed) / (weights left),
and the sources closed are those before the first whose ceiling lies above its level.
A document is emitted floor(rate) times, rate = target / tokens of its source, plus
once more if a draw seeded by its id falls below the fraction.

Defined cases: null text has size 0; a null source is a source of its own, last in
order; a source without words has target 0 and its documents are not emitted; a null
doc_id draws as "null"; equal ids draw alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, stored, text_of

SEED = "mix-7"


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("bigint")


def draw(doc_id: str, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5."""
    key = F.concat(F.lit(seed + "|"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, cycle: int = 3, most: int = 3) -> DataFrame:
    """From (source, size): source, source_size, weight, target. The windows run over one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Ascending code points: Spark compares strings by their UTF-8 bytes, which is the same order.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(cycle)) + 1).cast("bigint"))
    per = per.withColumn("ceiling", F.col("source_size") * most)
    fill = Window.orderBy((F.col("ceiling") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    per = per.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("ceiling").over(before), F.lit(0))) / F.sum("weight").over(after))
    per = per.withColumn("stop", F.col("ceiling") > F.col("level") * F.col("weight"))
    per = per.withColumn("level", F.min(F.when(F.col("stop"), F.struct(F.col("ceiling") / F.col("weight"), F.col("level")))).over(whole)["level"])
    target = F.when(F.col("level").isNull() | (F.col("ceiling") <= F.col("level") * F.col("weight")), F.col("ceiling").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def mixed(docs: DataFrame, cycle: int = 3, most: int = 3, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    sizes = stored(docs.select("doc_id", "source", word_count().alias("size")), "mixing-sizes")
    targets = stored(source_targets(sizes, cycle, most), "mixing-targets")
    t = broadcast_if_small(targets.withColumnRenamed("source", "t_source"), targets.count())
    rows = sizes.join(t, F.col("source").eqNullSafe(F.col("t_source")))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")))).otherwise(F.lit(0.0))
    rows = rows.withColumn("rate", rate)
    copies = F.floor("rate") + (draw("doc_id", seed) < F.col("rate") - F.floor("rate")).cast("bigint")
    rows = rows.withColumn("copies", copies)
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, cycle: int = 3, most: int = 3, seed: str = SEED) -> DataFrame:
    """The documents themselves, each as often as it is taken. Only a source's rate is joined, so texts are not shuffled."""
    sizes = docs.select("source", word_count().alias("size"))
    targets = stored(source_targets(sizes, cycle, most), "mixing-targets")
    rates = targets.select(F.col("source").alias("__aw_source"), F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")))).otherwise(F.lit(0.0)).alias("__aw_rate"))
    rates = broadcast_if_small(rates, targets.count())
    rows = docs.join(rates, F.col("source").eqNullSafe(F.col("__aw_source")))
    copies = F.floor("__aw_rate") + (draw("doc_id", seed) < F.col("__aw_rate") - F.floor("__aw_rate")).cast("bigint")
    rows = rows.withColumn("__aw_copies", F.expr("cast(0 as bigint)") + copies).filter(F.col("__aw_copies") > 0)
    rows = rows.withColumn("__aw_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__aw_copies"))))
    return rows.select(*docs.columns)
