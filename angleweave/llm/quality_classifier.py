"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is a character 4-gram over the characters of the trusted text, whatever their
script, and one symbol for those that it holds fewer than LEAST_SEEN times. Counts of 4-grams, of the
continuations of lower orders and of contexts are tables, sharded by their n-gram; discounts D1, D2, D3+ of every
order come from counts of counts. The corpus asks for its distinct 4-grams, and joins of these with the sharded
counts, order by order, give each its loss -log p(w | three characters). The losses go back to the texts: as a sorted
broadcast array while their counted number is at most BROADCAST_CODES, else by a join with the distinct 4-grams of each
CHUNK_ROWS documents, which meets the texts in a cogroup. Both ways give the same numbers.

A document's perplexity is that of its own characters. For the verdict its loss is taken together with PRIOR
characters of the mean loss of trusted text, so that a few words are no evidence. Thresholds are
language-specific quantiles of this score over the trusted documents that the model has not seen (half of them). A
language of n such documents has its own quantile with weight n / (n + LANGUAGE_PRIOR) and that of all languages with
the rest, but never less than its own, at every size.

The model is fitted on every trusted document of one half, drawn by a hash of the id, and the thresholds come from
every one of the other; train_docs, where it is given, bounds the fit. Ids are broadcast while they are few, so that texts are not shuffled.

Defined cases: null and empty texts have perplexity null, the mean trusted score, and are kept;
without trusted rows nothing is rejected; a null language is a language of its own, the empty one;
repeated rows are scored alike, and a trusted id that repeats counts with each of its rows; a null doc_id
has no label; very long texts are scored whole; other columns, whatever their names, do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, small_batches, stored

#: Bits of a symbol: four in a code. The commonest 2 ** BITS - 2 characters of the sample have their own.
BITS = 15
#: Rarer characters of the sample share the symbol of unseen ones, which so has counts.
LEAST_SEEN = 5
ORDER = 4
PRIOR = 150.0
QUANTILE = 0.998
LANGUAGE_PRIOR = 200
#: Of percentile_approx: ranks are right to a millionth of the rows.
ACCURACY = 1_000_000
#: 16 bytes each: 64 MB.
BROADCAST_CODES = 4_000_000
CHUNK_ROWS = 256
#: Distinct codes that a task gathers before it sends them on.
HELD_CODES = 1 << 21


def _points(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def codes_of(text: str, lookup):
    """The 4-gram that ends at each character; starting symbols (0) stand before the text."""
    import numpy as np

    p = _points(text)
    s = np.zeros(len(p) + ORDER - 1, np.int64)
    s[ORDER - 1 :] = lookup[np.minimum(p, len(lookup) - 1)]
    return ((s[:-3] << BITS | s[1:-2]) << BITS | s[2:-1]) << BITS | s[3:]


def alphabet(counts: list[tuple[int, int]]):
    """A table from code points to symbols: 0 starts a text, 1 is a character not seen or rare, then the others, the commonest first."""
    import numpy as np

    lookup = np.ones(0x110000, np.int32)
    common = [p for p, n in sorted(counts, key=lambda x: (-x[1], x[0])) if n >= LEAST_SEEN][: (1 << BITS) - 2]
    lookup[common] = np.arange(2, 2 + len(common))
    return lookup


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ of modified Kneser-Ney from the numbers of n-grams counted once, twice, three and four times."""
    if min(n) == 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(k, max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3))


def _suffix(code: Column, k: int) -> Column:
    """The last k symbols."""
    return code.bitwiseAND(F.lit((1 << BITS * k) - 1))


def _context(code: Column) -> Column:
    return F.shiftright(code, BITS)


class Model:
    """The sharded tables: of every order k from ORDER to 1 the n-grams (code, share) and contexts (code, back)."""

    def __init__(self, counts: DataFrame, lookup, symbols: int):
        """counts: code, n of the distinct 4-grams."""
        self.lookup, self.symbols, self.grams, self.contexts = lookup, symbols, {}, {}
        grams = counts
        for k in range(ORDER, 0, -1):
            of = grams.agg(*[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]).first()
            d = discounts(list(of))
            off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
            contexts = stored(grams.groupBy(_context(F.col("code")).alias("context")).agg(F.sum("n").alias("total"), (F.sum(off) / F.sum("n")).alias("back")), "classifier-contexts")
            shares = grams.withColumn("context", _context(F.col("code"))).join(broadcast_if_small(contexts, contexts.count()), "context")
            self.grams[k] = stored(shares.select("code", ((F.col("n") - off) / F.col("total")).alias("share")), "classifier-grams")
            self.contexts[k] = contexts.select(F.col("context").alias("code"), "back")
            # A lower order counts the different symbols before an n-gram.
            if k > 1:
                grams = stored(grams.groupBy(_suffix(F.col("code"), k - 1).alias("code")).agg(F.count(F.lit(1)).alias("n")), "classifier-lower")

    def losses(self, asked: DataFrame) -> DataFrame:
        """code, loss of distinct 4-grams: a sharded join with the n-grams and one with the contexts of every order, from the lowest on."""
        rows = asked.select("code", F.lit(1.0 / self.symbols).alias("p"))
        for k in range(1, ORDER + 1):
            grams, contexts = self.grams[k].withColumnRenamed("code", "__g"), self.contexts[k].withColumnRenamed("code", "__c")
            own = _suffix(F.col("code"), k)
            rows = rows.join(broadcast_if_small(grams, grams.count()), own == F.col("__g"), "left").join(broadcast_if_small(contexts, contexts.count()), _context(own) == F.col("__c"), "left")
            rows = rows.select("code", (F.coalesce("share", F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * F.col("p")).alias("p"))
        return rows.select("code", (-F.log(F.greatest("p", F.lit(1e-12)))).alias("loss"))


def _trusted(labels: DataFrame) -> DataFrame:
    """id, draw of the documents labelled good and not toxic."""
    good = labels.filter("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
    return good.select(F.col("doc_id").alias("__aw_id"), F.pmod(F.xxhash64(F.lit("trusted"), "doc_id"), F.lit(1 << 40)).alias("draw"))


def _char_counts(batches):
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    total: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                p, n = np.unique(_points(text), return_counts=True)
                total.update(dict(zip(p.tolist(), n.tolist())))
    yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int64()), pa.array([*total.values()], pa.int64())], names=["point", "n"])


def _code_counts(lookup):
    """code, n of the texts, added up over a task; sent on when HELD_CODES are gathered."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        codes, counts, size = [], [], 0

        def summed():
            every, back = np.unique(np.concatenate(codes), return_inverse=True)
            return every, np.bincount(back, np.concatenate(counts), len(every)).astype(np.int64)

        def out(every, n):
            for k in range(0, len(every), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(every[k : k + (1 << 17)]), pa.array(n[k : k + (1 << 17)])], names=["code", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    c, n = np.unique(codes_of(text, lookup.value), return_counts=True)
                    codes.append(c)
                    counts.append(n)
                    size += len(c)
            if size >= HELD_CODES:
                every, n = summed()
                codes, counts, size = [every], [n], len(every)
                if size >= HELD_CODES // 2:
                    yield from out(every, n)
                    codes, counts, size = [], [], 0
        if codes:
            yield from out(*summed())

    return run


def _measure(text, lookup, keys, losses):
    """Characters and the mean loss, null without characters."""
    import numpy as np

    if not text:
        return 0, None
    codes, n = np.unique(codes_of(text, lookup), return_counts=True)
    return len(text), float((losses[np.searchsorted(keys, codes)] * n).sum() / n.sum())


def _with_columns(batch, found):
    import pyarrow as pa

    n, loss = zip(*found) if found else ((), ())
    return [*batch.columns, pa.array(n, pa.int64()), pa.array(loss, pa.float64())], [*batch.schema.names, "__aw_chars", "__aw_loss"]


def _measured_here(shared, at: int):
    def run(batches):
        import pyarrow as pa

        lookup, keys, losses = shared.value
        for batch in batches:
            columns, names = _with_columns(batch, [_measure(t, lookup, keys, losses) for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _chunk_codes(lookup):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            held: dict[int, list] = {}
            for chunk, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    held.setdefault(chunk, []).append(np.unique(codes_of(text, lookup.value)))
            for chunk, codes in held.items():
                every = np.unique(np.concatenate(codes))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(every), chunk)), pa.array(every)], names=["chunk", "code"])

    return run


def _measured_there(lookup):
    def run(rows, answers):
        import numpy as np
        import pyarrow as pa

        keys, losses = answers.column("code").to_numpy(), answers.column("loss").to_numpy()
        keys, first = np.unique(keys, return_index=True)
        columns, names = _with_columns(rows, [_measure(t, lookup.value, keys, losses[first]) for t in rows.column("text").to_pylist()])
        return pa.table(columns, names=names).drop_columns(["__aw_chunk"])

    return run


def _measurer(docs: DataFrame, model: Model, shared, most: int):
    """A function from kept columns to these columns of docs with __aw_chars and __aw_loss (mean over the characters); texts are read at every call."""
    asked = docs.select(F.col("text").cast("string")).mapInArrow(_code_counts(shared), "code bigint, n bigint").select("code").distinct()
    losses = stored(model.losses(stored(asked, "classifier-asked")), "classifier-losses")
    schema = T.StructType([*docs.schema.fields, T.StructField("__aw_chars", T.LongType()), T.StructField("__aw_loss", T.DoubleType())])
    if losses.count() <= most:
        import numpy as np

        table = losses.toArrow()
        keys, values = table.column("code").to_numpy(), table.column("loss").to_numpy()
        order = np.argsort(keys)
        sent = docs.sparkSession.sparkContext.broadcast((model.lookup, keys[order], values[order]))
        found = docs.mapInArrow(_measured_here(sent, docs.columns.index("text")), schema)
    else:
        rows = stored(docs.withColumn("__aw_chunk", F.expr(f"monotonically_increasing_id() div {CHUNK_ROWS}")), "classifier-chunks")
        answers = rows.select("__aw_chunk", "text").mapInArrow(_chunk_codes(shared), "chunk bigint, code bigint").join(losses, "code")
        found = rows.groupBy("__aw_chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_measured_there(shared), schema)
    return lambda kept: found.select(*[F.col(f"`{c}`") for c in (*kept, "__aw_chars", "__aw_loss")])


def fit(docs: DataFrame, labels: DataFrame, train_docs: int | None = None, most: int = BROADCAST_CODES, whole: bool = False):
    """(doc_id and lang of docs, or whole: all columns, with __aw_score, __aw_chars, __aw_loss; thresholds by language (lang, n, own, threshold); the threshold of all), or None without trusted documents."""
    spark = docs.sparkSession
    small_batches(spark)
    ids = _trusted(labels)
    # The half of even draws is for the fit, thinned only to a bound that is given; all other trusted documents are held out.
    drawn, even = F.col("draw") % 2 == 0, ids.filter(F.col("draw") % 2 == 0).count()
    if train_docs is not None:
        drawn &= F.col("draw") < int((1 << 40) * min(1.0, 0.95 * train_docs / max(1, even))) + 2
    train = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(broadcast_if_small(ids.filter(drawn).select("__aw_id"), even), F.col("doc_id") == F.col("__aw_id")).select("text")
    train = stored(train, "classifier-sample")
    # One row a character: at most the size of Unicode.
    counts = [(r[0], r[1]) for r in train.mapInArrow(_char_counts, "point bigint, n bigint").groupBy("point").agg(F.sum("n")).collect()]
    if not counts:
        return None
    lookup = alphabet(counts)
    shared = spark.sparkContext.broadcast(lookup)
    grams = stored(train.mapInArrow(_code_counts(shared), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")), "classifier-counts")
    model = Model(grams, lookup, int(lookup.max()) + 1)
    measured = _measurer(docs, model, shared, most)
    rows = stored(measured(["doc_id", "lang"]), "classifier-rows")
    held = rows.join(ids.filter(~drawn), F.col("doc_id") == F.col("__aw_id"), "left_semi").filter("__aw_chars > 0").select("lang", "__aw_chars", "__aw_loss")
    held = stored(held, "classifier-held")
    # Rows with their texts are not written but measured once more, where they are read.
    rows = measured(docs.columns) if whole else rows
    # Without held-out text the fitted text's mean stands in; nothing is rejected then.
    mean = held.agg(F.sum(F.col("__aw_loss") * F.col("__aw_chars")) / F.sum("__aw_chars")).first()[0]
    score = lambda m: (F.coalesce("__aw_loss", F.lit(0.0)) * F.col("__aw_chars") + PRIOR * m) / (F.col("__aw_chars") + PRIOR)
    if mean is None:
        return rows.withColumn("__aw_score", F.col("__aw_loss")), None, float("inf")
    held = held.withColumn("score", score(mean))
    limit = lambda: F.percentile_approx("score", QUANTILE, ACCURACY)
    other = held.agg(limit()).first()[0]
    by = held.groupBy(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("__aw_lang")).agg(F.count(F.lit(1)).alias("n"), limit().alias("own"))
    blend = (F.col("n") * F.col("own") + LANGUAGE_PRIOR * F.lit(other)) / (F.col("n") + LANGUAGE_PRIOR)
    by = stored(by.withColumn("threshold", F.greatest("own", blend)), "classifier-thresholds")
    return rows.withColumn("__aw_score", score(mean)), by, other


def _judged(fitted) -> DataFrame:
    """The rows with __aw_limit, their language's threshold."""
    rows, by, other = fitted
    if by is None:
        return rows.withColumn("__aw_limit", F.lit(other))
    by = broadcast_if_small(by.select("__aw_lang", "threshold"), by.count())
    joined = rows.join(by, F.coalesce(F.col("lang").cast("string"), F.lit("")) == F.col("__aw_lang"), "left")
    return joined.withColumn("__aw_limit", F.coalesce("threshold", F.lit(other)))


def _kept() -> Column:
    return F.coalesce(F.col("__aw_score") <= F.col("__aw_limit"), F.lit(True))


def classified(docs: DataFrame, labels: DataFrame, train_docs: int | None = None, most: int = BROADCAST_CODES) -> DataFrame:
    """One row per document: doc_id, lang, chars, perplexity, score and threshold (as perplexities), kept."""
    docs = docs.select(F.col("text").cast("string"), F.col("doc_id").cast("bigint"), F.col("lang").cast("string"))
    fitted = fit(docs, labels, train_docs, most)
    if fitted is None:
        none = F.lit(None).cast("double")
        return docs.select("doc_id", "lang", F.char_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("chars"), none.alias("perplexity"), none.alias("score"), none.alias("threshold"), F.lit(True).alias("kept"))
    return _judged(fitted).select("doc_id", "lang", F.col("__aw_chars").alias("chars"), F.exp("__aw_loss").alias("perplexity"), F.exp("__aw_score").alias("score"), F.exp("__aw_limit").alias("threshold"), _kept().alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with their columns. Texts are neither shuffled nor copied to disk while the losses are few enough to be broadcast."""
    fitted = fit(docs, labels, whole=True)
    if fitted is None:
        return docs
    return _judged(fitted).filter(_kept()).select(*[F.col(f"`{c}`") for c in docs.columns])
