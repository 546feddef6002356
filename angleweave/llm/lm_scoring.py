"""Language-model scoring by cross-entropy difference.

A target model (documents labelled good and not toxic) and a background model (all
documents) are matched: word bigrams over one vocabulary, smoothed alike, different in their
counts only. A document's score is the mean over its words of loss under the target
minus loss under the background: below zero it is closer to the target.

Every word and bigram of all documents counts, without a cutoff, and what is gathered grows
with the corpus. A document is scored by the counts of all others: its own are taken off
both models, so that no document meets itself in them. With c the counts left,

    p(w) = (c(w) + 1) / (N + V),   p(w | h) = (c(h w) + MU p(w)) / (c(h) + MU),

where h is the word before or the start of the text, and what p(w | h) lacks to one is the end of the text.

Nothing of the models is broadcast or gathered. Texts become chunks of about CHUNK bytes, one row each,
which hold their words as numbers. A chunk asks for its distinct words and bigrams, dealt into shards by their
64-bit hashes; a shard adds up what the chunks bring and answers each of them in its own order, so that a common word is
one entry a chunk, answers need no keys, and texts never move. Shards follow the number of words; chunks grow with the shards, and from MOST_CHUNK on
shards grow instead, so that the rows asked stay in proportion to the text: one for BYTES_A_SHARD bytes at most, up to about 100 GB.
Beyond that they grow faster, up to one row an entry.

Defined cases: null and empty texts have no words, losses and score 0; documents without
a label are background; without labelled documents the target is uniform over the
vocabulary; repeated rows count as often as they occur, and each is scored by the others; a null doc_id is
carried and has no label; labels that repeat an id count once; very long texts are counted and scored whole.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, utf8

MU = 20.0
#: Bytes of text of a chunk, at least and at most; a longer text has a chunk of its own.
CHUNK = 4 << 20
MOST_CHUNK = 16 << 20
#: Entries of a shard, about, at least and at most: 8 bytes each.
SHARD = 1 << 19
MOST_SHARD = 1 << 22
LEAST_SHARDS = 64
#: Bytes of a chunk for each shard that it asks, so that an answer holds some hundred entries whatever the number of shards.
BYTES_A_SHARD = 3072
START = 1
#: Labels up to this many rows are broadcast (8 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 2_000_000


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def _flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, target (1 for documents of the target)."""
    good = labels.filter("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").alias("__aw_id")).distinct()
    if good.count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(good, F.col("doc_id") == F.col("__aw_id"), "left")
    return rows.select("doc_id", "text", F.col("__aw_id").isNotNull().cast("int").alias("target"))


def _packed(doc_ids, targets, sizes, ids, local) -> bytes:
    """A chunk as a compressed Arrow stream of two batches' worth of columns: documents; words and their hashes."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(map(digest, local), "u8", len(local))
    hashes[hashes == START] += np.uint64(1)
    hashes[0] = START
    words = np.concatenate([np.zeros(0, np.int32), *ids])
    row = [pa.array(x, type=pa.list_(t)) for x, t in (([doc_ids], pa.int64()), ([targets], pa.int8()), ([np.array(sizes, np.int64)], pa.int64()), ([words], pa.int32()), ([hashes], pa.uint64()))]
    batch = pa.RecordBatch.from_arrays(row, names=["doc_id", "target", "size", "word", "hash"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data):
    """doc_id (Arrow), target, size, word, hash."""
    import pyarrow as pa

    batch = pa.ipc.open_stream(data).read_next_batch()
    own, *rest = (c.values for c in batch.columns)
    return own, *(c.to_numpy() for c in rest)


def shard_bits(words: float) -> int:
    """Bits by which bigrams are dealt into shards: SHARD entries each, more of them once a chunk of MOST_CHUNK bytes asks enough shards."""
    most = max(1 << int(math.log2(MOST_CHUNK / BYTES_A_SHARD)), words / MOST_SHARD)
    return math.ceil(math.log2(max(LEAST_SHARDS, min(words / SHARD, most))))


def chunk_bytes(size: float) -> int:
    """Bytes of a chunk for texts of so many bytes; their words are at least two bytes each, mostly about six."""
    return min(MOST_CHUNK, max(CHUNK, BYTES_A_SHARD << shard_bits(size / 6)))


def _chunks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """chunk, words, packed: the documents of a task in their order, chunk_bytes a row."""
    most = chunk_bytes(docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        doc_ids, targets, sizes, ids, local, size = [], [], [], [], {b"": 0}, 0

        def row():
            packed = _packed(doc_ids, targets, sizes, ids, local)
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([sum(sizes)], pa.int64()), pa.array([packed], pa.binary())], names=["chunk", "words", "packed"])

        for batch in batches:
            for doc, text, target in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()):
                found = _words(text)
                doc_ids.append(doc)
                targets.append(target)
                sizes.append(len(found))
                for w in found:
                    if w not in local:
                        local[w] = len(local)
                ids.append(np.fromiter(map(local.__getitem__, found), np.int32, len(found)))
                size += len(text) + 8
                if size >= most:
                    yield row()
                    at, size = at + 1, 0
                    doc_ids, targets, sizes, ids, local = [], [], [], [], {b"": 0}
        if doc_ids:
            yield row()

    return stored(_flagged(docs, labels).mapInArrow(run, "chunk bigint, words bigint, packed binary"), "lm-chunks")


def _pairs(size, word, hashes):
    """Of every word: its document, the word before it (0 at a start), the place of its bigram; and the hashes of the distinct bigrams."""
    import numpy as np

    doc = np.repeat(np.arange(len(size)), size)
    before = np.concatenate([[0], word[:-1]]).astype(np.int64)[: len(word)]
    ends = np.cumsum(size)
    before[(ends - size)[size > 0]] = 0
    distinct, pair = np.unique(before << 31 | word, return_inverse=True)
    x = hashes[distinct >> 31] * np.uint64(0x9E3779B97F4A7C15) + hashes[distinct & (1 << 31) - 1]
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return doc, before, pair, x ^ (x >> np.uint64(31))


def _dealt(hashes, bits: int):
    """The order of ascending hashes, and the edges of their shards (the first bits of a hash)."""
    import numpy as np

    order = np.argsort(hashes)
    edges = np.searchsorted(hashes[order], np.arange(1 << bits, dtype="u8") << np.uint64(64 - bits)) if bits else np.zeros(1, int)
    return order, np.append(edges, len(hashes))


def _counts(word, pair, doc, size, target, n_words: int, n_pairs: int):
    """(n, n in the target) of the words, the start first, and of the bigrams."""
    import numpy as np

    mark = target[doc].astype(bool)
    full = size > 0
    out = []
    for ids, n, first in ((word, n_words, (full.sum(), (full & (target == 1)).sum())), (pair, n_pairs, None)):
        both = [np.bincount(ids, minlength=n).astype(np.int64), np.bincount(ids[mark], minlength=n).astype(np.int64)]
        if first:
            both[0][0], both[1][0] = first
        out.append(both)
    return out


def _asker(word_bits: int, pair_bits: int):
    """Rows shard, chunk, hashes, counts of a chunk's words (shards from 0) and bigrams (behind them)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, target, size, word, hashes = _unpacked(packed.as_buffer())
                doc, _, pair, pairs = _pairs(size, word, hashes)
                counts = _counts(word, pair, doc, size, target, len(hashes), len(pairs))
                rows = []
                for own, both, bits, base in ((hashes, counts[0], word_bits, 0), (pairs, counts[1], pair_bits, 1 << word_bits)):
                    order, edges = _dealt(own, bits)
                    own, both = own[order], [c[order] for c in both]
                    for s in np.flatnonzero(np.diff(edges)).tolist():
                        a, z = edges[s], edges[s + 1]
                        rows.append((base + s, own[a:z].tobytes(), pa.compress(both[0][a:z].tobytes() + both[1][a:z].tobytes(), "zstd", asbytes=True)))
                shard, h, n = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array([chunk] * len(rows), pa.int64()), pa.array(h, pa.binary()), pa.array(n, pa.binary())], names=["shard", "chunk", "hashes", "counts"])

    return run


def _answered(shard_rows):
    """Sums over all chunks, in the order in which each of them asked."""
    import numpy as np
    import pyarrow as pa

    asked = [np.frombuffer(x, "u8") for x in shard_rows.column("hashes").to_pylist()]
    both = [np.frombuffer(pa.decompress(x, 16 * len(h), "zstd"), "i8").reshape(2, -1) for h, x in zip(asked, shard_rows.column("counts").to_pylist())]
    distinct, back = np.unique(np.concatenate(asked), return_inverse=True)
    n, t = (np.bincount(back, np.concatenate([b[k] for b in both]), len(distinct)).astype(np.int64) for k in (0, 1))
    ends = np.cumsum([len(h) for h in asked])
    out = [pa.compress(n[back[a:z]].tobytes() + t[back[a:z]].tobytes(), "zstd", asbytes=True) for a, z in zip(ends - [len(h) for h in asked], ends)]
    rows = len(asked)
    return pa.table({"chunk": shard_rows.column("chunk"), "shard": shard_rows.column("shard"), "counts": pa.array(out, pa.binary()), "distinct": pa.array([len(distinct)] * rows, pa.int64()), "n": pa.array([int(n.sum())] * rows, pa.int64()), "target": pa.array([int(t.sum())] * rows, pa.int64())})


def _loss(count, context, unigram, own, total, vocabulary: int):
    """-log p of every word: counts of the corpus less the document's own. own: of the bigram, the context, the word, all words."""
    import numpy as np

    p1 = (unigram - own[2] + 1.0) / (total - own[3] + vocabulary)
    return -np.log((count - own[0] + MU * p1) / (context - own[1] + MU))


def _scorer(word_bits: int, pair_bits: int, vocabulary: int, totals: tuple[int, int]):
    def run(chunk, answers):
        import numpy as np
        import pyarrow as pa

        doc_id, target, size, word, hashes = _unpacked(chunk.column("packed").combine_chunks()[0].as_buffer())
        doc, before, pair, pairs = _pairs(size, word, hashes)
        sent, found = dict(zip(answers.column("shard").to_pylist(), answers.column("counts").to_pylist())), []
        for own, bits, base in ((hashes, word_bits, 0), (pairs, pair_bits, 1 << word_bits)):
            order, edges = _dealt(own, bits)
            both = np.empty((2, len(own)), np.int64)
            for s in np.flatnonzero(np.diff(edges)).tolist():
                a, z = edges[s], edges[s + 1]
                both[:, order[a:z]] = np.frombuffer(pa.decompress(sent[base + s], 16 * (z - a), "zstd"), "i8").reshape(2, -1)
            found.append(both)

        def within(ids, n):
            """How often the document of a word has ids there; the numbers of (document, id) serve for contexts."""
            keys, back, times = np.unique(doc * n + ids, return_inverse=True, return_counts=True)
            return keys, times, times[back]

        _, _, own_pair = within(pair, max(1, len(pairs)))
        keys, times, own_word = within(word, len(hashes))
        at = np.minimum(np.searchsorted(keys, doc * len(hashes) + before), max(0, len(keys) - 1))
        own_context = np.where(before == 0, 1, times[at]) if len(keys) else np.zeros(0, np.int64)
        means, mark = [], target[doc].astype(np.int64)
        for k, total in enumerate(totals):
            own = [x * mark if k else x for x in (own_pair, own_context, own_word, size[doc])]
            loss = _loss(found[1][k][pair], found[0][k][before], found[0][k][word], own, total, vocabulary)
            means.append(np.bincount(doc, loss, len(size)) / np.maximum(size, 1))
        return pa.table({"doc_id": doc_id, "n_words": pa.array(size, pa.int64()), "background_loss": pa.array(means[0]), "target_loss": pa.array(means[1])})

    return run


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, background_loss, target_loss, score."""
    small_batches(docs.sparkSession)
    chunks = _chunks(docs, labels)
    words = chunks.agg(F.sum("words")).first()[0] or 0
    # Nearly every word makes a new bigram in its chunk; distinct words are fewer by a magnitude.
    pair_bits = shard_bits(words)
    word_bits = max(0, pair_bits - 3)
    asked = chunks.select("chunk", "packed").mapInArrow(_asker(word_bits, pair_bits), "shard bigint, chunk bigint, hashes binary, counts binary")
    answers = stored(asked.groupBy("shard").applyInArrow(_answered, "chunk bigint, shard bigint, counts binary, distinct bigint, n bigint, target bigint"), "lm-answers")
    # One row a shard, summed; the start is among the words and stands for the end in the vocabulary.
    of_words = answers.filter(F.col("shard") < 1 << word_bits).groupBy("shard").agg(*[F.max(c).alias(c) for c in ("distinct", "n", "target")])
    vocabulary = of_words.agg(F.sum("distinct")).first()[0] or 1
    # Every word is the second of one bigram.
    totals = answers.filter(F.col("shard") >= 1 << word_bits).groupBy("shard").agg(F.max("n").alias("n"), F.max("target").alias("target")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first()
    run = _scorer(word_bits, pair_bits, vocabulary, tuple(totals))
    out = chunks.select("chunk", "packed").groupBy("chunk").cogroup(answers.select("chunk", "shard", "counts").groupBy("chunk")).applyInArrow(run, "doc_id bigint, n_words bigint, background_loss double, target_loss double")
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))
