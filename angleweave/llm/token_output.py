"""Token ids as ORC: stripes, integer run-length encoding, row indexes and Bloom filters on doc_id.

Documents are dealt into files by ranges of doc_id and sorted within them, so the files
in order hold ascending ids, and a file's stripes are read in parallel. ORC encodes the
ids with its second run-length encoding; row indexes hold the least and greatest doc_id of every
stride, and a Bloom filter of doc_id lets a reader skip stripes that lack an id.

Encoding is cached per run of anything but ASCII white space: the tokenizer's
normalizer turns white space into a space, its pre-tokenizer drops it and never joins
across it, so a text's ids are those of its runs in order.

Defined cases: null is empty and gives only the end id; a null doc_id comes first;
rows of equal doc_id stand in the order of their texts' hashes and each has a place of its own; they share one file, as ids
are meant to be unique; an empty table gives empty files; only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import fresh_path, small_batches

END_ID = 2
#: Runs of one generation, of which a worker holds two; at about 200 bytes each this is bounded by 480 MB.
MOST_RUNS = 1_200_000
#: Texts whose new runs are encoded together: so many, or the first ones of so many bytes.
TOGETHER = 256
TOGETHER_BYTES = 4 << 20
#: Runs that are encoded as one text.
JOINED = 4096
#: The suffix of tokens that close a word.
WORD_END = "</w>"
#: Bytes of text of a file, about.
FILE_BYTES = 256 << 20
ORC = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.write.format": "0.12",
}


#: Runs of these characters split into a known number of tokenizer words: letters of ASCII and Latin-1, a digit, or other ASCII signs but ' and <.
LETTERS = rb"(?:[A-Za-z]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
SIGNS = rb"[!-&(-/:;=-@\[-`{-~]+"
PLAIN = re.compile(rb"(?:%b|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+" % (b"[A-Za-z0-9" + SIGNS[1:-1]))
PLAIN_WORDS = re.compile(rb"%b|[0-9]|%b" % (LETTERS, SIGNS))
LETTERS_THEN_SIGNS = re.compile(rb"(%b)(%b)?" % (LETTERS, SIGNS))


class Kept(dict):
    """Ids by run. A run that is not there reads as None and is noted."""

    new: list[bytes]

    def __missing__(self, run: bytes) -> None:
        self.new.append(run)


class RunCache:
    """The tokenizer of one file, with ids kept per run as little-endian 32-bit integers.

    New runs of plain characters are encoded many at a time, as one text with spaces
    between them. Its ids are cut where a token closes a word, as every word of the
    tokenizer has one such token, at its end. Other runs are encoded one by one.
    """

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.batch = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        self.kept = Kept()
        self.before: dict[bytes, bytes] = {}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for w, i in vocabulary.items() if w.endswith(WORD_END)]] = True

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out, some, size = [], [], 0
        for t in texts:
            some.append(self._lowered(t))
            size += len(t)
            if len(some) >= TOGETHER or size >= TOGETHER_BYTES:
                out += self._some(some)
                some, size = [], 0
        return out + self._some(some)

    @staticmethod
    def _lowered(text: bytes) -> bytes:
        """A-Z in lower case, as the tokenizer has it; not where a mark could join a letter (lead byte CC) or a special token could arise."""
        return text if b"\xcc" in text or b"<|" in text else text.lower()

    def _some(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        found, gaps = self._looked_up(split)
        if any(gaps):
            if len(self.kept) + sum(map(len, gaps)) > MOST_RUNS:  # runs that are met again come back from the generation before
                self.before, self.kept = self.kept, Kept()
                found, gaps = self._looked_up(split)
            self._learn({w for gap in gaps for w in gap})
            for row, words, gap in zip(found, split, gaps):
                k = -1
                for w in gap:
                    k = row.index(None, k + 1)
                    row[k] = self.kept[w]
        return [b"".join(row) for row in found]

    def _looked_up(self, split: list[list[bytes]]) -> tuple[list[list], list[list[bytes]]]:
        """Ids of every run, None where they are new, and the new runs of every text in order."""
        get, found, gaps = self.kept.__getitem__, [], []
        for words in split:
            self.kept.new = gap = []
            found.append(list(map(get, words)))
            gaps.append(gap)
        return found, gaps

    def _learn(self, new: set[bytes]) -> None:
        kept, before = self.kept, self.before
        if before:
            known = [w for w in new if w in before]
            kept.update((w, before[w]) for w in known)
            new = new.difference(known)
        single, ends, rest = [], [], []
        for w in new:
            if w.isalpha():
                single.append(w)
            elif m := LETTERS_THEN_SIGNS.fullmatch(w):  # signs behind letters are always words of their own
                ends.append((w, m[1], m[2])) if m[2] else single.append(w)
            else:
                rest.append(w)
        single += {x for _, *pair in ends for x in pair if x not in new and x not in kept}
        self._encode_joined(single, [1] * len(single))
        plain = [w for w in rest if PLAIN.fullmatch(w)]
        self._encode_joined(plain, [len(PLAIN_WORDS.findall(w)) for w in plain])
        self._encode([w for w in (*single, *rest) if w not in kept])
        for w, a, b in ends:
            kept[w] = kept[a] + kept[b]

    def _encode_joined(self, runs: list[bytes], words: list[int]) -> None:
        """Runs of which each splits into so many tokenizer words. Where the cut is not clear, nothing is kept."""
        import numpy as np

        for k in range(0, len(runs), JOINED):
            some = runs[k : k + JOINED]
            ids = np.array(self.batch([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            last = np.cumsum(words[k : k + JOINED])
            if last[-1] == len(ends) and ends[-1] == len(ids):
                data, cuts = ids.tobytes(), (ends[last - 1] * 4).tolist()
                self.kept.update((w, data[a:b]) for w, a, b in zip(some, [0, *cuts], cuts))

    def _encode(self, runs: list[bytes]) -> None:
        import numpy as np

        for w, e in zip(runs, self.batch([w.decode() for w in runs], add_special_tokens=False)):
            self.kept[w] = np.array(e.ids, "<u4").tobytes()


@lru_cache(2)
def tokenizer(path: str) -> RunCache:
    return RunCache(path)


def _encoder(path: str, end_id: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .common import utf8

        t, end, part, before = tokenizer(path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        for batch in batches:
            found = [x + end for x in t.encode(utf8(batch.column(1)))]
            lengths = np.array([len(x) // 4 for x in found], np.int64)
            ends = np.cumsum(lengths)
            values = pa.Array.from_buffers(pa.int32(), int(lengths.sum()), [None, pa.py_buffer(b"".join(found))])
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            columns = [batch.column(0), pa.array(np.full(len(found), part, np.int32)), pa.array(before + ends - lengths), pa.array(lengths.astype(np.int32)), pa.ListArray.from_arrays(offsets, values)]
            before += int(lengths.sum())
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "before", "n_tokens", "ids"])

    return run


#: part: the range of doc_id, in ascending order; before: ids of the part's earlier documents.
SCHEMA = "doc_id bigint, part int, before bigint, n_tokens int, ids array<int>"


def parts_of(docs: DataFrame) -> int:
    """Files: one for FILE_BYTES of text, and no fewer than the session's shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Writes doc_id, part, before, n_tokens, ids as ORC files in ascending doc_id order. Texts are shuffled once, before they are encoded."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    rows = rows.repartitionByRange(parts_of(docs), "doc_id").sortWithinPartitions("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows.mapInArrow(_encoder(tokenizer_path, end_id), SCHEMA).write.options(**ORC).orc(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, ids; a filter on doc_id is pushed to stripes and row groups."""
    return spark.read.schema(SCHEMA).orc(path).select("doc_id", "n_tokens", "ids")


def _checksums(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        ids = batch.column(3)
        data, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        crc = [zlib.crc32(data[a:b]) for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "part", "before", "n_tokens", "ids_crc32"])


def starts_and_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the files. A start is the sum of all earlier parts, from their n_tokens alone, and what the file has before the row."""
    small_batches(spark)
    files = spark.read.schema(SCHEMA).orc(path)
    # One row a part: the window's single task has as many rows as there are files.
    counts = files.groupBy(F.col("part").alias("of")).agg(F.sum("n_tokens").alias("tokens"))
    offsets = counts.select("of", (F.sum("tokens").over(Window.orderBy("of")) - F.col("tokens")).alias("offset"))
    rows = files.select("doc_id", "part", "before", "ids").mapInArrow(_checksums, "doc_id bigint, part int, before bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(F.broadcast(offsets), F.col("part") == F.col("of")).select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The ids of some documents; stripes and row groups whose index or Bloom filter excludes the ids are not read."""
    return read_ids(spark, path).filter(F.col("doc_id").isin(doc_ids))


def encoded_digests(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    path = path or fresh_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer_path)
    return starts_and_checksums(docs.sparkSession, path)
