"""BPE by forced boundaries, equal to the tokenizers library's encode() and decode().

A merge makes a token of the vocabulary, so two neighbouring bytes that no token holds
side by side never meet in one token: the text is certainly cut between them. The table
of byte pairs that do occur inside tokens (256 x 256 bits) is built from the
vocabulary. Every word is cut at all other pairs, the fragments are encoded
independently, and their ids are concatenated. White space occurs in no token, so texts
fall into runs first; fragments and short runs are kept per worker in bounded tables.

New fragments are merged together: in each round every fragment merges its leftmost
pair of the best rank, over flat arrays. Fragments of more than LONG bytes go one by
one through a queue of pairs.

Words are what the tokenizer's own normalizer and splitting rule make of a run; runs of ASCII and
Latin-1 letters, digits and signs are split by an equal rule. Special tokens' strings in a
text become their ids, as with the library.

Defined cases: null is empty; empty or blank text has no ids; texts of any length are
encoded whole; repeated rows and ids each give a row; a null doc_id stays null; an empty
table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, utf8
from .token_output import PLAIN, PLAIN_WORDS, RunCache

#: Texts encoded together: so many bytes, or one longer text.
TOGETHER_BYTES = 4 << 20
#: Runs of one generation, of which a worker holds two, and fragments inside words; at about 200 bytes each bounded by 320 MB.
MOST_RUNS = 700_000
MOST_INNER = 200_000
#: Longer runs are not kept beyond their texts, longer fragments are merged through a queue.
LONG = 64
NO_RANK = 1 << 20
#: Capital letters of ASCII and Latin-1, which the normalizer changes.
CAPITAL = re.compile(rb"[A-Z]|\xc3[\x80-\x9e]")
BITS = 40


class FragmentTable:
    """Encoder and decoder for one tokenizer file: a byte-level BPE with a suffix that closes words."""

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary, self.suffix = file["model"]["vocab"], file["model"]["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        byte_of = self._alphabet()
        strings = {i: t for t, i in (vocabulary | special).items()}
        self.tokens = [strings.get(i, "").encode() for i in range(max(strings) + 1)]
        self.special = {t.encode(): np.array([i], "<u4").tobytes() for t, i in special.items()}
        self.at_special = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + b")") if special else None
        self.byte_of = str.maketrans({c: chr(b) for c, b in byte_of.items()})
        self.first, self.last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for c, b in byte_of.items():
            self.first[b], self.last[b] = vocabulary[c], vocabulary[c + self.suffix]
        self.inside = np.zeros((256, 256), bool)
        for t in vocabulary:
            raw = t.removesuffix(self.suffix).translate(self.byte_of).encode("latin-1")
            for a, b in zip(raw, raw[1:]):
                self.inside[a, b] = True
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in file["model"]["merges"]]
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        self.ranks = np.argsort(keys, kind="stable")
        self.keys = keys[self.ranks]
        self.runs: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.inner: dict[bytes, bytes] = {}

    @staticmethod
    def _alphabet() -> dict[str, int]:
        """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others by characters from U+0100 on, in order."""
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in set(shown)]
        return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of every text, as little-endian 32-bit integers."""
        out, some, size = [], [], 0
        for t in texts:
            some.append(RunCache._lowered(t).split())
            size += len(t)
            if size >= TOGETHER_BYTES:
                out += self._some(some)
                some, size = [], 0
        return out + self._some(some)

    def _some(self, split: list[list[bytes]]) -> list[bytes]:
        wanted = set().union(*split)
        new = wanted.difference(self.runs)
        if len(self.runs) + len(new) > MOST_RUNS:  # runs that are met again come back from the generation before
            self.before, self.runs = self.runs, {}
            new = wanted
        self._learn(new)
        ids = self.runs.__getitem__
        out = [b"".join(map(ids, words)) for words in split]
        for w in new:
            if len(w) > LONG:
                del self.runs[w]
        return out

    def _learn(self, new: set[bytes]) -> None:
        import numpy as np

        runs = self.runs
        if self.before:
            runs.update((w, self.before[w]) for w in new if w in self.before)
        order, split = [], []
        for w in new:
            if w in runs:
                continue
            if PLAIN.fullmatch(w) and not CAPITAL.search(w):
                words = PLAIN_WORDS.findall(w)
            elif self.at_special and self.at_special.search(w):
                parts = self.at_special.split(w)
                self._learn({p for p in parts[::2] if p and p not in runs})
                runs[w] = b"".join(self.special[p] if k % 2 else runs.get(p, b"") for k, p in enumerate(parts))
                continue
            else:
                words = self._words(w)
            order.append(w)
            split.append(words)
        if not order:
            return
        words = list(chain.from_iterable(split))
        data = b"".join(words)
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(data, np.uint8)
        closes = np.zeros(len(flat), bool)
        closes[np.cumsum(lengths) - 1] = True
        cut = closes.copy()
        cut[:-1] |= ~self.inside[flat[:-1], flat[1:]]
        ends = np.flatnonzero(cut) + 1
        final = closes[ends - 1].tolist()
        ends = ends.tolist()
        fragments = [data[a:b] for a, b in zip([0, *ends], ends)]
        inner = self.inner
        if len(inner) > MOST_INNER:
            inner.clear()
        missing = {(f, z) for f, z in zip(fragments, final) if f not in (runs if z else inner)}
        own = [runs, inner] if len(missing) < MOST_RUNS else [dict(runs), dict(inner)]
        for (f, z), ids in zip(missing, self._merged(list(missing))):
            own[0 if z else 1][f] = ids
        ids = [own[0 if z else 1][f] for f, z in zip(fragments, final)]
        # A run's fragments end where its last word does.
        sizes = np.array([sum(map(len, ws)) for ws in split], np.int64)
        until = np.searchsorted(np.array(ends), np.cumsum(sizes), side="right").tolist()
        for w, a, b in zip(order, [0, *until], until):
            runs[w] = ids[a] if b == a + 1 else b"".join(ids[a:b])
        for f, _ in missing:
            if len(f) > LONG:
                inner.pop(f, None)
                if f not in new:
                    runs.pop(f, None)

    def _words(self, run: bytes) -> list[bytes]:
        """The words of a run by the tokenizer's own normalizer and splitting rule."""
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(run.decode()))
        return [w.translate(self.byte_of).encode("latin-1") for w, _ in found]

    def _rank(self, left, right):
        """Ranks of pairs of ids, NO_RANK where they do not merge."""
        import numpy as np

        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def _merged(self, fragments: list[tuple[bytes, bool]]) -> list[bytes]:
        import numpy as np

        out: list[bytes] = [b""] * len(fragments)
        short = []
        for k, (f, z) in enumerate(fragments):
            if len(f) > LONG:
                out[k] = self._queued(f, z)
            else:
                short.append(k)
        if not short:
            return out
        lengths = np.array([len(fragments[k][0]) for k in short], np.int64)
        flat = np.frombuffer(b"".join(fragments[k][0] for k in short), np.uint8)
        ends = np.cumsum(lengths) - 1
        ids = self.first[flat]
        final = ends[np.array([fragments[k][1] for k in short], bool)]
        ids[final] = self.last[flat[final]]
        of = np.repeat(np.arange(len(short)), lengths)
        rank = np.full(len(ids), NO_RANK, np.int64)
        rank[:-1] = np.where(of[:-1] == of[1:], self._rank(ids[:-1], ids[1:]), NO_RANK)
        done_ids, done_of = [], []
        while len(ids):
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            best = np.minimum.reduceat(rank << BITS | np.arange(len(ids)), starts)
            merges = best >> BITS < NO_RANK
            if not merges.all():
                keep = np.repeat(merges, np.diff(np.r_[starts, len(ids)]))
                done_ids.append(ids[~keep])
                done_of.append(of[~keep])
                ids, of, rank = ids[keep], of[keep], rank[keep]
                continue
            at = best & (1 << BITS) - 1
            ids[at] = self.made[best >> BITS]
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            at = at - np.arange(len(at))  # each earlier fragment has lost one id
            ids, of, rank = ids[stays], of[stays], rank[stays]
            for p in (at, at[at > 0] - 1):
                p, right = p[p + 1 < len(ids)], p[p + 1 >= len(ids)]
                rank[right] = NO_RANK
                rank[p] = np.where(of[p] == of[p + 1], self._rank(ids[p], ids[p + 1]), NO_RANK)
        of = np.concatenate(done_of)
        order = np.argsort(of, kind="stable")
        data = np.concatenate(done_ids)[order].astype("<u4").tobytes()
        cuts = (np.cumsum(np.bincount(of, minlength=len(short))) * 4).tolist()
        for k, a, b in zip(short, [0, *cuts], cuts):
            out[k] = data[a:b]
        return out

    def _queued(self, fragment: bytes, final: bool) -> bytes:
        """One long fragment: pairs by rank, then from the left."""
        import numpy as np

        flat = np.frombuffer(fragment, np.uint8)
        ids = self.first[flat].tolist()
        if final:
            ids[-1] = int(self.last[flat[-1]])
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        ranks = self._rank(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist()
        queue = [(r, k, ids[k], ids[k + 1]) for k, r in enumerate(ranks) if r < NO_RANK]
        heapq.heapify(queue)
        known: dict[tuple[int, int], int] = {}

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0:
                pair = ids[a], ids[b]
                r = known.get(pair)
                if r is None:
                    r = known[pair] = int(self._rank(np.array([pair[0]], np.int64), np.array([pair[1]], np.int64))[0])
                if r < NO_RANK:
                    heapq.heappush(queue, (r, a, *pair))

        while queue:
            r, a, x, y = heapq.heappop(queue)
            b = after[a]
            if b < 0 or ids[a] != x or ids[b] != y:
                continue
            ids[a], ids[b] = int(self.made[r]), -1
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            after[b] = -1
            offer(before[a], a)
            offer(a, after[a])
        return np.array([k for k in ids if k >= 0], "<u4").tobytes()

    def decode(self, ids) -> bytes:
        """The UTF-8 text of an array of ids, special tokens included: the tokens' strings with spaces between them, as the file names no decoder."""
        if hasattr(ids, "tolist"):
            ids = ids.tolist()
        return b" ".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def table(path: str) -> FragmentTable:
    return FragmentTable(path)


def _digests(path: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        t = table(path)
        for batch in batches:
            found = t.encode(utf8(batch.column(1)))
            columns = [
                batch.column(0),
                pa.array([len(x) // 4 for x in found], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()),
                pa.array([hashlib.sha256(t.decode(np.frombuffer(x, "<u4"))).hexdigest() for x in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256. The path must exist on every executor."""
    return _rows(docs).mapInArrow(_digests(path), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        t = table(path)
        for batch in batches:
            found = t.encode(utf8(batch.column(1)))
            ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(found))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "ids"])

    return _rows(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text, from doc_id and ids; null ids give the empty text."""
    small_batches(ids.sparkSession)

    def run(batches):
        import pyarrow as pa

        t = table(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode(x or []).decode() for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
