"""SentencePiece BPE by a prefix table, equal to the library's encode().

A merge-type tokenizer gives every prefix of a text one last token, and a token can
follow another exactly if encoding the two strings together gives these two tokens.
So for every prefix the table stores its last token: among the pieces that end there
(found by an Aho-Corasick automaton), the one that is compatible with the last token
of the prefix before it. Ids are recovered from the end backwards.

Text falls into parts that no piece spans: a space (or U+2581) starts a new part
unless it follows another one, and a character that no piece holds stands alone and
becomes its UTF-8 bytes. A part is cut further where no piece holds both neighbours.
Parts are encoded once per worker while a bounded table has room.

Pieces of white space alone all have the same score; the merge order then goes from
the left, and the pair test, which runs the merges themselves, follows it.

Defined cases: null is empty; empty text has no ids; the dummy prefix is put before
all other text; texts of any length are encoded whole; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MARK = "▁"
#: Parts kept per worker; at about 250 bytes each this is bounded by 150 MB.
MOST_PARTS = 600_000
MOST_PAIRS = 1_000_000


class PrefixTable:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, self.ids, self.scores, self.bytes = self.library, {}, {}, {}
        for k in range(sp.get_piece_size()):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.bytes[int(piece[3:5], 16)] = k
            elif not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)):
                self.ids[piece], self.scores[piece] = k, sp.get_score(k)
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.chars = {c for piece in self.ids for c in piece}
        self._parts = re.compile(f"{MARK}*[^{MARK}]*").findall
        self.words: dict[str, tuple[int, ...]] = {}
        self.starts: dict[str, tuple[int, ...]] = {}
        self.inside = {piece[k : k + 2] for piece in self.ids for k in range(len(piece) - 1)}
        self.fits: dict[tuple[str, str], bool] = {}
        self.reachable = lru_cache(100_000)(lambda p: self.merged(p) == [p])

    def merged(self, text: str) -> list[str]:
        """The merges themselves, for strings of one or two pieces: best score first, then from the left."""
        parts: list[str | None] = list(text)
        after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (whole := parts[a] + parts[b]) in self.scores:
                heapq.heappush(queue, (-self.scores[whole], a, b, whole))

        for k in range(len(parts) - 1):
            offer(k, k + 1)
        while queue:
            _, a, b, whole = heapq.heappop(queue)
            if parts[a] is None or parts[b] is None or after[a] != b or parts[a] + parts[b] != whole:
                continue
            parts[a], parts[b] = whole, None
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p is not None]

    def _pair_fits(self, first: str, second: str) -> bool:
        if len(self.fits) >= MOST_PAIRS:
            self.fits.clear()
        found = self.fits[first, second] = self.merged(first + second) == [first, second]
        return found

    def _run(self, text: str) -> list[str]:
        """Pieces of a text all of whose characters are in pieces."""
        n = len(text)
        last: list[str | None] = [None] * (n + 1)
        fits = self.fits
        # The automaton gives the pieces that end at a place longest first; the compatible one is unique.
        for k, piece in self.automaton.iter(text):
            end = k + 1
            if last[end] is None:
                start = end - len(piece)
                if not start:
                    if self.reachable(piece):
                        last[end] = piece
                elif (before := last[start]) is not None:
                    ok = fits.get((before, piece))
                    if ok is None:
                        ok = self._pair_fits(before, piece)
                    if ok:
                        last[end] = piece
        out = []
        while n:
            if last[n] is None:
                raise ValueError(f"no piece ends at {n} of {text!r}")
            out.append(last[n])
            n -= len(last[n])
        return out[::-1]

    def part(self, text: str) -> tuple[int, ...]:
        """Ids of a part; characters outside all pieces become bytes."""
        if self.chars.issuperset(text):
            return tuple(map(self.ids.__getitem__, self._run(text)))
        out: list[int] = []
        start = 0
        for k, c in enumerate(text):
            if c not in self.chars:
                if k > start:
                    out += map(self.ids.__getitem__, self._run(text[start:k]))
                out += map(self.bytes.__getitem__, c.encode())
                start = k + 1
        if start < len(text):
            out += map(self.ids.__getitem__, self._run(text[start:]))
        return tuple(out)

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of a word behind a space, put together from its cuts: places where no piece holds both neighbours."""
        inside = self.inside
        cuts = [0, *(k for k in range(1, len(word)) if word[k - 1 : k + 1] not in inside), len(word)]
        if len(cuts) == 2:
            return self._keep(self.words, word, MARK + word)
        first = word[: cuts[1]]
        out = self.words.get(first) or self._keep(self.words, first, MARK + first)
        for a, z in zip(cuts[1:], cuts[2:]):
            some = word[a:z]
            out += self.starts.get(some) or self._keep(self.starts, some, some)
        if "\n" not in word:  # lines meet in countless ways
            self._store(self.words, word, out)
        return out

    def _keep(self, where: dict[str, tuple[int, ...]], key: str, text: str) -> tuple[int, ...]:
        found = self.part(text)
        self._store(where, key, found)
        return found

    def _store(self, where: dict[str, tuple[int, ...]], key: str, found: tuple[int, ...]) -> None:
        if len(key) <= 64:
            if len(where) >= MOST_PARTS:
                where.clear()
            where[key] = found

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            parts = self._parts(MARK + text.replace(" ", MARK))
            return [k for p in parts if p for k in self.part(p)]
        words = text.split(" ")
        found = list(map(self.words.get, words))
        if None in found:
            make = self._word
            found = [make(w) if f is None else f for w, f in zip(words, found)]
        return list(chain.from_iterable(found))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(4)
def table(path: str) -> PrefixTable:
    return PrefixTable(path)


def _encoder(path: str):
    def run(batches):
        import pyarrow as pa

        t, names = table(path), None
        names = [str(k) for k in range(t.library.get_piece_size())]
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = t.encode(text or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join([names[k] for k in ids]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(t.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256. The path must exist on every executor."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(_encoder(path), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids, for further use."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        t = table(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.encode(x or "") for x in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text, from doc_id and ids."""
    small_batches(ids.sparkSession)

    def run(batches):
        import pyarrow as pa

        t = table(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
