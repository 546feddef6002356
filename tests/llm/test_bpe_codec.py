"""BPE by forced boundaries against the library."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from angleweave.llm import bpe_codec
from angleweave.llm import queries as Q
from tests.llm.test_contracts import DIR, DOCS, empty_dir, odd_dir  # noqa: F401

PATH = Q.tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(table, library, texts):
    found = table.encode([t.encode() for t in texts])
    for text, ids, want in zip(texts, found, library.encode_batch(texts, add_special_tokens=False)):
        ids = np.frombuffer(ids, "<u4")
        assert ids.tolist() == want.ids, text[:100]
        assert table.decode(ids).decode() == library.decode(want.ids, skip_special_tokens=False), text[:100]


def test_random_texts(library):
    rng = random.Random(5)
    signs = "abcdefghijqxz'  \n.!?0123ABCÉéñ́İıſKß日本語🎉\x00\x1f\x85  <|endoftext|>½²ⅷ_#aaaaeeettt"
    same(bpe_codec.FragmentTable(PATH), library, ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(4000)])


def test_long_runs_and_special_tokens(library):
    same(bpe_codec.FragmentTable(PATH), library, ["", " ", "x" * 5000, "ab" * 3000 + "'s", "A" * 70 + "é" * 90, "日本" * 300, "<|endoftext|>", "a<|startoftext|>b<|endoftext|>", "<|ENDOFTEXT|>x", "don't we'll 'tis 'the DON'T", "word " * 20000])


def test_fragments_are_cut_only_where_no_token_spans(library):
    """Every token's bytes stay in one fragment, and a pair that no token holds is cut."""
    table = bpe_codec.FragmentTable(PATH)
    for token, _ in list(library.get_vocab(with_added_tokens=False).items())[::50]:
        raw = token.removesuffix("</w>").translate(table.byte_of).encode("latin-1")
        assert all(table.inside[a, b] for a, b in zip(raw, raw[1:]))
    assert not table.inside[ord("q"), ord("1")] and table.inside[ord("t"), ord("h")]


def test_small_tables_change_nothing(library, monkeypatch):
    """Ids do not depend on what the bounded tables hold."""
    monkeypatch.setattr(bpe_codec, "MOST_RUNS", 20)
    monkeypatch.setattr(bpe_codec, "MOST_INNER", 3)
    monkeypatch.setattr(bpe_codec, "TOGETHER_BYTES", 200)
    rng = random.Random(6)
    same(bpe_codec.FragmentTable(PATH), library, [" ".join(rng.choice(["one", "two,", "3x4", "q1q", "É", "thing's", "y" * 80]) + rng.choice("abc") for _ in range(30)) for _ in range(60)])


@pytest.mark.parametrize("where", ["small", "odd", "empty"])
def test_op12(spark, library, where, request):
    d = DIR if where == "small" else request.getfixturevalue(f"{where}_dir")
    want = []
    for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    found = [tuple(r) for r in Q.op12_bpe(spark, d).collect()]
    assert sorted(found) == sorted(want)


def test_round_trip(spark, library):
    rows = [(1, "Some words, twice 12."), (1, "Some words, twice 12."), (None, "x"), (2, None), (3, "")]
    ids = bpe_codec.encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH)
    texts = bpe_codec.decode(ids, PATH).collect()
    want = [(k, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for k, t in rows]
    assert sorted(map(tuple, texts), key=str) == sorted(want, key=str)
