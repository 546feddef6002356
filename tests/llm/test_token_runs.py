"""Cached and joined encoding of runs against the library itself."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from angleweave.llm import token_output

PATH = public_tokenizers.path("word_bpe_49k.json")
SIGNS = [*"abXYZhIst'dlmr<|>!?.,;:#&*019 \t\n@[]_=+-/\"$%", "ß", "É", "×", "÷", "µ", "İ", "Σ", "̱", "́", "̇", "̸", "\xa0", " ", "\x85", "\x1c", "日", "١", "<|startoftext|>", "<|ENDOFTEXT|>", "'LL", "\x00", "Å"]


def encoded(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in token_output.RunCache(PATH).encode([t.encode() for t in texts])]


def library(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("most", [3, 12, 60])
def test_random_texts(most):
    r = random.Random(most)
    texts = ["".join(r.choice(SIGNS) for _ in range(r.randint(0, most))) for _ in range(3000)]
    assert encoded(texts) == library(texts)


def test_edges_end_soon():
    texts = ["", "  ", "!" * 400 + "'", "a" * 500 + "日", "é" * 300 + "日" + "#" * 300 + "'", "a1" * 500 + "'", "word " * 50_000]
    assert encoded(texts) == library(texts)


def test_full_generations(monkeypatch):
    monkeypatch.setattr(token_output, "MOST_RUNS", 20)
    monkeypatch.setattr(token_output, "TOGETHER", 2)
    r = random.Random(1)
    texts = [" ".join(r.choice(["Alpha.", "beta", "x1", "日", "gamma!?", "d'or"]) + str(r.randint(0, 9)) for _ in range(30)) for _ in range(100)]
    assert encoded(texts) == library(texts)
