"""Added spans of op4 against a brute-force version, with planted disclosures."""

import math
import re
from collections import Counter

import pytest

from angleweave.llm import pii
from tests.llm import brute

EDGES = ".,;:!?()[]{}\"'*#$%&|<>"
SECRET = re.compile(r"(?<![A-Za-z0-9_+=])[A-Za-z0-9_+=]{20,}")


def secrets(text, base):
    for m in SECRET.finditer(text):
        v = m[0]
        if sum(c.isdigit() for c in v) >= 2 and sum(c.isalpha() for c in v) >= 2 and not any(a < m.end() and m.start() < z for a, _, z, _ in base):
            yield m.start(), m.end(), v


def spans_by_hand(texts):
    n = len(texts)
    base = [brute.base_spans(t) for t in texts]
    own = [[(a, z, (t or "")[a:z]) for a, _, z, _ in b] for t, b in zip(texts, base)]
    declared = [list(secrets(t or "", b)) for t, b in zip(texts, base)]
    words = []
    for t, a, d in zip(texts, own, declared):
        t = list(t or "")
        for x, z, _ in a + d:
            t[x:z] = ["￿"] * (z - x)
        words.append([(m.start(), m.end(), m[0].strip(EDGES).lower()) for m in brute.WORD.finditer("".join(t)) if "￿" not in m[0]])
    n_term = Counter(w for t in texts for w in {x.strip(EDGES).lower() for x in brute.WORD.findall(t or "")})
    held = [{v for _, _, v in a + d} for a, d in zip(own, declared)]
    n_value = Counter(v for h in held for v in h)
    both = Counter((v, w) for h, ws in zip(held, words) for v in h for w in {x[2] for x in ws})
    out = []
    for b, d, h, ws in zip(base, declared, held, words):
        marks = [(a, k, z, kind) for a, k, z, kind in b] + [(a, 4, z, "term") for a, z, _ in d]
        for a, z, w in ws:
            rates = []
            for v in h:
                share = n_value[v] / n
                given = (both[v, w] + pii.EVIDENCE * share) / (n_term[w] + pii.EVIDENCE)
                rates.append(math.log2(given / share) / -math.log2(share) if share < 1 else 0.0)
            if len(w) >= 3 and rates and max(rates) >= pii.GENERALISE:
                marks.append((a, 4, z, "term"))
        out.append(",".join(f"{kind}:{a}:{z}" for a, _, z, kind in sorted(marks)))
    return out


COMMON = "this text goes on with words that every document of the table holds and nothing else".split()
PLANTED = [
    "Mister Quixano, of Mancha, wrote from quix@mancha.es about sheep",
    "mail quix@mancha.es for Quixano and his horse",
    "the rare Dulcinea lives at 10.1.2.3 and 10.1.2.4 (both hers)",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" of Sancho',
    'again 24be64439e3e49cf46b2d7c90f3602a3d0b907ff, "Sancho" says',
    "no value here but Quixano and Dulcinea all the same",
    None,
    "",
    "a@b.cd " * 50 + "Lone Rider",
    "+1 (555) 123-4567 é\U0001f389 Ünïcode 4111 1111 1111 1111",
]


@pytest.fixture(scope="module")
def texts():
    return [p and f"{' '.join(COMMON)} {p}" for p in PLANTED] + [" ".join(COMMON) + (" sheep" if k % 3 else "") for k in range(90)]


def test_spans_by_hand(spark, texts):
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string").repartition(3)
    have = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    want = spans_by_hand(texts)
    assert len(have) == len(texts)
    for k, t in enumerate(texts):
        assert have[k].spans == want[k], t
        assert have[k].n_terms == want[k].count("term:")
    # The holder's name is found in the documents of the value, and left alone elsewhere.
    assert "term:" in have[0].spans and "term:" in have[2].spans and have[5].spans == "" == have[50].spans


def test_sanitised_rows(spark, texts):
    rows = [(None, texts[0]), (None, texts[0]), (3, texts[3]), (3, texts[50]), (4, None)] + [(100 + k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    clean = [(r.doc_id, r.text) for r in pii.sanitised(docs).collect()]
    assert Counter(d for d, _ in clean) == Counter(d for d, _ in rows)
    assert sum(t is None for _, t in clean) == 2 and sum(t == texts[50] for _, t in clean) == sum(t == texts[50] for _, t in rows)
    every = " ".join(t or "" for d, t in clean if d is None or d in (3, 100, 102, 103))
    assert not re.search("mancha|24be64|10[.]1|Quixano|Dulcinea", every) and "[EMAIL]" in every and "[IP]" in every
    assert pii.sanitised(docs.filter("false")).collect() == []


def test_real_table(spark):
    """At the smallest size too, the method finds terms."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    have = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(texts, spans_by_hand([*texts.values()])))
    assert have == want and any("term:" in s for s in have.values())
