"""The registered queries on the smallest tables and on a table of odd rows, against brute force and SQL."""

import hashlib

import duckdb
import pytest
import sentencepiece
from pyspark.sql import types as T
from tokenizers import Tokenizer

from angleweave.llm import queries as Q
from tests.llm import brute

DIR = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("fp", T.LongType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
LONG = "word " * 30000
ODD = [
    None, "", " ", "\n\t", "one", "Two words", "a b c", "a b c d", "A  B\tC\nD", "x" * 5000, LONG, LONG + "end",
    "mail me a.b@c.de or a@b or a@b.c_d@e.fg now", "1.2.3.4 and 256.1.1.1 and 1.2.3.4.5.6.7.8", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567 and +12 and +1234567890123456",
    "0" * 3000, "a@" * 2000, "1." * 3000, "@@ +1+1+1 .@. 1 2 3", "9" * 15 + "@x.y.z" + ".q" * 500, "é+49 30 1234567 ü a@é.de b@c.dé",
    "line one is here now\nline one is here now\nother\n\n \nother", "v w x y z v w x y z v w x y z", "### $$$ %%% &&& ||| <<< >>>",
    "<|endoftext|> <|ENDOFTEXT|> it's I'LL İstanbul ﬁ é é ½ 12ab", "▁under  score ▁ 日本語🎉\x00\x1f", "  lead and trail  ", "dup text here", "dup  text\nhere", "dup text here",
]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    rows = [(k, t, [None, "en", "de"][k % 3], [None, "s1", "s2", "s1", "hot"][k % 5], None, "x", "y", 7) for k, t in enumerate(ODD)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(5)] + [(None, 1, 0), (2, None, None)], LABELS).write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module", params=["small", "odd"])
def case(request, spark):
    d = DIR if request.param == "small" else request.getfixturevalue("odd_dir")
    return d, [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]


def got(spark, name, d, key="doc_id"):
    return sorted((tuple(r) for r in Q.queries()[name](spark, d).collect()), key=lambda r: (r[0] is None, r[0]))


def test_op3(spark, case):
    d, rows = case
    assert {r[0]: r[1:3] for r in got(spark, "op3_simhash", d)} == brute.near(rows)


def test_op4(spark, case):
    d, rows = case
    found = {r.doc_id: r for r in Q.op4_pii(spark, d).collect()}
    assert len(found) == len(rows)
    for k, t in rows:
        r = found[k]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256] == brute.base_digest(t), t[:80]
        base = [s for s in r.spans.split(",") if s and not s.startswith("term:")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256


def test_op7(spark, case):
    d, rows = case
    sp = sentencepiece.SentencePieceProcessor(model_file=Q.tokenizer_path("piece_bpe_32k.model"))
    want = []
    for k, t in rows:
        ids = sp.encode(t or "")
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got(spark, "op7_sentencepiece", d) == sorted(want)


def test_op8(spark, case):
    d, rows = case
    assert got(spark, "op8_token_output", d) == brute.token_rows(rows, Tokenizer.from_file(Q.tokenizer_path("word_bpe_49k.json")))


def test_op9(spark, case):
    d, rows = case
    found = got(spark, "op9_exact_dedup", d)
    assert [(a, b, c, e) for a, b, c, _, e in found] == sorted(brute.exact(rows))
    assert all(kept == (a == b) for a, b, _, kept, _ in found)


def test_op10(spark, case):
    d, rows = case
    found = got(spark, "op10_quality_rules", d)
    assert [r[:7] for r in found] == sorted((k, *brute.rule_counts(t)) for k, t in rows)
    assert not any(r[6] and r[7] for r in found)


#: Their table is that of the vectors: test_vectors.py.
OF_VECTORS = {"op11_centroids", "op13_vector_codes"}


@pytest.mark.parametrize("name", sorted({*Q.oracle_sql()} - OF_VECTORS))
def test_sql(spark, case, name):
    d, _ = case
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{d}/documents.parquet{'' if d == DIR else '/*.parquet'}')")
    df = Q.queries()[name](spark, d)
    columns = sorted(df.columns)
    want = con.sql(Q.oracle_sql()[name]).project(", ".join(columns)).fetchall()
    have = [tuple(r) for r in df.select(*columns).collect()]
    clean = lambda rows: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=str)
    assert clean(have) == clean(want)


@pytest.mark.parametrize("name", sorted({*Q.queries()} - OF_VECTORS))
def test_empty_and_stable(spark, empty_dir, odd_dir, name):
    f = Q.queries()[name]
    assert f(spark, empty_dir).collect() == []
    once = sorted(map(str, f(spark, odd_dir).collect()))
    assert len(once) == len(ODD) and once == sorted(map(str, f(spark, odd_dir).collect()))
