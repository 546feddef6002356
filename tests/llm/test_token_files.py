"""The token files: order, offsets of rows that share an id, stripes, and what lookups read."""

import glob

import pytest
from pyarrow import orc

from angleweave.llm import queries as Q
from angleweave.llm import token_output

N = 40_000


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tokens")) + "/ids"
    docs = spark.range(N).selectExpr("id * 2 AS doc_id", "concat('text number ', id, ' of many') AS text").repartition(4)
    token_output.write_ids(docs, path, Q.tokenizer_path("word_bpe_49k.json"))
    return path


def read_rows(df):
    """The result, and how many rows the scan gave."""
    found = df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return found, scan.metrics().apply("numOutputRows").value()


def test_files_hold_ascending_ids(files):
    parts = [orc.ORCFile(p).read().column("doc_id").to_pylist() for p in sorted(glob.glob(f"{files}/part-*"))]
    assert [d for p in parts for d in p] == list(range(0, 2 * N, 2)) and len(parts) >= 8


def test_row_index_prunes(spark, files):
    found, rows = read_rows(token_output.lookup(spark, files, [2 * 777, 2 * 30_000]))
    assert sorted(r.doc_id for r in found) == [1554, 60_000] and rows <= 4 * 1000


def test_bloom_filter_prunes(spark, files):
    """Ids that lie between those of every stride, but are not there: indexes cannot tell, the filter does."""
    asked = [4 * k + 1 for k in range(0, N // 2, 2500)]
    found, rows = read_rows(token_output.lookup(spark, files, asked))
    assert found == [] and rows <= 2 * 1000


def test_ids_are_run_length_encoded(files):
    """Second run-length encoding: a column of doc_ids in steps takes far less than 8 bytes an id."""
    size = sum(orc.ORCFile(p).content_length for p in glob.glob(f"{files}/part-*"))
    tokens = sum(sum(orc.ORCFile(p).read().column("n_tokens").to_pylist()) for p in glob.glob(f"{files}/part-*"))
    assert size < 2 * tokens


def test_rows_of_one_id(spark, tmp_path):
    """Repeated and null ids: every row has its own place, and the places are without gaps."""
    rows = [(5, f"text {k} " * (k % 7)) for k in range(300)] + [(None, "x y"), (None, None), (1, ""), (9, "same"), (9, "same")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = token_output.encoded_digests(docs, Q.tokenizer_path("word_bpe_49k.json"), f"{tmp_path}/ids").collect()
    found.sort(key=lambda r: r.start)
    assert len(found) == len(rows)
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in found]
    assert ids == [None, None, 1] + [5] * 300 + [9, 9]
    empty = token_output.encoded_digests(docs.filter("false"), Q.tokenizer_path("word_bpe_49k.json"), f"{tmp_path}/none")
    assert empty.collect() == []
