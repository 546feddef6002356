"""The pipeline's stages and the operators' own interfaces, on rows with nulls, repeats, clashing columns and long texts, against brute force."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from angleweave.llm import exact_dedup, mixing, quality_classifier, sentencepiece_codec, sharding, simhash, token_output
from angleweave.llm import queries as Q
from tests.llm import brute

KIND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("fp", T.StringType()), T.StructField("sha", T.StringType()), T.StructField("rid", T.LongType()), T.StructField("shard", T.StringType()), T.StructField("first", T.StringType())])
WORDS = "the quick brown fox jumps over one lazy dog while seven other foxes watch it from the far side of that hill".split()
BASE = " ".join(WORDS * 12)
TEXTS = [
    (None, "q q q"), (None, "q q q"), (5, "zz"), (5, "yy yy"), (5, "yy yy"), (7, BASE), (8, BASE + " end"), (None, BASE), (9, BASE.replace("dog", "cat", 1)),
    (1, None), (2, ""), (None, None), (3, " \n"), (10, "a b"), (10, "a  b"), (10, "c d"), (11, "word " * 250_000), (12, "word " * 250_000), (13, "x" * 1_200_000), (14, "yy yy"),
]


def table(spark, rows):
    return spark.createDataFrame([(d, t, ["en", None][k % 2], ["a", "b", None][k % 3], None, "f", "s", k % 4, "x", None) for k, (d, t) in enumerate(rows)], KIND).repartition(4)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS)


def contents(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_keep_first(spark, docs):
    out = exact_dedup.keep_first(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    groups = {}
    for d, t in TEXTS:
        groups.setdefault(norm(t), []).append(d)
    assert Counter(norm(r.text) for r in kept) == dict.fromkeys(groups, 1)
    for r in kept:
        assert r.doc_id == min(groups[norm(r.text)], key=lambda d: (d is None, d or 0))


def test_keep_first_with_many_filters(spark, docs, monkeypatch):
    """Several sharded filters, far too small: false positives are shuffled, the result is the same."""
    want = contents(exact_dedup.keep_first(docs))
    monkeypatch.setattr(exact_dedup, "MOST_BITS", 64)
    monkeypatch.setattr(exact_dedup, "LEAST_BITS", 64)
    monkeypatch.setattr(exact_dedup, "BITS_A_SLOT", 32)
    assert sum(contents(exact_dedup.keep_first(docs)).values()) == sum(want.values())
    found = sorted(((r.doc_id, r.group_size) for r in exact_dedup.exact_duplicates(docs).collect()), key=str)
    sizes = Counter(norm(t) for _, t in TEXTS)
    assert found == sorted(((d, sizes[norm(t)]) for d, t in TEXTS), key=str)


def test_keep_one(spark, docs):
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    prints = [brute.fingerprint(t) for _, t in TEXTS]
    group = list(range(len(TEXTS)))
    for i in range(len(TEXTS)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    want = Counter(min(((d is None, d or 0) for k, (d, _) in enumerate(TEXTS) if group[k] == g)) for g in {*group})
    kept = out.collect()
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in kept) == want
    assert {group[[t for _, t in TEXTS].index(r.text)] for r in kept} == {*group}
    assert {"q q q", "zz", "yy yy"} <= {r.text for r in kept}


def test_keep_good(spark, docs):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(20)] + [(None, 1, 0), (5, None, None)], "doc_id bigint, quality int, toxic int")
    out = quality_classifier.keep_good(docs, labels)
    verdict = {r.doc_id: r.kept for r in quality_classifier.classified(table(spark, [(k, t) for k, (_, t) in enumerate(TEXTS)]), labels).collect()}
    assert out.columns == docs.columns and len(verdict) == len(TEXTS)
    assert not contents(out) - Counter(TEXTS)
    none = quality_classifier.keep_good(docs, labels.filter("false"))
    assert contents(none) == Counter(TEXTS)


def test_emit(spark, docs):
    counts = Counter()
    for r in mixing.mixed(docs).collect():
        counts[r.doc_id, r.size] += r.copies
    size = lambda t: len(brute.WORD.findall(t or ""))
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    have = Counter()
    for r in out.collect():
        have[r.doc_id, size(r.text)] += 1
    assert have == +counts


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_mix_comes_near_its_targets(spark, sf):
    """A source's words are a sum of independent draws: within six standard deviations of its target."""
    rows = mixing.mixed(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).collect()
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        rate = own[0].target / own[0].source_size
        part = rate % 1
        deviation = (part * (1 - part) * sum(r.size**2 for r in own)) ** 0.5
        assert abs(sum(r.taken for r in own) - own[0].target) <= 6 * deviation + 1e-6
        assert all(r.taken <= 3 * r.size for r in own)


def test_codec_round_trip(spark, docs):
    import sentencepiece

    path = Q.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    some = docs.filter("length(text) < 10000 or text is null")
    ids = sentencepiece_codec.encode(some, path)
    want = Counter((d, tuple(sp.encode(t or ""))) for d, t in TEXTS if len(t or "") < 10000)
    assert Counter((r.doc_id, tuple(r.ids)) for r in ids.collect()) == want
    assert contents(sentencepiece_codec.decode(ids, path)) == Counter((d, sp.decode(list(i))) for d, i in want.elements())
    empty = docs.filter("false")
    assert sentencepiece_codec.encode(empty, path).count() == 0


def test_write_shards(spark, tmp_path, docs):
    rows = [(k, t) for k, (_, t) in enumerate(TEXTS)]
    d = table(spark, rows)
    placed = {r.doc_id: (r["shard"], r.shard_bytes, r.shard_rows) for r in sharding.write_shards(d, f"{tmp_path}/shards", limit=2000).collect()}
    back = spark.read.option("basePath", f"{tmp_path}/shards").schema("doc_id bigint, text string, rid bigint, __shard string").parquet(f"{tmp_path}/shards")
    found = back.collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter(rows)
    assert all(placed[r.doc_id][0] == r["__shard"].removeprefix("b") for r in found)
    assert all(size <= 2000 or n == 1 for _, size, n in placed.values())


def test_shards_without_a_broadcast(spark, docs, monkeypatch):
    """A directory beyond the counted limit is joined by a shuffle, and no broadcast stays in the plan; the rows are the same."""

    def shards(df):
        return Counter((r.doc_id, r["shard"], r.depth, r.bytes, r.shard_bytes, r.shard_rows) for r in df.collect())

    some = table(spark, [(k % 50, "word " * (k % 7)) for k in range(300)])
    want = shards(sharding.assign_shards(some, limit=100))
    monkeypatch.setattr(sharding, "BROADCAST_ROWS", 0)
    got = sharding.assign_shards(some, limit=100)
    # Rows of one id are told apart by a number drawn a run: the shards of single ids do not depend on it.
    assert Counter((d, b) for (d, _, _, b, _, _), n in shards(got).items() for _ in range(n)) == Counter((d, b) for (d, _, _, b, _, _), n in want.items() for _ in range(n))
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    alone = table(spark, [(k, "word " * (k % 7)) for k in range(300)])
    got = shards(sharding.assign_shards(alone, limit=100))
    monkeypatch.undo()
    assert got == shards(sharding.assign_shards(alone, limit=100))
    assert all(size <= 100 or n == 1 for _, _, _, _, size, n in got)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_and_empty_tables(spark, tmp_path, docs, name, stage):
    spark.createDataFrame([(k, 1, 0) for k in range(15)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert stage(spark, docs.filter("false"), str(tmp_path)).count() == 0
    out = stage(spark, docs, str(tmp_path))
    assert out.columns[0] == "doc_id" and (name == "sentencepiece" or out.columns == docs.columns)
    assert 0 < out.count() <= 3 * len(TEXTS)


def test_pipeline_by_stages(spark):
    """run() is its stages one after another; each is held against brute force on what its predecessor kept."""
    import sentencepiece

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)["quality_classifier"](spark, docs, d)
    verdict = {r.doc_id: r.kept for r in Q.op5_quality_classifier(spark, d).collect()}
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert {k for k, _ in rows} == {k for k, v in verdict.items() if v}
    first = exact_dedup.keep_first(kept)
    rows = {min(d for d, t in rows if norm(t) == norm(x)): None for _, x in rows} and {k: t for k, t in rows if k == min(d for d, x in rows if norm(x) == norm(t))}
    assert {r.doc_id: r.text for r in first.collect()} == rows
    near = brute.near(list(rows.items()))
    one = simhash.keep_one(first)
    rows = {k: t for k, t in rows.items() if near[k][1] == k}
    assert {r.doc_id: r.text for r in one.collect()} == rows
    copies = {r.doc_id: r.copies for r in mixing.mixed(one).collect()}
    assert Counter(r.doc_id for r in mixing.emit(one).collect()) == +Counter(copies)
    sp = sentencepiece.SentencePieceProcessor(model_file=Q.tokenizer_path("piece_bpe_32k.model"))
    want = Counter()
    for k, n in copies.items():
        ids = sp.encode(rows[k] or "")
        if n:
            want[k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += n
    assert Counter(map(tuple, corpus_pipeline.run(spark, d).collect())) == want


def test_write_shards_keeps_every_row(spark, tmp_path):
    """Repeated ids and ids that are null: as many rows out as in."""
    rows = [(1, "a", "u"), (1, "a", "u"), (1, "b", "v"), (None, "c", "w"), (None, "c", "w"), (2, None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard string")
    sharding.write_shards(df, f"{tmp_path}/shards", limit=1)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(map(tuple, back.select("doc_id", "text", "shard").collect()), key=str) == sorted(rows, key=str)
    assert back.select("__shard").distinct().count() == 6  # each row of its own, as none fits beside another
