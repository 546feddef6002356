"""The queries of this folder over the test tables, and their SQL where SQL can express them.

Each query applies its operator, with production parameters, to the whole of its table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, centroid_clustering, exact_dedup, lm_scoring, mixing, pii, quality_classifier, quality_rules, sentencepiece_codec, sharding, simhash, token_output, vector_codes
from .common import read_table

SHARD_BYTES = 1 << 20


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"), "doc_id", F.octet_length("text"), SHARD_BYTES)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classified(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.encoded_digests(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cutoffs", "risk_bound")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.clustered(read_table(spark, sf_dir, "embeddings"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_digests(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_lm_scoring, op3_simhash, op4_pii, op5_quality_classifier, op6_mixing, op7_sentencepiece, op8_token_output, op9_exact_dedup, op10_quality_rules, op11_centroids, op12_bpe, op13_vector_codes)}


OP1_SQL = f"""
WITH k AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes FROM documents),
nodes AS (SELECT d, h >> (60 - d) AS p, CAST(sum(bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows FROM k, generate_series(0, 40) t(d) GROUP BY ALL),
leaf AS (SELECT k.doc_id, k.h, k.bytes, coalesce(max(i.d) + 1, 0) AS depth FROM k LEFT JOIN nodes i ON i.shard_bytes > {SHARD_BYTES} AND i.shard_rows > 1 AND i.p = (k.h >> (60 - i.d)) GROUP BY ALL)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(p), CAST(depth AS INTEGER), '0') END AS shard, CAST(depth AS INTEGER) AS depth, bytes, shard_bytes, shard_rows
FROM leaf JOIN nodes ON nodes.d = depth AND nodes.p = (h >> (60 - depth))
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
c AS (SELECT *, source_size * 3 AS ceiling, (source_size * 3) / weight AS ratio FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(ceiling) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
f AS (SELECT min(level) FILTER (WHERE ceiling > level * weight AND ratio = (SELECT min(ratio) FROM l WHERE ceiling > level * weight)) AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN f.level IS NULL OR ceiling <= f.level * weight THEN CAST(ceiling AS DOUBLE) ELSE f.level * weight END AS target FROM l, f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(3.0, t.target / t.source_size) ELSE 0.0 END AS rate, CAST('0x' || substr(md5('mix-7|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 AS draw FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, size * CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM r
"""

OP9_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM n WINDOW w AS (PARTITION BY t)
"""


#: floor(s / n) in integers.
_FLOOR_MEAN = "(s - ((s % n) + n) % n) // n"
_WHOLE = "embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0"


def op11_sql(clusters: int = 8, rounds: int = 10) -> str:
    """Each round in a table of its own: distances of all vectors to all centroids, the nearest one, and the floors of the means."""
    steps = [
        f"""k AS MATERIALIZED (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings WHERE len(embedding) = 64 AND {_WHOLE})""",
        "e AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS p, unnest(v) AS x FROM k)",
        f"""c0 AS MATERIALIZED (SELECT CAST(r AS INTEGER) AS cluster, p, x FROM (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR))) - 1 AS r FROM k QUALIFY r < {clusters}) JOIN e USING (vec_id))""",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, min(ROW(distance, cluster)) AS best FROM (SELECT vec_id, cluster, CAST(sum((e.x - c.x) * (e.x - c.x)) AS BIGINT) AS distance FROM e JOIN c{r} c USING (p) GROUP BY ALL) GROUP BY vec_id)")
        if r < rounds:
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, c.p, coalesce({_FLOOR_MEAN}, c.x) AS x FROM c{r} c LEFT JOIN (SELECT best[2] AS cluster, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM e JOIN a{r} USING (vec_id) GROUP BY ALL) m ON m.cluster = c.cluster AND m.p = c.p)")
    steps.append(f"h AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)")
    steps.append(f"f AS (SELECT vec_id, best[2] AS cluster, best[1] AS distance FROM a{rounds})")
    return "WITH " + ", ".join(steps) + " SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM f JOIN h USING (cluster)"


def op13_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """As op11_sql, for every part position."""
    width = 64 // parts
    steps = [
        f"""k AS MATERIALIZED (SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings WHERE len(embedding) = 64 AND {_WHOLE})""",
        f"e AS MATERIALIZED (SELECT vec_id, part, j, v[part * {width} + j + 1] AS x FROM k, range({parts}) t(part), range({width}) u(j))",
        f"c0 AS MATERIALIZED (SELECT part, CAST(r AS INTEGER) AS entry, j, x FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM k QUALIFY r < {entries}) JOIN e USING (vec_id))",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, part, min(ROW(d, entry)) AS best FROM (SELECT vec_id, part, entry, CAST(sum((e.x - c.x) * (e.x - c.x)) AS BIGINT) AS d FROM e JOIN c{r} c USING (part, j) GROUP BY ALL) GROUP BY ALL)")
        if r < rounds:
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.j, coalesce({_FLOOR_MEAN}, c.x) AS x FROM c{r} c LEFT JOIN (SELECT part, best[2] AS entry, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM e JOIN a{r} USING (vec_id, part) GROUP BY ALL) m ON m.part = c.part AND m.entry = c.entry AND m.j = c.j)")
    steps.append(f"f AS (SELECT vec_id, string_agg(lpad(lower(to_hex(best[2])), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)")
    return "WITH " + ", ".join(steps) + f" SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, j)) FROM c{rounds}) AS codebooks_sha256 FROM f JOIN k USING (vec_id)"


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": OP1_SQL, "op6_mixing": OP6_SQL, "op9_exact_dedup": OP9_SQL, "op11_centroids": op11_sql(), "op13_vector_codes": op13_sql()}
