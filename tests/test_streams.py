"""Streams of chain metrics and of arriving files against their batch counterparts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from angleweave.functions import basins
from angleweave.operators import chains
from angleweave.streaming import chain_metrics as M

SCHEMA = "chain_id bigint, organism string, ts timestamp, tie bigint, phi double, psi double, w double, basin string"
START = datetime.datetime(2024, 1, 1)


def residues(chains_, seed=1):
    """Chains one after the other in time, a residue a second, an hour between chains."""
    rng = random.Random(seed)
    rows = []
    for c in range(chains_):
        for k in range(rng.randint(2, 40)):
            at = START + datetime.timedelta(hours=c, seconds=k // 2)  # two residues share a second; tie orders them
            rows.append((c, f"o{c % 3}", at, k, rng.uniform(-3, 3), None if rng.random() < 0.05 else rng.uniform(-3, 3), rng.uniform(-1, 0), rng.choice(["alpha", "beta", "other"])))
    return rows


def write(spark, rows, path, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def marker(hours):
    return (None, "end", START + datetime.timedelta(hours=hours), 0, 0.0, 0.0, 0.0, "other")


def batch(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).where("chain_id is not null").withColumn("pos", F.expr("row_number() over (partition by chain_id order by ts, tie)"))
    rough = chains.roughness(chains.stepped(df)).join(chains.helix_sheet_transitions(df), "chain_id", "left").fillna(0, ["n_transitions"])
    return {r.chain_id: (r.organism, r.length, r.bps, r.bps_norm, r.mean_dw, r.torus_l1, r.torus_l2, r.q_phi, r.q_psi, r.n_transitions) for r in rough.collect()}


def streamed(spark, d, delay, gap=600):
    stream = M.chain_stream(M.event_stream(spark, f"{d}/in", spark.createDataFrame([], SCHEMA).schema, 1), delay, gap)
    return M.run_until_now(stream, f"{d}/out", f"{d}/checkpoint")


def rows_of(spark, d):
    return spark.read.schema(M.METRICS).parquet(f"{d}/out").where("chain_id is not null").collect()


def same(found, want):
    assert found.keys() == want.keys()
    for c, w in want.items():
        assert found[c][0] == w[0] and found[c][1:] == pytest.approx(w[1:], rel=1e-9, abs=1e-9), c


def values(r):
    return (r.organism, r.length, r.bps, r.bps_norm, r.mean_dw, r.torus_l1, r.torus_l2, r.q_phi, r.q_psi, r.n_transitions)


def test_shuffled_files_equal_the_batch_over_restarts(spark, tmp_path):
    """Residues of all chains shuffled over files, in two runs on one checkpoint; nothing comes twice."""
    d, rows = str(tmp_path), residues(12)
    mixed = rows[:]
    random.Random(2).shuffle(mixed)
    for k in range(3):
        write(spark, mixed[k::6], f"{d}/in", k)
    streamed(spark, d, "100 hours")
    assert rows_of(spark, d) == []
    for k in range(3, 6):
        write(spark, mixed[k::6], f"{d}/in", k)
    streamed(spark, d, "100 hours")
    write(spark, [marker(300)], f"{d}/in", 9)
    streamed(spark, d, "100 hours")
    found = rows_of(spark, d)
    assert len(found) == 12
    same({r.chain_id: values(r) for r in found}, batch(spark, rows))
    streamed(spark, d, "100 hours")
    assert len(rows_of(spark, d)) == 12


def test_chains_leave_as_the_watermark_passes_and_late_rows_are_dropped(spark, tmp_path):
    d, rows = str(tmp_path), residues(6, 3)
    for c in range(6):
        write(spark, [r for r in rows if r[0] == c], f"{d}/in", c)
        streamed(spark, d, "10 minutes")
        # The chain an hour before is out, its state gone.
        assert sorted(r.chain_id for r in rows_of(spark, d)) == list(range(c))
    late = (0, "o0", START, 99, 0.0, 0.0, 0.0, "alpha")
    again = (0, "o0", START + datetime.timedelta(hours=5, minutes=2), 1, 0.0, 0.0, 0.0, "alpha")
    write(spark, [late], f"{d}/in", 7)
    assert streamed(spark, d, "10 minutes")["late"] == 1
    write(spark, [again], f"{d}/in", 8)
    assert streamed(spark, d, "10 minutes")["late"] == 0
    write(spark, [marker(50)], f"{d}/in", 9)
    assert streamed(spark, d, "10 minutes")["kept"] <= 2
    found = rows_of(spark, d)
    assert sorted(r.chain_id for r in found) == [0, 0, 1, 2, 3, 4, 5]
    runs = sorted((r for r in found if r.chain_id == 0), key=lambda r: r.length)
    assert runs[0].length == 1 and runs[0].first_at == again[2]
    same({r.chain_id: values(r) for r in found if r is not runs[0]}, batch(spark, rows))
