"""Fixed vectors and properties of the engine's operators, and every query that has SQL on the smallest tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from angleweave.functions import angles, basins, potential
from angleweave.operators import chains, kinematics, loops, nulls, stats
from angleweave.sources import structures
from angleweave.streaming import watch
from tests import compare

DIR = "/root/testdata/sf0.001"


def chain(spark, pairs, chain_id=1):
    rows = [(chain_id, "ecoli", k + 1, 80.0, "ALA", float(np.radians(p)), float(np.radians(s))) for k, (p, s) in enumerate(pairs)]
    return spark.createDataFrame(rows, "chain_id bigint, organism string, pos int, plddt double, resname string, phi double, psi double")


def test_landscape():
    w = potential.build()
    assert w.max() <= 0 and abs(w.min() + 1.2897) < 1e-3 and np.unravel_index(w.argmin(), w.shape) == (117, 137)
    assert w[117, 137] < w[60, 310] and w[117, 137] < w[180, 180]


def test_narrow_basins(spark):
    pairs = [(-63, -43), (-120, 130), (-120, -170), (-120, -130), (-75, 150), (-85, 140), (57, 47), (0, 0), (-90, 0)]
    rows = chain(spark, pairs).select("pos", basins.basin(F.col("phi"), F.col("psi"), "narrow").alias("b")).orderBy("pos").collect()
    assert [r.b for r in rows] == ["alpha", "beta", "beta", "beta", "ppII", "ppII", "alphaL", "other", "other"]


def test_total_variation(spark):
    df = chain(spark, [(0, 0)] * 5).withColumn("w", F.get(F.array(*map(F.lit, [0.0, 0.5, 0.3, 0.8, 0.1])), F.col("pos") - 1))
    r = chains.roughness(chains.stepped(df)).first()
    assert r.bps == pytest.approx(1.9) and r.bps_norm == pytest.approx(0.38)


def test_runs(spark):
    df = chain(spark, [(0, 0)] * 9).withColumn("basin", F.get(F.split(F.lit("aaabbboaa"), ""), F.col("pos") - 1))
    assert [(r.start - 1, r.end - 1, r.label) for r in chains.segments(df).orderBy("seg").collect()] == [(0, 2, "a"), (3, 5, "b"), (6, 6, "o"), (7, 8, "a")]


def test_text_parsing(spark):
    df = spark.createDataFrame([("AF-P12345-F1-model_v4.cif", "~4.4K")], "f string, c string")
    uid, version = angles.structure_file(F.col("f"))
    assert tuple(df.select(uid, version, angles.count_label(F.col("c"))).first()) == ("P12345", 4, 4400)


def test_shuffles_keep_pairs_and_ignore_partitions(spark):
    df = chain(spark, [(k, -k) for k in range(30)]).withColumn("basin", F.when(F.col("pos") < 12, "alpha").otherwise("beta"))
    for f in (nulls.shuffled, nulls.segment_shuffled):
        one = sorted(map(tuple, f(df).select("pos", "phi", "psi").collect()))
        assert one == sorted(map(tuple, f(df.repartition(5)).select("pos", "phi", "psi").collect()))
        assert sorted(r[1] for r in one) == sorted(r.phi for r in df.collect())


def test_geometry_round_trip(spark):
    pairs = [(-63, -43)] * 6 + [(-80, 60)] * 2 + [(-120, 130)] * 4
    back = kinematics.angles(kinematics.reconstructed(chain(spark, pairs))).orderBy("pos").collect()
    for r, (p, s) in zip(back[1:-1], pairs[1:-1]):
        assert np.degrees(r.phi) == pytest.approx(p, abs=1e-6) and np.degrees(r.psi) == pytest.approx(s, abs=1e-6)
    x = kinematics.build(*np.radians(np.array(pairs, float)).T).reshape(-1, 3)
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(3, 3)))[0]
    q *= np.sign(np.linalg.det(q))
    assert kinematics.superposed_rmsd(x, x @ q + 5) < 1e-6


def test_kinks_and_loops(spark):
    df = chain(spark, [(-63, -43)] * 5 + [(60, 60)] * 4 + [(-120, 130)] * 5).withColumn("basin", basins.basin(F.col("phi"), F.col("psi")))
    df = potential.with_nearest(df, potential.grid_table(spark, potential.build()))
    assert chains.kinks(chains.stepped(df)).first().n_kinks >= 1
    r = loops.extract(df).first()
    assert (r.start, r.end, r.direction, r.length, r.residues, r.path_len) == (6, 9, "alpha->beta", 4, "AAAA", 0.0)


def test_p_values():
    assert stats.t_p_value(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert stats.f_p_value(4.0, 3, 20) == pytest.approx(0.0222, abs=1e-3)
    assert stats.normal_p_value(1.959964) == pytest.approx(0.05, abs=1e-6)


def test_structure_files(spark, tmp_path):
    head = ["group_PDB", "label_atom_id", "label_alt_id", "label_comp_id", "auth_asym_id", "auth_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "B_iso_or_equiv", "pdbx_PDB_model_num"]
    x = kinematics.build(np.radians([-63.0] * 4), np.radians([-43.0] * 4))
    lines = [f"ATOM {a} . ALA A {i + 1} {x[i, k, 0]} {x[i, k, 1]} {x[i, k, 2]} 90 1" for i in range(4) for k, a in enumerate(("N", "CA", "C"))]
    (tmp_path / "ecoli").mkdir()
    (tmp_path / "ecoli" / "AF-P1-F1-model_v4.cif").write_text("data_x\nloop_\n" + "".join(f"_atom_site.{h}\n" for h in head) + "\n".join(lines + ["ATOM CA . ALA A 9 bad 0 0 1 1", "HETATM N . HOH A 10 0 0 0 1 1"]) + "\n#\n")
    res = structures.backbone(structures.read_cif(spark, str(tmp_path)))
    assert res.count() == 4
    back = kinematics.angles(res).orderBy("pos").collect()
    assert back[0].phi is None and np.degrees(back[1].phi) == pytest.approx(-63)
    assert structures.discover(spark, str(tmp_path)).first().organism == "ecoli"
    pdb = [f"ATOM  {1:5d}  {a:<3s} ALA A{i + 1:4d}    {x[i, k, 0]:8.3f}{x[i, k, 1]:8.3f}{x[i, k, 2]:8.3f}  1.00 90.00" for i in range(4) for k, a in enumerate(("N", "CA", "C"))]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.pdb").write_text("\n".join(pdb) + "\n")
    assert structures.backbone(structures.read_pdb(spark, str(tmp_path / "p")), "longest").count() == 4


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(k % 4, "o", float(k)) for k in range(20)], "chain_id int, organism string, bps_norm double")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = watch.new_rows(spark, str(tmp_path / "in"), rows.schema, 1)
    sink = watch.upsert(str(tmp_path / "out"))
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    out = watch.latest(spark, str(tmp_path / "out"), ["chain_id"], "bps_norm")
    assert sorted((r.chain_id, r.bps_norm) for r in out.collect()) == [(k, 16.0 + k) for k in range(4)]
    # A batch that is told again changes nothing; what was done is not new; the summary follows the rows.
    sink(spark.read.parquet(str(tmp_path / "in")).limit(0), 99)
    assert watch.unseen(rows, out, "chain_id").count() == 0 and watch.unseen(rows, out.where("chain_id > 0"), "chain_id").count() == 5
    assert watch.running_summary(out).first().mean == 17.5


@pytest.mark.parametrize("name", ["c01_wide_basins", "n08_segments", "n10_loops", "m01_shuffle", "g18_organism_spread", "g05_length_regression"])
def test_sql(spark, name):
    from angleweave.plans import catalogue

    assert compare.differences(spark, compare.views(DIR), catalogue.queries()[name], catalogue.oracle_sql()[name], DIR) == ""
