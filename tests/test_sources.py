"""Structure files through the data source, and folders that are watched."""

import gzip
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from angleweave.functions.geometry import build
from angleweave.operators import kinematics
from angleweave.sources import reader, structures
from angleweave.streaming import arrivals

HEAD = ["group_PDB", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "label_seq_id", "auth_asym_id", "auth_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "B_iso_or_equiv", "pdbx_PDB_model_num"]


def atoms(n, seed=0):
    rng = np.random.default_rng(seed)
    return build(rng.uniform(-3, 3, n), rng.uniform(-3, 3, n))


def cif(chains, method="X-RAY DIFFRACTION", resolution=1.8, extra=(), head=HEAD):
    """chains: (label chain, auth chain, first auth number, coordinates, model, residue names)."""
    lines = ["data_x", f"_exptl.method '{method}'", f"_refine.ls_d_res_high {resolution}", "loop_", *(f"_atom_site.{h}" for h in head)]
    for label, auth, first, x, model, names in chains:
        for i in range(len(x)):
            for k, a in enumerate(("N", "CA", "C")):
                lines.append(f"ATOM {a} . {names[i % len(names)]} {label} {i + 1} {auth} {first + i} {x[i, k, 0]:.6f} {x[i, k, 1]:.6f} {x[i, k, 2]:.6f} {90 - i} {model}")
    return "\n".join([*lines, *extra, "#", "ATOM CA . ALA A 99 A 99 0 0 0 1 1"]) + "\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("structures")
    (d / "ecoli").mkdir()
    (d / "human").mkdir()
    two = [("A", "X", 11, atoms(6, 1), 1, ["ALA", "GLY"]), ("B", "Y", 101, atoms(9, 2), 1, ["SER"]), ("A", "X", 11, atoms(6, 3), 2, ["ALA"])]
    (d / "ecoli" / "two.cif").write_text(cif(two, extra=["HETATM N . HOH A 7 X 17 0 0 0 1 1", "ATOM CA B ALA A 1 X 11 9 9 9 1 1", "ATOM CA . ALA A 8 X 18 bad 0 0 1 1", "ATOM CA . LIG A 9 X 19 1 1 1 5 1"]))
    with gzip.open(d / "human" / "one.cif.gz", "wt") as f:
        f.write(cif([("A", "A", 1, atoms(5, 4), 1, ["MSE", "UNK"])], method="solution nmr", resolution="."))
    x = np.concatenate([atoms(4, 5), atoms(4, 6) + 50])
    rows = [f"ATOM  {1:5d}  {a:<3s} ALA C{i + 1:4d}    {x[i, k, 0]:8.3f}{x[i, k, 1]:8.3f}{x[i, k, 2]:8.3f}  1.00{80.0:6.2f}" for i in range(8) for k, a in enumerate(("N", "CA", "C"))]
    (d / "human" / "gap.pdb").write_text("\n".join(["EXPDTA    X-RAY DIFFRACTION", "REMARK   2 RESOLUTION.    2.10 ANGSTROMS.", "MODEL        1", *rows, "ENDMDL", "MODEL        2", *rows, "ENDMDL"]) + "\n")
    (d / "human" / "_hidden.cif").write_text("x")
    return str(d)


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    reader.register(spark)


def load(spark, path, **options):
    return spark.read.format("structures").options(**options).load(path)


def test_equals_the_text_reader(spark, folder):
    names = ["chain", "resnum", "resname", "plddt", *reader.AXES]
    mine = load(spark, folder).where(F.col("path").endswith(".cif") | F.col("path").endswith(".gz")).select(*names)
    both = structures.backbone(structures.read_cif(spark, f"{folder}/ecoli").unionByName(structures.read_cif(spark, f"{folder}/human"))).where("path like '%.cif%'").select(*names)
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, both.collect())) and mine.count() == 20


def test_options(spark, folder):
    ecoli = f"{folder}/ecoli"
    count = lambda **o: sorted(map(tuple, load(spark, ecoli, **o).groupBy("chain").agg(F.count(F.lit(1)), F.min("resnum"), F.max("resnum")).collect()))
    assert count() == [("X", 6, 11, 16), ("Y", 9, 101, 109)]
    assert count(seqId="label") == [("X", 6, 1, 6), ("Y", 9, 1, 9)]
    assert count(chain="Y") == [("Y", 9, 101, 109)] and count(chain="longest") == [("Y", 9, 101, 109)] and count(chain="first") == [("X", 6, 11, 16)]
    assert count(chain="Z") == []
    # Chain-agnostic: numbers meet across chains; the later place counts, the first B stays.
    merged = load(spark, ecoli, chain="merged", seqId="label").orderBy("resnum").collect()
    assert [r.resnum for r in merged] == [*range(1, 10)] and merged[0].nx == pytest.approx(atoms(9, 2)[0, 0, 0], abs=1e-5) and merged[0].resname == "ALA" and merged[0].plddt == 90
    assert load(spark, ecoli, model=2).first().nx == pytest.approx(atoms(6, 3)[0, 0, 0], abs=1e-5) and load(spark, ecoli, model=2).count() == 6
    human = load(spark, f"{folder}/human", tabulated="true", chain="A").collect()
    assert [r.resname for r in human] == ["MSE"] * 3 and human[0].method == "SOLUTION NMR" and human[0].resolution is None
    assert {(r.resolution, r.method) for r in load(spark, ecoli).collect()} == {(1.8, "X-RAY DIFFRACTION")}
    with pytest.raises(Exception, match="chain 'Z' is not in"):
        load(spark, ecoli, chain="Z", missing="error").collect()
    assert load(spark, folder, leastBytes=1 << 30).count() == 0 and load(spark, folder, minAge=3600).count() == 0 and load(spark, f"{folder}/none").count() == 0


def test_segments_end_at_broken_bonds(spark, folder):
    rows = load(spark, f"{folder}/human/gap.pdb")
    assert [(r.seg, r.resnum) for r in rows.orderBy("resnum").collect()] == [(0, k) for k in range(1, 5)] + [(1, k) for k in range(5, 9)]
    assert rows.first().resolution == 2.1
    angles = kinematics.angles(reader.by_segment(rows)).orderBy("resnum").collect()
    assert [r.resnum for r in angles if r.phi is None] == [1, 5] and [r.resnum for r in angles if r.psi is None] == [4, 8]


def test_filters_reach_the_reader(spark, folder):
    rows = load(spark, folder).where((F.col("chain") == "X") & F.col("path").endswith("two.cif") & (F.col("resnum") > 12))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    left = next(line for line in plan.splitlines() if "Filter" in line)
    assert "resnum" in left and "path#" not in left and "chain#" not in left
    assert rows.count() == 4
    r = reader.StructureReader({"path": folder})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

    rest = [GreaterThan(("resnum",), 3)]
    assert list(r.pushFilters([StringContains(("path",), "human"), In(("chain",), ("A", "C")), *rest])) == rest
    assert [os.path.basename(f.path) for f in sorted(r.files(), key=lambda f: f.path)] == ["gap.pdb", "one.cif.gz"]
    r.pushFilters([])
    small = reader.StructureReader({"path": folder, "partitionBytes": "10"})
    assert [len(p.files) for p in small.partitions()] == [1, 1, 1]
    assert list(reader.StructureReader({"path": folder}).pushFilters([EqualTo(("path",), "x")])) == []


def aged(path, seconds):
    at = time.time() - seconds
    os.utime(path, (at, at))


def test_half_written_files_wait_and_ids_come_once(spark, tmp_path):
    """A file that still changes is read when it is complete; an id that is done or failed is not computed again."""
    d, org = tmp_path / "in", tmp_path / "in" / "ecoli"
    org.mkdir(parents=True)

    def put(name, text, age):
        (org / name).write_text(text)
        aged(org / name, age)

    def run():
        q = arrivals.watch(spark, str(d), str(tmp_path / "out"), str(tmp_path / "cp"), min_age=60)
        q.awaitTermination()

    def told(kind):
        path = tmp_path / "out" / kind
        return sorted((r.uniprot_id, r.version) for r in spark.read.parquet(str(path)).collect()) if path.exists() else []

    good = cif([("A", "A", 1, atoms(12, 7), 1, ["ALA"])])
    put("AF-P1-F1-model_v4.cif", good, 500)
    put("AF-P2-F1-model_v4.cif", good[: len(good) // 3], 0)
    put("AF-P3-F1-model_v4.cif", "data_x\n" + "# nothing here\n" * 20, 400)
    run()
    assert told("done") == [("P1", 4)] and told("failed") == [("P3", 4)]
    put("AF-P2-F1-model_v4.cif", good, 90)
    put("AF-P1-F1-model_v5.cif", good, 80)
    put("AF-P3-F1-model_v5.cif", good, 80)
    put("AF-P4-F1-model_v3.cif", good, 79)
    put("AF-P4-F1-model_v4.cif", good, 78)
    run()
    run()
    assert told("done") == [("P1", 4), ("P2", 4), ("P4", 4)] and told("failed") == [("P3", 4)]
    rows = {r.uniprot_id: r for r in spark.read.parquet(str(tmp_path / "out" / "done")).collect()}
    assert rows["P2"].residues == 12 and rows["P2"].length == 10 and rows["P2"].bps_norm == pytest.approx(rows["P1"].bps_norm) and rows["P1"].organism == "ecoli"


def test_a_batch_that_is_told_again_counts_once(spark, tmp_path):
    write = arrivals.processed(str(tmp_path))
    files = spark.createDataFrame([("/x/ecoli/AF-P1-F1-model_v4.cif", cif([("A", "A", 1, atoms(8, 8), 1, ["ALA"])])), ("/x/ecoli/AF-P2-F1-model_v4.cif", "")], "path string, text string")
    write(files, 3)
    write(files, 3)
    write(files, 4)
    assert spark.read.parquet(f"{tmp_path}/done").count() == 1 and spark.read.parquet(f"{tmp_path}/failed").count() == 1
