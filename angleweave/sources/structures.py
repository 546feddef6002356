"""Structure files as rows: text is read and cut by Spark, columns come from the file's own header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATOM_COLUMNS = "path string, grp string, atom string, alt string, resname string, chain string, resnum int, model int, x double, y double, z double, b double"


def _cif(batches):
    """Rows of the _atom_site loop; the loop ends at a blank line or a '#'."""
    import pyarrow as pa

    def number(kind, text):
        try:
            return kind(text)
        except (TypeError, ValueError):
            return None

    for batch in batches:
        out = []
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            names, inside = {}, False
            for line in (text or "").splitlines():
                if line.startswith("_atom_site."):
                    names[line.strip()[11:]] = len(names)
                    inside = True
                elif inside and names:
                    if not line.strip() or line[0] == "#":
                        break
                    v = line.split()
                    get = lambda k: v[names[k]] if k in names and names[k] < len(v) else None  # noqa: B023, E731
                    out.append((path, get("group_PDB"), (get("label_atom_id") or "").strip('"'), get("label_alt_id"), get("label_comp_id"), get("auth_asym_id") or get("label_asym_id"), number(int, get("auth_seq_id") or get("label_seq_id")), number(int, get("pdbx_PDB_model_num")) or 1, number(float, get("Cartn_x")), number(float, get("Cartn_y")), number(float, get("Cartn_z")), number(float, get("B_iso_or_equiv"))))
        names = ["path", "grp", "atom", "alt", "resname", "chain", "resnum", "model", "x", "y", "z", "b"]
        kinds = [pa.string()] * 6 + [pa.int32()] * 2 + [pa.float64()] * 4
        columns = list(zip(*out)) if out else [()] * 12
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def read_cif(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of mmCIF files (.gz too), one file a record."""
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return text.select(F.input_file_name().alias("path"), "value").mapInArrow(_cif, ATOM_COLUMNS)


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """Fixed columns of PDB files; the model number is that of the last MODEL record before."""
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", "\n").alias("lines"))
    models = F.filter(F.transform("lines", lambda x, i: F.when(x.startswith("MODEL"), i)), lambda x: x.isNotNull())
    rows = text.withColumn("at", models).select("path", "at", F.posexplode("lines").alias("k", "line")).where("line like 'ATOM%' or line like 'HETATM%'")
    cut = lambda a, n: F.trim(F.substring("line", a, n))
    num = lambda a, n: cut(a, n).try_cast("double")
    return rows.select("path", cut(1, 6).alias("grp"), cut(13, 4).alias("atom"), F.coalesce(F.nullif(cut(17, 1), F.lit("")), F.lit(".")).alias("alt"), cut(18, 3).alias("resname"), cut(22, 1).alias("chain"), cut(23, 4).try_cast("int").alias("resnum"), F.greatest(F.size(F.filter("at", lambda m: m < F.col("k"))), F.lit(1)).alias("model"), num(31, 8).alias("x"), num(39, 8).alias("y"), num(47, 8).alias("z"), num(61, 6).alias("b"))


def backbone(atoms: DataFrame, chain: str | None = None) -> DataFrame:
    """Residues with N, CA and C of the first model, altloc '.', 'A' or '?'; first atom seen wins. chain None keeps all; "longest" (S04) the longest."""
    rows = atoms.where(F.col("grp") == "ATOM").where(F.col("atom").isin("N", "CA", "C") & F.col("alt").isin(".", "A", "?") & (F.col("model") == 1) & F.col("x").isNotNull())
    if chain not in (None, "longest"):
        rows = rows.where(F.col("chain") == chain)
    pick = lambda a, c: F.first(F.when(F.col("atom") == a, F.col(c)), ignorenulls=True)
    out = rows.groupBy("path", "chain", "resnum").agg(F.first("resname").alias("resname"), F.first("b").alias("plddt"), *[pick(a, d).alias(a.lower() + d) for a in ("N", "CA", "C") for d in "xyz"])
    out = out.where("nx is not null and cax is not null and cx is not null")
    if chain == "longest":
        best = out.groupBy("path", "chain").count().groupBy("path").agg(F.max_by("chain", F.struct("count", "chain")).alias("chain"))
        out = out.join(best, ["path", "chain"])
    return out.withColumn("chain_id", F.concat_ws("|", "path", "chain")).withColumn("pos", F.col("resnum"))


def discover(spark: SparkSession, path: str, most_bytes: int = 5_000_000, least_bytes: int = 100, least_age: float = 0.0) -> DataFrame:
    """Files by organism folder, from metadata alone: path, modificationTime, length, organism. Files outside the size limits, or changed less than
    least_age seconds ago, are left out; files right in the folder are of "unknown"; of a file and its .gz the plain one counts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    files = files.where(F.col("path").rlike(r"\.cif(\.gz)?$") & F.col("length").between(least_bytes, most_bytes))
    if least_age > 0:
        files = files.where(F.unix_millis("modificationTime") <= F.unix_millis(F.current_timestamp()) - F.lit(int(least_age * 1000)))
    root = path.rstrip("/").rsplit("/", 1)[-1]
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    plain = F.regexp_replace("path", r"\.gz$", "")
    one = files.groupBy(plain.alias("__plain")).agg(F.min_by(F.struct("path", "modificationTime", "length"), F.length("path")).alias("f")).select("f.*")
    return one.withColumn("organism", F.when(folder == root, "unknown").otherwise(folder))
