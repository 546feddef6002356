"""Structure files as Spark data sources: residues by options in batch, arriving files by age in streams.

    register(spark)
    spark.read.format("structures").option("chain", "A").option("seqId", "auth").load("/data/pdb")
    spark.readStream.format("arriving_files").option("minAge", 3).load("/data/incoming")

Files are listed and read through pyarrow's file systems (local paths and the URIs it knows). For stores that Spark alone can read,
structures.read_cif goes through Spark's own text reader.
"""

from __future__ import annotations

import gzip
import io
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith

from ..operators.families import RESIDUES as STANDARD

AXES = [a + d for a in ("n", "ca", "c") for d in "xyz"]
RESIDUE_ROWS = "path string, chain string, resnum int, resname string, seg int, plddt double, " + ", ".join(f"{c} double" for c in AXES) + ", resolution double, method string"
FILE_ROWS = "path string, modified timestamp, length bigint, text string"
#: The farthest C and N of one peptide bond (Angstrom); modified residues that count as amino acids beside the standard ones.
BOND = 1.8
MODIFIED = ("MSE", "SEC", "PYL", "HYP", "SEP", "TPO", "PTR", "CSO", "CME", "MLY", "KCX", "PCA", "CSD", "OCS", "LLP")


@dataclass
class Atom:
    model: str
    label_chain: str | None
    auth_chain: str | None
    label_num: int | None
    auth_num: int | None
    resname: str | None
    name: str
    place: tuple[float, float, float]
    b: float | None


class Header(dict):
    """resolution and method, as far as the text told."""


def _number(kind, text):
    try:
        return kind(text)
    except (TypeError, ValueError):
        return None


def cif_atoms(lines, header: Header) -> Iterator[Atom]:
    """Backbone atoms of the first _atom_site loop, alternate locations '.', 'A', '?' or blank. Lines without their numbers are left out."""
    at: dict[str, int] = {}
    for line in lines:
        if line.startswith("_atom_site."):
            at[line.strip()[11:].strip()] = len(at)
        elif line.startswith("_refine.ls_d_res_high") and header.get("resolution") is None:
            header["resolution"] = _number(float, (line.split() + [None])[1])
        elif line.startswith("_exptl.method") and len(x := line.split(None, 1)) == 2 and x[0] == "_exptl.method":
            header["method"] = x[1].strip().strip("'\"").upper()
        elif at:
            if not line.startswith(("ATOM", "HETATM")):
                if line.strip() in ("", "#"):
                    return
                continue
            v = line.split()
            get = lambda k: v[at[k]] if k in at and at[k] < len(v) else None  # noqa: B023, E731
            name = (get("label_atom_id") or "").strip('"')
            if get("group_PDB") != "ATOM" or name not in ("N", "CA", "C") or (get("label_alt_id") or ".") not in (".", "A", "?", " "):
                continue
            place = tuple(_number(float, get(f"Cartn_{d}")) for d in "xyz")
            if None not in place:
                yield Atom(get("pdbx_PDB_model_num") or "1", get("label_asym_id"), get("auth_asym_id"), _number(int, get("label_seq_id")), _number(int, get("auth_seq_id")), get("label_comp_id"), name, place, _number(float, get("B_iso_or_equiv")))


def pdb_atoms(lines, header: Header) -> Iterator[Atom]:
    """The same from the fixed columns of a PDB file."""
    model = "1"
    for line in lines:
        kind = line[:6].strip()
        if kind == "MODEL":
            model = line[6:].strip() or model
        elif kind == "EXPDTA":
            header["method"] = line[10:].strip().upper()
        elif line.startswith("REMARK   2 RESOLUTION.") and header.get("resolution") is None:
            header["resolution"] = _number(float, (line[22:].split() + [None])[0])
        elif kind == "ATOM" and (name := line[12:16].strip()) in ("N", "CA", "C") and line[16:17] in (" ", ".", "A", "?"):
            place = tuple(_number(float, line[a : a + 8]) for a in (30, 38, 46))
            number, chain = _number(int, line[22:26]), line[21:22].strip()
            if None not in place:
                yield Atom(model, chain, chain, number, number, line[17:20].strip(), name, place, _number(float, line[60:66]))


@dataclass
class Choice:
    """What is taken from a file.

    chain: "all", an id, "first", "longest" (most residues, then the greatest id), or "merged": residues are keyed by number alone,
    as if the file were one chain named "". seq_id: "label" or "auth"; the other one counts where a file lacks it.
    model: "first" or a number. tabulated: amino acids only. missing: "skip" or "error" when a named chain is not there.
    """

    chain: str = "all"
    seq_id: str = "auth"
    model: str = "first"
    tabulated: bool = False
    missing: str = "skip"

    @classmethod
    def of(cls, options) -> Choice:
        o = {k.lower(): v for k, v in options.items()}
        return cls(o.get("chain", "all"), o.get("seqid", "auth"), str(o.get("model", "first")), str(o.get("tabulated", "false")).lower() == "true", o.get("missing", "skip"))


def residues(path: str, text, choice: Choice) -> list[tuple]:
    """RESIDUE_ROWS of one file. Of an atom that comes again the last place counts, of a residue the first atom's B. seg grows where a bond is broken."""
    header, found, models, seen = Header(), {}, None, set()
    lines = text.splitlines() if isinstance(text, str) else text
    atoms = (pdb_atoms if path.removesuffix(".gz").endswith((".pdb", ".ent")) else cif_atoms)(lines, header)
    for a in atoms:
        models = models or (a.model if choice.model == "first" else choice.model)
        if a.model != models:
            continue
        chain = a.auth_chain or a.label_chain or ""
        seen.add(chain)
        if choice.chain == "merged":
            chain = ""
        elif choice.chain not in ("all", "longest", "first") and chain != choice.chain:
            continue
        elif choice.chain == "first" and found and chain not in found:
            continue
        number = a.label_num if choice.seq_id == "label" else a.auth_num
        if number is None and choice.seq_id != "label":
            number = a.label_num
        if number is None:
            continue
        r = found.setdefault(chain, {}).setdefault(number, {"resname": a.resname, "b": a.b})
        r[a.name] = a.place
    if choice.missing == "error" and choice.chain not in ("all", "longest", "first", "merged") and choice.chain not in seen:
        raise ValueError(f"chain {choice.chain!r} is not in {path}, which has {sorted(seen)}")
    whole = {c: {n: r for n, r in rs.items() if all(k in r for k in ("N", "CA", "C")) and (not choice.tabulated or r["resname"] in STANDARD or r["resname"] in MODIFIED)} for c, rs in found.items()}
    if choice.chain == "longest" and whole:
        best = max(whole, key=lambda c: (len(whole[c]), c))
        whole = {best: whole[best]}
    out = []
    for chain in sorted(whole):
        seg, last = 0, None
        for n in sorted(whole[chain]):
            r = whole[chain][n]
            if last is not None and sum((p - q) ** 2 for p, q in zip(last, r["N"])) > BOND * BOND:
                seg += 1
            last = r["C"]
            out.append((path, chain, n, r["resname"], seg, r["b"], *r["N"], *r["CA"], *r["C"], header.get("resolution"), header.get("method")))
    return out


def residues_of(files: DataFrame, **options) -> DataFrame:
    """RESIDUE_ROWS of a table of path and text."""
    choice = Choice.of(options)

    def run(batches):
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield _batch(residues(path, text or "", choice))

    return files.select("path", "text").mapInArrow(run, RESIDUE_ROWS)


def _batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), *[pa.float64()] * (len(AXES) + 2), pa.string()]
    names = [f.split()[0] for f in RESIDUE_ROWS.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


@dataclass(frozen=True, order=True)
class File:
    modified_ns: int
    path: str
    length: int


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str, suffixes: tuple[str, ...] = (".cif", ".cif.gz", ".pdb", ".pdb.gz", ".ent", ".ent.gz"), least: int = 0, most: int = 1 << 62) -> list[File]:
    """The files of a folder and all below it, or one file, in order of change; hidden and temporary names are left out."""
    from pyarrow import fs

    system, at = _system(path)
    info = system.get_file_info(at)
    every = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return sorted(File(f.mtime_ns, f.path, f.size) for f in every if f.type == fs.FileType.File and f.path.endswith(suffixes) and not f.base_name.startswith((".", "_")) and least <= f.size <= most)


def opened(root: str, path: str):
    """A file's text lines; .gz is unpacked."""
    raw = _system(root)[0].open_input_stream(path, compression=None)
    return io.TextIOWrapper(gzip.open(raw) if path.endswith(".gz") else raw, errors="replace")


@dataclass
class Files(InputPartition):
    files: tuple[File, ...]


def by_bytes(files: list[File], most: int) -> list[Files]:
    """Consecutive files up to so many bytes; a larger file has a partition of its own."""
    out, some, size = [], [], 0
    for f in files:
        if some and size + f.length > most:
            out.append(Files(tuple(some)))
            some, size = [], 0
        some.append(f)
        size += f.length
    return out + ([Files(tuple(some))] if some else [])


class StructureReader(DataSourceReader):
    def __init__(self, options):
        o = {k.lower(): v for k, v in options.items()}
        self.root, self.choice = o["path"], Choice.of(options)
        self.least, self.most = int(o.get("leastbytes", 0)), int(o.get("mostbytes", 1 << 62))
        self.min_age, self.partition_bytes = float(o.get("minage", 0)), int(o.get("partitionbytes", 64 << 20))
        self.on_path: list = []
        self.on_chain: list = []

    def pushFilters(self, filters):
        """Equality, membership and parts of the path choose files before they are opened; equality and membership of the chain, rows before they are sent."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("path",) and isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)):
                self.on_path.append(f)
            elif column == ("chain",) and isinstance(f, (EqualTo, In)):
                self.on_chain.append(f)
            elif isinstance(f, IsNotNull) and column in (("path",), ("chain",), ("resnum",)):
                continue  # they never are
            else:
                yield f

    @staticmethod
    def _holds(f, value: str) -> bool:
        if isinstance(f, In):
            return value in f.value
        return {EqualTo: value.__eq__, StringStartsWith: value.startswith, StringEndsWith: value.endswith, StringContains: value.__contains__}[type(f)](f.value)

    def files(self) -> list[File]:
        before = time.time_ns() - int(self.min_age * 1e9)
        return [f for f in listed(self.root, least=self.least, most=self.most) if (not self.min_age or f.modified_ns <= before) and all(self._holds(p, f.path) for p in self.on_path)]

    def partitions(self):
        return by_bytes(self.files(), self.partition_bytes) or [Files(())]

    def read(self, partition):
        for f in partition.files:
            with opened(self.root, f.path) as lines:
                rows = residues(f.path, lines, self.choice)
            yield _batch([r for r in rows if all(self._holds(p, r[1]) for p in self.on_chain)])


class StructureSource(DataSource):
    """Residues with N, CA and C, a row each (RESIDUE_ROWS). Options: those of Choice, leastBytes, mostBytes, minAge (seconds), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "structures"

    def schema(self) -> str:
        return RESIDUE_ROWS

    def reader(self, schema) -> StructureReader:
        return StructureReader(dict(self.options))


class ArrivalReader(DataSourceStreamReader):
    """Offsets are the last file's time of change and path. A file is offered once it has not changed for minAge seconds, so one that is still being
    written waits; one that changes later comes again as a new file. Files that arrive with a time of change before the offset are not seen."""

    def __init__(self, options):
        o = {k.lower(): v for k, v in options.items()}
        self.root, self.min_age, self.partition_bytes = o["path"], float(o.get("minage", 3)), int(o.get("partitionbytes", 64 << 20))
        self.least, self.most = int(o.get("leastbytes", 100)), int(o.get("mostbytes", 1 << 62))
        self.last = (-1, "")

    def initialOffset(self) -> dict:
        return {"modified_ns": -1, "path": ""}

    def latestOffset(self) -> dict:
        before = time.time_ns() - int(self.min_age * 1e9)
        ready = [(f.modified_ns, f.path) for f in listed(self.root, least=self.least, most=self.most) if f.modified_ns <= before]
        self.last = max([self.last, *ready[-1:]])
        return {"modified_ns": self.last[0], "path": self.last[1]}

    def partitions(self, start: dict, end: dict):
        a, b = (start["modified_ns"], start["path"]), (end["modified_ns"], end["path"])
        return by_bytes([f for f in listed(self.root, least=self.least, most=self.most) if a < (f.modified_ns, f.path) <= b], self.partition_bytes)

    def read(self, partition):
        import datetime

        for f in partition.files:
            with opened(self.root, f.path) as lines:
                yield f.path, datetime.datetime.fromtimestamp(f.modified_ns / 1e9, datetime.timezone.utc), f.length, lines.read()

    def commit(self, end: dict) -> None:
        pass


class ArrivalSource(DataSource):
    """Text files as they arrive (FILE_ROWS). Options: minAge (seconds), leastBytes, mostBytes, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "arriving_files"

    def schema(self) -> str:
        return FILE_ROWS

    def streamReader(self, schema) -> ArrivalReader:
        return ArrivalReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StructureSource)
    spark.dataSource.register(ArrivalSource)


def by_segment(rows: DataFrame) -> DataFrame:
    """chain_id and pos such that angles end at broken bonds. Residues that are no standard amino acids take part in their neighbours' angles and can be left out afterwards."""
    return rows.withColumn("chain_id", F.concat_ws("|", "path", "chain", F.col("seg").cast("string"))).withColumn("pos", F.col("resnum"))
