"""Backbone geometry. Placement is sequential within a chain; angles from coordinates are window expressions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.angles import dihedral
from ..functions.geometry import build, build_many, place, superposed_many, superposed_rmsd  # noqa: F401
from . import families
from .chains import order
from .loops import path_distance, resampled
from .shared import chainwise, kept, sizes_of


def reconstructed(res: DataFrame) -> DataFrame:
    """chain_id, pos, nx .. cz."""
    names = [a + d for a in ("n", "ca", "c") for d in "xyz"]

    def run(pdf):
        import pandas as pd

        x = build_many(pdf["phi"].fillna(0).to_numpy(float), pdf["psi"].fillna(0).to_numpy(float), sizes_of(pdf["chain_id"])).reshape(-1, 9)
        return pd.DataFrame({"chain_id": pdf["chain_id"].to_numpy(), "pos": pdf["pos"].to_numpy(), **{c: x[:, k] for k, c in enumerate(names)}})

    return chainwise(res.select("chain_id", "pos", "phi", "psi"), run, "chain_id bigint, pos int, " + ", ".join(f"{c} double" for c in names), whole=True)


def angles(atoms: DataFrame, sign: int = -1) -> DataFrame:
    """Phi and psi over present residues, from nx .. cz; sign -1 gives IUPAC."""
    # Neighbours' atoms become columns first: inside the formula every mention would be a window function of its own.
    around = {f"__{a}{d}": f(a + d).over(order()) for a, f in (("c", F.lag), ("n", F.lead)) for d in "xyz"}
    at = lambda a: tuple(F.col(a + d) for d in "xyz")
    phi = dihedral([at("__c"), at("n"), at("ca"), at("c")], sign)
    psi = dihedral([at("n"), at("ca"), at("c"), at("__n")], sign)
    return atoms.withColumns(around).withColumns({"phi": phi, "psi": psi}).drop(*around)


def gyration(atoms: DataFrame) -> DataFrame:
    """P09."""
    spread = F.sqrt(F.var_pop("cax") + F.var_pop("cay") + F.var_pop("caz"))
    return atoms.groupBy("chain_id").agg(F.when(F.count(F.lit(1)) >= 3, spread).alias("rg"))


def contacts(atoms: DataFrame, cutoff: float = 8.0, least: int = 4) -> DataFrame:
    """chain_id, a, b (places, a < b), distance of CA atoms at least `least` places apart and nearer than the cutoff.

    Atoms fall into cells as wide as the cutoff; an atom meets its own cell and half of the 26 around it, by an equi-join, so the
    work grows with the chain's length. A merge join by hint: Spark's estimate does not see that rows were made 14-fold.
    """
    cell = [F.floor(F.col(f"ca{d}") / F.lit(cutoff)).cast("int").alias(f"c{d}") for d in "xyz"]
    rows = atoms.where(F.col("cax").isNotNull()).select("chain_id", "pos", "cax", "cay", "caz", *cell)
    half = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]
    steps = F.array(*[F.struct(*[F.lit(v).alias(f"o{d}") for d, v in zip("xyz", o)]) for o in half])
    moved = rows.select("chain_id", F.col("pos").alias("other"), *[F.col(f"ca{d}").alias(f"o{d}") for d in "xyz"], *[F.col(f"c{d}").alias(f"own{d}") for d in "xyz"], F.explode(steps).alias("o"))
    moved = moved.select("chain_id", "other", "ox", "oy", "oz", *[(F.col(f"own{d}") + F.col(f"o.o{d}")).alias(f"c{d}") for d in "xyz"], *[(F.col(f"o.o{d}") == 0).alias(f"same{d}") for d in "xyz"])
    same = F.col("samex") & F.col("samey") & F.col("samez")
    gap = sum((F.pow(F.col(f"ca{d}") - F.col(f"o{d}"), 2) for d in "xyz"), F.lit(0.0))
    met = rows.join(moved.hint("merge"), ["chain_id", "cx", "cy", "cz"]).where(~same | (F.col("pos") < F.col("other"))).where((F.abs(F.col("pos") - F.col("other")) >= least) & (gap < cutoff * cutoff))
    return met.select("chain_id", F.least("pos", "other").alias("a"), F.greatest("pos", "other").alias("b"), F.sqrt(gap).alias("distance"))


def contact_order(atoms: DataFrame, cutoff: float = 8.0, least: int = 4) -> DataFrame:
    """P10: mean separation of the contacts over the chain's length; null without contacts or below five residues."""
    found = contacts(atoms, cutoff, least).groupBy("chain_id").agg(F.sum(F.col("b") - F.col("a")).alias("sep"), F.count(F.lit(1)).alias("contacts"))
    n = atoms.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(found, "chain_id", "left").select("chain_id", F.when(F.col("n") >= 5, F.col("sep") / (F.col("n") * F.col("contacts"))).alias("contact_order"))


def shape(atoms: DataFrame) -> DataFrame:
    """chain_id, rg, contact_order."""
    return gyration(atoms).join(contact_order(atoms), "chain_id", "left")


#: Angles (degrees) that stand for a basin in canonical reconstruction.
CENTRES = {"alpha": (-63.0, -43.0), "beta": (-120.0, 130.0), "ppII": (-75.0, 150.0), "alphaL": (57.0, 47.0)}
def clashes(atoms: DataFrame, lookback: int = 6, radius: float = 2.0, bonded: bool = False) -> DataFrame:
    """chain_id, clashing (residues with an atom nearer than radius to one of the lookback residues before). bonded=True also
    counts the bond between neighbours, which is always shorter than the radius."""
    b = atoms.alias("b")
    kinds = ("n", "ca", "c")
    gap = lambda p, q: sum((F.pow(F.col(f"a.{p}{d}") - F.col(f"b.{q}{d}"), 2) for d in "xyz"), F.lit(0.0))
    bond = F.col("b.pos") - F.col("a.pos") == 1
    close = [gap(p, q) if bonded or (p, q) != ("c", "n") else F.when(~bond, gap(p, q)) for p in kinds for q in kinds]
    # Each residue meets the lookback residues after it by an equi-join on places.
    reach = atoms.withColumn("after", F.explode(F.array(*[F.lit(k) for k in range(1, lookback + 1)]))).alias("a")
    pairs = reach.join(b, (F.col("a.chain_id") == F.col("b.chain_id")) & (F.col("a.pos") + F.col("a.after") == F.col("b.pos")))
    hit = pairs.where(F.least(*close) < radius * radius).groupBy(F.col("b.chain_id").alias("chain_id")).agg(F.count_distinct("b.pos").alias("clashing"))
    return atoms.select("chain_id").distinct().join(hit, "chain_id", "left").select("chain_id", F.coalesce("clashing", F.lit(0)).alias("clashing"))


#: Widths of the rings in which a nearest path is searched; the last one holds every pair, as no two paths are farther apart than pi times the root of 2.
RINGS = (0.1, 0.2, 0.4, 0.8, 1.6, 4.5)
#: Two fixed paths (degrees) whose distances place a path in the index.
PIVOTS = ((-63.0, -43.0), (-120.0, 130.0))


def nearest_paths(asked: DataFrame, keys: list[str], library: DataFrame) -> DataFrame:
    """Adds family, other (its path) and distance: the nearest library path, ties by name. asked: keys and pts; library: family, pts; both of one number of points.

    The mean torus distance is a metric, so two paths within a ring's width differ by no more than it in their distances to any
    fixed path. Paths meet in cells of that width over two such distances, block by block in a stated number of tasks; a task gives
    the nearest of its block only. Who found none within the ring goes on to the next, wider one; only paths that are far from all
    of the library come to the last.
    """
    def placed(df: DataFrame) -> DataFrame:
        fixed = lambda phi, psi: F.transform("pts", lambda _: F.struct(F.lit(math.radians(phi)).alias("phi"), F.lit(math.radians(psi)).alias("psi")))
        return df.withColumns({f"d{k}": path_distance(F.col("pts"), fixed(*p)) for k, p in enumerate(PIVOTS)}).withColumn("id", F.monotonically_increasing_id())

    # A path with an undefined point is near none.
    whole = (F.col("d0") < math.inf) & (F.col("d1") < math.inf)
    named, every = kept(placed(library.select("family", "pts")), "library"), kept(placed(asked), "asked")
    shelf = named.where(whole).select("id", "family", families.flat("pts"), "d0", "d1")
    rest, out = every.where(whole).select("id", families.flat("pts"), "d0", "d1"), None
    for ring in RINGS:
        cell = lambda c: F.floor(F.col(c) / F.lit(ring * (1 + 1e-9))).cast("int")  # noqa: B023, E731
        around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        index = shelf.withColumn("o", F.explode(around)).select("id", "family", "at", (cell("d0") + F.col("o.i")).alias("x"), (cell("d1") + F.col("o.j")).alias("y"))
        near = families.met(index, rest.select("id", "at", cell("d0").alias("x"), cell("d1").alias("y")), ["x", "y"], ring, families.nearest_of(ring), "id bigint, distance double, family string, other bigint")
        # Blocks of one cell may each name a path.
        found = kept(near.groupBy("id").agg(F.min(F.struct("distance", "family", "other")).alias("best")).select("id", "best.*"), "ring")
        out = found if out is None else out.unionByName(found)
        rest = kept(rest.join(found.select("id"), "id", "left_anti"), "asked")
        if rest.isEmpty():
            break
    path = named.select(F.col("id").alias("other"), F.col("pts").alias("path"))
    return every.join(out.join(path, "other").drop("other"), "id").select(*asked.columns, "family", F.col("path").alias("other"), "distance")


#: Mean loss (Angstrom) below which canonical paths capture the loops, and capture them moderately.
CAPTURED, LOST = 1.0, 3.0


def canonical(res: DataFrame, loops: DataFrame, families: DataFrame) -> DataFrame:
    """Residues of a loop take the nearest family's centroid at the loop's length, other residues their basin's centre; the rest stay.

    res carries basin; loops has chain_id, start, length, pts; families has centroid. Adds kind: loop, basin or kept.
    """
    library = families.select(F.concat_ws("|", "g", F.col("cluster").cast("string")).alias("family"), F.col("centroid").alias("pts"))
    # Loops of one path (rep) ask once.
    loops = loops if "rep" in loops.columns else loops.withColumns({"g": F.lit(""), "rep": F.concat_ws(":", "chain_id", "start")})
    asked = loops.groupBy("g", "rep").agg(F.first("pts").alias("pts"))
    nearest = nearest_paths(asked, ["g", "rep"], library).select("g", "rep", F.col("other").alias("centroid"))
    nearest = loops.select("chain_id", "start", "length", "g", "rep").join(kept(nearest, "nearest"), ["g", "rep"])
    points = nearest.select("chain_id", "start", F.posexplode(resampled(F.col("centroid"), F.col("length").cast("int"))).alias("k", "p"))
    # Where loops overlap, the later one is written last.
    new = points.select("chain_id", (F.col("start") + F.col("k")).cast("int").alias("pos"), "start", "p").groupBy("chain_id", "pos").agg(F.max_by("p", "start").alias("p"))
    rows = res.join(new, ["chain_id", "pos"], "left")
    centre = lambda i: F.coalesce(*[F.when(F.col("basin") == b, F.lit(v[i])) for b, v in CENTRES.items()])
    kind = F.when(F.col("p").isNotNull(), "loop").when(F.col("basin").isin(*CENTRES), "basin").otherwise("kept")
    pick = lambda c, i: F.coalesce(F.col("p")[c], F.radians(centre(i)), F.col(c))
    return rows.withColumn("kind", kind).withColumn("new_phi", pick("phi", 0)).withColumn("new_psi", pick("psi", 1)).drop("p", "phi", "psi").withColumnsRenamed({"new_phi": "phi", "new_psi": "psi"})


def deviations(a: DataFrame, b: DataFrame, most: float = 0.5) -> DataFrame:
    """chain_id, n, rmsd of the CA atoms that both tables have, passed (below `most`). Many chains are superposed a call."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        n = sizes_of(pdf["chain_id"])
        r = superposed_many(pdf[["ax", "ay", "az"]].to_numpy(float), pdf[["bx", "by", "bz"]].to_numpy(float), n)
        return pd.DataFrame({"chain_id": pdf["chain_id"].to_numpy()[np.cumsum(n) - 1], "n": n, "rmsd": pd.Series(r).astype(object).where(~np.isnan(r), None)})

    one = lambda df, k: df.select("chain_id", "pos", *[F.col(f"ca{d}").alias(f"{k}{d}") for d in "xyz"])
    out = chainwise(one(a, "a").join(one(b, "b"), ["chain_id", "pos"]), run, "chain_id bigint, n bigint, rmsd double", whole=True)
    return out.withColumn("passed", F.col("rmsd") < most)


def compared(truth: DataFrame, observed: DataFrame, replaced: DataFrame) -> DataFrame:
    """chain_id, rmsd of the rebuilt chain from observed angles, of the one from canonical angles, and their difference, as deviations()
    gives them. Both meet the truth in one join and go to their chain together; a table has a place once."""
    sides = {"observed": "a", "canonical": "b"}

    def run(pdf):
        import numpy as np
        import pandas as pd

        out = []
        for name, k in sides.items():
            both = pdf[pdf[f"in_{k}"].notna()]
            n = sizes_of(both["chain_id"])
            r = superposed_many(both[["tx", "ty", "tz"]].to_numpy(float), both[[f"{k}x", f"{k}y", f"{k}z"]].to_numpy(float), n) if len(n) else np.zeros(0)
            out.append(pd.DataFrame({"chain_id": both["chain_id"].to_numpy()[np.cumsum(n) - 1], name: pd.Series(r).astype(object).where(~np.isnan(r), None)}))
        return out[0].merge(out[1], on="chain_id")

    one = lambda df, k: df.select("chain_id", "pos", *[F.col(f"ca{d}").alias(f"{k}{d}") for d in "xyz"], *([F.lit(True).alias(f"in_{k}")] if k != "t" else []))
    rows = one(truth, "t").join(one(observed, "a"), ["chain_id", "pos"], "left").join(one(replaced, "b"), ["chain_id", "pos"], "left").where("in_a or in_b")
    return chainwise(rows, run, "chain_id bigint, observed double, canonical double", whole=True).withColumn("delta", F.col("canonical") - F.col("observed"))


def reconstruction_verdict(found: DataFrame) -> DataFrame:
    """Chains, mean rmsd of both reconstructions, their mean difference and the verdict on it. found: as compared() gives it."""
    out = found.agg(F.count("delta").alias("chains"), F.avg("observed").alias("observed"), F.avg("canonical").alias("canonical"), F.avg("delta").alias("delta"))
    size = F.abs(F.col("delta"))
    return out.withColumn("verdict", F.when(size < CAPTURED, "captured").when(size < LOST, "moderate loss").when(size.isNotNull(), "significant loss"))
