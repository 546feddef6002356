"""Classes of residues and chains. Every variant is a named scheme."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def basin(phi: Column, psi: Column, scheme: str = "wide") -> Column:
    """wide (C01), narrow (C02), inclusive (C03); angles in radians, limits in degrees."""
    p, s = F.degrees(phi), F.degrees(psi)
    if scheme == "wide":
        found = F.when((p > -160) & (p < 0) & (s > -120) & (s < 30), "alpha").when((p > -170) & (p < -70) & ((s > 90) | (s < -120)), "beta")
    elif scheme == "narrow":
        found = (
            F.when((p > -100) & (p < -30) & (s > -67) & (s < -7), "alpha")
            .when((p > -100) & (p < -50) & (s > 120) & (s < 180), "ppII")
            .when((p > -170) & (p < -70) & ((s > 90) | (s < -120)), "beta")
            .when((p > 30) & (p < 90) & (s > 10) & (s < 70), "alphaL")
        )
    elif scheme == "inclusive":
        found = (
            F.when(p.between(-100, -30) & s.between(-67, -7), "alpha")
            .when(p.between(-170, -70) & (s.between(90, 180) | s.between(-180, -120)), "beta")
            .when(p.between(-100, -50) & s.between(120, 180), "ppII")
            .when(p.between(30, 90) & s.between(10, 70), "alphaL")
        )
    else:
        raise ValueError(scheme)
    return found.otherwise("other")


def stratum_hits(phi: Column, psi: Column) -> tuple[Column, Column]:
    """Stratified boxes (C04), counted on their own: phi in [-180, -40] and psi in [-80, 50], or psi beyond 80 or -140."""
    p, s = F.degrees(phi), F.degrees(psi)
    strip = p.between(-180, -40)
    return strip & s.between(-80, 50), strip & ((s > 80) | (s < -140))


def fold(a: Column, b: Column, scheme: str = "fractions", density: Column | None = None) -> Column:
    """Fold classes: fractions (C05), presence (C06, needs transition density), percent (C07), stratified."""
    if scheme == "fractions":
        return F.when((a >= 0.35) & (b < 0.10), "all-alpha").when((b >= 0.25) & (a < 0.15), "all-beta").when((a >= 0.20) & (b >= 0.15), "alpha/beta").when((a >= 0.10) & (b >= 0.10), "alpha+beta").otherwise("other")
    if scheme == "presence":
        return F.when((a >= 0.15) & (b >= 0.15), F.when(density > 0.05, "alpha/beta").otherwise("alpha+beta")).when(a >= 0.15, "all-alpha").when(b >= 0.15, "all-beta").otherwise("other")
    if scheme == "percent":
        return F.when((a > 15) & (b > 15), "mixed").when((a > 40) & (b <= 15), "alpha-rich").when((b > 25) & (a <= 15), "beta-rich").otherwise("Other")
    if scheme == "stratified":
        return F.when((a >= 0.40) & (b < 0.10), "all_alpha").when((b >= 0.30) & (a < 0.15), "all_beta").when((a >= 0.15) & (b >= 0.15), "alpha_beta").otherwise("other")
    raise ValueError(scheme)


#: Organism sets.
KINGDOMS = {
    "Bacteria": ("ecoli", "bacillus", "tuberculosis", "staph", "pseudomonas", "salmonella", "campylobacter", "helicobacter"),
    "Metazoa": ("human", "mouse", "rat", "fly", "worm", "zebrafish", "chicken", "pig", "cow", "dog", "cat", "gorilla", "chimp", "mosquito", "honeybee"),
    "Plants": ("arabidopsis", "rice", "soybean", "maize"),
    "Fungi": ("yeast", "fission_yeast", "candida"),
    "Protists": ("malaria", "leishmania", "trypanosoma", "dictyostelium"),
}


def kingdom(organism: Column) -> Column:
    """Kingdom of an organism, "?" if unknown."""
    out = F.lit("?")
    for name, members in KINGDOMS.items():
        out = F.when(organism.isin(*members), name).otherwise(out)
    return out


def kingdom_table(spark) -> DataFrame:
    """organism, kingdom: the dimension by which organisms are looked up (J02); a row an organism named here."""
    return spark.createDataFrame([(o, k) for k, members in KINGDOMS.items() for o in members], "organism string, kingdom string")


def with_kingdom(df: DataFrame) -> DataFrame:
    """Adds kingdom by a left join with the dimension; "?" where it has none."""
    found = df.join(F.broadcast(kingdom_table(df.sparkSession)), "organism", "left")
    return found.withColumn("kingdom", F.coalesce("kingdom", F.lit("?")))


def outlier(bps_norm: Column) -> Column:
    """A flag, never a filter (C11)."""
    return ~((bps_norm > 0.02) & (bps_norm < 0.50))


def tightness(n: Column, mean: Column, sd: Column, path_mean: Column | None = None, path_sd: Column | None = None, kind: str = "change") -> Column:
    """C12, from a family's |dW| (mean, sd) and path lengths: coefficients of variation below 30 %.

    "change": of |dW| alone, degenerate below three members or without a change. "both": of both, each 0 where its mean is. "largest":
    the larger of both; fewer than three members are tight.
    """
    if kind == "change":
        return F.when((n < 3) | (mean < 1e-6), "degenerate").when(100 * sd / F.when(mean >= 1e-6, mean) < 30, "tight").otherwise("catch-all")
    if kind == "both":
        cv = lambda m, s: F.when(m > 0, 100 * s / F.when(m > 0, m)).otherwise(0.0)
        return F.when((cv(mean, sd) < 30) & (cv(path_mean, path_sd) < 30), "tight").otherwise("catch-all")
    if kind == "largest":
        cv = lambda m, s: s / F.greatest(m, F.lit(1e-6))
        return F.when((n < 3) | (F.greatest(cv(mean, sd), cv(path_mean, path_sd)) < 0.30), "tight").otherwise("catch-all")
    raise ValueError(kind)
