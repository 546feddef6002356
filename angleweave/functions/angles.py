"""Column helpers on angles in radians: everything periodic goes through wrap()."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap(d: Column) -> Column:
    """Signed circular value of a difference."""
    return F.atan2(F.sin(d), F.cos(d))


def circular_distance(a: Column, b: Column) -> Column:
    """Absolute circular difference."""
    return F.abs(wrap(a - b))


def embed(phi: Column, psi: Column) -> list[Column]:
    """T2 to R4 (P07)."""
    return [F.cos(phi), F.sin(phi), F.cos(psi), F.sin(psi)]


def grid_index(angle: Column, n: int = 360, how: str = "nearest") -> Column:
    """Grid bin of an angle: nearest rounds half to even (P08), floor (P08b), truncate cuts the degrees towards zero first."""
    if how == "nearest":
        k = F.rint((F.degrees(angle) + 180.0) * n / 360.0)
    elif how == "floor":
        k = F.floor((angle + F.pi()) * n / (2 * F.pi()))
    elif how == "truncate":
        k = (F.degrees(angle) * n / 360.0).cast("int") + n // 2
    else:
        raise ValueError(how)
    return F.pmod(k.cast("int"), F.lit(n))


def dihedral(p: list[tuple[Column, Column, Column]], sign: int = -1, degenerate: str = "null") -> Column:
    """Dihedral of four points (P01): atan2(m1.n2, n1.n2) with the raw sign, times sign (-1 gives IUPAC)."""
    sub = lambda a, b: tuple(y - x for x, y in zip(a, b))
    cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    b1, b2, b3 = sub(p[0], p[1]), sub(p[1], p[2]), sub(p[2], p[3])
    n1, n2 = cross(b1, b2), cross(b2, b3)
    long = F.sqrt(dot(b2, b2))
    flat = (dot(n1, n1) < 1e-20) | (dot(n2, n2) < 1e-20) | (long < 1e-10)
    m1 = cross(n1, b2)
    angle = F.atan2(dot(m1, n2), long * dot(n1, n2)) * sign
    return F.when(flat, F.lit(None if degenerate == "null" else 0.0)).otherwise(angle)


def structure_file(name: Column) -> tuple[Column, Column]:
    """Id and version of AF-<id>-F1-model_v<k>.cif."""
    pattern = r"AF-([A-Z0-9]+)-F\d+-model_v(\d+)\.cif"
    return F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(name, pattern, 2), F.lit("")).cast("int")


def count_label(text: Column) -> Column:
    """'~4.4K' to 4400."""
    plain = F.regexp_replace(text, r"[~,\s]", "")
    number = F.regexp_extract(plain, r"^([0-9.]+)", 1).try_cast("double")
    scale = F.when(F.upper(plain).endswith("K"), 1000.0).when(F.upper(plain).endswith("M"), 1e6).otherwise(1.0)
    return F.round(number * scale).cast("bigint")
