"""Distances, angles and torsions between points given as three columns each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str = "", suffix: str = "") -> Vec:
    return tuple(F.col(f"{prefix}{c}{suffix}") for c in "xyz")


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vec, b: Vec) -> Column:
    return norm(sub(a, b))


def angle_between(a: Vec, b: Vec) -> Column:
    """Degrees between two vectors; null where one has no length."""
    size = norm(a) * norm(b)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(size, F.lit(0.0))))
    return F.when(size > 0, F.degrees(F.acos(cosine)))


def angle(a: Vec, b: Vec, c: Vec) -> Column:
    """Degrees at ``b``."""
    return angle_between(sub(a, b), sub(c, b))


def dihedral(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Signed torsion in degrees about the axis b-c."""
    b1, b2, b3 = sub(b, a), sub(c, b), sub(d, c)
    n1, n2 = cross(b1, b2), cross(b2, b3)
    return F.degrees(F.atan2(norm(b2) * dot(b1, n2), dot(n1, n2)))
