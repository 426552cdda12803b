"""Centroids and the distances, angles and torsions between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import geometry as G

ARITY = {"distance": 2, "angle": 3, "dihedral": 4}


def centroids(x: DataFrame, group: list[str]) -> DataFrame:
    return x.groupBy(*group).agg(*[F.avg(c).alias(c) for c in "xyz"], F.count("*").alias("atoms"))


def measure(
    atoms: DataFrame, handles: DataFrame, kind: str, names: list[str], strict: bool = False
) -> DataFrame:
    """One value per structure that holds all the named sets, between their centroids."""
    if kind not in ARITY:
        raise ValueError(f"unknown measurement {kind!r}; known: {', '.join(ARITY)}")
    if len(names) != ARITY[kind]:
        raise ValueError(f"a {kind} needs {ARITY[kind]} sets, got {len(names)}")
    key = S.atom_key(handles)
    used = handles.filter(F.col("name").isin(names)).select(*key, "name")
    placed = used.join(atoms.select(*key, "x", "y", "z"), key)
    means = placed.groupBy("structure_id").pivot("name", sorted(set(names))).agg(
        *[F.avg(c).alias(c) for c in "xyz"]
    )
    points = [tuple(F.col(f"{n}_{c}") for c in "xyz") for n in names]
    value = {"distance": G.distance, "angle": G.angle, "dihedral": G.dihedral}[kind](*points)
    out = means.select("structure_id", value.alias("value"))
    if strict:
        for n in names:
            if placed.filter(F.col("name") == n).isEmpty():
                raise ValueError(f"set {n!r} has no atoms to measure")
    return out.filter(F.col("value").isNotNull())
