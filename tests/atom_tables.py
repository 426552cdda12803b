"""Small atom tables for the tests."""

from __future__ import annotations

ATOM_COLUMNS = (
    "structure_id long, rank long, atom_id long, chain_id string, res_id int, ins_code string, res_name string, "
    "atom_name string, element string, hetero boolean, altloc_id string, occupancy double, b_factor double, "
    "x double, y double, z double"
)


def atom_rows(spark, rows):
    """Rows of (chain, res_id, res_name, atom_name, element, x, y, z, extra dict)."""
    full = []
    for i, (chain, res, resn, name, element, x, y, z, *more) in enumerate(rows):
        extra = more[0] if more else {}
        full.append((
            extra.get("structure", 1), i, i + 1, chain, res, extra.get("ins", ""), resn, name, element,
            extra.get("hetero", False), extra.get("alt", "."), extra.get("occ", 1.0), extra.get("b", 20.0),
            float(x), float(y), float(z),
        ))
    return spark.createDataFrame(full, ATOM_COLUMNS)


def ids(df):
    return sorted(r["atom_id"] for r in df.select("atom_id").collect())
