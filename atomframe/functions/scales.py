"""Rescaling of values, contour levels and the provenance vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL = 100.0
MODES = ("relative", "absolute", "peak")
# fixed values: how a map came to exist, and what to say beside a picture of it
PROVENANCE = {
    "measured": "measured map",
    "sharpened": "sharpened map: contrast was changed after measurement",
    "nn_enhanced": "enhanced by a neural network: features may not be in the data",
    "generated": "generated map: not a measurement",
    "unknown": "origin not declared",
}


def rescale(v: Column, lo: Column, hi: Column, mode: str = "relative") -> Column:
    """Onto 0..100.

    ``relative`` stretches over lo..hi and falls back to ``absolute`` where they
    are equal; ``absolute`` is 100 v; ``peak`` is v over hi, clipped.
    """
    if mode not in MODES:
        raise ValueError(f"unknown scale {mode!r}; known: {', '.join(MODES)}")
    ceiling = F.when(hi > 0, hi).otherwise(F.lit(1.0))
    peak = F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / ceiling)) * FULL
    if mode == "peak":
        return peak
    if mode == "absolute":
        return v * FULL
    return F.when(hi > lo, (v - lo) / (hi - lo) * FULL).otherwise(v * FULL)


def domain_fraction(
    v: Column, lo: Column, hi: Column, domain: tuple[float, float] | None = None
) -> Column:
    """Where a value sits in a domain, 0 to 1; one half where the data have no spread."""
    if domain is not None:
        if not domain[0] < domain[1]:
            raise ValueError(f"domain {list(domain)} has no width")
        lo, hi = F.lit(float(domain[0])), F.lit(float(domain[1]))
    inside = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - lo) / (hi - lo)))
    return F.when(hi > lo, inside).otherwise(F.lit(0.5))


def absolute_level(level: float, unit: str, mean: Column, sigma: Column) -> Column:
    """A contour level in map units; sigma levels use the given mean and sigma."""
    if unit not in ("sigma", "absolute"):
        raise ValueError(f"unit must be 'sigma' or 'absolute', not {unit!r}")
    number = float(level)
    if number != number or number in (float("inf"), float("-inf")):
        raise ValueError(f"contour level {level!r} is not finite")
    return F.lit(number) if unit == "absolute" else F.lit(number) * sigma + mean


def provenance(c: Column) -> Column:
    """The declared origin, trimmed and lower-cased; an unknown word is an error."""
    word = F.lower(F.trim(c))
    known = ", ".join(PROVENANCE)
    refuse = F.raise_error(F.concat(F.lit("unknown provenance "), c, F.lit(f"; known: {known}")))
    return F.when(word.isin(list(PROVENANCE)), word).otherwise(refuse.cast("string"))


def caveat(word: Column) -> Column:
    pairs = [F.lit(x) for item in PROVENANCE.items() for x in item]
    return F.element_at(F.create_map(*pairs), word)
