"""Solvent-accessible area by test points on a sphere around every atom.

A neighbour hides some of an atom's test points. Atoms are copied to the cubes
their balls touch; cubes are met as arrays, some hundred atoms at a time with
those in the columns of space around them. Which points a neighbour hides is
looked up: a table of directions and heights of caps tells those that are hidden
for sure and those that may be, and only points between the two that no other
neighbour hides for sure are tested one by one. The bit masks of hidden points
are OR-ed. Pairs never become rows, and no task gathers more than one cube and
its rim, or a few thousand atoms of small ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schema as S
from ..functions.chemistry import vdw_radius
from ..operators.spatial import AXES, in_cube, reaching_cubes
from ..scaling import by_key, cut_lineage

WORD = 64
ROWS = 16384  # atoms and copies at a time, of cubes that are smaller
NEAR = 512  # atoms whose neighbours are found at a time
EDGE = 6  # of a cube, in greatest distances of two atoms that meet
SIDE, HEAVIEST = 32, 48 << 20  # directions along a side of the table's six faces, bytes of the table
LIMBS = 1024  # fine steps along a side of a face
SLACK = 1e-6
HIGH, MASK = 40, (1 << 21) - 1


def fibonacci_sphere(points: int) -> np.ndarray:
    """``points`` nearly even unit vectors."""
    if points < 1:
        raise ValueError(f"points must be at least 1, got {points}")
    k = np.arange(points)
    z = 1.0 - (2.0 * k + 1.0) / points
    ring = np.sqrt(1.0 - z * z)
    turn = np.pi * (3.0 - np.sqrt(5.0)) * k
    return np.stack([ring * np.cos(turn), ring * np.sin(turn), z], axis=1)


def _words(hidden: np.ndarray) -> np.ndarray:
    """Boolean (rows, points) as (rows, words) of 64 bits."""
    rows, points = hidden.shape
    width = -(-points // WORD) * WORD
    padded = np.zeros((rows, width), dtype=bool)
    padded[:, :points] = hidden
    packed = np.packbits(padded, axis=1, bitorder="little")
    return packed.view(np.int64).reshape(rows, width // WORD)


def _codes(column: pa.Array) -> np.ndarray:
    """A number per distinct text; nulls are -1."""
    return pc.fill_null(column.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)


def _face(shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The face of a cube that each vector leaves through, and the place there, -1 to 1 along both sides."""
    x, y, z = shift
    ax, ay, az = np.abs(shift)
    along = np.where(ax >= ay, np.where(ax >= az, 0, 2), np.where(ay >= az, 1, 2))
    first, second, third = along == 0, along == 1, along == 2
    lead = np.where(first, x, np.where(second, y, z))
    size = np.maximum(np.abs(lead), np.finfo(float).tiny)
    return 2 * along + (lead < 0), np.where(first, y, x) / size, np.where(third, y, z) / size


class Caps:
    """Masks of the sphere's points above a height, by direction of the cap and height."""

    def __init__(self, sphere: np.ndarray) -> None:
        words = -(-len(sphere) // WORD)
        side = min(SIDE, max(4, int((HEAVIEST / (6 * 3 * 8 * words)) ** (1 / 3))))
        self.sphere, self.side, self.step = sphere, side, 1.0 / side
        self.low = -(side + 2)  # the height of level 0, in steps: no point lies as low
        levels = (np.arange(2 * side + 5) + self.low) * self.step
        fine = (np.arange(LIMBS) + 0.5) * 2 / LIMBS - 1
        # a side is cut into nearly equal angles; a limb belongs to one cut
        self.cut = np.minimum(((np.arctan(fine) * 4 / np.pi + 1) / 2 * side).astype(np.int64), side - 1)
        ends = np.concatenate([[-1.0], (np.flatnonzero(np.diff(self.cut)) + 1) * 2 / LIMBS - 1, [1.0]])
        low, high = (v.ravel() for v in np.meshgrid(np.arange(side), np.arange(side), indexing="ij"))
        spots = [(ends[low + i], ends[high + j]) for i in (0, 1) for j in (0, 1)]
        middle = ((ends[low] + ends[low + 1]) / 2, (ends[high] + ends[high + 1]) / 2)
        self.table = np.empty((6 * side * side, len(levels), words), np.int64)
        self.slack = np.empty(6 * side * side)
        for face in range(6):
            heart, *corners = (self._direction(face, *spot) for spot in (middle, *spots))
            held = slice(face * side * side, (face + 1) * side * side)
            self.slack[held] = np.max([np.linalg.norm(c - heart, axis=1) for c in corners], axis=0) + SLACK
            for k, up in enumerate(heart @ sphere.T, held.start):
                self.table[k] = _words(up[None] > levels[:, None])
        self.levels = len(levels)
        self.flat = self.table.reshape(-1, words)

    @staticmethod
    def _direction(face: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        lead = np.full(len(a), 1.0 - 2 * (face % 2))
        out = np.stack({0: (lead, a, b), 1: (a, lead, b), 2: (a, b, lead)}[face // 2], axis=1)
        return out / np.linalg.norm(out, axis=1)[:, None]

    def hidden(self, i: np.ndarray, shift: np.ndarray, far: np.ndarray, reach: np.ndarray, known: np.ndarray) -> np.ndarray:
        """``known`` (masks of atoms) and the points that pairs hide: those of atom i beyond ``reach`` along ``shift``.

        Pairs come in the order of i, ``far`` is the length of ``shift``.
        """
        if not len(i):
            return known
        face, a, b = _face(shift)
        limb = lambda v: self.cut[np.minimum(((v + 1) * (LIMBS / 2)).astype(np.int64), LIMBS - 1)]
        spot = (face * self.side + limb(a)) * self.side + limb(b)
        here = far > SLACK
        height = np.divide(reach, far, out=np.zeros(len(far)), where=here)
        slack = self.slack[spot]
        top = self.levels - 1
        sure = np.where(here, np.clip(np.ceil((height + slack) / self.step) - self.low, 0, top), top)
        maybe = np.where(here, np.clip(np.floor((height - slack) / self.step) - self.low, 0, top), 0)
        spot *= self.levels
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        out = known.copy()
        out[i[starts]] |= np.bitwise_or.reduceat(self.flat.take(spot + sure.astype(np.int64), axis=0), starts, axis=0)
        unsure = self.flat.take(spot + maybe.astype(np.int64), axis=0)
        unsure &= (~out).take(i, axis=0)
        at = np.flatnonzero(unsure)
        bits = np.unpackbits(unsure.ravel()[at].view(np.uint8), bitorder="little")
        bit = np.flatnonzero(bits.view(bool))
        at = at[bit >> 6]
        pair, point = at // out.shape[1], at % out.shape[1] * WORD + (bit & 63)
        px, py, pz = (self.sphere[:, k].take(point) for k in range(3))
        dx, dy, dz = (v.take(pair) for v in shift)
        met = px * dx + py * dy + pz * dz > reach.take(pair)
        found = np.zeros((len(out), out.shape[1] * WORD), bool)
        found[i.take(pair[met]), point[met]] = True
        return out | _words(found)


@lru_cache(maxsize=2)
def _caps(sphere: bytes) -> Caps:
    return Caps(np.frombuffer(sphere).reshape(-1, 3))


def _each(sphere: np.ndarray, i: np.ndarray, shift: np.ndarray, reach: np.ndarray, known: np.ndarray) -> np.ndarray:
    """As ``Caps.hidden``, every point of every pair."""
    if not len(i):
        return known
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    out = known.copy()
    height = sum(v[:, None] * p for v, p in zip(shift, sphere.T))
    out[i[starts]] |= np.bitwise_or.reduceat(_words(height > reach[:, None]), starts, axis=0)
    return out


class _Columns:
    """Atoms sorted by cube, column of space (two of its sides as wide as atoms reach) and height."""

    def __init__(self, cube: np.ndarray, place: np.ndarray, r: np.ndarray) -> None:
        self.reach = 2 * float(r.max()) + SLACK
        self.edge = self.reach / 2
        x, y, z = place
        self.base = z.min()
        cell = [np.floor(v / self.edge).astype(np.int64) for v in (x, y)]
        column = (cube << 42) | ((cell[0] & MASK) << 21) | (cell[1] & MASK)
        self.order = np.lexsort((z, column))
        self.x, self.y, self.z = x[self.order], y[self.order], z[self.order]
        self.cell = [c[self.order] for c in cell]
        known, self.number = np.unique(column[self.order], return_inverse=True)
        self.key = (self.number << HIGH) | self._height(self.z)
        steps = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]
        cx, cy, code = known >> 21 & MASK, known & MASK, known >> 42
        near = [(code << 42) | ((cx + i & MASK) << 21) | (cy + j & MASK) for i, j in steps]
        self.near = np.stack([np.searchsorted(known, k) for k in near], axis=1)
        there = known[np.minimum(self.near, len(known) - 1)] == np.stack(near, axis=1)
        self.near[~there] = -1
        self.steps = np.array(steps)

    def _height(self, z: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((z - self.base) * WORD), 0, (1 << HIGH) - 1).astype(np.int64)

    def around(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number within ``some``, atom) in the order of the first; all that are in reach, and more."""
        gap = []
        for v, cell, step in zip((self.x, self.y), self.cell, self.steps.T):
            v, cell = v[some, None], cell[some, None]
            gap.append(np.where(step > 0, (cell + step) * self.edge - v, np.where(step < 0, v - (cell + step + 1) * self.edge, 0.0)))
        left = self.reach * self.reach - np.square(np.maximum(gap[0], 0)) - np.square(np.maximum(gap[1], 0))
        column = self.near[self.number[some]]
        row, step = np.nonzero((left > 0) & (column >= 0))
        high, z, base = np.sqrt(left[row, step]) + SLACK, self.z[some[row]], column[row, step] << HIGH
        first = np.searchsorted(self.key, base | self._height(z - high))
        count = np.searchsorted(self.key, base | self._height(z + high), "right") - first
        ends = np.cumsum(count)
        j = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)
        return np.repeat(row, count), j


def _masks(cubes: pa.RecordBatch, code: np.ndarray, sphere: np.ndarray, ends: list[str], alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the atoms that lie in their cube, and their masks: hidden by any atom and, if ``alone``, by the own chain."""
    words = -(-len(sphere) // WORD)
    place = np.stack([cubes.column(c).to_numpy() for c in AXES])
    r = cubes.column("r").to_numpy()
    own = cubes.column("own").to_numpy(zero_copy_only=False)
    out = np.zeros((len(r), (1 + alone) * words), np.int64)
    # what lies nowhere meets nothing
    usable = np.flatnonzero(np.isfinite(place).all(axis=0))
    if not len(usable) or not own.any():
        return np.flatnonzero(own), out[own]
    columns = _Columns(code[usable], place[:, usable], r[usable])
    order = usable[columns.order]
    r, mine = r[order], np.flatnonzero(own[order])
    chain = _codes(cubes.column("chain_id"))[order]
    names = [_codes(c) if not pa.types.is_integer(c.type) else c.to_numpy() for c in map(cubes.column, ends)]
    names = [v[order] for v in names]
    for start in range(0, len(mine), NEAR):
        some = mine[start : start + NEAR]
        i, j = columns.around(some)
        shift = np.stack([v[j] - v[some][i] for v in (columns.x, columns.y, columns.z)])
        square = shift[0] * shift[0] + shift[1] * shift[1] + shift[2] * shift[2]
        far, ra = np.sqrt(square), r[some][i]
        met = far < ra + r[j]
        met &= np.logical_or.reduce([v[some][i] != v[j] for v in names])
        met = np.flatnonzero(met)
        i, j, shift, square, far, ra = i[met], j[met], shift[:, met], square[met], far[met], ra[met]
        rb = r[j]
        reach = (ra * ra + square - rb * rb) / (2 * ra)

        def hidden(part, known):
            if len(sphere) <= WORD:
                return _each(sphere, i[part], shift[:, part], reach[part], known)
            return _caps(np.ascontiguousarray(sphere).tobytes()).hidden(i[part], shift[:, part], far[part], reach[part], known)

        found = np.zeros((len(some), words), np.int64)
        if alone:
            same = (chain[some][i] == chain[j]) & (chain[j] >= 0)
            kin = hidden(same, found)
            out[order[some], words:] = kin
            found = hidden(~same, kin)
        else:
            found = hidden(slice(None), found)
        out[order[some], :words] = found
    own = np.flatnonzero(own)
    return own, out[own]


def _hide(sphere: np.ndarray, key: list[str], group: list[str], schema: pa.Schema, alone: bool):
    """Masks of hidden points of every atom, whole cubes at a time; rows come sorted by ``group``."""
    ends = [c for c in key if c not in group]

    def some(held: list[pa.RecordBatch], new: list[np.ndarray]) -> pa.RecordBatch:
        cubes = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        own, words = _masks(cubes, np.cumsum(np.concatenate(new)), sphere, ends, alone)
        marks = [cubes.column(c).take(pa.array(own)) for c in key]
        masks = [pa.array(np.ascontiguousarray(w)) for w in words.T]
        return pa.RecordBatch.from_arrays(marks + masks, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        marked: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, dtype=bool)
            for c in group:
                values = batch.column(c).to_numpy(zero_copy_only=False)
                new[0] |= bool(held) and held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py()
                new[1:] |= values[1:] != values[:-1]
            starts = np.flatnonzero(new)
            if len(starts) and sum(map(len, marked)) + len(new) >= ROWS:
                cut = int(starts[-1])
                if held or cut:
                    yield some([*held, batch.slice(0, cut)], [*marked, new[:cut]])
                batch, new, held, marked = batch.slice(cut), new[cut:], [], []
            held.append(batch)
            marked.append(new)
        if held:
            yield some(held, marked)

    return run


def accessible_area(
    atoms: DataFrame,
    points: int = 1000,
    probe: float = 1.4,
    sphere: list[tuple[float, float, float]] | None = None,
    group: list[str] | None = None,
    alone: bool = True,
) -> DataFrame:
    """``area`` and ``area_alone`` of every atom; atoms without a radius have 0.

    ``area_alone`` counts only neighbours of the same ``chain_id``: the area
    the chain would have by itself; without ``alone`` it is left out. ``group`` names
    the columns that keep atoms apart (structure, or structure and symmetry copy).
    """
    group = group or ["structure_id"]
    unit = np.asarray(sphere, dtype=float) if sphere is not None else fibonacci_sphere(points)
    count = len(unit)
    key = S.atom_key(atoms)
    sized = atoms.withColumn("r", vdw_radius() + F.lit(float(probe)))
    solid = sized.filter(F.col("r").isNotNull())
    widest = 2 * (max(S.R_C4, S.R_OTHER) + probe)
    cube = [*group, "_cube"]
    carry = [*key, "chain_id", "r", *AXES]
    homes = in_cube(solid.select(*carry).dropna(subset=key), EDGE * widest).withColumnRenamed("_cube", "_home")
    copies = reaching_cubes(homes, widest, EDGE * widest)
    rows = copies.select(*carry, "_cube", (F.col("_cube") == F.col("_home")).alias("own"))
    rows = by_key(rows, cube).sortWithinPartitions(*cube)
    width = -(-count // WORD)
    kinds = {"w": "", "s": "_alone"} if alone else {"w": ""}
    names = [f"{kind}{i}" for kind in kinds for i in range(width)]
    fields = [rows.schema[c] for c in key] + [T.StructField(n, T.LongType()) for n in names]
    hide = _hide(unit, key, cube, to_arrow_schema(T.StructType(fields)), alone)
    masks = rows.mapInArrow(hide, T.StructType(fields))
    masks = masks.groupBy(*key).agg(*[F.bit_or(n).alias(n) for n in names])

    def free(kind: str) -> Column:
        hidden = [F.coalesce(F.bit_count(F.col(f"{kind}{i}")), F.lit(0)) for i in range(width)]
        return F.lit(count) - sum(hidden[1:], hidden[0])

    r = F.col("r")
    full = F.lit(4 * np.pi / count) * r * r
    # as many rows as atoms, guessed by the size of the file they come from
    joined = sized.join(masks.hint("merge"), key, "left")
    counted = joined.withColumns({f"free{end}": F.when(r.isNotNull(), free(kind)).otherwise(0).cast("int") for kind, end in kinds.items()})
    return counted.withColumns(
        {f"area{end}": F.coalesce(full * F.col(f"free{end}"), F.lit(0.0)) for end in kinds.values()}
    ).drop("r", *names)


def sasa(atoms: DataFrame, points: int = 1000, probe: float = 1.4, sphere=None) -> DataFrame:
    """Accessible area per atom."""
    # read for the copies and for the result, so what they need is written out once
    needed = [*S.atom_key(atoms), "chain_id", "res_name", "atom_name", "element", *AXES]
    atoms = cut_lineage(atoms.select(*dict.fromkeys(needed)))
    found = accessible_area(atoms, points, probe, sphere, alone=False)
    return found.select(*S.atom_key(atoms), "area")


def delta_sasa(
    atoms: DataFrame, a: str, b: str, points: int = 1000, probe: float = 1.4, sphere=None, group=None
) -> DataFrame:
    """Area each atom of chains ``a`` and ``b`` loses when the two come together."""
    both = atoms.filter(F.col("chain_id").isin(a, b))
    found = accessible_area(both, points, probe, sphere, group)
    return found.withColumn("delta", F.col("area_alone") - F.col("area"))
