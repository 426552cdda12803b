"""Screened Coulomb potential on grids, and sampling a grid at atoms.

The potential at a point is a sum over all charges of the structure, so the
work is points times charges whatever the plan. Bricks of grid points are dealt over
all tasks and the charges come to each brick in chunks. With salt, exp(-kr)/r is a sum of
some forty Gaussians, each a product over x, y and z: a brick and a chunk are then products of
matrices, and wide Gaussians see the charges through a few nodes. The error is 5e-12 of 1/r.
A task holds the points of one brick, whatever the number of charges. Where only places
between the points are asked for, these come to the brick too, and no point becomes a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.physics import IONIC_STRENGTH, TEMPERATURE, WATER_DIELECTRIC, kt_scale, screening
from ..operators import predicates as P
from ..operators.prep import resolve_conformers
from ..scaling import BLOCK as BLOCK_ATOMS
from ..scaling import by_key, cut_lineage, top_k

BRICK = 64  # points per brick edge
CHUNK = 1024  # charges per chunk
FEW, TILE = 1000, 1 << 15  # bricks of so few points meet their charges one by one; pairs at a time
NEAREST = 1.0  # distances are floored here
STEP = math.log(2) / 4  # between the logarithms of widths, so that each Gaussian is the square of the last but one
SHARPEST, FAINTEST = 6.0, 12.0  # exp(-36) of what is left beyond the ends
NODES, REACH = 32, 2.0  # nodes per axis interpolate Gaussians up to this times half the box of a chunk to 2e-14
SMALL = 1e-40
BLOCK = 4  # cells per edge of the blocks that points are sampled from
AXES = "xyz"
PLACES = ["bi", "bj", "bk"]
OPENS, SPOT, CHARGES = range(3)  # order of the rows of a brick


def grid_axes(
    charges: DataFrame, spacing: float = 1.0, padding: float = 10.0, max_points: int | None = None
) -> DataFrame:
    """Origin, spacing and point counts of a box around each structure's charges.

    Grids are made in bricks, so any size will do; a caller may have boxes of more
    than ``max_points`` refused.
    """
    return _axes(_extent(charges, ["structure_id"]), spacing, padding, max_points)


def _extent(charges: DataFrame, group: list[str]) -> DataFrame:
    low = [F.min(c).alias(f"lo_{c}") for c in AXES]
    high = [F.max(c).alias(f"hi_{c}") for c in AXES]
    return charges.groupBy(*group).agg(*low, *high)


def _axes(box: DataFrame, spacing: float, padding: float, max_points: int | None) -> DataFrame:
    for c in AXES:
        box = box.withColumn(f"o{c}", F.col(f"lo_{c}") - F.lit(float(padding)))
        span = F.col(f"hi_{c}") + F.lit(float(padding)) - F.col(f"o{c}")
        count = F.ceil(span / F.lit(float(spacing))).cast("long") + 1
        box = box.withColumn(f"n{c}", F.greatest(count, F.lit(2)))
        box = box.withColumn(f"h{c}", F.lit(float(spacing)))
    total = F.col("nx") * F.col("ny") * F.col("nz")
    cols = ["structure_id", *[f"{p}{c}" for p in "onh" for c in AXES]]
    sized = box.select(*cols, total.alias("points"))
    if max_points is None:
        return sized
    refuse = F.raise_error(
        F.concat(
            F.lit("a grid of "), F.col("points").cast("string"),
            F.lit(f" points is above {max_points}; raise the spacing (now {spacing}) or lower the padding"),
        )
    ).cast("long")
    return sized.withColumn(
        "points", F.when(F.col("points") > max_points, refuse).otherwise(F.col("points"))
    )


def _bricks(axes: DataFrame) -> DataFrame:
    """One row per brick of each grid, numbered i, j, k by brick."""
    out = axes
    for c, b in zip(AXES, ("bi", "bj", "bk")):
        last = F.floor((F.col(f"n{c}") - 1) / BRICK).cast("int")
        out = out.withColumn(b, F.explode(F.sequence(F.lit(0), last)))
    return out


def _points(bricks: DataFrame) -> DataFrame:
    """The grid points of each brick."""
    out = bricks
    for c, b, i in zip(AXES, ("bi", "bj", "bk"), "ijk"):
        first = F.col(b) * BRICK
        last = F.least(first + (BRICK - 1), F.col(f"n{c}").cast("int") - 1)
        out = out.withColumn(i, F.explode(F.sequence(first, last)))
    return out


def grid_points(
    charges: DataFrame, spacing: float = 1.0, padding: float = 10.0, max_points: int | None = None
) -> DataFrame:
    """Every grid point: structure_id, i, j, k, x, y, z."""
    points = _points(_bricks(grid_axes(charges, spacing, padding, max_points)))
    place = [(F.col(f"o{c}") + F.lit(float(spacing)) * F.col(i)).alias(c) for c, i in zip(AXES, "ijk")]
    return points.select("structure_id", "i", "j", "k", *place)


def _chunks(charges: DataFrame, key: list[str]) -> DataFrame:
    """Charges in arrays of at most CHUNK, zero charges dropped.

    ``key`` are the structure and blocks of its atoms; chunks are counted inside a block,
    so that one shuffle deals the charges, numbers and gathers them.
    """
    charged = charges.filter(F.col("charge") != 0)
    place = F.row_number().over(Window.partitionBy(*key).orderBy("atom_id"))
    numbered = charged.withColumn("_chunk", F.floor((place - 1) / CHUNK).cast("long"))
    return numbered.groupBy(*key, "_chunk").agg(
        *[F.collect_list(c).alias(f"q{c}") for c in AXES], F.collect_list("charge").alias("q")
    )


def _gaussians(kappa: float) -> tuple[np.ndarray, np.ndarray]:
    """t and w so that exp(-kappa r) / r is the sum of w exp(-(t r)^2) from NEAREST on, widest first."""
    n = max(math.ceil(math.log(SHARPEST * FAINTEST / kappa) / STEP), 1)
    t = SHARPEST * np.exp(-STEP * np.arange(n, -1, -1))
    return t, 2 / math.sqrt(math.pi) * STEP * t * np.exp(-np.square(kappa / (2 * t)))


def _bells(axis: np.ndarray, at: np.ndarray, t: np.ndarray) -> Iterator[np.ndarray]:
    """exp(-(t d)^2) of every place on the axis and every ``at``, for one t after the other."""
    square, last = np.square(axis[:, None] - at), []
    for x in t:
        bell = np.square(last.pop(0)) if len(last) == 2 else np.exp(-x * x * square)
        bell[bell < SMALL] = 0.0
        last.append(bell)
        yield bell


def _nodes(at: np.ndarray, middle: float, half: float) -> tuple[np.ndarray, np.ndarray]:
    """Chebyshev nodes around ``middle`` and the weight each has at every place."""
    k, turn = np.arange(NODES)[:, None], np.pi * (np.arange(NODES) + 0.5) / NODES
    scale = np.where(k == 0, 1.0, 2.0) / NODES
    weight = (np.cos(k * turn) * scale).T @ np.cos(k * np.arccos(np.clip((at - middle) / half, -1, 1)))
    return middle + half * np.cos(turn), weight


def _add_wide(total: np.ndarray, axes: list, at: list, q: np.ndarray, half: float, t: np.ndarray, w: np.ndarray) -> None:
    spots, weights = zip(*[_nodes(a, (a.min() + a.max()) / 2, half) for a in at])
    pairs = ((weights[0] * q)[:, None] * weights[1]).reshape(NODES * NODES, -1)
    heart = pairs @ weights[2].T
    for scale, bx, by, bz in zip(w, *[_bells(x, p, t) for x, p in zip(axes, spots)]):
        part = np.matmul(by, (heart @ bz.T).reshape(NODES, NODES, -1))
        total += ((scale * bx) @ part.reshape(NODES, -1)).reshape(total.shape)


def _add_narrow(total: np.ndarray, axes: list, at: list, q: np.ndarray, t: np.ndarray, w: np.ndarray) -> None:
    """``at`` is sorted by x: a layer of points meets only the charges that its Gaussian reaches."""
    for x, scale, bx, by, bz in zip(t, w, *[_bells(x, p, t) for x, p in zip(axes, at)]):
        bx, bz, far = bx * (scale * q), np.ascontiguousarray(bz.T), math.sqrt(-math.log(SMALL)) / x
        bounds = np.searchsorted(at[0], axes[0] - far), np.searchsorted(at[0], axes[0] + far, "right")
        for i, (low, high) in enumerate(zip(*bounds)):
            if low < high:
                total[i] += (by[:, low:high] * bx[i, low:high]) @ bz[low:high]


def _floor(total: np.ndarray, axes: list, at: list, q: np.ndarray, kappa: float, t: np.ndarray, w: np.ndarray) -> None:
    """Points nearer than NEAREST get the value there instead of the sum of Gaussians."""
    first = [np.searchsorted(x, p - NEAREST) for x, p in zip(axes, at)]
    width = [int((np.searchsorted(x, p + NEAREST, "right") - f).max()) for x, p, f in zip(axes, at, first)]
    if not all(width):
        return
    steps = np.indices(width).reshape(3, -1)
    size = max(1, (1 << 18) // steps.shape[1])
    for start in range(0, len(q), size):
        part = slice(start, start + size)
        cells = [f[part, None] + s for f, s in zip(first, steps)]
        square = sum(np.square(x[np.minimum(c, len(x) - 1)] - p[part, None]) for x, c, p in zip(axes, cells, at))
        near = (square < NEAREST * NEAREST) & np.logical_and.reduce([c < len(x) for x, c in zip(axes, cells)])
        owner, _ = np.nonzero(near)
        found = sum(scale * np.exp(-x * x * square[near]) for x, scale in zip(t, w))
        value = q[part][owner] * (math.exp(-kappa * NEAREST) / NEAREST - found)
        np.add.at(total, tuple(c[near] for c in cells), value)


def _add_each(total: np.ndarray, axes: list, at: list, q: np.ndarray, kappa: float) -> None:
    """Every point with every charge, some charges at a time."""
    size = max(1, TILE // total.size)
    for start in range(0, len(q), size):
        part = slice(start, start + size)
        dx, dy, dz = (np.square(x[:, None] - p[part]) for x, p in zip(axes, at))
        r = dx[:, None, None] + dy[None, :, None] + dz[None, None, :]
        np.sqrt(np.maximum(r, NEAREST * NEAREST, out=r), out=r)
        if kappa:
            bell = np.exp(-kappa * r)
            total += np.divide(bell, r, out=bell) @ q[part]
        else:
            total += np.reciprocal(r, out=r) @ q[part]


def _add(total: np.ndarray, axes: list, at: list, q: np.ndarray, kappa: float) -> None:
    """Add the potential of a chunk of charges to the points of a brick."""
    if not kappa or total.size <= FEW:
        _add_each(total, axes, at, q, kappa)
        return
    order = np.argsort(at[0])
    at, q = [a[order] for a in at], q[order]
    t, w = _gaussians(kappa)
    half = max(max(float(np.ptp(a)) for a in at) / 2, NEAREST)
    wide = int(np.searchsorted(t, REACH / half))
    # products and sums of either way
    through = NODES**3 * len(q) + wide * NODES * (NODES + total.shape[0]) * total.shape[2] * (NODES + total.shape[1])
    if through > wide * total.size * len(q):
        wide = 0
    if wide:
        _add_wide(total, axes, at, q, half, t[:wide], w[:wide])
    _add_narrow(total, axes, at, q, t[wide:], w[wide:])
    _floor(total, axes, at, q, kappa, t, w)


def _sums(kappa: float, kind: str, spots: bool = False):
    """What is made of each brick, whose row comes before the ``spots`` in it and its charges.

    (structure_id, i, j, k, _sum) of its points; or, of the spots, their place, the copies that
    went to bricks and the sum over the corners in this brick. Of a brick with spots only the
    box around their cells is summed up.
    """
    number = pa.from_numpy_dtype(np.int64) if kind == "bigint" else pa.string()

    def owners(owner, n: int) -> pa.Array:
        return pa.array([owner], number).take(pa.array(np.zeros(n, np.int64)))

    def points(owner, first: list[int], total: np.ndarray) -> pa.RecordBatch:
        i, j, k = (np.indices(total.shape).reshape(3, -1) + np.array(first)[:, None]).astype(np.int32)
        return pa.RecordBatch.from_arrays([owners(owner, len(i)), *map(pa.array, (i, j, k, total.ravel()))], names=["structure_id", "i", "j", "k", "_sum"])

    def corners(owner, first: list[int], total: np.ndarray, cells: list, parts: list, at: list, copies: np.ndarray) -> pa.RecordBatch:
        found = np.zeros(len(copies))
        for corner in range(8):
            weight, spot, here = 1.0, [], np.ones(len(found), bool)
            for cell, part, start, size, bit in zip(cells, parts, first, total.shape, (2, 1, 0)):
                up = corner >> bit & 1
                weight = weight * (part if up else 1.0 - part)
                step = cell + (up - start)
                here &= (step >= 0) & (step < size)
                spot.append(np.clip(step, 0, size - 1))
            found += np.where(here, total[tuple(spot)] * weight, 0.0)
        return pa.RecordBatch.from_arrays([owners(owner, len(found)), *map(pa.array, (*at, copies, found))], names=["structure_id", *AXES, "copies", "_sum"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, brick, total, charged = None, None, None, False
        held: list[list[np.ndarray]] = []
        asked: list[list[np.ndarray]] = []

        def add() -> None:
            nonlocal brick, total
            if total is None:
                brick = _box(brick, BRICK, asked if spots else None)
                total = np.zeros([len(x) for x in brick[1]])
            *at, q = (np.concatenate(v) for v in zip(*held))
            _add(total, brick[1], at, q, kappa)
            held.clear()

        def made() -> Iterator[pa.RecordBatch]:
            if held:
                add()
            if charged and spots:
                yield corners(here[0], brick[0], total, *brick[2:])
            elif charged:
                yield points(here[0], brick[0], total)

        for batch in batches:
            lists = [batch.column(c) for c in (*[f"q{c}" for c in AXES], "q")]
            spot = [batch.column(f"s{c}").to_numpy(zero_copy_only=False) for c in (*AXES, "n")] if spots else []
            asks = ~np.isnan(spot[-1]) if spots else False
            stage = np.where(lists[-1].is_valid().to_numpy(zero_copy_only=False), CHARGES, np.where(asks, SPOT, OPENS))
            # spots of a brick come in one piece, all else row by row
            part, owner = batch.column("part").to_numpy(), batch.column("structure_id").to_numpy(zero_copy_only=False)
            inside = (stage[1:] == SPOT) & (stage[:-1] == SPOT) & (part[1:] == part[:-1]) & (owner[1:] == owner[:-1])
            starts = np.flatnonzero(np.r_[True, ~inside]) if len(stage) else np.zeros(0, np.int64)
            rows = batch.select(["structure_id", "part", *PLACES, *[f"{o}{c}" for o in "ohn" for c in AXES]]).take(pa.array(starts)).to_pylist()
            for n, end, row in zip(starts, [*starts[1:], len(stage)], rows):
                key = row["structure_id"], row["part"]
                if key != here:
                    yield from made()
                    here, brick, total, charged = key, None, None, False
                    asked.clear()
                if stage[n] == OPENS:
                    brick = row
                elif stage[n] == SPOT:
                    asked.append([v[n:end] for v in spot])
                elif asked or not spots:
                    charged = True
                    # blocks may hold few charges each; they are met together
                    held.append([x[int(n)].values.to_numpy(zero_copy_only=False) for x in lists])
                    if sum(len(v[-1]) for v in held) >= CHUNK:
                        add()
        yield from made()

    return work


def _box(row: dict, edge: int, asked: list[list[np.ndarray]] | None) -> tuple:
    """First points and places along the axes of a brick, or of the box around the cells of spots; these cells, the parts of them, and the spots."""
    first = [row[b] * edge for b in PLACES]
    count = [min(edge, row[f"n{c}"] - f) for c, f in zip(AXES, first)]
    more = ()
    if asked is not None:
        *at, copies = (np.concatenate(v) for v in zip(*asked))
        along = [(p - row[f"o{c}"]) / row[f"h{c}"] for c, p in zip(AXES, at)]
        cells = [np.floor(u).astype(np.int64) for u in along]
        low = [max(f, int(c.min())) for f, c in zip(first, cells)]
        count = [min(f + n, int(c.max()) + 2) - f2 for f, n, c, f2 in zip(first, count, cells, low)]
        first, more = low, (cells, [u - c for u, c in zip(along, cells)], at, copies.astype(np.int32))
    places = [row[f"o{c}"] + row[f"h{c}"] * (f + np.arange(n)) for c, f, n in zip(AXES, first, count)]
    return first, places, *more


class _Field:
    """The grids of a table of charges: bricks, and the charges dealt to them."""

    def __init__(
        self, charges: DataFrame, spacing: float = 1.0, padding: float = 10.0, dielectric: float = WATER_DIELECTRIC,
        ionic: float = IONIC_STRENGTH, temperature: float = TEMPERATURE, max_points: int | None = None,
    ) -> None:
        # blocks of atoms: their boxes make the structure's, and chunks of charges are gathered in them
        key = ["structure_id", "_blk"]
        charges = charges.withColumn("_blk", F.floor(F.col("atom_id") / F.lit(float(BLOCK_ATOMS))).cast("long"))
        blocks = cut_lineage(_extent(charges, key))
        whole = [F.min(f"lo_{c}").alias(f"lo_{c}") for c in AXES] + [F.max(f"hi_{c}").alias(f"hi_{c}") for c in AXES]
        self.axes = axes = cut_lineage(_axes(blocks.groupBy("structure_id").agg(*whole), spacing, padding, max_points))
        method = (
            f"sum of screened point charges, dielectric {dielectric:g} everywhere, {ionic:g} M salt; "
            "compare values within one grid, not with those of a continuum solver"
        )
        self.meta = axes.withColumn("method", F.lit(method))
        self.kappa, self.scale = screening(ionic, dielectric, temperature), F.lit(kt_scale(dielectric, temperature))
        # a brick owns its points: the charges come to it, chunk by chunk
        self.many = many = {c: F.ceil(F.col(f"n{c}") / BRICK).cast("long") for c in AXES}
        counts = axes.select("structure_id", (many["x"] * many["y"] * many["z"]).alias("_parts"))
        grid = [F.col(f"{o}{c}") for o in "ohn" for c in AXES]
        self.bricks = _bricks(axes).select("structure_id", self.part(), F.lit(OPENS).alias("stage"), *PLACES, *grid)
        # as many rows as structures, and more; the chunks are dealt and stay where they are
        counts = blocks.select(*key).join(counts.hint("merge"), "structure_id")
        chunks = _chunks(charges, key).join(counts.hint("merge"), key)
        chunks = chunks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        self.chunks = chunks.select("structure_id", "part", F.lit(CHARGES).alias("stage"), *[f"q{c}" for c in AXES], "q")

    def part(self) -> Column:
        return ((F.col("bi") * self.many["y"] + F.col("bj")) * self.many["z"] + F.col("bk")).alias("part")

    def _made(self, rows: DataFrame, columns: str, spots: bool) -> DataFrame:
        """``_sums`` of rows that are dealt by brick."""
        rows = by_key(rows, ["structure_id", "part"]).sortWithinPartitions("structure_id", "part", "stage")
        kind = rows.schema["structure_id"].dataType.simpleString()
        owner = "bigint" if kind in ("tinyint", "smallint", "int", "bigint") else "string"
        made = rows.withColumn("structure_id", F.col("structure_id").cast(owner)).mapInArrow(
            _sums(self.kappa, owner, spots), f"structure_id {owner}, {columns}, _sum double"
        )
        return made.withColumn("structure_id", F.col("structure_id").cast(kind))

    def grid(self) -> DataFrame:
        """Every point, which becomes a row once."""
        summed = self._made(self.bricks.unionByName(self.chunks, allowMissingColumns=True), "i int, j int, k int", False)
        return summed.select("structure_id", "i", "j", "k", (F.col("_sum") * self.scale).alias("value"))

    def samples(self, points: DataFrame) -> DataFrame:
        """``points`` with the trilinear ``potential`` there; null outside the grid."""
        box = self.axes.select("structure_id", *[f"{p}{c}" for p in "onh" for c in AXES])
        spots = points.select("structure_id", *[F.col(c).cast("double").alias(f"s{c}") for c in AXES]).join(box, "structure_id")
        inside, copies = F.lit(True), F.lit(1)
        for c, b in zip(AXES, PLACES):
            low = F.floor((F.col(f"s{c}") - F.col(f"o{c}")) / F.col(f"h{c}")).cast("long")
            inside = inside & (low >= 0) & (low < F.col(f"n{c}") - 1) & ~F.isnan(f"s{c}")
            block = F.floor(low / BRICK).cast("int")
            # a cell between two bricks has corners in both
            spots = spots.withColumn(f"_{b}", F.when(low % BRICK == BRICK - 1, F.array(block, block + 1)).otherwise(F.array(block)))
            copies = copies * F.size(f"_{b}")
        spots = spots.filter(inside).withColumn("sn", copies.cast("double"))
        for b in PLACES:
            spots = spots.withColumn(b, F.explode(f"_{b}"))
        spots = spots.select("structure_id", self.part(), F.lit(SPOT).alias("stage"), "sx", "sy", "sz", "sn")
        rows = self.bricks.unionByName(self.chunks, allowMissingColumns=True).unionByName(spots, allowMissingColumns=True)
        parts = self._made(rows, "x double, y double, z double, copies int", True)
        # equal places of several points come as often as these
        share = F.max("copies") / F.count(F.lit(1))
        found = parts.groupBy("structure_id", *[F.col(c).alias(f"_{c}") for c in AXES]).agg((F.sum("_sum") * share * self.scale).alias("potential"))
        found = found.withColumnRenamed("structure_id", "_structure")
        same = F.col("structure_id") == F.col("_structure")
        for c in AXES:
            same = same & (F.col(c).cast("double") == F.col(f"_{c}"))
        return points.join(found.hint("merge"), same, "left").drop("_structure", *[f"_{c}" for c in AXES])


def coulomb_grid(
    charges: DataFrame,
    spacing: float = 1.0,
    padding: float = 10.0,
    dielectric: float = WATER_DIELECTRIC,
    ionic: float = IONIC_STRENGTH,
    temperature: float = TEMPERATURE,
    max_points: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(GRID_META, GRID) of the screened Coulomb potential in kT/e.

    Distances are floored at 1 angstrom. ``method`` in the meta table says what
    the numbers are.
    """
    field = _Field(charges, spacing, padding, dielectric, ionic, temperature, max_points)
    return field.meta, field.grid()


def sample_coulomb(points: DataFrame, charges: DataFrame, **options) -> DataFrame:
    """As ``sample_grid`` of ``coulomb_grid`` at ``points``, without a row for any point of the grid.

    The points go to the bricks that hold the corners of their cells and only their sums come back.
    """
    return _Field(charges, **options).samples(points)


def _cell(i: Column, j: Column, k: Column) -> Column:
    """Number of a point inside its block, from its steps along the axes."""
    return ((i * (BLOCK + 1) + j) * (BLOCK + 1) + k).cast("int")


def _blocks(grid: DataFrame) -> DataFrame:
    """The values of BLOCK cells a side, the points on their far faces included, in one array.

    ``_held`` runs over a box of ``_wx`` x ``_wy`` x ``_wz`` points, the last axis fastest.
    """
    out = grid.filter(F.col("value").isNotNull())
    for i, b in zip("ijk", PLACES):
        block = F.floor(F.col(i) / BLOCK).cast("long")
        shared = (F.col(i) % BLOCK == 0) & (F.col(i) > 0)
        out = out.withColumn(b, F.explode(F.when(shared, F.array(block - 1, block)).otherwise(F.array(block))))
    steps = [F.col(i) - F.col(b) * BLOCK for i, b in zip("ijk", PLACES)]
    wide = [(F.max(step) + 1).cast("int").alias(f"_w{c}") for step, c in zip(steps, AXES)]
    held = F.sort_array(F.collect_list(F.struct(_cell(*steps).alias("cell"), "value")))
    found = out.groupBy("structure_id", *PLACES).agg(held.alias("_held"), *wide)
    wx, wy, wz = (F.col(f"_w{c}") for c in AXES)
    # points that lack a value leave holes, which are found by number
    at = lambda p: _cell(F.floor(p / (wy * wz)), F.floor(p / wz) % wy, p % wz)
    by_number = F.map_from_entries("_held")
    padded = F.transform(F.sequence(F.lit(0), wx * wy * wz - 1), lambda p: F.try_element_at(by_number, at(p)))
    return found.withColumn("_held", F.when(F.size("_held") == wx * wy * wz, F.col("_held.value")).otherwise(padded))


def sample_grid(points: DataFrame, grid: DataFrame, meta: DataFrame, key: list[str]) -> DataFrame:
    """Trilinear value at each point; null outside the grid, never clamped.

    ``key`` names the columns that identify a point inside its structure. A point meets
    the one block of the grid that holds its cell; corners never become rows.
    """
    box = meta.select("structure_id", *[F.col(f"{p}{c}").alias(f"_{p}{c}") for p in "onh" for c in AXES])
    placed = points.join(box, "structure_id", "left")
    inside = F.lit(True)
    for c, b in zip(AXES, PLACES):
        placed = placed.withColumn(f"_u{c}", (F.col(c) - F.col(f"_o{c}")) / F.col(f"_h{c}"))
        low = F.floor(f"_u{c}").cast("long")
        inside = inside & (low >= 0) & (low < F.col(f"_n{c}") - 1)
        placed = placed.withColumn(b, F.floor(low / BLOCK).cast("long"))
    spare = [f"_{p}{c}" for p in "onh" for c in AXES]
    met = placed.withColumn("_inside", inside).drop(*spare)
    met = met.join(_blocks(grid).hint("merge"), ["structure_id", *PLACES], "left")
    met = met.withColumns({f"_b{c}": F.floor(f"_u{c}").cast("long") for c in AXES})
    met = met.withColumns({f"_s{c}": (F.col(f"_b{c}") - F.col(b) * BLOCK).cast("int") for c, b in zip(AXES, PLACES)})
    spots, weights = [], []
    for corner in range(8):
        weight, spot, held = F.lit(1.0), F.lit(0), F.lit(True)
        for c, bit in zip(AXES, (2, 1, 0)):
            up, part = corner >> bit & 1, F.col(f"_u{c}") - F.col(f"_b{c}")
            weight = weight * (part if up else F.lit(1.0) - part)
            step = F.col(f"_s{c}") + up
            held = held & (step < F.col(f"_w{c}")) if up else held
            spot = spot * F.col(f"_w{c}") + step
        spots.append(F.when(held, spot))
        weights.append(weight)
    # arrays and small functions: eight written-out look-ups make a method too long to be compiled
    met = met.withColumn("_p", F.array(*weights)).withColumn("_c", F.array(*spots))
    met = met.withColumn("_v", F.transform("_c", lambda c: F.get("_held", c)))
    total = F.aggregate(F.zip_with("_v", "_p", lambda v, w: v * w), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    potential = F.when(F.col("_inside") & F.exists("_v", lambda v: v.isNotNull()), total)
    drop = [f"_{p}{c}" for p in "ubsw" for c in AXES]
    return met.withColumn("potential", potential).drop(*PLACES, *drop, "_inside", "_held", "_p", "_c", "_v")


def potential_by_residue(sampled: DataFrame) -> DataFrame:
    """Mean of the in-grid samples per residue; residues with none are dropped."""
    return sampled.groupBy("structure_id", "chain_id", "res_id", "ins_code").agg(
        F.avg("potential").alias("potential"), F.min_by("res_name", "atom_id").alias("res_name")
    ).filter(F.col("potential").isNotNull())


def extremes(residues: DataFrame, limit: int = 50) -> DataFrame:
    """The ``limit`` most negative and most positive residues of each structure."""
    tie = [F.col("chain_id"), F.col("res_id"), F.col("ins_code")]
    low = top_k(residues, ["structure_id"], [F.col("potential"), *tie], limit)
    high = top_k(residues, ["structure_id"], [F.col("potential").desc(), *tie], limit)
    return low.withColumn("side", F.lit("negative")).unionByName(
        high.withColumn("side", F.lit("positive"))
    )


def outside_grid(sampled: DataFrame) -> DataFrame:
    """Atoms that lie outside the grid, per structure."""
    missing = F.sum(F.col("potential").isNull().cast("long"))
    return sampled.groupBy("structure_id").agg(missing.alias("atoms_outside_grid"))


def grid_summary(grid: DataFrame, meta: DataFrame) -> DataFrame:
    span = grid.groupBy("structure_id").agg(
        F.round(F.min("value"), 3).alias("min"), F.round(F.max("value"), 3).alias("max")
    )
    return meta.join(span, "structure_id")


def charge_summary(charges: DataFrame, ff: str | None = None, ph: float | None = None) -> DataFrame:
    """Atoms and net charge; force field and pH are stated by the caller."""
    return charges.groupBy("structure_id").agg(
        F.count("*").alias("atoms"), F.round(F.sum("charge"), 3).alias("net_charge")
    ).withColumns({"ff": F.lit(ff).cast("string"), "ph": F.lit(ph).cast("double")})


def electrostatics(
    atoms: DataFrame, charges: DataFrame, limit: int = 50, **options
) -> dict[str, DataFrame]:
    """Grid, sampled atoms, residue potentials, extremes and summaries in one call.

    Samples the polymer of one conformer state at its atom positions.
    """
    field = _Field(charges, **options)
    meta, grid = field.meta, field.grid()
    state = resolve_conformers(atoms).filter(P.is_class("polymer"))
    # read for the bricks and for the result
    sampled = field.samples(cut_lineage(state))
    residues = potential_by_residue(sampled)
    return {
        "meta": meta, "grid": grid, "sampled": sampled, "residues": residues,
        "extremes": extremes(residues, limit), "outside": outside_grid(sampled),
        "grid_summary": grid_summary(grid, meta), "charge_summary": charge_summary(charges),
    }
