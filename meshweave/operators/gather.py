"""Neighbour values on a dense grid.

Grids are gathered by windows, one for each axis, wholly in SQL; a window's line is one task's. A large
grid with few lines is cut into tiles instead: each cell goes to its tile, and to the neighbouring tiles
that can reach it, in one shuffle; a tile's neighbours are then looked up by index, in Arrow, whatever the
number of axes and offsets. (Of 1024 x 1024 cells windows take half as long as tiles.)

A grid that is dealt into slabs lies in a table bucketed by slab. Its windows are within a slab, so they need
no shuffle; along the axis that was dealt, a slab gets the rows beyond its ends from its neighbours, and only
these move, with the wanted columns alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def name_of(column: str, offset: tuple[int, ...]) -> str:
    """Column of the neighbours of ``column`` at an offset; the same for equal offsets."""
    return column if not any(offset) else f"{column}@{'_'.join(map(str, offset))}"


def by_window(df: DataFrame, axes: tuple[str, ...], wanted: dict[str, set[tuple[int, ...]]]) -> DataFrame:
    """Adds the neighbours by ``lag`` and ``lead``, one window for each axis, all offsets of an axis
    together. An offset along several axes shifts what was shifted along the axes before. A
    neighbour outside the grid is null. The grid has to be dense.
    """
    steps = {(c, o[: a + 1] + (0,) * (len(axes) - a - 1)): a for c, os in wanted.items() for o in os for a in range(len(axes)) if o[a]}
    for a, axis in enumerate(axes):
        window = Window.partitionBy(*(x for x in axes if x != axis)).orderBy(axis)
        own = sorted(k for k, at in steps.items() if at == a and k[1][a])
        if own:
            new = {name_of(c, o): F.lead(F.col(f"`{name_of(c, o[:a] + (0,) * (len(axes) - a))}`"), o[a]).over(window) for c, o in own}
            df = df.withColumns(new)
    return df


def by_key(df: DataFrame, axes: tuple[str, ...], wanted: dict[str, set[tuple[int, ...]]]) -> DataFrame:
    """The same by sending each value to the cells that want it and grouping by cell. Works on sparse
    grids and for any offset, and a long single axis is dealt over all tasks.
    """
    offsets = sorted({o for os in wanted.values() for o in os if any(o)})
    if not offsets:
        return df
    names = [c for c in df.columns if c not in axes]
    home = [F.struct(*(F.col(x).alias(x) for x in axes), F.lit(-1).alias("point"))]
    sent = [F.struct(*((F.col(x) - o[a]).cast("int").alias(x) for a, x in enumerate(axes)), F.lit(k).alias("point")) for k, o in enumerate(offsets)]
    is_home = F.col("to.point") == -1
    # Sent copies carry only what is wanted there.
    spread = df.withColumn("to", F.explode(F.array(*home, *sent))).select("to", *(F.col(f"`{c}`") if any(any(o) for o in wanted.get(c, ())) else F.when(is_home, F.col(f"`{c}`")).alias(c) for c in names))
    out = [F.max(F.when(is_home, F.lit(True))).alias("__home")] + [F.max_by(F.col(f"`{c}`"), is_home).alias(c) for c in names]
    for c, os in wanted.items():
        for o in sorted(os):
            if any(o):
                at = F.col("to.point") == offsets.index(o)
                out.append(F.max_by(F.when(at, F.col(f"`{c}`")), F.when(at, F.lit(1))).alias(name_of(c, o)))
    grouped = spread.groupBy(*(F.col(f"to.{x}").alias(x) for x in axes)).agg(*out)
    return grouped.where("__home").drop("__home")


def tile_sizes(sizes: tuple[int, ...], reach: tuple[int, ...], most: int = 1 << 18) -> tuple[int, ...]:
    """Extents of a tile: of about ``most`` cells, cut along the last axes first, as they are stored, and
    never thinner than what is borrowed from a neighbour."""
    out = list(sizes)
    while prod(out) > most:
        for a in reversed(range(len(out))):
            if (half := -(-out[a] // 2)) >= max(16, 2 * reach[a]) and half < out[a]:
                out[a] = half
                break
        else:
            break
    return tuple(out)


def _crossed(tiles: Column, here: Column, n: int) -> Column:
    """Numbers of tiles over one axis more, which has ``n`` tiles."""
    return F.flatten(F.transform(tiles, lambda k: F.transform(here, lambda x: k * n + x)))


def by_tile(df: DataFrame, axes: tuple[str, ...], wanted: dict[str, set[tuple[int, ...]]], box: tuple[tuple[int, int], ...], most: int = 1 << 18) -> DataFrame:
    """The same in tiles of a box, which holds all coordinates. A task holds one tile and its borders."""
    offsets = sorted({o for os in wanted.values() for o in os if any(o)})
    if not offsets:
        return df
    sizes = tuple(high - low for low, high in box)
    reach = tuple(max(abs(o[a]) for o in offsets) for a in range(len(axes)))
    tile = tile_sizes(sizes, reach, most)
    counts = tuple(-(-n // t) for n, t in zip(sizes, tile, strict=True))
    to = F.array(F.lit(0).cast("long"))
    for axis, (low, _), t, r, n in zip(axes, box, tile, reach, counts, strict=True):
        at = F.col(axis) - low
        own, within = F.floor(at / t), at % t
        near = [own, *([F.when((within < r) & (own > 0), own - 1), F.when((within >= t - r) & (own < n - 1), own + 1)] if r and n > 1 else [])]
        here = F.filter(F.array(*near), lambda x: x.isNotNull())
        to = _crossed(to, here, n)
    sent = df.withColumn("__tile", F.explode(to))
    names = df.columns
    new = [(name_of(c, o), c, o) for c, os in wanted.items() for o in sorted(os) if any(o)]

    def run(table: pa.Table) -> pa.Table:
        k = table.column("__tile")[0].as_py()
        corner = []
        for n in reversed(counts):
            k, c = divmod(k, n)
            corner.append(c)
        begin = [low + c * t for (low, _), c, t in zip(box, reversed(corner), tile, strict=True)]
        shape = [t + 2 * r for t, r in zip(tile, reach, strict=True)]
        at = [table.column(x).to_numpy().astype(np.int64) - b + r for x, b, r in zip(axes, begin, reach, strict=True)]
        inside = np.ones(table.num_rows, bool)
        for x, t, r in zip(at, tile, reach, strict=True):
            inside &= (x >= r) & (x < r + t)
        rows = np.full(prod(shape), -1, np.int64)
        rows[np.ravel_multi_index(at, shape)] = np.arange(table.num_rows)
        home = np.flatnonzero(inside)
        mine = np.ravel_multi_index([x[home] for x in at], shape)
        steps = [prod(shape[a + 1 :]) for a in range(len(shape))]
        found = {}
        for o in offsets:  # borders are as wide as the offsets, so no index wraps around
            row = rows[mine + sum(x * s for x, s in zip(o, steps, strict=True))]
            found[o] = pa.array(row, mask=row < 0)
        own = table.select(names).take(pa.array(home))
        for name, c, o in new:
            own = own.append_column(name, table.column(c).take(found[o]))
        return own

    schema = StructType([*df.schema.fields, *(StructField(name, df.schema[c].dataType, True) for name, c, _ in new)])
    return sent.groupBy("__tile").applyInArrow(run, schema)


#: The column that has a cell's slab, in tables that are dealt.
SLAB = "__slab"


@dataclass(frozen=True)
class Slabs:
    """A block cut along an axis: slab k begins at ``low + k * height``; the first and the last also have
    what lies beyond. ``parts`` slabs are as many buckets."""

    axis: str
    low: int
    height: int
    parts: int

    def of(self, at: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.floor((at - self.low) / self.height), F.lit(self.parts - 1))).cast("int")

    def borders(self, df: DataFrame, columns: list[str], rest: list[str], behind: int, ahead: int) -> DataFrame:
        """For each slab and line the rows of other slabs within reach of it, as a map from coordinates."""
        x, k = F.col(self.axis), F.col(SLAB)
        down = (k > 0) & (x < self.low + k * self.height + ahead)
        up = (k < self.parts - 1) & (x >= self.low + (k + 1) * self.height - behind)
        to = F.filter(F.array(F.when(down, k - 1), F.when(up, k + 1)), lambda s: s.isNotNull())
        sent = df.where(down | up).select(F.explode(to).alias(SLAB), *rest, F.struct(x.alias("at"), F.struct(*(F.col(f"`{c}`").alias(c) for c in columns)).alias("v")).alias("e"))
        # At most ``behind + ahead`` rows of a line meet.
        return sent.repartition(self.parts, SLAB).groupBy(SLAB, *rest).agg(F.map_from_entries(F.collect_list("e")).alias("__border"))


def by_slab(df: DataFrame, axes: tuple[str, ...], wanted: dict[str, set[tuple[int, ...]]], slabs: Slabs) -> DataFrame:
    """The same of a table that is dealt into slabs, which has all its columns still where they were."""
    d = axes.index(slabs.axis)
    order = [d, *(a for a in range(len(axes)) if a != d)]
    only = lambda o, n: tuple(x if a in order[:n] else 0 for a, x in enumerate(o))
    along = sorted({(c, only(o, 1)) for c, os in wanted.items() for o in os if o[d]})
    rest = [x for x in axes if x != slabs.axis]
    if along:
        steps = [o[d] for _, o in along]
        behind, ahead = max(0, -min(steps)), max(0, *steps)
        if max(behind, ahead) > slabs.height:
            raise ValueError(f"slabs of {slabs.height} along {slabs.axis} are thinner than a stencil that reaches {max(behind, ahead)}")
        border = slabs.borders(df, sorted({c for c, _ in along}), rest, behind, ahead)
        window = Window.partitionBy(SLAB, *rest).orderBy(slabs.axis)
        df = df.join(border.hint("shuffle_hash"), [SLAB, *rest], "left")
        beyond = lambda c, n: F.element_at("__border", F.col(slabs.axis) + n)[c]
        df = df.withColumns({name_of(c, o): F.coalesce(F.lead(F.col(f"`{c}`"), o[d]).over(window), beyond(c, o[d])) for c, o in along}).drop("__border")
    for n, a in enumerate(order[1:], 1):
        window = Window.partitionBy(SLAB, *(x for x in axes if x != axes[a])).orderBy(axes[a])
        own = sorted({(c, o) for c, os in wanted.items() for o in os if o[a]}, key=str)
        new = {name_of(c, only(o, n + 1)): F.lead(F.col(f"`{name_of(c, only(o, n))}`"), o[a]).over(window) for c, o in own}
        if new:
            df = df.withColumns(new)
    return df


#: A grid of at most so many cells is gathered by windows, however few lines it has.
FEW_CELLS = 200_000


def gather(df: DataFrame, axes: tuple[str, ...], wanted: dict[str, set[tuple[int, ...]]], box: tuple[tuple[int, int], ...] = ()) -> DataFrame:
    """By key along a single axis; by tiles on a large grid (if its box is known) that has fewer lines along
    an axis that is wanted than there are partitions; by windows otherwise."""
    if len(axes) == 1:
        return by_key(df, axes, wanted)
    sizes = [high - low for low, high in box]
    used = {a for os in wanted.values() for o in os for a, x in enumerate(o) if x}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if sizes and prod(sizes) > FEW_CELLS and any(prod(sizes) // sizes[a] < parts for a in used):
        return by_tile(df, axes, wanted, box)
    return by_window(df, axes, wanted)
