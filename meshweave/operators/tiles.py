"""Loops with array kernels on dense tiles, which send only their borders.

A grid is cut into tiles; a tile is one row that holds a NumPy block of each field. Tiles lie in a table
that is bucketed by tile, so they stay where they are: a round joins them with the borders of their
neighbours, and only these are shuffled. A run does several loops several times in one round. It borrows
as many cells as all of them together reach, and computes cells of its neighbours again, fewer after each
loop; so the cells sent are those of the tiles' surfaces, once for ``depth`` steps.

Kernels are those of :meth:`Mesh.loop`: ``u[1, 0]`` is the neighbour in the first axis, ``v[2, 1, 0]`` of
component 2. But here it is an array over the cells of the loop, so a kernel can do with it what NumPy can,
also loops whose length depends on the values, which no column expresses. Arithmetic alone is the same
source for both. Reads see the state before the loop. Boxes have to leave room for the stencils.

A task holds one tile with its borders at a time. Blocks have the field's own type (half precision, too).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import product
from math import prod
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import AXES, INC, MAX, MIN, READ, RW, TYPES, Block, Box, Field, MeshError, box_of, box_size
from ..plans.grid import inside
from ..sources.shared import discard, stored_by
from .loop import Dat, Gbl, Idx, Mesh, Opt, Reduce
from .reduction import Folds, Reduction, identity

#: NumPy's types for Spark's.
KINDS = {"double": "f8", "float": "f4", "int": "i4", "smallint": "i2", "tinyint": "i1", "bigint": "i8", "boolean": "?"}


def kind_of(f: Field) -> np.dtype:
    spark = TYPES[f.dtype]
    if spark not in KINDS:
        raise MeshError(f"{f.name}: tiles hold no {f.dtype}")
    return np.dtype("f2" if f.dtype == "half" else KINDS[spark])


class Cells:
    """A field within an array kernel."""

    def __init__(self, dat: Dat, whole: np.ndarray, region: tuple[slice, ...]):
        self.dat, self.whole, self.region, self.new = dat, whole, region, {}

    def _split(self, key: Any) -> tuple[int, tuple[int, ...]]:
        key = key if isinstance(key, tuple) else (key,)
        many = self.dat.field.dim > 1
        component, offset = (key[0], key[1:]) if many else (0, key)
        if tuple(offset) not in self.dat.stencil.points:
            raise MeshError(f"{self.dat.field.name}{list(offset)} is not in stencil {self.dat.stencil.name}")
        if not 0 <= component < self.dat.field.dim:
            raise MeshError(f"{self.dat.field.name} has no component {component}")
        return component, tuple(offset)

    def __getitem__(self, key: Any) -> np.ndarray:
        component, offset = self._split(key)
        if not any(offset) and component in self.new:
            return self.new[component]
        at = tuple(slice(s.start + o, s.stop + o) for s, o in zip(self.region, offset, strict=True))
        found = self.whole[component][at]
        return found.astype(np.float32) if found.dtype == np.float16 else found

    def __setitem__(self, key: Any, value: Any) -> None:
        component, offset = self._split(key)
        if self.dat.access == READ or any(offset):
            raise MeshError(f"{self.dat.field.name}{list(offset)} cannot be written with {self.dat.access}")
        self.new[component] = value

    def add(self, value: Any, component: int = 0) -> None:
        self.new[component] = self.new.get(component, self.whole[component][self.region]) + value


class Folding:
    """A reduction within an array kernel: it folds the cells of the tile itself, not those borrowed."""

    def __init__(self, arg: Reduce, own: tuple[slice, ...], shape: tuple[int, ...]):
        self.arg, self.own, self.shape = arg, own, shape
        self.found = [identity(arg.access, arg.handle.dtype)] * arg.handle.dim

    def add(self, value: Any, component: int = 0) -> None:
        value = np.broadcast_to(value, self.shape)[self.own]
        if value.size:
            fold = {INC: np.add, MIN: np.fmin, MAX: np.fmax}[self.arg.access]
            more = fold.reduce(value, axis=None)
            if not np.isnan(more) or self.arg.access == INC:
                self.found[component] = fold(self.found[component], more).item()


@dataclass
class TileLoop:
    """One loop of a run."""

    name: str
    box: Box
    kernel: Callable[..., None]
    args: dict[str, Any]
    handles: list[Reduce] = field(default_factory=list)

    @property
    def dats(self) -> list[Dat]:
        return [a for a in self.args.values() if isinstance(a, Dat)]

    def reach(self, axis: int) -> int:
        return max((abs(p[axis]) for d in self.dats for p in d.stencil.points), default=0)


@dataclass
class Grid:
    """How a box is cut: along each axis into ``counts`` parts of nearly equal size."""

    box: Box
    counts: tuple[int, ...]

    def parts(self, axis: int, k: int) -> tuple[int, int]:
        low, high = self.box[axis]
        return low + (high - low) * k // self.counts[axis], low + (high - low) * (k + 1) // self.counts[axis]

    def place(self, tile: int) -> tuple[int, ...]:
        out = []
        for n in reversed(self.counts):
            tile, k = divmod(tile, n)
            out.append(k)
        return tuple(reversed(out))

    def number(self, place: tuple[int, ...]) -> int:
        out = 0
        for n, k in zip(self.counts, place, strict=True):
            out = out * n + k
        return out

    def bounds(self, tile: int) -> Box:
        return tuple(self.parts(a, k) for a, k in enumerate(self.place(tile)))

    def near(self, tile: int, used: tuple[bool, ...]) -> Iterator[tuple[tuple[int, ...], int]]:
        """The neighbours of a tile and which way they are."""
        at = self.place(tile)
        for way in product(*((-1, 0, 1) if u else (0,) for u in used)):
            to = tuple(a + w for a, w in zip(at, way, strict=True))
            if any(way) and all(0 <= t < n for t, n in zip(to, self.counts, strict=True)):
                yield way, self.number(to)

    def strip(self, tile: int, way: tuple[int, ...], width: tuple[int, ...]) -> Box:
        """The cells of a tile that the neighbour ``way`` of it borrows."""
        return tuple((lo, hi) if not w else (lo, lo + r) if w < 0 else (hi - r, hi) for (lo, hi), w, r in zip(self.bounds(tile), way, width, strict=True))


def _at(box: Box, origin: tuple[int, ...]) -> tuple[slice, ...]:
    return tuple(slice(lo - o, hi - o) for (lo, hi), o in zip(box, origin, strict=True))


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


@dataclass
class Tiles:
    """Fields of one size on a block, in tiles."""

    spark: SparkSession
    block: Block
    size: tuple[int, ...]
    tile: tuple[int, ...]
    base: tuple[int, ...] = ()
    buckets: int = 0
    fields: dict[str, Field] = field(default_factory=dict)
    table: DataFrame | None = None
    width: tuple[int, ...] = ()  # of the borders that the table has ready

    def __post_init__(self) -> None:
        base = self.base or (0,) * self.block.dims
        if len(self.size) != self.block.dims or len(self.tile) != self.block.dims or min(*self.size, *self.tile) < 1:
            raise MeshError(f"tiles of {self.block.name}: a size and a tile's size for each of {self.block.dims} axes are needed")
        self.grid = Grid(tuple((b, b + n) for b, n in zip(base, self.size, strict=True)), tuple(max(1, n // t) for n, t in zip(self.size, self.tile, strict=True)))
        self.width = (0,) * self.block.dims
        # Tiles are dealt by hash: with as many buckets as tiles, those that get several are done beside others.
        self.buckets = self.buckets or min(prod(self.grid.counts), 4 * max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        if self.spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # a row is large
            self.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
            self.spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))

    def _schema(self, names: list[str]) -> str:
        return "tile long, " + "".join(f"`{n}` binary, " for n in names) + "edges array<struct<to:long,way:int,cells:binary>>, folds array<struct<step:int,handle:string,component:int,value:double>>"

    # fields

    def field(self, name: str, dtype: str = "double", dim: int = 1, values: DataFrame | None = None) -> Field:
        """Declares a field of zeros, or of the values (coordinates and a column of its name) where there are some."""
        if name in self.fields:
            raise MeshError(f"field {name} exists already on block {self.block.name}")
        f = Field(self.block, name, self.size, self.base or (0,) * self.block.dims, dim=dim, dtype=dtype)
        kind_of(f)
        self.fields[name] = f
        if values is not None:
            self._fill(f, values)
        return f

    def from_mesh(self, mesh: Mesh, *fields: Field) -> list[Field]:
        """Fields of a mesh (their interior) under their names."""
        for f in fields:
            if f.block != self.block or f.size != self.size or f.base != (self.base or (0,) * self.block.dims):
                raise MeshError(f"{f.name} does not cover these tiles")
        return [self.field(f.name, f.dtype, f.dim, mesh.table(f)) for f in fields]

    def _fill(self, f: Field, values: DataFrame) -> None:
        """Cells go to their tiles once. A tile without any stays away, and is all zeros."""
        axes, grid, kind = self.block.axes, self.grid, kind_of(f)
        number = F.lit(0).cast("long")
        for a, x in enumerate(axes):
            low, high = grid.box[a]
            # The part k that begins at or before the coordinate: low + n k div counts <= x.
            number = number * grid.counts[a] + F.floor(((F.col(x).cast("long") - low + 1) * grid.counts[a] - 1) / (high - low)).cast("long")

        def run(table: pa.Table) -> pa.Table:
            tile = table.column("tile")[0].as_py()
            bounds = grid.bounds(tile)
            block = np.zeros((f.dim, *(hi - lo for lo, hi in bounds)), kind)
            at = tuple(table.column(x).to_numpy() - lo for x, (lo, _) in zip(axes, bounds, strict=True))
            v = table.column("v").combine_chunks()
            block[(slice(None), *at)] = (v.flatten() if f.dim > 1 else v).to_numpy(zero_copy_only=False).reshape(-1, f.dim).T
            return pa.table({"tile": pa.array([tile]), f.name: pa.array([_bytes(block)], pa.binary())})

        kept = values.where(inside(grid.box, axes)).select(number.alias("tile"), *(F.col(x).cast("int").alias(x) for x in axes), F.col(f"`{f.name}`").cast(f.spark_type).alias("v"))
        blocks = kept.where(F.col("v").isNotNull()).repartition(self.buckets, "tile").groupBy("tile").applyInArrow(run, f"tile long, `{f.name}` binary")
        self._keep(self._all().drop(f.name).join(blocks, "tile", "left"))
        self.width = (0,) * self.block.dims

    def _all(self) -> DataFrame:
        """The table; at first only the tiles' numbers. A null block is zeros."""
        if self.table is not None:
            return self.table.drop("edges", "folds")
        return self.spark.range(prod(self.grid.counts)).select(F.col("id").alias("tile")).repartition(self.buckets, "tile")

    def _keep(self, df: DataFrame) -> None:
        before, self.table = self.table, stored_by(df, "tiles", "tile", self.buckets)
        if before is not None:
            discard(before)

    def cells(self, *names: str) -> DataFrame:
        """Coordinates and values of fields, a row for each cell; a batch for each tile."""
        fields = [self.fields[n] for n in names or self.fields]
        grid, axes, kinds = self.grid, self.block.axes, [kind_of(f) for f in fields]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    bounds = grid.bounds(batch.column(0)[row].as_py())
                    shape = tuple(hi - lo for lo, hi in bounds)
                    at = [pa.array(np.ascontiguousarray(np.broadcast_to(np.arange(lo, hi, dtype=np.int32).reshape(tuple(-1 if b == a else 1 for b in range(len(shape)))), shape)).ravel()) for a, (lo, hi) in enumerate(bounds)]
                    out = []
                    for k, (f, kind) in enumerate(zip(fields, kinds, strict=True)):
                        raw = batch.column(k + 1)[row].as_buffer()
                        v = np.frombuffer(raw, kind) if raw is not None else np.zeros(f.dim * prod(shape), kind)
                        v = v.astype(np.float32) if kind == np.float16 else v
                        out.append(pa.array(v) if f.dim == 1 else pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, f.dim, dtype=np.int32)), pa.array(np.ascontiguousarray(v.reshape(f.dim, -1).T).ravel())))
                    yield pa.RecordBatch.from_arrays([*at, *out], [*axes, *(f.name for f in fields)])

        table = self._all()
        read = [F.col(f"`{f.name}`") if f.name in table.columns else F.lit(None).cast("binary").alias(f.name) for f in fields]
        return table.select("tile", *read).mapInArrow(run, ", ".join([*(f"{x} int" for x in axes), *(f"`{f.name}` {f.spark_type}" for f in fields)]))

    # loops

    def loop(self, name: str, box: Any, kernel: Callable[..., None], **args: Any) -> TileLoop:
        """A loop over a half-open box, for :meth:`run`. Kernels get arrays; an index is an open grid of them."""
        box = box_of(box)
        if len(box) != self.block.dims:
            raise MeshError(f"loop {name}: a range for each of {self.block.dims} axes is needed")
        args = {k: a.arg if isinstance(a, Opt) and a.flag else None if isinstance(a, Opt) else a for k, a in args.items()}
        made = TileLoop(name, box, kernel, args)
        for d in made.dats:
            if self.fields.get(d.field.name) != d.field:
                raise MeshError(f"loop {name}: {d.field.name} is not on these tiles")
            if d.access not in (READ, RW) and len(d.stencil.points) > 1:
                raise MeshError(f"loop {name}: {d.field.name} is written with the {len(d.stencil.points)}-point stencil {d.stencil.name}")
            for a, ((lo, hi), (low, high)) in enumerate(zip(box, self.grid.box, strict=True)):
                if box_size(box) and any(lo + p[a] < low or hi + p[a] > high for p in d.stencil.points):
                    raise MeshError(f"loop {name}: {d.field.name} is read outside of its cells along {AXES[a]}")
        for r in args.values():
            if isinstance(r, Reduce) and r.access not in (INC, MIN, MAX):
                raise MeshError(f"loop {name}: tiles reduce with {INC}, {MIN} and {MAX}")
            if isinstance(r, Reduce):
                r.handle.check(r.access)
        made.handles = [r for r in args.values() if isinstance(r, Reduce)]
        return made

    def run(self, loops: list[TileLoop], steps: int = 1, depth: int = 8, fold_all: bool = False) -> None:
        """The loops one after the other, ``steps`` times; borders move once for ``depth`` steps.

        Reductions get the last step (in others a kernel has None for them), or with ``fold_all`` every step.
        """
        reach = tuple(sum(x.reach(a) for x in loops) for a in range(self.block.dims))
        for a, (r, n) in enumerate(zip(reach, self.grid.counts, strict=True)):
            if n > 1 and r:
                least = min(hi - lo for lo, hi in (self.grid.parts(a, k) for k in range(n)))
                if least < r:
                    raise MeshError(f"tiles of {least} cells along {AXES[a]} are thinner than the {r} cells that a step reaches")
                depth = min(depth, least // r)
        done = 0
        while done < steps:
            now = min(depth, steps - done)
            after = min(depth, steps - done - now) or now
            self._round(loops, done, now, steps, tuple(r * now for r in reach), tuple(r * after for r in reach), fold_all)
            done += now

    def borders(self) -> DataFrame:
        """What the tiles send: for each tile the cells that its neighbours have for it."""
        sent = self.table.select(F.explode("edges").alias("e")).select(F.col("e.to").alias("tile"), F.struct("e.way", "e.cells").alias("b"))
        return sent.repartition(self.buckets, "tile").groupBy("tile").agg(F.collect_list("b").alias("borders"))

    def joined(self) -> DataFrame:
        """Each tile with the borders of its neighbours; the tiles stay where they are."""
        blocks = self.table.drop("edges", "folds")
        if not any(self.width):
            return blocks.withColumn("borders", F.lit(None).cast("array<struct<way:int,cells:binary>>"))
        return blocks.join(self.borders().hint("shuffle_hash"), "tile", "left")

    def _round(self, loops: list[TileLoop], done: int, now: int, steps: int, width: tuple[int, ...], after: tuple[int, ...], fold_all: bool) -> None:
        if self.table is None:
            self._keep(self._all())
        if any(w > s for w, s in zip(width, self.width, strict=True)):
            self._advance([], 0, 0, 0, (0,) * self.block.dims, width, False)  # only cuts the borders
        folds = self._advance(loops, done, now, steps, width, after, fold_all)
        handles = {r.handle.name: r for x in loops for r in x.handles}
        if handles and (fold_all or done + now == steps):
            self._fold(folds, handles)

    def _advance(self, loops: list[TileLoop], done: int, now: int, steps: int, width: tuple[int, ...], after: tuple[int, ...], fold_all: bool) -> DataFrame:
        # Handles stay on the driver: tasks get their names and kinds.
        loops = [TileLoop(x.name, x.box, x.kernel, {k: Reduce(Reduction(a.handle.name, a.handle.dim, a.handle.dtype), a.access) if isinstance(a, Reduce) else a for k, a in x.args.items()}) for x in loops]
        names = list(self.fields)
        fields, grid, ready = [self.fields[n] for n in names], self.grid, self.width
        kinds = [kind_of(f) for f in fields]
        dims = self.block.dims

        def load(tile: int, blocks: list[Any], borders: Any) -> tuple[list[np.ndarray], tuple[int, ...]]:
            """The fields over a tile and what it borrows."""
            bounds = grid.bounds(tile)
            over = tuple((max(low, lo - w), min(high, hi + w)) for (lo, hi), (low, high), w in zip(bounds, grid.box, width, strict=True))
            origin, shape = tuple(lo for lo, _ in over), tuple(hi - lo for lo, hi in over)
            own = tuple(hi - lo for lo, hi in bounds)
            whole = []
            for f, kind, raw in zip(fields, kinds, blocks, strict=True):
                block = np.zeros((f.dim, *shape), kind)
                if raw is not None:
                    block[(slice(None), *_at(bounds, origin))] = np.frombuffer(raw, kind).reshape(f.dim, *own)
                whole.append(block)
            if any(width) and borders.is_valid:
                ways = list(product((-1, 0, 1), repeat=dims))
                for b in borders:
                    way, raw = ways[b["way"].as_py()], b["cells"].as_buffer()
                    sender = grid.number(tuple(k - w for k, w in zip(grid.place(tile), way, strict=True)))
                    box, at = grid.strip(sender, way, ready), 0
                    kept = tuple((max(lo, o), min(hi, o + n)) for (lo, hi), o, n in zip(box, origin, shape, strict=True))
                    cells = tuple(hi - lo for lo, hi in box)
                    for f, kind, block in zip(fields, kinds, whole, strict=True):
                        n = f.dim * prod(cells)
                        got = np.frombuffer(raw, kind, n, at).reshape(f.dim, *cells)
                        block[(slice(None), *_at(kept, origin))] = got[(slice(None), *_at(kept, tuple(lo for lo, _ in box)))]
                        at += n * kind.itemsize
            return whole, origin

        def step(tile: int, whole: list[np.ndarray], origin: tuple[int, ...], k: int, used: list[int], folds: list[tuple]) -> None:
            bounds, by_name = grid.bounds(tile), dict(zip(names, whole, strict=True))
            for x in loops:
                for a in range(dims):
                    used[a] += x.reach(a)
                region = tuple((max(lo - (w - u), low), min(hi + (w - u), high)) for (lo, hi), (low, high), w, u in zip(bounds, x.box, width, used, strict=True))
                if any(hi <= lo for lo, hi in region):
                    continue
                shape, at = tuple(hi - lo for lo, hi in region), _at(region, origin)
                own = _at(tuple((max(lo, b), max(min(hi, e), max(lo, b))) for (lo, hi), (b, e) in zip(region, bounds, strict=True)), tuple(lo for lo, _ in region))
                given: dict[str, Any] = {}
                for n, arg in x.args.items():
                    if isinstance(arg, Dat):
                        given[n] = Cells(arg, by_name[arg.field.name], at)
                    elif isinstance(arg, Reduce):
                        given[n] = Folding(arg, own, shape) if fold_all or done + k + 1 == steps else None
                    elif isinstance(arg, Idx):
                        given[n] = [np.arange(lo, hi).reshape(tuple(-1 if b == a else 1 for b in range(dims))) for a, (lo, hi) in enumerate(region)]
                    else:
                        given[n] = arg.value if isinstance(arg, Gbl) else arg
                x.kernel(**given)
                news = [(v.whole[c], np.array(new) if isinstance(new, np.ndarray) and new.base is not None else new) for v in given.values() if isinstance(v, Cells) for c, new in v.new.items()]
                for old, new in news:
                    old[at] = new
                folds += [(done + k, v.arg.handle.name, c, float(found)) for v in given.values() if isinstance(v, Folding) for c, found in enumerate(v.found)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("tile", pa.int64()), *((n, pa.binary()) for n in names), ("edges", pa.list_(pa.struct([("to", pa.int64()), ("way", pa.int32()), ("cells", pa.binary())]))), ("folds", pa.list_(pa.struct([("step", pa.int32()), ("handle", pa.string()), ("component", pa.int32()), ("value", pa.float64())])))])
            ways = {w: k for k, w in enumerate(product((-1, 0, 1), repeat=dims))}
            for batch in batches:
                for row in range(batch.num_rows):
                    tile = batch.column(0)[row].as_py()
                    whole, origin = load(tile, [batch.column(k + 1)[row].as_buffer() for k in range(len(names))], batch.column(len(names) + 1)[row])
                    used, folds = [0] * dims, []
                    for k in range(now):
                        step(tile, whole, origin, k, used, folds)
                    bounds = grid.bounds(tile)
                    edges = []
                    for way, to in grid.near(tile, tuple(bool(w) for w in after)):
                        at = (slice(None), *_at(grid.strip(tile, way, after), origin))
                        edges.append({"to": to, "way": ways[way], "cells": b"".join(_bytes(x[at]) for x in whole)})
                    own = (slice(None), *_at(bounds, origin))
                    told = [dict(zip(("step", "handle", "component", "value"), x, strict=True)) for x in folds]
                    yield pa.RecordBatch.from_pylist([{"tile": tile, **{n: _bytes(x[own]) for n, x in zip(names, whole, strict=True)}, "edges": edges, "folds": told}], schema)

        table = self.joined()
        blocks = [F.col(f"`{n}`") if n in table.columns else F.lit(None).cast("binary").alias(n) for n in names]
        self._keep(table.select("tile", *blocks, "borders").mapInArrow(run, self._schema(names)))
        self.width = after
        return self.table.select(F.explode("folds").alias("f")).select("f.*")

    def _fold(self, folds: DataFrame, handles: dict[str, Reduce]) -> None:
        """Adds a round's folds to the handles, a few numbers each."""
        rows = folds.groupBy("handle", "component").agg(F.sum("value").alias(INC), F.min("value").alias(MIN), F.max("value").alias(MAX)).collect()
        found = {(r["handle"], r["component"]): r for r in rows}
        for name, r in handles.items():
            names, kind = [f"{name}_{c}" for c in range(r.handle.dim)], TYPES[r.handle.dtype]
            values = [found[name, c][r.access] if (name, c) in found else identity(r.access, r.handle.dtype) for c in range(r.handle.dim)]
            frame = self.spark.range(1).select(*(F.lit(v).cast(kind).alias(n) for n, v in zip(names, values, strict=True)))
            r.handle.add(Folds(frame), names, r.access)
