"""Box loops over fields: gather neighbours, evaluate a kernel of columns, write and reduce.

A :class:`Mesh` keeps the fields of equal index set as columns of one wide table, so loops over them
need no join. A loop is planned, not run: it replaces tables by lazier ones, and only reductions that
are read out, fetches and writes run anything.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import AXES, INC, MAX, MIN, READ, RW, TYPES, WRITE, Block, Box, Field, LoopRecord, MeshError, Stencil, box_of, box_size
from ..plans.grid import index_set, inside
from ..sources.shared import stored, stored_by
from .gather import SLAB, Slabs, by_slab, gather, name_of
from .reduction import Folds, Reduction, folded, identity

#: A table of at most this many cells may be sent to all executors in a join.
MOST_SENT = 200_000
#: A slab has about this many cells at most, as it is one task's; slabs are not made thinner than this many rows.
MOST_DEALT, LEAST_ROWS = 1 << 18, 64


@dataclass(frozen=True)
class Dat:
    """A field argument."""

    field: Field
    stencil: Stencil
    access: str


@dataclass(frozen=True)
class Gbl:
    """A value (or list of values) that is the same for all cells, as it is when the loop is planned."""

    value: Any


@dataclass(frozen=True)
class Idx:
    """The coordinates, as a list of columns."""


@dataclass(frozen=True)
class Reduce:
    handle: Reduction
    access: str


@dataclass(frozen=True)
class Opt:
    """An argument that is left out if the flag is off; the kernel then gets None."""

    arg: Any
    flag: bool


def read(f: Field, stencil: Stencil | None = None) -> Dat:
    return Dat(f, stencil or Stencil.point(f.block.dims), READ)


def write(f: Field, stencil: Stencil | None = None) -> Dat:
    return Dat(f, stencil or Stencil.point(f.block.dims), WRITE)


def rw(f: Field, stencil: Stencil | None = None) -> Dat:
    return Dat(f, stencil or Stencil.point(f.block.dims), RW)


def inc(f: Field) -> Dat:
    return Dat(f, Stencil.point(f.block.dims), INC)


class View:
    """A field within a kernel: ``u[1, 0]`` is a neighbour, ``v[2, 1, 0]`` component 2 of one."""

    def __init__(self, dat: Dat):
        self.dat, self.new = dat, {}

    def _split(self, key: Any) -> tuple[int, tuple[int, ...]]:
        key = key if isinstance(key, tuple) else (key,)
        many = self.dat.field.dim > 1
        component, offset = (key[0], key[1:]) if many else (0, key)
        if tuple(offset) not in self.dat.stencil.points:
            raise MeshError(f"{self.dat.field.name}{list(offset)} is not in stencil {self.dat.stencil.name}")
        if not 0 <= component < self.dat.field.dim:
            raise MeshError(f"{self.dat.field.name} has no component {component}")
        return component, tuple(offset)

    def _old(self, component: int, offset: tuple[int, ...]) -> Column:
        column = F.col(f"`{_column(self.dat, offset)}`")
        return F.get(column, component) if self.dat.field.dim > 1 else column

    def __getitem__(self, key: Any) -> Column:
        component, offset = self._split(key)
        if not any(offset) and component in self.new:
            return self.new[component]
        return self._old(component, offset)

    def __setitem__(self, key: Any, value: Any) -> None:
        component, offset = self._split(key)
        if self.dat.access == READ or any(offset):
            raise MeshError(f"{self.dat.field.name}{list(offset)} cannot be written with {self.dat.access}")
        self.new[component] = value if isinstance(value, Column) else F.lit(value)

    def add(self, value: Any, component: int = 0) -> None:
        """What INC, MIN or MAX folds in."""
        value = value if isinstance(value, Column) else F.lit(value)
        if self.dat.access == INC and not self.dat.field.degenerate:
            value = self.new.get(component, self._old(component, (0,) * self.dat.field.block.dims)) + value
        self.new[component] = value


class ReduceView:
    def __init__(self, arg: Reduce):
        self.arg, self.new = arg, {}

    def add(self, value: Any, component: int = 0) -> None:
        value = value if isinstance(value, Column) else F.lit(value)
        if component in self.new and self.arg.access != WRITE:
            old = self.new[component]
            value = old + value if self.arg.access == INC else (F.least if self.arg.access == MIN else F.greatest)(old, value)
        self.new[component] = value


def _column(dat: Dat, offset: tuple[int, ...]) -> str:
    """Where the gathered neighbour of an argument is found."""
    if dat.stencil.kind != "regular":
        return f"{dat.field.name}@{dat.stencil.kind}{'_'.join(map(str, offset))}"
    return name_of(dat.field.name, offset if not dat.field.degenerate else tuple(o if a in dat.field.kept else 0 for a, o in enumerate(offset)))


@dataclass
class Mesh:
    """The fields of a program, their tables, constants and reductions."""

    spark: SparkSession
    cut_every: int = 4
    profile: bool = False  # run each loop when it is planned, and time it
    tables: dict[tuple, DataFrame] = field(default_factory=dict)
    fields: dict[tuple[str, str], Field] = field(default_factory=dict)
    blocks: dict[str, Block] = field(default_factory=dict)
    constants: dict[str, Any] = field(default_factory=dict)
    folds: dict[tuple[str, str], str | None] = field(default_factory=dict)
    records: dict[str, LoopRecord] = field(default_factory=dict)
    depth: dict[tuple, int] = field(default_factory=dict)
    slabs: dict[str, Slabs] = field(default_factory=dict)

    # declarations

    def block(self, name: str, dims: int) -> Block:
        return self.blocks.setdefault(name, Block(name, dims))

    @staticmethod
    def key(f: Field) -> tuple:
        return f.block.name, f.kept, tuple(f.allocation[a] for a in f.kept)

    def declare(self, f: Field, values: DataFrame | None = None) -> Field:
        """Registers a field: zero everywhere, or the values (coordinates and a column of its name)
        where there are some."""
        at = (f.block.name, f.name)
        if at in self.fields:
            raise MeshError(f"field {f.name} exists already on block {f.block.name}")
        self.blocks.setdefault(f.block.name, f.block)
        self.fields[at] = f
        key = self.key(f)
        if key not in self.tables:
            self.tables[key] = index_set(self.spark, f.axes, key[2])
            if self._dealt(key):
                self.tables[key] = self._stored(key, self.tables[key])
        if "struct" in f.spark_type:
            zero = F.expr("named_struct('re', 0D, 'im', 0D)").cast(f.spark_type)
        elif f.dim > 1:
            zero = F.array(*[F.lit(0)] * f.dim).cast(f.spark_type)
        else:
            zero = F.lit(False) if f.spark_type == "boolean" else F.lit(0).cast(f.spark_type)
        self.tables[key] = self.tables[key].withColumn(f.name, zero)
        if values is not None:
            self.set_values(f, values)
        return f

    def field(self, block: Block, name: str, size: tuple[int, ...], **more: Any) -> Field:
        values = more.pop("values", None)
        return self.declare(Field(block, name, tuple(size), **more), values)

    def constant(self, name: str, value: Any) -> None:
        """Declares or updates a constant; loops planned before keep the old value."""
        self.constants[name] = value

    # tables

    def table(self, f: Field) -> DataFrame:
        """Coordinates and value of a field over its whole allocation."""
        self.folds.pop((f.block.name, f.name), None)
        return self.tables[self.key(f)].select(*f.axes, F.col(f"`{f.name}`"))

    def assign(self, f: Field, value: Column) -> None:
        """Overwrites a field by an expression over its own table; no join."""
        key = self.key(f)
        self._keep(key, self.tables[key].withColumn(f.name, value.cast(f.spark_type)))

    def deal(self, f: Field, axis: int, parts: int) -> None:
        """Cuts the block of a field into ``parts`` slabs along an axis, or more if the grid is so large that slabs
        would have more than ``MOST_DEALT`` cells. All its tables that have the axis, also
        of fields of another size or declared later, are stored by slab: loops over several of them join
        without a shuffle, and of neighbours only those across slabs move. A slab is one task's.

        The session is told that joins may rest on a part of their keys, here the slab."""
        if axis not in f.kept or not 1 <= parts <= f.size[axis]:
            raise MeshError(f"{f.name} cannot be dealt into {parts} slabs of axis {axis}")
        self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        low, high = f.interior[axis]
        parts = max(parts, min(-(-box_size(tuple(f.allocation[a] for a in f.kept)) // MOST_DEALT), (high - low) // LEAST_ROWS))
        self.slabs[f.block.name] = Slabs(AXES[axis], low, -(-(high - low) // parts), parts)
        for key in self.tables:
            if key[0] == f.block.name and axis in key[1]:
                self.tables[key], self.depth[key] = self._stored(key, self.tables[key].drop(SLAB)), 0

    def _dealt(self, key: tuple) -> Slabs | None:
        """The slabs of a table, if it is dealt."""
        slabs = self.slabs.get(key[0])
        return slabs if slabs and any(AXES[a] == slabs.axis for a in key[1]) else None

    def _stored(self, key: tuple, df: DataFrame) -> DataFrame:
        if not (slabs := self._dealt(key)):
            return stored(df, "mesh")
        if SLAB not in df.columns:
            df = df.withColumn(SLAB, slabs.of(F.col(slabs.axis))).repartition(slabs.parts, SLAB)
        return stored_by(df, "mesh", SLAB, slabs.parts)

    def set_values(self, f: Field, values: DataFrame, only: Box | None = None, cells: int | None = None) -> None:
        """Overwrites a field where ``values`` has rows (within ``only``); other cells stay. ``cells`` is
        how many rows these are at most, if that is known."""
        key = self.key(f)
        new = values.select(*f.axes, F.col(f"`{f.name}`").cast(f.spark_type).alias("__new"), F.lit(True).alias("__hit"))
        if only is not None:
            new = new.where(inside(tuple(only[a] for a in f.kept), f.axes))
        self._put(key, new, {f.name: F.col("__new")}, cells)

    def put(self, f: Field, new: DataFrame, value: Column, cells: int | None = None) -> None:
        """Overwrites a field by ``value`` where ``new`` (coordinates, ``__hit`` and what the value needs)
        has rows."""
        self._put(self.key(f), new, {f.name: value.cast(f.spark_type)}, cells)

    def put_columns(self, key: tuple, new: DataFrame, columns: dict[str, Column], cells: int | None = None) -> None:
        """The same for several fields of a table, which is joined once."""
        for name in columns:
            self.folds.pop((key[0], name), None)
        self._put(key, new, columns, cells)

    def _put(self, key: tuple, new: DataFrame, columns: dict[str, Column], cells: int | None = None) -> None:
        """Changes columns where ``new`` has rows; few rows are sent to where the table lies."""
        axes = tuple(AXES[a] for a in key[1])
        table, on = self.tables[key], list(axes)
        few = cells is not None and cells <= MOST_SENT
        if (slabs := self._dealt(key)) and not few:  # the table stays where it is
            on = [SLAB, *axes]
            if SLAB not in new.columns:
                new = new.withColumn(SLAB, slabs.of(F.col(slabs.axis))).repartition(slabs.parts, SLAB)
        else:
            new = new.drop(SLAB)
        if few:
            new = F.broadcast(new)
        elif cells is not None:  # known to be large, whatever Spark takes the rows of Python for
            new = new.hint("merge")
        joined = table.join(new, on, "left") if axes else table.crossJoin(F.broadcast(new.limit(1)))
        changed = {c: F.when(F.col("__hit"), v).otherwise(F.col(f"`{c}`")) for c, v in columns.items()}
        self._keep(key, joined.withColumns(changed).select(*(F.col(f"`{c}`") for c in table.columns)))

    def _keep(self, key: tuple, df: DataFrame) -> None:
        """Stores a table's new plan; a plan that has grown long is written out and read back."""
        self.depth[key] = self.depth.get(key, 0) + 1
        if self.depth[key] >= self.cut_every:
            df, self.depth[key] = self._stored(key, df), 0
        self.tables[key] = df

    def cut(self, f: Field) -> None:
        """Ends the lineage of a field's table now."""
        key = self.key(f)
        self.tables[key], self.depth[key] = self._stored(key, self.tables[key]), 0

    def free(self, f: Field) -> None:
        """Forgets a field; its table goes with the last field on it."""
        key = self.key(f)
        del self.fields[f.block.name, f.name]
        self.folds.pop((f.block.name, f.name), None)
        self.tables[key] = self.tables[key].drop(f.name)
        if not any(self.key(x) == key for x in self.fields.values()):
            del self.tables[key]

    def catalog(self) -> DataFrame:
        """What is declared: one row for each field."""
        rows = [(f.block.name, f.block.dims, f.name, f.dtype, f.dim, *(str(list(x)) for x in (f.size, f.base, f.below, f.above, f.stride)), f.degenerate) for f in self.fields.values()]
        return self.spark.createDataFrame(rows, "block string, dims int, field string, type string, dim int, size string, base string, below string, above string, stride string, degenerate boolean")

    # loops

    def loop(self, name: str, block: Block, box: Any, kernel: Callable[..., None], **args: Any) -> None:
        """For every cell of a half-open box: ``kernel(**views)``. Cells outside keep their values. A loop
        that writes its table and reduces is run and stored at once, so that it is run only once.

        Within a loop all reads see the state before it. An empty box changes nothing, and adds the
        identity to reductions.
        """
        started = time.perf_counter()
        box = box_of(box)
        if len(box) != block.dims:
            raise MeshError(f"loop {name}: a range for each of {block.dims} axes is needed")
        args = {k: a.arg if isinstance(a, Opt) and a.flag else None if isinstance(a, Opt) else a for k, a in args.items()}
        dats = {k: a for k, a in args.items() if isinstance(a, Dat)}
        for k, d in dats.items():
            if d.access in (WRITE, INC, MIN, MAX) and len(d.stencil.points) > 1:
                raise MeshError(f"loop {name}: {d.field.name} is written with the {len(d.stencil.points)}-point stencil {d.stencil.name}")
            if d.access in (MIN, MAX) and not d.field.degenerate:
                raise MeshError(f"loop {name}: {d.access} needs a field with a collapsed axis")
            if d.field.block.name != block.name and d.stencil.kind == "regular":
                raise MeshError(f"loop {name}: {d.field.name} is on block {d.field.block.name}")
        for a in args.values():
            if isinstance(a, Reduce):
                a.handle.check(a.access)
        cells, home = self._gathered(block, box, list(dats.values()))
        views = {k: View(a) if isinstance(a, Dat) else ReduceView(a) if isinstance(a, Reduce) else [F.col(x) for x in block.axes] if isinstance(a, Idx) else a.value if isinstance(a, Gbl) else a for k, a in args.items()}
        kernel(**views)
        within = inside(box, block.axes)
        own: dict[str, Column] = {}
        others: dict[tuple, dict[str, Column]] = {}
        folds_onto: list[tuple[Dat, dict[int, Column]]] = []
        for k, d in dats.items():
            f, new = d.field, views[k].new
            if not new:
                continue
            if f.degenerate:
                folds_onto.append((d, new))
                continue
            value = self._value(d, new)
            if home == self.key(f):
                own[f.name] = F.when(within, value).otherwise(F.col(f"`{f.name}`"))
            else:
                others.setdefault(self.key(f), {})[f.name] = value
        self._fold_all(block, folds_onto, cells.where(within))
        for key, values in others.items():
            slab = [SLAB] if SLAB in cells.columns and self._dealt(key) else []
            new = cells.where(within).select(*slab, *block.axes, *(v.alias(f"__new_{c}") for c, v in values.items()), F.lit(True).alias("__hit"))
            self._put(key, new, {c: F.col(f"`__new_{c}`") for c in values}, box_size(box))
        handles = {k: a for k, a in args.items() if isinstance(a, Reduce)}
        # What the handles get of each cell, beside the cell's new values: both come of one run.
        given = [F.when(within, v).alias(f"__{k}_{d}") for k in handles for d, v in views[k].new.items()]
        folds = None
        if own:
            names = self.tables[home].columns
            new = cells.select(*(own[c].alias(c) if c in own else F.col(f"`{c}`") for c in names), *given)
            if handles or self.profile:
                new = self._stored(home, new)
                self.tables[home], self.depth[home] = new.select(*(F.col(f"`{c}`") for c in names)), 0
            else:
                self._keep(home, new)
        elif handles:
            new = cells.where(within).select(*block.axes, *given)
        if handles:
            parts = {(k, d): self._part(views[k].new.get(d), F.col(f"`__{k}_{d}`"), a, block) for k, a in handles.items() for d in range(a.handle.dim)}
            folds = Folds(new.agg(*(p.alias(f"{k}_{d}") for (k, d), p in parts.items())))
            for k, a in handles.items():
                a.handle.add(folds, [f"{k}_{d}" for d in range(a.handle.dim)], a.access)
        planned = time.perf_counter() - started
        if self.profile:
            for key in others:
                self.tables[key], self.depth[key] = self._stored(key, self.tables[key]), 0
            if folds:
                folds.row()
        record = self.records.setdefault(name, LoopRecord(name, box))
        record.calls += 1
        record.planned += planned
        record.seconds += time.perf_counter() - started if self.profile else 0.0
        record.bytes += box_size(box) * 8 * sum(d.field.dim * (2 if d.access in (RW, INC) else 1) for d in dats.values())
        record.fields = sorted({d.field.name for d in dats.values()})

    @staticmethod
    def _part(given: Column | None, column: Column, a: Reduce, block: Block) -> Column:
        """A handle's fold of one component; of WRITE the last cell in storage order whose value is not 0."""
        kind = TYPES[a.handle.dtype]
        if kind.startswith("struct"):
            return F.struct(*(F.sum(column[x]).alias(x) for x in ("re", "im")))
        if given is None:
            return F.max(F.lit(identity(a.access, a.handle.dtype)))
        if a.access == WRITE:
            return F.max_by(column, F.when(column != 0, F.struct(*reversed(block.axes))))
        return folded(column, a.access)

    def _value(self, d: Dat, new: dict[int, Column]) -> Column:
        f = d.field
        if f.dim == 1:
            return self._rounded(f, new[0])
        element = f.spark_type[len("array<") : -1]
        old = F.col(f"`{f.name}`")
        return F.array(*((self._rounded(f, new[c]) if c in new else F.get(old, c)).cast(element) for c in range(f.dim)))

    @staticmethod
    def _rounded(f: Field, value: Column) -> Column:
        if f.dtype == "half":
            from ..functions.scalar import to_half

            return to_half(value)
        return value.cast(TYPES[f.dtype])

    def _fold_all(self, block: Block, targets: list[tuple[Dat, dict[int, Column]]], cells: DataFrame) -> None:
        """Folds a loop onto fields with collapsed axes: one group for each kept coordinate. Several targets
        are folded in one pass, by grouping sets, whose result is stored."""
        last = F.struct(*reversed(block.axes))  # of a plain write the last cell in storage order stays

        def parts(n: int) -> list[Column]:
            d, new = targets[n]
            return [(folded(v, d.access) if d.access in (INC, MIN, MAX) else F.max_by(v, last)).alias(f"__fold{n}_{c}") for c, v in new.items()]

        if len(targets) > 1:
            axes = [x for x in block.axes if any(x in d.field.axes for d, _ in targets)]
            sets = list(dict.fromkeys(tuple(d.field.axes) for d, _ in targets))
            grouped = cells.groupingSets([[F.col(x) for x in s] for s in sets], *axes)
            every = stored(grouped.agg(F.grouping_id().alias("__set"), *(p for n in range(len(targets)) for p in parts(n))), "folds")
        for n, (d, new) in enumerate(targets):
            if len(targets) == 1:
                found = cells.groupBy(*d.field.axes).agg(*parts(n))
            else:
                own = sum(1 << k for k, x in enumerate(reversed(axes)) if x not in d.field.axes)
                found = every.where(F.col("__set") == own)
            self._fold(d, new, found.select(*d.field.axes, *(F.col(f"__fold{n}_{c}").alias(f"__fold{c}") for c in new), F.lit(True).alias("__hit")))

    def _fold(self, d: Dat, new: dict[int, Column], found: DataFrame) -> None:
        """Merges a loop's folds into a field."""
        f, at = d.field, (d.field.block.name, d.field.name)
        key, few = self.key(f), box_size(tuple(f.allocation[a] for a in f.kept))
        element = TYPES[f.dtype]
        old = [F.get(F.col(f"`{f.name}`"), c) if f.dim > 1 else F.col(f"`{f.name}`") for c in range(f.dim)]
        whole = lambda parts: F.array(*(p.cast(element) for p in parts)) if f.dim > 1 else parts[0].cast(element)
        if d.access not in (INC, MIN, MAX):
            self._put(key, found, {f.name: whole([F.col(f"__fold{c}") if c in new else old[c] for c in range(f.dim)])}, few)
            self.folds.pop(at, None)
            return
        if self.folds.get(at) != d.access:  # first use, another access than before, or read since then
            self._keep(key, self.tables[key].withColumn(f.name, whole([F.lit(identity(d.access, f.dtype))] * f.dim)))
        both = F.least if d.access == MIN else F.greatest
        merged = [old[c] if c not in new else F.coalesce(old[c] + F.col(f"__fold{c}"), old[c]) if d.access == INC else both(old[c], F.col(f"__fold{c}")) for c in range(f.dim)]
        self._put(key, found, {f.name: whole(merged)}, few)
        self.folds[at] = d.access

    def _gathered(self, block: Block, box: Box, dats: list[Dat]) -> tuple[DataFrame, tuple | None]:
        """The loop's cells with all that its arguments read, and the table that they come from."""
        full = [d for d in dats if not d.field.degenerate and d.stencil.kind == "regular"]
        full.sort(key=lambda d: d.access == READ)
        home = self.key(full[0].field) if full else None
        wanted: dict[tuple, dict[str, set]] = {}
        for d in dats:
            if d.access in (INC, MIN, MAX) and d.field.degenerate:
                continue
            if d.access != READ and d.access != RW and d.stencil.kind == "regular" and self.key(d.field) != home:
                if d.access != INC and d.field.dim == 1:
                    continue
            points = {tuple(p[a] for a in d.field.kept) for p in d.stencil.points} if d.stencil.kind == "regular" else {p for p in d.stencil.points}
            if d.stencil.kind == "regular":
                wanted.setdefault(self.key(d.field), {}).setdefault(d.field.name, set()).update(points)
            if d.access == READ:
                self.folds.pop((d.field.block.name, d.field.name), None)
        cells = self.tables[home] if home else index_set(self.spark, block.axes, box)
        if home:
            cells = _neighbours(cells, block.dims, tuple(range(block.dims)), wanted.pop(home, {}), home[2], self._dealt(home))
        for key, columns in wanted.items():
            axes = tuple(AXES[a] for a in key[1])
            slabs = self._dealt(key)
            own = self.tables[key].select(*([SLAB] if slabs else []), *axes, *(F.col(f"`{c}`") for c in columns))
            own = _neighbours(own, block.dims, key[1], columns, key[2], slabs)
            few, on = box_size(key[2]) <= MOST_SENT, list(axes)
            if slabs and SLAB in cells.columns and not few:
                on = [SLAB, *axes]  # both tables lie by slab
            else:
                own = own.drop(SLAB)
            if few:
                own = F.broadcast(own)
            cells = cells.join(own, on, "left") if axes else cells.crossJoin(own)
        for d in dats:
            if d.stencil.kind == "restrict":
                cells = self._restricted(cells, block, d)
            elif d.stencil.kind == "prolong":
                cells = self._prolonged(cells, block, d)
        return cells, home

    def _restricted(self, cells: DataFrame, block: Block, d: Dat) -> DataFrame:
        """Fine values at ``ratio * index + offset``: each goes to the coarse cells that read it."""
        fine, ratio = self.table(d.field), d.stencil.ratio
        parts, tests = [], []
        for k, p in enumerate(d.stencil.points):
            shifted = [F.col(x) - p[a] for a, x in enumerate(block.axes)]
            fits = F.lit(True)
            for a, s in enumerate(shifted):
                fits = fits & (s % ratio[a] == 0)
            to = [F.floor(s / ratio[a]).cast("int").alias(x) for a, (s, x) in enumerate(zip(shifted, block.axes, strict=True))]
            parts.append(F.when(fits, F.struct(*to, F.lit(k).alias("point"))))
            tests.append(_column(d, p))
        sent = fine.select(F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("to"), F.col(f"`{d.field.name}`").alias("v"))
        values = [F.max_by("v", F.when(F.col("to.point") == k, F.lit(1))).alias(c) for k, c in enumerate(tests)]
        found = sent.groupBy(*(F.col(f"to.{x}").alias(x) for x in block.axes)).agg(*values)
        return cells.join(found, list(block.axes), "left")

    def _prolonged(self, cells: DataFrame, block: Block, d: Dat) -> DataFrame:
        """Coarse values at ``index div ratio + offset``; the division truncates."""
        axes, n = block.axes, d.field.name
        coarse = _neighbours(self.table(d.field), block.dims, tuple(range(block.dims)), {n: set(d.stencil.points)})
        renamed = coarse.select(*(F.col(x).alias(f"__{x}") for x in axes), *(F.col(f"`{name_of(n, p)}`").alias(_column(d, p)) for p in d.stencil.points))
        on = F.lit(True)
        for a, x in enumerate(axes):
            on = on & (F.expr(f"{x} div {d.stencil.ratio[a]}") == F.col(f"__{x}"))
        if box_size(d.field.allocation) <= MOST_SENT:
            renamed = F.broadcast(renamed)
        return cells.join(renamed, on, "left").drop(*(f"__{x}" for x in axes))


def _neighbours(df: DataFrame, dims: int, kept: tuple[int, ...], wanted: dict[str, set], box: Box = (), slabs: Slabs | None = None) -> DataFrame:
    """Gathers along the kept axes; columns are named by offsets over all axes."""
    axes = tuple(AXES[a] for a in kept)
    if not axes:
        return df
    out = by_slab(df, axes, wanted, slabs) if slabs else gather(df, axes, wanted, box)
    if len(kept) == dims:
        return out
    names = {name_of(c, o): name_of(c, tuple(o[kept.index(a)] if a in kept else 0 for a in range(dims))) for c, os in wanted.items() for o in os if any(o)}
    return out.withColumnsRenamed(names)
