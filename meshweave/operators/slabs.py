"""Parts of fields: fetching, overwriting, planes, extents, checks and text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import randoms, twister
from ..plans.catalog import AXES, TYPES, Field, MeshError, box_of, box_size
from ..plans.grid import inside
from .loop import Mesh


def interior(mesh: Mesh, f: Field) -> DataFrame:
    return mesh.table(f).where(inside(tuple(f.interior[a] for a in f.kept), f.axes))


def slab(mesh: Mesh, f: Field, box: list[int]) -> DataFrame:
    """The cells of a box; halo cells are possible."""
    bounds = box_of(box)
    return mesh.table(f).where(inside(tuple(bounds[a] for a in f.kept), f.axes))


def plane(mesh: Mesh, f: Field, axis: int, at: int) -> DataFrame:
    """The interior at one position of an axis, without that axis."""
    if not 0 <= axis < f.block.dims or axis not in f.kept:
        raise MeshError(f"{f.name} has no axis {axis}")
    low, high = f.interior[axis]
    if not low <= at < high:
        raise MeshError(f"{f.name} has no plane {at} on axis {axis}; they are {low} to {high - 1}")
    return interior(mesh, f).where(F.col(AXES[axis]) == at).drop(AXES[axis])


def ordered(df: DataFrame, f: Field) -> DataFrame:
    """Rows in storage order, the first axis fastest."""
    return df.orderBy(*reversed(f.axes))


def set_interior(mesh: Mesh, f: Field, values: DataFrame) -> None:
    mesh.set_values(f, values, f.interior)


def set_all(mesh: Mesh, f: Field, values: DataFrame) -> None:
    """Interior and halo."""
    mesh.set_values(f, values, f.allocation)


def set_slab(mesh: Mesh, f: Field, values: DataFrame, box: list[int]) -> None:
    mesh.set_values(f, values, box_of(box))


def extents(f: Field) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Base and size of the interior."""
    return f.base, f.size


def slab_extents(f: Field, box: list[int]) -> tuple[tuple[int, ...], int]:
    """Sizes of a box within the interior, and how many bytes it has."""
    bounds = box_of(box)
    if len(bounds) != f.block.dims or any(lo < b or hi > b + s or hi < lo for (lo, hi), b, s in zip(bounds, f.base, f.size, strict=True)):
        raise MeshError(f"box {bounds} is not within {f.name}")
    sizes = tuple(hi - lo for lo, hi in bounds)
    n = f.dim * {"float": 4, "half": 2, "int": 4, "short": 2, "char": 1}.get(f.dtype, 8)
    for s in sizes:
        n *= s
    return sizes, n


def raw_metadata(f: Field) -> dict[str, tuple[int, ...]]:
    """How a dense array of the field would be laid out: shape with halo, strides in cells with the
    first axis fastest, halo depths."""
    shape = tuple(hi - lo for lo, hi in f.allocation)
    strides, step = [], 1
    for n in shape:
        strides.append(step)
        step *= n
    return {"shape": shape, "strides": tuple(strides), "below": f.below, "above": f.above}


def as_array(mesh: Mesh, f: Field, most: int = 50_000_000) -> np.ndarray:
    """A field with its halo as a NumPy array on the driver, indexed by axis (then component).
    Fields of more than ``most`` cells are refused; work on those with ``map_batches``."""
    box = tuple(f.allocation[a] for a in f.kept)
    if box_size(box) * f.dim > most:
        raise MeshError(f"{f.name} has more than {most} cells")
    t = ordered(mesh.table(f), f).toArrow()
    shape = [hi - lo for lo, hi in reversed(box)]
    values = t[f.name].combine_chunks()
    if f.dim > 1:
        return values.flatten().to_numpy(zero_copy_only=False).reshape(*shape, f.dim).transpose(*range(len(shape) - 1, -1, -1), len(shape))
    return values.to_numpy(zero_copy_only=False).reshape(shape).T


def map_batches(mesh: Mesh, f: Field, change: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> None:
    """Raw access to a field where it lies: Arrow batches of coordinates and value in, the same out."""
    t = mesh.table(f)
    mesh.set_values(f, t.mapInArrow(change, t.schema))


def partitions(mesh: Mesh, f: Field) -> DataFrame:
    """How many cells each partition of a field's table has."""
    return mesh.table(f).groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("cells"))


def transposed(mesh: Mesh, f: Field, axes: tuple[int, ...]) -> DataFrame:
    """A field with its axes in another order: axis ``axes[a]`` becomes axis ``a``. Only names change."""
    if sorted(axes) != list(range(f.block.dims)) or f.degenerate:
        raise MeshError(f"{f.name} cannot be transposed by {axes}")
    return mesh.table(f).select(*(F.col(AXES[x]).alias(AXES[a]) for a, x in enumerate(axes)), f.name)


def copied(mesh: Mesh, f: Field, name: str) -> Field:
    """A new field with the metadata and the values of another."""
    new = f.like(name)
    mesh.declare(new)
    mesh.table(f)
    mesh.assign(new, F.col(f"`{f.name}`"))
    return new


def deep_copy(mesh: Mesh, target: Field, source: Field) -> None:
    """The values of ``source``, halo included, into ``target`` on the same block."""
    if target.block.name != source.block.name:
        raise MeshError(f"{target.name} and {source.name} are on different blocks")
    if mesh.key(target) == mesh.key(source):
        mesh.table(source)  # ends a fold, as any read does
        mesh.assign(target, F.col(f"`{source.name}`"))
        return
    mesh.set_values(target, mesh.table(source).withColumnRenamed(source.name, target.name))


def first_nan(mesh: Mesh, f: Field) -> DataFrame:
    """The first NaN in storage order, halo included: one row or none. Integers have none."""
    t = mesh.table(f)
    if not f.floating:
        return t.limit(0)
    bad = F.exists(f.name, F.isnan) if f.dim > 1 else F.isnan(F.col(f.name))
    return t.where(bad).orderBy(*reversed(f.axes)).limit(1)


def fill_random(mesh: Mesh, f: Field, seed: int, normal: bool = False) -> None:
    """Fills a field, halo included: uniform in [0, 1), integers from 0, or standard normal."""
    if normal and not f.floating:
        raise MeshError(f"{f.name}: normal numbers need a real type")
    at = [F.col(x) for x in f.axes]

    def value(stream: int) -> Column:
        if normal:
            return randoms.normal(at, seed, stream)
        return randoms.uniform(at, seed, stream) if f.floating else randoms.uniform_int(at, seed, stream)

    new = F.array(*(value(d) for d in range(f.dim))) if f.dim > 1 else value(0)
    mesh.assign(f, new)


def fill_twister(mesh: Mesh, f: Field, seed: int, chunk: int = 4_000_000) -> None:
    """Fills a field, halo included, with the stream of a Mersenne twister in storage order (components of a
    cell together): uniform in [0, 1), integers from 0. Each task enters the stream at its own place, so the
    values do not depend on ``chunk``, the cells of a task."""
    kind = TYPES[f.dtype]
    if kind not in ("double", "float", "int"):
        raise MeshError(f"{f.name}: a twister fills double, float and int, not {f.dtype}")
    box, each, modulus = tuple(f.allocation[a] for a in f.kept), f.dim * (2 if kind == "double" else 1), twister.characteristic()
    cells, axes, dim = box_size(box), f.axes, f.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n in (n for batch in batches for n in batch.column(0).to_pylist()):
            begin, end = n * chunk, min((n + 1) * chunk, cells)
            stream = twister.Stream(seed, begin * each, modulus)
            for low in range(begin, end, 100_000):
                at = np.arange(low, min(low + 100_000, end), dtype=np.int64)
                columns, step = [], 1
                for first, last in box:
                    columns.append(pa.array((at // step % (last - first) + first).astype(np.int32)))
                    step *= last - first
                values = pa.array(stream.values(len(at) * dim, kind))
                if dim > 1:
                    values = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * dim), values)
                yield pa.RecordBatch.from_arrays([*columns, values], [*axes, "value"])

    tasks = -(-cells // chunk)
    made = mesh.spark.range(0, tasks, 1, tasks).mapInArrow(run, ", ".join([*(f"{x} int" for x in axes), f"value {f.spark_type}"]))
    mesh.set_values(f, made.withColumnRenamed("value", f.name), cells=cells)


def lines(mesh: Mesh, f: Field) -> DataFrame:
    """One line of text for each row of cells along the first axis."""
    t = mesh.table(f)
    rest = [x for x in f.axes if x != f.axes[0]]
    row = F.array_sort(F.collect_list(F.struct(F.col(f.axes[0]).alias("p"), F.col(f.name).cast("string").alias("v"))))
    return t.groupBy(*rest).agg(F.array_join(F.transform(row, lambda x: x["v"]), " ").alias("line"))


def text_lines(mesh: Mesh, f: Field) -> DataFrame:
    """The same in storage order."""
    return lines(mesh, f).orderBy(*(F.col(x) for x in reversed(f.axes[1:])))
