"""Halo transfers: boxes copied between fields, with axes permuted and flipped."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import AXES, TYPES, Box, Halo
from ..plans.grid import inside
from .loop import Mesh


def _box(base: tuple[int, ...], shape: tuple[int, ...], direction: tuple[int, ...]) -> Box:
    return tuple((b, b + shape[abs(d) - 1]) for b, d in zip(base, direction, strict=True))


def _buffer(base: tuple[int, ...], shape: tuple[int, ...], direction: tuple[int, ...]) -> list[Column]:
    """Coordinates within the transferred box, from those of a field."""
    out: list[Column] = [F.lit(0)] * len(shape)
    for m, d in enumerate(direction):
        a = abs(d) - 1
        within = F.col(AXES[m]) - base[m]
        out[a] = within if d > 0 else F.lit(shape[a] - 1) - within
    return out


def _moved(halo: Halo) -> Column:
    """The halo's value in the target's type."""
    one = TYPES[halo.target.dtype]
    value = F.col(f"`{halo.source.name}`")
    if "half" in (halo.source.dtype, halo.target.dtype) and halo.target.dim == 1:
        value = value.cast("float")
    value = value.cast(one if halo.target.dim == 1 else halo.target.spark_type)
    if halo.sign == 1:
        return value
    signed = lambda x: (x * F.lit(halo.sign)).cast(one)
    return signed(value) if halo.target.dim == 1 else F.transform(value, signed)


def remapped(source: DataFrame, halos: dict[str, Halo]) -> DataFrame:
    """The cells of halos of equal boxes and directions under the target's coordinates, each halo's values as a
    column of its name; one projection of a filtered scan."""
    halo = next(iter(halos.values()))
    axes = AXES[: len(halo.shape)]
    box = _box(halo.from_base, halo.shape, halo.from_dir)
    buffer = _buffer(halo.from_base, halo.shape, halo.from_dir)
    placed = source.where(inside(box, axes)).select(*(b.cast("int").alias(f"__b{a}") for a, b in enumerate(buffer)), *(_moved(h).alias(n) for n, h in halos.items()))
    out = []
    for m, d in enumerate(halo.to_dir):
        a = abs(d) - 1
        b = F.col(f"__b{a}")
        out.append((F.lit(halo.to_base[m]) + (b if d > 0 else F.lit(halo.shape[a] - 1) - b)).cast("int").alias(axes[m]))
    return placed.select(*out, *halos)


def transfer(mesh: Mesh, halos: list[Halo]) -> None:
    """Carries out a group of halos. All read the state before the group; their targets should not
    overlap, and if they do, the later halo wins.

    Halos with the same boxes and tables move together, and each table that is written is joined once,
    however many of its fields and borders the group has.
    """
    moves: dict[tuple, dict[tuple, dict[str, Halo]]] = {}
    for k, h in enumerate(halos):
        way = (mesh.key(h.source), h.shape, h.from_base, h.to_base, h.from_dir, h.to_dir)
        moves.setdefault(mesh.key(h.target), {}).setdefault(way, {})[f"__halo{k}"] = h
        mesh.table(h.source)  # ends a fold, as any read does
    tables = dict(mesh.tables)
    for key, ways in moves.items():
        parts = [remapped(tables[way[0]], own) for way, own in ways.items()]
        every = parts[0]
        for more in parts[1:]:
            every = every.unionByName(more, allowMissingColumns=True)
        axes = tuple(AXES[a] for a in key[1])
        named = {n: h for own in ways.values() for n, h in own.items()}
        if len(parts) > 1:
            every = every.groupBy(*axes).agg(*(F.first(n, ignorenulls=True).alias(n) for n in named))
        targets: dict[str, list[str]] = {}
        for n in sorted(named, key=lambda n: int(n.removeprefix("__halo")), reverse=True):
            targets.setdefault(named[n].target.name, []).append(n)
        values = {f: F.coalesce(*(F.col(n) for n in own), F.col(f"`{f}`")) for f, own in targets.items()}
        # How many numbers are sent, not rows: a row can be wide.
        numbers = sum(prod(h.shape) * (h.target.dim + len(axes)) for h in named.values()) // (1 + len(axes))
        mesh.put_columns(key, every.withColumn("__hit", F.lit(True)), values, numbers)
