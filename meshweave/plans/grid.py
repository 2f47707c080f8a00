"""Dense index sets as DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Box, box_size


def index_set(spark: SparkSession, axes: tuple[str, ...], box: Box) -> DataFrame:
    """All coordinates of a box, the first axis fastest: one range, no join."""
    columns, step = [], 1
    for axis, (low, high) in zip(axes, box, strict=True):
        width = max(0, high - low)
        columns.append(F.expr(f"cast((id div {step}) % {max(1, width)} + {low} AS int)").alias(axis))
        step *= max(1, width)
    return spark.range(box_size(box)).select(*columns)


def inside(box: Box, axes: tuple[str, ...]) -> Column:
    """Whether a row's coordinates are in a half-open box; an empty box holds none."""
    out = F.lit(True)
    for axis, (low, high) in zip(axes, box, strict=True):
        out = out & (F.col(axis) >= low) & (F.col(axis) < high)
    return out


def densified(values: DataFrame, axes: tuple[str, ...], box: Box, filled: dict[str, Column]) -> DataFrame:
    """Values on every coordinate of a box: rows outside are dropped, missing ones filled."""
    spark = values.sparkSession
    grid = index_set(spark, axes, box).join(values, list(axes), "left")
    return grid.select(*axes, *(F.coalesce(F.col(c), v).alias(c) for c, v in filled.items()))


def _coarse(box: Box) -> tuple[int, int]:
    """Bits that a Morton key takes of each coordinate, and how many low ones it leaves out."""
    bits = max(1, *((high - low - 1).bit_length() for low, high in box))
    used = min(bits, 62 // len(box))
    return used, bits - used


def morton(axes: tuple[str, ...], box: Box) -> Column:
    """The place of a cell on a curve that keeps neighbours together: the bits of its coordinates in turn."""
    bits, drop = _coarse(box)
    key = F.lit(0).cast("long")
    for a, (axis, (low, _)) in enumerate(zip(axes, box, strict=True)):
        x = F.shiftright((F.col(axis) - low).cast("long"), drop)
        for b in range(bits):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(x, b).bitwiseAND(F.lit(1).cast("long")), b * len(box) + a))
    return key


def morton_of(at: list[np.ndarray], box: Box) -> np.ndarray:
    """The same of arrays of coordinates."""
    bits, drop = _coarse(box)
    key = np.zeros(len(at[0]), np.int64)
    for a, (x, (low, _)) in enumerate(zip(at, box, strict=True)):
        x = x.astype(np.int64) - low >> drop
        for b in range(bits):
            key |= (x >> b & 1) << b * len(box) + a
    return key


def morton_ranges(box: Box, part: Box, most: int = 64) -> list[tuple[int, int]]:
    """At most ``most`` ranges (ends included) of the keys of ``box`` that hold all cells of ``part``. Cubes of
    the curve are halved along each axis until they are inside the part, outside, or there are enough."""
    bits, drop = _coarse(box)
    dims = len(box)
    lows = [max(0, (max(p, low) - low)) >> drop for (p, _), (low, _) in zip(part, box, strict=True)]
    highs = [(min(p, high) - 1 - low) >> drop for (_, p), (low, high) in zip(part, box, strict=True)]
    if any(h < lo for lo, h in zip(lows, highs, strict=True)):
        return []
    whole, cut = [], [(0, (0,) * dims)]
    for level in range(bits, -1, -1):  # cubes of 2^level cells along each axis
        halves = []
        for key, corner in cut:
            if any(c > h or c + (1 << level) - 1 < lo for c, lo, h in zip(corner, lows, highs, strict=True)):
                continue
            if level == 0 or all(lo <= c and c + (1 << level) - 1 <= h for c, lo, h in zip(corner, lows, highs, strict=True)):
                whole.append((key, key + (1 << level * dims) - 1))
                continue
            halves.append((key, corner))
        if level and len(whole) + len(halves) > 8 * most:
            whole += [(key, key + (1 << level * dims) - 1) for key, _ in halves]
            break
        half = 1 << max(0, level - 1)
        cut = [(key + (n << (level - 1) * dims), tuple(c + half * (n >> a & 1) for a, c in enumerate(corner))) for key, corner in halves for n in range(1 << dims)]
    out: list[list[int]] = []
    for low, high in sorted(whole):
        if out and low <= out[-1][1] + 1:
            out[-1][1] = high
        else:
            out.append([low, high])
    while len(out) > most:  # the smallest gaps are read too
        gaps = sorted(range(1, len(out)), key=lambda k: out[k][0] - out[k - 1][1])[: len(out) - most]
        for k in sorted(gaps, reverse=True):
            out[k - 1][1] = out[k][1]
            del out[k]
    return [tuple(x) for x in out]
