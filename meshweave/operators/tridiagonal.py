"""Tridiagonal systems along an axis, one for each line of a box.

Lines are independent, so they are dealt out whole. A line is a recurrence in two directions, which
no built-in expression has, so it is solved in NumPy: all lines of a batch at once, step by step
along the axis. Lines longer than ``chunk`` are cut: each piece is solved for its own right-hand side
and for a unit value of either neighbour beyond its ends; two equations for each piece then give the
values at the ends, and the rest follows without another recurrence. So no task holds a longer run.

Where lines are few and long, parallel cyclic reduction is used instead, in SQL alone: a round eliminates the
neighbours at a distance, which doubles; then every cell is an equation of its own. There are two shuffles in
all, and one more for each stage where lines are longer than the square of ``chunk``. The near rounds are windows within slabs, which borrow as many cells as the rounds together reach; after
them, cells at the same remainder of the distance are systems of their own, and the far rounds are windows
within these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import AXES, Field, MeshError, box_of, box_size
from ..plans.grid import inside
from ..sources.shared import stored
from .loop import Mesh


def thomas(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Solves ``a x[k-1] + b x[k] + c x[k+1] = d`` for each row; a[:, 0] and c[:, -1] do not count."""
    n = b.shape[1]
    upper, x = np.empty_like(d), np.empty_like(d)
    upper[:, 0], x[:, 0] = c[:, 0] / b[:, 0], d[:, 0] / b[:, 0]
    for k in range(1, n):
        pivot = b[:, k] - a[:, k] * upper[:, k - 1]
        upper[:, k] = c[:, k] / pivot
        x[:, k] = (d[:, k] - a[:, k] * x[:, k - 1]) / pivot
    for k in range(n - 2, -1, -1):
        x[:, k] -= upper[:, k] * x[:, k + 1]
    return x


def _lines(systems: DataFrame, line: list[str], along: str) -> DataFrame:
    """One row of arrays for each line, ordered along the axis: ``p``, ``a``, ``b``, ``c``, ``d``."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(along).alias("p"), *(F.col(x).cast("double").alias(x) for x in "abcd"))))
    lines = systems.groupBy(*line).agg(cells.alias("s")) if line else systems.agg(cells.alias("s"))
    return lines.select(*line, F.col("s.p").alias("p"), *(F.col(f"s.{x}").alias(x) for x in "abcd"))


def _by_length(batch: pd.DataFrame, column: str) -> Iterator[tuple[pd.Index, int]]:
    lengths = batch[column].map(len)
    for n in lengths.unique():
        if n:
            yield lengths.index[lengths == n], int(n)


def _kinds(df: DataFrame, names: list[str]) -> str:
    return "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in names)


def solve_lines(systems: DataFrame, line: list[str], along: str) -> DataFrame:
    """``line`` columns, ``along`` and ``x`` of systems ``a, b, c, d``, each line whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = pd.Series([[]] * len(batch), index=batch.index, dtype=object)
            for at, _ in _by_length(batch, "b"):
                x[at] = pd.Series(list(thomas(*(np.stack(batch.loc[at, k].to_numpy()) for k in "abcd"))), index=at)
            yield batch[[*line, "p"]].assign(x=x)

    solved = _lines(systems, line, along).mapInPandas(run, f"{_kinds(systems, line)}p array<int>, x array<double>")
    return solved.select(*line, F.explode(F.arrays_zip("p", "x")).alias("v")).select(*line, F.col("v.p").alias(along), F.col("v.x").alias("x"))


def joints(y0: np.ndarray, yn: np.ndarray, u0: np.ndarray, un: np.ndarray, w0: np.ndarray, wn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last values of the pieces of one line, from what each piece says of its ends:

        first[k] + u0[k] last[k - 1] + w0[k] first[k + 1] = y0[k]      and the same for last[k] with n

    by elimination forward over the pieces: last[k] = g[k] - h[k] first[k + 1].
    """
    m = len(y0)
    g, h, f, e = np.zeros(m), np.zeros(m), np.zeros(m), np.zeros(m)
    for k in range(m):
        before_g, before_h = (g[k - 1], h[k - 1]) if k else (0.0, 0.0)
        # last[k-1] = g - h first[k], so first[k] (1 - u0 h) = y0 - u0 g - w0 first[k+1]
        scale = 1 - u0[k] * before_h
        f[k], e[k] = (y0[k] - u0[k] * before_g) / scale, w0[k] / scale
        g[k], h[k] = yn[k] - un[k] * (before_g - before_h * f[k]), wn[k] + un[k] * before_h * e[k]
    first = np.zeros(m + 1)
    for k in range(m - 1, -1, -1):
        first[k] = f[k] - e[k] * first[k + 1]
    return first[:-1], g - h * first[1:]


def solve_long_lines(systems: DataFrame, line: list[str], along: str, begin: int, chunk: int) -> DataFrame:
    """The same as ``solve_lines``, in pieces of ``chunk`` cells."""
    cut = systems.withColumn("piece", F.floor((F.col(along) - begin) / chunk).cast("long"))
    at = [*line, "piece"]

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {k: pd.Series([[]] * len(batch), index=batch.index, dtype=object) for k in "yuw"}
            for rows, n in _by_length(batch, "b"):
                a, b, c, d = (np.stack(batch.loc[rows, k].to_numpy()) for k in "abcd")
                left, right = np.zeros_like(d), np.zeros_like(d)
                left[:, 0] = np.where(batch.loc[rows, "piece"] > 0, a[:, 0], 0)  # the line's first a counts no neighbour
                right[:, n - 1] = c[:, n - 1]
                for k, rhs in zip("yuw", (d, left, right), strict=True):
                    out[k][rows] = pd.Series(list(thomas(a, b, c, rhs)), index=rows)
            yield batch[[*at, "p"]].assign(**out)

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for _, r in batch.iterrows():
                pieces = sorted(r["s"], key=lambda s: s["piece"])
                first, last = joints(*(np.array([s[k] for s in pieces]) for k in ("y0", "yn", "u0", "un", "w0", "wn")))
                before, after = np.concatenate(([0.0], last[:-1])), np.concatenate((first[1:], [0.0]))
                rows += [(*(r[c] for c in line), s["piece"], b, e) for s, b, e in zip(pieces, before, after, strict=True)]
            yield pd.DataFrame(rows, columns=[*at, "before", "after"])

    solved = stored(_lines(cut, at, along).mapInPandas(own, f"{_kinds(cut, at)}p array<int>, y array<double>, u array<double>, w array<double>"), "pieces")
    told = F.struct("piece", *(F.element_at(k, n).alias(f"{k}{'0' if n == 1 else 'n'}") for k in "yuw" for n in (1, -1)))
    lines = solved.groupBy(*line).agg(F.collect_list(told).alias("s")) if line else solved.agg(F.collect_list(told).alias("s"))
    known = lines.mapInPandas(ends, f"{_kinds(cut, at)}before double, after double")
    joined = solved.join(known, at).select(*line, "before", "after", F.explode(F.arrays_zip("p", "y", "u", "w")).alias("v"))
    return joined.select(*line, F.col("v.p").alias(along), (F.col("v.y") - F.col("v.u") * F.col("before") - F.col("v.w") * F.col("after")).alias("x"))


def _over(x: Column, y: Column) -> Column:
    """x / y; NaN over zero, as in NumPy."""
    return x / F.when(y == 0, F.lit(float("nan"))).otherwise(y)


def _round(df: DataFrame, window: Window, distance: int) -> DataFrame:
    """Eliminates the neighbours ``distance`` rows off. Beyond a line's ends there is nothing to eliminate."""
    near = {f"{k}{side}": way(k, distance).over(window) for side, way in (("0", F.lag), ("1", F.lead)) for k in "abcd"}
    df = df.withColumns(near)
    low = F.when(F.col("b0").isNull(), 0.0).otherwise(_over(-F.col("a"), F.col("b0")))
    high = F.when(F.col("b1").isNull(), 0.0).otherwise(_over(-F.col("c"), F.col("b1")))
    df = df.withColumns({"low": low, "high": high})
    of = lambda k: F.coalesce(F.col(k), F.lit(0.0))
    new = {
        "a": F.col("low") * of("a0"),
        "b": F.col("b") + F.col("low") * of("c0") + F.col("high") * of("a1"),
        "c": F.col("high") * of("c1"),
        "d": F.col("d") + F.col("low") * of("d0") + F.col("high") * of("d1"),
    }
    return df.withColumns(new).drop(*near, "low", "high")


def _near(cells: int, chunk: int) -> int:
    """How many rounds are near ones: after them the systems have at most ``chunk`` cells."""
    return (-(-cells // chunk) - 1).bit_length()


def solve_by_reduction(systems: DataFrame, line: list[str], along: str, begin: int, cells: int, chunk: int, stages: bool = False) -> DataFrame:
    """The same as ``solve_lines`` for lines of ``cells`` cells, by parallel cyclic reduction. Tasks have slabs
    and systems of at most ``chunk`` cells and their borders. With ``stages`` lines may be of any length: near
    rounds in slabs of the systems so far go on, a shuffle for each stage, until systems have ``chunk`` cells."""
    if not stages and (1 << _near(cells, chunk)) - 1 > chunk:
        raise MeshError(f"lines of {cells} cells are too long for systems of {chunk}")
    at = F.col(along) - begin
    df = systems.select(*line, along, F.when(at == 0, 0.0).otherwise(F.col("a").cast("double")).alias("a"), F.col("b").cast("double").alias("b"), F.when(at == cells - 1, 0.0).otherwise(F.col("c").cast("double")).alias("c"), F.col("d").cast("double").alias("d"))
    done = 0  # rounds; cells of a system are 2 to this power apart
    system, place, length = list(line), at, cells
    while length > chunk:
        near, parts = min(_near(length, chunk), (chunk + 1).bit_length() - 1), -(-length // chunk)
        reach = (1 << near) - 1
        slab, within = F.floor(place / chunk).cast("int"), place % chunk
        to = F.array(slab, F.when((within < reach) & (slab > 0), slab - 1), F.when((within >= chunk - reach) & (slab < parts - 1), slab + 1))
        df = df.withColumn("slab", F.explode(F.filter(to, lambda s: s.isNotNull())))
        window = Window.partitionBy(*system, "slab").orderBy(along)
        for k in range(near):
            df = _round(df, window, 1 << k)
        df = df.where(F.col("slab") == slab).drop("slab")
        done += near
        df = df.withColumn("rest", (at % (1 << done)).cast("int"))
        system, place, length = [*line, "rest"], F.floor(at / (1 << done)).cast("int"), -(-cells // (1 << done))
    window = Window.partitionBy(*system).orderBy(along)
    distance = 1
    while distance << done < cells:
        df = _round(df, window, distance)
        distance *= 2
    return df.select(*line, along, _over(F.col("d"), F.col("b")).alias("x"))


def solve(mesh: Mesh, axis: int, box: list[int], a: Field, b: Field, c: Field, d: Field, into: Field | None = None, chunk: int = 65_536, by: str | None = None) -> None:
    """Solves along ``axis`` over a box. The solution overwrites ``d``, or is added to ``into``. The last
    cell's ``c`` and the first cell's ``a`` do not count. ``by``: lines ``whole``, in ``pieces`` of ``chunk``
    cells or by cyclic ``reduction``. If it is not given, lines longer than ``chunk`` are reduced if there are
    fewer of them than partitions, and cut into pieces if not."""
    fields = [a, b, c, d, *([into] if into else [])]
    if len({(f.size, f.dtype) for f in fields}) != 1:
        raise MeshError("the coefficients of a tridiagonal system differ in size or type")
    if not d.floating or d.dtype == "half" or any(f.dim != 1 or f.degenerate for f in fields):
        raise MeshError("tridiagonal systems take full fields of one double or float component")
    bounds, axes = box_of(box), d.block.axes
    table, names = None, list(zip("abcd", (a, b, c, d), strict=True))
    for key in dict.fromkeys(mesh.key(f) for _, f in names):  # fields of one table are read from it together
        own = [(n, f) for n, f in names if mesh.key(f) == key]
        for _, f in own:
            mesh.table(f)  # ends a fold, as any read does
        part = mesh.tables[key].where(inside(bounds, axes)).select(*axes, *(F.col(f"`{f.name}`").alias(n) for n, f in own))
        table = part if table is None else table.join(part, list(axes))
    line, along = [x for x in axes if x != AXES[axis]], AXES[axis]
    low, high = bounds[axis]
    if by is None:
        few = box_size(bounds) < int(mesh.spark.conf.get("spark.sql.shuffle.partitions")) * max(1, high - low)
        by = "whole" if high - low <= chunk else "reduction" if few and 1 << _near(high - low, chunk) <= chunk else "pieces"
    if by not in ("whole", "pieces", "reduction"):
        raise MeshError(f"tridiagonal systems cannot be solved by {by}")
    if by == "reduction":
        solved = solve_by_reduction(table, line, along, low, high - low, chunk, True)
    elif by == "pieces":
        last = F.col(along) == high - 1
        solved = solve_long_lines(table.withColumn("c", F.when(last, 0.0).otherwise(F.col("c"))), line, along, low, chunk)
    else:
        solved = solve_lines(table, line, along)
    target = into or d
    new = solved.select(*axes, F.col("x").alias("__new"), F.lit(True).alias("__hit"))
    value = F.col("__new") if not into else F.col(f"`{into.name}`") + F.col("__new")
    mesh.put(target, new, value, box_size(bounds))
