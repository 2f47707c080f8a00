"""Iterated stencils on bands of rows: several steps for each shuffle.

A band is a run of whole grid rows. Before a round each band gets ``depth`` rows of its neighbours;
it then does ``depth`` steps on its own, each step losing one of the borrowed rows at either side.
So ``steps`` steps need ``steps / depth`` shuffles of narrow borders, whatever the grid's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, stored

#: (rows x columns array with a border of one) -> new inner values.
Step = Callable[[np.ndarray], np.ndarray]


def in_bands(rows: DataFrame, low: int, high: int, height: int) -> DataFrame:
    """``band``, ``j`` and ``row`` of rows ``j``, ``row`` (arrays over the first axis)."""
    last = (high - 1 - low) // height
    band = F.greatest(F.lit(0), F.least(F.floor((F.col("j") - low) / height), F.lit(last))).cast("int")
    return rows.select(band.alias("band"), F.col("j").cast("int").alias("j"), "row")


def bands_of(df: DataFrame, value: str, low: int, high: int, height: int) -> DataFrame:
    """Rows ``j`` of a 2-D field as arrays over ``i``, in bands: ``band``, ``j``, ``row``. The bands
    cover the rows from ``low`` to ``high``; rows outside are borders and go with the nearest."""
    row = F.array_sort(F.collect_list(F.struct("i", F.col(value).cast("double").alias("v"))))
    return in_bands(df.groupBy("j").agg(F.transform(row, lambda x: x["v"]).alias("row")), low, high, height)


def iterate(rows: DataFrame, step: Step, steps: int, low: int, high: int, height: int, depth: int = 8) -> DataFrame:
    """``steps`` steps on rows ``j`` in ``[low, high)`` and all columns but the first and the last;
    adds ``change``, the largest change of a row in the last step. Border rows keep their values.
    """
    depth = max(1, min(depth, height))
    last = (high - 1 - low) // height
    done = 0
    current, held = rows.withColumn("change", F.lit(0.0)), None
    while done < steps:
        now = min(depth, steps - done)
        current = _round(current, step, now, low, high, height, last)
        done += now
        if done < steps:
            before, held = held, stored(current, "bands")
            current = held
            if before is not None:  # read by the round that is stored now
                discard(before)
    return current


def _round(rows: DataFrame, step: Step, now: int, low: int, high: int, height: int, last: int) -> DataFrame:
    b, j = F.col("band"), F.col("j")
    down = (b > 0) & (j < F.lit(low) + b * height + now)
    up = (b < last) & (j >= F.lit(low) + (b + 1) * height - now)
    to = F.filter(F.array(b, F.when(down, b - 1), F.when(up, b + 1)), lambda x: x.isNotNull())
    sent = rows.select(F.explode(to).alias("to"), "band", "j", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        if not table.num_rows:
            return
        band = table.column("to")[0].as_py()
        at = table.column("j").to_numpy()
        order = np.argsort(at)
        at = at[order]
        home = table.column("band").to_numpy()[order] == band
        width = len(table.column("row")[0])
        grid = table.column("row").combine_chunks().flatten().to_numpy().reshape(-1, width)[order].copy()
        change = np.zeros(len(grid))
        own = (at >= low) & (at < high)
        first, stop = int(np.argmax(own)), len(own) - int(np.argmax(own[::-1]))
        for k in range(now):
            top = max(first, k + 1 if first == 0 else first)
            bottom = min(stop, len(grid) - 1 - k if stop == len(grid) else stop)
            new = step(grid[top - 1 : bottom + 1])
            if k == now - 1:
                change[top:bottom] = np.abs(new - grid[top:bottom, 1:-1]).max(1)
            grid[top:bottom, 1:-1] = new
        keep = np.flatnonzero(home)
        offsets = pa.array(np.arange(0, (keep.size + 1) * width, width, dtype=np.int32))
        values = pa.ListArray.from_arrays(offsets, pa.array(grid[keep].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(keep.size, band, np.int32)), pa.array(at[keep].astype(np.int32)), values, pa.array(change[keep])], ["band", "j", "row", "change"])

    return sent.groupBy("to").applyInArrow(run, "band int, j int, row array<double>, change double")


def five_point(grid: np.ndarray) -> np.ndarray:
    """The mean of the four neighbours."""
    out = grid[1:-1, 2:] + grid[1:-1, :-2]
    out += grid[:-2, 1:-1]
    out += grid[2:, 1:-1]
    out *= 0.25
    return out
