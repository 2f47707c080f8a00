"""Fields set from a table of regions: rectangles, circles and points, of which the last one wins.

Each region has the level at which a square tile is as wide as it is, and is put down for the tiles of that
level that it touches, four at most. A cell looks its tile up on each level that occurs, so a join by level
and tile brings a cell and the regions near it together, whatever their sizes; no cell meets all regions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import Field, MeshError
from .loop import MOST_SENT, Mesh

KINDS = ("rectangle", "circle", "point")


def _placed(regions: DataFrame) -> DataFrame:
    """Regions with the half-open box around them and their level."""
    known = regions.where(F.col("kind").isin(*KINDS) & F.col("place").isNotNull())
    circle, point = F.col("kind") == "circle", F.col("kind") == "point"
    low = lambda c: F.when(circle, F.ceil(F.col(f"{c}0") - F.col("radius"))).otherwise(F.ceil(f"{c}0")).cast("long")
    high = lambda c: F.when(circle, F.floor(F.col(f"{c}0") + F.col("radius")) + 1).when(point, F.floor(f"{c}0") + 1).otherwise(F.ceil(f"{c}1")).cast("long")
    boxed = known.withColumns({f"{side}_{c}": of(c) for c in "xy" for side, of in (("low", low), ("high", high))})
    boxed = boxed.where("low_x < high_x AND low_y < high_y")
    widest = F.greatest(F.col("high_x") - F.col("low_x"), F.col("high_y") - F.col("low_y"))
    return boxed.withColumn("level", F.length(F.bin(widest - 1)))


def set_regions(mesh: Mesh, f: Field, regions: DataFrame) -> None:
    """Sets a two-dimensional field of one component where regions are: ``place`` (order; the greatest wins),
    ``kind``, ``x0``, ``y0``, ``x1``, ``y1`` (a rectangle's half-open corners; the others' centre is the first),
    ``radius`` (a circle has what is no farther away) and ``value``. Other cells keep theirs; regions without
    a place or of another kind are left out, and those outside the field set nothing."""
    if f.block.dims != 2 or f.degenerate or f.dim != 1:
        raise MeshError(f"{f.name}: regions are set on full fields of two axes and one component")
    cells = mesh.table(f).select("i", "j")
    placed = _placed(regions.select("place", "kind", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "radius")), "value"))
    (ilow, ihigh), (jlow, jhigh) = f.allocation
    placed = placed.where((F.col("low_x") < ihigh) & (F.col("high_x") > ilow) & (F.col("low_y") < jhigh) & (F.col("high_y") > jlow))
    levels = [r["level"] for r in placed.select("level").distinct().collect()]  # at most 64
    put = placed
    for c in "xy":
        put = put.withColumn(f"t{c}", F.explode(F.expr(f"sequence(shiftright(low_{c}, level), shiftright(high_{c} - 1, level))")))
    if put.count() <= MOST_SENT:
        put = F.broadcast(put)
    if not levels:
        return
    looked = cells.withColumn("level", F.explode(F.array(*map(F.lit, sorted(levels)))))
    looked = looked.withColumns({"tx": F.expr("shiftright(cast(i as bigint), level)"), "ty": F.expr("shiftright(cast(j as bigint), level)")})
    near = looked.join(put, ["level", "tx", "ty"])
    dx, dy = F.col("i") - F.col("x0"), F.col("j") - F.col("y0")
    within = (F.col("i") >= F.col("low_x")) & (F.col("i") < F.col("high_x")) & (F.col("j") >= F.col("low_y")) & (F.col("j") < F.col("high_y"))
    met = F.when(F.col("kind") == "circle", dx * dx + dy * dy <= F.col("radius") * F.col("radius")).when(F.col("kind") == "point", (dx == 0) & (dy == 0)).otherwise(F.lit(True))
    last = near.where(within & met).groupBy("i", "j").agg(F.max_by("value", "place").alias(f.name))
    mesh.set_values(f, last)
