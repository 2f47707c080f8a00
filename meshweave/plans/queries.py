"""One query for each operator of the engine, over meshes made from the driver's tables, with the
same result in SQL.

The meshes: a 40 x 25 grid of quantities (``lineitem`` by part and supplier), a 10 x 10 x 7 grid
(by supplier, part and line number), and 720 hours of events.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import bands, halo, regions, slabs, tridiagonal
from ..operators.loop import Dat, Gbl, Idx, Mesh, Opt, Reduce, inc, read, rw, write
from ..operators.reduction import Reduction
from ..operators.tiles import Tiles
from ..plans.catalog import INC, MAX, MIN, WRITE, Block, Field, Halo, Stencil
from ..plans.grid import inside
from ..sources.mesh import along_curve, register
from ..sources.shared import new_path
from ..sources.store import Store
from ..streaming.steps import Checkpointer, Replay, run_steps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

G2 = """g AS (SELECT CAST(a.range AS INT) AS i, CAST(b.range AS INT) AS j, coalesce(s.v, 0) AS v FROM range(40) a CROSS JOIN range(25) b
 LEFT JOIN (SELECT l_partkey % 40 AS i, l_suppkey % 25 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) s ON s.i = a.range AND s.j = b.range)"""
G3 = """g AS (SELECT CAST(a.range AS INT) AS i, CAST(b.range AS INT) AS j, CAST(c.range AS INT) AS k, coalesce(s.v, 0) AS v FROM range(10) a CROSS JOIN range(10) b CROSS JOIN range(7) c
 LEFT JOIN (SELECT l_suppkey % 10 AS i, l_partkey % 10 AS j, l_linenumber - 1 AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3) s ON s.i = a.range AND s.j = b.range AND s.k = c.range)"""
G1 = """g AS (SELECT CAST(a.range AS INT) AS i, CAST(coalesce(s.v, 0) AS DOUBLE) AS v FROM range(720) a
 LEFT JOIN (SELECT CAST(date_diff('hour', TIMESTAMP '2024-01-01', CAST(ts AS TIMESTAMP)) AS INT) AS i, count(*) AS v FROM events GROUP BY 1) s ON s.i = a.range)"""
NEAR = "lag(v) OVER x AS w, lead(v) OVER x AS e, lag(v) OVER y AS s, lead(v) OVER y AS n FROM {t} WINDOW x AS (PARTITION BY j ORDER BY i), y AS (PARTITION BY i ORDER BY j)"
WITHIN = "i BETWEEN 1 AND 38 AND j BETWEEN 1 AND 23"


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query and its SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def grid2(spark: SparkSession, sf_dir: str, **more) -> tuple[Mesh, Block, Field]:
    m = Mesh(spark)
    b = m.block("parts", 2)
    values = lineitem(spark, sf_dir).groupBy((F.col("l_partkey") % 40).cast("int").alias("i"), (F.col("l_suppkey") % 25).cast("int").alias("j")).agg(F.sum("l_quantity").alias("v"))
    return m, b, m.field(b, "v", (40, 25), values=values, **more)


def grid3(spark: SparkSession, sf_dir: str) -> tuple[Mesh, Block, Field]:
    m = Mesh(spark)
    b = m.block("lines", 3)
    at = (F.col("l_suppkey") % 10).cast("int").alias("i"), (F.col("l_partkey") % 10).cast("int").alias("j"), (F.col("l_linenumber") - 1).cast("int").alias("k")
    return m, b, m.field(b, "v", (10, 10, 7), values=lineitem(spark, sf_dir).groupBy(*at).agg(F.sum("l_quantity").alias("v")))


def grid1(spark: SparkSession, sf_dir: str) -> tuple[Mesh, Block, Field]:
    m = Mesh(spark)
    b = m.block("hours", 1)
    hour = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3600)
    values = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(hour.cast("int").alias("i")).agg(F.count("*").cast("double").alias("v"))
    return m, b, m.field(b, "v", (720,), values=values)


def one_row(**columns: DataFrame) -> DataFrame:
    """The single values ``r0`` of several reductions as one row; each is a row already."""
    out = None
    for name, df in columns.items():
        own = df.select(F.lit(1).alias("__one"), F.col("r0").alias(name))
        out = own if out is None else out.join(own, "__one")
    return out.drop("__one")


# loops and stencils


def average(v, new) -> None:
    new[0, 0] = 0.25 * (v[1, 0] + v[-1, 0] + v[0, 1] + v[0, -1])


def change(v, new, most, total) -> None:
    average(v, new)
    most.add(F.abs(new[0, 0] - v[0, 0]))
    total.add(new[0, 0])


STEP_SQL = f"n1 AS (SELECT i, j, CASE WHEN {WITHIN} THEN 0.25 * (e + w + n + s) ELSE v END AS v FROM (SELECT i, j, v, {NEAR.format(t='g')}))"


@query("stencil_five_point", f"WITH {G2}, {STEP_SQL} SELECT i, j, v AS new FROM n1")
def stencil_five_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b, v = grid2(spark, sf_dir)
    new = slabs.copied(m, v, "new")
    m.loop("average", b, [1, 39, 1, 24], average, v=read(v, Stencil.star(2)), new=write(new))
    return m.table(new)


@query("loop_with_reductions", f"WITH {G2}, {STEP_SQL} SELECT max(abs(n1.v - g.v)) AS most, sum(n1.v) AS total FROM n1 JOIN g USING (i, j) WHERE {WITHIN}")
def loop_with_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a five-point step, with its largest change and its sum."""
    m, b, v = grid2(spark, sf_dir)
    new = m.field(b, "new", (40, 25))
    most, total = Reduction("most"), Reduction("total")
    m.loop("change", b, [1, 39, 1, 24], change, v=read(v, Stencil.star(2)), new=write(new), most=Reduce(most, MAX), total=Reduce(total, INC))
    return one_row(most=most.frame(), total=total.frame())


@query("loop_pointwise_box", f"WITH {G2} SELECT i, j, CASE WHEN i BETWEEN 5 AND 19 AND j BETWEEN 3 AND 8 THEN v * 3 + i + 10 * j ELSE v END AS v FROM g")
def loop_pointwise_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b, v = grid2(spark, sf_dir)

    def scale(v, by, at) -> None:
        v[0, 0] = v[0, 0] * by + at[0] + 10 * at[1]

    m.loop("scale", b, [5, 20, 3, 9], scale, v=rw(v), by=Gbl(3), at=Idx())
    return m.table(v)


@query("loop_empty_range", "SELECT CAST(0 AS DOUBLE) AS total, CAST(1.7976931348623157e308 AS DOUBLE) AS least, CAST(-1.7976931348623157e308 AS DOUBLE) AS most")
def loop_empty_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b, v = grid2(spark, sf_dir)
    total, least, most = Reduction("total"), Reduction("least"), Reduction("most")

    def look(v, total, least, most) -> None:
        for r in (total, least, most):
            r.add(v[0, 0])

    m.loop("look", b, [7, 7, 3, 1], look, v=read(v), total=Reduce(total, INC), least=Reduce(least, MIN), most=Reduce(most, MAX))
    return one_row(total=total.frame(), least=least.frame(), most=most.frame())


@query("loop_boundary_faces", f"WITH {G2} SELECT i, j, CASE WHEN i = 0 OR i = 39 THEN 0 WHEN j = 0 OR j = 24 THEN i ELSE v END AS v FROM g")
def loop_boundary_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b, v = grid2(spark, sf_dir)

    def number(v, at) -> None:
        v[0, 0] = at[0].cast("double")

    def zero(v) -> None:
        v[0, 0] = 0.0

    for box in ([0, 40, 0, 1], [0, 40, 24, 25]):
        m.loop("number", b, box, number, v=write(v), at=Idx())
    for box in ([0, 1, 0, 25], [39, 40, 0, 25]):
        m.loop("zero", b, box, zero, v=write(v))
    return m.table(v)


@query(
    "loop_mirror_halo",
    f"WITH {G2} SELECT i, j, v FROM g UNION ALL SELECT -1, j, -v FROM g WHERE i = 0 UNION ALL SELECT -2, j, -v FROM g WHERE i = 1 UNION ALL SELECT 40, j, v FROM g WHERE i = 39 UNION ALL SELECT 41, j, v FROM g WHERE i = 38",
)
def loop_mirror_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reflection at both ends of an axis, with a change of sign at the lower one."""
    m, b, v = grid2(spark, sf_dir, below=(-2, 0), above=(2, 0))
    far = Stencil("mirror", ((0, 0), (1, 0), (3, 0), (-1, 0), (-3, 0)))
    for at, offset, sign in ((-1, 1, -1), (-2, 3, -1), (40, -1, 1), (41, -3, 1)):

        def mirror(v, offset=offset, sign=sign) -> None:
            v[0, 0] = v[offset, 0] * sign

        m.loop("mirror", b, [at, at + 1, 0, 25], mirror, v=rw(v, far))
    return m.table(v)


@query("loop_masked_update", f"WITH {G2} SELECT i, j, CASE WHEN v % 3 = 0 THEN -v ELSE v / 2 END AS v FROM g")
def loop_masked_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b, v = grid2(spark, sf_dir)
    solid = m.field(b, "solid", (40, 25), dtype="int")

    def mark(v, solid) -> None:
        solid[0, 0] = (v[0, 0] % 3 == 0).cast("int")

    def update(v, solid) -> None:
        v[0, 0] = F.when(solid[0, 0] == 1, -v[0, 0]).otherwise(v[0, 0] / 2)

    m.loop("mark", b, [0, 40, 0, 25], mark, v=read(v), solid=write(solid))
    m.loop("update", b, [0, 40, 0, 25], update, v=rw(v), solid=read(solid))
    return m.table(v)


@query(
    "region_initialisation",
    "SELECT CAST(a.range AS INT) AS i, CAST(b.range AS INT) AS j, CAST(CASE WHEN a.range = 17 AND b.range = 4 THEN 4 WHEN (a.range - 20) * (a.range - 20) + (b.range - 12) * (b.range - 12) <= 36 THEN 3 WHEN a.range >= 5 AND a.range < 25 AND b.range >= 2 AND b.range < 14 THEN 2 ELSE 1 END AS DOUBLE) AS state FROM range(40) a CROSS JOIN range(25) b",
)
def region_initialisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Background, rectangle, circle and point states; a later state wins."""
    m = Mesh(spark)
    b = m.block("parts", 2)
    state = m.field(b, "state", (40, 25))

    def put(state, at) -> None:
        i, j = at
        value = F.lit(1.0)
        for where, x in ((inside(((5, 25), (2, 14)), ("i", "j")), 2.0), ((i - 20) * (i - 20) + (j - 12) * (j - 12) <= 36, 3.0), ((i == 17) & (j == 4), 4.0)):
            value = F.when(where, F.lit(x)).otherwise(value)
        state[0, 0] = value

    m.loop("put", b, [0, 40, 0, 25], put, state=write(state), at=Idx())
    return m.table(state)


@query("constants_and_options", f"WITH {G2} SELECT i, j, (v + 5) * 7 AS v FROM g")
def constants_and_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constant that is updated between loops, and an argument that is switched off."""
    m, b, v = grid2(spark, sf_dir)
    m.constant("c", 5)

    def add(v, extra) -> None:
        v[0, 0] = v[0, 0] + m.constants["c"] + (extra[0, 0] if extra else 0)

    def times(v) -> None:
        v[0, 0] = v[0, 0] * m.constants["c"]

    m.loop("add", b, [0, 40, 0, 25], add, v=rw(v), extra=Opt(read(v), False))
    m.constant("c", 7)
    m.loop("times", b, [0, 40, 0, 25], times, v=rw(v))
    return m.table(v)


@query(
    "stencil_nine_point",
    f"WITH {G2} SELECT g.i, g.j, CASE WHEN g.i BETWEEN 1 AND 38 AND g.j BETWEEN 1 AND 23 THEN s.v ELSE g.v END AS v FROM g LEFT JOIN (SELECT a.i, a.j, sum(b.v) AS v FROM g a JOIN g b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY a.i, a.j) s ON s.i = g.i AND s.j = g.j",
)
def stencil_nine_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b, v = grid2(spark, sf_dir)
    box9 = Stencil("box9", tuple((x, y) for y in (-1, 0, 1) for x in (-1, 0, 1)))

    def total(v) -> None:
        out = v[0, 0]
        for p in box9.points:
            if any(p):
                out = out + v[p]
        v[0, 0] = out

    m.loop("total", b, [1, 39, 1, 24], total, v=rw(v, box9))
    return m.table(v)


@query(
    "stencil_seven_point_3d",
    f"WITH {G3} SELECT i, j, k, CASE WHEN i BETWEEN 1 AND 8 AND j BETWEEN 1 AND 8 AND k BETWEEN 1 AND 5 THEN lag(v) OVER x + lead(v) OVER x + lag(v) OVER y + lead(v) OVER y + lag(v) OVER z + lead(v) OVER z - 6 * v ELSE 0 END AS new FROM g WINDOW x AS (PARTITION BY j, k ORDER BY i), y AS (PARTITION BY i, k ORDER BY j), z AS (PARTITION BY i, j ORDER BY k)",
)
def stencil_seven_point_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b, v = grid3(spark, sf_dir)
    new = m.field(b, "new", (10, 10, 7))
    star = Stencil.star(3)

    def laplace(v, new) -> None:
        out = -6 * v[0, 0, 0]
        for p in star.points[1:]:
            out = out + v[p]
        new[0, 0, 0] = out

    m.loop("laplace", b, [1, 9, 1, 9, 1, 6], laplace, v=read(v, star), new=write(new))
    return m.table(new)


@query("stencil_wide_1d", f"WITH {G1} SELECT i, CASE WHEN i BETWEEN 4 AND 715 THEN 8 * (lead(v, 1) OVER w - lag(v, 1) OVER w) + 3 * (lead(v, 2) OVER w - lag(v, 2) OVER w) + 2 * (lead(v, 3) OVER w - lag(v, 3) OVER w) + lead(v, 4) OVER w - lag(v, 4) OVER w ELSE 0 END AS new FROM g WINDOW w AS (ORDER BY i)")
def stencil_wide_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b, v = grid1(spark, sf_dir)
    new = m.field(b, "new", (720,))

    def derivative(v, new) -> None:
        new[0,] = sum((c * (v[d,] - v[-d,]) for d, c in ((2, 3), (3, 2), (4, 1))), 8 * (v[1,] - v[-1,]))

    m.loop("derivative", b, [4, 716], derivative, v=read(v, Stencil.star(1, 4)), new=write(new))
    return m.table(new)


@query("multi_component", f"WITH {G2} SELECT i, j, CAST(v AS DOUBLE) AS a, CAST(2 * v + i AS DOUBLE) AS b FROM g")
def multi_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b, v = grid2(spark, sf_dir)
    pair = m.field(b, "pair", (40, 25), dim=2)

    def fill(v, pair, at) -> None:
        pair[0, 0, 0] = v[0, 0]
        pair[1, 0, 0] = 2 * v[0, 0] + at[0]

    m.loop("fill", b, [0, 40, 0, 25], fill, v=read(v), pair=write(pair), at=Idx())
    return m.table(pair).select("i", "j", F.get("pair", 0).alias("a"), F.get("pair", 1).alias("b"))


@query("increment_field", f"WITH {G2} SELECT i, j, CASE WHEN i < 10 THEN v + 3 * i ELSE v END AS v FROM g")
def increment_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b, v = grid2(spark, sf_dir)

    def more(v, at) -> None:
        v.add(at[0])
        v.add(2 * at[0])

    m.loop("more", b, [0, 10, 0, 25], more, v=inc(v), at=Idx())
    return m.table(v)


@query("stencil_staggered", f"WITH {G2} SELECT a.range::INT AS i, b.range::INT AS j, coalesce(CASE WHEN a.range BETWEEN 1 AND 39 AND b.range BETWEEN 1 AND 24 THEN (g.v + w.v + s.v + t.v) / 4 END, 0) AS node FROM range(41) a CROSS JOIN range(26) b LEFT JOIN g ON g.i = a.range AND g.j = b.range LEFT JOIN g w ON w.i = a.range - 1 AND w.j = b.range LEFT JOIN g s ON s.i = a.range AND s.j = b.range - 1 LEFT JOIN g t ON t.i = a.range - 1 AND t.j = b.range - 1")
def stencil_staggered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes from cells: fields of different size on one block."""
    m, b, v = grid2(spark, sf_dir)
    node = m.field(b, "node", (41, 26))

    def mean(v, node) -> None:
        node[0, 0] = (v[0, 0] + v[-1, 0] + v[0, -1] + v[-1, -1]) / 4

    m.loop("mean", b, [1, 40, 1, 25], mean, v=read(v, Stencil("corner", ((0, 0), (-1, 0), (0, -1), (-1, -1)))), node=write(node))
    return m.table(node)


@query(
    "stencil_cross_terms_3d",
    f"WITH {G3} SELECT g.i, g.j, g.k, CASE WHEN g.i BETWEEN 2 AND 7 AND g.j BETWEEN 2 AND 7 AND g.k BETWEEN 2 AND 4 THEN c.v ELSE 0 END AS new FROM g JOIN (SELECT a.i, a.j, a.k, sum(b.v * CASE WHEN (b.i - a.i) * (b.j - a.j) + (b.j - a.j) * (b.k - a.k) > 0 THEN 1 ELSE -1 END) AS v FROM g a JOIN g b ON abs(a.i - b.i) <= 2 AND abs(a.j - b.j) <= 2 AND abs(a.k - b.k) <= 2 AND ((abs(a.i - b.i) = 2 AND abs(a.j - b.j) = 2 AND a.k = b.k) OR (a.i = b.i AND abs(a.j - b.j) = 2 AND abs(a.k - b.k) = 2)) GROUP BY a.i, a.j, a.k) c USING (i, j, k)",
)
def stencil_cross_terms_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed second differences: corners two cells off in two planes."""
    m, b, v = grid3(spark, sf_dir)
    new = m.field(b, "new", (10, 10, 7))
    signs = {(x, y, 0): x * y // 4 for x in (-2, 2) for y in (-2, 2)} | {(0, y, z): y * z // 4 for y in (-2, 2) for z in (-2, 2)}

    def mixed(v, new) -> None:
        out = F.lit(0.0)
        for p, s in signs.items():
            out = out + s * v[p]
        new[0, 0, 0] = out

    m.loop("mixed", b, [2, 8, 2, 8, 2, 5], mixed, v=read(v, Stencil("cross", tuple(signs))), new=write(new))
    return m.table(new)


#: Weights of the second difference of eighth order, from the centre outward.
EIGHTH = (-205 / 72, 8 / 5, -1 / 5, 8 / 315, -1 / 560)


def _eighth_sql() -> str:
    pair = lambda w: " + ".join(f"{c!r} * (coalesce(lag(v, {d}) OVER {w}, 0) + coalesce(lead(v, {d}) OVER {w}, 0))" for d, c in enumerate(EIGHTH) if d)
    sides = " + ".join(f"({pair(w)})" for w in "xyz")
    return f"SELECT i, j, k, round({3 * EIGHTH[0]!r} * v + {sides}, 6) AS new FROM g WINDOW x AS (PARTITION BY j, k ORDER BY i), y AS (PARTITION BY i, k ORDER BY j), z AS (PARTITION BY i, j ORDER BY k)"


@query("stencil_25_point_3d", f"WITH {G3} {_eighth_sql()}")
def stencil_25_point_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Laplacian of a wave kernel: four neighbours each way along three axes, zero beyond the grid."""
    m = Mesh(spark)
    b = m.block("lines", 3)
    at = (F.col("l_suppkey") % 10).cast("int").alias("i"), (F.col("l_partkey") % 10).cast("int").alias("j"), (F.col("l_linenumber") - 1).cast("int").alias("k")
    halo4 = {"below": (-4, -4, -4), "above": (4, 4, 4)}
    v = m.field(b, "v", (10, 10, 7), values=lineitem(spark, sf_dir).groupBy(*at).agg(F.sum("l_quantity").alias("v")), **halo4)
    new = m.field(b, "new", (10, 10, 7), **halo4)
    star = Stencil.star(3, reach=4)

    def laplacian(v, new) -> None:
        out = 3 * EIGHTH[0] * v[0, 0, 0]
        for p in star.points[1:]:
            out = out + EIGHTH[max(map(abs, p))] * v[p]
        new[0, 0, 0] = out

    m.loop("laplacian", b, [0, 10, 0, 10, 0, 7], laplacian, v=read(v, star), new=write(new))
    return slabs.interior(m, new).withColumn("new", F.round("new", 6))


GAMMA = 1.4
WAVES_SQL = f"""{G1}, s AS (SELECT i, 1 + v / 100 AS r, (v % 7) / 10 - 0.3 AS u, 1 + v / 50 AS p FROM g),
q AS (SELECT i, r, r * u AS m, p / ({GAMMA} - 1) + 0.5 * r * u * u AS e, u, sqrt(r) AS w, (p / ({GAMMA} - 1) + 0.5 * r * u * u + p) / r AS h FROM s),
n AS (SELECT i, lead(r) OVER o - r AS dr, lead(m) OVER o - m AS dm, lead(e) OVER o - e AS de,
      (w * u + lead(w) OVER o * lead(u) OVER o) / (w + lead(w) OVER o) AS ru, (w * h + lead(w) OVER o * lead(h) OVER o) / (w + lead(w) OVER o) AS rh FROM q WINDOW o AS (ORDER BY i)),
c AS (SELECT *, sqrt(({GAMMA} - 1) * (rh - 0.5 * ru * ru)) AS a FROM n),
z AS (SELECT *, ({GAMMA} - 1) / (a * a) * ((rh - ru * ru) * dr + ru * dm - de) AS a2 FROM c),
y AS (SELECT *, (dr * (ru + a) - dm - a * a2) / (2 * a) AS a1 FROM z),
waves AS (SELECT i, a1, a2, dr - a1 - a2 AS a3 FROM y)"""


def _limited_sql(x: str) -> str:
    return f"CASE WHEN i BETWEEN 1 AND 718 AND lag({x}) OVER o * {x} > 0 THEN CASE WHEN {x} < 0 THEN -1 ELSE 1 END * least(abs(lag({x}) OVER o), abs({x})) ELSE 0 END"


@query(
    "riemann_tvd",
    f"WITH {WAVES_SQL} SELECT i, " + ", ".join(f"round(CASE WHEN i < 719 THEN a{k} ELSE 0 END, 7) AS wave{k}, round({_limited_sql(f'a{k}')}, 7) AS limited{k}" for k in (1, 2, 3)) + " FROM waves WINDOW o AS (ORDER BY i)",
)
def riemann_tvd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strengths of the three waves between neighbouring gas states, by Roe's averages of velocity and
    enthalpy, and each limited to the smaller of neighbouring ones of its family."""
    m, b, v = grid1(spark, sf_dir)
    gas = m.field(b, "gas", (720,), dim=3)
    waves, limited = m.field(b, "waves", (720,), dim=3), m.field(b, "limited", (720,), dim=3)
    ahead, behind = Stencil("ahead", ((0,), (1,))), Stencil("behind", ((0,), (-1,)))

    def start(v, gas) -> None:
        density, speed, pressure = 1 + v[0,] / 100, (v[0,] % 7) / 10 - 0.3, 1 + v[0,] / 50
        gas[0, 0], gas[1, 0], gas[2, 0] = density, density * speed, pressure / (GAMMA - 1) + 0.5 * density * speed * speed

    def decompose(gas, waves) -> None:
        def state(at: int) -> list[Column]:
            density, momentum, energy = (gas[c, at] for c in range(3))
            speed = momentum / density
            pressure = (GAMMA - 1) * (energy - 0.5 * density * speed * speed)
            return [F.sqrt(density), speed, (energy + pressure) / density]

        (w0, u0, h0), (w1, u1, h1) = state(0), state(1)
        speed, enthalpy = (w0 * u0 + w1 * u1) / (w0 + w1), (w0 * h0 + w1 * h1) / (w0 + w1)
        sound = F.sqrt((GAMMA - 1) * (enthalpy - 0.5 * speed * speed))
        density, momentum, energy = (gas[c, 1] - gas[c, 0] for c in range(3))
        middle = (GAMMA - 1) / (sound * sound) * ((enthalpy - speed * speed) * density + speed * momentum - energy)
        left = (density * (speed + sound) - momentum - sound * middle) / (2 * sound)
        waves[0, 0], waves[1, 0], waves[2, 0] = left, middle, density - left - middle

    def limit(waves, limited) -> None:
        for c in range(3):
            old, new = waves[c, -1], waves[c, 0]
            limited[c, 0] = F.when(old * new > 0, F.sign(new) * F.least(F.abs(old), F.abs(new))).otherwise(0.0)

    m.loop("start", b, [0, 720], start, v=read(v), gas=write(gas))
    m.loop("decompose", b, [0, 719], decompose, gas=read(gas, ahead), waves=write(waves))
    m.loop("limit", b, [1, 719], limit, waves=read(waves, behind), limited=write(limited))
    both = m.tables[m.key(waves)]
    return both.select("i", *(F.round(F.get(x, c), 7).alias(f"{n}{c + 1}") for x, n in (("waves", "wave"), ("limited", "limited")) for c in range(3)))


@query("stencil_flux_limiter", f"WITH {G1} SELECT i, CASE WHEN i BETWEEN 1 AND 718 THEN CASE WHEN l * r > 0 THEN CASE WHEN l < 0 THEN -1 ELSE 1 END * least(abs(l), abs(r)) ELSE 0 END ELSE 0 END AS slope FROM (SELECT i, v - lag(v) OVER w AS l, lead(v) OVER w - v AS r FROM g WINDOW w AS (ORDER BY i))")
def stencil_flux_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smaller of the two one-sided differences where they agree in sign."""
    m, b, v = grid1(spark, sf_dir)
    slope = m.field(b, "slope", (720,))

    def limit(v, slope) -> None:
        left, right = v[0,] - v[-1,], v[1,] - v[0,]
        slope[0,] = F.when(left * right > 0, scalar.sign(F.least(F.abs(left), F.abs(right)), left)).otherwise(0.0)

    m.loop("limit", b, [1, 719], limit, v=read(v, Stencil.star(1)), slope=write(slope))
    return m.table(slope)


@query("scalar_functions", f"WITH {G2} SELECT i, j, CASE WHEN i < 20 THEN -v ELSE v END AS signed, least(v, i, j) AS low, greatest(v, i, j) AS high, round(sqrt(v) + sin(i) * cos(j) + exp(-j) + pow(i, 2), 6) AS math FROM g")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b, v = grid2(spark, sf_dir)
    out = {x: m.field(b, x, (40, 25)) for x in ("signed", "low", "high", "math")}

    def fill(v, at, signed, low, high, math) -> None:
        i, j = (x.cast("double") for x in at)
        signed[0, 0] = scalar.sign(v[0, 0], i - 20)
        low[0, 0], high[0, 0] = scalar.min3(v[0, 0], i, j), scalar.max3(v[0, 0], i, j)
        math[0, 0] = F.round(F.sqrt(v[0, 0]) + F.sin(i) * F.cos(j) + F.exp(-j) + F.pow(i, F.lit(2)), 6)

    m.loop("fill", b, [0, 40, 0, 25], fill, v=read(v), at=Idx(), **{k: write(f) for k, f in out.items()})
    return m.tables[m.key(v)].select("i", "j", *out)


@query("half_precision", f"WITH {G2} SELECT i, j, CAST(v % 512 + 512.5 AS DOUBLE) AS h FROM g")
def half_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between 512 and 1024 half precision has steps of one half."""
    m, b, v = grid2(spark, sf_dir)
    h = m.field(b, "h", (40, 25), dtype="half")

    def fill(v, h) -> None:
        h[0, 0] = v[0, 0] % 512 + 512.6

    m.loop("fill", b, [0, 40, 0, 25], fill, v=read(v), h=write(h))
    return m.table(h).select("i", "j", F.col("h").cast("double").alias("h"))


# reductions


@query("reduce_global", f"WITH {G2} SELECT sum(v) AS total, min(v) AS least, max(v) AS most FROM g WHERE i BETWEEN 3 AND 30 AND j BETWEEN 2 AND 20")
def reduce_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b, v = grid2(spark, sf_dir)
    total, least, most = Reduction("total"), Reduction("least"), Reduction("most")

    def look(v, total, least, most) -> None:
        for r in (total, least, most):
            r.add(v[0, 0])

    m.loop("look", b, [3, 31, 2, 21], look, v=read(v), total=Reduce(total, INC), least=Reduce(least, MIN), most=Reduce(most, MAX))
    return one_row(total=total.frame(), least=least.frame(), most=most.frame())


@query("reduce_vector", f"WITH {G2} SELECT CAST(sum(v * i) AS DOUBLE) AS r0, CAST(sum(v * j) AS DOUBLE) AS r1, CAST(sum(v) AS DOUBLE) AS r2 FROM g")
def reduce_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b, v = grid2(spark, sf_dir)
    r = Reduction("moments", dim=3)

    def moments(v, at, r) -> None:
        r.add(v[0, 0] * at[0], 0)
        r.add(v[0, 0] * at[1], 1)
        r.add(v[0, 0], 2)

    m.loop("moments", b, [0, 40, 0, 25], moments, v=read(v), at=Idx(), r=Reduce(r, INC))
    return r.frame()


@query("reduce_across_loops", f"WITH {G2}, h AS (WITH {G3} SELECT v FROM g) SELECT (SELECT sum(v) FROM g WHERE i < 5) + (SELECT sum(v) FROM g WHERE i >= 30) + (SELECT sum(v) FROM h) AS r0")
def reduce_across_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One handle over two loops of one block and one of another."""
    (m, b, v), (m3, b3, v3) = grid2(spark, sf_dir), grid3(spark, sf_dir)
    r = Reduction("total")

    def total2(v, r) -> None:
        r.add(v[0, 0])

    def total3(v, r) -> None:
        r.add(v[0, 0, 0])

    m.loop("low", b, [0, 5, 0, 25], total2, v=read(v), r=Reduce(r, INC))
    m.loop("high", b, [30, 40, 0, 25], total2, v=read(v), r=Reduce(r, INC))
    m3.loop("all", b3, [0, 10, 0, 10, 0, 7], total3, v=read(v3), r=Reduce(r, INC))
    return r.frame()


@query("reduce_complex", f"WITH {G2} SELECT CAST(sum(v * i - j) AS DOUBLE) AS re, CAST(sum(i + v * j) AS DOUBLE) AS im FROM g")
def reduce_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of (v + I) (i + j I)."""
    m, b, v = grid2(spark, sf_dir)
    z = m.field(b, "z", (40, 25), dtype="complexd")
    r = Reduction("total", dtype="complexd")

    def number(v, z, at) -> None:
        z[0, 0] = scalar.complex_mul(scalar.complex_of(v[0, 0], F.lit(1.0)), scalar.complex_of(at[0].cast("double"), at[1].cast("double")))

    def total(z, r) -> None:
        r.add(z[0, 0])

    m.loop("number", b, [0, 40, 0, 25], number, v=read(v), z=write(z), at=Idx())
    m.loop("total", b, [0, 40, 0, 25], total, z=read(z), r=Reduce(r, INC))
    return r.frame().select("r0.re", "r0.im")


@query("reduce_write", f"WITH {G2} SELECT coalesce((SELECT v FROM g WHERE v <> 0 AND (i + j) % 3 = 0 ORDER BY j DESC, i DESC LIMIT 1), 0) AS last, (SELECT sum(v) FROM g) AS total")
def reduce_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A handle with WRITE has what the last cell wrote that is not zero; another one sums in the same loop."""
    m, b, v = grid2(spark, sf_dir)
    last, total = Reduction("last"), Reduction("total")

    def found(v, at, last, total) -> None:
        last.add(F.when((at[0] + at[1]) % 3 == 0, v[0, 0]).otherwise(0.0))
        total.add(v[0, 0])

    m.loop("found", b, [0, 40, 0, 25], found, v=read(v), at=Idx(), last=Reduce(last, WRITE), total=Reduce(total, INC))
    return one_row(last=last.frame(), total=total.frame())


@query("reduce_point_probe", f"WITH {G2} SELECT sum(v) AS r0 FROM g WHERE i = 12 AND j = 7")
def reduce_point_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b, v = grid2(spark, sf_dir)
    r = Reduction("probe")

    def probe(v, r) -> None:
        r.add(v[0, 0])

    m.loop("probe", b, [12, 13, 7, 8], probe, v=read(v), r=Reduce(r, INC))
    return r.frame()


@query("reduce_dot_and_errors", f"WITH {G2} SELECT sum(v * (v + 1)) AS dot, sum(CASE WHEN v > 500 THEN 1 ELSE 0 END)::DOUBLE AS errors FROM g")
def reduce_dot_and_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b, v = grid2(spark, sf_dir)
    dot, errors = Reduction("dot"), Reduction("errors")

    def fold(v, dot, errors) -> None:
        dot.add(v[0, 0] * (v[0, 0] + 1))
        errors.add(F.when(v[0, 0] > 500, 1).otherwise(0))

    m.loop("fold", b, [0, 40, 0, 25], fold, v=read(v), dot=Reduce(dot, INC), errors=Reduce(errors, INC))
    return one_row(dot=dot.frame(), errors=errors.frame())


@query("nan_check", "SELECT 3 AS i, 2 AS j")
def nan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b, v = grid2(spark, sf_dir)

    def spoil(v) -> None:
        v[0, 0] = F.lit(float("nan"))

    for box in ([3, 9, 2, 3], [0, 2, 5, 9]):
        m.loop("spoil", b, box, spoil, v=write(v))
    return slabs.first_nan(m, v).select("i", "j")


# fields with collapsed axes


@query(
    "lowdim_planes",
    f"WITH {G3} SELECT 'xy' AS plane, i AS a, j AS b, max(v) AS v FROM g GROUP BY i, j UNION ALL SELECT 'xz', i, k, sum(v) FROM g GROUP BY i, k UNION ALL SELECT 'yz', j, k, min(v) FROM g GROUP BY j, k",
)
def lowdim_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One loop that folds onto three planes."""
    m, b, v = grid3(spark, sf_dir)
    xy, xz, yz = m.field(b, "xy", (10, 10, 1)), m.field(b, "xz", (10, 1, 7)), m.field(b, "yz", (1, 10, 7))
    point = Stencil.point(3)

    def fold(v, xy, xz, yz) -> None:
        for f in (xy, xz, yz):
            f.add(v[0, 0, 0])

    m.loop("fold", b, [0, 10, 0, 10, 0, 7], fold, v=read(v), xy=Dat(xy, point, MAX), xz=Dat(xz, point, INC), yz=Dat(yz, point, MIN))
    parts = [m.table(f).select(F.lit(f.name).alias("plane"), F.col(f.axes[0]).alias("a"), F.col(f.axes[1]).alias("b"), F.col(f.name).alias("v")) for f in (xy, xz, yz)]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    "lowdim_reinitialise",
    f"WITH {G3} SELECT i, sum(CASE WHEN j < 5 THEN v ELSE 0 END) + sum(CASE WHEN j >= 5 THEN v ELSE 0 END) AS twice, min(CASE WHEN j >= 5 THEN v END) AS again FROM g GROUP BY i",
)
def lowdim_reinitialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loops add up; a read, and another access, start afresh."""
    m, b, v = grid3(spark, sf_dir)
    line = m.field(b, "line", (10, 1, 1))
    point = Stencil.point(3)

    def fold(v, line) -> None:
        line.add(v[0, 0, 0])

    low, high = [0, 10, 0, 5, 0, 7], [0, 10, 5, 10, 0, 7]
    for box in (low, high):
        m.loop("add", b, box, fold, v=read(v), line=Dat(line, point, INC))
    twice = m.table(line).withColumnRenamed("line", "twice")
    for box in (low, high):
        m.loop("least", b, box, fold, v=read(v), line=Dat(line, point, MIN))
        m.table(line)
    return twice.join(m.table(line).withColumnRenamed("line", "again"), "i")


@query("lowdim_components", f"WITH {G3} SELECT i, sum(v) AS total, sum(v * k) AS moment, arg_max(v, k * 100 + j) AS last FROM g GROUP BY i")
def lowdim_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two components folded onto a line in one loop; of a plain write the last cell stays."""
    m, b, v = grid3(spark, sf_dir)
    sums, last = m.field(b, "sums", (10, 1, 1), dim=2), m.field(b, "last", (10, 1, 1))
    point, box = Stencil.point(3), [0, 10, 0, 10, 0, 7]

    def fold(v, sums, last, at) -> None:
        sums.add(v[0, 0, 0], 0)
        sums.add(v[0, 0, 0] * at[2], 1)
        last[0, 0, 0] = v[0, 0, 0]

    m.loop("fold", b, box, fold, v=read(v), sums=Dat(sums, point, INC), last=write(last), at=Idx())
    return m.table(sums).select("i", F.get("sums", 0).alias("total"), F.get("sums", 1).alias("moment")).join(m.table(last), "i")


@query("lowdim_strided_read", f"WITH {G3}, p AS (SELECT i, j, sum(v) AS p FROM g GROUP BY i, j) SELECT i, j, k, v * 100 - p AS new FROM g JOIN p USING (i, j)")
def lowdim_strided_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane read back by a loop over the whole grid."""
    m, b, v = grid3(spark, sf_dir)
    plane, new = m.field(b, "plane", (10, 10, 1)), m.field(b, "new", (10, 10, 7))
    box = [0, 10, 0, 10, 0, 7]

    def fold(v, plane) -> None:
        plane.add(v[0, 0, 0])

    def spread(v, plane, new) -> None:
        new[0, 0, 0] = v[0, 0, 0] * 100 - plane[0, 0, 0]

    m.loop("fold", b, box, fold, v=read(v), plane=Dat(plane, Stencil.point(3), INC))
    m.loop("spread", b, box, spread, v=read(v), plane=read(plane), new=write(new))
    return m.table(new)


# halos


def two_blocks(spark: SparkSession, sf_dir: str, **other) -> tuple[Mesh, Field, Field]:
    m, _, v = grid2(spark, sf_dir)
    b = m.block("target", 2)
    return m, v, m.field(b, "w", **({"size": (40, 25), "below": (-2, -2), "above": (2, 2)} | other))


_SHIFTED = "SELECT CAST(a.range - 2 AS INT) AS i, CAST(b.range - 2 AS INT) AS j, coalesce({v}, 0) AS w FROM range(44) a CROSS JOIN range(29) b LEFT JOIN g ON {on}"


@query("halo_periodic", f"WITH {G2} " + _SHIFTED.format(v="g.v", on="((a.range - 2 < 0 AND g.i = a.range - 2 + 40) OR (a.range - 2 >= 40 AND g.i = a.range - 2 - 40)) AND g.j = b.range - 2"))
def halo_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, v, w = two_blocks(spark, sf_dir)
    halo.transfer(m, [Halo(v, w, (2, 25), (38, 0), (-2, 0), (1, 2), (1, 2)), Halo(v, w, (2, 25), (0, 0), (40, 0), (1, 2), (1, 2))])
    return m.table(w)


@query("halo_flip", f"WITH {G2} " + _SHIFTED.format(v="g.v", on="a.range - 2 >= 40 AND g.i = a.range - 2 - 40 AND g.j = 24 - (b.range - 2)"))
def halo_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, v, w = two_blocks(spark, sf_dir)
    halo.transfer(m, [Halo(v, w, (2, 25), (0, 0), (40, 0), (1, 2), (1, -2))])
    return m.table(w)


@query("halo_rotate", f"WITH {G2} " + _SHIFTED.format(v="g.v", on="b.range - 2 < 0 AND g.i = 38 + (b.range - 2 + 2) AND g.j = a.range - 2 AND a.range - 2 BETWEEN 0 AND 24"))
def halo_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two columns become two rows below the target."""
    m, v, w = two_blocks(spark, sf_dir)
    halo.transfer(m, [Halo(v, w, (2, 25), (38, 0), (0, -2), (1, 2), (2, 1))])
    return m.table(w)


@query("halo_group_snapshot", f"WITH {G2} SELECT i, j, v FROM g UNION ALL SELECT i - 40, j, v FROM g WHERE i >= 39 UNION ALL SELECT i + 40, j, v FROM g WHERE i < 1")
def halo_group_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field's own periodic halos, both from the state before."""
    m, _, v = grid2(spark, sf_dir, below=(-1, 0), above=(1, 0))
    halo.transfer(m, [Halo(v, v, (1, 25), (39, 0), (-1, 0), (1, 2), (1, 2)), Halo(v, v, (1, 25), (0, 0), (40, 0), (1, 2), (1, 2))])
    return m.table(v)


@query("halo_mixed_precision", f"WITH {G2} SELECT CAST(a.range AS INT) AS i, CAST(b.range AS INT) AS j, CAST(CASE WHEN a.range < 2 THEN CAST(g.v / 4 + 100000000.0 AS FLOAT) ELSE 0 END AS DOUBLE) AS w FROM range(40) a CROSS JOIN range(25) b LEFT JOIN g ON g.i = a.range + 38 AND g.j = b.range")
def halo_mixed_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, v, w = two_blocks(spark, sf_dir, below=(0, 0), above=(0, 0), dtype="float")

    def large(v) -> None:
        v[0, 0] = v[0, 0] / 4 + 100000000.0

    m.loop("large", v.block, [0, 40, 0, 25], large, v=rw(v))
    halo.transfer(m, [Halo(v, w, (2, 25), (38, 0), (0, 0), (1, 2), (1, 2))])
    return m.table(w).select("i", "j", F.col("w").cast("double").alias("w"))


# multigrid


@query("multigrid_restrict", f"WITH {G2} SELECT c.i // 2 AS i, c.j // 5 AS j, c.v + r.v AS coarse FROM g c JOIN g r ON r.i = c.i + 1 AND r.j = c.j WHERE c.i % 2 = 0 AND c.j % 5 = 0")
def multigrid_restrict(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b, v = grid2(spark, sf_dir)
    coarse = m.field(b, "coarse", (20, 5), stride=(2, 5))
    pair = Stencil("pair", ((0, 0), (1, 0)), "restrict", (2, 5))

    def add(v, coarse) -> None:
        coarse[0, 0] = v[0, 0] + v[1, 0]

    m.loop("restrict", b, [0, 20, 0, 5], add, v=read(v, pair), coarse=write(coarse))
    return m.table(coarse)


@query("multigrid_prolong", f"WITH {G2}, c AS (SELECT i // 2 AS i, j // 5 AS j, v FROM g WHERE i % 2 = 0 AND j % 5 = 0) SELECT g.i, g.j, c.v + CASE WHEN g.i % 2 = 1 AND n.v IS NOT NULL THEN n.v ELSE c.v END AS fine FROM g JOIN c ON c.i = g.i // 2 AND c.j = g.j // 5 LEFT JOIN c n ON n.i = g.i // 2 + 1 AND n.j = g.j // 5")
def multigrid_prolong(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b, v = grid2(spark, sf_dir)
    coarse, fine = m.field(b, "coarse", (20, 5), stride=(2, 5)), m.field(b, "fine", (40, 25))
    up = Stencil("up", ((0, 0), (1, 0)), "prolong", (2, 5))

    def pick(v, coarse) -> None:
        coarse[0, 0] = v[0, 0]

    def spread(coarse, fine, at) -> None:
        fine[0, 0] = coarse[0, 0] + F.when((at[0] % 2 == 1) & coarse[1, 0].isNotNull(), coarse[1, 0]).otherwise(coarse[0, 0])

    m.loop("pick", b, [0, 20, 0, 5], pick, v=read(v, Stencil("one", ((0, 0),), "restrict", (2, 5))), coarse=write(coarse))
    m.loop("prolong", b, [0, 40, 0, 25], spread, coarse=read(coarse, up), fine=write(fine), at=Idx())
    return m.table(fine)


# tridiagonal systems: the right-hand side is made from the grid, so the solution is the grid


def line_systems(m: Mesh, b: Block, v: Field, axis: int) -> list[Field]:
    a, bb, c, d = (m.field(b, x, v.size) for x in "abcd")
    low, high = tuple(-1 if k == axis else 0 for k in range(2)), tuple(1 if k == axis else 0 for k in range(2))
    line = Stencil("line", ((0, 0), low, high))

    def make(v, a, b, c, d, at) -> None:
        n = v_size - 1
        a[0, 0], b[0, 0], c[0, 0] = F.when(at[axis] == 0, 0.0).otherwise(-1.0), F.lit(4.0), F.when(at[axis] == n, 0.0).otherwise(-2.0)
        d[0, 0] = 4.0 * v[0, 0] - F.when(at[axis] == 0, 0.0).otherwise(v[low]) - 2.0 * F.when(at[axis] == n, 0.0).otherwise(v[high])

    v_size = v.size[axis]
    m.loop("make", b, [0, 40, 0, 25], make, v=read(v, line), a=write(a), b=write(bb), c=write(c), d=write(d), at=Idx())
    return [a, bb, c, d]


@query("tridiagonal_solve", f"WITH {G2} SELECT i, j, round(v, 6) AS d FROM g")
def tridiagonal_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b, v = grid2(spark, sf_dir)
    systems = line_systems(m, b, v, 0)
    tridiagonal.solve(m, 0, [0, 40, 0, 25], *systems)
    return m.table(systems[3]).select("i", "j", F.round("d", 6).alias("d"))


@query("tridiagonal_increment", f"WITH {G2} SELECT i, j, round(2 * v, 6) AS v FROM g")
def tridiagonal_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b, v = grid2(spark, sf_dir)
    systems = line_systems(m, b, v, 1)
    tridiagonal.solve(m, 1, [0, 40, 0, 25], *systems, into=v)
    return m.table(v).select("i", "j", F.round("v", 6).alias("v"))


@query("tridiagonal_in_pieces", f"WITH {G2} SELECT i, j, round(v, 6) AS d FROM g")
def tridiagonal_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 cells in pieces of 7, as lines of any length would be."""
    m, b, v = grid2(spark, sf_dir)
    systems = line_systems(m, b, v, 0)
    tridiagonal.solve(m, 0, [0, 40, 0, 25], *systems, chunk=7)
    return m.table(systems[3]).select("i", "j", F.round("d", 6).alias("d"))


# random fields


def _lehmer(seed: int, stream: int) -> str:
    x = str((seed * 40503 + stream * 65537 + 12345) % 2147483647)
    for c, p in (("i", 73856093), ("j", 19349663)):
        x = f"(({x} * 48271::BIGINT + ({c}::BIGINT + 1048576) * {p}) % 2147483647)"
        x = f"((SELECT (q * q + 69621) % 2147483647 FROM (SELECT {x} AS q)))"
    return f"(({x} * 69621::BIGINT) % 2147483647)"


# A cell for each part and line number, and one more part at either end.
_CELLS = "p AS (SELECT CAST(p_partkey AS INT) AS i FROM part), c AS (SELECT i, CAST(b.range AS INT) AS j FROM (SELECT i FROM p UNION ALL SELECT min(i) - 1 FROM p UNION ALL SELECT max(i) + 1 FROM p) CROSS JOIN range(7) b)"


@query("random_uniform", f"WITH {_CELLS} SELECT i, j, {_lehmer(9, 0)}::DOUBLE / 2147483647 AS u FROM c")
def random_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b, v = part_grid(spark, sf_dir)
    u = m.field(b, "u", v.size, base=v.base, below=(-1, 0), above=(1, 0))
    slabs.fill_random(m, u, seed=9)
    return m.table(u)


@query("random_normal", f"WITH {_CELLS} SELECT i, j, round(sqrt(-2 * ln(1 - {_lehmer(9, 101)}::DOUBLE / 2147483647)) * cos({_lehmer(9, 102)}::DOUBLE / 2147483647 * {2 * math.pi!r}), 6) AS u FROM c")
def random_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b, v = part_grid(spark, sf_dir)
    u = m.field(b, "u", v.size, base=v.base, below=(-1, 0), above=(1, 0))
    slabs.fill_random(m, u, seed=9, normal=True)
    return m.table(u).select("i", "j", F.round("u", 6).alias("u"))


# One twister in SQL: the state of a seed, then 227 new words at a time, each made of words of the state alone.
_TWISTER = """s AS (SELECT 0 AS n, {seed}::UBIGINT AS x UNION ALL SELECT n + 1, (1812433253::UBIGINT * xor(x, x >> 30) + n + 1) % 4294967296 FROM s WHERE n < 623),
b AS (SELECT 0 AS b, list(x ORDER BY n) AS x FROM s UNION ALL SELECT b + 1, list_concat(x[228:624], list_transform(range(1, 228), lambda q: xor(xor(x[q + 397], ((x[q] & 2147483648) | (x[q + 1] & 2147483647)) >> 1), (x[q + 1] % 2) * 2567483615))) FROM b WHERE b <= (SELECT 2 * count(*) // 227 FROM c)),
y0 AS (SELECT (b - 1) * 227 + unnest(range(227)) AS n, unnest(x[398:624]) AS y FROM b WHERE b > 0), y1 AS (SELECT n, xor(y, y >> 11) AS y FROM y0), y2 AS (SELECT n, xor(y, (y << 7) & 2636928640) AS y FROM y1),
y3 AS (SELECT n, xor(y, (y << 15) & 4022730752) AS y FROM y2), y AS (SELECT n, xor(y, y >> 18) AS y FROM y3)"""


@query(
    "random_twister",
    f"WITH RECURSIVE {_CELLS}, {_TWISTER.format(seed=4711)} SELECT i, j, (a.y::DOUBLE + b.y::DOUBLE * 4294967296.0) / 18446744073709551616.0 AS u FROM (SELECT i, j, row_number() OVER (ORDER BY j, i) - 1 AS place FROM c) JOIN y a ON a.n = 2 * place JOIN y b ON b.n = 2 * place + 1",
)
def random_twister(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One twister's stream over the grid of parts, which each task enters at its own place."""
    m, b, v = part_grid(spark, sf_dir)
    u = m.field(b, "u", v.size, base=v.base, below=(-1, 0), above=(1, 0))
    slabs.fill_twister(m, u, seed=4711, chunk=max(1000, v.size[0]))
    return m.table(u)


# parts, copies, metadata, storage


@query("slab_fetch", f"WITH {G2} SELECT i, j, v FROM g WHERE i BETWEEN 10 AND 19 AND j BETWEEN 4 AND 6")
def slab_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _, v = grid2(spark, sf_dir)
    return slabs.slab(m, v, [10, 20, 4, 7])


@query("slab_set", f"WITH {G2} SELECT i, j, CASE WHEN i < 5 AND j < 5 THEN -1 ELSE v END AS v FROM g")
def slab_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _, v = grid2(spark, sf_dir)
    slabs.set_slab(m, v, m.table(v).withColumn("v", F.lit(-1.0)), [0, 5, 0, 5])
    return m.table(v)


@query("set_interior_and_all", f"WITH {G2} SELECT i, j, v + 2 AS v FROM g UNION ALL SELECT CAST(unnest([-1, 40]) AS INT), CAST(range AS INT), 1 FROM range(25)")
def set_interior_and_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _, v = grid2(spark, sf_dir, below=(-1, 0), above=(1, 0))
    old = m.table(v)
    slabs.set_all(m, v, old.withColumn("v", F.lit(1.0)))
    slabs.set_interior(m, v, old.withColumn("v", F.col("v") + 2))
    return m.table(v)


@query("plane_extract", f"WITH {G3} SELECT i, k, v FROM g WHERE j = 4")
def plane_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _, v = grid3(spark, sf_dir)
    return slabs.plane(m, v, 1, 4)


@query("copy_and_deep_copy", f"WITH {G2} SELECT i, j, v AS a, 2 * v AS b FROM g")
def copy_and_deep_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b, v = grid2(spark, sf_dir)
    a = slabs.copied(m, v, "a")

    def twice(v) -> None:
        v[0, 0] = 2 * v[0, 0]

    m.loop("twice", b, [0, 40, 0, 25], twice, v=rw(v))
    other = m.field(b, "b", (40, 25))
    slabs.deep_copy(m, other, v)
    return m.table(a).join(m.table(other), ["i", "j"])


@query("transpose", f"WITH {G3} SELECT k AS i, i AS j, j AS k, v FROM g")
def transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _, v = grid3(spark, sf_dir)
    return slabs.transposed(m, v, (2, 0, 1))


@query("raw_batches", f"WITH {G2} SELECT i, j, v * 2 + 1 AS v FROM g")
def raw_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw access to a field's values, batch by batch."""
    m, _, v = grid2(spark, sf_dir)

    def change(batches):
        import pyarrow as pa

        for x in batches:
            yield pa.RecordBatch.from_arrays([*x.columns[:2], pa.array(x.column(2).to_numpy() * 2 + 1)], x.schema.names)

    slabs.map_batches(m, v, change)
    return m.table(v)


@query("catalog", "SELECT 'parts' AS block, 2 AS dims, 'v' AS field, 'double' AS type, 1 AS dim, '[40, 25]' AS size, '[0, 0]' AS base, '[0, 0]' AS below, '[0, 0]' AS above, '[1, 1]' AS stride, false AS degenerate")
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b, _ = grid2(spark, sf_dir)
    m.free(m.field(b, "gone", (40, 1)))
    return m.catalog()


@query("extents", "SELECT 'i' AS axis, CAST(min(p_partkey) AS INT) AS base, CAST(max(p_partkey) - min(p_partkey) + 1 AS INT) AS size, 0 AS below, 0 AS above FROM part UNION ALL SELECT 'j', 0, 7, 0, 0")
def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, f = part_grid(spark, sf_dir)
    base, size = slabs.extents(f)
    return spark.createDataFrame(list(zip(f.block.axes, base, size, f.below, f.above, strict=True)), "axis string, base int, size int, below int, above int")


@query("store_round_trip", f"WITH {G2} SELECT i, j, v, 7 AS c FROM g")
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b, v = grid2(spark, sf_dir)
    store = Store(spark, new_path(spark, "store"))
    store.dump(m, [Stencil.star(2)])
    store.write_constant("c", 7)
    again = Mesh(spark)
    back = store.read_field(again, store.read_block("parts", 2), "v")
    return again.table(back).withColumn("c", F.lit(store.read_constant("c")))


@query("store_slab_single_precision", f"WITH {G2} SELECT i, j, CAST(CAST(v / 3 AS FLOAT) AS DOUBLE) AS v FROM g WHERE i < 4 AND j < 6")
def store_slab_single_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b, v = grid2(spark, sf_dir)

    def third(v) -> None:
        v[0, 0] = v[0, 0] / 3

    m.loop("third", b, [0, 40, 0, 25], third, v=rw(v))
    store = Store(spark, new_path(spark, "store"))
    store.write_slab(m, v, [0, 4, 0, 6], "part", "single")
    return store.read_part("part").select("i", "j", F.col("v").cast("double").alias("v"))


@query("store_plane_group", f"WITH {G3} SELECT 'I3/lines/first/v' AS part, CAST(count(*) AS BIGINT) AS cells, sum(v) AS total FROM g WHERE i = 3 UNION ALL SELECT 'K2/lines/first/v', count(*), sum(v) FROM g WHERE k = 2")
def store_plane_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b, v = grid3(spark, sf_dir)
    store = Store(spark, new_path(spark, "store"))
    parts = [store.read_part(p).agg(F.lit(p).alias("part"), F.count("*").alias("cells"), F.sum("v").alias("total")) for p in store.write_plane_group(m, [(0, 3), (2, 2)], "first", [v])]
    return parts[0].union(parts[1])


@query("text_lines", f"WITH {G2} SELECT j, string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR) || '.0', ' ' ORDER BY i) AS line FROM g GROUP BY j")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _, v = grid2(spark, sf_dir)
    return slabs.text_lines(m, v)


# iteration


def _steps_sql(n: int) -> str:
    out, last = [], "g"
    for k in range(n):
        out.append(f"s{k} AS (SELECT i, j, CASE WHEN {WITHIN} THEN 0.25 * (e + w + n + s) ELSE v END AS v FROM (SELECT i, j, v, {NEAR.format(t=last)}))")
        last = f"s{k}"
    return ", ".join(out)


@query("checkpoint_restart", f"WITH {G2}, {_steps_sql(4)} SELECT i, j, v FROM s3")
def checkpoint_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four steps, of which the last two are done by a second program from the first one's save."""
    path = new_path(spark, "restart")
    for program in range(2):
        m, b, v = grid2(spark, sf_dir)
        new = slabs.copied(m, v, "new")
        saver = Checkpointer(m, path, [v, new], interval=3600)

        def step(k: int, m: Mesh = m, b: Block = b, v: Field = v, new: Field = new) -> None:
            m.loop("average", b, [1, 39, 1, 24], average, v=read(v, Stencil.star(2)), new=write(new))
            slabs.deep_copy(m, v, new)

        run_steps(step, 4 if program else 2, saver)
        if not program:
            saver.save(2)
    return m.table(v)


@query("replay_restart", f"WITH {G2}, {_steps_sql(4)} SELECT i, j, v, t.total FROM s3, (SELECT round(sum(v), 4) AS total FROM s2) t")
def replay_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four steps and a reduction by a program that is run twice; the second run skips the loops that the
    first one's save has behind it, and gets the reductions of then."""
    path, totals = new_path(spark, "replay"), []
    for program in range(2):
        m, b, v = grid2(spark, sf_dir)
        new = slabs.copied(m, v, "new")
        saver = Checkpointer(m, path, [v, new], interval=1e-6 if not program else 3600)
        run = Replay(saver)
        run.ready()
        for k in range(4 if program else 3):
            total = Reduction("total")

            def back(new, v, total) -> None:
                v[0, 0] = new[0, 0]
                total.add(new[0, 0])

            run.loop("average", b, [1, 39, 1, 24], average, v=read(v, Stencil.star(2)), new=write(new))
            run.loop("back", b, [0, 40, 0, 25], back, new=read(new), v=write(v), total=Reduce(total, INC))
            if k == 2:
                totals.append(run.result(total))
            else:
                run.result(total)
    return m.table(v).withColumn("total", F.round(F.lit(totals[-1]), 4))


#: A grid that grows with the tables: a row for each part.
GP = """g AS (SELECT CAST(p_partkey AS INT) AS i, CAST(b.range AS INT) AS j, coalesce(s.v, 0) AS v FROM part CROSS JOIN range(7) b
 LEFT JOIN (SELECT l_partkey AS i, l_linenumber - 1 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) s ON s.i = p_partkey AND s.j = b.range)"""


@query(
    "loop_part_grid",
    f"WITH {GP}, m AS (SELECT min(i) AS low, max(i) AS high FROM g) SELECT i, j, CASE WHEN i > low AND i < high AND j BETWEEN 1 AND 5 THEN 0.25 * (e + w + n + s) ELSE v END AS v FROM (SELECT i, j, v, {NEAR.format(t='g')}), m",
)
def loop_part_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relaxation step on parts by line numbers, which has as many cells as the scale factor gives."""
    keys = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.min("p_partkey"), F.max("p_partkey")).first()
    low, high = int(keys[0]), int(keys[1]) + 1
    m = Mesh(spark)
    b = m.block("parts", 2)
    values = lineitem(spark, sf_dir).groupBy(F.col("l_partkey").cast("int").alias("i"), (F.col("l_linenumber") - 1).cast("int").alias("j")).agg(F.sum("l_quantity").alias("v"))
    v = m.field(b, "v", (high - low, 7), base=(low, 0), values=values)
    new = slabs.copied(m, v, "new")
    m.loop("average", b, [low + 1, high - 1, 1, 6], average, v=read(v, Stencil.star(2)), new=write(new))
    return m.table(new).withColumnRenamed("new", "v")


@query("band_iteration", f"WITH {G2}, {_steps_sql(5)} SELECT i, j, v FROM s4")
def band_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five steps in bands of six rows that borrow three rows at a time."""
    m, _, v = grid2(spark, sf_dir)
    rows = bands.iterate(bands.bands_of(m.table(v), "v", 1, 24, 6), bands.five_point, 5, 1, 24, 6, depth=3)
    return rows.select("j", F.posexplode("row").alias("i", "v")).select("i", "j", "v")


# array kernels on tiles


def part_grid(spark: SparkSession, sf_dir: str) -> tuple[Mesh, Block, Field]:
    """Quantities by part and line number: a grid that grows with the scale factor."""
    keys = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.min("p_partkey"), F.max("p_partkey")).first()
    low, high = int(keys[0]), int(keys[1]) + 1
    m = Mesh(spark)
    b = m.block("parts", 2)
    values = lineitem(spark, sf_dir).groupBy(F.col("l_partkey").cast("int").alias("i"), (F.col("l_linenumber") - 1).cast("int").alias("j")).agg(F.sum("l_quantity").alias("v"))
    return m, b, m.field(b, "v", (high - low, 7), base=(low, 0), values=values)


def part_tiles(spark: SparkSession, sf_dir: str, rows: int) -> tuple[Tiles, Block, Field, int, int]:
    m, b, v = part_grid(spark, sf_dir)
    tiles = Tiles(spark, b, v.size, (rows, 7), v.base)
    tiles.from_mesh(m, v)
    return tiles, b, v, v.base[0], v.base[0] + v.size[0]


def _part_steps_sql(n: int) -> str:
    out, last = ["m AS (SELECT min(i) AS low, max(i) AS high FROM g)"], "g"
    for k in range(n):
        out.append(f"s{k} AS (SELECT i, j, CASE WHEN i > low AND i < high AND j BETWEEN 1 AND 5 THEN 0.25 * (e + w + n + s) ELSE v END AS v FROM (SELECT i, j, v, {NEAR.format(t=last)}), m)")
        last = f"s{k}"
    return ", ".join(out)


@query("tiles_relaxation", f"WITH {GP}, {_part_steps_sql(5)} SELECT i, j, round(v, 6) AS v, round(most, 6) AS most FROM s4, (SELECT max(abs(s4.v - s3.v)) AS most FROM s4 JOIN s3 USING (i, j))")
def tiles_relaxation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five steps on parts by line numbers in tiles, with borders that are sent once for two steps."""
    tiles, _, v, low, high = part_tiles(spark, sf_dir, 64)
    most = Reduction("most")

    def relax(v, most) -> None:
        new = 0.25 * (v[1, 0] + v[-1, 0] + v[0, 1] + v[0, -1])
        if most:
            most.add(abs(new - v[0, 0]))
        v[0, 0] = new

    tiles.run([tiles.loop("relax", [low + 1, high - 1, 1, 6], relax, v=rw(v, Stencil.star(2)), most=Reduce(most, MAX))], steps=5, depth=2)
    return tiles.cells("v").select("i", "j", F.round("v", 6).alias("v"), F.round(F.lit(most.result()), 6).alias("most"))


@query(
    "tiles_array_kernel",
    f"WITH RECURSIVE {GP}, s AS (SELECT i, j, CAST(v + lead(v) OVER (PARTITION BY j ORDER BY i) AS BIGINT) AS n FROM g), c(n0, n, k) AS (SELECT DISTINCT n, n, 0 FROM s WHERE n >= 1 UNION ALL SELECT n0, CASE WHEN n % 2 = 0 THEN n // 2 ELSE 3 * n + 1 END, k + 1 FROM c WHERE n > 1), t AS (SELECT n0, max(k) AS k FROM c GROUP BY n0) SELECT i, j, CAST(coalesce(k, 0) AS INTEGER) AS length FROM s LEFT JOIN t ON t.n0 = s.n",
)
def tiles_array_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kernel that no column expresses: from a cell and its neighbour a sequence is followed (halve an even
    number, else three times and one) until it comes to 1. How long that takes depends on the values."""
    tiles, _, v, low, high = part_tiles(spark, sf_dir, 128)
    length = tiles.field("length", "int")

    def follow(v, length) -> None:
        n = (v[0, 0] + v[1, 0]).astype(np.int64)
        steps = np.zeros(n.shape, np.int32)
        while (going := n > 1).any():
            n = np.where(going, np.where(n % 2 == 0, n // 2, 3 * n + 1), n)
            steps += going
        length[0, 0] = steps

    tiles.run([tiles.loop("follow", [low, high - 1, 0, 7], follow, v=read(v, Stencil("ahead", ((0, 0), (1, 0)))), length=write(length))])
    return tiles.cells("length")


def _two_loops_sql(n: int) -> str:
    """Slopes between cells, then their differences added to the cells they lie between."""
    out, last = [], "(SELECT i, j, CAST(v AS DOUBLE) AS v FROM g)"
    for k in range(n):
        slope = lambda axis: f"CASE WHEN i < 39 AND j < 24 THEN lead(v) OVER {axis} - v ELSE 0 END"
        out.append(f"f{k} AS (SELECT i, j, v, {slope('x')} AS p, {slope('y')} AS q FROM {last} WINDOW x AS (PARTITION BY j ORDER BY i), y AS (PARTITION BY i ORDER BY j))")
        out.append(f"u{k} AS (SELECT i, j, CASE WHEN {WITHIN} THEN v + 0.125 * ((p - lag(p) OVER x) + (q - lag(q) OVER y)) ELSE v END AS v FROM f{k} WINDOW x AS (PARTITION BY j ORDER BY i), y AS (PARTITION BY i ORDER BY j))")
        last = f"u{k}"
    return ", ".join(out)


@query("tiles_two_loops", f"WITH {G2}, {_two_loops_sql(3)} SELECT i, j, round(v, 6) AS v, round((SELECT sum(v) FROM u0 WHERE {WITHIN}) + (SELECT sum(v) FROM u1 WHERE {WITHIN}) + (SELECT sum(v) FROM u2 WHERE {WITHIN}), 3) AS total FROM u2")
def tiles_two_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loops a step, a field of two components between them, and a sum over all steps."""
    m, b, v = grid2(spark, sf_dir)
    tiles = Tiles(spark, b, (40, 25), (9, 8))
    tiles.from_mesh(m, v)
    slope, total = tiles.field("slope", dim=2), Reduction("total")

    def slopes(v, slope) -> None:
        slope[0, 0, 0], slope[1, 0, 0] = v[1, 0] - v[0, 0], v[0, 1] - v[0, 0]

    def spread(slope, v, total) -> None:
        v[0, 0] = v[0, 0] + 0.125 * ((slope[0, 0, 0] - slope[0, -1, 0]) + (slope[1, 0, 0] - slope[1, 0, -1]))
        total.add(v[0, 0])

    loops = [
        tiles.loop("slopes", [0, 39, 0, 24], slopes, v=read(v, Stencil("ahead", ((0, 0), (1, 0), (0, 1)))), slope=write(slope)),
        tiles.loop("spread", [1, 39, 1, 24], spread, slope=read(slope, Stencil("behind", ((0, 0), (-1, 0), (0, -1)))), v=rw(v), total=Reduce(total, INC)),
    ]
    tiles.run(loops, steps=3, depth=2, fold_all=True)
    return tiles.cells("v").select("i", "j", F.round("v", 6).alias("v"), F.round(F.lit(total.result()), 3).alias("total"))


# slabs


_PART_NODES = f"""{GP}, m AS (SELECT min(i) AS low, max(i) AS high FROM g), n AS (SELECT i, CAST(b.range AS INT) AS j FROM (SELECT i FROM g WHERE j = 0 UNION ALL SELECT high + 1 FROM m) CROSS JOIN range(8) b)"""


@query(
    "slabs_staggered",
    f"WITH {_PART_NODES}, c AS (SELECT n.i, n.j, CASE WHEN n.i > low AND n.i <= high AND n.j BETWEEN 1 AND 6 THEN (g.v + w.v + s.v + t.v) / 4 ELSE 0 END AS node FROM n CROSS JOIN m LEFT JOIN g ON g.i = n.i AND g.j = n.j LEFT JOIN g w ON w.i = n.i - 1 AND w.j = n.j LEFT JOIN g s ON s.i = n.i AND s.j = n.j - 1 LEFT JOIN g t ON t.i = n.i - 1 AND t.j = n.j - 1) "
    "SELECT g.i, g.j, round(CASE WHEN g.j <= 5 AND g.i < high THEN g.v + p.node - q.node ELSE g.v END, 6) AS v FROM g CROSS JOIN m JOIN c p ON p.i = g.i AND p.j = g.j JOIN c q ON q.i = g.i + 1 AND q.j = g.j + 1",
)
def slabs_staggered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells to nodes and back on parts by line numbers: two sizes of field on a block that is dealt into
    slabs, so the loops join them where they lie."""
    m, b, v, node, low, high = staggered_slabs(spark, sf_dir, 8)

    def mean(v, node) -> None:
        node[0, 0] = (v[0, 0] + v[-1, 0] + v[0, -1] + v[-1, -1]) / 4

    def back(v, node) -> None:
        v[0, 0] = v[0, 0] + node[0, 0] - node[1, 1]

    m.loop("mean", b, [low + 1, high, 1, 7], mean, v=read(v, Stencil("corner", ((0, 0), (-1, 0), (0, -1), (-1, -1)))), node=write(node))
    m.loop("back", b, [low, high - 1, 0, 6], back, v=rw(v), node=read(node, Stencil("opposite", ((0, 0), (1, 1)))))
    return m.table(v).withColumn("v", F.round("v", 6))


def staggered_slabs(spark: SparkSession, sf_dir: str, parts: int) -> tuple[Mesh, Block, Field, Field, int, int]:
    m, b, v = part_grid(spark, sf_dir)
    low, high = v.interior[0]
    m.deal(v, 0, parts)
    return m, b, v, m.field(b, "node", (high - low + 1, 8), base=(low, 0)), low, high


@query("slabs_wide_stencil", f"WITH {GP}, m AS (SELECT min(i) AS low, max(i) AS high FROM g), s0 AS (SELECT i, j, CASE WHEN i >= low + 3 AND i <= high - 2 AND j BETWEEN 1 AND 5 THEN (lead(v, 2) OVER y + lag(v, 3) OVER y + lag(v) OVER x) / 3 ELSE v END AS v FROM g CROSS JOIN m WINDOW x AS (PARTITION BY i ORDER BY j), y AS (PARTITION BY j ORDER BY i)), s1 AS (SELECT i, j, CASE WHEN i >= low + 3 AND i <= high - 2 AND j BETWEEN 1 AND 5 THEN (lead(v, 2) OVER y + lag(v, 3) OVER y + lag(v) OVER x) / 3 ELSE v END AS v FROM s0 CROSS JOIN m WINDOW x AS (PARTITION BY i ORDER BY j), y AS (PARTITION BY j ORDER BY i)) SELECT i, j, round(v, 6) AS v FROM s1")
def slabs_wide_stencil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps of an uneven stencil on a dealt grid: only rows at the ends of slabs move."""
    m, b, v = part_grid(spark, sf_dir)
    low, high = v.interior[0]
    m.deal(v, 0, 8)

    def mean(v) -> None:
        v[0, 0] = (v[2, 0] + v[-3, 0] + v[0, -1]) / 3

    for _ in range(2):
        m.loop("mean", b, [low + 3, high - 2, 1, 6], mean, v=rw(v, Stencil("uneven", ((0, 0), (2, 0), (-3, 0), (0, -1)))))
    return m.table(v).withColumn("v", F.round("v", 6))


def part_systems(spark: SparkSession, sf_dir: str) -> tuple[Mesh, Block, Field, list[Field], list[int]]:
    """Systems along the parts, a line for each line number, whose solution is the grid of quantities."""
    m, b, v = part_grid(spark, sf_dir)
    low, high = v.interior[0]
    a, bb, c, d = (m.field(b, x, v.size, base=v.base) for x in "abcd")

    def make(v, a, b, c, d, at) -> None:
        first, last = at[0] == low, at[0] == high - 1
        a[0, 0], b[0, 0], c[0, 0] = F.lit(-1.0), F.lit(4.0), F.lit(-2.0)
        d[0, 0] = 4.0 * v[0, 0] - F.when(first, 0.0).otherwise(v[-1, 0]) - 2.0 * F.when(last, 0.0).otherwise(v[1, 0])

    box = [low, high, 0, 7]
    m.loop("make", b, box, make, v=read(v, Stencil("line", ((0, 0), (-1, 0), (1, 0)))), a=write(a), b=write(bb), c=write(c), d=write(d), at=Idx())
    return m, b, v, [a, bb, c, d], box


@query("tridiagonal_reduction", f"WITH {GP} SELECT i, j, round(v, 6) AS d FROM g")
def tridiagonal_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few lines as long as there are parts, by cyclic reduction in slabs of 64 cells and systems of as many."""
    m, _, _, systems, box = part_systems(spark, sf_dir)
    tridiagonal.solve(m, 0, box, *systems, chunk=64, by="reduction")
    return m.table(systems[3]).withColumn("d", F.round("d", 6))


# stored parts, halos of many fields


@query("store_pruned_slab", f"WITH {GP}, m AS (SELECT min(i) AS low, max(i) AS high FROM g) SELECT i, j, v FROM g, m WHERE i >= low + (high - low) // 3 AND i < low + (high - low) // 3 + 40 AND j BETWEEN 2 AND 4")
def store_pruned_slab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slab of a stored grid, read by ranges of its curve."""
    m, b, v = part_grid(spark, sf_dir)
    low, high = v.interior[0]
    store = Store(spark, new_path(spark, "store"), per_file=50_000, per_group=500)
    store.write_field(m, v)
    begin = low + (high - 1 - low) // 3
    return store.read_slab(b, "v", [begin, begin + 40, 2, 5])


@query("store_as_data_source", f"WITH {GP}, m AS (SELECT min(i) AS low, max(i) AS high FROM g) SELECT i, j, v FROM g, m WHERE i >= low + (high - low) // 4 AND i < low + (high - low) // 2 AND j IN (1, 2, 5) AND v > 20")
def store_as_data_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid written as ``format("mesh")``, and a box of it read."""
    m, b, v = part_grid(spark, sf_dir)
    register(spark)
    path, (low, high) = new_path(spark, "store"), v.interior[0]
    named = {"block": b.name, "field": v.name}
    more = {"size": ",".join(map(str, v.size)), "base": ",".join(map(str, v.base)), "per_group": "2000"}
    along_curve(m.table(v), v, 8).write.format("mesh").options(**named, **more).mode("overwrite").save(path)
    begin, end = low + (high - 1 - low) // 4, low + (high - 1 - low) // 2
    return spark.read.format("mesh").options(**named, box=f"{begin},{end},1,6").load(path).where("j IN (1, 2, 5) AND v > 20")


@query("store_half_components", f"WITH {G2} SELECT i, j, CAST(v % 512 + 512.5 AS DOUBLE) AS a, CAST(v % 1024 + 1024 AS DOUBLE) AS b FROM g WHERE i < 4 AND j < 6")
def store_half_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slab of a field of two components in half precision, whose steps are one half and one there."""
    m, b, v = grid2(spark, sf_dir)
    pair = m.field(b, "pair", (40, 25), dim=2)

    def fill(v, pair) -> None:
        pair[0, 0, 0], pair[1, 0, 0] = v[0, 0] % 512 + 512.6, v[0, 0] % 1024 + 1024.3

    m.loop("fill", b, [0, 40, 0, 25], fill, v=read(v), pair=write(pair))
    store = Store(spark, new_path(spark, "store"))
    store.write_slab(m, pair, [0, 4, 0, 6], "part", "half")
    return store.read_part("part").select("i", "j", *(F.get("pair", c).cast("double").alias("ab"[c]) for c in range(2)))


_PLANES = [(0, 3), (0, 7), (1, 4), (2, 2), (2, 5)]


@query("store_plane_cells", f"WITH {G3} " + " UNION ALL ".join(f"SELECT '{'IJK'[a]}{at}' AS plane, {'jii'[a]} AS x, {'kkj'[a]} AS y, v, v * 2 + {'ijk'[a]} AS w FROM g WHERE {'ijk'[a]} = {at}" for a, at in _PLANES))
def store_plane_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five planes of two fields, written in one pass; every cell of them."""
    m, b, v = grid3(spark, sf_dir)
    w = m.field(b, "w", (10, 10, 7))
    store = Store(spark, new_path(spark, "store"))
    out = None
    for axis in range(3):

        def fill(v, w, at, axis=axis) -> None:
            w[0, 0, 0] = v[0, 0, 0] * 2 + at[axis]

        m.loop("fill", b, [0, 10, 0, 10, 0, 7], fill, v=read(v), w=write(w), at=Idx())
        names = store.write_plane_group(m, [p for p in _PLANES if p[0] == axis], f"along{axis}", [v, w])
        for first, second in zip(names[::2], names[1::2], strict=True):
            x, y = (c for c in "ijk" if c != "ijk"[axis])
            both = store.read_part(first).join(store.read_part(second), [x, y]).select(F.lit(first.split("/")[0]).alias("plane"), F.col(x).alias("x"), F.col(y).alias("y"), "v", "w")
            out = both if out is None else out.union(both)
    return out


_MIRROR = "SELECT i, j, v AS p, v + i AS q, CAST(v * 2 AS DOUBLE) AS r FROM g"


@query(
    "halo_mirror_group",
    f"WITH {G2}, f AS ({_MIRROR}), x AS (SELECT * FROM f UNION ALL SELECT -1 - i, j, p, -q, r FROM f WHERE i < 2 UNION ALL SELECT 79 - i, j, p, -q, r FROM f WHERE i >= 38) SELECT * FROM x UNION ALL SELECT i, -1 - j, p, q, -r FROM x WHERE j < 2 UNION ALL SELECT i, 49 - j, p, q, -r FROM x WHERE j >= 23",
)
def halo_mirror_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mirrors of three fields at all four sides: along each axis in one group, with the sign of the component
    that the wall turns round. The second group takes the corners along."""
    m, b, v = grid2(spark, sf_dir)
    halo2 = {"below": (-2, -2), "above": (2, 2)}
    fields = {x: m.field(b, x, (40, 25), **halo2) for x in "pqr"}
    box = [0, 40, 0, 25]

    def fill(v, at, p, q, r) -> None:
        p[0, 0], q[0, 0], r[0, 0] = v[0, 0], v[0, 0] + at[0], v[0, 0] * 2

    m.loop("fill", b, box, fill, v=read(v), at=Idx(), **{x: write(f) for x, f in fields.items()})
    for axis, turned in ((0, "q"), (1, "r")):
        n = (40, 25)[axis]
        shape = (2, 25) if axis == 0 else (44, 2)
        at = lambda k, axis=axis: (k, 0) if axis == 0 else (-2, k)
        flip = (-1, 2) if axis == 0 else (1, -2)
        halo.transfer(m, [Halo(f, f, shape, at(begin), at(to), (1, 2), flip, -1 if x == turned else 1) for x, f in fields.items() for begin, to in ((0, -2), (n - 2, n))])
    return m.tables[m.key(fields["p"])].select("i", "j", "p", "q", "r")


# regions, text, metadata


@query(
    "regions_from_table",
    """WITH c AS (SELECT CAST(a.range - 5 AS INT) AS i, CAST(b.range AS INT) AS j FROM range(120) a CROSS JOIN range(90) b),
r AS (SELECT o_orderkey AS place, o_orderkey % 3 AS kind, o_custkey % 130 - 10 AS x, o_orderkey % 97 - 4 AS y, o_custkey % 5 + 1 + CASE WHEN o_orderkey % 500 < 3 THEN 40 ELSE 0 END AS w, CAST(o_custkey AS DOUBLE) AS value FROM orders WHERE o_custkey % 11 < 9),
m AS (SELECT i, j, arg_max(value, place) AS value FROM c JOIN r ON CASE kind WHEN 0 THEN i >= x AND i < x + w AND j >= y AND j < y + 2 * w WHEN 1 THEN (i - x) * (i - x) + (j - y) * (j - y) <= w * w ELSE i = x AND j = y END GROUP BY i, j)
SELECT i, j, coalesce(value, -1) AS state FROM c LEFT JOIN m USING (i, j)""",
)
def regions_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States from rectangles, circles and points of ``orders``, of very different sizes; the last order wins."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_custkey % 11 < 9")
    width = F.col("o_custkey") % 5 + 1 + F.when(F.col("o_orderkey") % 500 < 3, 40).otherwise(0)
    x, y = F.col("o_custkey") % 130 - 10, F.col("o_orderkey") % 97 - 4
    kind = F.element_at(F.array(*map(F.lit, regions.KINDS)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    table = orders.select(F.col("o_orderkey").alias("place"), kind.alias("kind"), x.alias("x0"), y.alias("y0"), (x + width).alias("x1"), (y + 2 * width).alias("y1"), width.alias("radius"), F.col("o_custkey").cast("double").alias("value"))
    m = Mesh(spark)
    b = m.block("plane", 2)
    state = m.field(b, "state", (120, 90), base=(-5, 0))
    m.loop("background", b, [-5, 115, 0, 90], lambda state: state.__setitem__((0, 0), -1.0), state=write(state))
    regions.set_regions(m, state, table)
    return m.table(state)


@query("store_text_dump", f"WITH {GP}, s AS (SELECT min(i) AS low, max(i) - min(i) + 1 AS size FROM g) SELECT CAST(0 AS BIGINT) AS n, 'v block=parts size=[' || size || ', 7] dim=1 type=double' AS line FROM s UNION ALL SELECT 1 + j, string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR) || '.0', ' ' ORDER BY i) FROM g GROUP BY j")
def store_text_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump in several files, read back in the order of their names."""
    m, b, v = part_grid(spark, sf_dir)
    store = Store(spark, new_path(spark, "store"))
    store.write_text(m, v, "dump", 4)
    return store.read_text("dump")


@query(
    "store_halos_and_stencils",
    f"WITH {G2} SELECT i, j, v, 7 AS points, 1.5::DOUBLE AS payload FROM g UNION ALL SELECT -2 + i, j, -g.v, 7, 1.5 FROM g WHERE i < 2",
)
def store_halos_and_stencils(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A halo and a stencil are written, read back and used."""
    m, b, v = grid2(spark, sf_dir, below=(-2, 0))
    store = Store(spark, new_path(spark, "store"))
    store.dump(m, [Stencil.star(3)], [Halo(v, v, (2, 25), (0, 0), (-2, 0), (1, 2), (1, 2), -1)])
    store.write_constant("payload", [1.5])
    halo.transfer(m, [store.read_halo(v, v)])
    points = len(store.read_stencil(Stencil.star(3).name).points)
    return m.table(v).withColumns({"points": F.lit(points), "payload": F.lit(store.read_constant("payload")[0])})


@query(
    "field_metadata",
    "WITH m AS (SELECT CAST(min(p_partkey) AS INT) AS low, CAST(max(p_partkey) AS INT) AS high FROM part) SELECT 'i' AS axis, low AS base, high - low + 1 AS size, high - low + 4 AS length, 1 AS stride, -1 AS below, 2 AS above, high - low AS slab, CAST((high - low) * 3 * 8 AS BIGINT) AS slab_bytes, CAST((high - low + 4) * 7 AS BIGINT) AS cells FROM m UNION ALL SELECT 'j', 0, 7, 7, high - low + 4, 0, 0, 3, (high - low) * 3 * 8, (high - low + 4) * 7 FROM m",
)
def field_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents, the layout of a dense array, a slab's extents and bytes, and the cells of all partitions."""
    m, b, v = part_grid(spark, sf_dir)
    low, high = v.interior[0]
    f = m.field(b, "w", v.size, base=v.base, below=(-1, 0), above=(2, 0))
    (base, size), raw, (slab, n) = slabs.extents(f), slabs.raw_metadata(f), slabs.slab_extents(f, [low, high - 1, 2, 5])
    cells = slabs.partitions(m, f).agg(F.sum("cells").alias("cells"))
    rows = spark.createDataFrame([(x, base[a], size[a], raw["shape"][a], raw["strides"][a], raw["below"][a], raw["above"][a], slab[a], n) for a, x in enumerate(f.axes)], "axis string, base int, size int, length int, stride int, below int, above int, slab int, slab_bytes long")
    return rows.join(F.broadcast(cells))
