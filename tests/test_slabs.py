"""Dealt grids against grids that are not, and what their plans shuffle."""

import random
import re

import pytest
from pyspark.sql import functions as F

from meshweave.operators import loop as loops
from meshweave.operators import slabs
from meshweave.operators.gather import SLAB
from meshweave.operators.loop import Dat, Idx, Mesh, Reduce, inc, read, rw, write
from meshweave.operators.reduction import Reduction
from meshweave.plans.catalog import INC, MAX, MeshError, Stencil
from meshweave.plans.queries import staggered_slabs

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def large(spark, monkeypatch):
    """Every table is too large to be sent."""
    monkeypatch.setattr(loops, "MOST_SENT", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("axis", [0, 1, 2])
def test_dealt_grid_has_the_same_neighbours(spark, large, axis):
    rng = random.Random(axis)
    points = tuple({(0, 0, 0)} | {tuple(rng.randint(-2, 2) for _ in range(3)) for _ in range(9)})
    far = Stencil("far", points)
    values = spark.range(7 * 9 * 8).selectExpr("cast(id % 7 - 1 as int) i", "cast(id div 7 % 9 as int) j", "cast(id div 63 as int) k", "cast(id * 7919 % 103 as double) v")
    found = []
    for parts in (0, 3):
        m = Mesh(spark, cut_every=2)
        b = m.block("b", 3)
        v = m.field(b, "v", (5, 9, 8), below=(-1, 0, 0), above=(1, 0, 0), values=values)
        if parts:
            m.deal(v, axis, parts)
            with pytest.raises(MeshError):
                m.deal(v, 5, 2)
        w, plane, total = m.field(b, "w", (5, 9, 8), dim=2), m.field(b, "plane", (5, 9, 1)), Reduction("total")

        def step(v, w, total, at):
            out = at[0].cast("double")
            for p in points:
                out = out + F.coalesce(v[p], F.lit(0.5))
            w[0, 0, 0, 0], w[1, 0, 0, 0] = out, v[0, 0, 0]
            total.add(out)

        def fold(w, v, plane):
            v.add(w[0, 0, 0, 0] / 4)
            plane.add(w[1, 0, 0, 0])

        def spread(v, plane):
            v[0, 0, 0] = v[0, 0, 0] - plane[0, 0, 0]

        for _ in range(2):
            m.loop("step", b, [0, 5, 0, 9, 0, 8], step, v=read(v, far), w=write(w), total=Reduce(total, INC), at=Idx())
            m.loop("fold", b, [0, 5, 1, 9, 0, 7], fold, w=read(w), v=inc(v), plane=Dat(plane, Stencil.point(3), MAX))
            m.loop("spread", b, [0, 5, 0, 8, 0, 8], spread, v=rw(v), plane=read(plane))
        slabs.set_slab(m, v, m.table(v).withColumn("v", F.lit(-1.0)), [0, 2, 0, 2, 0, 2])
        found.append((rows(m.table(v)), rows(m.table(w)), rows(m.table(plane)), total.result()))
    assert found[0] == found[1]


def test_staggered_loops_join_without_exchange(spark, large):
    """Nodes are set from cells: the tables are read by bucket, and only rows at the ends of slabs move."""
    m, b, v, node, low, high = staggered_slabs(spark, SF, 4)

    def put(v, node):
        node[0, 0] = node[0, 0] + v[0, 0]

    m.loop("put", b, [low, high, 0, 7], put, v=read(v), node=rw(node))
    plan = plan_of(m.tables[m.key(node)])
    assert "Join" in plan and "Exchange" not in plan and plan.count("Bucketed: true") == 2

    def mean(v, node):
        node[0, 0] = (v[0, 0] + v[-1, 0] + v[0, -1] + v[-1, -1]) / 4

    m.cut(node)
    m.loop("mean", b, [low + 1, high, 1, 7], mean, v=read(v, Stencil("corner", ((0, 0), (-1, 0), (0, -1), (-1, -1)))), node=write(node))
    plan = plan_of(m.tables[m.key(node)])
    assert plan.count("Exchange") == 1 and re.search(rf"Exchange hashpartitioning\({SLAB}#\d+, 4\), REPARTITION_BY_NUM", plan)


def test_border_rows_alone_are_sent(spark, large):
    m = Mesh(spark)
    b = m.block("b", 2)
    v = m.field(b, "v", (4000, 5), values=spark.range(20_000).selectExpr("cast(id % 4000 as int) i", "cast(id div 4000 as int) j", "cast(id as double) v"))
    other = m.field(b, "other", (4000, 5))
    m.deal(v, 0, 8)
    table = m.tables[m.key(v)]
    borders = m.slabs["b"].borders(table, ["v"], ["j"], 2, 1)
    assert borders.count() == 8 * 5  # one for each slab and line
    assert borders.select(F.explode(F.map_values("__border"))).count() == 7 * 5 * 3
    m.loop("shift", b, [2, 3999, 0, 5], lambda v, other: other.__setitem__((0, 0), v[-2, 0] + v[1, 0]), v=read(v, Stencil("s", ((-2, 0), (1, 0)))), other=write(other))
    assert plan_of(m.tables[m.key(v)]).count("Exchange") == 1
    assert m.table(other).where("i between 2 and 3998 and other <> 2 * (i + 4000 * j) - 1").count() == 0
    m.cut(v)
    assert "Bucketed: true" in plan_of(m.tables[m.key(v)].groupBy(SLAB).count())
    with pytest.raises(ValueError):
        m.loop("far", b, [600, 700, 0, 5], lambda v, other: None, v=read(v, Stencil("f", ((501, 0),))), other=write(other))


def test_slabs_of_a_large_grid_are_more(spark, large, monkeypatch):
    """A slab is one task's, so a larger grid has more of them than were asked for, with the same values."""
    monkeypatch.setattr(loops, "MOST_DEALT", 1000, raising=False)
    values = spark.range(20_000).selectExpr("cast(id % 4000 as int) i", "cast(id div 4000 as int) j", "cast(id as double) v")
    found = []
    for parts in (0, 3):
        m = Mesh(spark)
        b = m.block("b", 2)
        v = m.field(b, "v", (4000, 5), values=values)
        if parts:
            m.deal(v, 0, parts)
        m.loop("mean", b, [3, 3998, 1, 5], lambda v: v.__setitem__((0, 0), v[2, 0] + v[-3, 0] + v[0, -1]), v=rw(v, Stencil("s", ((0, 0), (2, 0), (-3, 0), (0, -1)))))
        found.append(rows(m.table(v)))
    assert found[0] == found[1]
    table = m.tables[m.key(v)]
    assert table.groupBy(SLAB).count().agg(F.count("*"), F.max("count")).first() == (20, 1000)
