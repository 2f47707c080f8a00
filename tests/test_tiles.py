"""Array kernels on tiles against the same loops on rows and against NumPy, and what a round shuffles."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave.operators.loop import Gbl, Idx, Mesh, Opt, Reduce, inc, read, rw, write
from meshweave.operators.reduction import Reduction
from meshweave.operators.tiles import Grid, Tiles
from meshweave.plans.catalog import INC, MAX, MIN, WRITE, Block, MeshError, Stencil

BOX9 = Stencil("box9", tuple((x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)))


def as_array(tiles, name, shape):
    rows = tiles.cells(name).toPandas()
    out = np.full(shape, np.nan)
    out[tuple(rows[x] for x in tiles.block.axes)] = rows[name]
    assert len(rows) == out.size
    return out


def filled(tiles, f, values):
    box = [x for n in tiles.size for x in (0, n)]
    here = (0,) * tiles.block.dims

    def put(f, at):
        f[here] = values[np.ix_(*(a.ravel() for a in at))]

    tiles.run([tiles.loop("put", box, put, f=write(f), at=Idx())])


@pytest.mark.parametrize(("tile", "depth", "steps"), [((5, 4), 1, 3), ((6, 8), 2, 5), ((11, 13), 9, 4), ((100, 100), 3, 4)])
def test_corners_cross_tiles(spark, tile, depth, steps):
    n, m = 23, 17
    tiles = Tiles(spark, Block("b", 2), (n, m), tile)
    v = tiles.field("v")
    x = np.random.default_rng(1).standard_normal((n, m))
    filled(tiles, v, x)
    most, total, low = Reduction("most"), Reduction("total"), Reduction("low")

    def mean(v, most, total, low):
        out = sum(v[p] for p in BOX9.points) / 9
        if most:
            most.add(np.abs(out))
            total.add(out)
            low.add(out)
        v[0, 0] = out

    tiles.run([tiles.loop("mean", [1, n - 1, 2, m - 1], mean, v=rw(v, BOX9), most=Reduce(most, MAX), total=Reduce(total, INC), low=Reduce(low, MIN))], steps, depth)
    for _ in range(steps):
        new = sum(np.roll(x, (-a, -b), (0, 1)) for a, b in BOX9.points) / 9
        x[1 : n - 1, 2 : m - 1] = new[1 : n - 1, 2 : m - 1]
    inner = x[1 : n - 1, 2 : m - 1]
    assert np.abs(as_array(tiles, "v", (n, m)) - x).max() < 1e-14
    assert abs(most.result() - np.abs(inner).max()) < 1e-14 and abs(total.result() - inner.sum()) < 1e-11 and abs(low.result() - inner.min()) < 1e-14


def test_same_kernel_on_rows_and_tiles(spark):
    """Three axes, wide and uneven reach, two components, whole numbers, options and constants."""
    block = Block("b", 3)
    wide = Stencil("wide", ((0, 0, 0), (2, 0, 0), (-1, 0, 1), (0, -2, 0)))
    box = [1, 8, 2, 7, 0, 5]

    def step(u, w, at, by, none):
        w[0, 0, 0, 0] = u[2, 0, 0] * by - u[-1, 0, 1] + at[0]
        w[1, 0, 0, 0] = u[0, -2, 0] + at[1] * at[2]
        assert none is None

    def more(w, u):
        u.add(w[0, 0, 0, 0] + w[1, 0, 0, 0])

    values = spark.range(10 * 8 * 6).selectExpr("cast(id % 10 as int) i", "cast(id div 10 % 8 as int) j", "cast(id div 80 as int) k", "cast(id * 7919 % 103 as int) u")
    mesh = Mesh(spark, blocks={"b": block})
    mu, mw = mesh.field(block, "u", (10, 8, 6), dtype="int", values=values), mesh.field(block, "w", (10, 8, 6), dim=2)
    tiles = Tiles(spark, block, (10, 8, 6), (4, 3, 3))
    tu, tw = tiles.from_mesh(mesh, mu)[0], tiles.field("w", dim=2)
    for _ in range(2):
        mesh.loop("step", block, box, step, u=read(mu, wide), w=write(mw), at=Idx(), by=Gbl(3), none=Opt(read(mu), False))
        mesh.loop("more", block, box, more, w=read(mw), u=inc(mu))
    loops = [tiles.loop("step", box, step, u=read(tu, wide), w=write(tw), at=Idx(), by=Gbl(3), none=Opt(read(tu), False)), tiles.loop("more", box, more, w=read(tw), u=inc(tu))]
    tiles.run(loops, steps=2, depth=1)
    for name, f in (("u", mu), ("w", mw)):
        got, want = tiles.cells(name), mesh.table(f)
        assert got.schema == want.schema or [x.dataType for x in got.schema] == [x.dataType for x in want.schema]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_swapped_fields_and_views_are_safe(spark):
    tiles = Tiles(spark, Block("b", 1), (20,), (6,))
    a, b = tiles.field("a"), tiles.field("b")
    x, y = np.arange(20.0), np.arange(20.0) * -3
    filled(tiles, a, x)
    filled(tiles, b, y)

    def swap(a, b):
        a[0,], b[0,] = b[1,], a[-1,]

    tiles.run([tiles.loop("swap", [1, 19], swap, a=rw(a, Stencil.star(1)), b=rw(b, Stencil.star(1)))], steps=3, depth=2)
    for _ in range(3):
        p, q = x.copy(), y.copy()
        p[1:19], q[1:19] = y[2:20], x[0:18]
        x, y = p, q
    assert (as_array(tiles, "a", (20,)) == x).all() and (as_array(tiles, "b", (20,)) == y).all()


def test_half_precision_and_missing_cells(spark):
    tiles = Tiles(spark, Block("b", 1), (9,), (2,), base=(-3,))
    h = tiles.field("h", "half", values=spark.createDataFrame([(-3, 1.0), (5, 2049.0), (6, 9.0), (-4, 9.0), (0, None)], "i int, h double"))

    def more(h):
        h[0,] = h[0,] + 0.1

    tiles.run([tiles.loop("more", [-3, 5], more, h=rw(h))])
    got = {r["i"]: r["h"] for r in tiles.cells("h").collect()}
    assert len(got) == 9 and got[5] == 2048.0 and got[-3] == float(np.float16(1.1)) and got[0] == float(np.float16(0.1))


def test_only_borders_are_shuffled(spark):
    """The tiles are read by bucket; what is exchanged comes from the edges alone, and is as large as they are."""
    n = 256
    tiles = Tiles(spark, Block("b", 2), (n, n), (64, 64))
    v = tiles.field("v")
    filled(tiles, v, np.ones((n, n)))

    def mean(v):
        v[0, 0] = 0.25 * (v[1, 0] + v[-1, 0] + v[0, 1] + v[0, -1])

    tiles.run([tiles.loop("mean", [1, n - 1, 1, n - 1], mean, v=rw(v, Stencil.star(2)))], steps=2, depth=2)
    plan = tiles.joined()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    scans = re.findall(r"FileScan parquet.*?Bucketed: (\w+).*?ReadSchema: struct<([^\n]*)>", plan)
    assert [b for b, schema in scans if "v:binary" in schema] == ["true"]
    assert all("v:binary" not in schema for b, schema in scans if b == "false")
    sent = tiles.table.select(F.explode("edges").alias("e")).agg(F.sum(F.length("e.cells"))).first()[0]
    assert sent < 8 * n * n * 0.2  # twelve inner sides of two cells, and corners


def test_tiles_are_checked(spark):
    block = Block("b", 2)
    tiles = Tiles(spark, block, (8, 8), (3, 3))
    v = tiles.field("v")
    nothing = lambda **_: None
    for wrong in (
        lambda: tiles.field("v"),
        lambda: tiles.field("z", "complexd"),
        lambda: tiles.loop("x", [0, 8], nothing, v=read(v)),
        lambda: tiles.loop("x", [0, 8, 0, 8], nothing, v=read(v, Stencil.star(2))),
        lambda: tiles.loop("x", [1, 7, 1, 7], nothing, v=write(v, Stencil.star(2))),
        lambda: tiles.loop("x", [1, 7, 1, 7], nothing, v=read(v), r=Reduce(Reduction("r"), WRITE)),
        lambda: tiles.loop("x", [1, 7, 1, 7], nothing, v=read(Mesh(spark).field(block, "v", (9, 9)))),
        lambda: Tiles(spark, block, (8,), (3, 3)),
    ):
        with pytest.raises(MeshError):
            wrong()
    far = Stencil("far", ((0, 0), (5, 0)))
    with pytest.raises(MeshError):
        tiles.run([tiles.loop("x", [0, 3, 0, 8], lambda v: None, v=read(v, far))])


def test_tiles_have_every_cell_once():
    for size, counts in (((23, 7), (4, 2)), ((5, 5), (5, 1))):
        grid = Grid(tuple((3, 3 + n) for n in size), counts)
        seen = np.zeros(size, int)
        for t in range(counts[0] * counts[1]):
            assert grid.number(grid.place(t)) == t
            (a, b), (c, d) = grid.bounds(t)
            seen[a - 3 : b - 3, c - 3 : d - 3] += 1
        assert (seen == 1).all()


def test_relaxation_has_the_known_change(spark):
    from bench import relax_in_tiles

    assert relax_in_tiles(spark, 30, 100, (11, 16), 5) == pytest.approx(0.0018718304066847602, rel=1e-12)


def test_cells_by_tiles_beyond_32_bits(spark):
    """A coordinate times the number of tiles passes 2^31; only the cells' own tiles are filled."""
    n = 3_000_000
    tiles = Tiles(spark, Block("long", 2), (n, 1), (1000, 1), buckets=4)
    values = spark.createDataFrame([(0, 0, 1.0), (n // 2, 0, 2.0), (n - 1, 0, 3.0)], "i int, j int, v double")
    tiles.field("v", values=values)
    assert tiles.table.where("v IS NOT NULL").orderBy("tile").select("tile").toPandas()["tile"].tolist() == [0, 1500, 2999]
    assert sorted(map(tuple, tiles.cells("v").where("v <> 0").collect())) == [(0, 0, 1.0), (n // 2, 0, 2.0), (n - 1, 0, 3.0)]
