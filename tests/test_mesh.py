import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave.functions import randoms, scalar
from meshweave.operators import halo, slabs, tridiagonal
from meshweave.operators.gather import by_key, by_tile, by_window
from meshweave.operators.loop import Dat, Idx, Mesh, Reduce, read, rw, write
from meshweave.operators.reduction import Reduction
from meshweave.plans.catalog import INC, MAX, MIN, WRITE, Block, Field, Halo, MeshError, Stencil
from meshweave.plans.grid import densified, index_set
from meshweave.plans.options import Options
from meshweave.streaming.steps import timings


def numbered(m: Mesh, b: Block, name: str, size: tuple[int, ...], factors: tuple[int, ...], **more) -> Field:
    f = m.field(b, name, size, **more)

    def number(f, at) -> None:
        f[(0,) * b.dims] = sum((x * k for x, k in zip(at[1:], factors[1:], strict=True)), at[0] * factors[0])

    m.loop("number", b, [x for s in size for x in (0, s)], number, f=write(f), at=Idx())
    return f


def values(df) -> dict:
    return {tuple(r)[:-1]: r[-1] for r in df.collect()}


@pytest.mark.parametrize("dims", [0, 6])
def test_block_dims(dims):
    with pytest.raises(MeshError):
        Block("b", dims)


@pytest.mark.parametrize("more", [{"below": (1, 0)}, {"above": (0, -1)}, {"base": (0,)}, {"dtype": "text"}, {"dim": 0}])
def test_field_errors(more):
    with pytest.raises(MeshError):
        Field(Block("b", 2), "f", (3, 3), **more)


@pytest.mark.parametrize("direction", [(0, 1), (1, 1), (1, 3)])
def test_halo_directions(direction):
    f = Field(Block("b", 2), "f", (3, 3))
    with pytest.raises(MeshError):
        Halo(f, f, (1, 3), (0, 0), (2, 0), direction, (1, 2))


def test_loop_errors(spark):
    m = Mesh(spark)
    b = m.block("b", 2)
    f = m.field(b, "f", (3, 3))
    with pytest.raises(MeshError):
        m.loop("wide write", b, [0, 3, 0, 3], lambda f: None, f=write(f, Stencil.star(2)))
    with pytest.raises(MeshError):
        m.loop("undeclared offset", b, [0, 3, 0, 3], lambda f: f[1, 1], f=read(f, Stencil.star(2)))
    with pytest.raises(MeshError):
        m.loop("short range", b, [0, 3], lambda f: None, f=read(f))
    with pytest.raises(MeshError):
        m.loop("min of a full field", b, [0, 3, 0, 3], lambda f: None, f=Dat(f, Stencil.point(2), MIN))
    with pytest.raises(MeshError):
        m.field(b, "f", (3, 3))

    def put(f) -> None:
        f[0, 0] = 1.0

    with pytest.raises(MeshError):
        m.loop("write of a read", b, [0, 3, 0, 3], put, f=read(f))


def test_reduction_states(spark):
    m = Mesh(spark)
    b = m.block("b", 2)
    f = numbered(m, b, "f", (4, 4), (1, 10))
    r = Reduction("r")

    def add(f, r) -> None:
        r.add(f[0, 0])

    m.loop("sum", b, [0, 4, 0, 4], add, f=read(f), r=Reduce(r, INC))
    with pytest.raises(MeshError):
        m.loop("other access", b, [0, 4, 0, 4], add, f=read(f), r=Reduce(r, MAX))
    assert r.result() == 264
    m.loop("after reading", b, [0, 4, 0, 4], add, f=read(f), r=Reduce(r, MAX))
    assert r.result() == 33
    with pytest.raises(MeshError):
        r.result()
    with pytest.raises(MeshError):
        m.loop("complex", b, [0, 4, 0, 4], add, f=read(f), r=Reduce(Reduction("z", dtype="complexd"), MIN))


def test_nan_is_left_out_of_extremes(spark):
    m = Mesh(spark)
    b = m.block("b", 1)
    f = numbered(m, b, "f", (5,), (1,))
    slabs.set_slab(m, f, m.table(f).withColumn("f", F.lit(float("nan"))), [2, 3])
    low, high = Reduction("low"), Reduction("high")

    def look(f, low, high) -> None:
        low.add(f[0,])
        high.add(f[0,])

    m.loop("look", b, [0, 5], look, f=read(f), low=Reduce(low, MIN), high=Reduce(high, MAX))
    assert (low.result(), high.result()) == (0, 4)
    assert [r["i"] for r in slabs.first_nan(m, f).collect()] == [2]


def test_windows_and_keys_agree(spark):
    grid = index_set(spark, ("i", "j"), ((-1, 6), (0, 5))).withColumn("v", F.col("i") * 7 + F.col("j") * F.col("j"))
    wanted = {"v": {(0, 0), (1, 0), (-2, 0), (0, 1), (1, -1), (2, 2)}}
    one, two = by_window(grid, ("i", "j"), wanted), by_key(grid, ("i", "j"), wanted)
    columns = sorted(two.columns)
    assert sorted(map(str, one.select(*(F.col(f"`{c}`") for c in columns)).collect())) == sorted(map(str, two.select(*(F.col(f"`{c}`") for c in columns)).collect()))


def test_missing_cells_are_filled(spark):
    some = spark.createDataFrame([(0, 5.0), (3, 7.0), (9, 1.0)], "i int, v double")
    assert values(densified(some, ("i",), ((0, 5),), {"v": F.lit(0.0)})) == {(0,): 5, (1,): 0, (2,): 0, (3,): 7, (4,): 0}


HALOS = [
    # shape, from, to, from_dir, to_dir, sum, two cells
    ((2, 20), (18, 0), (-2, 0), (1, 2), (1, 2), 8340, {(-2, 0): 18, (-1, 19): 399}),
    ((2, 20), (0, 0), (20, 0), (1, 2), (1, -2), 7620, {(20, 0): 380, (21, 19): 1}),
    ((20, 2), (0, 0), (0, 20), (1, 2), (-1, 2), 780, {(0, 20): 19, (19, 21): 20}),
    ((2, 20), (18, 0), (0, -2), (1, 2), (2, 1), 8340, {(0, -2): 18, (19, -1): 399}),
]


@pytest.mark.parametrize(("shape", "start", "to", "from_dir", "to_dir", "total", "cells"), HALOS)
def test_halo_orientations(spark, shape, start, to, from_dir, to_dir, total, cells):
    m = Mesh(spark)
    source = numbered(m, m.block("a", 2), "f", (20, 20), (1, 20), below=(-2, -2), above=(2, 2))
    target = m.field(m.block("b", 2), "g", (20, 20), below=(-2, -2), above=(2, 2))
    halo.transfer(m, [Halo(source, target, shape, start, to, from_dir, to_dir)])
    got = {k: v for k, v in values(m.table(target)).items() if v}
    assert sum(got.values()) == total
    assert {k: got[k] for k in cells} == cells


def test_halo_in_four_dimensions(spark):
    m = Mesh(spark)
    source = numbered(m, m.block("a", 4), "f", (3, 3, 3, 3), (1, 3, 9, 27))
    target = m.field(m.block("b", 4), "g", (3, 3, 3, 3))
    halo.transfer(m, [Halo(source, target, (3, 3, 3, 1), (0, 0, 0, 2), (0, 0, 0, 0), (1, 2, 3, 4), (2, 1, -3, 4))])
    got = values(m.table(target))
    assert all(got[i, j, k, 0] == j + 3 * i + 9 * (2 - k) + 54 for i in range(3) for j in range(3) for k in range(3))


def test_low_dimensional_sums(spark):
    m = Mesh(spark)
    b = m.block("b", 3)
    f = m.field(b, "f", (10, 10, 10))
    shifted = [(lambda at: (at + 3) % 10)]
    xy, xz, yz = m.field(b, "xy", (10, 10, 1)), m.field(b, "xz", (10, 1, 10)), m.field(b, "yz", (1, 10, 10))
    x, z = m.field(b, "x", (10, 1, 1)), m.field(b, "z", (1, 1, 10))

    def number(f, at) -> None:
        s = [shifted[0](a) for a in at]
        f[0, 0, 0] = (s[0] + 10 * s[1] + 100 * s[2]).cast("double")

    def fold(f, **to) -> None:
        for t in to.values():
            t.add(f[0, 0, 0])

    box, point = [0, 10] * 3, Stencil.point(3)
    m.loop("number", b, box, number, f=write(f), at=Idx())
    m.loop("fold", b, box, fold, f=read(f), xy=Dat(xy, point, MAX), xz=Dat(xz, point, INC), yz=Dat(yz, point, MIN), x=Dat(x, point, INC), z=Dat(z, point, INC))
    assert values(m.table(xy))[0, 0] == 933
    assert values(m.table(xz))[0, 0] == 3480
    assert values(m.table(yz))[0, 0] == 330
    assert (values(m.table(x))[(0,)], values(m.table(z))[(0,)]) == (49800, 34950)
    m.loop("again", b, box, fold, f=read(f), z=Dat(z, point, MAX))
    assert values(m.table(z))[(9,)] == 299


def test_multigrid(spark):
    m = Mesh(spark)
    b = m.block("b", 2)
    small = numbered(m, b, "small", (6, 6), (1, 6))
    middle, large = m.field(b, "middle", (12, 12)), m.field(b, "large", (24, 24))
    up, down = Stencil("up", ((0, 0),), "prolong", (2, 2)), Stencil("down", ((0, 0),), "restrict", (2, 2))

    def copy(a, to) -> None:
        to[0, 0] = a[0, 0]

    m.loop("up", b, [0, 12, 0, 12], copy, a=read(small, up), to=write(middle))
    m.loop("up", b, [0, 24, 0, 24], copy, a=read(middle, up), to=write(large))
    got = values(m.table(large))
    assert sum(got.values()) == 10080 and all(v == i // 4 + 6 * (j // 4) for (i, j), v in got.items())
    fine = numbered(m, b, "fine", (24, 24), (1, 24))
    m.loop("down", b, [0, 12, 0, 12], copy, a=read(fine, down), to=write(middle))
    m.loop("down", b, [0, 6, 0, 6], copy, a=read(middle, down), to=write(small))
    got = values(m.table(small))
    assert sum(got.values()) == 9000 and all(v == 4 * i + 96 * j for (i, j), v in got.items())


def test_vectors_and_complex_numbers(spark):
    m = Mesh(spark)
    b = m.block("b", 2)
    pair, z = m.field(b, "pair", (4, 4), dim=2), m.field(b, "z", (6, 6), dtype="complexd")
    sums, total = Reduction("sums", dim=2), Reduction("total", dtype="complexd")

    def fill(pair, at, sums) -> None:
        for d in (0, 1):
            pair[d, 0, 0] = at[d].cast("double")
            sums.add(pair[d, 0, 0], d)

    def number(z, at) -> None:
        z[0, 0] = scalar.complex_of(at[0].cast("double"), at[1].cast("double"))

    def add(z, total) -> None:
        total.add(z[0, 0])

    m.loop("fill", b, [0, 4, 0, 4], fill, pair=write(pair), at=Idx(), sums=Reduce(sums, INC))
    m.loop("number", b, [0, 6, 0, 6], number, z=write(z), at=Idx())
    m.loop("add", b, [0, 6, 0, 6], add, z=read(z), total=Reduce(total, INC))
    assert sums.result() == [24, 24]
    assert tuple(total.result()) == (90, 90)


def test_tridiagonal_errors_and_box(spark):
    m = Mesh(spark)
    b = m.block("b", 1)
    a, bb, c, d = (m.field(b, x, (6,)) for x in "abcd")
    other = m.field(b, "other", (5,))

    def fill(a, bb, c, d, at) -> None:
        a[0,], bb[0,], c[0,], d[0,] = 1.0, 4.0, 1.0, at[0].cast("double")

    m.loop("fill", b, [0, 6], fill, a=write(a), bb=write(bb), c=write(c), d=write(d), at=Idx())
    with pytest.raises(MeshError):
        tridiagonal.solve(m, 0, [0, 6], a, bb, c, other)
    tridiagonal.solve(m, 0, [1, 5], a, bb, c, d)
    x = values(m.table(d))
    assert x[(0,)] == 0 and x[(5,)] == 5
    assert abs(4 * x[(1,)] + x[(2,)] - 1) < 1e-12 and abs(x[(2,)] + 4 * x[(3,)] + x[(4,)] - 3) < 1e-12


def test_raw_access_and_planes(spark):
    m = Mesh(spark)
    b = m.block("b", 2)
    f = numbered(m, b, "f", (20, 20), (1, 20), below=(-1, -1), above=(1, 1))

    def star(f) -> None:
        f[0, 0] = f[0, 0] + f[1, 0] + f[-1, 0] + f[0, 1] + f[0, -1]

    m.loop("star", b, [10, 11, 10, 11], star, f=rw(f, Stencil.star(2)))
    assert values(slabs.slab(m, f, [10, 12, 10, 12])) == {(10, 10): 1050, (11, 10): 211, (10, 11): 230, (11, 11): 231}
    assert slabs.slab_extents(f, [10, 12, 10, 12]) == ((2, 2), 32)
    with pytest.raises(MeshError):
        slabs.slab_extents(f, [-1, 2, 0, 2])
    with pytest.raises(MeshError):
        slabs.plane(m, f, 0, 20)
    with pytest.raises(MeshError):
        slabs.plane(m, f, 2, 0)


def test_random_fields(spark):
    cells = index_set(spark, ("i", "j"), ((0, 200), (0, 100)))
    at = [F.col("i"), F.col("j")]
    row = cells.select(randoms.uniform(at, 5).alias("u"), randoms.normal(at, 5).alias("n")).agg(F.min("u"), F.max("u"), F.avg("u"), F.stddev("u"), F.avg("n"), F.stddev("n"), F.countDistinct("u")).first()
    assert row[0] >= 0 and row[1] < 1 and abs(row[2] - 0.5) < 0.01 and abs(row[3] - 0.2887) < 0.01
    assert abs(row[4]) < 0.03 and abs(row[5] - 1) < 0.03 and row[6] > 19_000
    assert values(cells.select(*at, randoms.uniform(at, 5))) == values(cells.repartition(7).select(*at, randoms.uniform(at, 5)))


def test_scalars(spark):
    row = spark.range(1).select(scalar.sign(F.lit(3), F.lit(-1)), scalar.sign(F.lit(-3), F.lit(-1)), scalar.min3(F.lit(3), F.lit(1), F.lit(2)), scalar.max3(F.lit(3), F.lit(1), F.lit(2)), scalar.to_half(F.lit(0.1))).first()
    assert tuple(row) == (-3, 3, 1, 3, 0.0999755859375)


def test_arrays_and_metadata(spark):
    m = Mesh(spark)
    b = m.block("b", 2)
    f = numbered(m, b, "f", (4, 3), (1, 10), below=(-1, 0))
    array = slabs.as_array(m, f)
    assert array.shape == (5, 3) and array[1 + 2, 1] == 12 and array[0, 0] == 0
    assert slabs.raw_metadata(f) == {"shape": (5, 3), "strides": (1, 5), "below": (-1, 0), "above": (0, 0)}
    assert sum(r["cells"] for r in slabs.partitions(m, f).collect()) == 15
    pair = m.field(b, "pair", (4, 3), dim=2)
    assert slabs.as_array(m, pair).shape == (4, 3, 2)
    with pytest.raises(MeshError):
        slabs.as_array(m, f, most=3)
    with pytest.raises(MeshError):
        slabs.transposed(m, f, (0, 0))
    m.free(f)
    assert [r["field"] for r in m.catalog().collect()] == ["pair"]


def test_partitioned_tridiagonal(spark):
    """Pieces of any size give the solution of the whole system, with either end's neighbour left out."""
    rng = np.random.default_rng(4)
    n = 57
    lower, upper = rng.uniform(-1, 1, n), rng.uniform(-1, 1, n)
    middle, right = rng.uniform(3, 4, n), rng.normal(size=n)
    full = np.diag(middle) + np.diag(lower[1:], -1) + np.diag(upper[:-1], 1)
    want = np.linalg.solve(full, right)
    m = Mesh(spark)
    b = m.block("line", 1)
    values = spark.createDataFrame([(k, float(lower[k]), float(middle[k]), float(upper[k]), float(right[k])) for k in range(n)], "i int, a double, b double, c double, d double")
    a, bb, c, d = (m.field(b, x, (n,), values=values.select("i", x)) for x in "abcd")
    x = m.field(b, "x", (n,))
    for chunk in (1, 2, 10, 56, 57):
        tridiagonal.solve(m, 0, [0, n], a, bb, c, d, into=x, chunk=chunk)
        m.cut(x)
    got = slabs.as_array(m, x)
    assert np.allclose(got, 5 * want, rtol=1e-9)


def test_each_loop_runs_once(spark):
    """A loop that writes and reduces is stored; its handles share one row."""
    m = Mesh(spark, profile=True)
    b = m.block("b", 2)
    f = m.field(b, "f", (6, 5))
    total, most, last, none = Reduction("total"), Reduction("most", dtype="int"), Reduction("last", dtype="int"), Reduction("none")

    def set_(f, at, total, most, last, none) -> None:
        f[0, 0] = at[0] + 10 * at[1]
        total.add(at[0])
        most.add(at[1])
        last.add(F.when(at[1] < 3, at[0] + 1).otherwise(0))

    m.loop("set", b, [0, 6, 0, 5], set_, f=write(f), at=Idx(), total=Reduce(total, INC), most=Reduce(most, MAX), last=Reduce(last, WRITE), none=Reduce(none, MIN))
    assert total.pending[0][0] is most.pending[0][0]
    assert (total.result(), most.result(), last.result()) == (75.0, 4, 6) and none.result() > 1e300
    m.loop("empty", b, [2, 2, 0, 5], set_, f=write(f), at=Idx(), total=Reduce(total, INC), most=Reduce(most, MAX), last=Reduce(last, WRITE), none=Reduce(none, MIN))
    assert total.result() == 0.0 and last.result() == 0
    m.deal(f, 1, 3)
    assert m.tables[m.key(f)].count() == 30
    with pytest.raises(MeshError):
        m.deal(f, 2, 3)
    told = {r["loop"]: r for r in timings(m).collect()}
    assert told["set"]["seconds"] > 0 and told["set"]["gb_per_second"] > 0 and told["set"]["planned"] > 0


def test_options(spark):
    assert Options.parse([]) == Options()
    got = Options.parse(["--profile", "-cut-every=2", "other", "partitions=3", "PARTITIONS=5", "interval=0.5", "diagnostics=2"])
    assert got == Options(True, 2, 5, 2, 0.5)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    m = got.mesh(spark)
    assert m.profile and m.cut_every == 2 and spark.conf.get("spark.sql.shuffle.partitions") == "5"
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    for bad in ("partitions=x", "cut_every=0", "interval=-1"):
        with pytest.raises(MeshError):
            Options.parse([bad])


@pytest.mark.parametrize("sizes", [(23, 40), (70, 3), (9, 11, 20)])
def test_tiles_equal_windows(spark, sizes):
    """Tiles of any cut, with corners, wide offsets, several columns, arrays and nulls."""
    axes = ("i", "j", "k")[: len(sizes)]
    low = (-2, 5, 0)[: len(sizes)]
    n = int(np.prod(sizes))
    at, rest = [], F.col("id")
    for x, size, base in zip(axes, sizes, low, strict=True):
        at.append((rest % size + base).cast("int").alias(x))
        rest = F.floor(rest / size)
    df = spark.range(n).select(*at, F.when(F.col("id") % 7 > 0, F.col("id") * 1.5).alias("v"), F.array(F.col("id"), F.col("id") + 1).alias("w"), (F.col("id") % 2 == 0).alias("other"))
    unit = lambda a, s: tuple(s if b == a else 0 for b in range(len(sizes)))
    wanted = {"v": {unit(0, 1), unit(1, -2), (1,) * len(sizes), (0,) * len(sizes)}, "w": {unit(len(sizes) - 1, 3), (-1,) * len(sizes)}}
    want = by_window(df, axes, wanted)
    box = tuple((b, b + s) for b, s in zip(low, sizes, strict=True))
    for most in (64, 1 << 18):
        got = by_tile(df, axes, wanted, box, most)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*(F.col(f"`{c}`") for c in got.columns)).collect()))


def test_large_grids_of_few_lines_are_gathered_in_tiles(spark, monkeypatch):
    from meshweave.operators import gather as g

    monkeypatch.setattr(g, "FEW_CELLS", 10)
    seen, whole = [], g.by_tile
    monkeypatch.setattr(g, "by_tile", lambda *a: seen.append(a) or whole(*a))
    m = Mesh(spark)
    b = m.block("b", 2)
    f = numbered(m, b, "f", (40, 5), (1, 100))  # five lines, eight partitions
    new = slabs.copied(m, f, "new")

    def step(f, new) -> None:
        new[0, 0] = f[1, 0] + f[0, -1]

    m.loop("step", b, [0, 39, 1, 5], step, f=read(f, Stencil.star(2)), new=write(new))
    got = slabs.as_array(m, new)
    assert len(seen) == 1
    at = np.arange(40)[:, None] + 100 * np.arange(5)[None, :]
    assert (got[:-1, 1:] == (at[1:, 1:] + at[:-1, :-1])).all() and (got[-1] == at[-1]).all()
