import pytest

from meshweave.operators import slabs
from pyspark.sql import functions as F

from meshweave.operators.loop import Mesh, Reduce, read, rw, write
from meshweave.operators.reduction import Reduction
from meshweave.plans import apps
from meshweave.plans.catalog import INC, Block, Field, Halo, MeshError, Stencil
from meshweave.sources.store import Store
from meshweave.streaming.steps import Checkpointer, Replay, run_steps, timings, until


def test_poisson(spark):
    assert apps.poisson(spark) == pytest.approx(16.5173570176708, rel=1e-9)


def test_poisson_in_two_blocks(spark):
    assert apps.poisson(spark, n=8, steps=3, blocks=(2, 1)) == pytest.approx(apps.poisson(spark, n=8, steps=3), rel=1e-12)


def test_poisson_with_unequal_steps(spark):
    """Against the same scheme in NumPy: dx and dy weigh the right neighbours."""
    import numpy as np

    n, dx, dy = 10, 0.03, 0.01
    at = np.arange(-1, n + 1)
    exact = np.sin(np.pi * dx * at)[:, None] * np.cos(2 * np.pi * dy * at)[None, :]
    u, f = exact.copy(), -5 * np.pi**2 * exact
    u[1:-1, 1:-1] = 0
    for _ in range(4):
        new = ((u[:-2, 1:-1] + u[2:, 1:-1]) / dx**2 + (u[1:-1, :-2] + u[1:-1, 2:]) / dy**2 - f[1:-1, 1:-1]) / (2 / dx**2 + 2 / dy**2)
        u[1:-1, 1:-1] = new
    want = ((u - exact)[1:-1, 1:-1] ** 2).sum()
    assert apps.poisson(spark, n=n, steps=4, dx=dx, dy=dy) == pytest.approx(want, rel=1e-10)


def test_laplace_in_bands(spark):
    assert apps.laplace_bands(spark, 30, 100, height=10, depth=5) == pytest.approx(0.0018718304066847602, rel=1e-12)


def test_laplace_by_loops_equals_bands(spark):
    assert apps.laplace(spark, 12, 3) == pytest.approx(apps.laplace_bands(spark, 12, 3, height=5, depth=2), rel=1e-12)


def test_lattice_boltzmann(spark):
    assert apps.lattice_boltzmann(spark, 2) == pytest.approx([1.6384e-06, 3.2507555555617583e-06], rel=1e-9)


def test_alternating_directions_keep_borders(spark):
    m = apps.alternating_directions(spark, 6, 1)
    u = Field(Block("cube", 3), "u", (6, 6, 6))
    assert apps.spot_values(m, u, [(0, 0, 0), (2, 2, 5), (0, 3, 3)]) == [1, 1, 0]


def test_store(spark, tmp_path):
    store, m = Store(spark, f"file://{tmp_path}/store"), Mesh(spark)
    b = m.block("b", 2)
    f, g = m.field(b, "f", (3, 2), below=(-1, 0)), m.field(b, "g", (3, 2), dim=2, dtype="float")
    star = Stencil.star(2)
    join = Halo(f, f, (1, 2), (0, 0), (2, 0), (1, 2), (1, -2))
    store.dump(m, [star], [join])
    assert store.read_block("b") == b and store.read_stencil(star.name) == star and store.read_halo(f, f) == join
    again = Mesh(spark)
    assert store.read_field(again, again.block("b", 2), "g", 2, "float") == g
    with pytest.raises(MeshError):
        store.read_field(again, b, "f", 2)
    with pytest.raises(MeshError):
        store.read_block("nothing")
    with pytest.raises(MeshError):
        store.read_block("b", 3)
    other = Mesh(spark)
    with pytest.raises(MeshError):
        store.write_field(other, other.field(other.block("b", 2), "f", (4, 2)))
    for _ in range(2):
        store.append_text(m, f, "text")
    files = sorted((tmp_path / "store" / "text").glob("part-*"))
    texts = [x for x in (p.read_text().splitlines() for p in files) if x]
    assert len(texts) == 2 and all(len(x) == 3 and x[0].startswith("f block=b") for x in texts)
    broken = Store(spark, f"file://{tmp_path}/broken")
    (tmp_path / "broken" / "meta").mkdir(parents=True)
    (tmp_path / "broken" / "meta" / "field").mkdir()
    (tmp_path / "broken" / "meta" / "field" / "b.f").write_bytes(b"not json")
    with pytest.raises(ValueError):  # found, but not readable: never taken for missing
        broken.write_field(m, f)


def test_replay_saves_what_changed(spark, tmp_path):
    counts = []
    for program in range(3):
        m = Mesh(spark)
        b = m.block("b", 1)
        f, g = m.field(b, "f", (4,)), m.field(b, "g", (4,))
        saver = Checkpointer(m, f"file://{tmp_path}/saves", [f, g], interval=1e-6)
        run = Replay(saver)

        def begin(g) -> None:
            g[0,] = F.lit(5.0)

        def more(f) -> None:
            f[0,] = f[0,] + 1

        def total(f, r) -> None:
            r.add(f[0,])

        run.loop("begin", b, [0, 4], begin, g=write(g))
        run.ready()
        seen = []
        for _ in range(2 + 2 * program):
            r = Reduction("r")
            run.loop("more", b, [0, 4], more, f=rw(f))
            run.loop("total", b, [0, 4], total, f=read(f), r=Reduce(r, INC))
            seen.append(run.result(r))
        assert seen == [4.0 * (k + 1) for k in range(2 + 2 * program)]
        assert {x["g"] for x in slabs.interior(m, g).collect()} == {5.0}
        counts.append((run.stats["skipped"], run.stats["saves"] > 0))
        folders = {p.parent.parent.name for p in (tmp_path / "saves").glob("*/b/g")}
    assert counts[0] == (0, True) and counts[1][0] == 3 and counts[2][0] == 7
    assert folders == {"00000001"}  # g does not change and is not written again; its save stays for it
    assert len(list((tmp_path / "saves").glob("*/done"))) <= 2


def test_steps_and_timings(spark, tmp_path):
    m = Mesh(spark)
    b = m.block("b", 1)
    f = m.field(b, "f", (4,))

    def more(f) -> None:
        f[0,] = f[0,] + 1

    saver = Checkpointer(m, f"file://{tmp_path}/saves", [f], interval=1e-6)
    assert run_steps(lambda k: m.loop("more", b, [0, 4], more, f=rw(f)), 2, saver) == 0
    second = Mesh(spark)
    b2 = second.block("b", 1)
    f2 = second.field(b2, "f", (4,))
    again = Checkpointer(second, f"file://{tmp_path}/saves", [f2], interval=3600)
    assert run_steps(lambda k: second.loop("more", b2, [0, 4], more, f=rw(f2)), 3, again) == 2
    assert {r["f"] for r in slabs.interior(second, f2).collect()} == {3.0}
    assert until(lambda k: 1 / (k + 1), 0.3, 10) == (4, 0.25)
    assert timings(m).first()["calls"] == 2
    with pytest.raises(MeshError):
        Checkpointer(m, "x", [], interval=0)
