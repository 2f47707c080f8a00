"""Whole programs on the engine: relaxation, Poisson, lattice Boltzmann, alternating directions."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import bands, halo, slabs, tridiagonal
from ..operators.loop import Gbl, Idx, Mesh, Reduce, read, rw, write
from ..operators.reduction import Reduction
from ..plans.catalog import INC, MAX, Field, Halo, Stencil


def laplace_mesh(spark: SparkSession, n: int, dtype: str = "double") -> tuple[Mesh, Field, Field]:
    """A field with zero inside and sines on its left and right borders."""
    m = Mesh(spark)
    b = m.block("plate", 2)
    a, new = (m.field(b, x, (n, n), below=(-1, -1), above=(1, 1), dtype=dtype) for x in ("a", "new"))

    def sines(a, new, at) -> None:
        left = F.sin(math.pi * (at[1] + 1) / (n + 1))
        edge = F.when(at[0] == -1, left).when(at[0] == n, left * math.exp(-math.pi)).otherwise(0.0)
        a[0, 0] = edge
        new[0, 0] = edge

    for box in ([-1, 0, -1, n + 1], [n, n + 1, -1, n + 1]):
        m.loop("sines", b, box, sines, a=write(a), new=write(new), at=Idx())
    return m, a, new


def laplace(spark: SparkSession, n: int, steps: int, dtype: str = "double") -> float:
    """The largest change in the last of ``steps`` relaxation steps, by loops."""
    m, a, new = laplace_mesh(spark, n, dtype)
    star, box, error = Stencil.star(2), [0, n, 0, n], Reduction("error", dtype=dtype)

    def step(a, new, error) -> None:
        new[0, 0] = 0.25 * (a[1, 0] + a[-1, 0] + a[0, -1] + a[0, 1])
        error.add(F.abs(new[0, 0] - a[0, 0]))

    def back(a, new) -> None:
        a[0, 0] = new[0, 0]

    for k in range(steps):
        error = Reduction("error", dtype=dtype)
        m.loop("step", a.block, box, step, a=read(a, star), new=write(new), error=Reduce(error, MAX))
        if k < steps - 1:
            m.loop("back", a.block, box, back, a=write(a), new=read(new))
    return error.result()


def laplace_bands(spark: SparkSession, n: int, steps: int, height: int = 64, depth: int = 8) -> float:
    """The same in bands: one shuffle of borders for ``depth`` steps. The start is made row by row,
    so that no cell is ever a row of its own."""
    j = F.col("id")
    left = F.when((j == -1) | (j == n), 0.0).otherwise(F.sin(math.pi * (j + 1) / (n + 1)))
    row = F.concat(F.array(left), F.array_repeat(F.lit(0.0), n), F.array(left * math.exp(-math.pi)))
    rows = bands.in_bands(spark.range(-1, n + 1).select(j.alias("j"), row.alias("row")), 0, n, height)
    return bands.iterate(rows, bands.five_point, steps, 0, n, height, depth).agg(F.max("change")).first()[0]


def poisson(spark: SparkSession, n: int = 20, steps: int = 10, dx: float = 0.01, dy: float = 0.01, blocks: tuple[int, int] = (1, 1)) -> float:
    """The squared error after ``steps`` steps, the grid cut into blocks that swap halos each step."""
    m = Mesh(spark)
    width, height = n // blocks[0], n // blocks[1]
    parts = {}
    for p in range(blocks[0]):
        for q in range(blocks[1]):
            b = m.block(f"grid{p}_{q}", 2)
            parts[p, q] = tuple(m.field(b, x, (width, height), below=(-1, -1), above=(1, 1)) for x in ("u", "new", "f", "exact"))
    along = (1, 2)
    halos = []
    for (p, q), (u, *_) in parts.items():
        for (dp, dq), shape, start, to in (((1, 0), (1, height), (width - 1, 0), (-1, 0)), ((-1, 0), (1, height), (0, 0), (width, 0)), ((0, 1), (width, 1), (0, height - 1), (0, -1)), ((0, -1), (width, 1), (0, 0), (0, height))):
            if (other := parts.get((p + dp, q + dq))) is not None:
                halos.append(Halo(u, other[0], shape, start, to, along, along))
    box, border = [0, width, 0, height], [-1, width + 1, -1, height + 1]

    def populate(u, f, exact, at, shift) -> None:
        wave = F.sin(math.pi * dx * (at[0] + shift[0])) * F.cos(2 * math.pi * dy * (at[1] + shift[1]))
        u[0, 0] = wave
        f[0, 0] = -5 * math.pi**2 * wave
        exact[0, 0] = wave

    def zero(u) -> None:
        u[0, 0] = 0.0

    # The five-point scheme (u_W - 2 u + u_E) / dx^2 + (u_S - 2 u + u_N) / dy^2 = f, solved for u.
    weights = (1 / dx**2, 1 / dy**2)

    def step(u, f, new) -> None:
        along_x, along_y = u[1, 0] + u[-1, 0], u[0, 1] + u[0, -1]
        new[0, 0] = (weights[0] * along_x + weights[1] * along_y - f[0, 0]) / (2 * sum(weights))

    def back(new, u) -> None:
        u[0, 0] = new[0, 0]

    def squared(u, exact, error) -> None:
        error.add((u[0, 0] - exact[0, 0]) * (u[0, 0] - exact[0, 0]))

    for (p, q), (u, _, f, exact) in parts.items():
        m.loop("populate", u.block, border, populate, u=write(u), f=write(f), exact=write(exact), at=Idx(), shift=Gbl((p * width, q * height)))
        m.loop("zero", u.block, box, zero, u=write(u))
    for _ in range(steps):
        if halos:
            halo.transfer(m, halos)
        for u, new, f, _ in parts.values():
            m.loop("step", u.block, box, step, u=read(u, Stencil.star(2)), f=read(f), new=write(new))
            m.loop("back", u.block, box, back, new=read(new), u=write(u))
    error = Reduction("error")
    for u, _, _, exact in parts.values():
        m.loop("squared", u.block, box, squared, u=read(u), exact=read(exact), error=Reduce(error, INC))
    return error.result()


# Fixed values of the nine-velocity lattice: weights, velocities, and opposite directions.
WEIGHTS = (4 / 9, 1 / 9, 1 / 36, 1 / 9, 1 / 36, 1 / 9, 1 / 36, 1 / 9, 1 / 36)
CX, CY = (0, 0, 1, 1, 1, 0, -1, -1, -1), (0, 1, 1, 0, -1, -1, -1, 0, 1)
OPPOSITE = (0, 5, 6, 7, 8, 1, 2, 3, 4)
# Fixed values of the known flow: its open channels as inclusive boxes; everything else is solid.
CHANNELS = ((2, 65, 4, 29), (45, 123, 41, 65), (30, 101, 91, 115))


def lattice_boltzmann(spark: SparkSession, steps: int, n: int = 128, push: float = 1e-5, omega: float = 1.0) -> list[float]:
    """Kinetic energy after each step of a flow past solids, periodic both ways."""
    m = Mesh(spark, cut_every=2)
    b = m.block("lattice", 2)
    pops = m.field(b, "pops", (n, n), dim=9, below=(-1, -1), above=(1, 1))
    solid = m.field(b, "solid", (n, n), dtype="int", below=(-1, -1), above=(1, 1))
    box, round9 = [0, n, 0, n], Stencil("box9", tuple((x, y) for y in (-1, 0, 1) for x in (-1, 0, 1)))
    wrap_x = [Halo(pops, pops, (1, n), (n - 1, 0), (-1, 0), (1, 2), (1, 2)), Halo(pops, pops, (1, n), (0, 0), (n, 0), (1, 2), (1, 2))]
    wrap_y = [Halo(pops, pops, (n + 2, 1), (-1, n - 1), (-1, -1), (1, 2), (1, 2)), Halo(pops, pops, (n + 2, 1), (-1, 0), (-1, n), (1, 2), (1, 2))]

    def start(pops, solid, at) -> None:
        free = F.lit(False)
        for x0, x1, y0, y1 in CHANNELS:
            free = free | at[0].between(x0, x1) & at[1].between(y0, y1)
        solid[0, 0] = F.when(free, 0).otherwise(1)
        for d in range(9):
            pops[d, 0, 0] = F.lit(WEIGHTS[d])

    def stream_and_collide(pops, solid, energy) -> None:
        moved = [pops[d, -CX[d], -CY[d]] for d in range(9)]
        rho = sum(moved[1:], moved[0])
        ux = sum((moved[d] * CX[d] for d in range(1, 9)), F.lit(0.0)) / rho + push
        uy = sum((moved[d] * CY[d] for d in range(1, 9)), F.lit(0.0)) / rho
        speed = ux * ux + uy * uy
        for d in range(9):
            along = ux * CX[d] + uy * CY[d]
            rest = (1 + (3 + 4.5 * along) * along - 1.5 * speed) * WEIGHTS[d] * rho
            pops[d, 0, 0] = F.when(solid[0, 0] == 1, moved[OPPOSITE[d]]).otherwise(moved[d] + (rest - moved[d]) * omega)
        energy.add(speed)

    m.loop("start", b, box, start, pops=write(pops), solid=write(solid), at=Idx())
    out = []
    for _ in range(steps):
        halo.transfer(m, wrap_x)
        halo.transfer(m, wrap_y)
        m.cut(pops)
        energy = Reduction("energy")
        m.loop("stream", b, box, stream_and_collide, pops=rw(pops, round9), solid=read(solid), energy=Reduce(energy, INC))
        out.append(energy.result())
    return out


def alternating_directions(spark: SparkSession, n: int = 12, steps: int = 2, ratio: float = 1.0) -> Mesh:
    """Heat conduction by a tridiagonal solve along each axis in turn; border cells stay."""
    m = Mesh(spark)
    b = m.block("cube", 3)
    shape = (n, n, n)
    u, a, bb, c, d = (m.field(b, x, shape) for x in ("u", "a", "b", "c", "d"))
    box = [0, n] * 3

    def start(u, at) -> None:
        edge = (at[2] == 0) | (at[2] == n - 1)
        u[0, 0, 0] = F.when(edge, 1.0).otherwise(0.0)

    def systems(u, a, b, c, d, at) -> None:
        edge = F.lit(False)
        for x in at:
            edge = edge | (x == 0) | (x == n - 1)
        a[0, 0, 0] = F.when(edge, 0.0).otherwise(-0.5 * ratio)
        b[0, 0, 0] = F.when(edge, 1.0).otherwise(1.0 + ratio)
        c[0, 0, 0] = F.when(edge, 0.0).otherwise(-0.5 * ratio)
        around = -6.0 * u[0, 0, 0]
        for p in star.points[1:]:
            around = around + F.coalesce(u[p], F.lit(0.0))
        d[0, 0, 0] = F.when(edge, 0.0).otherwise(ratio * around)

    star = Stencil.star(3)
    m.loop("start", b, box, start, u=write(u), at=Idx())
    for _ in range(steps):
        m.loop("systems", b, box, systems, u=read(u, star), a=write(a), b=write(bb), c=write(c), d=write(d), at=Idx())
        tridiagonal.solve(m, 0, box, a, bb, c, d)
        tridiagonal.solve(m, 1, box, a, bb, c, d)
        tridiagonal.solve(m, 2, box, a, bb, c, d, into=u)
        m.cut(u)
    return m


def spot_values(m: Mesh, f: Field, cells: list[tuple[int, ...]]) -> list[float]:
    """Values of a few cells."""
    wanted = m.spark.createDataFrame(cells, ", ".join(f"{x} int" for x in f.axes))
    found = {tuple(r[x] for x in f.axes): r[f.name] for r in slabs.slab(m, f, [x for pair in f.allocation for x in pair]).join(F.broadcast(wanted), list(f.axes)).collect()}
    return [found[c] for c in cells]
