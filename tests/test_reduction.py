"""Cyclic reduction against the recurrence, and what it shuffles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave.operators import tridiagonal
from meshweave.operators.loop import Mesh
from meshweave.plans.catalog import MeshError


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("n", "chunk"), [(1, 4), (2, 4), (5, 8), (8, 8), (9, 8), (50, 8), (64, 8), (37, 16), (100, 100)])
def test_reduction_equals_the_recurrence(spark, n, chunk):
    rng = np.random.default_rng(n)
    lines = []
    for line in range(3):
        a, c, d = rng.standard_normal((3, n))
        b = np.abs(a) + np.abs(c) + 0.5
        lines += [(line, k - 4, *map(float, (a[k], b[k], c[k], d[k]))) for k in range(n)]
    systems = spark.createDataFrame(lines, "j int, i int, a double, b double, c double, d double").repartition(5)
    got = {(r["j"], r["i"]): r["x"] for r in tridiagonal.solve_by_reduction(systems, ["j"], "i", -4, n, chunk).collect()}
    assert len(got) == 3 * n
    for line in range(3):
        own = np.array([x[2:] for x in lines if x[0] == line]).T
        want = tridiagonal.thomas(*(x[None, :] for x in own))[0]
        assert np.abs(want - [got[line, k - 4] for k in range(n)]).max() < 1e-9


def test_one_line_of_a_million_cells(spark):
    """To 1e-9 of the recurrence, in two shuffles and without Python."""
    n = 1_000_000
    values = {x: f"{lo} + {w} * (id * {p} % 1009) / 1009" for x, lo, w, p in (("a", -1.0, 0.5, 7919), ("b", 2.5, 0.5, 104729), ("c", -0.7, 0.6, 1299709), ("d", -3.0, 6.0, 15485863))}
    systems = spark.range(n).selectExpr("cast(id as int) i", *(f"cast({e} as double) {x}" for x, e in values.items()))
    solved = tridiagonal.solve_by_reduction(systems, [], "i", 0, n, 65_536)
    plan = plan_of(solved)
    assert plan.count("Exchange") == 2 and "Arrow" not in plan and "Python" not in plan and "Pandas" not in plan
    rows = systems.toPandas().sort_values("i")
    want = tridiagonal.thomas(*(rows[x].to_numpy()[None, :] for x in "abcd"))[0]
    got = solved.toPandas().sort_values("i")["x"].to_numpy()
    assert len(got) == n and np.abs(got - want).max() < 1e-9


def test_how_lines_are_solved(spark, monkeypatch):
    """Few long lines are reduced, many are cut, short ones are whole; a singular pivot gives no number."""
    used = []
    for name in ("solve_lines", "solve_long_lines", "solve_by_reduction"):
        monkeypatch.setattr(tridiagonal, name, lambda *a, f=getattr(tridiagonal, name), n=name: used.append(n) or f(*a))
    for size, chunk, by in (((30, 2), 100, None), ((30, 2), 8, None), ((30, 20), 8, None), ((30, 2), 100, "reduction")):
        m = Mesh(spark)
        b = m.block("b", 2)
        cells = spark.range(size[0] * size[1]).selectExpr(f"cast(id % {size[0]} as int) i", f"cast(id div {size[0]} as int) j")
        fs = [m.field(b, x, size, values=cells.withColumn(x, F.lit(v))) for x, v in (("a", 1.0), ("b", 4.0), ("c", 1.0), ("d", 6.0))]
        tridiagonal.solve(m, 0, [0, size[0], 0, size[1]], *fs, chunk=chunk, by=by)
        x = m.table(fs[3]).where("i = 15 and j = 1").first()["d"]
        assert abs(x - 1) < 1e-6
    assert used == ["solve_lines", "solve_by_reduction", "solve_long_lines", "solve_by_reduction"]
    with pytest.raises(MeshError):
        tridiagonal.solve(m, 0, [0, 30, 0, 2], *fs, by="guess")
    with pytest.raises(MeshError):
        tridiagonal.solve_by_reduction(cells, ["j"], "i", 0, 1000, 4)
    one = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0)], "i int, a double, b double, c double, d double")
    assert np.isnan(tridiagonal.solve_by_reduction(one, [], "i", 0, 1, 4).first()["x"])


@pytest.mark.parametrize(("n", "chunk"), [(100, 4), (1000, 4), (1023, 1), (5000, 8)])
def test_lines_of_any_length_are_reduced(spark, n, chunk):
    """Lines longer than the square of ``chunk`` take several stages; they were refused before."""
    rng = np.random.default_rng(n)
    lines = []
    for line in range(2):
        a, c, d = rng.standard_normal((3, n))
        lines.append(np.array([a, np.abs(a) + np.abs(c) + 0.5, c, d]))
    cells = spark.createDataFrame([(k + 2, j, *map(float, lines[j][:, k])) for j in range(2) for k in range(n)], "i int, j int, a double, b double, c double, d double").repartition(5)
    m = Mesh(spark)
    block = m.block("b", 2)
    fs = [m.field(block, x, (n, 2), base=(2, 0), values=cells.select("i", "j", x)) for x in "abcd"]
    tridiagonal.solve(m, 0, [2, n + 2, 0, 2], *fs, chunk=chunk, by="reduction")
    got = {(r["j"], r["i"]): r["d"] for r in m.table(fs[3]).collect()}
    for j in range(2):
        want = tridiagonal.thomas(*(x[None, :] for x in lines[j]))[0]
        assert np.abs(want - [got[j, k + 2] for k in range(n)]).max() < 1e-9
