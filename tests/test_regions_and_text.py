"""Regions against brute force, and text dumps in many files."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from meshweave.operators import regions, slabs
from meshweave.operators.loop import Mesh
from meshweave.plans.catalog import MeshError
from meshweave.sources.store import Store

SCHEMA = "place long, kind string, x0 double, y0 double, x1 double, y1 double, radius double, value double"


def brute(rows, box):
    (ilow, ihigh), (jlow, jhigh) = box
    out = {}
    for _, kind, x0, y0, x1, y1, r, value in sorted((x for x in rows if x[0] is not None and x[1] in regions.KINDS), key=lambda x: x[0]):
        for i in range(ilow, ihigh):
            for j in range(jlow, jhigh):
                if x0 <= i < x1 and y0 <= j < y1 if kind == "rectangle" else (i - x0) ** 2 + (j - y0) ** 2 <= r * r if kind == "circle" else i == x0 and j == y0:
                    out[i, j] = value
    return out


@pytest.mark.parametrize("sent", [True, False])
def test_regions_equal_brute_force(spark, monkeypatch, sent):
    if not sent:
        monkeypatch.setattr(regions, "MOST_SENT", 0)
    rng = random.Random(5)
    rows = []
    for k in range(250):
        kind = rng.choice(regions.KINDS)
        x, y, w = rng.choice([rng.randint(-9, 45), rng.uniform(-9, 45)]), rng.randint(-9, 40), rng.choice([0, 0.4, 1, 2, 5, 30])
        rows.append((rng.randint(0, 10**6) * 1000 + k, kind, float(x), float(y), float(x + w), float(y + w * 1.5), float(w), float(k)))
    rows += [(None, "circle", 5.0, 5.0, 0.0, 0.0, 9.0, -1.0), (10**12, "blob", 5.0, 5.0, 9.0, 9.0, 9.0, -1.0), (10**12, "rectangle", 9.0, 5.0, 3.0, 9.0, 9.0, -1.0), (10**12, "point", 1e9, 5.0, 3.0, 9.0, 9.0, -1.0)]
    m = Mesh(spark)
    f = m.field(m.block("b", 2), "f", (40, 30), base=(-3, 0), below=(-1, 0), above=(0, 2))
    regions.set_regions(m, f, spark.createDataFrame(rows, SCHEMA))
    want = brute(rows, f.allocation)
    got = {(r["i"], r["j"]): r["f"] for r in m.table(f).collect()}
    assert len(got) == 41 * 32 and len(want) > 300
    assert got == {at: want.get(at, 0.0) for at in got}


def test_ten_thousand_regions_without_a_cross_join(spark):
    """Each cell meets the regions of its tiles alone: far fewer pairs than cells times regions."""
    n = 10_000
    table = spark.range(n).selectExpr("id place", "'rectangle' kind", "cast(id * 7919 % 600 as double) x0", "cast(id * 104729 % 600 as double) y0").selectExpr("*", "x0 + 3 x1", "y0 + 2 y1", "0D radius", "cast(place as double) value")
    m = Mesh(spark)
    f = m.field(m.block("b", 2), "f", (600, 600))
    regions.set_regions(m, f, table)
    plan = m.tables[m.key(f)]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    last = {}
    for k in range(n):
        x, y = k * 7919 % 600, k * 104729 % 600
        last.update({(i, j): float(k) for i in range(x, min(x + 3, 600)) for j in range(y, min(y + 2, 600))})
    got = {(r["i"], r["j"]): r["f"] for r in m.table(f).where("f > 0").collect()}
    assert got == {at: v for at, v in last.items() if v}


def test_regions_are_checked(spark):
    m = Mesh(spark)
    b = m.block("b", 2)
    empty = spark.createDataFrame([], SCHEMA)
    for f in (m.field(b, "line", (5, 1)), m.field(b, "pair", (5, 5), dim=2)):
        with pytest.raises(MeshError):
            regions.set_regions(m, f, empty)
    f = m.field(b, "f", (5, 5))
    regions.set_regions(m, f, empty)
    assert m.table(f).agg(F.sum("f")).first()[0] == 0


def test_a_dump_in_many_files(spark, tmp_path):
    """The files in the order of their names are what one task would have written."""
    m = Mesh(spark)
    b = m.block("b", 3)
    size = (3, 20, 9)
    cells = spark.range(540).selectExpr("cast(id % 3 as int) i", "cast(id div 3 % 20 as int) j", "cast(id div 60 as int) k", "id * 0.5D f")
    f = m.field(b, "f", size, values=cells)
    store = Store(spark, f"file://{tmp_path}/store")
    store.write_text(m, f, "dump", 6)
    files = sorted(Path(tmp_path, "store/dump").glob("part-*"))
    assert len(files) > 3
    text = "".join(p.read_text() for p in files).splitlines()
    assert text[0].startswith("f block=b size=[3, 20, 9]")
    assert text[1:] == [" ".join(str((3 * line + i) * 0.5) for i in range(3)) for line in range(180)]
    assert text[1:] == [r["line"] for r in slabs.text_lines(m, f).collect()]
    assert [r["line"] for r in store.read_text("dump").orderBy("n").collect()] == text
    line = m.field(m.block("c", 1), "g", (4,))
    store.write_text(m, line, "line", 3)
    assert [r["line"] for r in store.read_text("line").orderBy("n").collect()][1:] == ["0.0 0.0 0.0 0.0"]
