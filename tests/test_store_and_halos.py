"""What stored slabs read, that a plane group is one pass, and that a halo group is one join."""

import random
import uuid
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from meshweave.functions.scalar import to_half_each
from meshweave.operators import halo
from meshweave.operators.loop import Mesh
from meshweave.plans.catalog import Block, Halo, MeshError
from meshweave.plans.grid import morton, morton_ranges
from meshweave.sources.store import KEY, Missing, Store


def numbered(spark, size, base=None):
    """Cells with the number of each as its value."""
    step, columns = 1, []
    for axis, n, b in zip("ijklm", size, base or (0,) * len(size), strict=False):
        columns.append(f"cast(id div {step} % {n} + {b} as int) {axis}")
        step *= n
    return spark.range(step).selectExpr(*columns, "cast(id as double) v")


@pytest.mark.parametrize("box", [((0, 13),), ((-3, 9), (5, 22)), ((0, 5), (-1, 6), (2, 13)), ((0, 2), (0, 3), (0, 4), (0, 2), (0, 3))])
def test_ranges_hold_the_part(spark, box):
    axes = tuple("ijklm"[: len(box)])
    cells = numbered(spark, [hi - lo for lo, hi in box], [lo for lo, _ in box]).select(*axes, morton(axes, box).alias("key")).collect()
    assert len({r["key"] for r in cells}) == len(cells)
    rng = random.Random(len(box))
    for most in (1, 3, 64):
        for _ in range(15):
            part = tuple(sorted((rng.randint(lo - 2, hi + 2), rng.randint(lo - 2, hi + 2))) for lo, hi in box)
            ranges = morton_ranges(box, tuple(map(tuple, part)), most)
            inside = [r["key"] for r in cells if all(lo <= r[a] < hi for a, (lo, hi) in zip(axes, part, strict=True))]
            assert len(ranges) <= most and all(any(lo <= k <= hi for lo, hi in ranges) for k in inside)
            if most == 64 and not inside:
                assert not any(lo <= r["key"] <= hi for lo, hi in ranges for r in cells)


def test_keys_of_very_long_axes_are_coarse():
    box = ((0, 1 << 40), (0, 1 << 40))
    (low, high), *_ = morton_ranges(box, ((5, 6), (7, 8)))
    assert 0 <= low <= high < 1 << 62


def test_a_slab_reads_few_row_groups(spark, tmp_path):
    """One per cent of a million cells: at most five per cent of the row groups, by Parquet's own statistics."""
    n = 1000
    m = Mesh(spark)
    b = m.block("b", 2)
    v = m.field(b, "v", (n, n), values=numbered(spark, (n, n)))
    store = Store(spark, f"file://{tmp_path}/store", per_file=300_000, per_group=3000)
    store.write_field(m, v)
    box = [430, 530, 610, 710]
    got = store.read_slab(b, "v", box)
    plan = got._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "Or(Or(" in pushed
    few = store.read_slab(b, "v", box, most=1)._jdf.queryExecution().executedPlan().toString().split("PushedFilters: [")[1]
    assert f"GreaterThanOrEqual({KEY}," in few
    assert got.agg(F.count("*"), F.sum("v")).first()[:] == (10_000, float(sum(i + n * j for i in range(430, 530) for j in range(610, 710))))
    ranges, read, every = morton_ranges(((0, n), (0, n)), ((430, 530), (610, 710))), 0, 0
    for file in Path(tmp_path, "store/b/v/data").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = meta.schema.names.index(KEY)
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at).statistics
            every += 1
            read += any(lo <= stats.max and hi >= stats.min for lo, hi in ranges)
    assert every > 200 and read <= 0.05 * every
    with pytest.raises(Missing):
        store.read_slab(b, "w", box)
    assert store.read_slab(b, "v", [5, 5, 0, 9]).count() == 0


def test_halo_cells_and_lines_are_read(spark, tmp_path):
    m = Mesh(spark)
    b = m.block("b", 2)
    v = m.field(b, "v", (6, 1), below=(-2, 0), above=(1, 0), values=spark.range(-2, 7).selectExpr("cast(id as int) i", "id * 1.0 v"))
    store = Store(spark, f"file://{tmp_path}/store")
    store.write_field(m, v)
    assert [r["v"] for r in store.read_slab(b, "v", [-2, 1, 0, 1]).orderBy("i").collect()] == [-2.0, -1.0, 0.0]
    again = Mesh(spark)
    back = store.read_field(again, store.read_block("b"), "v")
    assert again.table(back).columns == ["i", "v"] and again.table(back).count() == 9


def jobs_of(spark, run):
    tracker, group = spark.sparkContext.statusTracker(), uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(tracker.getJobIdsForGroup(group))


def test_a_plane_group_is_one_pass(spark, tmp_path):
    """However many planes and fields: the job that writes, and one for the names."""
    m = Mesh(spark)
    b = m.block("b", 3)
    cells = numbered(spark, (8, 7, 6))
    fields = [m.field(b, x, (8, 7, 6), values=cells.withColumnRenamed("v", x)) for x in ("u", "v", "w")]
    for f in fields:
        m.cut(f)
    store = Store(spark, f"file://{tmp_path}/store")
    counts = [jobs_of(spark, lambda p=planes, k=key: store.write_plane_group(m, p, k, fields)) for key, planes in (("few", [(0, 1)]), ("many", [(0, k) for k in range(8)] + [(2, 5), (1, 0), (1, 0)]))]
    assert counts[0] == counts[1] <= 2
    for j in range(8):
        plane = store.read_part(f"I{j}/b/many/w")
        assert plane.columns == ["j", "k", "w"] and sorted(r["w"] for r in plane.collect()) == [j + 8.0 * q for q in range(42)]
    with pytest.raises(MeshError):
        store.write_plane_group(m, [(0, 8)], "wrong", fields)


def test_fifteen_fields_move_in_one_join(spark):
    m = Mesh(spark)
    b = m.block("b", 2)
    cells = numbered(spark, (6, 5))
    fields = [m.field(b, f"f{k}", (6, 5), below=(-1, 0), above=(1, 0), values=cells.withColumn(f"f{k}", F.col("v") + k)) for k in range(15)]
    m.cut(fields[0])
    signs = [1 if k % 3 else -1 for k in range(15)]
    halo.transfer(m, [h for f, s in zip(fields, signs, strict=True) for h in (Halo(f, f, (1, 5), (0, 0), (-1, 0), (1, 2), (1, 2), s), Halo(f, f, (1, 5), (5, 0), (6, 0), (1, 2), (1, 2)))])
    plan = m.tables[m.key(fields[0])]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1
    for k, f in enumerate(fields):
        rows = {(r["i"], r["j"]): r[f.name] for r in m.table(f).collect()}
        assert len(rows) == 40
        for j in range(5):
            assert rows[-1, j] == signs[k] * rows[0, j] and rows[6, j] == rows[5, j] == 5 + 6 * j + k


def test_later_halos_win_and_signs_are_checked(spark):
    m = Mesh(spark)
    b = m.block("b", 1)
    f = m.field(b, "f", (4,), above=(2,), dim=2, values=spark.range(4).selectExpr("cast(id as int) i", "array(id * 1.0D, id * 10.0D) f"))
    halo.transfer(m, [Halo(f, f, (2,), (0,), (4,), (1,), (1,)), Halo(f, f, (1,), (3,), (5,), (1,), (1,), -2)])
    rows = {r["i"]: r["f"] for r in m.table(f).collect()}
    assert rows[4] == [0.0, 0.0] and rows[5] == [-6.0, -60.0]
    z = m.field(b, "z", (4,), dtype="complexd")
    with pytest.raises(MeshError):
        Halo(z, z, (1,), (0,), (1,), (1,), (1,), -1)


def test_arrays_in_half_precision(spark, tmp_path):
    rows = [(0, [1.1, None, 70000.0]), (1, None), (2, []), (3, [2049.0])]
    df = spark.createDataFrame(rows, "k int, v array<double>").coalesce(1)
    got = {r["k"]: r["h"] for r in df.where("k > -1").select("k", to_half_each(F.col("v")).alias("h")).collect()}
    assert got[1] is None and got[2] == [] and got[3] == [2048.0]
    assert got[0][0] == float(np.float16(1.1)) and got[0][2] == float("inf")
    m = Mesh(spark)
    f = m.field(Block("b", 1), "f", (3,), dim=2, values=spark.range(3).selectExpr("cast(id as int) i", "array(id + 2048.0D, id + 0.1D) f"))
    store = Store(spark, f"file://{tmp_path}/store")
    store.write_slab(m, f, [0, 3], "part", "half")
    assert [r["f"][0] for r in store.read_part("part").orderBy("i").collect()] == [2048.0, 2048.0, 2050.0]
