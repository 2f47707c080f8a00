"""Streams of the twister against a plain one."""

import numpy as np
import pytest

from meshweave.functions import twister
from meshweave.operators import slabs
from meshweave.operators.loop import Mesh
from meshweave.plans.catalog import MeshError


def test_the_plain_stream():
    stream = twister.Stream(5489)
    assert stream.words(10_000)[-1] == 4123659995  # the language standard names this number
    state, plain = twister.seeded(77), np.random.RandomState(77)
    plain.bytes(4 * 624)
    assert (twister.raw_words(state, 1248)[624:] == plain.get_state()[1]).all()


def test_entering_at_any_place():
    assert twister.characteristic().bit_length() - 1 == twister.BITS
    whole = twister.Stream(42).words(60_000)
    for place in (0, 1, 2, 226, 227, 623, 624, 625, 19936, 19937, 19938, 40_001, 59_000):
        assert (twister.Stream(42, place).words(500) == whole[place : place + 500]).all()
    # far away: two jumps and one meet
    far = 1 << 44
    there = twister.state_at(42, far, twister.characteristic())
    onward = np.random.MT19937()
    onward.state = {"bit_generator": "MT19937", "state": {"key": there, "pos": 624}}
    onward.random_raw(12_345)
    assert (onward.random_raw(300) == twister.Stream(42, far + 12_345).words(300)).all()


def plain_values(seed, count, kind):
    words = twister.Stream(seed).words(2 * count).tolist()
    if kind == "double":
        return [(float(a) + float(b) * 4294967296.0) / 18446744073709551616.0 for a, b in zip(words[::2], words[1::2], strict=True)]
    return [float(np.float32(w) / np.float32(4294967296)) for w in words[:count]] if kind == "float" else [w >> 1 for w in words[:count]]


@pytest.mark.parametrize(("kind", "dim"), [("double", 1), ("float", 2), ("int", 3)])
def test_fill_is_one_stream_whatever_the_tasks(spark, kind, dim):
    m = Mesh(spark)
    b = m.block("b", 2)
    got = []
    for chunk in (97, 4_000_000):
        f = m.field(b, f"f{chunk}", (40, 11), base=(3, 0), below=(-2, 0), above=(1, 1), dim=dim, dtype=kind)
        slabs.fill_twister(m, f, seed=12, chunk=chunk)
        rows = m.table(f).orderBy("j", "i").collect()
        got.append([x for r in rows for x in (r[f.name] if dim > 1 else [r[f.name]])])
    assert len(got[0]) == 43 * 12 * dim and got[0] == got[1] == plain_values(12, 43 * 12 * dim, kind)


def test_the_first_hundred_thousand(spark):
    m = Mesh(spark)
    f = m.field(m.block("b", 2), "u", (400, 250))
    slabs.fill_twister(m, f, seed=1, chunk=30_000)
    assert [r["u"] for r in m.table(f).orderBy("j", "i").collect()] == plain_values(1, 100_000, "double")


def test_other_types_are_refused(spark):
    m = Mesh(spark)
    with pytest.raises(MeshError):
        slabs.fill_twister(m, m.field(m.block("b", 1), "c", (4,), dtype="complexd"), seed=1)


def test_a_large_field_is_not_sent_to_the_driver(spark):
    """A few rows, one for each task, become the cells: Spark takes these for few and broadcast them."""
    m = Mesh(spark)
    f = m.field(m.block("b", 2), "u", (1000, 300))
    slabs.fill_twister(m, f, seed=1, chunk=100_000)
    plan = m.table(f)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
