"""The mesh as a data source: what it plans, reads, writes and refuses."""

import uuid

import pytest
from pyspark.sql import functions as F

from meshweave.operators.loop import Mesh
from meshweave.plans.catalog import Block, Field
from meshweave.sources.mesh import Folder, MeshReader, along_curve, register
from meshweave.sources.shared import new_path
from meshweave.sources.store import Store

BLOCK = Block("b", 2)
FIELD = Field(BLOCK, "v", (64, 40), base=(2, 0), below=(-1, 0), above=(0, 3))
NAMED = {"block": "b", "field": "v"}
SIZED = NAMED | {"size": "64,40", "base": "2,0", "below": "-1,0", "above": "0,3"}


def cells(spark):
    return spark.range(65 * 43).selectExpr("cast(id % 65 + 1 as int) i", "cast(id div 65 as int) j", "cast(id as double) v")


def put(df, path, options=SIZED, mode="overwrite"):
    df.write.format("mesh").options(**options).mode(mode).save(path)


def rows(df):
    return sorted(map(tuple, df.select("i", "j", "v").collect()))


@pytest.fixture(scope="module")
def stored(spark):
    register(spark)
    path = new_path(spark, "mesh")
    put(along_curve(cells(spark), FIELD, 16), path, SIZED | {"per_group": "50"})
    return path


def test_round_trip_and_filters(spark, stored):
    read = spark.read.format("mesh").options(**NAMED).load(stored)
    assert read.schema.simpleString() == "struct<i:int,j:int,v:double>"
    assert rows(read) == rows(cells(spark))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for test in ("i = 7", "i BETWEEN 3 AND 9 AND j > 38", "j IN (4, 9, 41) AND i <= 5", "v > 100 AND j < 2", "i = 5 OR j = 3", "i > 900"):
            assert rows(read.where(test)) == rows(cells(spark).where(test)), test
        assert rows(read) == rows(cells(spark))  # no filter of another query is left behind
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize(("box", "test"), [("3,10,5,6", "i BETWEEN 3 AND 9 AND j = 5"), ("-9,4,40,99", "i < 4 AND j >= 40"), ("900,999,0,5", "false"), ("7,7,0,5", "false")])
def test_boxes(spark, stored, box, test):
    assert rows(spark.read.format("mesh").options(**NAMED, box=box).load(stored)) == rows(cells(spark).where(test))


def test_files_outside_the_box_are_no_partitions(stored):
    files = lambda *box: len(MeshReader(stored, FIELD, box).partitions())
    assert files((0, 99), (-9, 99)) == 16
    assert files((2, 6), (3, 4)) <= 2 and files((0, 99), (0, 6)) < 16 and files((400, 500), (0, 9)) == 0


def test_store_and_source_read_each_other(spark, stored):
    store, m = Store(spark, stored), Mesh(spark)
    assert rows(store.read_slab(BLOCK, "v", [5, 9, 2, 4])) == rows(cells(spark).where("i BETWEEN 5 AND 8 AND j IN (2, 3)"))
    assert rows(m.table(store.read_field(m, BLOCK, "v"))) == rows(cells(spark))
    other = Mesh(spark)
    b = other.block("c", 2)
    pair = other.field(b, "pair", (9, 5), dim=2, dtype="float", values=spark.range(45).selectExpr("cast(id % 9 as int) i", "cast(id div 9 as int) j", "array(cast(id as float), 0.5f) pair"))
    path = new_path(spark, "mesh")
    Store(spark, path).write_field(other, pair)
    load = lambda: spark.read.format("mesh").options(block="c", field="pair", dim="2", dtype="float").load(path)
    read = load()
    key = lambda df: sorted((r["i"], r["j"], tuple(r["pair"])) for r in df.collect())
    assert key(read.where("j = 3")) == key(other.table(pair).where("j = 3"))
    put(read.withColumn("pair", F.transform("pair", lambda x: (x * 2).cast("float"))), path, {"block": "c", "field": "pair"})
    assert key(Store(spark, path).read_slab(b, "pair", [0, 9, 0, 5])) == [(i, j, (a * 2, 1.0)) for i, j, (a, _) in key(other.table(pair))]
    Store(spark, path).write_field(other, pair)  # the ranges noted for the files before are of no use now
    assert key(load()) == key(other.table(pair))


def test_writes_are_whole_or_nothing(spark, stored):
    before, folder = rows(spark.read.format("mesh").options(**NAMED).load(stored)), Folder(stored)
    files = folder.files("b/v/data")
    one = cells(spark).where("i = 3 AND j = 3")
    wrong = [
        cells(spark).where("i < 60"),
        cells(spark).union(one),
        cells(spark).where("NOT (i = 4 AND j = 4)").union(one),
        cells(spark).withColumn("i", F.col("i") + 1),
        cells(spark).withColumn("v", F.when(F.col("v") != 9, F.col("v"))),
        cells(spark).limit(0),
    ]
    for df in wrong:
        with pytest.raises(Exception, match="v has|cannot be null"):
            put(df.repartition(3), stored)
    assert set(files) <= set(folder.files("b/v/data")) and rows(spark.read.format("mesh").options(**NAMED).load(stored)) == before
    with folder.at.open_output_stream(f"{folder.root}/b/v/data/part-{uuid.uuid4().hex}.parquet") as f:
        f.write(b"of an attempt that was lost")
    assert rows(spark.read.format("mesh").options(**NAMED).load(stored)) == before
    put(along_curve(cells(spark), FIELD, 16), stored, NAMED | {"per_group": "50"})
    assert len(folder.files("b/v/data")) == 16 and rows(spark.read.format("mesh").options(**NAMED).load(stored)) == before


@pytest.mark.parametrize(
    ("options", "message"),
    [({"field": "v"}, "option block"), (NAMED | {"field": "w"}, "has no field"), (NAMED | {"dim": "2"}, "has dim 1"), (NAMED | {"dtype": "int"}, "has dtype double"), (NAMED | {"box": "1,2"}, "not 4")],
)
def test_reads_check_the_metadata(spark, stored, options, message):
    with pytest.raises(Exception, match=message):
        spark.read.format("mesh").options(**options).load(stored).count()


def test_writes_check_the_metadata(spark, stored):
    new = new_path(spark, "mesh")
    for df, path, options, mode, message in [
        (cells(spark), stored, NAMED | {"size": "65,40"}, "overwrite", "other metadata"),
        (cells(spark), stored, NAMED, "append", "already"),
        (cells(spark), new, NAMED, "append", "option size"),
        (cells(spark), new, SIZED | {"dtype": "int"}, "append", "has the columns"),
        (cells(spark).withColumn("more", F.lit(1)), new, SIZED, "append", "has the columns"),
        (cells(spark), stored, SIZED | {"field": "x", "size": "64"}, "append", "each of 1 axes|other dimensions"),
    ]:
        with pytest.raises(Exception, match=message):
            put(df, path, options, mode)
