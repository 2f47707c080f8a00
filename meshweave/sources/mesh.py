"""``format("mesh")``: stored fields as a data source of Spark.

    register(spark)
    spark.read.format("mesh").options(block="plate", field="a", box="3,10,5,6").load(path)
    cells.write.format("mesh").options(block="plate", field="a", size="64,64").mode("overwrite").save(path)

It reads and writes what ``Store`` has. The metadata are checked when a read or write is planned. A file holds
a range of the Morton curve and is one partition. ``box``, the ends of a half-open range along each axis,
restricts a read: files whose range (written down beside the metadata by this source's writer) misses it are left
out at planning, and of the others only row groups near it are read. Files without a note of their range are
opened and pruned by their statistics in the tasks; the driver opens none of them.

The box is an option and not taken from ``where``, as Spark 4.1 keeps what a Python source was told of filters
with the loaded frame: after ``read.where("j < 2")`` the frame ``read`` would have these rows alone. A frame that was
loaded before a write has to be loaded again.

Python reads and writes here, so the path has to be one that Arrow can open (local, HDFS, S3, GCS). ``Store``
goes through Spark's own readers, which is faster and works with any path that Spark has.

A write is complete or leaves what was there: tasks write files under new names, and the commit notes
those of the attempts that counted, then removes all others. It fails unless every cell of the field is
there once, as the number of cells and the sums of their places and of the squares of these tell; so a field
cannot be appended to. Coordinates outside the field fail in their task, as do nulls.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, types
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..plans.catalog import AXES, TYPES, Block, Box, Field, MeshError, box_of, box_size
from ..plans.grid import morton, morton_of, morton_ranges
from .store import KEY, Missing


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(MeshSource)


def along_curve(cells: DataFrame, f: Field, parts: int) -> DataFrame:
    """The cells of a field in ``parts`` ranges of its curve, as a write wants them."""
    return cells.repartitionByRange(parts, morton(f.axes, tuple(f.allocation[a] for a in f.kept)))


class Folder:
    """A store's small texts and files, as Arrow reaches them."""

    def __init__(self, path: str):
        self.at, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        self.root = root.rstrip("/")

    def files(self, name: str) -> list[str]:
        found = self.at.get_file_info(fs.FileSelector(f"{self.root}/{name}", allow_not_found=True))
        return sorted(x.base_name for x in found if x.type == fs.FileType.File and x.base_name[0] not in "_.")

    def get(self, kind: str, name: str) -> Any:
        for file in self.files(f"meta/{kind}/{name}"):
            with self.at.open_input_stream(f"{self.root}/meta/{kind}/{name}/{file}") as f:
                if text := f.read().decode():
                    return json.loads(text)
        raise Missing(f"{self.root} has no {kind} {name}")

    def put(self, kind: str, name: str, value: Any) -> None:
        self.at.create_dir(f"{self.root}/meta/{kind}/{name}", recursive=True)
        old = self.files(f"meta/{kind}/{name}")
        new = f"part-{uuid.uuid4().hex}.txt"
        with self.at.open_output_stream(f"{self.root}/meta/{kind}/{name}/{new}") as f:
            f.write(json.dumps(value).encode())
        for file in old:
            self.at.delete_file(f"{self.root}/meta/{kind}/{name}/{file}")


def _numbers(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in text.split(",")) if text else ()


def meta_of(f: Field) -> dict[str, Any]:
    return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(f).items() if k != "block"} | {"block": f.block.name}


class MeshSource(DataSource):
    """Options: ``block`` and ``field``; to write a field that is not there ``size``, and ``base``, ``below``,
    ``above``, ``dim`` and ``dtype`` where they are not the usual ones; ``per_group``, about how many
    cells a row group holds; ``box`` to read. ``dim`` and ``dtype`` given to a read have to be the stored ones."""

    @classmethod
    def name(cls) -> str:
        return "mesh"

    def _stored(self) -> tuple[Folder, Field]:
        for name in ("path", "block", "field"):
            if not self.options.get(name):
                raise MeshError(f"the option {name} is needed")
        folder = Folder(self.options["path"])
        meta = folder.get("field", f"{self.options['block']}.{self.options['field']}")
        block = Block(**folder.get("block", self.options["block"]))
        f = Field(block, meta["name"], *(tuple(meta[k]) for k in ("size", "base", "below", "above")), meta["dim"], meta["dtype"], tuple(meta["stride"]))
        for name, have in (("dim", str(f.dim)), ("dtype", f.dtype)):
            if self.options.get(name, have) != have:
                raise MeshError(f"{f.name} in {folder.root} has {name} {have}, not {self.options[name]}")
        return folder, f

    def schema(self) -> types.StructType:
        f = self._stored()[1]
        return schema_of(f)

    def reader(self, schema: types.StructType) -> MeshReader:
        folder, f = self._stored()
        if schema != schema_of(f):
            raise MeshError(f"{f.name} has the columns {schema_of(f).simpleString()}, not {schema.simpleString()}")
        given = _numbers(self.options.get("box", "")) or tuple(x for bounds in f.allocation for x in bounds)
        if len(given) != 2 * f.block.dims:
            raise MeshError(f"box has {len(given)} numbers, not {2 * f.block.dims}")
        return MeshReader(self.options["path"], f, box_of(given))

    def writer(self, schema: types.StructType, overwrite: bool) -> MeshWriter:
        try:
            folder, f = self._stored()
        except Missing:
            o = self.options
            size = _numbers(o.get("size", ""))
            if not size:
                raise MeshError("the option size is needed to write a new field") from None
            f = Field(Block(o["block"], len(size)), o["field"], size, *(_numbers(o.get(k, "")) for k in ("base", "below", "above")), int(o.get("dim", 1)), o.get("dtype", "double"))
            folder = Folder(o["path"])
        else:
            if not overwrite:
                raise MeshError(f"{f.name} is in {folder.root} already; mode overwrite replaces it")
            for name in ("size", "base", "below", "above"):
                if name in self.options and _numbers(self.options[name]) != getattr(f, name):
                    raise MeshError(f"{f.name} in {folder.root} has other metadata: {name} is {getattr(f, name)}")
        try:
            if folder.get("block", f.block.name) != asdict(f.block):
                raise MeshError(f"block {f.block.name} in {folder.root} has other dimensions")
        except Missing:
            pass
        if not f.kept:
            raise MeshError(f"{f.name} has no axes to store cells by")
        want, got = ({x.name: x.dataType.simpleString() for x in s} for s in (schema_of(f), schema))
        if want != got:
            raise MeshError(f"{f.name} has the columns {schema_of(f).simpleString()}, not {schema.simpleString()}")
        return MeshWriter(self.options["path"], f, schema.names, int(self.options.get("per_group", 500_000)))


def _value_type(kind: str) -> types.DataType:
    """Spark's type of a component; planning has no session that could read it from text."""
    if kind.startswith("struct"):
        part = types.FloatType() if "float" in kind else types.DoubleType()
        return types.StructType([types.StructField("re", part), types.StructField("im", part)])
    simple = (types.DoubleType, types.FloatType, types.IntegerType, types.ShortType, types.ByteType, types.LongType, types.BooleanType)
    return next((t() for t in simple if t().simpleString() == kind), types.DecimalType(20, 0))


def schema_of(f: Field) -> types.StructType:
    value = _value_type(TYPES[f.dtype])
    columns = [*((x, types.IntegerType()) for x in f.axes), (f.name, types.ArrayType(value) if f.dim > 1 else value)]
    return types.StructType([types.StructField(*x) for x in columns])


@dataclass
class Part(InputPartition):
    file: str
    ranges: list[tuple[int, int]]

    def __post_init__(self) -> None:
        super().__init__(self.file)


class MeshReader(DataSourceReader):
    def __init__(self, path: str, f: Field, box: Box):
        self.path, self.f = path, f
        self.whole: Box = tuple(f.allocation[a] for a in f.kept)
        self.box: Box = tuple((max(low, box[a][0]), min(high, box[a][1])) for a, (low, high) in zip(f.kept, self.whole, strict=True))

    def partitions(self) -> list[Part]:
        """The files that can have cells of the box, by their noted ranges of the curve."""
        if any(high <= low for low, high in self.box):
            return []
        folder, name = Folder(self.path), f"{self.f.block.name}.{self.f.name}"
        ranges = morton_ranges(self.whole, self.box) if self.whole else []
        try:
            noted = folder.get("files", name)
        except Missing:
            noted = {}
        files = folder.files(f"{self.f.block.name}/{self.f.name}/data")
        if noted and set(noted) <= set(files):
            files = [x for x in noted if any(noted[x][0] <= high and low <= noted[x][1] for low, high in ranges)]
        return [Part(x, ranges) for x in files]

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # a plan without partitions still asks once
            return
        folder = Folder(self.path)
        tests = [(ds.field(x) >= low) & (ds.field(x) < high) for x, (low, high) in zip(self.f.axes, self.box, strict=True)]
        if part.ranges:
            tests.append(reduce(or_, ((ds.field(KEY) >= low) & (ds.field(KEY) <= high) for low, high in part.ranges)))
        data = ds.dataset(f"{folder.root}/{self.f.block.name}/{self.f.name}/data/{part.file}", filesystem=folder.at, format="parquet")
        yield from data.to_batches(columns=[*self.f.axes, self.f.name], filter=reduce(and_, tests) if tests else None)


@dataclass
class Written(WriterCommitMessage):
    files: dict[str, tuple[int, int]]
    sums: tuple[int, int, int]  # of the cells' places to the powers 0, 1 and 2, modulo 2^64


def _sums(at: list[np.ndarray], box: Box) -> tuple[int, int, int]:
    place, step = np.zeros(len(at[0]), np.uint64), 1
    for x, (low, high) in zip(at, box, strict=True):
        place += (x.astype(np.int64) - low).astype(np.uint64) * np.uint64(step)
        step *= high - low
    return len(place), int(place.sum(dtype=np.uint64)), int((place * place).sum(dtype=np.uint64))


class MeshWriter(DataSourceArrowWriter):
    """A task sorts what it gets along the curve, ``PER_FILE`` cells at a time; frames that were dealt by
    ``along_curve`` have files that do not overlap."""

    PER_FILE = 2_000_000

    def __init__(self, path: str, f: Field, names: list[str], per_group: int):
        self.path, self.f, self.names, self.per_group = path, f, names, per_group
        self.data = f"{f.block.name}/{f.name}/data"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder, files, held, rows, sums = Folder(self.path), {}, [], 0, []
        folder.at.create_dir(f"{folder.root}/{self.data}", recursive=True)
        for batch in iterator:
            held.append(batch)
            rows += batch.num_rows
            if rows >= self.PER_FILE:
                sums.append(self._file(folder, held, files))
                rows, held = 0, []
        if rows:
            sums.append(self._file(folder, held, files))
        return Written(files, tuple(map(sum, zip(*sums, strict=True))) or (0, 0, 0))

    def _file(self, folder: Folder, held: list[pa.RecordBatch], files: dict[str, tuple[int, int]]) -> tuple[int, int, int]:
        box = tuple(self.f.allocation[a] for a in self.f.kept)
        table = pa.Table.from_batches(held).rename_columns(self.names).select([*self.f.axes, self.f.name])
        if any(table[x].null_count for x in table.column_names):
            raise MeshError(f"{self.f.name}: coordinates and values cannot be null")
        at = [table[x].to_numpy() for x in self.f.axes]
        if any(((x < low) | (x >= high)).any() for x, (low, high) in zip(at, box, strict=True)):
            raise MeshError(f"{self.f.name} has cells in {box} only")
        key = morton_of(at, box)
        order = np.argsort(key, kind="stable")
        table = table.take(pa.array(order)).append_column(KEY, pa.array(key[order]))
        name = f"part-{uuid.uuid4().hex}.parquet"
        pq.write_table(table, f"{folder.root}/{self.data}/{name}", filesystem=folder.at, row_group_size=self.per_group)
        files[name] = int(key[order[0]]), int(key[order[-1]])
        return _sums(at, box)

    def commit(self, messages: list[Written | None]) -> None:
        n = box_size(tuple(self.f.allocation[a] for a in self.f.kept))
        given = [sum(m.sums[k] for m in messages if m) for k in range(3)]
        if [x % 2**64 for x in given] != [x % 2**64 for x in (n, n * (n - 1) // 2, n * (n - 1) * (2 * n - 1) // 6)]:
            raise MeshError(f"{self.f.name} has {n} cells; {given[0]} were given, or some twice and others not")
        files = {x: r for m in messages if m for x, r in m.files.items()}
        folder, name = Folder(self.path), f"{self.f.block.name}.{self.f.name}"
        folder.put("block", self.f.block.name, asdict(self.f.block))
        folder.put("field", name, meta_of(self.f))
        folder.put("files", name, files)
        for x in folder.files(self.data):
            if x not in files:
                folder.at.delete_file(f"{folder.root}/{self.data}/{x}")

    def abort(self, messages: list[Written | None]) -> None:
        """Removes the files of tasks that ended; those of broken attempts go with the next write."""
        folder = Folder(self.path)
        for x in (x for m in messages if m for x in m.files):
            folder.at.delete_file(f"{folder.root}/{self.data}/{x}")
