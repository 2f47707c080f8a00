"""A mesh on disk: one Parquet dataset for each field, with its metadata beside it.

``{path}/{block}/{field}/data`` holds coordinates and values, ``{path}/meta`` one JSON document for
each block, field, stencil, halo and constant. Everything is read and written by Spark, so any store
that Spark can reach will do. Reads check the metadata first.

Cells are stored along a Morton curve, in files and row groups by ranges of it: a box is cut into ranges of
keys, which are pushed down, so reading a slab reads few row groups besides those that it is in.
"""

from __future__ import annotations

import json
from dataclasses import asdict
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import slabs
from ..operators.loop import Mesh
from ..plans.catalog import AXES, Block, Field, Halo, MeshError, Stencil, box_of, box_size
from ..plans.grid import inside, morton, morton_ranges

#: The column with a cell's place on the curve.
KEY = "__key"
PRECISIONS = {"double": "double", "single": "float", "half": "float"}


class Missing(MeshError):
    """Nothing is stored under a name."""


def read_text(spark: SparkSession, path: str) -> list[str]:
    """The lines of a small text; none if there is no such path. Any other failure is raised."""
    try:
        return [r["value"] for r in spark.read.text(path).collect()]
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


class Store:
    """``per_file`` and ``per_group``: about how many cells a file and a row group of it hold."""

    def __init__(self, spark: SparkSession, path: str, per_file: int = 16_000_000, per_group: int = 500_000):
        self.spark, self.path = spark, path.rstrip("/")
        self.per_file, self.per_group = per_file, per_group

    # metadata

    def _put(self, kind: str, name: str, value: Any) -> None:
        row = self.spark.createDataFrame([(json.dumps(value),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(f"{self.path}/meta/{kind}/{name}")

    def _get(self, kind: str, name: str) -> Any:
        rows = read_text(self.spark, f"{self.path}/meta/{kind}/{name}")
        if not rows:
            raise Missing(f"{self.path} has no {kind} {name}")
        return json.loads(rows[0])

    def write_block(self, block: Block) -> None:
        self._put("block", block.name, asdict(block))

    def read_block(self, name: str, dims: int | None = None) -> Block:
        block = Block(**self._get("block", name))
        if dims not in (None, block.dims):
            raise MeshError(f"block {name} has {block.dims} dimensions, not {dims}")
        return block

    def write_stencil(self, stencil: Stencil) -> None:
        self._put("stencil", stencil.name, asdict(stencil))

    def read_stencil(self, name: str) -> Stencil:
        found = self._get("stencil", name)
        return Stencil(found["name"], tuple(map(tuple, found["points"])), found["kind"], tuple(found["ratio"]), tuple(found["stride"]))

    def write_halo(self, halo: Halo) -> None:
        value = {k: list(getattr(halo, k)) for k in ("shape", "from_base", "to_base", "from_dir", "to_dir")} | {"sign": halo.sign}
        self._put("halo", f"{halo.source.block.name}.{halo.source.name}.{halo.target.block.name}.{halo.target.name}", value)

    def read_halo(self, source: Field, target: Field) -> Halo:
        found = self._get("halo", f"{source.block.name}.{source.name}.{target.block.name}.{target.name}")
        return Halo(source, target, *(tuple(found[k]) for k in ("shape", "from_base", "to_base", "from_dir", "to_dir")), found.get("sign", 1))

    def write_constant(self, name: str, value: Any) -> None:
        self._put("const", name, value)

    def read_constant(self, name: str) -> Any:
        return self._get("const", name)

    # fields

    def write_field(self, mesh: Mesh, f: Field) -> None:
        """The whole allocation. A field that is there already must have the same metadata."""
        try:
            old = self._get("field", f"{f.block.name}.{f.name}")
        except Missing:
            old = None
        meta = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(f).items() if k != "block"} | {"block": f.block.name}
        if old is not None and old != meta:
            raise MeshError(f"{f.name} in {self.path} has other metadata")
        self.write_block(f.block)
        self._put("field", f"{f.block.name}.{f.name}", meta)
        box = tuple(f.allocation[a] for a in f.kept)
        cells = mesh.table(f)
        if box:
            cells = cells.withColumn(KEY, morton(f.axes, box))
            files = -(-box_size(box) // self.per_file)
            cells = (cells.repartitionByRange(files, KEY) if files > 1 else cells.coalesce(1)).sortWithinPartitions(KEY)
        # A row group is closed by its bytes; a cell has its coordinates, its key and its values.
        width = 8 + 4 * len(box) + 8 * f.dim
        cells.write.mode("overwrite").option("parquet.block.size", self.per_group * width).parquet(self._data(f.block.name, f.name))

    def _data(self, block: str, name: str) -> str:
        return f"{self.path}/{block}/{name}/data"

    def _field(self, block: Block, name: str) -> Field:
        meta = self._get("field", f"{block.name}.{name}")
        return Field(block, name, *(tuple(meta[k]) for k in ("size", "base", "below", "above")), meta["dim"], meta["dtype"], tuple(meta["stride"]))

    def read_slab(self, block: Block, name: str, box: list[int], most: int = 64) -> DataFrame:
        """The stored cells of a box, halo cells too: of the files only row groups near them are read."""
        f, bounds = self._field(block, name), box_of(box)
        data = self.spark.read.parquet(self._data(block.name, name))
        whole, part = tuple(f.allocation[a] for a in f.kept), tuple(bounds[a] for a in f.kept)
        near = F.lit(not whole)
        for low, high in morton_ranges(whole, part, most) if whole else []:
            near = near | F.col(KEY).between(low, high)
        return data.where(near).where(inside(part, f.axes)).select(*f.axes, f"`{f.name}`")

    def read_field(self, mesh: Mesh, block: Block, name: str, dim: int = 1, dtype: str = "double") -> Field:
        """Declares a field as it was written; its ``dim`` and type must be as asked."""
        f = self._field(block, name)
        if (f.dim, f.dtype) != (dim, dtype):
            raise MeshError(f"{name} in {self.path} is {f.dim} x {f.dtype}, not {dim} x {dtype}")
        return mesh.declare(f, self.spark.read.parquet(self._data(block.name, name)))

    def dump(self, mesh: Mesh, stencils: list[Stencil] = (), halos: list[Halo] = ()) -> None:
        """All blocks, all fields without collapsed axes, and the stencils and halos given."""
        for f in mesh.fields.values():
            if not f.degenerate:
                self.write_field(mesh, f)
        for b in mesh.blocks.values():
            self.write_block(b)
        for s in stencils:
            self.write_stencil(s)
        for h in halos:
            self.write_halo(h)

    # parts

    def _precise(self, df: DataFrame, f: Field, precision: str | None) -> DataFrame:
        if precision is None or not f.floating:
            return df
        kind = PRECISIONS[precision]
        value = F.col(f.name)
        if precision == "half":
            from ..functions.scalar import to_half, to_half_each

            value = to_half_each(value) if f.dim > 1 else to_half(value)
        return df.withColumn(f.name, value.cast(f"array<{kind}>" if f.dim > 1 else kind))

    def write_slab(self, mesh: Mesh, f: Field, box: list[int], name: str, precision: str | None = None) -> None:
        self._precise(slabs.slab(mesh, f, box), f, precision).write.mode("overwrite").parquet(f"{self.path}/{name}")

    def write_plane(self, mesh: Mesh, f: Field, axis: int, at: int, name: str, precision: str | None = None) -> None:
        self._precise(slabs.plane(mesh, f, axis, at), f, precision).write.mode("overwrite").parquet(f"{self.path}/{name}")

    def write_plane_group(self, mesh: Mesh, planes: list[tuple[int, int]], key: str, fields: list[Field], precision: str | None = None) -> list[str]:
        """Every plane of every field; the names under which ``read_part`` has them are
        ``{axis letter}{position}/{block}/{key}/{field}``. Fields of equal cells are written together, in one
        pass over their table: a cell goes to each plane that has it, and a plane is a partition."""
        groups: dict[tuple, list[Field]] = {}
        for f in fields:
            for axis, at in planes:
                slabs.plane(mesh, f, axis, at)  # checks that there is one
            groups.setdefault((*mesh.key(f), f.interior), []).append(f)
        told: dict[str, dict[str, str]] = {}
        for n, own in enumerate(groups.values()):
            f = own[0]
            places = {axis: sorted({at for a, at in planes if a == axis}) for axis, _ in planes}
            has = F.filter(F.array(*(F.when(F.col(AXES[a]).isin(at), F.concat(F.lit("IJKLM"[a]), F.col(AXES[a]).cast("string"))) for a, at in places.items())), lambda x: x.isNotNull())
            cells = mesh.tables[mesh.key(f)].where(inside(tuple(f.interior[a] for a in f.kept), f.axes)).withColumn("plane", F.explode(has))
            for x in own:
                cells = self._precise(cells, x, precision)
            data = f"{self.path}/planes/{f.block.name}/{key}/{n}"
            cells.select("plane", *f.axes, *(f"`{x.name}`" for x in own)).write.mode("overwrite").partitionBy("plane").parquet(data)
            told.setdefault(f.block.name, {}).update({x.name: str(n) for x in own})
        for block, names in told.items():
            self._put("planes", f"{block}.{key}", names)
        return [f"{'IJKLM'[axis]}{at}/{f.block.name}/{key}/{f.name}" for axis, at in planes for f in fields]

    def read_part(self, name: str) -> DataFrame:
        """A slab or a plane by its name."""
        parts = name.split("/")
        if len(parts) == 4:
            plane, block, key, field = parts
            try:
                n = self._get("planes", f"{block}.{key}").get(field)
            except Missing:
                n = None
            if n is not None:
                data = self.spark.read.parquet(f"{self.path}/planes/{block}/{key}/{n}")
                axis = AXES["IJKLM".index(plane[0])]
                return data.where(F.col("plane") == plane).select(*(x for x in data.columns if x in AXES and x != axis), f"`{field}`")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def write_text(self, mesh: Mesh, f: Field, name: str, parts: int) -> None:
        """A header and all cells as text in ``parts`` files at most, which in the order of their names are the
        dump: lines are ranged by their place, and no task has all of them."""
        head = F.lit(f"{f.name} block={f.block.name} size={list(f.size)} dim={f.dim} type={f.dtype}")
        place, step = F.lit(1).cast("long"), 1
        for a in f.kept[1:]:
            low, high = f.allocation[a]
            place, step = place + (F.col(AXES[a]) - low) * step, step * (high - low)
        lines = slabs.lines(mesh, f).select(place.alias("place"), "line")
        every = self.spark.range(1).select(F.lit(0).cast("long").alias("place"), head.alias("line")).union(lines)
        every.repartitionByRange(parts, "place").sortWithinPartitions("place").select("line").write.mode("overwrite").text(f"{self.path}/{name}")

    def read_text(self, name: str) -> DataFrame:
        """``n`` (from 0) and ``line`` of a dump: the files by name, each from its begin."""
        read = self.spark.read.text(f"{self.path}/{name}").select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"))
        before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each file
        files = read.groupBy("file").count().select("file", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
        within = F.row_number().over(Window.partitionBy("file").orderBy("at"))
        return read.withColumn("k", within).join(files, "file").select((F.col("before") + F.col("k") - 1).alias("n"), "line")

    def append_text(self, mesh: Mesh, f: Field, name: str) -> None:
        """Appends a header and all cells as text, in one part file in order."""
        head = F.lit(f"{f.name} block={f.block.name} size={list(f.size)} dim={f.dim} type={f.dtype}")
        lines = slabs.text_lines(mesh, f)
        rest = [x for x in lines.columns if x != "line"]
        cells = lines.select(F.lit(1).alias("__at"), *rest, "line")
        first = self.spark.range(1).select(F.lit(0).alias("__at"), *(F.lit(None).cast("int").alias(x) for x in rest), head.alias("line"))
        ordered = first.unionByName(cells).orderBy("__at", *reversed(rest))
        ordered.select("line").coalesce(1).write.mode("append").text(f"{self.path}/{name}")
