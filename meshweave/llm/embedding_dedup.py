"""Near-duplicate embeddings by randomised-rotation binary codes.

Each vector is rotated at random and kept as the signs of its coordinates, with one correction
factor: the inner product f of the unit vector with its own code. For a query q the quotient of
<code, q> and f is an unbiased estimate of the cosine, and with high probability it is within

    eps * sqrt((1 - f^2) / f^2) / sqrt(dim - 1)

of it. The bound that the query uses is sure, though: with g = <code, q>, as code and vector are at the
angle arccos f and code and query at arccos g,

    f g - sqrt((1 - f^2) (1 - g^2)) <= cosine <= f g + sqrt((1 - f^2) (1 - g^2))

A pair whose upper confidence bound reaches the threshold is recomputed in double precision; all others
are dismissed on their codes alone. Without ``eps`` no link is lost; with it, the first bound is used
too, and a link is lost where the estimate is off by more than ``eps`` deviations.

Which pairs meet: equal vectors of a label are one class first (it counts as often as it occurs).
The classes of a label of at least ``2 * cell`` are dealt to the cells of spherical k-means centres of
their own, fitted on a bounded sample; every vector is assigned. A smaller label is one cell. A link of
angle t can only lead from a vector v to a cell c if the angle of v and c is at most t plus the radius of
c, and at most 2 t plus the angle of v and its own centre. As the partner is nearer to c than to v's own
centre, the plane halfway between the two is within t of v:

    cos(v, c) >= cos(v, own) - sin(t) * |c - own|

v visits the cells that pass all three; they hold for every partner, so nothing is lost to the index. A
cell is cut into blocks, and the visitors of a cell into chunks; a task holds one block and streams one
chunk. Counts of links are summed, and each task gives links enough for the components, never all pairs.
Where vectors have no structure the bounds exclude little, and the work within a label is quadratic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from .common import materialise
from .graph import components


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@dataclass
class Codes:
    """Sign bits (packed) and correction factors of unit vectors."""

    bits: np.ndarray
    factor: np.ndarray
    dim: int

    @classmethod
    def of(cls, x: np.ndarray, turn: np.ndarray) -> Codes:
        y = x @ turn
        return cls(np.packbits(y > 0, axis=1), np.abs(y).sum(1) / np.sqrt(x.shape[1]), x.shape[1])

    def signs(self) -> np.ndarray:
        return (np.unpackbits(self.bits, axis=1, count=self.dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(self.dim))

    def estimate(self, turned: np.ndarray) -> np.ndarray:
        """Unbiased cosines of the coded vectors (rows) with rotated unit queries (columns)."""
        return (self.signs() @ turned.T.astype(np.float32)) / self.factor[:, None].astype(np.float32)

    def upper(self, turned: np.ndarray, eps: float | None) -> np.ndarray:
        """Upper bounds of the cosines; single precision is allowed for."""
        g = np.clip(self.signs() @ turned.T.astype(np.float32), -1, 1)
        f = self.factor[:, None].astype(np.float32)
        sure = f * g + np.sqrt(np.maximum(1 - f * f, 0)) * np.sqrt(1 - g * g)
        if eps is not None:
            sure = np.minimum(sure, g / f + self.error(eps)[:, None].astype(np.float32))
        return sure + np.float32(1e-3)

    def error(self, eps: float) -> np.ndarray:
        return eps * np.sqrt(np.maximum(1 - self.factor**2, 0)) / self.factor / np.sqrt(max(self.dim - 1, 1))


def links_between(a: np.ndarray, codes: Codes, b: np.ndarray, turn: np.ndarray, cosine: float, eps: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` whose exact cosine reaches the threshold."""
    i, j = np.nonzero(codes.upper(b @ turn, eps) >= cosine)
    out_i, out_j = [], []
    for k in range(0, i.size, 1 << 16):
        p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        good = np.einsum("ij,ij->i", a[p], b[q]) >= cosine
        out_i.append(p[good])
        out_j.append(q[good])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (i, j)


def fit_centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(11)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        home = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _usable() -> Column:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & some, F.lit(False))


def near_duplicates(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, eps: float | None = None,
    cell: int = 4096, most_centres: int = 4096, sample: int = 20_000, block: int = 2048,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    label or id, link with nothing. Vectors of single precision are kept so, others in double; cosines are
    computed in double. Vectors of different length are never compared. Rows with equal
    vectors of a label link to each other, repeated ids too. Where rows repeat an id
    with other vectors, a row has the links and the component of its own vector, which is named after the
    smallest id that has it; vectors named alike are forms of one, not compared, and each has the links of all.
    """
    given = embeddings.schema[vector_col].dataType
    kind = given.elementType if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else DoubleType()
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(ArrayType(kind)).alias("embedding"), F.col(label_col).cast("string").alias("label"))
    good = rows.where(_usable()).withColumns({"f1": F.xxhash64("label", "embedding"), "f2": F.xxhash64(F.lit(1), "embedding", "label")})
    classes = materialise(good.groupBy("f1", "f2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w")), "classes")
    first = good.join(classes, ["f1", "f2"]).where("vec_id = rep").dropDuplicates(["f1", "f2"]).select("rep", "w", "label", "embedding", F.size("embedding").alias("dim"))
    first = materialise(first, "vectors")
    found = None
    for dim in [r["dim"] for r in first.select("dim").distinct().collect()]:
        part = _found(first.where(F.col("dim") == dim), dim, cosine, eps, cell, most_centres, sample, block)
        found = part if found is None else found.union(part)
    out = rows.withColumns({"f1": F.xxhash64("label", "embedding"), "f2": F.xxhash64(F.lit(1), "embedding", "label")})
    if found is None:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialise(found, "links")
    counts = found.where("v IS NULL").groupBy("rep").agg(F.sum("n").alias("n"))
    edges = components(found.where("v IS NOT NULL").select(F.col("rep").alias("u"), "v"), "near").withColumnRenamed("node", "rep")
    named = classes.join(counts, "rep", "left").join(edges, "rep", "left").select("f1", "f2", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    valid = out.where(_usable()).join(named, ["f1", "f2"]).select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("c").alias("component_id"), (F.col("vec_id") == F.col("c")).alias("kept"))
    bad = out.where(~_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return valid.union(bad)


def _found(first: DataFrame, dim: int, cosine: float, eps: float | None, cell: int, most_centres: int, sample: int, block: int) -> DataFrame:
    """Rows (``rep``, ``n``, null): sums of links; and (``u``, 0, ``v``): links for components."""
    spark = first.sparkSession
    vector = first.schema["embedding"].dataType.simpleString()
    large = first.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= 2 * cell).orderBy(F.desc("n"), "label").limit(most_centres // 2).collect()
    shared = min(1.0, most_centres / max(1, sum(r["n"] // cell for r in large)))
    wanted = {r["label"]: max(2, int(r["n"] // cell * shared)) for r in large}  # in all about most_centres
    fitted: dict[str, np.ndarray] = {}
    if wanted:
        got = first.where(F.col("label").isin(sorted(wanted))).orderBy(F.xxhash64("rep"), "rep").limit(sample).select("label", "embedding").toArrow()  # bounded by sample
        x, label = unit(_vectors(got["embedding"].combine_chunks(), dim)), np.asarray(got["label"].to_pylist(), object)
        fitted = {k: fit_centres(x[label == k], n) for k, n in wanted.items() if (label == k).any()}
    centres = spark.sparkContext.broadcast(fitted)
    reach = float(np.arccos(cosine))

    def by_label(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of a batch in labels with centres, the centres, and the angles to them."""
        label = np.asarray(batch.column(2).to_pylist(), object)
        for k in sorted(set(label.tolist()) & set(centres.value)):
            at = np.flatnonzero(label == k)
            x = unit(_vectors(batch.column(3).take(pa.array(at)), dim))
            yield at, k, np.arccos(np.clip(x @ centres.value[k].T, -1, 1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, own = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for at, _, angles in by_label(batch):
                home[at] = angles.argmin(1)
                own[at] = angles.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(own)], ["rep", "w", "label", "embedding", "home", "angle"])

    homes = first.select("rep", "w", "label", "embedding").mapInArrow(assign, f"rep long, w long, label string, embedding {vector}, home int, angle double")
    homes = materialise(homes, "homes")
    radii = {k: np.full(len(c), -1.0) for k, c in fitted.items()}
    if fitted:
        for r in homes.where(F.col("label").isin(sorted(fitted))).groupBy("label", "home").agg(F.max("angle").alias("r")).collect():  # at most as many as centres
            radii[r["label"]][r["home"]] = r["r"]
    apart = {k: np.sqrt(np.maximum(2 - 2 * c @ c.T, 0)) for k, c in fitted.items()}

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: list = [[]] * batch.num_rows
            homes, owns = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            for at, k, angles in by_label(batch):
                home, own, r = homes[at], owns[at], radii[k]
                may = (angles <= np.minimum(own[:, None] + 2 * reach, r[None, :] + reach) + 1e-9) & (np.arange(r.size)[None, :] > home[:, None]) & (r >= 0)[None, :]
                may &= np.cos(own)[:, None] - np.cos(angles) <= np.sin(reach) * apart[k][home] + 1e-9
                for i, m in zip(at.tolist(), may, strict=True):
                    cells[i] = np.flatnonzero(m).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(cells, pa.list_(pa.int32()))], ["rep", "w", "label", "embedding", "home", "cells"])

    seen = materialise(homes.mapInArrow(visit, f"rep long, w long, label string, embedding {vector}, home int, cells array<int>"), "visits")
    sizes = seen.groupBy("label", F.col("home").alias("cell")).agg(F.count("*").alias("m"))
    visits = seen.select("label", F.explode("cells").alias("cell")).groupBy("label", "cell").agg(F.count("*").alias("v"))
    sizes = sizes.join(visits, ["label", "cell"], "left").select("label", "cell", F.ceil(F.col("m") / block).cast("int").alias("blocks"), F.ceil((F.col("m") + F.coalesce("v", F.lit(0))) / (4 * block)).cast("int").alias("chunks"))
    # A member goes to its own block (as index, in every chunk) and asks in its own block and later ones.
    own = seen.select("rep", "w", "label", "embedding", F.col("home").alias("cell")).join(sizes, ["label", "cell"])
    own = own.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("turn", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("chunks")).cast("int"))
    columns = ["label", "cell", "block", "chunk", "role", "rep", "w", "embedding"]
    index = own.withColumn("block", F.col("mine")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("role", F.lit(0)).select(*columns)
    inside = own.withColumn("block", F.explode(F.sequence(F.col("mine"), F.col("blocks") - 1))).withColumn("chunk", F.col("turn")).withColumn("role", F.when(F.col("block") == F.col("mine"), 1).otherwise(2)).select(*columns)
    guests = seen.select("rep", "w", "label", "embedding", F.explode("cells").alias("cell")).join(sizes, ["label", "cell"])
    guests = guests.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("chunks")).cast("int")).withColumn("role", F.lit(2)).select(*columns)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = index.union(inside).union(guests).repartition(parts, "label", "cell", "block", "chunk").sortWithinPartitions("label", "cell", "block", "chunk", "role", "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim)
        key = None
        members: list[pa.RecordBatch] = []
        index = None

        def out(rep: np.ndarray, n: np.ndarray, v: np.ndarray | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(n, pa.int64()), pa.array(v, pa.int64()) if v is not None else pa.nulls(rep.size, pa.int64())], ["rep", "n", "v"])

        def opened():
            ids = np.concatenate([m.column(5).to_numpy() for m in members])
            weights = np.concatenate([m.column(6).to_numpy() for m in members])
            x = unit(np.concatenate([_vectors(m.column(7), dim) for m in members]))
            return ids, weights, x, Codes.of(x, turn)

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if begin == end:
                    continue
                part, (*at, role) = batch.slice(begin, end - begin), keys[begin]
                if at != key:
                    key, members, index = at, [], None
                if role == 0:
                    members.append(part)
                    continue
                if not members:
                    continue
                index = index or opened()
                ids, weights, x, codes = index
                for k in range(0, part.num_rows, 1024):
                    some = part.slice(k, 1024)
                    q_ids, q_weights = some.column(5).to_numpy(), some.column(6).to_numpy()
                    i, j = links_between(x, codes, unit(_vectors(some.column(7), dim)), turn, cosine, eps)
                    if role == 1:  # of a pair within the block, the larger id asks
                        once = ids[i] < q_ids[j]
                        i, j = i[once], j[once]
                    if not i.size:
                        continue
                    sums = np.bincount(i, q_weights[j], ids.size).astype(np.int64)
                    q_sums = np.bincount(j, weights[i], q_ids.size).astype(np.int64)
                    yield out(ids[sums > 0], sums[sums > 0], None)
                    yield out(q_ids[q_sums > 0], q_sums[q_sums > 0], None)
                    u, v = forest(i, j + ids.size, ids.size + q_ids.size)
                    both = np.concatenate((ids, q_ids))
                    yield out(both[u], np.zeros(u.size, np.int64), both[v])

    return dealt.mapInArrow(compare, "rep long, n long, v long")


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the edges i-j connect, at most one for each node."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root[root] != root).any():
        root = root[root]
    u = np.flatnonzero(root != np.arange(n))
    return u, root[u]
