"""Whitening of embeddings by the eigenvectors of their exactly centred covariance.

Entries become whole numbers x = floor(1024 c) + 100000, so their sums S are exact at any number n of
rows, and n x - S is an exact multiple of the centred value, free of cancellation. These rows over n are a
RowMatrix of MLlib, whose Gramian over n is the covariance; only its dimensions squared reach the driver,
where ``numpy.linalg.eigh`` takes it apart. The whitening is sent to the executors, and a second Gramian,
of the whitened rows, says how far their covariance is from the identity.

Defined cases: vectors that are null, or hold null, NaN or infinite entries, are left out, as are those
with an entry whose x has 52 bits or more (its sums could not be held), and those of another length than
most vectors have (the smaller length of equally many). Empty vectors have no component. Components whose
eigenvalue is nothing but rounding have no scale and are left out, so n = 1 and equal vectors give no rows.
Repeated ids, and rows without an id, are rows like others. The dimension is bounded by the driver's
memory (8 bytes for each pair of dimensions) and by RowMatrix at 65,535. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _bound_batches, materialise

#: Entries x are below this in absolute value: the sum of a batch of at most 2^11 rows fits 63 bits.
LARGEST = 1 << 51
PER_BATCH = 1 << 11
#: A deviation has at most 38 digits; a greater one is null.
WIDEST = 10**38


def whole_vectors(embeddings: DataFrame, id_col: str, vector_col: str, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """``vec_id`` and ``x`` of the vectors that count."""
    _bound_batches(embeddings.sparkSession)
    v = F.col("v")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * scale >= float(LARGEST - shift - 1)))
    good = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(v.isNotNull() & ~bad)
    whole = good.select("vec_id", F.transform(v, lambda c: F.floor(c * scale) + F.lit(shift).cast("long")).alias("x"))
    stored = materialise(whole.where(F.size("x") > 0), "vectors")
    lengths = stored.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return stored.where(F.size("x") == (lengths[0]["d"] if lengths else 0))


def _stack(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(np.int64)


def exact_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """How many rows there are, and the sum of each dimension: tasks add up in 64 bits, the rest is decimal."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, None
        for batch in batches:
            for k in range(0, len(batch), PER_BATCH):
                own = _stack(batch["x"].iloc[k : k + PER_BATCH])
                n += len(own)
                total = own.sum(0).astype(object) + (0 if total is None else total)
        if n:
            yield pd.DataFrame({"n": n, "at": np.arange(len(total)), "s": [Decimal(int(s)) for s in total]})

    sums = vectors.select("x").mapInPandas(run, "n long, at int, s decimal(38,0)").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("at").collect()
    return (sums[0]["n"], [int(r["s"]) for r in sums]) if sums else (0, [])


@dataclass
class Centring:
    """n x - S, exactly: in 64 bits where that has room, else in Python's integers."""

    n: int
    sums: list[int]

    def exact(self, x: np.ndarray) -> np.ndarray:
        room = self.n * int(np.abs(x).max()) + max(map(abs, self.sums)) < 1 << 62
        kind = np.int64 if room else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def centred(self, exact: np.ndarray) -> np.ndarray:
        """(n x - S) / n, rounded at most twice."""
        return (exact.astype(np.float64)) / self.n

    @staticmethod
    def squares(exact: np.ndarray) -> list[int]:
        """Sums of squares of the rows, exactly."""
        if exact.dtype != object and int(np.abs(exact).max()) ** 2 * exact.shape[1] >= 1 << 63:
            exact = exact.astype(object)
        return [int(s) for s in (exact * exact).sum(1)]


def gramian(rows: DataFrame, column: str) -> np.ndarray:
    """The Gramian of the arrays of a column, by MLlib."""
    vectors = rows.select(array_to_vector(F.col(column)).alias("v"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v")).computeGramianMatrix().toArray()


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """``vec_id``, ``component`` (from 1), ``n``, ``deviation`` (decimal), ``whitened``, ``explained`` and
    ``identity_error`` of each vector and each of the first ``components`` components."""
    spark = embeddings.sparkSession
    kind = embeddings.schema[id_col].dataType.simpleString()
    vectors = whole_vectors(embeddings, id_col, vector_col)
    n, sums = exact_sums(vectors)
    if n:
        centring = Centring(n, sums)

        def centre(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield pd.DataFrame({"y": [*centring.centred(centring.exact(_stack(batch["x"])))]})

        covariance = gramian(vectors.select("x").mapInPandas(centre, "y array<double>"), "y") / n
        values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
        values, axes = values[::-1], axes[:, ::-1]
        k = min(components, int((values > values[0] * len(values) * np.finfo(float).eps).sum()) if values[0] > 0 else 0)
    if not n or not k:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    sent = spark.sparkContext.broadcast(axes[:, :k] / np.sqrt(values[:k]))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                exact = centring.exact(_stack(batch["x"]))
                yield pd.DataFrame({"vec_id": batch["vec_id"], "deviation": [Decimal(s) if s < WIDEST else None for s in centring.squares(exact)], "w": [*(centring.centred(exact) @ sent.value)]})

    named = vectors.select(F.col("vec_id").cast("string").alias("vec_id"), "x")  # pandas has no whole numbers beside null
    done = materialise(named.mapInPandas(project, "vec_id string, deviation decimal(38,0), w array<double>").withColumn("vec_id", F.col("vec_id").cast(kind)), "whitened")
    means = np.array(done.agg(*(F.avg(F.get("w", c)) for c in range(k))).first())
    still = F.transform("w", lambda v, c: v - F.get(F.array(*map(F.lit, means.tolist())), c))
    error = float(np.abs(gramian(done.select(still.alias("w")), "w") / n - np.eye(k)).max())
    explained = F.array(*(F.lit(float(e / values.sum())) for e in values[:k]))
    rows = done.select("vec_id", "deviation", F.posexplode("w").alias("c", "whitened"))
    return rows.select("vec_id", (F.col("c") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("c")).alias("explained"), F.lit(error).alias("identity_error"))
