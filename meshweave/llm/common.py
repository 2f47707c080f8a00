"""Pieces that the training-data operators share: input columns, shared storage, hashing."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there."""
    return stored(df, what, compression="zstd")


def _bound_batches(spark: SparkSession) -> None:
    """Texts can be very long: Arrow batches are bounded in rows and bytes, unless the session has
    other than Spark's default rows."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def texts(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """Only the id and the text, as ``doc_id`` and ``text``; other columns cannot clash.

    ``carry`` adds the whole input row as the struct ``row``.
    """
    _bound_batches(docs.sparkSession)
    row = [F.struct("*").alias("row")] if carry else []
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *row)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, handing freed memory back to the system at its end. Python workers serve many tasks
    of different stages, and would otherwise each keep the most that any of these has needed."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class Numbers(dict):
    """64-bit hashes of words, kept up to a bound; frequent words come first and stay."""

    def __init__(self, most: int):
        from xxhash import xxh3_64_intdigest

        super().__init__()
        self.digest, self.most = xxh3_64_intdigest, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            first = [*islice(self.items(), self.most // 4)]
            self.clear()
            self.update(first)
        self[word] = number = self.digest(word.encode("utf-8", "replace"))
        return number


class Sieve:
    """A set of 64-bit keys as a bit table of fixed size, to leave out rows before a shuffle.

    It may keep a row whose key is not in the set, and never loses one that is. The size does not
    depend on the number of keys; with very many of them it merely keeps more rows.
    """

    def __init__(self, keys: DataFrame, bits: int = 24):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros(1 << (bits - 6), np.uint64)
            for batch in batches:
                slot = self.slots(batch.column(0).to_numpy())
                np.bitwise_or.at(table, slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64))
            word = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(table[word].view(np.int64))], ["word", "bits"])

        self.bits = bits
        got = keys.mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        table = np.zeros(1 << (bits - 6), np.uint64)
        table[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
        self.table = keys.sparkSession.sparkContext.broadcast(table)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slots(keys)
        return (self.table.value[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("bits", "table")}
