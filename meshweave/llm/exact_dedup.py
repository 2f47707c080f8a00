"""Exact deduplication of texts, combined in stages that no hot group can overload.

Two texts are equal if they are so after their white space is deleted. Four steps:

1. Local: each task groups its documents by their normalised texts, in windows of bounded size. A group
   leaves one row: SHA-256, normalised text, ids of its members (the one to stay first).
2. The digests are counted over all local groups. One that occurs once is done; its text is not moved.
3. Salted: local groups of a repeated digest are dealt over as many salts as there are ``per_salt`` of
   them, and merged where digest, salt and text are equal.
4. Global: the winners of the salts are merged where digest and text are equal.

Equal digests are never trusted alone: each step compares the whole texts, so texts whose digests collide
stay apart. A group of any size sends one row for each window of rows that it occurs in, and its members
find their winner by a join of these rows, which Spark splits where it is skewed. Of a group the row with
the most code points stays, of these the one with the least id (null is the greatest), of these one: of
rows that repeat id and length any may stay, but just one does. A null text is like an empty one, and all
texts of white space alone are equal. Texts of any length are compared whole. An empty table gives an
empty result; other columns of the input cannot clash, as only two are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import Sieve, materialise, texts, tidy

#: What is deleted before texts are compared.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: A table of digests up to this size is sent to all executors; a larger one is joined by shuffle.
MOST_SENT = 300_000


def _windows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _grouped(ids: pa.Array, raw: list[bytes | None], chars: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Normalised texts; the group of each row; the row of each group that stays."""
    keys = ids.to_pylist()
    found: dict[bytes, int] = {}
    group, best = np.empty(len(raw), np.int64), []
    for k, text in enumerate(raw):
        content = (text or b"").translate(None, WHITE)
        g = group[k] = found.setdefault(content, len(best))
        if g == len(best):
            best.append(k)
            continue
        old = best[g]
        if chars[k] > chars[old] or (chars[k] == chars[old] and keys[k] is not None and (keys[old] is None or keys[k] < keys[old])):
            best[g] = k
    return [*found], group, np.array(best, np.int64)


def local_groups(docs: DataFrame, window: int = 32 << 20) -> DataFrame:
    """The first step over ``doc_id``, ``text`` (and ``row``): a row for each distinct text of a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for table in _windows(batches, window):
            ids, text = table.column(0).combine_chunks(), table.column(1).combine_chunks().cast(pa.binary())
            chars = pc.fill_null(pc.utf8_length(table.column(1)), 0).to_numpy().astype(np.int64)
            content, group, best = _grouped(ids, text.to_pylist(), chars)
            n = len(content)
            first = np.zeros(len(group), bool)
            first[best] = True
            order = np.lexsort((~first, group))
            size = np.bincount(group, minlength=n)
            columns = {
                "gid": pa.array(number + np.arange(n)),
                "sha": pa.array([hashlib.sha256(x).digest() for x in content], pa.binary()),
                "content": pa.array(content, pa.binary()),
                "n": pa.array(size),
                "chars": pa.array(chars[best]),
                "doc_id": ids.take(pa.array(best)),
                "members": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), ids.take(pa.array(order))),
            }
            if "row" in table.column_names:
                columns["row"] = table.column("row").combine_chunks().take(pa.array(best))
            number += n
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    kind = docs.schema["doc_id"].dataType
    fields = [StructField("gid", LongType()), StructField("sha", BinaryType()), StructField("content", BinaryType()), StructField("n", LongType()), StructField("chars", LongType()), StructField("doc_id", kind), StructField("members", ArrayType(kind))]
    return docs.mapInArrow(tidy(run), StructType([*fields, *(x for x in docs.schema.fields if x.name == "row")]))


def _sent(df: DataFrame) -> tuple[DataFrame, bool]:
    small = df.count() <= MOST_SENT
    return (F.broadcast(df) if small else df), small


def _merged(local: DataFrame, per_salt: int) -> DataFrame:
    """Steps 2 to 4 over ``gid``, ``key``, ``content``, ``n``, ``chars``, ``doc_id``: for each text that is
    in several local groups its size, the winner, and how many texts share its key (one, but for collisions)."""
    repeated = materialise(local.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "repeated")
    sent, small = _sent(repeated)
    if not small:  # only texts that can have a copy are shuffled
        sieve = Sieve(repeated.select(F.xxhash64("key").alias("k")))

        @F.pandas_udf("boolean")
        def maybe(k: pd.Series) -> pd.Series:
            return pd.Series(sieve.holds(k.to_numpy()))

        local = local.where(maybe(F.xxhash64("key")))
    salt = F.pmod(F.xxhash64("gid"), F.ceil(F.col("m") / per_salt)).alias("salt")
    rank = F.struct((-F.col("chars")).alias("fewer"), F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("gid")).alias("best")
    dealt = local.join(sent, "key").select("key", salt, "content", "n", rank).repartition("key", "salt")
    salted = dealt.groupBy("key", "salt", "content").agg(F.sum("n").alias("n"), F.min("best").alias("best"))
    texts_of = salted.repartition("key").groupBy("key", "content").agg(F.sum("n").alias("size"), F.min("best").alias("best"))
    # A key has one text but for collisions: counting the texts of a key needs no window over them.
    found = materialise(texts_of.select("key", "content", "size", F.col("best.gid").alias("keep_gid"), F.col("best.doc_id").alias("keep")), "winners")
    return found.join(found.groupBy("key").agg(F.count("*").alias("texts")), "key")


def _resolved(docs: DataFrame, per_salt: int, window: int, key_bytes: int) -> DataFrame:
    """Every local group with its winner (``keep_gid``, ``keep``) and the size of its whole group."""
    local = materialise(local_groups(docs, window), "local-groups").withColumn("key", F.substring("sha", 1, key_bytes))
    winners = materialise(_merged(local.select("gid", "key", "content", "n", "chars", "doc_id"), per_salt), "resolved")
    own = ("size", "keep_gid", "keep")
    one, _ = _sent(winners.where("texts = 1").select("key", *own))
    out = local.drop("content").join(one, "key", "left")
    several = winners.where("texts > 1")
    if not several.isEmpty():  # keys that collide: these groups are told apart by their texts
        told = local.select("gid", "key", "content").join(several.select("key", "content", *(F.col(c).alias(f"__{c}") for c in own)), ["key", "content"]).drop("key", "content")
        out = out.join(told, "gid", "left")
        out = out.withColumns({c: F.when(F.col("__keep_gid").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)) for c in own})
    alone = F.col("keep_gid").isNull()
    return out.withColumns({"keep": F.when(alone, F.col("doc_id")).otherwise(F.col("keep")), "size": F.when(alone, F.col("n")).otherwise(F.col("size")), "keep_gid": F.when(alone, F.col("gid")).otherwise(F.col("keep_gid"))})


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_salt: int = 64, window: int = 32 << 20, key_bytes: int = 32) -> DataFrame:
    """One row for each document: ``doc_id``, ``keep_id`` (of the row of its group that stays),
    ``group_size``, ``kept`` (true for one row of a group) and ``text_sha256`` of the normalised text.

    ``key_bytes`` is how much of the digest decides where texts meet; any number gives the same result.
    """
    found = _resolved(texts(docs, id_col, text_col), per_salt, window, key_bytes)
    rows = found.select("sha", "size", "keep", "gid", "keep_gid", F.posexplode("members").alias("at", "id"))
    kept = (F.col("gid") == F.col("keep_gid")) & (F.col("at") == 0)
    return rows.select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_salt: int = 64, window: int = 32 << 20) -> DataFrame:
    """The rows that stay, one of each group, with all their columns."""
    found = _resolved(texts(docs, id_col, text_col, carry=True), per_salt, window, 32)
    return found.where("gid = keep_gid").select("row.*")
