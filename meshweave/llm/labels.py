"""Labelled rows for the classifiers: which may be learnt from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % folds).cast("int")


def known(labels: DataFrame, label_col: str, id_col: str, folds: int, held_out: int) -> DataFrame:
    """``doc_id`` and ``y`` (0 or 1) of the labels outside the held-out fold.

    Repeated labels of a document count once; a document with both labels, and null labels, are left
    out.
    """
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    rows = rows.where(F.col("y").isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out))
    return rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").select("doc_id", "y")


def sample(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows whose ids have the least hash: the same rows for the same ids, on any plan."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
