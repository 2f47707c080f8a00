"""The corpus pipeline: rate, deduplicate, decontaminate, redact, pack.

Each stage takes the documents that the one before kept and returns documents with the columns it
got, but for the last, which returns packed pieces. Stages add no columns and rename none, so
columns of any further name pass through.

In every stage a null text is like an empty one and stays null, repeated rows are treated alike, an
empty table gives an empty one, and a text may have any length. Only ``rate`` and ``deduplicate`` leave
rows out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshweave.llm import fm_index, jaccard_join, packing, quality, secrets
from meshweave.llm.common import materialise, table
from meshweave.llm.queries import tokenizer_path
from meshweave.sources.shared import discard

# A set of document ids up to this size is sent to all executors; a larger one is joined by shuffle.
MOST_SENT = 2_000_000


def _with_text(carried: DataFrame, columns: list[str], new: Column) -> DataFrame:
    """The carried rows with their text replaced, and ``n_chars`` counted again if it changed."""
    old = F.col("row.text")
    changed = ~old.eqNullSafe(new)
    out = []
    for c in columns:
        value = F.col("row")[c]
        if c == "text":
            value = new
        elif c == "n_chars":
            value = F.when(changed, F.char_length(new)).otherwise(value).cast(carried.schema["row"].dataType[c].dataType)
        out.append(value.alias(c))
    return carried.select(*out)


def rate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects. Null and empty texts are scored as texts
    without words; rows without an id are scored too."""
    return quality.score_quality(docs, table(spark, sf_dir, "labels"), carry=True).where("predicted = 1").select("row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least document of each group of near duplicates, one row of it; documents without
    words, and rows without an id, stay. Of rows that repeat an id and its text one stays, the first by
    all its columns as JSON; rows that repeat an id with other texts all stay, as one document."""
    joined, _ = jaccard_join.jaccard_join(docs)
    joined = materialise(joined.where("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", "component_id"), "joined")
    dropped = joined.where("doc_id <> component_id").select(F.col("doc_id").alias("__dropped")).distinct()
    if dropped.count() <= MOST_SENT:
        dropped = F.broadcast(dropped)
    kept = docs.join(dropped, docs["doc_id"] == F.col("__dropped"), "left_anti")
    repeated = joined.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__repeated"))
    if repeated.isEmpty():
        return kept
    again = docs["doc_id"] == F.col("__repeated")
    rows = kept.join(repeated, again, "left_semi").groupBy("doc_id", "text").agg(F.min_by(F.struct("*"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias("row"))
    return kept.join(repeated, again, "left_anti").union(rows.select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the words of benchmark items out of the documents; a text without any stays as it is."""
    cleaned = fm_index.find_leaks(docs, table(spark, sf_dir, "benchmark"), carry=True, cut=True)
    return _with_text(cleaned, docs.columns, F.col("text"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets, overlapping ones together, by a mark."""
    found = secrets.scan(docs, carry=True)
    return _with_text(found, docs.columns, secrets.redacted(F.col("text"), F.col("spans")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 4096 tokens: one row for each piece. A null or empty
    text is one end token."""
    return packing.best_two_fit(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", rate),
    ("jaccard_join", deduplicate),
    ("decontamination", decontaminate),
    ("secret_scan", redact),
    ("best_fit_packing", pack),
]

#: Models, searches and tokenizers of the stages are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return docs
