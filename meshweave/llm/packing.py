"""Best-two-fit packing of tokenised documents into sequences of bounded length.

A length lies between 1 and ``seq_len``, so how many pieces there are of each length is a table of
at most ``seq_len`` rows, whatever the size of the corpus. The packing is planned on that table on
the driver: a plan is a list of *patterns* (which lengths share a sequence) with multiplicities.
Every pattern exhausts one length up to less than one more use, so there are at most about
``seq_len * ln(seq_len)`` patterns, however many documents there are. The pieces then look up their
place by their length and their rank among the pieces of that length.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, texts, tidy

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"

# Characters for which lower-casing, NFC and the split below are the same in Python and in the
# tokenizer; a text with any other character, or with a special token, goes to the tokenizer whole.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e©«°·»¿¡À-ÿŒœ–—‘-”…]*")
_LETTERS = "a-zß-öø-ÿœ"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")
# The printable symbol that stands for each byte within the tokenizer's vocabulary: printable Latin-1
# characters stand for themselves, the other bytes for the characters from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SYMBOLS = {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*_SHOWN}))}


# The stages of a tokenizer for which the above holds, as its file names them.
_STAGES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WordEncoder:
    """Token ids of whole texts as little-endian 32-bit bytes, with a bounded cache of words.

    A tokenizer with the stages above splits a text into words and merges within each word alone, so the
    ids of a text are those of its words in order. Any other tokenizer encodes each text whole.
    """

    def __init__(self, path: str, cache_words: int = 200_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:  # a public vocabulary, at this path on every machine
            told = json.load(file)
        self.by_word = all(told.get(k) == v for k, v in _STAGES.items()) and told["model"].get("type") == "BPE" and not told["model"].get("dropout")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in told.get("added_tokens") or ()) or "(?!)")
        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.cache_words = cache_words

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_word or not _PLAIN.fullmatch(text) or self.special.search(text):
            return self.whole(text)
        words = _SPLIT.findall(text.lower())
        cache = self.cache
        try:
            return b"".join(map(cache.__getitem__, words))
        except KeyError:
            new = list({w for w in words if w not in cache})
        if len(cache) + len(new) > self.cache_words:  # frequent words came first: they stay
            cache = self.cache = dict(islice(cache.items(), self.cache_words // 8))
            new = list({w for w in words if w not in cache})
        merge = self.tokenizer.model.tokenize
        for w in new:
            cache[w] = array("I", [t.id for t in merge(w.encode().decode("latin-1").translate(_BYTE_SYMBOLS))]).tobytes()
        return b"".join(map(cache.__getitem__, words))


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(path)


def tokenised_pieces(
    docs: DataFrame, tokenizer_path: str, seq_len: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece of at most ``seq_len`` tokens; ``end_id`` ends each document.

    A null or empty text is the piece ``[end_id]``. Repeated rows each give their pieces.
    ``with_ids`` adds the column ``ids`` (array of int).
    """
    end = np.asarray([end_id], "<u4").tobytes()
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * seq_len)):
                    part = ids[at : at + 4 * seq_len]
                    row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<i4") if with_ids else None)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            n = len(names) if with_ids else len(names) - 1
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out[:n], kinds, strict=False)], names[:n])

    return texts(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), schema)


@dataclass
class Plan:
    """Intervals of ranks: the pieces of ``length`` ranked ``rank ..`` go ``copies`` to a sequence."""

    length: np.ndarray
    rank: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.length * (1 << 44) + self.rank, length * (1 << 44) + rank, "right") - 1
        within = rank - self.rank[k]
        return self.sequence[k] + within // self.copies[k], self.offset[k] + within % self.copies[k] * length


def plan_best_two_fit(counts: dict[int, int], seq_len: int) -> Plan:
    """Patterns by best-two-fit: open a sequence with the longest piece, keep adding the longest
    that fits, then replace its shortest piece by the two unpacked pieces that fill the widened gap
    most. The pattern is repeated while its pieces last.
    """
    left = np.zeros(seq_len + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    taken = np.zeros(seq_len + 1, np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    there = np.flatnonzero(left)
    while there.size:
        free = left.copy()
        pattern: list[int] = []
        gap = seq_len
        while gap:
            k = np.searchsorted(there, gap, "right") - 1
            while k >= 0 and free[there[k]] == 0:
                k -= 1
            if k < 0:
                break
            length = int(there[k])
            copies = min(gap // length, int(free[length]))
            pattern += [length] * copies
            free[length] -= copies
            gap -= length * copies
        if gap and len(pattern) > 1:
            shortest = pattern[-1]
            a = np.flatnonzero(free)
            a = a[a < gap + shortest]
            if a.size:
                k = np.searchsorted(a, gap + shortest - a, "right") - 1
                b = np.where(k >= 0, a[np.maximum(k, 0)], 0)
                b = np.where((b == a) & (free[a] < 2), np.where(k > 0, a[np.maximum(k - 1, 0)], 0), b)
                total = np.where(b > 0, a + b, 0)
                best = int(total.argmax())
                if total[best] > shortest:
                    pattern[-1:] = sorted((int(a[best]), int(b[best])), reverse=True)
        lengths, uses = np.unique(pattern, return_counts=True)
        times = int((left[lengths] // uses).min())
        at = 0
        for length, n in zip(lengths.tolist(), uses.tolist(), strict=True):
            rows.append((length, int(taken[length]), n, sequence, at))
            taken[length] += n * times
            left[length] -= n * times
            at += length * n
        sequence += times
        there = there[left[there] > 0]
    table = np.asarray(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*table.T.copy(), n_sequences=sequence)


def pack(pieces: DataFrame, seq_len: int = 4096, buckets: int | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (read twice, so they should be stored).

    Ranks within a length are counted per hashed bucket of documents, so that a length that a third
    of all pieces have is still dealt over all tasks; ties are broken by document and piece.
    """
    spark = pieces.sparkSession
    n = buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)))
    per = materialise(dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most seq_len rows
    plan = spark.sparkContext.broadcast(plan_best_two_fit(counts, seq_len))
    before = per.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece"))).join(before, ["length", "bucket"])
    names = [c for c in pieces.columns]
    rows = ranked.select(*names, (F.col("before") + F.col("rank") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.value.place(batch.column(names.index("length")).to_numpy(), batch.column(len(names)).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return rows.mapInArrow(run, schema)


def best_two_fit(docs: DataFrame, tokenizer_path: str, seq_len: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its place. An empty table gives no rows."""
    pieces = tokenised_pieces(docs, tokenizer_path, seq_len, end_id, id_col, text_col, with_ids)
    return pack(materialise(pieces, "pieces"), seq_len)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from ``best_two_fit(..., with_ids=True)``.

    A sequence holds at most ``seq_len`` tokens, so its group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
