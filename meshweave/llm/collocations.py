"""Phrases whose words keep together, mined by naming pairs level by level.

A phrase of k words is the pair of the phrases of k - 1 words that begin at its first and at its second
word, and can only be frequent if both are. So level k reads the places of frequent phrases of level k - 1,
names each pair of neighbours, and keeps the pairs that are frequent in the whole corpus. The two halves of
a name are parent pointers: cuts, texts and the test for longer phrases follow them, and no phrase is
looked up by its words.

The corpus is held in chunks: a row for some megabytes of text of one language, with the chunk's own small
numbers at each place (compressed; -1 where no phrase begins, one for a run of such places). The distinct pairs
of a chunk and how often each occurs are rows of their own, a packed piece for each slice of the pairs' hashes
(words: pieces of ``PIECE`` words). So no row grows with the corpus, and row groups are kept small, as a reader
holds one at a time. A level takes two shuffles:

* the pieces of a slice meet, some millions of pairs, and their counts are added up. A slice numbers its frequent
  pairs; this number and the slice are a pair's name, so names are unique and small. Any pair, however frequent,
  is in one piece of each chunk.
* the names of frequent pairs return to their chunks, packed, which put them at their places and pair neighbours.

Nothing is broadcast and no table of words is held in memory beyond that of a chunk. Everything is counted
by language; a null language is ``und``. Null and empty texts have no words; a word of any length and a text
of any length are whole; rows without id and repeated rows count like others. An empty table has no phrases.
Other columns are not read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, stored
from .common import _bound_batches, materialise, tidy

#: Bytes that end a piece, and bytes between words.
BREAKS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
#: Bits of the corpus' names.
NAME_BITS = 40
#: Names below this are held two in a number.
PAIRED_NAMES = 1 << 31
#: Words of a row of level 1.
PIECE = 1 << 14
#: Rows are large, so row groups are cut by size at any row.
SMALL_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}
_KIND = np.zeros(256, np.uint8)
_KIND[[*BLANKS]], _KIND[[*BREAKS]] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts in order, and the number of the piece that each is in."""
    text = text.cast(pa.binary())
    at = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    kind = _KIND[data]
    letter = kind == 0
    begins = np.zeros(len(data) + 1, bool)  # of a text
    begins[at - at[0]] = True
    begins = begins[:-1]
    first = letter.copy()
    first[1:] &= ~letter[:-1] | begins[1:]
    piece = np.cumsum((kind == 2) | begins, dtype=np.int32)[first]
    inner = np.cumsum(letter, dtype=np.int32)  # letters up to each place
    offsets = np.append(inner[first] - 1, inner[-1] if len(inner) else 0).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(piece), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[letter]])]), piece


def _coded(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0, compressed: their first bytes, their second bytes and so on, which are alike."""
    width = 1 << (max(int(numbers.max(initial=0)).bit_length() - 1, 0) // 8).bit_length()
    raw = np.ascontiguousarray(numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()
    return bytes([width]) + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _decoded(coded: bytes) -> np.ndarray:
    width, size = coded[0], int.from_bytes(coded[1:9], "little")
    if not size:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(pa.decompress(coded[9:], size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def _steps(numbers: np.ndarray) -> np.ndarray:
    return np.diff(numbers, prepend=0)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers at the places of a chunk, compressed; of a run of -1 one is kept."""
    if numbers.size:
        numbers = numbers[np.append(True, (numbers[1:] >= 0) | (numbers[:-1] >= 0))]
    return _coded(numbers + 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return (_decoded(packed) - 1).astype(np.int32)


def word_chunks(docs: DataFrame, text_col: str, lang_col: str, chunk: int) -> DataFrame:
    """Level 1: the chunks with the words at each place, and their distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20

        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            table = pa.Table.from_batches(held)
            lang = table.column(0).combine_chunks().dictionary_encode()
            for own, name in enumerate(lang.dictionary):
                words, piece = _words(table.column(1).combine_chunks().take(pa.array(np.flatnonzero(lang.indices.to_numpy() == own))))
                if not len(words):
                    continue
                coded = words.dictionary_encode()
                at = coded.indices.to_numpy().astype(np.int64)
                broken = np.flatnonzero(piece[1:] != piece[:-1]) + 1
                seq = np.insert(at, broken, -1)
                counts = np.bincount(at, minlength=len(coded.dictionary))
                for k in range(0, len(counts), PIECE):  # the places are in the first of the chunk's rows
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([number]), "lang": pa.array([name.as_py()]), "seq": pa.array([None if k else _packed(seq)], pa.binary()), "start": pa.array([k]), "word": pa.array([coded.dictionary[k : k + PIECE]], pa.list_(pa.binary())), "n": pa.array([counts[k : k + PIECE]], pa.list_(pa.int64()))})
                number += 1

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= chunk:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    read = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return read.mapInArrow(tidy(run), "chunk long, lang string, seq binary, start long, word array<binary>, n array<long>")


def _slice_of(first: np.ndarray, second: np.ndarray, slices: int) -> np.ndarray:
    mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ second.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed >> np.uint64(32)) % np.uint64(slices)).astype(np.int64)


def pair_chunks(chunks: DataFrame, names: DataFrame, most: int, slices: int, last: bool) -> DataFrame:
    """The next level: the frequent phrases at the places of each chunk, paired with their neighbours. A row has
    the chunk's places (none at the ``last`` level), the others the pairs of a slice and their counts."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {x: [] for x in ("slice", "start", "seq", "first", "second", "n")}
        if left.num_rows and right.num_rows:
            seq = _unpacked(left.column("seq")[0].as_py())
            number = np.concatenate([np.cumsum(_decoded(x)) for x in right.column("at").to_pylist()])
            name = np.concatenate([_decoded(x) for x in right.column("names").to_pylist()])
            order = np.argsort(name)
            rank = np.full(int(max(seq.max(initial=0), number.max())) + 1, -1, np.int64)
            rank[number[order]] = np.arange(order.size)  # frequent phrases by their place among the chunk's names
            place = np.where(seq < 0, -1, rank[seq])
            both = (place[:-1] >= 0) & (place[1:] >= 0)
            pairs, at, count = np.unique(place[:-1][both] * order.size + place[1:][both], return_inverse=True, return_counts=True)
            name = name[order]
            if pairs.size:
                first, second = name[pairs // order.size], name[pairs % order.size]
                where = _slice_of(first, second, slices)
                dealt = np.argsort(where, kind="stable")  # pairs are numbered slice by slice
                if not last:
                    back = np.empty(dealt.size, np.int64)
                    back[dealt] = np.arange(dealt.size)
                    seq = np.full(max(place.size - 1, 0), -1, np.int64)
                    seq[both] = back[at]
                    for x in out:
                        out[x].append(_packed(seq) if x == "seq" else None)
                cuts = np.append(np.flatnonzero(np.diff(where[dealt], prepend=-1)), dealt.size)
                first, second, count = first[dealt], second[dealt], count[dealt]
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    row = (int(where[dealt[lo]]), lo, None, _coded(_steps(first[lo:hi])), _coded(second[lo:hi]), _coded(count[lo:hi]))
                    for x, v in zip(out, row, strict=True):
                        out[x].append(v)
        kinds = {"slice": pa.int64(), "start": pa.int64()}
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(out["slice"]), pa.int64()), **{x: pa.array(v, kinds.get(x, pa.binary())) for x, v in out.items()}})

    if most >= 1 << NAME_BITS:
        raise ValueError(f"names beyond {NAME_BITS} bits")
    heads = chunks.where(F.col("seq").isNotNull()).select("chunk", "seq")
    return heads.groupBy("chunk").cogroup(names.groupBy("chunk")).applyInArrow(run, "chunk long, slice long, start long, seq binary, first binary, second binary, n binary")


def frequent_words(chunks: DataFrame, least: int, per_slice: int) -> DataFrame:
    """``chunk``, ``at``, ``name`` and whole count ``a`` of each frequent word of each chunk. A slice numbers the
    rows of its frequent words; a word is named after its least row (``own``) and the slice."""
    spark = chunks.sparkSession
    rows = chunks.agg(F.sum(F.size("n"))).first()[0] or 0
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_slice))
    each = chunks.select("chunk", "lang", "start", F.posexplode(F.arrays_zip("word", "n")).alias("k", "v"))
    each = each.select("lang", F.col("v.word").alias("word"), F.col("v.n").alias("n"), "chunk", (F.col("start") + F.col("k")).alias("at"))
    meet = Window.partitionBy("lang", "word")
    often = each.repartition(slices, "lang", "word").withColumn("a", F.sum("n").over(meet)).where(F.col("a") >= least)
    rows = often.withColumn("row", F.monotonically_increasing_id()).withColumn("first_row", F.min("row").over(meet))
    in_slice = F.col("first_row").bitwiseAND(F.lit((1 << 33) - 1))  # above these 33 bits is the slice
    name = in_slice * slices + F.shiftright("first_row", 33)
    own = F.col("row") == F.col("first_row")
    return rows.select("chunk", "at", name.alias("name"), "a", own.alias("own"), *(F.when(own, F.col(c)).alias(c) for c in ("lang", "word")))


def _told_words(found: DataFrame) -> DataFrame:
    """The names of words on the way back to their chunks, packed in pieces."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        chunk, at, name = (table.column(k).to_numpy() for k in range(3))
        order = np.lexsort((at, chunk))
        chunk, at, name = chunk[order], at[order], name[order]
        cuts = np.append(np.flatnonzero(np.diff(chunk, prepend=-1)), chunk.size).tolist()
        parts = [slice(lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_pydict({"chunk": pa.array(chunk[cuts[:-1]]), "at": pa.array([_coded(_steps(at[p])) for p in parts], pa.binary()), "names": pa.array([_coded(name[p]) for p in parts], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 1_000_000:
                yield pack(held)
                held, rows = [], 0
        if rows:
            yield pack(held)

    return found.select("chunk", "at", "name").mapInArrow(run, "chunk long, at binary, names binary")


def frequent_pairs(chunks: DataFrame, least: int, most: int, slices: int) -> DataFrame:
    """Rows with ``name``, ``a``, ``first`` and ``second`` of frequent pairs, and rows that tell chunks of them:
    ``chunk``, ``at`` and ``names``, packed. ``most`` is the greatest name of the parents."""
    paired = most < PAIRED_NAMES

    def run(key: tuple, table: pa.Table) -> pa.Table:
        own, begins, counts = key[0].as_py(), table.column("start").to_pylist(), [_decoded(x) for x in table.column("n").to_pylist()]
        first = np.concatenate([np.cumsum(_decoded(x)) for x in table.column("first").to_pylist()])
        second = np.concatenate([_decoded(x) for x in table.column("second").to_pylist()])
        order = np.argsort(first << 32 | second, kind="stable") if paired else np.lexsort((second, first))
        new = np.append(True, (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0))
        head = order[new]
        a = np.add.reduceat(np.concatenate(counts)[order], np.flatnonzero(new))
        often = a >= least
        named = np.where(often, (np.cumsum(often) - 1) * slices + own, -1)
        name = np.empty(order.size, np.int64)
        name[order] = named[np.cumsum(new) - 1]
        chunk, at, names, low = [], [], [], 0
        for c, begin, n in zip(table.column("chunk").to_pylist(), begins, counts, strict=True):
            here = name[low : low + n.size]
            low += n.size
            k = np.flatnonzero(here >= 0)
            if k.size:
                chunk.append(c)
                at.append(_coded(_steps(k + begin)))
                names.append(_coded(here[k]))
        numbers = {"name": named[often], "a": a[often], "first": first[head][often], "second": second[head][often]}
        told = pa.table({"chunk": pa.array(chunk, pa.int64()), "at": pa.array(at, pa.binary()), "names": pa.array(names, pa.binary()), **{x: pa.nulls(len(chunk), pa.int64()) for x in numbers}})
        rows = len(numbers["name"])
        mine = pa.table({"chunk": pa.nulls(rows, pa.int64()), "at": pa.nulls(rows, pa.binary()), "names": pa.nulls(rows, pa.binary()), **{x: pa.array(v, pa.int64()) for x, v in numbers.items()}})
        return pa.concat_tables([told, mine]).combine_chunks()

    pieces = chunks.where(F.col("slice").isNotNull()).drop("seq")
    return pieces.groupBy("slice").applyInArrow(run, "chunk long, at binary, names binary, name long, a long, first long, second long")


def _levels(docs: DataFrame, text_col: str, lang_col: str, least: int, longest: int, chunk: int, per_slice: int) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of each length, and the words of each language."""
    spark = docs.sparkSession
    chunks = stored(word_chunks(docs, text_col, lang_col, chunk), "chunks", compression="zstd", **SMALL_GROUPS)
    total = materialise(chunks.groupBy("lang").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")), "words")
    words = total.agg(F.sum("n")).first()[0] or 0  # a level has no more pairs
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // per_slice))
    found = materialise(frequent_words(chunks, least, per_slice), "names")
    own, told = materialise(found.where("own").select("name", "a", "lang", "word"), "phrases-1"), _told_words(found)
    levels = [own]
    for k in range(2, longest + 1):
        most = own.agg(F.max("name")).first()[0] or 0
        before, names, chunks = chunks, found, stored(pair_chunks(chunks, told, most, slices, k == longest), "chunks", compression="zstd", **SMALL_GROUPS)
        discard(before)
        discard(names)
        found = materialise(frequent_pairs(chunks, least, most, slices), "names")
        own, told = materialise(found.where(F.col("name").isNotNull()).select("name", "a", "first", "second"), f"phrases-{k}"), found.where(F.col("chunk").isNotNull()).select("chunk", "at", "names")
        levels.append(own)
    discard(chunks)
    discard(found)
    return levels, total


def _told(levels: list[DataFrame], scale: int) -> list[DataFrame]:
    """For each length from 2: ``name``, ``lang``, ``phrase``, ``a``, its best cut ``l``, ``r``, ``score`` and its
    two parents. ``pre`` and ``post`` have the counts of the phrase's first and last j words, j from 1."""
    own = levels[0].select("name", "lang", F.col("word").cast("string").alias("phrase"), F.col("word").cast("string").alias("last"), F.array("a").alias("pre"), F.array("a").alias("post"))
    out = []
    for k, level in enumerate(levels[1:], 2):
        left = own.select(F.col("name").alias("first"), "lang", F.col("phrase").alias("begin"), F.col("pre").alias("lefts"))
        right = own.select(F.col("name").alias("second"), F.col("last"), F.col("post").alias("rights"))
        both = level.join(left, "first").join(right, "second")
        # Lowest score first, then the shortest first part; the score is exact in 38 digits.
        cuts = [F.struct(F.expr(f"(CAST({scale} AS DECIMAL(18,0)) * CAST(a AS DECIMAL(19,0))) div (CAST(lefts[{j - 1}] AS DECIMAL(20,0)) + rights[{k - j - 1}])").alias("score"), F.lit(j).alias("j"), F.col("lefts")[j - 1].alias("l"), F.col("rights")[k - j - 1].alias("r")) for j in range(1, k)]
        told = both.withColumn("cut", F.array_min(F.array(*cuts))).select(
            "name", "lang", "first", "second", "a", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "cut.score", "cut.l", "cut.r",
            F.concat("lefts", F.array("a")).alias("pre"), F.concat("rights", F.array("a")).alias("post"),
        )
        own = materialise(told, "told")
        out.append(own)
    return out


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = 4, top: int = 2000, scale: int = 2_000_000, covered: int = 80, chunk: int = 16 << 20,
    per_slice: int = 2_000_000, salts: int = 32,
) -> DataFrame:
    """The first ``top`` phrases of each language by score: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``,
    ``n``, ``score``. A phrase inside a longer one that has ``covered`` percent of its count is left out."""
    _bound_batches(docs.sparkSession)
    levels, total = _levels(docs, text_col, lang_col, least, longest, chunk, per_slice)
    told = _told(levels, scale)
    kept = []
    for phrases, longer in zip(told, [*told[1:], None], strict=True):
        phrases = phrases.select("name", "lang", "phrase", "a", "l", "r", "score")
        if longer is not None:  # what holds a phrase and is longer still is itself held by no more than these
            parent = longer.select(F.explode(F.array("first", "second")).alias("name"), F.col("a").alias("most")).groupBy("name").agg(F.max("most").alias("most"))
            phrases = phrases.join(parent, "name", "left").where(f"most IS NULL OR CAST(100 AS DECIMAL(3,0)) * CAST(most AS DECIMAL(19,0)) < CAST({covered} AS DECIMAL(3,0)) * CAST(a AS DECIMAL(19,0))").drop("most")
        kept.append(phrases)
    every = kept[0]
    for more in kept[1:]:
        every = every.union(more)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("name"), F.lit(salts))
    every = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*best))).where(F.col("rank") <= top)
    every = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return every.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
