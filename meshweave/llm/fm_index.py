"""Benchmark decontamination with an FM-index over each training shard.

A shard is a run of documents with at most about ``shard_words`` words (a longer document is a
shard of its own). Its text is a sequence of word numbers. Words that no benchmark item has can be
in no match: each of their positions, and each document end, is a symbol of its own that sorts
before all words, in text order. That keeps suffixes short without changing any match.

* suffix array by prefix doubling, then the BWT in a wavelet matrix (a wavelet tree with its levels
  laid out flat) with sampled bit ranks;
* all test windows are searched backward at once, a word at a time, by two ranks each;
* an occurrence is located by LF steps to the next sampled suffix (starts of runs of known words,
  and every ``sample``-th position within one);
* occurrences are merged to removal spans of each document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, texts, tidy

# Bytes of UTF-8 text: A-Z become a-z, all other ASCII characters but letters and digits are gaps.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class BitRank:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        n = bits.size
        packed = np.zeros((n // 64 + 1) * 8, np.uint8)
        some = np.packbits(bits, bitorder="little")
        packed[: some.size] = some
        self.words = packed.view("<u8")
        self.before = np.zeros(self.words.size, np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.ones = int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Rank and access over numbers below ``2 ** levels``."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels = []
        v = values
        for b in range(levels - 1, -1, -1):
            bits = (v >> b) & 1
            one = bits.astype(bool)
            self.levels.append((b, BitRank(one), v.size - int(one.sum())))
            v = np.concatenate((v[~one], v[one]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol is before each place."""
        start = np.zeros_like(i)
        for b, bits, zeros in self.levels:
            up = ((symbol >> b) & 1).astype(bool)
            both = bits.rank(np.concatenate((start, i)))
            s, e = both[: i.size], both[i.size :]
            start = np.where(up, zeros + s, start - s)
            i = np.where(up, zeros + e, i - e)
        return i - start

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it is before."""
        symbol, start = np.zeros_like(i), np.zeros_like(i)
        for b, bits, zeros in self.levels:
            up = bits.get(i).astype(bool)
            both = bits.rank(np.concatenate((start, i)))
            s, e = both[: i.size], both[i.size :]
            start = np.where(up, zeros + s, start - s)
            i = np.where(up, zeros + e, i - e)
            symbol |= up.astype(np.int64) << b
        return symbol, i - start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of symbols of which 0 stands for a different, smaller symbol at each place.

    The last symbol has to be 0. Only suffixes that are still equal to others are sorted again.
    """
    n = text.size
    zero = np.flatnonzero(text == 0)
    known = np.flatnonzero(text)
    sa = np.empty(n, np.int64)
    sa[: zero.size] = zero
    order = known[np.argsort(text[known], kind="stable")]
    sa[zero.size :] = order
    rank = np.empty(n, np.int64)
    rank[zero] = np.arange(zero.size)

    def groups(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of each row's group, and whether the group has more rows than one."""
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, first.size))
        return np.repeat(start, size), np.repeat(size > 1, size)

    if not known.size:
        return sa
    symbols = text[order]
    start, open_ = groups(np.concatenate(([True], symbols[1:] != symbols[:-1])))
    rank[order] = zero.size + start
    slots = zero.size + np.flatnonzero(open_)
    step = 1
    while slots.size:
        members = sa[slots]
        old, following = rank[members], rank[members + step]
        by = np.argsort(old * (n + 1) + following)
        members, old, following = members[by], old[by], following[by]
        sa[slots] = members
        start, open_ = groups(np.concatenate(([True], (old[1:] != old[:-1]) | (following[1:] != following[:-1]))))
        rank[members] = slots[start]
        slots = slots[open_]
        step *= 2
    return sa


class FMIndex:
    """FM-index of one shard: ``text`` of word numbers, 0 for document ends and unknown words."""

    def __init__(self, text: np.ndarray, vocabulary: int, sample: int = 16):
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.n = text.size
        self.wavelet = WaveletMatrix(bwt, max(1, int(vocabulary).bit_length()))
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=vocabulary + 1))))
        kept = (bwt == 0) | (sa % sample == 0)
        self.sampled = BitRank(kept)
        self.positions = sa[kept]

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all rows of ``windows``: which occur, and their suffix intervals."""
        which = np.arange(windows.shape[0])
        low, high = np.zeros(which.size, np.int64), np.full(which.size, self.n, np.int64)
        for k in range(windows.shape[1] - 1, -1, -1):
            symbol = windows[which, k]
            ranks = self.wavelet.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
            low, high = self.less[symbol] + ranks[: which.size], self.less[symbol] + ranks[which.size :]
            some = high > low
            which, low, high = which[some], low[some], high[some]
            if not which.size:
                break
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        out = np.empty(rows.size, np.int64)
        todo, steps = np.arange(rows.size), 0
        while todo.size:
            there = self.sampled.get(rows).astype(bool)
            out[todo[there]] = self.positions[self.sampled.rank(rows[there])] + steps
            todo, rows = todo[~there], rows[~there]
            if todo.size:
                symbol, before = self.wavelet.access(rows)
                rows = self.less[symbol] + before
                steps += 1
        return out


class Windows:
    """The test phrases of a block of benchmark items: every ``size`` consecutive words of an item,
    or the whole of a shorter one. Items without words have none; a null item_id names no item, but
    its windows count."""

    def __init__(self, items: list[tuple[object, str | None]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({str(i) for i, _ in items if i is not None})
        at = {x: k for k, x in enumerate(self.names)}
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item_id, text in items:
            numbers = np.asarray([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int64)
            if numbers.size:
                width = min(size, numbers.size)
                found.setdefault(width, []).append((np.lib.stride_tricks.sliding_window_view(numbers, width), -1 if item_id is None else at[str(item_id)]))
        #: for each length: its different windows, how many items each has, and these items in turn
        self.by_length = []
        for _, parts in sorted(found.items()):
            owner = np.repeat([o for _, o in parts], [len(w) for w, _ in parts])
            rows, which = np.unique(np.concatenate([w for w, _ in parts]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack((which.ravel(), owner), 1)[owner >= 0], axis=0)
            self.by_length.append((rows, np.bincount(pairs[:, 0], minlength=len(rows)), pairs[:, 1]))


def _search_shard(numbers: list[np.ndarray], windows: Windows, sample: int) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
    """Merged word spans and item names of each document of a shard."""
    ends = np.cumsum([a.size + 1 for a in numbers])
    text = np.zeros(int(ends[-1]), np.int64)
    starts = ends - [a.size + 1 for a in numbers]
    for a, s in zip(numbers, starts.tolist(), strict=True):
        text[s : s + a.size] = a
    spans: list[list[tuple[int, int]]] = [[] for _ in numbers]
    items: list[list[str]] = [[] for _ in numbers]
    index = FMIndex(text, len(windows.vocabulary), sample)
    edge = np.zeros(text.size + 1, np.int64)
    pairs = []
    for rows, n_owners, owners in windows.by_length:
        which, low, high = index.search(rows)
        if not which.size:
            continue
        count = high - low
        suffixes = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = index.locate(suffixes)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + rows.shape[1], -1)
        hit = np.unique(np.searchsorted(ends, at, "right") * len(rows) + np.repeat(which, count))  # (document, window)
        doc, w = hit // len(rows), hit % len(rows)
        own = n_owners[w]
        first = np.cumsum(n_owners)[w] - own
        pairs.append(np.repeat(doc, own) * (len(windows.names) + 1) + owners[np.repeat(first, own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)])
    if pairs:
        for pair in np.unique(np.concatenate(pairs)).tolist():
            items[pair // (len(windows.names) + 1)].append(windows.names[pair % (len(windows.names) + 1)])
        covered = np.concatenate(([0], (np.cumsum(edge) > 0).astype(np.int8)))
        change = np.diff(covered)
        for begin, end in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True):
            d = int(np.searchsorted(ends, begin, "right"))
            spans[d].append((begin - int(starts[d]), end - int(starts[d])))
    return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans, in order; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words in ``spans``; one space stands where a span was."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    parts, done = [], 0
    for b, e in spans:
        parts += [raw[done : at[b][0]].rstrip(b" ")]
        done = at[e - 1][1]
    tail = raw[done:]
    return (b" ".join([*parts, tail.lstrip(b" ")]) if parts else raw).decode("utf-8", "surrogatepass")


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[bool, list[tuple[object, str | None]]]]:
    """The benchmark's items in blocks of about ``block_bytes`` of text each; whether it is the last.

    Equal rows are one item; items are dealt by id and text, so many items of one text are spread too.
    """
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    n = size // block_bytes + 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield k == n - 1, [(r["item_id"], r["text"]) for r in part.collect()]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    shard_words: int = 500_000, sample: int = 16, block_bytes: int = 4 << 20, carry: bool = False, cut: bool = False,
) -> DataFrame:
    """For each row of ``docs``: its text, ``n_words``, the merged ``spans`` of words inside any
    occurrence of a test window (begin inclusive, end exclusive), and the ``items`` that occur.

    No shuffle: each task indexes the shards of its own rows. A benchmark larger than
    ``block_bytes`` is searched block by block, the result so far being written in between. Null and
    empty texts have no words; repeated rows each get their row; an empty benchmark hits nothing.
    ``carry`` adds the input row as ``row``; ``cut`` removes the spans from ``text``, and texts
    without a hit, null ones too, stay as they are.
    """
    rows = texts(docs, id_col, text_col, carry)
    extra = ["row"] if carry else []
    rows = rows.selectExpr("doc_id", "text", "0L AS n_words", "cast(array() AS array<struct<begin:long,end:long>>) AS spans", "cast(array() AS array<string>) AS items", *extra)
    schema = rows.schema
    spark = docs.sparkSession
    for k, (last, block) in enumerate(_blocks(benchmark, item_col, item_text_col, block_bytes)):
        if k:
            rows = materialise(rows, "leaks")
        windows = spark.sparkContext.broadcast(Windows(block, window))

        def run(batches: Iterator[pa.RecordBatch], windows=windows, cut=cut and last) -> Iterator[pa.RecordBatch]:
            w = windows.value
            number = w.vocabulary.get

            def closed(batch: pa.RecordBatch, numbers: list[np.ndarray]) -> pa.RecordBatch:
                spans, items = _search_shard(numbers, w, sample)
                old_spans, old_items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
                spans = [merged([*((x["begin"], x["end"]) for x in a), *b]) if a else b for a, b in zip(old_spans, spans, strict=True)]
                items = [sorted({*a, *b}) for a, b in zip(old_items, items, strict=True)]
                text = batch.column(1)
                if cut and any(spans):
                    text = pa.array([without_spans(t, s) if s else t for t, s in zip(text.to_pylist(), spans, strict=True)], pa.string())
                columns = [
                    batch.column(0), text, pa.array([a.size for a in numbers], pa.int64()),
                    pa.array([[{"begin": b, "end": e} for b, e in x] for x in spans], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                    pa.array(items, pa.list_(pa.string())), *batch.columns[5:],
                ]
                return pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_words", "spans", "items", *extra])

            for batch in batches:
                numbers, total, begin = [], 0, 0
                for k, text in enumerate(batch.column(1)):
                    words = words_of(text.as_py())
                    numbers.append(np.fromiter((number(x, 0) for x in words), np.int64, len(words)))
                    total += len(words) + 1
                    if total >= shard_words:
                        yield closed(batch.slice(begin, k + 1 - begin), numbers)
                        numbers, total, begin = [], 0, k + 1
                if numbers:
                    yield closed(batch.slice(begin), numbers)

        rows = rows.mapInArrow(tidy(run), schema)
    return rows
