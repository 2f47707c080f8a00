"""Toxicity by two class-conditional Kneser-Ney bigram models with a shared backoff.

For each class y (toxic, ordinary), with N_y(. v w) the distinct words that precede the pair v w in a
bounded sample of labelled documents (``max_docs`` of each class), and N_y(. w) those that precede w:

    P_y(w | v) = (N_y(. v w) - D)+ / N_y(. v .) + l_y(v) (S(w | v) + s(v) P_y(w))
    P_y(w)     = (N_y(. w) - D)+ / N_y(. .) + b_y P_y(t) P(w) / P(t)        t: the stem of w
    P_y(t)     = (N_y(. t) - D)+ / N_y(. .) + d_y P(t)
    S(w | v)   = (c(v w) - D)+ / c(v)          P(w) ~ N(. w) + 1/2

D depends on the count: it is estimated from the counts of counts, for each class and each order
(``estimated``); pairs after one word only are cut off, D being 1 there, so that the sample's frequent
pairs are all that has to be counted in the corpus. l_y(v), s(v), b_y and d_y are what the discounts leave,
of a head as a whole, so that P_y(. | v) sums to 1 over the vocabulary, the other words of a stem, and those
of other stems, being one each. A stem is a word's first ``STEM`` characters: forms and compounds that the
sample lacks are as likely in a class as others of their stem. The
backoff S and P is shared by both classes and counted in *all* documents: c(v w) how often a pair occurs,
N(. w) how many distinct words precede w; P(t) sums over the words of t. So a rare expression of which
neither class has the stem says nothing either way, and a passage that is copied from document to document
is as likely in both classes, even if more of its labelled copies are toxic. S is counted for the pairs that
a class has left after its discount, and 0 for others. Each document begins with a start symbol.

N(. w) is exact and needed for the words of the sample alone (for another word both classes give
b_y P_y(t) P(w) / P(t), whose ratio has no P(w)); all other words of a stem share one count, of their
occurrences. A word is told by a number, whose upper bits are those of its stem. A task turns
each pair into one number (the word's place in the sample's list, and 38 bits of the hash of the word
before), scrambles it one to one, and sends its distinct numbers in sorted runs by their top bits, as
differences. So pairs of any word, however frequent, are spread evenly, and a task counts the distinct
pairs of one run at a time. Two heads of a word coincide with probability 2^-38.

A document is compared by the length-normalised log-likelihood ratio of the two models, of the whole
document, of its most toxic passages (runs of ``PASSAGES`` words) and of its most toxic words (``TOPS``), as
a few words among many must not be diluted. A logistic curve turns these into a probability. It is fitted on the sample's documents,
each compared by models of the other parts of the sample (``PARTS``), so that no label is spent on the curve
alone; the corpus is counted once for the models of the whole sample and of all parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.shared import discard
from .common import Numbers, materialise, texts, tidy
from .labels import fold, known, sample

_WORD = re.compile(r"[^\W_]+")
_FAST = re.compile(r"\w+")  # the same words, where no underscore is
START = 0x9E3779B97F4A7C15  # the number of the start symbol
HEAD_BITS = 38
_HEAD = np.uint64((1 << HEAD_BITS) - 1)
STEM = 6
_CHUNK = 12  # bits of the places that are sent together
_MULTIPLY = 0xBF58476D1CE4E5B9
_BACK = pow(_MULTIPLY, -1, 1 << 64)
#: Lengths in words of the passages that are compared besides the whole document.
PASSAGES = (1, 4, 16, 64)
#: Ranks of the words whose ratios are compared too: insults are scattered one by one.
TOPS = (2, 4, 8, 16)
N_FEATURES = 3 + len(PASSAGES) + len(TOPS)
#: Discounts of counts of 1, 2, and 3 or more, where there are too few counts to estimate them.
DISCOUNTS = (1.0, 1.6, 2.0)
#: Parts of the sample, each left out once.
PARTS = 4


def scrambled(a: np.ndarray, bits: int) -> np.ndarray:
    """A one-to-one mapping of numbers below ``2 ** bits`` that spreads them evenly."""
    low = np.uint64((1 << bits) - 1)
    a = a * np.uint64(_MULTIPLY) & low
    return (a ^ (a >> np.uint64((bits + 1) // 2))) * np.uint64(_MULTIPLY) & low


def unscrambled(a: np.ndarray, bits: int) -> np.ndarray:
    low = np.uint64((1 << bits) - 1)
    a = a * np.uint64(_BACK) & low
    return (a ^ (a >> np.uint64((bits + 1) // 2))) * np.uint64(_BACK) & low


def _words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return _WORD.findall(text) if "_" in text else _FAST.findall(text)


class _Stemmed(Numbers):
    """The hash of the first ``STEM`` characters, then ``HEAD_BITS`` bits of the word's."""

    def __missing__(self, word: str) -> int:
        whole = super().__missing__(word)
        stem = self.digest(word[:STEM].encode("utf-8", "replace")) if len(word) > STEM else whole
        self[word] = number = stem >> HEAD_BITS << HEAD_BITS | whole & ((1 << HEAD_BITS) - 1)
        return number


class Words:
    """The words of texts as 64-bit numbers."""

    def __init__(self, most: int = 200_000):
        self.number = _Stemmed(most).__getitem__

    def several(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts, a start symbol before each text; and how many words each has."""
        flat: list[int] = []
        sizes = []
        for text in texts:
            flat.append(START)
            flat += map(self.number, _words_of(text))
            sizes.append(len(flat))
        ends = np.array([0, *sizes], np.int64)
        return np.array(flat, np.uint64), np.diff(ends) - 1


def places(vocabulary: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """From 1 on, where hashes are in the vocabulary (sorted); 0 for others."""
    if not vocabulary.size:
        return np.zeros(flat.size, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, flat), vocabulary.size - 1)
    return np.where(vocabulary[at] == flat, at + 1, 0)


def stems_of(numbers: np.ndarray) -> np.ndarray:
    return numbers >> np.uint64(HEAD_BITS)


def _inner(sizes: np.ndarray) -> np.ndarray:
    """Where the words are among the words and start symbols."""
    inner = np.ones(int(sizes.sum()) + sizes.size, bool)
    inner[np.cumsum(sizes + 1) - sizes - 1] = False
    return np.flatnonzero(inner)


def _slices(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, list[str | None]]]:
    """Consecutive texts of about ``most`` characters in all, and where they begin."""
    begin, some, size = 0, [], 0
    for k, text in enumerate(texts):
        some.append(text.as_py())
        size += len(some[-1] or "")
        if size >= most:
            yield begin, some
            begin, some, size = k + 1, [], 0
    if some:
        yield begin, some


def class_pairs(rows: DataFrame) -> DataFrame:
    """``head``, ``word``, ``n0`` and ``n1``: N_y(. v w) of each pair in the sample ``(y, part, text)``, and
    without each part p: ``n0_p``, ``n1_p``. Before the first pair of a text stands the start symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            labels, parts = (batch.column(k).to_numpy().astype(np.int32) for k in (0, 1))
            for begin, some in _slices(batch.column(2)):
                flat, sizes = words.several(some)
                at = _inner(sizes)
                before = np.where(flat[at - 1] == np.uint64(START), np.uint64(START), flat[np.maximum(at - 2, 0)])
                y, part = (np.repeat(x[begin : begin + len(some)], sizes) for x in (labels, 1 << parts))
                yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(part), *(pa.array(x.view(np.int64)) for x in (before, flat[at - 1], flat[at]))], ["y", "parts", "before", "head", "word"])

    found = rows.select("y", "part", "text").mapInArrow(tidy(run), "y int, parts int, before long, head long, word long").repartition("head", "word")  # one shuffle for both
    found = found.groupBy("y", "before", "head", "word").agg(F.bit_or("parts").alias("parts"))
    n = [F.sum((F.col("y") == y).cast("long")).alias(f"n{y}") for y in (0, 1)]
    n += [F.sum(((F.col("y") == y) & (F.col("parts") != 1 << p)).cast("long")).alias(f"n{y}_{p}") for y in (0, 1) for p in range(PARTS)]
    return materialise(found.groupBy("head", "word").agg(*n), "class-pairs")


def _runs(keys: np.ndarray, bits: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Sorted distinct numbers below ``2 ** bits`` by their top bits: of each run its bucket, and its
    differences, each in so many bytes as most need (told by the first byte). The largest number of so
    many bytes stands for itself without a key, and what is beyond it follows."""
    shift = bits - (buckets.bit_length() - 1)
    bucket = (keys >> np.uint64(shift)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for begin, end in zip(cuts.tolist(), [*cuts[1:].tolist(), keys.size][: cuts.size], strict=True):
        gaps = np.diff(keys[begin:end], prepend=np.uint64(int(bucket[begin]) << shift))
        width = min(8, (int(gaps.mean()).bit_length() + 9) // 8)
        top = (1 << 8 * width) - 1
        more = (gaps // np.uint64(top)).astype(np.int64)
        out = np.full(gaps.size + int(more.sum()), top, "<u8")
        out[np.arange(gaps.size) + np.cumsum(more)] = gaps - more.astype(np.uint64) * np.uint64(top)
        yield int(bucket[begin]), bytes([width]) + out.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _of_run(bucket: int, run: bytes, bits: int, buckets: int) -> np.ndarray:
    width = run[0]
    wide = np.zeros(((len(run) - 1) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(run, np.uint8, offset=1).reshape(-1, width)
    steps = wide.reshape(-1).view("<u8")
    keys = np.cumsum(steps, dtype=np.uint64) + np.uint64(bucket << bits - (buckets.bit_length() - 1))
    return keys[steps != np.uint64((1 << 8 * width) - 1)]


def shared_counts(docs: DataFrame, vocabulary: np.ndarray, pairs: np.ndarray, buckets: int | None = None, most: int = 1 << 21, n_chars: int = 0) -> DataFrame:
    """``place`` and ``n`` over all documents. For a word of the vocabulary, from 1 on, N(. w); then, for
    ``pairs`` (see ``pair_key``, sorted), how often each occurs; how often each place of the vocabulary (0 is
    the start symbol) is a head; and how often words outside the vocabulary have each of its stems (0 is
    any other stem). ``most`` pairs are held by
    a task before it sends them. There are as many buckets as keep each below some ``2 * most`` pairs, if the
    documents have ``n_chars`` characters, six to a word."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = buckets or max(1024, 1 << (8 * parts - 1).bit_length(), 1 << (n_chars // (12 * most)).bit_length())
    stems = np.unique(stems_of(vocabulary))
    listed = spark.sparkContext.broadcast((vocabulary, pairs, stems))
    size = vocabulary.size + 1
    n_places = 2 * size + pairs.size + stems.size + 1
    bits = HEAD_BITS + vocabulary.size.bit_length()

    def packed(counts: np.ndarray) -> tuple[list[int], list[bytes], list[bytes]]:
        """The counts that are not 0 in chunks of places: the chunk, places and counts of each."""
        some = np.flatnonzero(counts)
        cuts = np.flatnonzero(np.diff(some >> _CHUNK, prepend=-1))
        ends = [*cuts[1:].tolist(), some.size][: cuts.size]
        parts = [some[b:e] for b, e in zip(cuts.tolist(), ends, strict=True)]
        wide = [np.min_scalar_type(counts[x].max()) for x in parts]
        inside = [(x & ((1 << _CHUNK) - 1)).astype("<u2").tobytes() for x in parts]
        return [int(x[0] >> _CHUNK) for x in parts], inside, [counts[x].astype(t).tobytes() for x, t in zip(parts, wide, strict=True)]

    def unpacked(place: pa.Scalar, n: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        """Places in their chunk, and counts, in as many bytes as the largest of the chunk needs."""
        at, n = np.frombuffer(place.as_py(), "<u2").astype(np.int64), n.as_py()
        return at, np.frombuffer(n, f"<u{len(n) // at.size}").astype(np.int64)

    def row(bucket: list[int], run: list[bytes] | None = None, place: list[bytes] | None = None, n: list[bytes] | None = None) -> pa.RecordBatch:
        binary = (pa.nulls(len(bucket), pa.binary()) if x is None else pa.array(x, pa.binary()) for x in (run, place, n))
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *binary], ["bucket", "run", "place", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        vocabulary, pairs, stems = listed.value
        held: list[np.ndarray] = []
        n_held = 0
        counts = np.zeros(n_places, np.int64)

        def sent(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
            runs = [*_runs(keys, bits, n_buckets)]
            if runs:
                yield row([b for b, _ in runs], run=[r for _, r in runs])

        for batch in batches:
            for _, some in _slices(batch.column(0)):
                flat, sizes = words.several(some)
                place, at = places(vocabulary, flat), _inner(sizes)
                word, head = place[at], place[at - 1]
                begins = np.diff(at, prepend=-1) > 1
                if pairs.size:
                    both = np.flatnonzero((word > 0) & (begins | (head > 0)))  # no other pair can be among them
                    key = pair_key(head[both], word[both], begins[both], size)
                    found = np.minimum(np.searchsorted(pairs, key), pairs.size - 1)
                    counts[size : size + pairs.size] += np.bincount(found[pairs[found] == key], minlength=pairs.size)
                counts[size + pairs.size : 2 * size + pairs.size] += np.bincount(np.where(begins, 0, head)[begins | (head > 0)], minlength=size)
                counts[2 * size + pairs.size :] += np.bincount(places(stems, stems_of(flat[at[word == 0]])), minlength=stems.size + 1)
                at = at[word > 0]
                held.append(scrambled(place[at].astype(np.uint64) << np.uint64(HEAD_BITS) | flat[at - 1] & _HEAD, bits))
                n_held += at.size
                if n_held >= 2 * most:
                    keys = np.unique(np.concatenate(held))
                    held, n_held = [keys], keys.size
                    if n_held >= most:
                        yield from sent(keys)
                        held, n_held = [], 0
        if held:
            yield from sent(np.unique(np.concatenate(held)))
        chunks, where, n = packed(counts)
        yield row(chunks, place=where, n=n)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_places, np.int64)
        bucket, held = None, []

        def add() -> None:
            if held:
                place = (unscrambled(np.unique(np.concatenate(held)), bits) >> np.uint64(HEAD_BITS)).astype(np.int64)
                where, n = np.unique(place, return_counts=True)
                sums[where] += n

        for batch in batches:
            for b, r, where, n in zip(*batch.columns, strict=True):
                if r.is_valid:
                    if b.as_py() != bucket:
                        add()
                        bucket, held = b.as_py(), []
                    held.append(_of_run(bucket, r.as_py(), bits, n_buckets))
                else:
                    at, some = unpacked(where, n)
                    sums[(b.as_py() << _CHUNK) + at] += some
        add()
        chunks, where, n = packed(sums)
        yield row(chunks, place=where, n=n)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, _, where, n in zip(*batch.columns, strict=True):
                some = sums.setdefault(b.as_py(), np.zeros(1 << _CHUNK, np.int64))
                at, more = unpacked(where, n)
                some[at] += more
        for chunk, some in sums.items():
            at = np.flatnonzero(some)
            yield pa.RecordBatch.from_arrays([pa.array((chunk << _CHUNK) + at, pa.int64()), pa.array(some[at])], ["place", "n"])

    schema = "bucket int, run binary, place binary, n binary"
    runs = docs.select("text").mapInArrow(tidy(run), schema)
    dealt = runs.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(tidy(counted), schema).repartition(parts, "bucket").mapInArrow(tidy(summed), "place long, n long")


def pair_key(head: np.ndarray, word: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """A number for a pair of places; at the beginning of a text the start symbol is the head."""
    return np.where(begins, size, head) * size + word


def estimated(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Discounts of counts of 1, 2, and 3 or more, from how many things were counted once to four times.
    ``DISCOUNTS`` has the place of an estimate that is not between 0 and its count."""
    if not n1:
        return DISCOUNTS
    y = n1 / (n1 + 2 * n2)
    found = [k - (k + 1) * y * more / n if n else 0.0 for k, n, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(d if 0 < d < k else fixed for k, (d, fixed) in enumerate(zip(found, DISCOUNTS, strict=True), 1))


def kept(n: np.ndarray, discounts: tuple[float, ...]) -> np.ndarray:
    """What the discounts (for counts of 1, 2, and the last for more) leave of counts."""
    return np.maximum(n - np.interp(n, range(len(discounts) + 1), (0, *discounts)), 0)


@dataclass
class Models:
    """Both models. ``words`` is the vocabulary (sorted numbers) and ``stems`` its stems; the arrays by place
    have what is unknown at 0, and ``head`` has the start symbol last. ``pairs`` (see ``pair_key``) is sorted."""

    words: np.ndarray
    stems: np.ndarray
    word: np.ndarray  # (2, size): P_y(w); of unknown words b_y
    stem: np.ndarray  # (2, stems + 1): P_y(t) / P(t), of unknown stems d_y; P(w) is the same in both
    head: np.ndarray  # (2, size + 1): l_y(v)
    pairs: np.ndarray
    own: np.ndarray  # (2, pairs): what is left of N_y(. v w), over N_y(. v .)
    common: np.ndarray  # (2, pairs): S(w | v) and s(v)
    spare: np.ndarray  # (size + 1): s(v); 1 where S has no pair of v
    other: np.ndarray  # (stems + 1): P(w) of all unknown words of each stem

    @cached_property
    def _logs(self) -> tuple[np.ndarray, ...]:
        return tuple(np.log(x[1]) - np.log(x[0]) for x in (self.word, self.stem, self.head))

    def given(self, y: int, head: int) -> np.ndarray:
        """P_y(. | v) of a place, or of the start symbol (last): of all unknown words together, then of each word."""
        size = self.word.shape[1]
        own = self.word[y].copy()
        own[0] *= (self.stem[y] * self.other).sum()
        out = self.head[y, head] * self.spare[head] * own
        begin, end = np.searchsorted(self.pairs, (head * size, head * size + size))
        w = self.pairs[begin:end] - head * size
        out[w] += self.own[y, begin:end] + self.head[y, head] * self.common[0, begin:end]
        return out

    def ratios(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log P_toxic(w | v) - log P_ordinary(w | v) of all words of texts (see ``Words.several``)."""
        place, at = places(self.words, flat), _inner(sizes)
        w, v, begins = place[at], place[at - 1], np.diff(at, prepend=-1) > 1
        size = self.word.shape[1]
        of_word, of_stem, of_head = self._logs
        ratio = of_word[w]
        new = np.flatnonzero(w == 0)
        ratio[new] += of_stem[places(self.stems, stems_of(flat[at[new]]))]
        if self.pairs.size:
            both = np.flatnonzero((w > 0) & (begins | (v > 0)))
            key = pair_key(v[both], w[both], begins[both], size)
            found = np.minimum(np.searchsorted(self.pairs, key), self.pairs.size - 1)
            hit = np.flatnonzero(self.pairs[found] == key)
            found, has = found[hit], both[hit]
            w_, v_ = w[has], np.where(begins, size, v)[has]
            p = self.own[:, found] / self.head[:, v_] + self.common[0, found] + self.common[1, found] * self.word[:, w_]
            ratio[has] = np.log(p[1]) - np.log(p[0])
        return ratio + of_head[np.where(begins, size, v)]


def features(r: np.ndarray) -> list[float]:
    """Length-normalised log ratios: of the document, and the largest of a passage of each length; then the
    ratio of the ``TOPS``-th most toxic words, wherever they stand, and of the median word, which tells the
    level that the language has. A document shorter than a passage is one passage. The length itself
    tells how large the largest of so many passages or words is by chance."""
    if not r.size:
        return [0.0] * N_FEATURES
    sums = np.concatenate(([0.0], np.cumsum(r)))
    out = [float(r.mean()), float(np.log1p(r.size))]
    for width in PASSAGES:
        k = min(width, r.size)
        out.append(float((sums[k:] - sums[:-k]).max() / width))
    places = [max(r.size - k, 0) for k in TOPS] + [r.size // 2]
    return out + np.partition(r, places)[places].tolist()


def build_models(pairs: DataFrame, docs: DataFrame, n_chars: int = 0) -> Iterator[Models]:
    """The models of the sample's ``pairs`` without each part, and last of all of them, all backed off to the counts of
    ``docs``, of some ``n_chars`` characters. What reaches the driver is bounded by the sample: its words,
    its heads and the pairs that a discount leaves."""
    samples = (*(f"_{p}" for p in range(PARTS)), "")
    columns = [f"n{y}{s}" for s in samples for y in (0, 1)]
    counts_of = pairs.agg(*(F.sum((F.col(c) == k).cast("double")).alias(f"{c}k{k}") for c in columns for k in (1, 2, 3, 4))).first()
    # pairs after one word are cut off; what an estimate leaves of larger counts is above 0
    discounts = {c: (1.0, *estimated(*(counts_of[f"{c}k{k}"] or 0.0 for k in (1, 2, 3, 4)))[1:]) for c in columns}
    off = {c: F.least(F.col(c).cast("double"), _discount(c, discounts[c])) for c in columns}
    seen = pairs.groupBy("word").agg(*(F.sum((F.col(c) > 0).cast("double")).alias(c) for c in columns)).toArrow()
    heads = pairs.groupBy("head").agg(*(F.sum(F.col(c).cast("double")).alias(c) for c in columns), *(F.sum(off[c]).alias(f"{c}d") for c in columns)).toArrow()
    rich = pairs.where("n0 > 1 OR n1 > 1").toArrow()
    hashes = seen["word"].to_numpy().view(np.uint64)
    by = np.argsort(hashes)
    words = hashes[by]
    stems, stem_of = np.unique(stems_of(words), return_inverse=True)
    size = words.size + 1

    def place(column: pa.ChunkedArray) -> np.ndarray:
        """The start symbol is last; a head that is no word of the sample is 0."""
        h = column.to_numpy().view(np.uint64)
        return np.where(h == np.uint64(START), size, places(words, h))

    every_key = place(rich["head"]) * size + place(rich["word"])
    order = np.argsort(every_key)
    every_key = every_key[order]
    got = shared_counts(docs, words, every_key, n_chars=n_chars).toArrow()
    counts = np.zeros(2 * size + every_key.size + stems.size + 1)
    counts[got["place"].to_numpy()] = got["n"].to_numpy()
    base, of_pair, of_head, other = np.split(counts, (size, size + every_key.size, 2 * size + every_key.size))
    base = base[1:] + 0.5
    total = max(base.sum() + other.sum(), 0.5)
    base, other = base / total, other / total
    of_stem = other[1:] + np.bincount(stem_of, weights=base, minlength=stems.size)  # P(t)
    at = place(heads["head"])
    for s in samples:
        of_class = [rich[f"n{y}{s}"].to_numpy()[order].astype(float) for y in (0, 1)]
        here = np.maximum(*of_class) > 1
        keys = every_key[here]
        rich_head = keys // size
        shared = tuple(sum(d) / 2 for d in zip(discounts[f"n0{s}"], discounts[f"n1{s}"], strict=True))
        left = kept(of_pair[here], shared) / np.maximum(of_head[np.where(rich_head == size, 0, rich_head)], 1)
        spare = np.maximum(1 - np.bincount(rich_head, weights=left, minlength=size + 1), 1e-9)
        common = np.stack((left, spare[rich_head]))
        word, stem, head, own = (np.ones((2, n)) for n in (size, stems.size + 1, size + 1, keys.size))
        for y in (0, 1):
            count = seen[f"n{y}{s}"].to_numpy()[by]
            total = max(count.sum(), 1)
            share = kept(count, estimated(*(float((count == k).sum()) for k in (1, 2, 3, 4))))
            word[y, 0] = max(1 - share.sum() / total, 1e-9)
            count = np.bincount(stem_of, weights=count, minlength=stems.size)
            part = kept(count, estimated(*(float((count == k).sum()) for k in (1, 2, 3, 4)))) / total
            stem[y, 0] = max(1 - part.sum(), 1e-9)
            stem[y, 1:] = part / of_stem + stem[y, 0]
            word[y, 1:] = share / total + word[y, 0] * stem[y, 1:][stem_of] * base
            c, d = heads[f"n{y}{s}"].to_numpy(), heads[f"n{y}{s}d"].to_numpy()
            head[y, at] = np.where(c > 0, np.maximum(d, 1e-9) / np.maximum(c, 1), 1.0)
            over = np.ones(size + 1)
            over[at] = np.maximum(c, 1)
            own[y] = kept(of_class[y][here], discounts[f"n{y}{s}"]) / over[rich_head]
        yield Models(words, stems, word, stem, head, keys, own, common, spare, other)


def _discount(column: str, discounts: tuple[float, ...]):
    out = F.lit(float(discounts[-1]))
    for k in range(len(discounts) - 1, 0, -1):
        out = F.when(F.col(column) <= k, F.lit(float(discounts[k - 1]))).otherwise(out)
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method: centre, scale, and weights with the bias last."""
    ridge /= len(x)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    a = np.hstack(((x - centre) / scale, np.ones((len(x), 1))))
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) / weight.sum() + ridge * w
        h = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a / weight.sum() + ridge * np.eye(w.size)
        w -= np.linalg.solve(h, g)
    return centre, scale, w


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id: str = "doc_id",
    folds: int = 3, held_out: int = 1, threshold: float = 0.7, max_docs: int = 6_000,
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``docs``.

    At most ``max_docs`` labelled documents of each class, outside the held-out fold, make the models and
    fit the curve. Repeated rows are scored alike; null and empty texts are texts without words. If a
    class has no documents in two parts of the sample, so that nothing is left without one of them, the
    score is the share of toxic labels, or 0.
    """
    rows = texts(docs, id_col, text_col)
    spark = docs.sparkSession
    learnt = known(labels, label_col, label_id, folds, held_out).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(PARTS)).cast("int")).persist()
    chosen = [sample(learnt.where(F.col("y") == y), max_docs) for y in (0, 1)]
    n = {r["y"]: r["n"] for r in learnt.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_parts = {r["y"]: r["n"] for r in chosen[0].union(chosen[1]).groupBy("y").agg(F.countDistinct("part").alias("n")).collect()}
    curve, constant = None, n.get(1, 0) / max(1, sum(n.values()))
    if min(n_parts.get(y, 0) for y in (0, 1)) > 1:
        measure = Observation()
        measured = rows.observe(measure, F.sum(F.length("text")).alias("n_chars"))
        joined = measured.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")  # at most 2 * max_docs ids
        known_texts = materialise(joined.select("doc_id", "y", "part", "text"), "labelled")
        pairs = class_pairs(known_texts)
        unseen = []
        for p, model in enumerate(build_models(pairs, rows, measure.get["n_chars"] or 0)):
            models = spark.sparkContext.broadcast(model)
            if p < PARTS:
                unseen.append(_scored(known_texts.where(F.col("part") == p).select("y", "text"), models).toArrow())
                models.destroy()  # one at a time is on the executors' disks
        discard(pairs)
        discard(known_texts)
        got = pa.concat_tables(unseen)
        y = got["y"].to_numpy()
        x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES)
        weight = np.where(y == 1, n[1] / max(1, (y == 1).sum()), n[0] / max(1, (y == 0).sum()))
        if len(set(y.tolist())) == 2:
            curve = fit_curve(x, y, weight)
    learnt.unpersist()
    if curve is None:
        scored = rows.select("doc_id", F.lit(float(constant)).alias("score"))
    else:
        scored = _scored(rows, models, curve)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _scored(rows: DataFrame, models, curve: tuple | None = None) -> DataFrame:
    """The columns but ``text``, with the features ``x``, or with a curve the ``score``."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = models.value
        words = Words()
        for batch in batches:
            x = []
            for _, some in _slices(batch.column("text")):
                flat, sizes = words.several(some)
                r = model.ratios(flat, sizes)
                end = np.cumsum(sizes)
                x += [features(r[e - s : e]) for e, s in zip(end.tolist(), sizes.tolist(), strict=True)]
            if curve is None:
                last = pa.array(x, pa.list_(pa.float64()))
            else:
                centre, scale, w = curve
                a = (np.asarray(x, float).reshape(-1, centre.size) - centre) / scale
                last = pa.array(1 / (1 + np.exp(-np.clip(a @ w[:-1] + w[-1], -30, 30))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), last], [*names, "x" if curve is None else "score"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(tidy(run), f"{schema}, x array<double>" if curve is None else f"{schema}, score double")
