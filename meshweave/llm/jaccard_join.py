"""N-gram Jaccard join by T-occurrence search (DivideSkip) over inverted lists.

1. Each text becomes the set of its distinct word shingles, as 64-bit hashes. Equal sets are one
   *class*, represented by its least document; all that follows is between classes.
2. Classes are dealt to *families*: MinHash band collisions (``bands`` of ``rows`` hashes) join
   classes, and a family is a connected component of that. A pair at the threshold fails to collide
   with probability (1 - 0.8^5)^50 < 3e-9, and is still in one family if others connect it.
3. Within a family each class is searched for in the inverted lists of the family: for a query of n
   shingles an answer shares at least T of them. The L longest lists are set aside; the others are
   merged with a heap, which leaves the classes found T - L times or more; those are looked up in
   the long lists by binary search, and dropped as soon as T is out of reach.
4. Classes already known to be in one component need no further check, so a family of m copies gives
   at most m - 1 links unless ``forest`` is off. Components follow from the links.

A family larger than ``block`` is cut into blocks, and a task holds two blocks at a time however large
the family. First each block meets the first one, which is searched in itself too; what is then in one
component with the largest one of the first block need not be compared with itself any more. Only the
others ask all blocks. So a family of m near copies of each other sends some 2 m texts, and one with r
others (m + r m / block) more. With all links wanted, all pairs of blocks meet.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, texts, tidy, Sieve
from .graph import components

# Bytes of UTF-8 text: A-Z become a-z, white space becomes the space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sorted distinct shingle hashes of a text; word hashes are cached up to a bound."""

    def __init__(self, n: int, most: int = 120_000):
        from xxhash import xxh3_64_intdigest

        self.n, self.digest, self.cache, self.most = n, xxh3_64_intdigest, {}, most

    def of(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ")
        words = [w for w in raw if w]
        if not words:
            return np.empty(0, np.uint64)
        cache = self.cache
        try:
            h = np.array([*map(cache.__getitem__, words)], np.uint64)
        except KeyError:
            if len(cache) > self.most:
                cache.clear()
            cache.update((w, self.digest(w)) for w in words if w not in cache)
            h = np.array([*map(cache.__getitem__, words)], np.uint64)
        width = min(self.n, h.size)
        out = np.full(h.size - width + 1, np.uint64(width))
        for k in range(width):
            out = _mix(out * _M1 + h[k : h.size - width + 1 + k])
        return np.unique(out)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set."""
    if not s.size:
        return 0, 0
    return int(np.bitwise_xor.reduce(_mix(s * _M3)).view(np.int64)), int(np.add.reduce(_mix(s + _M1)).view(np.int64))


class MinHash:
    """Band keys of shingle sets: ``bands`` keys, each of ``rows`` minima."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20_240_229)
        self.factor = rng.integers(0, 1 << 31, (bands * rows, 1), np.uint32) * np.uint32(2) + np.uint32(1)
        self.bands, self.rows = bands, rows

    def of(self, s: np.ndarray) -> np.ndarray:
        x = (s >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        for k in range(0, x.size, 2048):
            np.minimum(least, (self.factor * x[k : k + 2048]).min(1), out=least)
        least = least.reshape(self.bands, self.rows).astype(np.uint64)
        key = np.arange(self.bands, dtype=np.uint64)
        for k in range(self.rows):
            key = _mix(key * _M1 + least[:, k])
        return key.view(np.int64)


def shingle_sets(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """``doc_id``, ``n`` (set size), ``f1``, ``f2`` (its fingerprint) and its band ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, minhash = Shingler(shingle), MinHash(bands, rows)
        for batch in batches:
            n, f1, f2, keys = [], [], [], []
            for text in batch.column(1):
                s = shingler.of(text.as_py())
                a, b = fingerprint(s)
                n.append(s.size)
                f1.append(a)
                f2.append(b)
                keys.append(minhash.of(s) if s.size else np.empty(0, np.int64))
            offsets = np.cumsum([0, *(k.size for k in keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "n", "f1", "f2", "keys"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(tidy(run), f"doc_id {kind}, n long, f1 long, f2 long, keys array<long>")


class Lists:
    """Inverted lists of a block of sets, numbered in order of size."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.asarray([s.size for s in sets])
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        by = np.argsort(flat, kind="stable")
        self.owner = owner[by]
        self.tokens, first = np.unique(flat[by], return_index=True)
        self.first = np.append(first, flat.size)

    def search(self, query: np.ndarray, num: int, den: int, skip: np.ndarray, start: int = 0, mu: float = 0.0085) -> np.ndarray:
        """Sets from ``start`` on, at least as large as the query and not in ``skip``, with
        den * |intersection| >= num * |union|."""
        n = query.size
        low, high = np.searchsorted(self.sizes, n), np.searchsorted(self.sizes, n * den // num, "right")
        low = max(int(low), start)
        if low >= high:
            return np.empty(0, np.int64)
        at = np.searchsorted(self.tokens, query)
        at = at[self.tokens[np.minimum(at, self.tokens.size - 1)] == query]
        least = -(-num * 2 * n // (num + den))  # T for an answer of the query's own size
        if at.size < least:
            return np.empty(0, np.int64)
        begin, end = self.first[at], self.first[at + 1]
        lists = [self.owner[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
        if high - low < self.sizes.size:
            lists = [x[np.searchsorted(x, low) : np.searchsorted(x, high)] for x in lists]
        lists = sorted((x for x in lists if x.size), key=len)
        if len(lists) < least:
            return np.empty(0, np.int64)
        longest = lists[-1].size
        n_long = min(least - 1, int(least / (mu * np.log2(longest + 1) + 1)))
        short, long_ = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        short = [x[~skip[x]] for x in short]
        runs = [(k, sum(1 for _ in g)) for k, g in groupby(heapq.merge(*(x.tolist() for x in short if x.size)))]
        found, count = np.asarray([k for k, _ in runs], np.int64), np.asarray([c for _, c in runs], np.int64)
        need = -(-num * (n + self.sizes[found]) // (num + den))
        keep = count + n_long >= need
        found, count, need = found[keep], count[keep], need[keep]
        for k, x in enumerate(long_):
            if not found.size:
                break
            p = np.searchsorted(x, found)
            count = count + (x[np.minimum(p, x.size - 1)] == found)
            if k % 8 == 7 or k == n_long - 1:
                keep = count + (n_long - 1 - k) >= need
                found, count, need = found[keep], count[keep], need[keep]
        return found[count >= need]


class _Union:
    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: int, b: int) -> None:
        x, y = self.of[a], self.of[b]
        if x != y:
            self.of[self.of == max(x, y)] = min(x, y)


def search_blocks(ids: list[int], sets: list[np.ndarray], own: np.ndarray, num: int, den: int, forest: bool, hub: bool = False) -> tuple[list[tuple[int, int]], list[int]]:
    """Links within a block, or between two blocks (``own`` tells them apart) but not within either.

    With ``hub`` also within both: first in the first block, whose largest component is the hub. Second, the
    members that are not in the hub's component.
    """
    order = np.lexsort((ids, [s.size for s in sets]))
    ids, sets, own = [ids[k] for k in order], [sets[k] for k in order], own[order]
    blocks = np.unique(own).tolist()
    homes = {b: np.flatnonzero(own == b) for b in blocks}
    lists = {b: Lists([sets[k] for k in home]) for b, home in homes.items()}
    joined = _Union(len(sets))
    out = []

    def search(q: int, other: int) -> None:
        # the smaller of a pair asks the other's block; of equal sizes, the earlier one
        home = homes[other]
        start = int(np.searchsorted(home, q, "right"))
        if start == home.size:
            return
        skip = joined.of[home] == joined.of[q] if forest else np.zeros(home.size, bool)
        for r in lists[other].search(sets[q], num, den, skip, start).tolist():
            found = int(home[r])
            if ids[q] == ids[found] or forest and joined.of[q] == joined.of[found]:
                continue
            out.append((ids[q], ids[found]))
            joined.join(q, found)

    if not hub:
        for q in range(len(sets)):
            search(q, blocks[0] if own[q] == blocks[-1] else blocks[-1])
        return out, []
    first = homes.get(0, np.empty(0, np.int64)).tolist()
    for q in first:
        search(q, 0)
    roots, sizes = np.unique(joined.of[first], return_counts=True)
    main = first[int(np.flatnonzero(joined.of[first] == roots[sizes.argmax()])[0])] if first else None
    for q in range(len(sets)):
        for b in blocks:
            if b or own[q]:
                search(q, b)
    return out, [ids[k] for k in range(len(sets)) if main is None or joined.of[k] != joined.of[main]]


def links(members: DataFrame, shingle: int, num: int, den: int, forest: bool) -> DataFrame:
    """Links ``u``, ``v`` within the families of ``members`` (``family``, ``block`` and ``other``, the
    blocks that meet, ``own``, the member's block, ``rep``, ``f1``, ``f2``, ``text``). Without ``v``: a
    member that is not in the component of the first block's largest one (with ``forest`` alone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        key, ids, sets, own, seen = None, [], [], [], set()

        def done() -> pa.RecordBatch:
            hub = forest and key[2] > 0
            found, others = [], []
            if len(ids) > 1 and (hub or key[1] == key[2] or len(set(own)) > 1):
                found, others = search_blocks(ids, sets, np.asarray(own), num, den, forest, hub)
            if hub and key[2] > 1:  # those of the first block are told with the second one
                first = {i for i, o in zip(ids, own, strict=True) if o == 0}
                others = [i for i in others if i not in first]
            both = [*found, *((i, None) for i in others)]
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in both], pa.int64()), pa.array([b for _, b in both], pa.int64())], ["u", "v"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(7)]
            for family, block, other, mine, rep, f1, f2, text in zip(*columns, batch.column(7), strict=True):
                if (family, block, other) != key:
                    if ids:
                        yield done()
                    key, ids, sets, own, seen = (family, block, other), [], [], [], set()
                if (mine, rep, f1, f2) in seen:  # another row of the id with an equal text
                    continue
                s = shingler.of(text.as_py())
                if fingerprint(s) == (f1, f2):
                    seen.add((mine, rep, f1, f2))
                    ids.append(rep)
                    sets.append(s)
                    own.append(mine)
        if ids:
            yield done()

    parts = members.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = members.repartition(int(parts), "family", "block", "other").sortWithinPartitions("family", "block", "other", "rep")
    return dealt.select("family", "block", "other", "own", "rep", "f1", "f2", "text").mapInArrow(tidy(run), "u long, v long")


def _met(reps: DataFrame, sieve: Sieve) -> DataFrame:
    """``key`` and ``rep`` of the keys that may be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            key, count = column.flatten().to_numpy(), column.value_lengths().to_numpy()
            keep = sieve.holds(key)
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(np.repeat(batch.column(0).to_numpy(), count)[keep])], ["key", "rep"])

    return reps.mapInArrow(run, "key long, rep long")


def _with_id_in(rows: DataFrame, sieve: Sieve) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sieve.holds(batch.column(0).to_numpy())))

    return rows.mapInArrow(run, "doc_id long, text string")


def _others(large: DataFrame, others: DataFrame, block: int) -> DataFrame:
    """Groups in which ``others`` ask the blocks of their families."""
    asking = materialise(large.join(others, "rep", "left_semi"), "asking")
    chunks = asking.groupBy("family").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks"))
    # A block is the index of each chunk of others; an asking member has its own number, as has the chunk.
    index = large.join(chunks, "family").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("block", F.col("own")).withColumn("own", F.lit(0))
    asks = asking.join(chunks, "family").withColumn("other", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("chunks")).cast("int"))
    asks = asks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("own", F.lit(1))
    return index.unionByName(asks).withColumn("other", -1 - F.col("other"))  # no number of a block


def jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100, bands: int = 50, rows: int = 5, block: int = 2048, forest: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Two tables: one row per input row with ``doc_id``, ``n_shingles``, ``rep`` (the class) and
    ``component_id``; and the links ``u``, ``v`` between classes.

    Texts without words, null ones too, have the empty set and are linked with nothing, also not
    with each other. Rows with equal text are one class. A row with a null id is in no component
    (null). Rows that repeat an id are documents of their own with the same name.
    """
    rows_in = texts(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text")
    sets = materialise(shingle_sets(rows_in, shingle, bands, rows), "shingles")
    some = sets.where("n > 0 AND doc_id IS NOT NULL")
    classes = materialise(some.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")), "sets")
    reps = materialise(some.join(classes, ["f1", "f2"]).where("doc_id = rep").select("rep", "f1", "f2", "keys"), "classes")
    keyed = reps.select(F.explode("keys").alias("key"), "rep")  # a key has its band mixed in
    near = keyed.groupBy("key").agg(F.min("rep").alias("v"), F.max("rep").alias("w")).where("v < w").select("key", "v")
    near = materialise(near, "keys")
    edges = _met(reps.select("rep", "keys"), Sieve(near.select("key"))).join(near, "key").where("rep <> v").select(F.col("rep").alias("u"), "v").distinct()
    families = components(edges, "families").select(F.col("node").alias("rep"), F.col("component").alias("family"))
    families = materialise(families.join(reps.select("rep", "f1", "f2").distinct(), "rep"), "families")
    sizes = families.groupBy("family").agg(F.count("*").alias("m"))
    dealt = families.join(sizes, "family").withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    dealt = materialise(dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).select("family", "blocks", "own", "rep", "f1", "f2"), "dealt")
    near_texts = materialise(_with_id_in(rows_in.where("doc_id IS NOT NULL"), Sieve(families.select("rep"))), "near-texts")

    def searched(groups: DataFrame) -> DataFrame:
        members = groups.join(near_texts.withColumnRenamed("doc_id", "id"), F.col("rep") == F.col("id")).drop("id")
        return materialise(links(members, shingle, num, den, forest), "links")

    columns = ["family", "block", "other", "own", "rep", "f1", "f2"]
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    if forest:  # the first block meets each other one
        met = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).when(F.col("own") == 0, F.filter(every, lambda k: k > 0)).otherwise(F.array("own")))
        first = dealt.withColumn("other", met).withColumn("block", F.lit(0))
    else:
        first = dealt.withColumn("met", F.explode(every)).withColumns({"block": F.least("own", "met"), "other": F.greatest("own", "met")})
    found = searched(first.select(*columns))
    others = found.where("v IS NULL").select(F.col("u").alias("rep")).distinct()
    if forest and not others.isEmpty():
        found = found.union(searched(_others(dealt.where("blocks > 1"), others, block).select(*columns)))
    found = found.where("v IS NOT NULL")
    joined = components(found, "components").withColumnRenamed("node", "rep")
    named = classes.join(joined, "rep", "left").select("f1", "f2", "rep", F.coalesce("component", "rep").alias("component_id"))
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), "f1", "f2").join(named, ["f1", "f2"], "left")
    whole = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep"), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return whole.select(F.col("doc_id"), "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")), found
