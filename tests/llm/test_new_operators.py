"""Exact deduplication, phrases and whitening against brute force, and the odd cases of each."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from meshweave.llm import collocations, embedding_dedup, exact_dedup, tool_calls, whitening

# exact deduplication

ODD = [
    (1, None, "x", "rep"), (2, "", "x", "rep"), (3, " \t\n\x0b\x0c\r", "x", "rep"), (4, "one two", "x", "rep"), (4, "one two", "x", "rep"), (5, "onetwo", "x", "rep"),
    (None, "one  two ", "x", "rep"), (None, "zwei", None, None), (7, "zwei", "x", "rep"), (8, "a b", "x", "rep"), (9, "ab", "x", "rep"), (10, "word " * 50_000, "x", "rep"),
    (11, " word" * 50_000, "x", "rep"), (12, "Straße \U0001f600", "x", "rep"), (13, "Straße\U0001f600\n", "x", "rep"),
]
CLASHING = "doc_id long, text string, members string, gid string"


def brute_copies(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for text, members in groups.items():
        members.sort()
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), k == 0, sha) for k, m in enumerate(members)]
    return sorted(out, key=repr)


def found_copies(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("settings", [{}, {"window": 1, "per_salt": 2}, {"window": 1, "per_salt": 1, "key_bytes": 1}])
def test_copies_equal_brute_force(spark, settings):
    """With one byte of the digest nearly every text collides with others, and stays apart from them."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 7))) for _ in range(400)] + ["c " * 9] * 150
    rng.shuffle(texts)
    rows = [*((k, t, "x", "rep") for k, t in enumerate(texts)), *ODD]
    docs = spark.createDataFrame(rows, CLASHING).repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = found_copies(exact_dedup.exact_duplicates(docs, **settings))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_copies([r[:2] for r in rows])


def test_copies_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_SENT", 0)
    assert found_copies(exact_dedup.exact_duplicates(spark.createDataFrame(ODD, CLASHING).repartition(4), window=1)) == brute_copies([r[:2] for r in ODD])


def test_rows_that_stay(spark):
    docs = spark.createDataFrame(ODD, CLASHING).repartition(5)
    got = exact_dedup.without_copies(docs, window=1)
    assert got.columns == docs.columns
    want = Counter(r[1] for r in brute_copies([r[:2] for r in ODD]) if r[3])
    assert Counter(r["doc_id"] for r in got.collect()) == want
    assert all(r["members"] in ("x", None) for r in got.collect())


def test_no_documents(spark):
    empty = spark.createDataFrame([], CLASHING)
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert exact_dedup.without_copies(empty).count() == 0
    assert collocations.collocations(empty.selectExpr("*", "'en' AS lang")).count() == 0


# phrases


def brute_phrases(rows, least, top, covered=80, longest=4):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = tuple(re.findall("[^\x20\x09]+", piece))
            n[lang] += len(words)
            f.update((lang, words[k : k + m]) for m in range(1, longest + 1) for k in range(len(words) - m + 1))
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, w), a in candidates.items():
        for m in range(2, len(w)):
            for k in range(len(w) - m + 1):
                inside[lang, w[k : k + m]] = max(inside[lang, w[k : k + m]], a)
    out = defaultdict(list)
    for (lang, w), a in candidates.items():
        if 100 * inside[lang, w] < covered * a or (lang, w) not in inside:
            score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, found in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def made_documents(rng, n):
    vocabulary = ["of", "the", "New", "york", "city", "école", "a b", "z\x1cz", "\U0001f600"]
    weights = [9, 8, 3, 3, 3, 2, 1, 1, 1]
    docs = [(None, None, None), (1, "en", None), (2, None, ""), (3, "en", " \t\n.,;"), (3, "en", " \t\n.,;"), (4, "", "new york city! " * 40)]
    for k in range(n):
        words = rng.choices(vocabulary, weights, k=rng.randint(0, 60))
        if rng.random() < 0.5:
            words += ["new", "york", "city", "hall"]
        docs.append((k, rng.choice(["en", "en", "en", "de", None]), "".join(w + rng.choice([" "] * 8 + ["\t", ". ", ",", "\n", "  ", "?"]) for w in words)))
    return docs


@pytest.mark.parametrize(("chunk", "paired"), [(1, 1 << 31), (16 << 20, 0)])
def test_phrases_equal_brute_force(spark, monkeypatch, chunk, paired):
    monkeypatch.setattr(collocations, "PAIRED_NAMES", paired)
    docs = made_documents(random.Random(8), 250)
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string").selectExpr("*", "'x' AS chunk", "'y' AS name").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = sorted(map(tuple, collocations.collocations(df, least=12, top=40, chunk=chunk, salts=3).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute_phrases([d[1:] for d in docs], 12, 40)
    assert got == want and len(want) > 60


def test_words_of_texts_cut_from_a_longer_array():
    import pyarrow as pa

    texts = pa.array(["skipped", "One, two  THREE", None, "", "four", "five\tsix", ".", "Ä b"]).slice(1).fill_null("")
    words, piece = collocations._words(texts)
    assert [w.as_py().decode() for w in words] == ["one", "two", "three", "four", "five", "six", "Ä", "b"]
    same = [a == b for a, b in zip(piece[:-1], piece[1:], strict=True)]
    assert same == [False, True, False, False, True, False, True]


def test_runs_without_phrases_are_packed():
    numbers = np.array([-1, -1, 3, -1, -1, -1, 4, 5, -1, -1])
    assert collocations._unpacked(collocations._packed(numbers)).tolist() == [-1, 3, -1, 4, 5, -1]
    assert collocations._unpacked(collocations._packed(np.zeros(0, np.int64))).size == 0


def test_one_very_long_text(spark):
    text = "alpha beta gamma. " * 60_000
    got = collocations.collocations(spark.createDataFrame([("en", text)], "lang string, text string")).collect()
    assert [(r["phrase"], r["a"], r["n"], r["score"]) for r in got] == [("alpha beta gamma", 60_000, 180_000, 1_000_000)]


# whitening


def check_whitening(rows, got, components=8):
    """Against NumPy on exact integers."""
    good = [(i, [float(c) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v) and len(v)]
    common = Counter(len(v) for _, v in good)
    d = min(k for k in common if common[k] == max(common.values()))
    good = [(i, v) for i, v in good if len(v) == d]
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in good], dtype=object)
    n, s = len(x), x.sum(0)
    exact = n * x - s
    y = exact.astype(np.float64) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, d)
    assert len(got) == n * k
    by_id = defaultdict(dict)
    for r in got:
        by_id[r["vec_id"]][r["component"]] = r
    for c in range(k):
        want = y @ axes[:, c] / np.sqrt(values[c])
        have = np.array([by_id[i][c + 1]["whitened"] for i, _ in good])
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < 1e-9
        r = by_id[good[0][0]][c + 1]
        assert abs(r["explained"] - values[c] / values.sum()) < 1e-12 and r["identity_error"] < 1e-9 and r["n"] == n
    assert [int(by_id[i][1]["deviation"]) for i, _ in good] == [int(q) for q in (exact * exact).sum(1)]


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12)) + 3).astype(np.float32)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    odd = [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, []), (905, [1.0] * 3), (906, [1e30] * 12)]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>").selectExpr("*", "'z' AS x", "1 AS component").repartition(5)
    check_whitening(rows, whitening.whiten(df).collect())


def test_whitening_of_other_types_and_few_dimensions(spark):
    rows = [(f"v{k}", [k * 0.1, (k * 7 % 11) * 3.5, (k * k % 5) - 1e6]) for k in range(60)]
    check_whitening(rows, whitening.whiten(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect())


def test_large_entries_stay_exact(spark):
    """Beyond 64 bits the integers are Python's."""
    rows = [(k, [((k * 7919) % 101) * 1e10, k * 1e9 - 3e10]) for k in range(40)]
    check_whitening(rows, whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())


def test_whitening_without_spread(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [0.5, 2.0]), (2, [0.5, 2.0]), (None, [0.5, 2.0])]):
        got = whitening.whiten(spark.createDataFrame(rows, kind))
        assert got.count() == 0 and got.columns[:3] == ["vec_id", "component", "n"]


def test_whitening_of_less_than_full_rank(spark):
    """Two directions of four have a spread; ids may be null and repeat."""
    rows = [(None if k % 5 == 0 else k % 7, [float(k % 6), float(k % 4), float(k % 6 + k % 4), 1.0]) for k in range(48)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 48 * 2 and max(r["component"] for r in got) == 2
    assert Counter(r["vec_id"] for r in got if r["component"] == 1) == Counter(r[0] for r in rows)
    assert all(r["identity_error"] < 1e-9 for r in got)


# schemas and numbers of tool calls


def test_schemas_of_any_form_are_defined():
    errors = tool_calls.errors_of
    assert errors({"x": 1}, {"properties": {"x": True}}) == [] and errors({"x": 1}, {"properties": {"x": False}}) == ["$.x: not allowed"]
    assert errors({"x": 1}, {"required": None, "enum": None, "properties": None, "items": None, "anyOf": None, "minimum": None}) == []
    assert errors([1, "a", 2.5], {"items": [{"type": "integer"}, {"type": "integer"}]}) == ["$[1]: not integer"]
    assert errors(True, {"enum": [1]}) == ["$: not in enum"] and errors(1.0, {"enum": [1]}) == [] and errors([True], {"const": [1]}) == ["$: not const"]
    assert errors({"a": {"b": [1]}}, {"const": {"a": {"b": [1.0]}}}) == []
    assert errors(5, {"minimum": 6}) == ["$: below minimum"] and errors(5, {"maximum": 4.5}) == ["$: above maximum"] and errors("z", {"minimum": 6}) == []
    assert errors("z", {"anyOf": [{"type": "integer"}, {"type": "null"}]}) == ["$: none of anyOf"] and errors(None, {"anyOf": [{"type": "integer"}, {"type": "null"}]}) == []
    assert errors({"a": 1, "b": "x"}, {"properties": {"a": {}}, "additionalProperties": {"type": "integer"}}) == ["$.b: not integer"]
    assert tool_calls.unchecked({"type": "object", "title": "t", "format": "f", "properties": {"a": {"pattern": "x"}}, "items": [{"minLength": 1}], "additionalProperties": {"maxItems": 2}}) == ["$.format", "$.properties.a.pattern", "$.items[0].minLength", "$.additionalProperties.maxItems"]


def test_any_schema_and_value_without_a_crash():
    rng = random.Random(7)
    words = [*tool_calls.CHECKED, "x", "$ref", "format"]

    def made(depth):
        k = rng.random()
        if depth == 0 or k < 0.4:
            return rng.choice([None, True, False, 0, 1, -2.5, 1e21, 10**30, "", "integer", "object", "x"])
        if k < 0.6:
            return [made(depth - 1) for _ in range(rng.randint(0, 3))]
        return {rng.choice(words): made(depth - 1) for _ in range(rng.randint(0, 4))}

    for _ in range(4000):
        value, schema = made(3), made(4)
        found = tool_calls.errors_of(value, schema)
        assert isinstance(found, list) and all(isinstance(x, str) for x in found)
        tool_calls.unchecked(schema)
        text = tool_calls.canonical(value)
        assert tool_calls.canonical(json.loads(text)) == text and tool_calls._same(json.loads(text), value)


def test_a_number_has_one_form():
    same = [("1e21", "1000000000000000000000", "1e+21"), ("1E2", "100.0", "100"), ("-0.0", "0", "0"), ("1e300", str(10**300), None)]
    for a, b, want in same[:3]:
        assert tool_calls.canonical(tool_calls.parse(a)) == tool_calls.canonical(tool_calls.parse(b)) == want
    assert tool_calls.canonical(9007199254740993) == "9007199254740993" and tool_calls.canonical(10**21 + 1) == str(10**21 + 1)
    assert tool_calls.canonical(10**400) == str(10**400)


# what is said of repeated ids of vectors


def test_repeated_ids_of_vectors(spark):
    """A row has the links of its own vector; vectors with the same smallest id are forms of one."""
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.999, 0.01]

    def of(rows):
        return sorted(tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame([(k, v, "l") for k, v in rows], "vec_id long, embedding array<double>, label string")).collect())

    assert of([(5, x), (5, y), (3, y), (7, z)]) == [(3, 2, 3, True), (5, 0, 5, True), (5, 2, 3, False), (7, 2, 3, False)]
    assert of([(5, x), (5, y), (7, z)]) == [(5, 1, 5, True), (5, 1, 5, True), (7, 1, 5, False)]


def test_no_row_of_a_chunk_grows_with_it(spark, monkeypatch):
    """Words lie in rows of ``PIECE``, pairs in one row for each slice, and row groups are cut by size: a reader
    holds a row group at a time, which had all rows of a file before."""
    monkeypatch.setattr(collocations, "PIECE", 64)
    text = " ".join(f"w{k % 500} x{k % 300}." for k in range(3000))
    docs = spark.createDataFrame([("en", text)], "lang string, text string")
    chunks = collocations.stored(collocations.word_chunks(docs, "text", "lang", 16 << 20), "chunks")
    assert chunks.selectExpr("max(size(word))", "sum(size(word))").first() == (64, 800)
    found = collocations.materialise(collocations.frequent_words(chunks, 2, 1000), "names")
    pairs = collocations.pair_chunks(chunks, collocations._told_words(found), 10_000, 16, False).toPandas()
    assert sorted(pairs[pairs["slice"].notna()]["slice"]) == list(range(16))
    assert sum(collocations._decoded(x).sum() for x in pairs["n"].dropna()) == 3000
    assert len(pairs["seq"].dropna()) == 1 and collocations._unpacked(pairs["seq"].dropna().iloc[0]).max() == 1499


def test_row_groups_of_large_rows_are_small(spark):
    from pathlib import Path

    import pyarrow.parquet as pq

    rows = spark.range(0, 40, 1, 1).selectExpr("id", "array_join(transform(sequence(1, 16384), k -> sha2(cast(id * 100000 + k as string), 512)), '') AS seq")
    path = collocations.stored(rows, "rows", **collocations.SMALL_GROUPS).stored_at.removeprefix("file://").removeprefix("file:")
    (file,) = Path(path).glob("*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert meta.num_rows == 40 and max(meta.row_group(k).num_rows for k in range(meta.num_row_groups)) <= 12
