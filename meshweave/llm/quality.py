"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are the good labelled documents (at most ``max_positive`` of them); *all* documents are
the unlabelled text. With the class prior p and a logistic loss l the risk is

    p E+[l(f)] + max(0, Eu[l(-f)] - p E+[l(-f)])

The second term estimates the risk on the bad documents without seeing any; where it would turn
negative the step ascends it instead, as the estimator prescribes. f is additive: one weight for
each quantile bin of each feature of the text.

* Features are rates of the whole text, and two of its words: the mean of the log ratio of how many
  trusted and how many of all documents have a word (by ``2 ** 16`` hashed numbers), and the share of
  words that the trusted ones have much less often. The trusted documents that these ratios are from
  are not the ones that the risk has, as a document knows its own words.
* The fit starts from a sample of ``start`` documents, and goes on with the risk over all documents
  (L-BFGS, each step two sums over the stored features) until it falls no more. Quantiles and
  document frequencies are from all documents too.
* The class prior is estimated from the scores of that first fit, which has half of the trusted documents:
  the least share of all documents above a threshold to the share of the other half above it, plus what
  sampling explains, as the bad documents above a good threshold are few. The first fit has the share of
  good labels in its place, and the last one all trusted documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from .common import Numbers, materialise, texts, tidy
from .labels import fold, known, sample

_MARKS = re.compile(r"[^\w\s]{3,}")
FEATURES = (
    "words", "letters_a_word", "upper", "digits", "ascii_marks", "other_bytes", "end_marks", "exclamations", "bars", "symbol_marks", "mark_runs",
    "distinct_words", "distinct_pairs", "repeats", "distinct_lines", "lines_a_word", "lower_words", "commonest_word", "word_ratio", "strange_words",
)


BUCKETS = 1 << 16


def bucket_of(text: str, number: Callable[[str], int]) -> np.ndarray:
    """The hashed numbers of the words of a text, letter case left out."""
    words = text.lower().split()
    return (np.fromiter(map(number, words), np.uint64, len(words)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def features(text: str | None, ratios: np.ndarray, number: Callable[[str], int]) -> list[float]:
    """Shares and rates of a whole text; of an empty one, zeros. ``ratios`` are by hashed word."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size = raw.sum()
    pairs = n - 1
    lines = [x for x in text.split("\n") if x.strip()]
    marks = raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum()
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return [
        np.log1p(n),
        (size - raw[32] - raw[10]) / n,
        raw[65:91].sum() / size,
        raw[48:58].sum() / size,
        marks / size,
        raw[128:].sum() / size,
        (raw[46] + raw[63]) / n,
        raw[33] / n,
        raw[124] / n,
        raw[35:39].sum() / n,
        len(_MARKS.findall(text)) / n,
        len(counts) / n,
        len(set(zip(words, words[1:], strict=False))) / pairs if pairs else 1.0,
        sum(map(str.__eq__, words, words[1:])) / pairs if pairs else 0.0,
        len(set(lines)) / len(lines),
        len(lines) / n,
        sum(map(str.islower, words)) / n,
        max(counts.values()) / n,
        float((of_words := ratios[bucket_of(text, number)]).mean()) if n else 0.0,
        float((of_words < -0.5).mean()) if n else 0.0,
    ]


def _features(rows: DataFrame, ratios) -> DataFrame:
    """The columns but ``text``, and the features ``x`` (array of float)."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Numbers(100_000).__getitem__
        for batch in batches:
            x = [features(t.as_py(), ratios.value, number) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(x, pa.list_(pa.float32()))], [*names, "x"])

    schema = StructType([*(rows.schema[c] for c in names), StructField("x", ArrayType(FloatType()))])
    return rows.mapInArrow(tidy(run), schema)


def word_ratios(rows: DataFrame, weight: float = 20.0) -> np.ndarray:
    """The log ratio of each hashed word over all rows (``text``, ``p``: 1 for a trusted one); a word of
    few trusted documents is drawn to 0, as if ``weight`` more had it as often as all have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Numbers(100_000).__getitem__
        counts = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            for p, text in zip(batch.column(1).is_valid().to_pylist(), batch.column(0), strict=True):
                some = np.unique(bucket_of(text.as_py() or "", number))
                counts[0][some] += 1
                counts[0][BUCKETS] += 1
                if p:
                    counts[1][some] += 1
                    counts[1][BUCKETS] += 1
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(c[at]) for c in counts)], ["k", "u", "p"])

    got = rows.select("text", "p").mapInArrow(tidy(run), "k long, u long, p long").groupBy("k").agg(F.sum("u").alias("u"), F.sum("p").alias("p")).toArrow()
    u, p = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    u[got["k"].to_numpy()], p[got["k"].to_numpy()] = got["u"].to_numpy(), got["p"].to_numpy()
    share = np.maximum(u[:-1], 0.5) / max(u[-1], 1)
    return np.log((p[:-1] + weight * share) / (p[-1] + weight) / share).astype(np.float32)


@dataclass
class Model:
    edges: np.ndarray  # (features, bins - 1)
    weights: np.ndarray  # (features, bins)
    bias: float
    prior: float

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The weight's number of each feature."""
        bins = self.weights.shape[1]
        return np.stack([np.searchsorted(self.edges[k], x[:, k], "right") + k * bins for k in range(x.shape[1])], 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.weights.ravel()[self.codes(x)].sum(1) + self.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, edges: np.ndarray, prior: float, steps: int = 2000, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """Minimise the non-negative PU risk of samples by full-batch Adam. ``edges`` are (features, bins - 1)."""
    model = Model(edges, np.zeros((edges.shape[0], edges.shape[1] + 1)), 0.0, prior)
    p, u = model.codes(positive), model.codes(unlabelled)
    size = model.weights.size
    w = np.zeros(size + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)

    def gradient(codes: np.ndarray, each: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(codes.ravel(), np.repeat(each, codes.shape[1]), size), each.sum())

    for t in range(1, steps + 1):
        fp, fu = w[:-1][p].sum(1) + w[-1], w[:-1][u].sum(1) + w[-1]
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        g_negative = gradient(u, _sigmoid(fu) / fu.size) - prior * gradient(p, _sigmoid(fp) / fp.size)
        g = prior * gradient(p, -_sigmoid(-fp) / fp.size) + g_negative if negative >= 0 else -g_negative
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Model(edges, w[:-1].reshape(model.weights.shape), float(w[-1]), prior)


def _sums(stored: DataFrame, model: Model, weights: list[np.ndarray], gradient: bool) -> np.ndarray:
    """Over all rows: for each of some weights the sum of softplus(f), and of the first the gradient;
    last, the number of rows."""
    size = model.weights.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(weights) + (size + 1) * gradient + 1)
        for batch in batches:
            codes = model.codes(batch.column(0).flatten().to_numpy().reshape(-1, len(FEATURES)))
            for k, w in enumerate(weights):
                f = w[:-1][codes].sum(1) + w[-1]
                out[k] += np.logaddexp(0, f).sum()
                if gradient and not k:
                    each = _sigmoid(f)
                    out[len(weights) : len(weights) + size] += np.bincount(codes.ravel(), np.repeat(each, codes.shape[1]), size)
                    out[len(weights) + size] += each.sum()
            out[-1] += len(codes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size), pa.int32()), pa.array(out)], ["k", "v"])

    got = stored.select("x").mapInArrow(tidy(run), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(len(weights) + (size + 1) * gradient + 1)
    out[got["k"].to_numpy()] = got["v"].to_numpy()
    return out


def refine(model: Model, positive: np.ndarray, stored: DataFrame, decay: float = 1e-5, most: int = 12, least: float = 1e-5) -> Model:
    """Goes on with the risk over all rows of ``stored``, from a fitted model, until it falls by less than
    ``least`` in a step. Where its second term is not positive there is nothing more to learn."""
    p, prior = model.codes(positive), model.prior
    w = np.append(model.weights.ravel(), model.bias)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    steps = (1.0, 0.5, 0.2, 0.05, 0.01)
    before = None

    def risk(w: np.ndarray, softplus: float) -> tuple[float, float]:
        fp = w[:-1][p].sum(1) + w[-1]
        negative = softplus - prior * np.logaddexp(0, fp).mean()
        return prior * np.logaddexp(0, -fp).mean() + max(0.0, negative) + decay / 2 * (w[:-1] ** 2).sum(), negative

    for _ in range(most):
        got = _sums(stored, model, [w], True)
        now, negative = risk(w, got[0] / got[-1])
        if negative <= 0:
            break
        fp = w[:-1][p].sum(1) + w[-1]
        # l(f) - l(-f) = -f: both terms on the trusted rows are linear
        g = got[1:-1] / got[-1] - prior * np.append(np.bincount(p.ravel(), minlength=w.size - 1) / len(fp), 1.0)
        g[:-1] += decay * w[:-1]
        if before is not None:
            past.append((w - before[0], g - before[1]))
        before = w, g
        d, back = -g, []
        for s, y in reversed(past[-8:]):
            back.append((s @ d) / max(s @ y, 1e-12))
            d = d - back[-1] * y
        if past:
            s, y = past[-1]
            d = d * max(s @ y, 1e-12) / max(y @ y, 1e-12)
        else:
            d = d * min(10.0, 0.5 / max(np.abs(d).max(), 1e-9))
        for (s, y), a in zip(past[-8:], reversed(back), strict=True):
            d = d + s * (a - (y @ d) / max(s @ y, 1e-12))
        tried = [w + t * d for t in steps]
        sums = _sums(stored, model, tried, False)
        best = min((risk(x, sums[k] / sums[-1])[0], k) for k, x in enumerate(tried))
        if best[0] >= now - least:
            w = tried[best[1]] if best[0] < now else w
            break
        w = tried[best[1]]
    return Model(model.edges, w[:-1].reshape(model.weights.shape), float(w[-1]), prior)


def estimate_prior(trusted: np.ndarray, every: np.ndarray, first: float, least: float = 0.2, delta: float = 0.1) -> float:
    """The class prior from histograms of scores of trusted and of all documents, from low to high: the
    ratio at the threshold whose upper confidence bound is least, of those that ``least`` of the trusted
    ones reach; ``first`` without documents."""
    n_p, n_u = trusted.sum(), every.sum()
    if not n_p or not n_u:
        return first
    up, uu = trusted[::-1].cumsum() / n_p, every[::-1].cumsum() / n_u
    slack = np.sqrt(np.log(4 / delta) / 2 / n_u) + np.sqrt(np.log(4 / delta) / 2 / n_p)
    ok = up >= least
    at = int(np.argmin(np.where(ok, (uu + slack) / np.maximum(up, 1e-9), np.inf)))
    return float(np.clip(uu[at] / up[at], 0.01, 0.999))


def _score_counts(stored: DataFrame, model: Model, bins: int = 1000) -> np.ndarray:
    """How many rows have a score in each of so many equal parts of 0 to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(bins, np.int64)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, len(FEATURES))
            out += np.bincount(np.minimum((_sigmoid(model.logit(x)) * bins).astype(int), bins - 1), minlength=bins)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(bins), pa.int32()), pa.array(out)], ["k", "n"])

    got = stored.select("x").mapInArrow(tidy(run), "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(bins)
    out[got["k"].to_numpy()] = got["n"].to_numpy()
    return out


def fit(rows: DataFrame, learnt: DataFrame, max_positive: int, start: int, bins: int = 24) -> tuple[Model, np.ndarray, DataFrame] | None:
    """The model, the word ratios and the stored features of ``rows`` (``doc_id``, ``text``)."""
    spark = rows.sparkSession
    share = learnt.agg(F.avg("y"), F.count("*")).first()
    if not share[1] or not share[0]:
        return None
    trusted = sample(learnt.where("y = 1").select("doc_id"), max_positive)
    half = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2))
    # At most max_positive ids: half of them tell of words (p = 0), the others are the risk's (p = 1).
    marked = rows.join(F.broadcast(trusted.withColumn("p", half.cast("int"))), "doc_id", "left")
    ratios = word_ratios(marked.select("text", F.when(F.col("p") == 0, 1).alias("p")))
    stored = materialise(_features(marked.select("doc_id", "p", "text"), spark.sparkContext.broadcast(ratios)), "features")
    x_of = lambda df: df.select("x").toArrow()["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    positive = x_of(stored.where("p = 1").orderBy(F.xxhash64("doc_id"), "doc_id"))
    if len(positive) < 2:
        return None
    cuts = [k / bins for k in range(1, bins)]
    edges = np.array(stored.agg(*(F.percentile_approx(F.col("x")[k], cuts, 1000).alias(f"q{k}") for k in range(len(FEATURES)))).first(), float)
    first = fit_nnpu(positive[::2], x_of(stored.orderBy(F.xxhash64("doc_id"), "doc_id").limit(start)), edges, min(float(share[0]), 0.999))
    own = np.bincount(np.minimum((_sigmoid(first.logit(positive[1::2])) * 1000).astype(int), 999), minlength=1000).astype(float)
    prior = estimate_prior(own, _score_counts(stored, first), first.prior)
    shifted = Model(edges, first.weights, first.bias + np.log(prior / (1 - prior)) - np.log(first.prior / (1 - first.prior)), prior)
    return refine(shifted, positive, stored), ratios, stored


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id: str = "doc_id",
    folds: int = 5, held_out: int = 0, threshold: float = 0.3, max_positive: int = 12_000, start: int = 12_000, carry: bool = False,
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``docs``.

    Repeated rows are scored alike; null and empty texts are scored as texts without words. Without
    good labels to learn from the score is 0.5. ``carry`` adds the input row as ``row``.
    """
    rows = texts(docs, id_col, text_col)
    spark = docs.sparkSession
    found = fit(rows, known(labels, label_col, label_id, folds, held_out), max_positive, start)
    model, ratios, stored = found or (None, None, None)

    by_word = spark.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From texts where rows are carried, in one pass, as each chained pass is a process more."""
        number = Numbers(100_000).__getitem__
        for batch in batches:
            if carry:
                x = np.array([features(t.as_py(), by_word.value, number) for t in batch.column("text")], np.float32)
            else:
                x = batch.column("x").flatten().to_numpy()
            score = _sigmoid(model.logit(x.reshape(-1, len(FEATURES))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score)], [*names, "score"])

    names = ["doc_id", "row"] if carry else ["doc_id"]
    every = texts(docs, id_col, text_col, carry)
    if model is None:
        scored = every.select(*names, F.lit(0.5).alias("score"))
    else:
        scored = (every if carry else stored.select("doc_id", "x")).mapInArrow(tidy(run), StructType([*(every.schema[c] for c in names), StructField("score", DoubleType())]))
    return scored.select(*names, F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
