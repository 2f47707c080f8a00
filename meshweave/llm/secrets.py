"""Secret scan with DataFrame functions only: pattern matches plus a randomness test battery.

Base matches (``assign``, ``access``, ``hex``) are found by three patterns. The battery looks at every
other maximal run of at least 20 key characters, but for digits alone, capitals alone, and small letters
with or without a capital before them: those are numbers and words much more often than keys.

1. The encoding is inferred from the characters that occur: the smallest alphabet that has them all.
2. Against a uniformly random string over that alphabet: a chi-squared test of the symbol counts (scaled
   to its exact mean and variance, as short runs have few of each symbol), a runs test of lower and upper
   halves of the alphabet, and the lag-1 serial correlation of symbol numbers.
3. Against ordinary writing, which repeats its symbols much more (coincidence ``ordinary``): the
   probability that such a text of this length would have as small a chi-squared. Short runs can hardly
   reach small values there, so the test is aware of length.

The p-value of a run is that of 3, or 1 if any test of 2 rejects it (Bonferroni, ``reject``). The
Benjamini-Hochberg rule at ``fdr`` is applied to these p-values within each class of lengths, on
histograms of at most ``8 * 101`` cells. A run is reported as ``random`` if the rule accepts it and it
overlaps no base match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

KINDS = ("assign", "access", "hex", "random")  # in the order in which ties are listed
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run of these characters is matched whole, so the least length can be part of the pattern.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
RUN = "[A-Za-z0-9+/_-]{20,}"
# Digits alone, or letters as a word has them, are not keys.
PLAIN = "^([0-9]+|[A-Z]?[a-z]+|[A-Z]+)$"

_LOW, _UP, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets from small to large, with the pattern that a string over them matches.
ALPHABETS = (
    ("decimal", "^[0-9]*$", _DIGIT),
    ("hex", "^[0-9a-f]*$", _DIGIT + "abcdef"),
    ("HEX", "^[0-9A-F]*$", _DIGIT + "ABCDEF"),
    ("lower", "^[a-z]*$", _LOW),
    ("upper", "^[A-Z]*$", _UP),
    ("base32", "^[A-Z2-7]*$", _UP + "234567"),
    ("base36", "^[0-9a-z]*$", _DIGIT + _LOW),
    ("BASE36", "^[0-9A-Z]*$", _DIGIT + _UP),
    ("base62", "^[0-9A-Za-z]*$", _UP + _LOW + _DIGIT),
    ("base64", "^[0-9A-Za-z+/]*$", _UP + _LOW + _DIGIT + "+/"),
    ("base64url", "^[0-9A-Za-z_-]*$", _UP + _LOW + _DIGIT + "-_"),
    ("key", "", _UP + _LOW + _DIGIT + "+/-_"),
)
_SPAN = "array<struct<begin:bigint,end:bigint,kind:int>>"
_CELLS = 100


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, for z of either sign (five-term expansion, 1e-7)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z < 0, 1 - tail).otherwise(tail)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Items that a scan appends to one list; lists are joined afterwards, as an append copies its list.
_PART = 256


def _scan(items: Column, state: Column, advance: Callable[[Column, Column], Column], tell: Callable[[Column, Column], Column], told: str) -> Column:
    """``tell(state, item)`` (of the type ``told``) of each item, with the state before the item."""

    def within(state: Column, part: Column) -> Column:
        start = F.struct(state.alias("state"), F.expr(f"cast(array() as array<{told}>)").alias("out"))
        return F.aggregate(part, start, lambda a, x: F.struct(advance(a["state"], x).alias("state"), F.concat(a["out"], F.array(tell(a["state"], x))).alias("out")))

    parts = F.transform(F.sequence(F.lit(0), F.size(items) - 1, F.lit(_PART)), lambda i: F.slice(items, i + 1, F.lit(_PART)))
    start = F.struct(state.alias("state"), F.expr(f"cast(array() as array<array<{told}>>)").alias("out"))
    done = F.aggregate(parts, start, lambda a, part: _let(within(a["state"], part), lambda w: F.struct(w["state"].alias("state"), F.concat(a["out"], F.array(w["out"])).alias("out"))))
    return F.when(F.size(items) > 0, F.flatten(done["out"])).otherwise(F.expr(f"cast(array() as array<{told}>)"))


def _matches(text: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """Spans of the leftmost matches: text pieces between them give their places."""
    parts = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = [F.transform(F.slice(parts, 1, F.size(found)), F.char_length).alias("gap"), F.transform(found, F.char_length).alias("len")]
    pairs = F.arrays_zip(*lengths, *([keep.alias("keep")] if keep is not None else []))

    def spans(pairs: Column) -> Column:
        begin = lambda at, x: at + x["gap"]
        end = lambda at, x: at + x["gap"] + x["len"]
        tell = lambda at, x: F.struct(begin(at, x).alias("begin"), end(at, x).alias("end"), F.lit(kind).alias("kind"), (x["keep"] if keep is not None else F.lit(True)).alias("keep"))
        return _scan(pairs, F.lit(0).cast("long"), end, tell, "struct<begin:bigint,end:bigint,kind:int,keep:boolean>")

    kept = F.transform(F.filter(_let(pairs, spans), lambda s: s["keep"]), lambda s: F.struct(s["begin"], s["end"], s["kind"]))
    return F.when(text.rlike(pattern), kept).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def _apart(spans: Column) -> Column:
    """Spans in order of begin and kind, without those of the battery that overlap a base match: one that
    began before and ends later (known going forward), or begins within (known going backward)."""
    told = "struct<begin:bigint,kind:int,end:bigint,hit:boolean>"
    row = lambda s, hit: F.struct(s["begin"].alias("begin"), s["kind"].alias("kind"), s["end"].alias("end"), ((s["kind"] == 3) & hit).alias("hit"))
    marked = F.transform(spans, lambda s: row(s, F.lit(False)))
    forward = lambda x: _scan(x, F.lit(0).cast("long"), lambda e, s: F.when(s["kind"] < 3, F.greatest(e, s["end"])).otherwise(e), lambda e, s: row(s, s["hit"] | (e > s["begin"])), told)
    backward = lambda x: _scan(x, F.lit((1 << 62)).cast("long"), lambda b, s: F.when(s["kind"] < 3, F.least(b, s["begin"])).otherwise(b), lambda b, s: row(s, s["hit"] | (b < s["end"])), told)
    return F.filter(F.reverse(_let(F.reverse(_let(marked, forward)), backward)), lambda s: ~s["hit"])


def _scores(run: Column, ordinary: float) -> Column:
    """``even``: how unlikely ordinary writing is (a probability); ``reject``: least p-value of the
    three tests against a random string; ``n``: length."""
    alphabet = F.lit(ALPHABETS[-1][2])
    for _, pattern, letters in ALPHABETS[-2::-1]:
        alphabet = F.when(run.rlike(pattern), F.lit(letters)).otherwise(alphabet)

    def counted(v: Column) -> Column:
        run, alphabet = v["run"], v["alphabet"]
        counts = F.transform(F.split(alphabet, ""), lambda s: (F.char_length(run) - F.char_length(F.replace(run, s, F.lit("")))).cast("double"))
        codes = F.transform(F.split(run, ""), lambda c: F.position(c, alphabet).cast("double"))
        return F.struct(
            F.char_length(alphabet).cast("double").alias("size"),
            F.char_length(run).cast("double").alias("n"),
            F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c).alias("squares"),
            codes.alias("codes"),
            (F.aggregate(codes, F.lit(0.0), lambda a, c: a + c) / F.char_length(run)).alias("middle"),
        )

    def folded(v: Column) -> Column:
        codes, middle = v["codes"], v["middle"]
        bits = F.array_join(F.transform(codes, lambda c: F.when(c * 2 <= v["size"], F.lit("0")).otherwise(F.lit("1"))), "")
        lagged = F.zip_with(codes, F.slice(codes, 2, F.size(codes)), lambda a, b: F.coalesce((a - middle) * (b - middle), F.lit(0.0)))
        return F.struct(
            v["size"].alias("size"),
            v["n"].alias("n"),
            v["squares"].alias("squares"),
            bits.alias("bits"),
            F.aggregate(codes, F.lit(0.0), lambda a, c: a + (c - middle) * (c - middle)).alias("spread"),
            F.aggregate(lagged, F.lit(0.0), lambda a, c: a + c).alias("lagged"),
        )

    def counts_of_runs(v: Column) -> Column:
        n, bits = v["n"], v["bits"]
        ones = F.char_length(F.replace(bits, F.lit("0"), F.lit(""))).cast("double")
        turns = (2 * n - F.char_length(F.replace(bits, F.lit("01"), F.lit("0"))) - F.char_length(F.replace(bits, F.lit("10"), F.lit("1")))).cast("double")
        return F.struct(*(v[x].alias(x) for x in ("size", "n", "squares", "spread", "lagged")), turns.alias("turns"), (2 * ones * (n - ones) / n + 1).alias("mean"))

    def judged(v: Column) -> Column:
        n, squares, df = v["n"], v["squares"], v["size"] - 1
        chi2 = (squares * v["size"] / n - n) * n / (n - 1)
        df = df * n / (n - 1)  # mean and variance of chi-squared are now those of uniform symbols
        uniform = _let((F.pow(chi2 / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)), _upper_tail)
        variance = (v["mean"] - 1) * (v["mean"] - 2) / (n - 1)
        runs = F.when(variance > 0, 2 * _let(F.abs((v["turns"] + 1 - v["mean"]) / F.sqrt(variance)), _upper_tail)).otherwise(F.lit(0.0))
        serial = F.when(v["spread"] > 0, 2 * _let(F.abs(v["lagged"] / v["spread"] * F.sqrt(n)), _upper_tail)).otherwise(F.lit(0.0))
        repeat = F.greatest(F.lit(ordinary), 2 / v["size"])
        coincidence = (squares - n) / (n * (n - 1))
        even = _let((repeat - coincidence) * n / F.sqrt(2 * repeat), _upper_tail)
        return F.struct(n.alias("n"), even.alias("even"), F.least(uniform, runs, serial).alias("reject"))

    return _let(_let(_let(_let(F.struct(run.alias("run"), alphabet.alias("alphabet")), counted), folded), counts_of_runs), judged)


def _cell(score: Column, reject: float) -> Column:
    """The p-value in tenths of its decimal logarithm, and none if a test of randomness rejects."""
    return F.when(score["reject"] * 3 < reject, F.lit(-1)).otherwise(F.floor(-10 * F.log10(F.greatest(score["even"], F.lit(1e-12)))))


def _length_class(n: Column) -> Column:
    return F.least(F.floor(F.log2(n / 20) * 2), F.lit(7)).cast("int")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.01, reject: float = 0.001, ordinary: float = 0.0667, carry: bool = False) -> DataFrame:
    """``doc_id``, ``text`` and ``spans`` (begin, end exclusive, kind number) in order of begin, kind.

    One row per input row: repeated rows each have theirs. Null and empty texts have no spans. Of spans
    that begin alike the kinds tell the order. A text's time grows with its length and, but for joining
    lists of 256, with its matches. Positions are code points. The
    histograms of the battery are the only thing gathered; they are at most 808 rows. ``carry`` adds the input row as ``row``.
    """
    rows = texts(docs, id_col, text_col, carry)
    text = F.coalesce("text", F.lit(""))
    found = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    spans = _matches(text, RUN, 3, F.transform(found, lambda r: ~r.rlike(PLAIN)))
    runs = F.zip_with(spans, F.filter(found, lambda r: ~r.rlike(PLAIN)), lambda s, r: F.struct(s.alias("span"), _let(r, lambda r: _scores(r, ordinary)).alias("score")))
    tested = F.when(text.rlike(RUN), runs)
    candidates = rows.where(F.col("text").rlike(RUN)).select(F.explode(tested).alias("t")).select("t.score.*")
    cell = F.least(_cell(F.struct("even", "reject"), reject), F.lit(_CELLS)).cast("int")
    cells = candidates.groupBy(_length_class(F.col("n")).alias("length"), cell.alias("cell")).agg(F.count("*").alias("n")).collect()
    limits = []  # the least cell of each length class that the Benjamini-Hochberg rule accepts
    for length in range(8):
        own = sorted(((r["cell"], r["n"]) for r in cells if r["length"] == length), reverse=True)
        total, found, least = sum(n for _, n in own), 0, 10.0**9
        for c, n in own:
            found += n
            if 10 ** (-c / 10) * total <= fdr * found:
                least = float(c)
        limits.append(least)

    parts = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    base = F.concat(_matches(text, ASSIGN, 0, F.transform(parts, lambda p: F.char_length(p) >= 6)), _matches(text, ACCESS, 1), _matches(text, HEX, 2))

    def accepted(t: Column) -> Column:
        least = F.element_at(F.array(*map(F.lit, limits)), _length_class(t["score"]["n"]) + 1)
        return _cell(t["score"], reject) >= least

    random = F.coalesce(F.transform(F.filter(tested, accepted), lambda t: t["span"]), F.expr(f"cast(array() as {_SPAN})"))
    both = rows.withColumn("base", base).withColumn("extra", random)
    ordered = F.array_sort(F.transform(F.concat("base", "extra"), lambda s: F.struct(s["begin"].alias("begin"), s["kind"].alias("kind"), s["end"].alias("end"))))
    plain = F.transform(ordered, lambda s: F.struct(s["begin"].alias("begin"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(False).alias("hit")))
    order = F.when((F.size("extra") > 0) & (F.size("base") > 0), _let(ordered, _apart)).otherwise(plain)
    return both.select("doc_id", "text", F.transform(order, lambda s: F.struct(s["begin"], s["end"], s["kind"])).alias("spans"), *(["row"] if carry else []))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["begin"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by ``mark``. ``spans`` are in order."""
    tell = lambda at, s: F.struct(at.alias("begin"), s["begin"].alias("end"), (s["begin"] >= at).alias("new"))
    gaps = F.filter(_scan(spans, F.lit(0).cast("long"), lambda at, s: F.greatest(at, s["end"]), tell, "struct<begin:bigint,end:bigint,new:boolean>"), lambda g: g["new"])

    def cut(text: Column, begin: Column, end: Column) -> Column:
        return F.substring(text, (begin + 1).cast("int"), (end - begin).cast("int"))

    def joined(part: Column) -> Column:
        """Gaps in turn are cut from the text that they share, not each from its begin."""
        begin = F.element_at(part, 1)["begin"]
        own = lambda x: F.array_join(F.transform(part, lambda g: F.concat(cut(x, g["begin"] - begin, g["end"] - begin), F.lit(mark))), "")
        return _let(cut(text, begin, F.element_at(part, -1)["end"]), own)

    parts = lambda g: F.array_join(F.transform(F.sequence(F.lit(0), F.size(g) - 1, F.lit(_PART)), lambda i: _let(F.slice(g, i + 1, F.lit(_PART)), joined)), "")
    rest = F.substring(text, (F.array_max(F.transform(spans, lambda s: s["end"])) + 1).cast("int"), F.char_length(text))
    return F.when(F.size(spans) > 0, F.concat(_let(gaps, parts), rest)).otherwise(text)
