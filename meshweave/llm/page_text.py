"""Main text of web pages, with differencing against the pages that are nearest by URL.

A page is read into lines, one for each block of its markup, each with its place: inside a part
that never is content (menus, forms, ...), inside the article, in prose. Pages are ordered by host,
URL path and id. A page with which another shares more than half of its text is a copy to it and says
nothing about boilerplate; the neighbours of a page are the nearest pages before and after it on its
host that are no copies, however long a run of copies lies between. Lines that a longest common
subsequence aligns with a neighbour's lines are shared, and shared lines are deleted, but for the
paragraphs, headings and quotations inside an ``article`` or ``main`` element: these are content, even if
another page has them too. What remains in the article (or, without one, on the page) outside the parts
that never are content is the text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile("[a-z0-9]+")
_RAW = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in ("script", "style", "noscript", "template", "textarea", "iframe", "title", "svg", "select")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: The innermost block of a line tells whether it is prose; items, cells and captions are not.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_ITEMS = frozenset("li td th dd dt figcaption caption".split())
_NEVER = frozenset("nav footer aside form head button dialog menu".split())
_SCOPE = frozenset("article aside blockquote body dd details div dl dt fieldset figure footer form header html main nav ol section table td th tr ul".split())
#: Words that mark a part as no content where a class, id or role is or ends with one ("site-nav").
_MARKS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent disqus dialog footer masthead menu modal nav navbar navigation newsletter notice notification popup promo promoted promotion recommended related replies reply search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)

#: Marks of parts that hold articles of others; an article in any other marked part can be the page's own.
_OTHERS = frozenset("ad ads adv advert advertisement advertising comment comments disqus recommended related replies reply sponsor sponsored".split())
#: Words that may follow a mark ("comment-list", "sidebar-left"); other words do not belong to it ("comment-free").
_SHAPES = frozenset("area bar block body bottom box button buttons center close column container content footer form group header icon icons inner item items left link links list outer panel placeholder primary right row section slot top unit wrap wrapper".split())

#: Words beside which a mark tells of the layout ("with-sidebar"), not of the part.
_HOLDERS = frozenset("with has no without layout".split())
#: A header with one of these is the article's own.
_OWN = frozenset("article entry post story title section".split())


@dataclass
class Line:
    text: str
    dropped: bool
    main: bool
    prose: bool
    held: bool = False


@lru_cache(maxsize=4096)
def mark_of(name: str) -> str | None:
    """The mark of one class, id or role: its last word, or its first one if only words of shape follow."""
    words = _NAME.findall(name)
    for mark, rest in ((words[-1], ()), (words[0], words[1:])) if words else ():
        if (mark in _MARKS or mark == "header") and all(w in _SHAPES or w.isdigit() for w in rest):
            return mark
    return None


def lines_of(html: str | None) -> list[Line]:
    """The blocks of a page in order, empty ones left out.

    ``main`` is dropped only where it is hidden, ``article`` also where it is marked as a comment or as
    somebody else's. If a page has them only in parts that a form or a word drops, such as a form around
    the whole page, what they have is kept.
    """
    html = html or ""
    out: list[Line] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, starts a dropped part, starts the article, may hold it
    drops = mains = holds = 0
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(Line(text, drops > 0, mains > 0, next((t in _PROSE for t, *_ in reversed(stack) if t in _PROSE or t in _ITEMS), False), mains > 0 and 0 < drops == holds))

    def pop(n: int) -> None:
        nonlocal drops, mains, holds
        for _, d, m, h in stack[n:]:
            drops -= d
            mains -= m
            holds -= h
        del stack[n:]

    at = 0
    while (m := _TAG.search(html, at)) is not None:
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = name.lower()
        if m[1]:
            if tag in _BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
            continue
        if tag in _BLOCK:
            flush()
        if tag in _RAW:
            end = _RAW[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag == "br":
            parts.append(" ")
        if tag in _VOID:
            continue
        if tag == "body":
            pop(0)
        elif tag in _BLOCK:  # a block ends an open paragraph, an item the item before
            for k in range(len(stack) - 1, -1, -1):
                open_ = stack[k][0]
                if open_ == "p" or open_ == tag and tag in ("li", "td", "th", "tr", "dd", "dt", "option"):
                    pop(k)
                    break
                if open_ in _SCOPE:
                    break
        drop, hold = tag in _NEVER or tag == "header" and not mains, tag == "form" and not mains
        if m[3]:
            attrs = {a[1].lower(): (a[2] or a[3] or a[4] or "").lower() for a in _ATTR.finditer(m[3])}
            named = [x for k in ("class", "id", "role") for x in attrs.get(k, "").split()]
            hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")
            marks = {mark_of(x) for x in named} - {None}
            if "header" in marks and (mains or any(not _OWN.isdisjoint(_NAME.findall(x)) for x in named)):
                marks.discard("header")
            if not all(_HOLDERS.isdisjoint(_NAME.findall(x)) for x in named):
                marks.clear()
            if tag == "main" or tag == "article" and _OTHERS.isdisjoint(marks):
                marks.clear()
            if tag not in ("html", "body") and (hidden or marks):
                hold = not hidden and not mains and (hold or not drop) and _OTHERS.isdisjoint(marks)
                drop = True
        main = tag in ("article", "main") and not drop
        if main and drops and not mains:  # a menu or header that nobody closed ends here
            while stack and drops and stack[-1][0] not in ("aside", "section", "div"):
                pop(len(stack) - 1)
        stack.append((tag, drop, main, hold))
        drops += drop
        mains += main
        holds += hold
    parts.append(html[at:])
    flush()
    if not any(x.main and not x.dropped for x in out):
        for x in out:
            x.dropped = x.dropped and not x.held
    return out


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of two lists of line hashes.

    Bit-parallel: a row of the dynamic programme is one number, of as many bits as ``b`` has lines, with
    zeros where the length grows. Only every ``isqrt``-th row is held; the others are computed again on
    the way back. So repeated lines cost no more than others, and n lines need n ** 1.5 / 4 bytes.
    """
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    high = 0
    while high < len(a) - low and high < len(b) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    masks: dict[int, int] = {}
    here = set(a[low : len(a) - high])
    inner = [x for x in b[low : len(b) - high] if x in here]  # other lines of b are in no common subsequence
    places: dict[int, list[int]] = {}
    for k, x in enumerate(inner):
        places.setdefault(x, []).append(k)
    for x, at in places.items():
        bits = bytearray(len(inner) // 8 + 1)
        for k in at:
            bits[k >> 3] |= 1 << (k & 7)
        masks[x] = int.from_bytes(bits, "little")
    rows = [k for k in range(low, len(a) - high) if a[k] in masks]
    every = (1 << len(inner)) - 1
    step = isqrt(len(rows)) + 1

    def below(v: int, k: int) -> int:
        both = v & masks[a[rows[k]]]
        return (v + both | v - both) & every

    held, v = [], every
    for k in range(len(rows)):
        if k % step == 0:
            held.append(v)
        v = below(v, k)
    middle, j = [], len(inner)
    for block in range(len(held) - 1, -1, -1):
        begin = block * step
        grid = [held[block]]  # grid[i]: before the row begin + i
        for k in range(begin, min(begin + step, len(rows))):
            grid.append(below(grid[-1], k))
        for i in range(len(grid) - 1, 0, -1):
            grows = ~grid[i] & ((1 << j) - 1)
            j = grows.bit_length()  # the last place up to which the length is as large
            if not j:
                break
            if grid[i - 1] >> (j - 1) & 1:  # it grows there in this row alone: a match
                middle.append(rows[begin + i - 1])
                j -= 1
        if not j:
            break
    return [*range(low), *reversed(middle), *range(len(a) - high, len(a))]


def _outlines(pages: DataFrame) -> DataFrame:
    """``host``, ``path``, ``page_id``, ``key``, ``lines`` (hashes) and ``sizes`` (code points) of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            found = [lines_of(h.as_py()) for h in batch.column(4)]
            hashes = [[xxh3_64_intdigest(x.text.encode("utf-8", "surrogatepass")) - (1 << 63) for x in f] for f in found]
            sizes = [[len(x.text) for x in f] for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))], ["host", "path", "page_id", "key", "lines", "sizes"])

    return pages.mapInArrow(run, "host string, path string, page_id long, key long, lines array<long>, sizes array<int>")


def nearest(lines: list, sizes: list, copy: float, back: bool) -> list[tuple[int, list[int]] | None]:
    """For each page of a host its nearest page before (or after) that is no copy, and the lines shared
    with it; None if there is none. The search goes on beyond a copy at the copy's own neighbour."""
    found: list[tuple[int, list[int]] | None] = [None] * len(lines)
    step = -1 if back else 1
    for i in range(len(lines)) if back else reversed(range(len(lines))):
        j = i + step
        while 0 <= j < len(lines):
            if lines[i] and lines[i] == lines[j]:
                found[i] = found[j]
                break
            common = common_lines(lines[i], lines[j])
            if sum(sizes[i][k] for k in common) <= copy * sum(sizes[i]):
                found[i] = j, common
                break
            j = found[j][0] if found[j] else -1
    return found


_SIDED = "side int, part int, host string, path string, page_id long, key long, lines array<long>, sizes array<int>, guest boolean, shared array<int>"


def _sided(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.bool_(), pa.list_(pa.int32())]
    columns = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in _SIDED.split(", ")])


def _shared(outlines: DataFrame, parts: int, copy: float) -> DataFrame:
    """``page_id``, ``key`` and ``shared`` (line numbers) of pages that share lines with a neighbour.

    The outlines are range-partitioned by host, path and id, so a host of any size is spread. Pages
    whose neighbour is not in their part, all of them in the run of copies at its begin or end, look
    for it among the outermost page, and that one's neighbour, of each part of the host beyond.
    """
    order = ["host", "path", "page_id", "key"]

    def hosts(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
        """Runs of equal ``names``, with the pages (path, page_id, key, lines, sizes, guest)."""
        key, pages = None, []
        for batch in batches:
            columns = [batch.column(c) for c in (*names, "path", "page_id", "key", "lines", "sizes", "guest")]
            for k in range(batch.num_rows):
                *at, path, page_id, page_key, lines, sizes, guest = (c[k].as_py() for c in columns)
                if tuple(at) != key:
                    if pages:
                        yield key, pages
                    key, pages = tuple(at), []
                if key[-1] is not None:
                    pages.append((path, page_id, page_key, array("q", lines), array("i", sizes), guest))
        if pages:
            yield key, pages

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        first, held = True, None  # the last host so far, with what it needs if no other follows
        for (host,), pages in hosts(batches, ["host"]):
            lines, sizes = [p[3] for p in pages], [p[4] for p in pages]
            before, after = (nearest(lines, sizes, copy, back) for back in (True, False))
            row = lambda side, k, guest=False: (side, part, host, *pages[k][:3], pages[k][3].tolist(), pages[k][4].tolist(), guest, None)  # noqa: E731, B023
            for k in range(0, len(pages), 1000):
                got = [(x, sorted({*(before[x][1] if before[x] else ()), *(after[x][1] if after[x] else ())})) for x in range(k, min(k + 1000, len(pages)))]
                yield _sided([(0, part, host, *pages[x][:3], None, None, False, s) for x, s in got if s])
            if first:
                yield _sided([row(1, k) for k in range(len(pages)) if not before[k]])
                yield _sided([row(2, k, True) for k in (0, *([after[0][0]] if after[0] else []))])
            last = len(pages) - 1
            held = [row(2, k) for k in range(len(pages)) if not after[k]] + [row(1, k, True) for k in (last, *([before[last][0]] if before[last] else []))]
            first = False
        if held:
            yield _sided(held)

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (side, part, host), pages in hosts(batches, ["side", "part", "host"]):
            found = nearest([p[3] for p in pages], [p[4] for p in pages], copy, side == 1)
            yield _sided([(0, part, host, *p[:3], None, None, False, sorted(f[1])) for p, f in zip(pages, found, strict=True) if not p[5] and f and f[1]])

    ranged = outlines.withColumn("guest", F.lit(False)).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    got = materialise(ranged.mapInArrow(within, _SIDED), "outlines")
    asking = got.where("side > 0 AND NOT guest")
    heads = asking.select("side", "host", F.col("part").alias("to")).distinct()
    guests = got.where("guest").join(heads, ["side", "host"]).where("side = 1 AND part < to OR side = 2 AND part > to").withColumn("part", F.col("to")).select(*got.columns)
    rest = asking.union(guests).repartition(parts, "side", "part").sortWithinPartitions("side", "part", *order).mapInArrow(beyond, _SIDED)
    return got.where("side = 0").union(rest).select("page_id", "key", "shared")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/?#:]+)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*(/[^?#]*)", 1)


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", copy: float = 0.5) -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every page, an empty line between its blocks.

    A null html is an empty page, with the empty text. A null or relative URL has no host, and so no
    neighbour. Rows that repeat an id with another url or html are pages of their own; rows that are
    equal in all three are copies of each other and lose the same lines.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("key", F.xxhash64("url", "html"))
    located = rows.select(F.when(host_of(F.col("url")) != "", host_of(F.col("url"))).alias("host"), path_of(F.col("url")).alias("path"), "page_id", "key", "html")
    outlines = materialise(_outlines(located), "outlines")  # ranging samples its input: the pages are read into lines once
    shared = materialise(_shared(outlines, int(spark.conf.get("spark.sql.shuffle.partitions")), copy), "shared")
    shared = shared.groupBy("page_id", "key").agg(F.array_distinct(F.flatten(F.collect_set("shared"))).alias("shared"))
    joined = rows.alias("p").join(shared.alias("s"), F.col("p.page_id").eqNullSafe(F.col("s.page_id")) & (F.col("p.key") == F.col("s.key")), "left").select("p.page_id", "p.url", "p.html", "s.shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, common in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                lines, gone = lines_of(html.as_py()), set(common or ())
                article = any(x.main and not x.dropped for x in lines)
                kept = (x.text for k, x in enumerate(lines) if not x.dropped and (x.main or not article) and (k not in gone or x.main and x.prose))
                texts.append("\n\n".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, "page_id long, url string, text string")
