"""HTML extraction: lines that a page shares with its neighbour by URL go; markup cleans what is left."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from os.path import commonprefix
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import map_arrow, partitions, written
from .urls import parsed

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|template|noscript|iframe|textarea|title|svg|select)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<bad>/?[a-zA-Z])[^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that break a line; others stand within one.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that end an open p.
ENDS_P = BLOCK - {"br", "td", "th", "tr", "body", "html", "head", "option", "optgroup", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
#: Elements that are no main text.
AWAY = frozenset("nav header footer aside form button menu dialog head input label option object embed audio video canvas map math".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Words of class and id that name no main text.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social sidebar side menu nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager toc footer header masthead topbar related recommended recommendations comment comments commentlist reply replies disqus discussion feedback widget skip hidden".split()
)
SPLIT = re.compile(r"[^a-z0-9]+")
MAIN = re.compile(r"role\s*=\s*[\"']?main\b", re.I)
#: Pages that are read at once.
AT_ONCE = 200
#: A neighbour that shares over so much of the lines of either page may be its near copy.
NEAR_COPY = 0.9
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def unwanted(name: str, attrs: str) -> bool:
    if name in AWAY:
        return True
    if not attrs.strip():
        return False
    for key, *values in ATTR.findall(attrs):
        key, value = key.lower(), html.unescape("".join(values))
        if key in ("class", "id"):
            if name not in ("html", "body", "main") and not NAMES.isdisjoint(SPLIT.split(CAMEL.sub(" ", value).lower())):
                return True
        elif key == "role" and value.strip().lower() in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        elif key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


class Line(NamedTuple):
    """A block's text; whether markup tells it apart from main text; the outermost article it stands in, counted from 1,
    or 0; whether it stands in the page's main element, and whether it is a heading."""

    text: str
    away: bool
    article: int
    main: bool
    heading: bool


def lines_of(page: str) -> list[Line]:
    """All lines of a page in order, white space within a line made one space.

    What AWAY, ROLES and NAMES tell apart is away with all it holds; scripts, styles and comments are no lines. Ends that
    match no open element are ignored; an element's end closes all it holds; a new block closes an open p.
    """
    lines: list[Line] = []
    stack: list[tuple[str, bool, int, bool, int]] = []
    away, article, main, heading, articles, buf, last = 0, 0, False, 0, 0, [], 0

    def flush() -> None:
        if buf:
            if line := " ".join(html.unescape("".join(buf)).split()):
                lines.append(Line(line, away > 0, article, main, heading > 0))
            buf.clear()

    def pop() -> None:
        nonlocal away, article, main, heading
        if stack[-1][1]:
            flush()
        _, bad, article, main, heading = stack.pop()
        away -= bad

    for m in TOKEN.finditer(page):
        if m.start() > last:
            buf.append(page[last : m.start()])
        last = m.end()
        name = m["name"]
        if name is None:
            if m["bad"]:
                flush()
            continue
        name = name.lower()
        if name in BLOCK:
            flush()
        if m["close"]:
            if name == "p" and not any(s[0] == "p" for s in stack):
                continue
            if any(s[0] == name for s in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in VOID or (m["attrs"].endswith("/") and name not in BLOCK):
            continue
        if name in ENDS_P:
            open_p = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ("p", "td", "th", "li", "div", "article", "section", "main")), None)
            if open_p is not None and stack[open_p][0] == "p":
                while len(stack) > open_p:
                    pop()
        bad = unwanted(name, m["attrs"])
        if bad:
            flush()
        stack.append((name, bad, article, main, heading))
        away += bad
        if not away:
            if name == "article" and not article:
                articles += 1
                article = articles
            elif name == "main" or MAIN.search(m["attrs"]):
                main = True
            heading += name in ("h1", "h2", "h3")
    buf.append(page[last:])
    flush()
    return lines


def scope(lines: list[Line]) -> tuple[list[bool], bool]:
    """Which lines markup lets be main text, and whether the page marks any.

    Marked are the lines of the main element, or, where that holds one article alone, of this article; without a main
    element, those of articles. Where these hold no heading, one that stands before them is theirs. A page without marks
    may have main text wherever it is not away.
    """
    near = [i for i, x in enumerate(lines) if x.main and not x.away]
    own = {lines[i].article for i in near} - {0}
    if len(own) == 1 or not near:
        near = [i for i, x in enumerate(lines) if not x.away and (x.article in own if near else x.article > 0)]
    if not near:
        return [not x.away for x in lines], False
    if not any(lines[i].heading for i in near):
        near += [i for i in range(near[0]) if lines[i].heading and not lines[i].away][-1:]
    inside = set(near)
    return [i in inside for i in range(len(lines))], True


def blocks(page: str) -> tuple[list[str], bool]:
    """The lines that markup lets be main text, and whether the page marks any."""
    lines = lines_of(page)
    inside, marked = scope(lines)
    return [x.text for x, s in zip(lines, inside, strict=True) if s], marked


#: Bytes of the table of a common subsequence, beyond which it is made in halves.
TABLE = 1 << 24


def table_rows(a: list, b: list) -> Iterator[int]:
    """For every prefix of a, where the longest common subsequence with prefixes of b grows, as zero bits."""
    at: dict = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        u = row & at.get(x, 0)
        row = (row + u | row - u) & full
        yield row


def lengths(a: list, b: list) -> np.ndarray:
    """Of the longest common subsequence of a with each prefix of b."""
    row = 0
    for row in table_rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Places in a and b of a longest common subsequence: rows of its table as bits, then the way back. Where the table
    is too large, a is halved, and b where the halves' subsequences are longest together."""
    in_a, in_b = set(a), set(b)
    at_a, at_b = [i for i, x in enumerate(a) if x in in_b], [j for j, x in enumerate(b) if x in in_a]
    out: list[tuple[int, int]] = []
    todo = [(0, len(at_a), 0, len(at_b))]
    while todo:
        lo, hi, left, right = todo.pop()
        x, y = [a[i] for i in at_a[lo:hi]], [b[j] for j in at_b[left:right]]
        if not x or not y:
            continue
        if len(x) > 1 and len(x) * len(y) > 8 * TABLE:
            mid = len(x) // 2
            cut = int(np.argmax(lengths(x[:mid], y) + lengths(x[mid:][::-1], y[::-1])[::-1]))
            todo += [(lo, lo + mid, left, left + cut), (lo + mid, hi, left + cut, right)]
            continue
        rows = list(table_rows(x, y))
        i, j = len(x), len(y)
        while i and j:
            if rows[i - 1] >> j - 1 & 1:
                j -= 1
                continue
            i -= 1
            if not i or rows[i - 1] >> j - 1 & 1:
                j -= 1
                out.append((at_a[lo + i], at_b[left + j]))
    return sorted(out)


#: Of a line's number: marked as main text by its page, and let be main text.
MARKED, INSIDE = 1, 2


def shared_lines(own: list[int], near: list[list[int]]) -> list[int]:
    """Places of a page's lines that a longest common subsequence shares with the first of near; with the next, where the
    first shares nearly all lines of either, as a near copy does, and the next does not. A line that the page marks as main
    text stays, unless the other page, which marks some, has it elsewhere: else it is quoted, not framework."""
    found = []
    for other in near:
        pairs = common([x >> 2 for x in own], [x >> 2 for x in other])
        marks = any(x & MARKED for x in other)
        found.append([i for i, j in pairs if not own[i] & MARKED or marks and not other[j] & MARKED])
        if len(pairs) <= NEAR_COPY * max(len(own), len(other)):
            return found[-1]
    return found[0] if found else []


def differenced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """rid, path, lines, before and after (path and lines of the neighbours, or null): the places of lines that the page
    shares with the neighbour of longest common path, the one before where these tie."""
    rids, gone = [], []
    for row in batch.to_pylist():
        near = [x for x in (row["before"], row["after"]) if x is not None]
        near.sort(key=lambda x: -len(commonprefix([x["path"] or "", row["path"] or ""])))
        if places := shared_lines(row["lines"], [x["lines"] for x in near]):
            rids.append(row["rid"])
            gone.append(places)
    yield pa.RecordBatch.from_pydict({"rid": pa.array(rids, pa.int64()), "gone": pa.array(gone, pa.list_(pa.int32()))})


def paired(pages: DataFrame) -> DataFrame:
    """rid, path, lines, before and after of pages (rid, page_id, url, host, path, lines): path and lines of the nearest
    pages of the same host in the order of (path, page_id, url) whose lines are not the same; null where there is none.

    Pages are dealt by ranges of that order, so that no host is gathered; the ranges are written, for a range's number
    has to stay. Hosts in several ranges then exchange each range's first and last page, with these pages' neighbours.
    """
    key = ["host", "path", "page_id", "url"]
    rows = pages.repartitionByRange(partitions(pages), *key).withColumn("part", F.spark_partition_id())
    rows = written(rows, "pages")
    me = F.struct("path", "lines", F.xxhash64("lines").alias("hash"))
    rows = rows.withColumn("me", me)
    inside = W.partitionBy("host", "part").orderBy(*key[1:], "me.hash")

    def other(side, last):
        # the last change of lines up to here is where the nearest other page stands
        return last(F.when(~F.col(f"{side}.hash").eqNullSafe(F.col("me.hash")) & F.col(side).isNotNull(), F.col(side)), ignorenulls=True)

    rows = rows.withColumns({"back": F.lag("me").over(inside), "next": F.lead("me").over(inside)})
    rows = rows.withColumns({"before": other("back", F.last).over(inside.rowsBetween(W.unboundedPreceding, 0)), "after": other("next", F.first).over(inside.rowsBetween(0, W.unboundedFollowing))})
    rows = rows.drop("back", "next")
    wide = rows.groupBy("host").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("host")
    order = F.struct(*key[1:], "me.hash")
    ends = rows.join(F.broadcast(wide), "host", "left_semi").groupBy("host", "part")
    ends = ends.agg(F.min_by(F.struct("me", "after"), order).alias("lo"), F.max_by(F.struct("me", "before"), order).alias("hi"))
    parts = W.partitionBy("host").orderBy("part")
    ends = ends.withColumns({"back": F.lag("hi").over(parts), "next": F.lead("lo").over(parts)})
    # where a range holds one text alone, what differs from it stands further on
    ends = ends.withColumns(
        {
            "hi2": F.coalesce("hi.before", F.when(F.col("back.me.hash") != F.col("hi.me.hash"), F.col("back.me"))),
            "lo2": F.coalesce("lo.after", F.when(F.col("next.me.hash") != F.col("lo.me.hash"), F.col("next.me"))),
        }
    )
    ends = ends.select(
        "host", "part", F.col("back.me").alias("b1"), F.col("next.me").alias("n1"),
        F.last("hi2", ignorenulls=True).over(parts.rowsBetween(W.unboundedPreceding, -1)).alias("b2"),
        F.first("lo2", ignorenulls=True).over(parts.rowsBetween(1, W.unboundedFollowing)).alias("n2"),
    )
    rows = rows.join(ends, ["host", "part"], "left")

    def far(side, one, two):
        return F.coalesce(side, F.when(F.col(f"{one}.hash") != F.col("me.hash"), F.col(one)).otherwise(F.col(two)))

    pick = {"before": far("before", "b1", "b2"), "after": far("after", "n1", "n2")}
    return rows.select("rid", "path", "lines", *[F.when(x.isNotNull(), F.struct(x["path"].alias("path"), x["lines"].alias("lines"))).alias(c) for c, x in pick.items()])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and marked of every page: its main text.

    Every page is held against the nearest page by URL on its host whose lines are not all the same (paired). The lines that
    a longest common subsequence of both shares are framework and go, but for lines marked as main text that the other page
    does not have elsewhere. Of the others, markup cleans what it tells apart (scope), for frameworks also differ from page to page. Pages
    whose host has no other page are cleaned by markup alone. Null html is an empty text; null urls have an empty host and
    path, and are one host. Equal rows are judged one by one. Other columns are left out, whatever their names.

    Pages are parsed once: numbers of all lines are paired, and the text that markup lets be main text, packed, meets the
    places of shared lines again. Neighbours meet by ranges of (host, path), so that no host is gathered.
    """
    rows = parsed(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
    rows = rows.withColumn("rid", F.monotonically_increasing_id())
    keys = ["rid", "page_id", "url", "host", "path"]

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        numbers, packed = [], []
        for page in batch.column(batch.schema.get_field_index("html")).to_pylist():
            lines = lines_of(page or "")
            inside, marked = scope(lines)
            code = (int.from_bytes(hashlib.blake2b(x.text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for x in lines)
            numbers.append([c & -4 | (MARKED if s and marked else 0) | (INSIDE if s else 0) for c, s in zip(code, inside, strict=True)])
            packed.append(z.compress("\n".join(x.text for x, s in zip(lines, inside, strict=True) if s).encode("utf-8", "replace")))
        cols = {c: batch.column(batch.schema.get_field_index(c)) for c in keys}
        yield pa.RecordBatch.from_pydict(cols | {"lines": pa.array(numbers, pa.list_(pa.int64())), "packed": pa.array(packed, pa.binary())})

    read_once = written(map_arrow(rows, read, "rid long, page_id long, url string, host string, path string, lines array<long>, packed binary", AT_ONCE), "lines")
    gone = written(map_arrow(paired(read_once.select(*keys, "lines")), differenced, "rid long, gone array<int>"), "gone")
    whole = read_once.join(gone, "rid", "left").select("page_id", "url", "lines", "packed", "gone")

    def rest(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        texts, marks = [], []
        for row in batch.select(["lines", "packed", "gone"]).to_pylist():
            places = [i for i, x in enumerate(row["lines"]) if x & INSIDE]
            lost = set(row["gone"] or ())
            lines = z.decompress(row["packed"]).decode().split("\n")
            texts.append(" ".join(x for i, x in zip(places, lines, strict=False) if i not in lost))
            marks.append(any(x & MARKED for x in row["lines"]))
        n = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": n, "marked": pa.array(marks, pa.bool_())})

    return map_arrow(whole, rest, "page_id long, url string, text string, n_chars long, marked boolean")
