"""Main text of web pages by nearest-URL page differencing (operator 3).

Pages are sorted by host and path and range-partitioned, so a host with a third of all pages is cut anywhere. Pages that
follow each other and are copies (`differs` says no: less than a twentieth of either page's characters is in lines that
the other has not) form a run; a page's neighbours are the pages just before and just after its run, on the same host, and
it is paired with the one whose path agrees longer with its own. So a page is never differenced with a copy of itself. If
the pages beside the run are copies of it too, or there are none, it has no neighbour. Both pages are read as lines, one
per block; the lines are aligned by a longest common subsequence, and lines that both pages have are deleted as the site's
frame.

What is sorted and aligned are hashes of lines. The range-partitioned rows are written once; one row for each partition
hands the pages at its borders on to the partitions beside it, past ones that a single run fills, so the cuts do not
change a result.

Differencing alone errs in two ways, which the marks of the page correct. Lines of the frame can be part of an article:
shared lines inside `article` or `main` are kept. Frames can differ from page to page (adverts, menus, footers): lines
inside navigation, footer, form, aside and like elements, or ones named so by class or id, are dropped though they are not
shared, and so is everything outside the article if the page marks one.

Defined cases: null html gives an empty text; a page with a null URL or without a host has no neighbour; a page without
neighbour keeps its unmarked lines; elements that are never closed end with their parent or the page; a reference cut off
by the end of the page stays as it stands; repeated pages and rows are each answered; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape
from os.path import commonprefix
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.llm.scratch import Scratch, keyed

OUTSIDE, ARTICLE, FRAME, MUTED = 0, 1, 2, 3
Line = tuple[str, int]

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe|select)\b[^>]*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?:(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'){0,200}+)>)?|<[!?/][^>]*>",
    re.S | re.I,
)
#: A tag, comment or raw element that the end of the page cuts off.
_CUT = re.compile(r"<(?:!--|script\b|style\b).*\Z|<[a-z/!][^<>]*\Z", re.S | re.I)
_INLINE = set("a abbr b bdi bdo big br cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_LEFT_OPEN = set("p li dt dd tr td th thead tbody tfoot option".split())
_FRAMES = set("nav footer aside form menu dialog button".split())
_HINTS = (r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|disqus|footer|masthead|menu|nav(?:bar|igation)?|newsletter"
          r"|notices?|pagination|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe)")
#: A name that begins or ends with one of these words.
_HINT = re.compile(rf"(?:^|\s){_HINTS}(?:$|[\s_-])|[_-]{_HINTS}(?:$|\s)", re.I)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)


class _Ends:
    """Where tags end that have over 200 parts, or none of whose `>` is outside quotes: read once from the back, for all
    three states (outside quotes, in double ones, in single ones), so that many such tags cost no more than one."""

    def __init__(self, html: str):
        self.at = [m.start() for m in re.finditer("[>\"']", html)]
        self.found = [-1] * (len(self.at) + 1)
        out = double = single = -1
        for k in range(len(self.at) - 1, -1, -1):
            c = html[self.at[k]]
            if c == ">":
                out = self.at[k] + 1
            elif c == '"':
                out, double = double, out
            else:
                out, single = single, out
            self.found[k] = out
        self.plain = html.find

    def after(self, at: int) -> int:
        """The end of a tag whose name ends at `at`: after the first `>` outside quotes; without one, after the first `>`."""
        end = self.found[bisect_left(self.at, at)]
        return end if end >= 0 else self.plain(">", at) + 1


def _role(name: str, rest: str, zone: int) -> int | None:
    """What an element makes of its content: None if nothing new."""
    if name in _FRAMES or name == "header" and zone != ARTICLE:
        return FRAME
    if rest:
        if any(_HINT.search(a or b or c) for a, b, c in _NAMED.findall(rest)) and name not in ("html", "body", "article", "main"):
            return FRAME
        if _HIDDEN.search(rest):
            return FRAME
    return ARTICLE if name in ("article", "main") else None


def page_lines(html: str | None) -> list[Line]:
    """The page's blocks in order as (text, zone), references decoded and white space single."""
    out: list[Line] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    held: Counter[str] = Counter()
    zone = spoken = OUTSIDE  # text of a dropped inline element is muted, it does not end the block

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, zone if zone != MUTED else spoken))

    def leave() -> None:
        nonlocal zone
        name, zone = stack.pop()
        held[name] -= 1

    html = html or ""
    at, last = 0, html.rfind(">") + 1
    ends: _Ends | None = None
    while m := _TOKEN.search(html, at, last):
        if m.start() > at and zone != MUTED:
            parts.append(html[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        rest = m["rest"]
        if rest is None:
            ends = ends or _Ends(html)
            at = ends.after(m.end())
            rest = html[m.end() : at - 1]
        if name in _INLINE:
            if name == "br":
                parts.append(" ")
        else:
            flush()
        if m["end"]:
            if held[name]:
                while stack[-1][0] != name:
                    leave()
                if zone != stack[-1][1] and zone != MUTED:
                    flush()
                leave()
            continue
        while name not in _INLINE and stack and stack[-1][0] == "p":
            leave()
        role = _role(name, rest, zone) if zone not in (FRAME, MUTED) else None
        if role == FRAME and name in _INLINE:
            role, spoken = MUTED, zone
        if name in _VOID or name in _LEFT_OPEN and (role is None or name != "p"):
            continue
        if role is not None and role not in (zone, MUTED):
            flush()
        stack.append((name, zone))
        held[name] += 1
        if role is not None:
            zone = role
    tail = html[at:]
    cut = _CUT.search(tail)
    if zone != MUTED:
        parts.append(tail[: cut.start()] if cut else tail)
    flush()
    return out


#: Lines of the neighbour in one number. Tables of up to twice the square of it are kept whole, larger ones are halved.
STRETCH = 4096


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The length of a longest common subsequence of `a` and each beginning of `b`, the empty one first. One big number
    holds a row of the table for STRETCH lines of `b`; what a row carries goes on to the next ones, so memory is linear."""
    carry, grown = [0] * len(a), []
    for k in range(0, len(b), STRETCH):
        part = b[k : k + STRETCH]
        place: dict[int, int] = {}
        for j, y in enumerate(part):
            place[y] = place.get(y, 0) | 1 << j
        row = full = (1 << len(part)) - 1
        for i, x in enumerate(a):
            m = place.get(x, 0)
            if m or carry[i]:
                m &= row
                total = row + m + carry[i]
                carry[i] = total >> len(part)
                row = (total | row - m) & full
        bits = np.unpackbits(np.frombuffer(row.to_bytes(len(part) // 8 + 1, "little"), np.uint8), bitorder="little")
        grown.append(1 - bits[: len(part)].astype(np.int64))
    return np.concatenate([[0], np.cumsum(np.concatenate(grown))]) if grown else np.zeros(1, np.int64)


def _table(a: list[int], b: list[int]) -> list[int]:
    """Places in `a` on a longest common subsequence with `b`, from all rows of the table."""
    place: dict[int, int] = {}
    for j, y in enumerate(b):
        place[y] = place.get(y, 0) | 1 << j
    row = full = (1 << len(b)) - 1
    rows = []
    for x in a:
        rows.append(row)
        m = row & place.get(x, 0)
        row = (row + m | row - m) & full
    out, j = [], len(b)
    for t in range(len(a) - 1, -1, -1):
        # A zero bit ends a column at which the row's length grows by one; the line is on the path if its bit turned.
        while j and row >> (j - 1) & 1:
            j -= 1
        if j and rows[t] >> (j - 1) & 1:
            out.append(t)
            j -= 1
        row = rows[t]
    return out


def shared_lines(a: list, b: list) -> set[int]:
    """Places in `a` on a longest common subsequence with `b`, exact for any lengths: what both begin and end with is taken
    off, lines that only one has too; a table that is too large is split where the halves of `a` have most in common with
    a beginning and the rest of `b`, which needs one row of each half."""
    lo, n = 0, min(len(a), len(b))
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out = set(range(lo)) | set(range(len(a) - hi, len(a)))
    number: dict = {}
    for y in b[lo : len(b) - hi]:
        number.setdefault(y, len(number))
    xs = [i for i in range(lo, len(a) - hi) if a[i] in number]
    in_a = {a[i] for i in xs}
    todo = [(xs, [number[y] for y in b[lo : len(b) - hi] if y in in_a])]
    while todo:
        xs, ys = todo.pop()
        if not xs or not ys:
            continue
        lines = [number[a[i]] for i in xs]
        if len(xs) == 1:
            out.update(xs if lines[0] in ys else ())
        elif len(ys) <= 2 * STRETCH and len(xs) * len(ys) <= 2 * STRETCH * STRETCH:
            out.update(xs[t] for t in _table(lines, ys))
        else:
            half = len(xs) // 2
            both = _lengths(lines[:half], ys) + _lengths(lines[half:][::-1], ys[::-1])[::-1]
            at = int(both.argmax())
            todo += [(xs[:half], ys[:at]), (xs[half:], ys[at:])]
    return out


def main_text(lines: list[Line], shared: set[int]) -> str:
    marked = any(zone == ARTICLE for _, zone in lines)
    kept = [x for i, (x, zone) in enumerate(lines) if zone == ARTICLE or zone == OUTSIDE and not marked and i not in shared]
    return "\n".join(kept)


#: Pages are copies of each other if one has less than this share of its characters in lines of its own.
OWN = 0.05


class Page(NamedTuple):
    """A page's place and the hashes and lengths of its lines."""

    host: str
    path: str
    lines: list[int]
    sizes: list[int]


def differs(a: Page, b: Page) -> bool:
    """Whether both pages have enough lines of their own; if not, what they share is no frame."""
    for x, y in ((a, b), (b, a)):
        held = set(y.lines)
        if sum(n for h, n in zip(x.lines, x.sizes) if h not in held) < max(OWN * sum(x.sizes), 1):
            return False
    return True


def _starts(before: Page | None, page: Page) -> bool:
    """Whether a run of copies starts with the page."""
    return before is None or before.host != page.host or differs(before, page)


def _nearest(page: Page, before: Page | None, after: Page | None) -> Page | None:
    near = [p for p in (before, after) if p is not None and p.host == page.host and differs(p, page)]
    return max(near, key=lambda p: len(commonprefix([p.path, page.path])), default=None)


PAGE = "struct<host:string,path:string,lines:array<bigint>,sizes:array<int>>"
#: A page, or (page null) what others need of a partition: its first and last page, and of the runs that start after the
#: first page the first one's first page and the page before the last one.
CUT = f"part int, at bigint, h1 bigint, h2 bigint, page {PAGE}, first {PAGE}, last {PAGE}, start {PAGE}, ahead {PAGE}"
#: Sorted before a partition's pages: the page before it, the one before the run that is open there, the next run's first.
BORDER = f"part int, at bigint, h1 bigint, h2 bigint, page {PAGE}, previous {PAGE}, ahead {PAGE}, after {PAGE}"


def _page(x: dict | None) -> Page | None:
    return None if x is None else Page(x["host"], x["path"], x["lines"], x["sizes"])


def _row(x: Page | None) -> dict | None:
    return None if x is None else x._asdict()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            yield from batch.slice(k, 256).to_pylist()


def _mapped(df: DataFrame, ddl: str | StructType, work: Callable[[Iterator[dict]], Iterator[tuple]]) -> DataFrame:
    """Rows as dicts to rows as tuples."""
    schema = StructType.fromDDL(ddl) if isinstance(ddl, str) else ddl

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for row in work(_rows(batches)):
            rows.append(row)
            if len(rows) == 1000:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)

    return df.mapInArrow(run, schema)


def _hashed(rows: Iterator[dict]) -> Iterator[tuple]:
    """Pages that can have or be a neighbour."""
    for r in rows:
        lines = page_lines(r["_html"])
        if lines:
            hashes = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x, _ in lines]
            yield (r["_key"], r["h1"], r["h2"],
                   {"host": r["_host"], "path": r["_path"], "lines": hashes, "sizes": [len(x) for x, _ in lines]})


def _cut(rows: Iterator[dict]) -> Iterator[tuple]:
    """A partition's pages in order, and the row for its borders."""
    part = TaskContext.get().partitionId()
    first = last = start = ahead = None
    for at, r in enumerate(rows):
        page = _page(r["page"])
        if first is None:
            first = page
        elif _starts(last, page):
            start, ahead = start or page, last
        last = page
        yield part, at, r["h1"], r["h2"], r["page"], None, None, None, None
    if first is not None:
        yield part, -1, None, None, None, _row(first), _row(last), _row(start), _row(ahead)


def _opened(rows: Iterator[dict]) -> Iterator[tuple]:
    """Of each partition with the last page before it: the first page of its first run, and the page before its last run."""
    for r in rows:
        start, ahead = r["start"], r["ahead"]
        if r["previous"] is not None and _starts(_page(r["previous"]), _page(r["first"])):
            start, ahead = r["first"], ahead or r["previous"]
        yield r["part"], r["previous"], start, ahead


def _shared(rows: Iterator[dict]) -> Iterator[tuple]:
    """The places of lines that the nearest page has too, marked or not. Rows by partition, its borders first."""
    last: Page | None = None
    ahead: Page | None = None
    after: Page | None = None
    run: list[tuple[int, int, Page]] = []

    def closed(behind: Page | None) -> Iterator[tuple]:
        for h1, h2, page in run:
            other = _nearest(page, ahead, behind)
            shared = shared_lines(page.lines, other.lines) if other else set()
            if shared:
                yield h1, h2, sorted(shared)
        run.clear()

    for r in rows:
        if r["page"] is None:
            yield from closed(after)
            last, ahead, after = _page(r["previous"]), _page(r["ahead"]), _page(r["after"])
            continue
        page = _page(r["page"])
        if _starts(last, page):
            yield from closed(page)
            ahead = last
        run.append((r["h1"], r["h2"], page))
        last = page
    yield from closed(after)


def shared_places(source: DataFrame, scratch: Scratch) -> DataFrame:
    """(h1, h2, shared) of the pages that share lines with their neighbour."""
    pages = _mapped(source.where("_host <> ''").select("_key", "h1", "h2", "_host", "_path", "_html"),
                    keyed(source, "_key", f"h1 bigint, h2 bigint, page {PAGE}"), _hashed)
    order = ["page.host", "page.path", "_key", "h1", "h2"]
    ordered = pages.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = scratch.keep(_mapped(ordered, CUT, _cut), "cut")
    along, back = (Window.partitionBy(F.lit(1)).orderBy(by) for by in ("part", F.desc("part")))  # one row for each partition
    ends = cut.where("page is null").select("part", F.lag("last").over(along).alias("previous"), "first", "start", "ahead")
    opened = scratch.keep(_mapped(ends, f"part int, previous {PAGE}, start {PAGE}, ahead {PAGE}", _opened), "opened")
    borders = opened.select(
        "part", F.lit(-1).cast("bigint").alias("at"), *(F.lit(None).cast(t).alias(c) for c, t in (("h1", "bigint"), ("h2", "bigint"), ("page", PAGE))),
        "previous", F.last("ahead", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("ahead"),
        F.last("start", True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("after"))
    rows = cut.where("page is not null").select(
        "part", "at", "h1", "h2", "page", *(F.lit(None).cast(PAGE).alias(c) for c in ("previous", "ahead", "after")))
    rows = rows.union(borders).repartitionByRange("part").sortWithinPartitions("part", "at")
    return scratch.keep(_mapped(rows, "h1 bigint, h2 bigint, shared array<int>", _shared).dropDuplicates(["h1", "h2"]), "shared")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Key, url and text of every page."""
    rest = F.regexp_extract(url, r"://(.*)$", 1)
    # Rows with the same two hashes have the same place and lines, and so the same neighbours.
    row = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, url, html)] + [F.col(key).isNull()]
    source = pages.select(
        F.col(key).alias("_key"), F.col(url).alias("_url"), F.xxhash64(*row).alias("h1"), F.xxhash64(F.lit(1), *row).alias("h2"),
        F.coalesce(F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit("")).alias("_host"),
        F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")).alias("_path"), F.col(html).alias("_html"))
    shared = shared_places(source, Scratch(pages.sparkSession, "pages"))

    def alone(rows: Iterator[dict]) -> Iterator[tuple]:
        """Texts of the pages that can have no neighbour."""
        for r in rows:
            yield r["_key"], r["_url"], main_text(page_lines(r["_html"]), set())

    def paired(rows: Iterator[dict]) -> Iterator[tuple]:
        """Lines of the others; what they share is taken off before the marks correct it."""
        for r in rows:
            lines = page_lines(r["_html"])
            yield r["_key"], r["_url"], r["h1"], r["h2"], [x for x, _ in lines], [zone for _, zone in lines]

    def texts(rows: Iterator[dict]) -> Iterator[tuple]:
        for r in rows:
            yield r["_key"], r["_url"], main_text(list(zip(r["lines"], r["zones"])), set(r["shared"] or ()))

    fields = [pages.select(key).schema[0], pages.select(url).schema[0]]
    schema = StructType([*fields, *StructType.fromDDL("text string").fields])
    lines = StructType([*source.schema.fields[:2], *StructType.fromDDL("h1 bigint, h2 bigint, lines array<string>, zones array<int>").fields])
    hostless = _mapped(source.where("_host = ''").select("_key", "_url", "_html"), schema, alone)
    held = _mapped(source.where("_host <> ''").select("_key", "_url", "h1", "h2", "_html"), lines, paired).join(shared, ["h1", "h2"], "left")
    return hostless.union(_mapped(held.select("_key", "_url", "lines", "zones", "shared"), schema, texts))


def _batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), arrow.field(i).type) for i, c in enumerate(zip(*rows))], names=schema.names)
