"""Main text of web pages by nearest-URL page differencing.

A page is read into lines, one for each block of text.  What HTML itself marks as no article is left out while reading:
scripts, styles, comments, menus, headers, footers, sidebars, forms, hidden parts, and elements whose id, role or a class
is the name of an advert, notice, menu or reader comments or, on a container, ends with one ("post-comments").  A name
takes out no ``article``, ``main`` or heading.  Inside an article it takes out adverts and reader comments, and blocks
whose text is mostly links; what else has such a name there goes if the nearest page shares it.  What holds most of the
page's text goes by no other name than that of adverts and comments.

Within each host, pages are ordered by URL path and each is paired with the neighbour of other content whose path shares
the longer beginning.  The two pages' lines are aligned by a longest common subsequence, and shared lines are deleted as
the site's furniture.  Unnamed lines inside the article are not deleted: pages of one host also share article paragraphs
(quotations, copies), which belong to the text.

The article is ``main`` (or ``role="main"``), else each ``article`` that is not mostly links; in a menu, sidebar or
footer neither counts.  A page without one keeps all lines that its neighbour does not share.

Pages are paired without gathering a host: each host's distinct lists of line hashes are range-partitioned by host and
path, neighbours inside a part are found by a window, and only each part's first and last page cross over.

Time grows in proportion to a page's length, the alignment's with the product of two pages' shared lines, a machine word
at a time.  Defined results: null or empty HTML gives an empty text; a null or malformed URL has host '' and the whole
URL as path; a host's only page, or one with nothing but copies beside it, is compared with nothing; rows that are alike
in id, URL and HTML have equal results; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import ship, stored
from .text import prefix_sums, signed, span_hash

# fixed values: element names and the words that name furniture in class, id and role
_DROPPED = frozenset("script style noscript template svg iframe object head title nav footer aside form select button textarea dialog menu".split())
_SIDE = frozenset("nav aside footer menu dialog".split())  # an article in one of these is a card or a teaser
_BLOCKS = frozenset(
    "address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_IN_HEAD = frozenset("title meta link base script style noscript template".split())
_ENDS_ITSELF = frozenset("p li dt dd tr td th option".split())
_LANDMARK = frozenset(("article", "main"))
_FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion recommended related replies "
    "search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
_READERS = frozenset("ad ads advert adverts advertisement advertising comments disqus replies sponsored".split())  # never the article's
_HOLDERS = frozenset("aside div figure ins ol section table ul".split())
_MODIFIERS = frozenset("has hide no show with without".split())  # "has-sidebar" tells of a layout
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)", re.S | re.I)
_OPEN = re.compile(r"<(/?)([a-zA-Z][\w:-]*)")
_PLAIN = re.compile(r"""[^<>"']*+(?:(?:"[^"<>]*+"|'[^'<>]*+')[^<>"']*+)*+>""")  # attributes without angle brackets in quotes
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'<>=]++))?+""")
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)

OUTSIDE, TEXT, SUSPECT, OPEN = range(4)  # kinds of lines: beside the article; of it; in a named block in it; of a page without one


def _tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """``(start, end, "/" or "", name, attributes)`` of each tag.

    A quote that is never closed does not hide the rest of the page: such a tag ends at the next angle bracket.  Places
    from which no tag end can be reached are remembered, so the time is linear in the page's length.
    """
    at, dead = 0, set()
    while (m := _OPEN.search(page, at)) is not None:
        start, at = m.start(), m.end()
        plain = _PLAIN.match(page, at)
        end = plain.end() if plain else -1
        if end < 0:
            k, path = at, []
            while k not in dead and (stop := _STOP.search(page, k)) is not None:
                if stop.group() == ">":
                    end = stop.end()
                    break
                path.append(k)
                k = page.find(stop.group(), stop.end()) + 1
                if k == 0:
                    break
            if end < 0:
                dead.update(path)
                end = page.find(">", at) + 1
                cut = page.find("<", at)
                if end == 0 or 0 <= cut < end - 1:
                    if cut < 0:
                        yield start, len(page), "/", "", ""  # a tag cut off by the page's end
                        return
                    end = cut
        yield start, end, m.group(1), m.group(2).lower(), page[at : end - 1 if page[end - 1] == ">" else end]
        at = end


def _named(name: str, attributes: str) -> tuple[bool, set[str]]:
    """Whether an element is hidden, and the words of furniture that a class, the id or the role is or ends with."""
    hidden, words = False, set()
    if not attributes or _TELLING.search(attributes) is None:
        return hidden, words
    named = name not in ("html", "body") and name not in _LANDMARK and name not in _HEADINGS
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value.strip() == "true"):
            hidden = True
        elif key == "style":
            hidden = hidden or "display:none" in "".join(value.split())
        elif named and key in ("class", "id", "role"):
            for v in [value.strip()] if key == "id" else value.split():
                parts = re.split(r"[-_]+", v)
                if v in _FURNITURE:
                    words.add(v)
                elif name in _HOLDERS and parts[-1] in _FURNITURE and parts[0] not in _MODIFIERS:
                    words.add(parts[-1])
                elif name in _HOLDERS and v == "site-header":
                    words.add(v)
    return hidden, words


class _Page:
    """A page's elements, in the order in which they open, and its stretches of text."""

    def __init__(self, html: str):
        self.name, self.attributes, self.parent, self.begin, self.closed = ["html"], [""], [0], [0], [True]
        self.tokens: list[tuple[int, str | None]] = []  # (element, text); None: the element opens or ends here
        self.own, self.linked = [0], [0]
        stack, places = [0], {"html": [0]}  # places: where in the stack elements of a name stand
        blocks = [0]

        def leave(height: int) -> None:
            while len(stack) > height:
                e = stack.pop()
                places[self.name[e]].pop()
                if blocks and blocks[-1] == len(stack):
                    blocks.pop()
                self.tokens.append((e, None))

        def say(text: str) -> None:
            e, n = stack[-1], len("".join(text.split()))
            self.tokens.append((e, text))
            self.own[e] += n
            if places.get("a"):
                self.linked[e] += n

        page, at = _RAW.sub(" ", html), 0
        for start, end, ends, name, attributes in _tags(page):
            if start > at:
                say(page[at:start])
            at = end
            if not name:
                break
            if ends:
                where = places.get(name)
                # an inline element ends within its block; nothing but its own end tag ends an article
                if where and (name in _BLOCKS or where[-1] > blocks[-1]):
                    over = max((places[k][-1] for k in _LANDMARK if places.get(k)), default=0)
                    if where[-1] >= over or name in ("body", "html"):
                        self.closed[stack[where[-1]]] = True
                        leave(where[-1])
                continue
            if places.get("head") and name not in _IN_HEAD:
                leave(places["head"][-1])
            nearest = self.name[stack[blocks[-1]]]
            if name in _BLOCKS and name not in _VOID and (nearest == "p" or nearest == name and name in _ENDS_ITSELF):
                leave(blocks[-1])
            if name in _VOID or attributes.endswith("/"):
                if name in _BLOCKS:
                    self.tokens.append((-1, None))
                continue
            e = len(self.name)
            self.name.append(name)
            self.attributes.append(attributes)
            self.parent.append(stack[-1])
            self.begin.append(len(self.tokens))
            self.closed.append(False)
            self.own.append(0)
            self.linked.append(0)
            self.tokens.append((e, None))
            places.setdefault(name, []).append(len(stack))
            if name in _BLOCKS or name in _DROPPED:
                blocks.append(len(stack))
            stack.append(e)
        if at < len(page):
            rest = page[at:]
            say(rest[: rest.rfind("<")] if re.search(r"<[/a-zA-Z][^<>]*\Z", rest) else rest)
        leave(1)


def blocks(html: str) -> tuple[list[str], list[int]]:
    """A page's text blocks and the kind of each."""
    page = _Page(html)
    n, never = len(page.name), len(page.tokens) + 1
    name, parent = page.name, page.parent
    said = [_named(name[e], page.attributes[e]) for e in range(n)]
    role = [any(k.lower() == "role" and v.strip("\"'").lower() == "main" for k, v in _ATTRIBUTE.findall(x)) if "main" in x else False for x in page.attributes]
    mark = [name[e] in _LANDMARK or role[e] for e in range(n)]
    text, linked, marks, mains = page.own[:], page.linked[:], [0] * n, [0] * n
    first = [never] * n  # where the first landmark or the body inside begins
    for e in range(n - 1, 0, -1):
        up = parent[e]
        text[up] += text[e]
        linked[up] += linked[e]
        marks[up] += marks[e] + mark[e]
        mains[up] += mains[e] + (mark[e] and name[e] != "article")
        first[up] = min(first[up], page.begin[e] if mark[e] or name[e] == "body" else first[e])
    # left out up to which token (0: not at all); whether an article is around; in a named block of an article
    until, around, suspect = [0] * n, [False] * n, [False] * n
    for e in range(1, n):
        up = parent[e]
        around[e], suspect[e] = around[up] or mark[e], suspect[up]
        hidden, words = said[e]
        furniture = hidden or name[e] in _DROPPED or (name[e] == "header" and not around[up])
        if name[e] not in _SIDE and not hidden and (mains[e] or marks[e] and marks[e] + mark[e] == marks[0]):
            furniture = False  # a form or header around the article
        elif not furniture and words and not mark[e]:
            mostly = 2 * linked[e] > text[e]
            if around[up]:
                furniture = mostly or (bool(words & _READERS) and name[e] in _HOLDERS)
                suspect[e] = True
            else:  # a name on what holds most of the page tells of its layout
                furniture = mostly or bool(words & _READERS) or 2 * text[e] <= text[0] or name[e] == "p"
        own = 0
        if furniture:
            own = never if page.closed[e] or first[e] == never else first[e]
        until[e] = max(until[up] if page.begin[e] < until[up] else 0, own)
    live = [e for e in range(1, n) if mark[e] and page.begin[e] >= until[e]]
    if any(name[e] != "article" and text[e] for e in live):
        live = [e for e in live if name[e] != "article"]  # an article beside main is a card; one in it is main's
    elif any(2 * linked[e] <= text[e] and text[e] for e in live):
        live = [e for e in live if 2 * linked[e] <= text[e]]
    chosen = set(live)
    inside = [False] * n
    for e in range(1, n):
        inside[e] = e in chosen or inside[parent[e]]
    out: list[str] = []
    kinds: list[int] = []
    parts: list[str] = []
    kind = OPEN

    def close() -> None:
        if parts:
            line = " ".join(entities.unescape("".join(parts)).split())
            if line:
                out.append(line)
                kinds.append(kind)
            parts.clear()

    for t, (e, words) in enumerate(page.tokens):
        if words is None:
            if e < 0 or name[e] in _BLOCKS or until[e] > page.begin[e]:
                close()
        elif t >= until[e]:
            if not parts:
                kind = OPEN if not chosen else OUTSIDE if not inside[e] else SUSPECT if suspect[e] else TEXT
            parts.append(words)
    close()
    return out, kinds


def lines(html: str) -> tuple[list[str], list[bool], bool]:
    """A page's text blocks, whether each stands in its article or main element, and whether there is such an element."""
    out, kinds = blocks(html)
    return out, [k in (TEXT, SUSPECT) for k in kinds], any(k != OPEN for k in kinds)


ROW_BITS = 1 << 28  # bits of alignment rows that are held at once; longer pages are halved first


def _grow(x: list[int], where: dict[int, int], full: int) -> Iterator[int]:
    """One row of bits for each line of ``x``: bit j is 0 where the common length grows at column j."""
    row = full
    for v in x:
        hit = row & where.get(v, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _columns(y: list[int]) -> dict[int, int]:
    at: dict[int, list[int]] = {}
    for k, v in enumerate(y):
        at.setdefault(v, []).append(k)
    out = {}
    for v, ks in at.items():
        bits = bytearray(ks[-1] // 8 + 1)
        for k in ks:
            bits[k >> 3] |= 1 << (k & 7)
        out[v] = int.from_bytes(bits, "little")
    return out


def _lengths(x: list[int], y: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``x`` with each beginning of ``y``."""
    row = full = (1 << len(y)) - 1
    for row in _grow(x, _columns(y), full):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(y)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def common(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b`` (bit-parallel rows over ``b``, halved where they are many)."""
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    also = set(a[start : len(a) - end]) & set(b[start : len(b) - end])  # other lines are in no common subsequence
    places = [k for k in range(start, len(a) - end) if a[k] in also]
    x, y = [a[k] for k in places], [v for v in b[start : len(b) - end] if v in also]
    if len(x) > 1 and len(x) * len(y) > ROW_BITS:
        half = len(x) // 2
        cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        middle = [places[k] for k in common(x[:half], y[:cut])] + [places[half + k] for k in common(x[half:], y[cut:])]
        return [*range(start), *middle, *range(len(a) - end, len(a))]
    rows = list(_grow(x, _columns(y), (1 << len(y)) - 1))
    middle, j = [], len(y) - 1
    for i in range(len(x) - 1, -1, -1):
        while j >= 0 and rows[i] >> j & 1:
            j -= 1
        if j < 0:
            break
        if i == 0 or rows[i - 1] >> j & 1:
            middle.append(places[i])
            j -= 1
    return [*range(start), *middle[::-1], *range(len(a) - end, len(a))]


def _read(pages: pa.Array) -> pa.Array:
    hashes, deletable = [], []
    for t in pages.to_pylist():
        rows, kinds = blocks(t or "")
        raw = [r.encode("utf-8", "surrogatepass") for r in rows]
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        sums = prefix_sums(np.frombuffer(b"".join(raw), dtype=np.uint8))
        hashes.append(signed(span_hash(sums, np.r_[0, ends[:-1]].astype(np.int64), ends)).tolist() if rows else [])
        deletable.append([k for k, kind in enumerate(kinds) if kind in (SUSPECT, OPEN)])
    return pa.StructArray.from_arrays(
        [pa.array(hashes, type=pa.list_(pa.int64())), pa.array(deletable, type=pa.list_(pa.int32()))], names=["lines", "may"]
    )


def _shared(own: pa.Array, may: pa.Array, other: pa.Array) -> pa.Array:
    out = []
    for a, can, b in zip(own.to_pylist(), may.to_pylist(), other.to_pylist()):
        both = set(common(a or [], b or []))
        out.append([k for k in can or [] if k in both])
    return pa.array(out, type=pa.list_(pa.int32()))


def _extract(pages: pa.Array, gone: pa.Array) -> pa.Array:
    out = []
    for t, drop in zip(pages.to_pylist(), gone.to_pylist()):
        lost = set(drop or ())
        out.append("\n".join(r for k, (r, kind) in enumerate(zip(*blocks(t or ""))) if kind != OUTSIDE and k not in lost))
    return pa.array(out, type=pa.string())


def _like(a: Column, b: Column) -> Column:
    """Number of leading path segments that two paths share."""
    both = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: x.eqNullSafe(y))
    return F.coalesce(F.array_position(both, F.lit(False)) - 1, F.lit(-1)) + F.when(~F.array_contains(both, False), 1_000_000).otherwise(0)


def shared_lines(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(k1, k2, gone)``: the numbers of lines to delete, as the nearest different page shares them.

    ``k1`` is the id (null: the least integer), ``k2`` a hash of URL and HTML; together they name rows that are alike.
    Pages of a host with equal lists of lines stand as one (the first by path), so a copy is nobody's nearest page.
    """
    u = F.coalesce(F.col(url), F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.when(host == "", u).otherwise(F.regexp_replace(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""))
    path = F.regexp_replace(path, r"[?#].*$", "")
    read = F.arrow_udf(_read, "struct<lines:array<bigint>,may:array<int>>").asNondeterministic()(F.col(html))
    rows = _keyed(pages, page_id, url, html).select("k1", "k2", host.alias("host"), path.alias("path"), read.alias("r"))
    rows = rows.select("k1", "k2", "host", "path", "r.lines", "r.may", F.xxhash64("r.lines", "r.may").alias("same"))
    rows = stored(rows.where(F.size("lines") > 0), "pages-lines")
    order = ["host", "path", "same"]
    kinds = rows.groupBy("host", "same").agg(F.min("path").alias("path"), F.any_value("lines").alias("lines"), F.any_value("may").alias("may"))
    kinds = kinds.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    kinds = stored(kinds, "pages-kinds")
    page = F.struct("host", "path", "lines")
    along = Window.partitionBy("part").orderBy(*order)
    edges = kinds.groupBy("part").agg(F.min_by(page, F.struct(*order)).alias("head"), F.max_by(page, F.struct(*order)).alias("tail"))
    line = Window.orderBy("part")  # one row a part
    edges = edges.select("part", F.lag("tail").over(line).alias("last"), F.lead("head").over(line).alias("next"))
    pairs = kinds.withColumns({"a": F.lag(page).over(along), "b": F.lead(page).over(along)}).join(edges, "part")
    pairs = pairs.withColumns({"a": F.coalesce("a", "last"), "b": F.coalesce("b", "next")}).where(F.size("may") > 0)
    other = lambda c: (F.col(f"{c}.host") == F.col("host")) & ~F.col(f"{c}.lines").eqNullSafe(F.col("lines"))
    same = lambda c: F.when(other(c), _like(F.col("path"), F.col(f"{c}.path"))).otherwise(-2)
    near = F.when((same("a") >= same("b")) & (same("a") > -2), F.col("a.lines")).when(same("b") > -2, F.col("b.lines"))
    found = pairs.select("host", "same", "lines", "may", near.alias("other")).where("other IS NOT NULL")
    gone = found.select("host", "same", F.arrow_udf(_shared, "array<int>").asNondeterministic()("lines", "may", "other").alias("gone"))
    gone = rows.select("k1", "k2", "host", "same").distinct().join(gone.where(F.size("gone") > 0), ["host", "same"])
    return gone.groupBy("k1", "k2").agg(F.min("gone").alias("gone"))


def _keyed(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    k1 = F.coalesce(F.col(page_id).cast("bigint"), F.lit(-(1 << 63)))
    return pages.withColumns({"k1": k1, "k2": F.xxhash64(F.col(url), F.col(html))})


def main_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every page."""
    ship(pages.sparkSession)
    pages = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    gone = stored(shared_lines(pages), "pages-shared")
    rows = _keyed(pages, "page_id", "url", "html").join(gone, ["k1", "k2"], "left")
    text = F.arrow_udf(_extract, "string").asNondeterministic()("html", "gone")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
