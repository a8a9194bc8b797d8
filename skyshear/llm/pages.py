"""Main text of web pages by differencing with the pages of nearest URL.

A page's body is divided into lines of text, one a block, each with its place:
inside the main container (article or main), in a part that its markup names as
no text of the article (menu, header, footer, sidebar, notice, advert, form,
comments), or elsewhere. Markup decides first, since differencing alone gives
wrong results where menus and adverts differ from page to page (the README has
figures). Pages are ordered by host and URL path, and each is
aligned with its neighbours on the same host by the longest common subsequence
of their lines. Shared lines are the site's frame and go; unshared ones stay, in
the main container or not, unless their markup names them as no text. Two guards
keep the article whole: in a container with lines of its own, shared lines are
quotations and stay, and a neighbour that shares nearly all its lines is a copy
that says nothing about the frame.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import parts
from .common import ranges, table

#: Elements whose content is no text.
DROPPED = frozenset("script style noscript template svg math iframe object canvas select textarea button head title audio video".split())
#: Elements that end a block where they start and end.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements of a head; any other start tag ends one whose end tag is left out.
HEAD = frozenset("base basefont bgsound link meta noframes noscript object script style template title".split())
#: Dropped elements in which the end of a parent says nothing.
SEALED = frozenset("template textarea title iframe".split())
#: Elements that never have an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are the article's own.
MAIN = frozenset(("article", "main"))
#: Elements that class, id or role never make frame.
WHOLE = MAIN | {"html", "body"}
#: Elements and words of class, id or role that name what isn't the article.
FRAME = frozenset("nav aside footer form menu dialog search".split())
FRAME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar cookie cookies consent notice notices newsletter subscribe share social related comment comments respond replies popup modal complementary contentinfo search".split()
)
#: Parts of a name that say nothing by themselves, and those that turn a name round.
NEUTRAL = frozenset("site page post posts block blocks box list section wrap wrapper container widget area bar inner outer top bottom links buttons form slot unit item items global primary secondary thread group panel article articles".split())
TURNED = frozenset("no not non has with without hide hidden is".split())
#: The columns that pages are ordered by.
KEY = ("_host", "_path", "_url", "_id")
#: Pages that a range gets from each side.
BORDER = 2
#: A pair that shares so much of the longer content is a pair of copies.
COPY = 0.8
#: Private characters, one of which, not in the page, stands for an ampersand until its block is whole.
MARKS = (*range(0xE000, 0xF900), *range(0xF0000, 0x10FFFE))
WHITE = re.compile(r"\s+")
#: Elements that the start of another one ends, and the elements that such an end doesn't pass.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}


@dataclass
class Line:
    text: str
    main: int  # number of the outermost main container around it, 0 outside
    frame: bool
    weak: str = ""  # a name around it that makes it frame where a neighbour has a block of that name


def named_frame(names: str, heads: bool, inside: bool) -> tuple[bool, str]:
    """Whether the words of class, id and role name what isn't the article, and a name among them that may.

    Whole words count: those of frame words alone, or outside a main container
    with parts that say nothing. Any other that holds a frame word is only a hint.
    ``heads``: a header is the article's own here.
    """
    hint = ""
    for name in names.replace("side-bar", "sidebar").replace("side_bar", "sidebar").split():
        parts = [x for x in re.split(r"[_-]+", name) if x]
        found = [x for x in parts if x in FRAME_WORDS and not (heads and x in ("header", "masthead"))]
        if not found or TURNED & set(parts):
            continue
        other = [x for x in parts if x not in FRAME_WORDS]
        if not other or not inside and NEUTRAL.issuperset(other):
            return True, ""
        hint = hint or name
    return False, hint


class Blocks(HTMLParser):
    """The lines of a page, in order, from markup however broken."""

    def __init__(self, page: str = "", mark: str = "") -> None:
        super().__init__(convert_charrefs=False)
        self.page, self.mark = page, mark
        self.lowered: str | None = None
        self.ends: dict[str, tuple[int, int]] = {}
        self.inline: Counter[str] = Counter()
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, bool, str]] = []
        self.hints: list[str] = []
        self.held: list[str] = []
        self.mains = 0
        self.boxes = 0
        self.frames = 0
        self.muted = 0  # open inline elements that are frame: what they hold is left out of its block
        self.skip: list[str] = []
        self.drops: list[tuple[int, bool]] = []  # place in skip of each dropped element, and whether it has an end

    def flush(self) -> None:
        if self.held:
            text = WHITE.sub(" ", entities.unescape("".join(self.held).replace(self.mark, "&"))).strip()
            self.held = []
            if text:
                self.lines.append(Line(text, self.boxes if self.mains else 0, self.frames > 0, self.hints[-1] if self.hints else ""))

    def ended(self, tag: str) -> bool:
        """Whether an end tag of ``tag`` follows anywhere."""
        if tag not in self.ends:
            self.lowered = self.page.lower() if self.lowered is None else self.lowered
            at = self.lowered.rfind("</" + tag)
            self.ends[tag] = (1 + self.lowered.count("\n", 0, at), at - self.lowered.rfind("\n", 0, at) - 1) if at >= 0 else (0, 0)
        return self.ends[tag] > self.getpos()

    def broken(self, tag: str) -> bool:
        """Whether ``tag`` starts what can't be in the innermost dropped element, so that ends there."""
        at, closed = self.drops[-1]
        outer = self.skip[at]
        if outer == "head":
            return tag not in HEAD and tag != "head"
        if tag == "body":
            return outer not in SEALED or not closed
        if tag not in BLOCKS:
            return False
        return not closed or outer in ("svg", "math") and not {"foreignobject", "desc", "annotation-xml"} & set(self.skip[at:])

    def drop(self, tag: str) -> None:
        if tag in DROPPED:
            self.drops.append((len(self.skip), self.ended(tag)))
        self.skip.append(tag)

    def undrop(self, at: int) -> None:
        del self.skip[at:]
        while self.drops and self.drops[-1][0] >= at:
            self.drops.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while self.skip and self.broken(tag):
            self.undrop(self.drops[-1][0])
        if self.skip or tag in DROPPED:
            if tag not in VOID:
                self.drop(tag)
            return
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.held.append("\n")
        if tag in VOID:
            return
        if tag in BLOCKS and self.open and self.open[-1][0] == "p":
            self.close(len(self.open) - 1)
        self.end_before(tag)
        named = " ".join(v.lower() for k, v in attrs if k in ("class", "id", "role") and v)
        inside = self.mains > 0
        main = tag in MAIN or any(k == "role" and v == "main" for k, v in attrs)
        heads = tag == "header" or "header" in named  # of the page, outside an article; the article's own inside
        by_name, hint = (False, "") if main or tag in WHOLE else named_frame(named, inside and heads, inside)
        frame = tag in FRAME or tag == "header" and not inside or by_name
        hint = "" if frame else hint
        main = main and not frame
        if tag not in BLOCKS:
            self.inline[tag] += 1
        if tag in BLOCKS or frame or main or hint:
            self.open.append((tag, main, frame, hint))
            self.hints += [hint] if hint else []
            self.boxes += main and not inside
            self.mains += main
            self.frames += frame
            self.muted += frame and tag not in BLOCKS

    def end_before(self, tag: str) -> None:
        """Ends the open elements that HTML ends where ``tag`` starts."""
        if tag not in ENDS:
            return
        ended, bounds = ENDS[tag]
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] in bounds:
                break
            if self.open[at][0] in ended:
                self.close(at)

    def close(self, at: int) -> None:
        for tag, main, frame, hint in self.open[at:]:
            self.mains -= main
            self.muted -= frame and tag not in BLOCKS
            self.frames -= frame
            if hint:
                self.hints.pop()
        del self.open[at:]

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag in self.skip:
                self.undrop(len(self.skip) - 1 - self.skip[::-1].index(tag))
                return
            at, closed = self.drops[-1]
            if self.skip[at] in SEALED and closed or not self.inline[tag] and all(tag != x for x, *_ in self.open):
                return
            self.undrop(0)
        self.inline[tag] -= self.inline[tag] > 0
        if tag in BLOCKS:
            self.flush()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self.close(at)
                break

    def handle_data(self, data: str) -> None:
        if self.skip == ["head"] and data.strip():
            self.undrop(0)
        if not self.skip and not self.muted:
            self.held.append(data)

    def close_input(self) -> None:
        """What is left at the end of the page, an unfinished tag included, is text of its block."""
        HTMLParser.close(self)
        self.flush()


def finished(page: str) -> str:
    """``page`` with each < after its last > as a reference: no tag ends there, and the parser would look for its end from every one of them."""
    last = page.rfind(">") + 1
    comment = page.find("<!--", last)
    tail = page[last:] if comment < 0 else page[last:comment]
    return page[:last] + tail.replace("<", "&lt;") + page[last + len(tail) :]


def lines_of(page: str | None) -> list[Line]:
    """The lines of a page; null has none. An ampersand passes the parser as a mark, so references are decoded once, in whole blocks."""
    page = finished(page or "")
    mark = next(c for c in map(chr, MARKS) if c not in page)
    marked = page.replace("&", mark)
    parser = Blocks(marked, mark)
    parser.feed(marked)
    parser.close_input()
    return parser.lines


def shared(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``.

    Equal ends are taken first; a row of lengths a line of ``a`` as bits of one
    number finds the rest, so long pages cost len(a) * len(b) / 64.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = {*range(head), *range(len(a) - tail, len(a))}
    mid_a, mid_b = a[head : len(a) - tail], b[head : len(b) - tail]
    common = set(mid_a) & set(mid_b)
    xs, ys = [i for i, v in enumerate(mid_a) if v in common], [j for j, v in enumerate(mid_b) if v in common]
    if not xs or not ys:
        return out
    where: dict[str, int] = {}
    for bit, j in enumerate(ys):
        where[mid_b[j]] = where.get(mid_b[j], 0) | 1 << bit
    full, rows, v = (1 << len(ys)) - 1, [], (1 << len(ys)) - 1
    for i in xs:
        u = v & where[mid_a[i]]
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    # walk back: a zero bit in a row is a step of the length up to that column
    j = len(ys)
    for r in range(len(xs) - 1, -1, -1):
        if not j:
            break
        now = rows[r]
        before = rows[r - 1] if r else full
        length = lambda row, upto: upto - bin(row & ((1 << upto) - 1)).count("1")
        while j and length(now, j) == length(now, j - 1):
            j -= 1
        if j and length(before, j) < length(now, j):
            out.add(head + xs[r])
            j -= 1
    return out


def witness(page: list[Line], other: list[Line]) -> set[int] | None:
    """Places of ``page`` that it shares with ``other``; none if that is empty or a copy.

    Copies share nearly all characters that markup doesn't name frame: lines of a menu are many but short.
    Lines in a block whose name is only a hint are shared where the other page has a block of that name.
    """
    if not other:
        return None
    both, weigh = shared([x.text for x in page], [x.text for x in other]), lambda lines: sum(len(x.text) for x in lines if not x.frame)
    most = max(weigh(page), weigh(other))
    if most and weigh(page[i] for i in both) >= COPY * most:
        return None
    names = {x.weak for x in other if x.weak}
    return both | {i for i, x in enumerate(page) if x.weak in names}


def difference(page: list[Line], others: list[list[Line]]) -> list[Line]:
    """The lines of ``page`` that aren't frame by its neighbours ``others``."""
    return rest(page, set().union(*(witness(page, other) or () for other in others)))


def rest(page: list[Line], frame: set[int]) -> list[Line]:
    """The lines of ``page`` that aren't frame: named so by markup, or shared with a neighbour at the places ``frame``.

    Lines in a block whose name is a hint go if they are among these places.
    Shared lines stay where their main container has lines of its own. Containers
    that are shared whole are teasers if the page has lines of its own elsewhere;
    a single one, only if those are longer.
    """
    text = [(i, x) for i, x in enumerate(page) if not x.frame and not (x.weak and i in frame)]
    kept, boxes = {x.main for i, x in text if x.main and i not in frame}, {x.main for _, x in text if x.main}
    if not kept:
        own, held = sum(len(x.text) for i, x in text if i not in frame), sum(len(x.text) for _, x in text if x.main)
        kept = boxes if not own or len(boxes) == 1 and own <= held else kept
    return [x for i, x in text if i not in frame or x.main in kept]


class Node:
    """A page, with the pages that follow it and have equal lines."""

    def __init__(self, page: str | None, lines: list[Line], before: Node | None) -> None:
        self.page, self.lines, self.rows, self.waits, self.frame = page, lines, [], [], set()
        self.before = before
        while self.before is not None and (found := witness(lines, self.before.lines)) is None:
            self.before = self.before.before
        if self.before is not None:
            self.frame |= found


class Host:
    """Pages of one host in order; each is settled when a page that isn't its copy follows, or at the end."""

    def __init__(self) -> None:
        self.first: Node | None = None
        self.last: Node | None = None
        self.settled: list[tuple] = []

    def add(self, row: tuple | None, page: str | None) -> None:
        """``row`` is none for a page that another range settles."""
        last = self.last
        if last is None or page != last.page:
            lines = lines_of(page)
            if last is None or lines != last.lines:
                self.last = Node(page, lines, last)
                self.first = self.first or self.last
                if last is not None:
                    self.settle(last, self.last)
                self.forget()
        if row is not None:
            self.last.rows.append(row)

    def forget(self) -> None:
        """Links lead some pages back, then to the host's first, so lines that are long past go."""
        node = self.last
        for _ in range(8):
            node = node and node.before
        if node is not None and node is not self.first:
            node.before = self.first

    def settle(self, node: Node, after: Node | None) -> None:
        todo = [node]
        while todo:
            node = todo.pop()
            found = set() if after is None else witness(node.lines, after.lines)
            if found is None:
                after.waits.append(node)
                continue
            if node.rows:
                text = "\n".join(x.text for x in rest(node.lines, node.frame | found))
                self.settled += [(*row, text, len(text)) for row in node.rows]
            todo += node.waits
            node.waits, node.rows = [], []

    def end(self) -> None:
        if self.last is not None:
            self.settle(self.last, None)


def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range of keys (host first): the first and last BORDER keys, the last key of its first host, the first of its last."""
    head: list[tuple] = []
    tail: list[tuple] = []
    end = start = None
    for batch in batches:
        for key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if tail and key == tail[-1]:
                continue
            if len(head) < BORDER:
                head.append(key)
            if key[0] == head[0][0]:
                end = key
            if not tail or key[0] != tail[-1][0]:
                start = key
            tail = [*tail[1 - BORDER :], key] if BORDER > 1 else [key]
    if head:
        found = [("head", *k) for k in head] + [("tail", *k) for k in tail] + [("end", *end), ("start", *start)]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(found), pa.int32()), *(pa.array([f[i] for f in found], pa.string()) for i in range(5))], ["part", "kind", *KEY])


def borders(ranges: list[dict[str, list[tuple]]]) -> dict[tuple, list[int]]:
    """The ranges that see a page of another range as neighbour, by its key: on both sides the BORDER nearest of the host, and the host's outermost."""
    out: dict[tuple, set[int]] = {}
    for near, far, first, ahead in (("tail", "start", "head", 1), ("head", "end", "tail", -1)):
        outermost = None
        for at in range(len(ranges))[::ahead]:
            host = ranges[at][first][0 if ahead > 0 else -1][0]
            seen, other = [], at - ahead
            while 0 <= other < len(ranges) and len(seen) < BORDER:
                keys = [k for k in ranges[other][near][::-ahead] if k[0] == host]
                seen += keys
                if len(keys) < len(ranges[other][near]):
                    break
                other -= ahead
            if outermost is not None and outermost[0] == host:
                seen = [*seen[:BORDER], outermost]
            for key in seen:
                out.setdefault(key, set()).add(at)
            here = ranges[at][far][0]
            outermost = outermost if outermost is not None and outermost[0] == host == here[0] else here
    return {k: sorted(v) for k, v in out.items()}


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages`` (page_id, url, html).

    Pages are dealt by range of (host, path), so a host of any size spreads over
    tasks. Ranges are cut by keys alone; each gets the pages next to it on both
    sides, and the outermost of their host, so a page meets the nearest page that
    isn't its copy whatever the number of ranges (the outermost one, if a run of
    copies passes both a cut and the border pages). A null url is a host of its
    own; null or empty html gives an empty text. Rows are kept apart even if
    equal (a copy is no witness); pages of any length are read whole, and tags
    that are never closed end where HTML ends them; an empty table gives an empty
    result; other columns are ignored.
    """
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|[?#].*$", "")
    key = [c.alias(k) for c, k in zip((host, path, url, F.coalesce(F.col("page_id").cast("string"), F.lit(""))), KEY, strict=True)]
    n = ranges(pages)
    found = pages.select(*key).repartitionByRange(n, *KEY).sortWithinPartitions(*KEY).mapInArrow(edges, "part int, kind string, " + ", ".join(f"{k} string" for k in KEY)).collect()
    by_part: dict[int, dict[str, list[tuple]]] = {}
    for r in found:
        by_part.setdefault(r[0], {}).setdefault(r[1], []).append(tuple(r[2:]))
    found = [{k: sorted(v) for k, v in by_part[p].items()} for p in sorted(by_part)]
    cuts, border = [r["head"][0] for r in found][1:], borders(found)
    kind = pages.schema["page_id"].dataType.simpleString()

    def dealt(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        keys = zip(*(x.to_pylist() for x in (a, b, c, d)), strict=True)
        return pa.array([[bisect_right(cuts, k), *(-1 - p for p in border.get(k, ()))] for k in keys], pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pages_of, done = None, Host(), []
        for batch in batches:
            for piece in parts(batch, 256):
                for page_id, link, page, *place, to in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    if place != now:
                        pages_of.end()
                        done += pages_of.settled
                        now, pages_of = place, Host()
                    pages_of.add((page_id, link) if to >= 0 else None, page)
                done, pages_of.settled = done + pages_of.settled, []
                while len(done) >= 512:
                    yield out(done[:512])
                    done = done[512:]
        pages_of.end()
        done += pages_of.settled
        for at in range(0, len(done), 512):
            yield out(done[at : at + 512])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in rows], t) for i, t in enumerate((pages_id, pa.string(), pa.string(), pa.int64()))], ["page_id", "url", "text", "n_chars"])

    pages_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    to = F.explode(F.arrow_udf(dealt, "array<int>")(*KEY)).alias("to")
    part = F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).alias("part")
    rows = pages.select("page_id", "url", "html", *key).select("page_id", "url", "html", *KEY, to).select("*", part)
    ordered = rows.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", *KEY)
    return ordered.select("page_id", "url", "html", "part", KEY[0], "to").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return extract(table(spark, sf_dir, "pages"))
