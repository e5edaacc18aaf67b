"""Main text of web pages by differencing pages of nearest URLs.

Pages are ordered by host and URL path, so that neighbours mostly come from one template. Each page is
cut into text blocks (the lines of the page), and its lines are aligned, by a longest common
subsequence, with those of the ``NEAR`` pages before and after it of the same host. That comes first, on every page:

- A line that more than half of the neighbours share is the template's and is deleted; headings of the main place (the one that holds
  most of the page's text) never are, its paragraphs and long lines if ``MANY`` neighbours share them.
- A place (the chain of elements and classes around a line) whose lines neighbours share again and again
  is a place of the template, and all its lines are deleted, also those that no neighbour has: menus and
  adverts that rotate. Shares are counted over the page and its neighbours (``SHARE`` of the lines or more).

Pages of which next to no text of their own is left are copies of each other and tell nothing; runs of
pages with the same html count as one page. Pages that share more than a little of the long lines and paragraphs of their
main place are related articles: they tell nothing about such lines, nor about places. Nothing inside the main place's element (that of most pages around, if the page has it) goes because of its place, and of a declared ``article`` or ``main``
only lines up to ``SHORT`` characters go that aren't paragraphs or headings; items of lists there only as
a whole.

Markup comes second and settles what differencing can't see: elements that are menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles or comments by tag or role are dropped, and so is
all outside the declared part where there is one (``main``, else the articles). Class names and ids are a
fallback for containers outside of it: headings, sections and paragraphs may be named anything. Inside it
only containers whose whole name says advert, share bar or reader comments are dropped.

Two shuffles into ranges of host, path and id with the same bounds, so that a host of any size is spread over many
tasks: one of keys and hashes, from which the pages beside each range's edges are known, and one of the pages
with those pages' line hashes beside them. The text therefore doesn't depend on the number of ranges. The driver holds
one bound and the hashes of ``2 * EDGE`` pages for each range, nothing that grows with the pages.

Defined cases: null or empty html gives an empty text. A null URL has no host, so no neighbours;
markup alone decides. Repeated rows are copies and don't delete each other's lines. Unclosed elements
end with their parents; unclosed comments and scripts run to the page's end. From a tag on that doesn't end because
its quotes aren't closed, quotes aren't minded; without another ``>`` the rest is text. An empty table gives an empty
result. Pages of any length are read whole. Columns other than page_id, url, html are not read.
"""

from __future__ import annotations

import bisect
import html
import pickle
import re
import zlib
from array import array
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions.shipping import map_in_arrow
from stemma.llm.common import materialize, table
from stemma.llm.url_filters import host_and_path

#: Pages to compare with on each side.
NEAR = 12
#: Pages beside a range that its own depend on: the neighbours of a page's neighbours; one more may be of the same run.
EDGE = 2 * NEAR + 1
#: Pages are copies if no more than this share of either's text is its own, and related if more than this share of either's main place is shared.
ALMOST = 0.1
#: Of a place's lines, the share that neighbours have too for it to be the template's, and how many that are at least.
SHARE, LEAST = 0.1, 2
#: Neighbours at least that share a paragraph or long line of the main place for it to be the template's.
MANY = 3
#: Longest line that differencing may delete inside a declared article.
SHORT = 200
#: Sampled keys per range of the order, for its bounds.
PER_RANGE = 100
#: Up to so many ranges the hashes of pages at their edges (400 bytes a range) are broadcast.
BROADCAST_RANGES = 50_000
_TAG = re.compile(r"<(!--|[!?]|/?[a-z][a-z0-9:-]*)", re.I)
_ATTRS = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = frozenset("script style noscript template textarea iframe svg title select object".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover "
    "mspace mstyle mpadded mtable mtr mtd semantics".split()
)
_DROP = frozenset("nav footer aside form head menu dialog button fieldset".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PROSE = _HEADS | {"p", "blockquote", "pre"}
_LISTS = frozenset("ul ol dl table".split())
_MAIN, _ARTICLE = 1, 2
_CORE = {"main": _MAIN, "article": _ARTICLE}
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Elements whose names may tell what they are.
_CONTAINERS = frozenset("div ul ol dl table center td span a".split())
_PARTS_INSIDE = _CONTAINERS | {"section"}
#: Last words of names of template parts outside a declared article.
_NAMES = frozenset(
    "ad ads advert adverts advertisement adsense banner banners sponsor sponsors sponsored promo promos promotion cookie cookies "
    "consent gdpr notice notices alert alerts popup popups modal overlay newsletter subscribe subscription sidebar sidebars menu menus nav "
    "navbar navigation breadcrumb breadcrumbs share sharing social related recommended recommendations comment comments commentlist "
    "replies respond disqus foot footer footers masthead header headers topbar pagination pager widget widgets toolbar login signup "
    "search copyright legal disclaimer".split()
)
#: Words that may follow them: an ad box is an ad, a notice board isn't a notice.
_PARTS = frozenset(
    "area bar block bottom box container content group holder inner item items left link links list outer panel right row section slot "
    "space top unit wrap wrapper".split()
)
#: Whole names of what isn't the article's inside an article.
_INSIDE = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo share sharing share-bar share-buttons social social-share comments "
    "comment-list commentlist replies respond disqus newsletter subscribe breadcrumb breadcrumbs pagination pager cookie-notice related-posts".split()
)

#: text, declared part around it (bits of _MAIN and _ARTICLE), dropped by markup, place in a list (-2 heading, -1 paragraph, else number
#: of the list around it or 0), places around it and its own, outermost first
Line = tuple[str, int, bool, int, tuple[int, ...]]


def _named(value: str, core: int) -> bool:
    """Whether a class or id names a part of the template."""
    for name in value.lower().split():
        if core:
            if name in _INSIDE:
                return True
            continue
        words = [w for w in re.split(r"[-_]+|\d+", name) if w]
        while words:
            if words[-1] in _NAMES or words[-2:] in (["side", "bar"], ["skip", "link"]):
                return True
            if words.pop() not in _PARTS:
                break
    return False


@cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(text, "", ""), (tag, "open" or "close", attributes) of a page; each character is read a bounded number of times."""
    at, quotes = 0, True
    for_text = 0
    while True:
        m = _TAG.search(page, at)
        if not m:
            break
        name = m[1].lower()
        if name == "!--":
            end = page.find("-->", m.end())
            end = len(page) if end < 0 else end + 3
        elif name in "!?":
            end = page.find(">", m.end()) + 1
        elif quotes and (a := _ATTRS.match(page, m.end())):
            end = a.end()
        else:
            quotes = False
            end = page.find(">", m.end()) + 1
        if not end:
            break
        if m.start() > for_text:
            yield page[for_text : m.start()], "", ""
        at = for_text = end
        if name[0] in "!?":
            continue
        if name[0] == "/":
            yield name[1:], "close", ""
            continue
        attrs = page[m.end() : end - 1]
        if name in _RAW:
            if name == "svg" and attrs.endswith("/"):
                continue
            closed = _end_of(name).search(page, end)
            at = for_text = closed.end() if closed else len(page)
            continue
        yield name, "open", attrs
    if for_text < len(page):
        yield page[for_text:], "", ""


def lines(page: str | None) -> list[Line]:
    """A page's blocks, in order."""
    out: list[Line] = []
    stack: list[tuple[str, int, bool, int, tuple[int, ...]]] = []  # name, core, dropped, list, places
    held: list[str] = []
    lists = 0
    core, dropped = 0, False

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            block = next((x for x in reversed(stack) if x[0] not in _INLINE), ("", 0, False, 0, (0,)))
            out.append((text, core, dropped, -2 if block[0] in _HEADS else -1 if block[0] in _PROSE else block[3], block[4]))

    for tag, kind, attrs in _tokens(page or ""):
        if not kind:
            held.append(html.unescape(tag))
            continue
        if tag not in _INLINE:
            flush()
        if kind == "close":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if (core, dropped) != (stack[k - 1][1:3] if k else (0, False)):
                        flush()
                    del stack[k:]
                    break
                if tag in _INLINE and stack[k][0] not in _INLINE:
                    break
            core, dropped = stack[-1][1:3] if stack else (0, False)
            continue
        if tag in _VOID or attrs.endswith("/") and tag in _INLINE:
            continue
        if tag in ("p", "li", "option", "dt", "dd", "tr", "td", "th") and stack:
            _close(stack, tag)
            core, dropped = stack[-1][1:3] if stack else (0, False)
        now_core, now_dropped = core | _CORE.get(tag, 0), dropped or tag in _DROP or tag == "header" and not core
        classes = ""
        for name, *values in _ATTR.findall(attrs):
            value, name = "".join(values), name.lower()
            if name == "role":
                now_dropped = now_dropped or value.lower() in _ROLES
                now_core |= _MAIN if value.lower() == "main" else 0
            else:
                classes = value if name == "class" else classes
                now_dropped = now_dropped or tag in (_PARTS_INSIDE if now_core else _CONTAINERS) and _named(value, now_core)
        if (now_core, now_dropped) != (core, dropped):
            flush()
        around, places = stack[-1][3:] if stack else (0, (0,))
        if tag in _LISTS and not around:
            lists += 1
            around = lists
        if tag not in _INLINE and tag not in _PROSE and tag not in ("html", "body"):
            places = (*places, zlib.crc32(f"{tag} {classes}".encode("utf-8", "surrogatepass"), places[-1]))
        stack.append((tag, now_core, now_dropped, around, places))
        core, dropped = now_core, now_dropped
    flush()
    return out


def _close(stack: list[tuple], tag: str) -> None:
    """A new paragraph, list item or cell ends an open one, unless a container lies between."""
    for k in range(len(stack) - 1, -1, -1):
        name = stack[k][0]
        if name == tag:
            del stack[k:]
            return
        if name not in _INLINE and name not in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            return


def kept(own: list[Line]) -> list[int]:
    """Lines that markup keeps: not dropped, and in the declared part if there is one.

    Of a main part with articles in it, all; but where the articles hold most of its text, only paragraphs and headings beside them.
    """
    left = [k for k, x in enumerate(own) if not x[2]]
    for part in (_MAIN, _ARTICLE):
        inside = [k for k in left if own[k][1] & part]
        if inside:
            if part == _MAIN:
                size = lambda ks: sum(len(own[k][0]) for k in ks)
                articles = [k for k in inside if own[k][1] & _ARTICLE]
                if 2 * size(articles) >= size(inside):
                    inside = [k for k in inside if own[k][1] & _ARTICLE or own[k][3] < 0]
            return inside
    return left


def _lengths(a: list, b: list) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with the starts of ``b``, bit-parallel."""
    at: dict = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & at.get(x, 0)
        v = (v + u | v - u) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list, b: list) -> tuple[list[int], list[int]]:
    """Indexes of a longest common subsequence of two lists of lines, in both.

    Equal ends are matched and lines of one list alone left out. Where few pairs of equal lines are left, the longest rising run of
    their places is kept; otherwise the first list is halved where the lengths of both halves' subsequences, found bit-parallel, sum to
    most. So lines that repeat cost no more than the product of the lengths over the word size, and memory stays linear.
    """
    ours: list[int] = []
    theirs: list[int] = []
    todo = [(list(range(len(a))), list(range(len(b))))]
    while todo:
        i, j = todo.pop()
        start = 0
        while start < min(len(i), len(j)) and a[i[start]] == b[j[start]]:
            start += 1
        stop = 0
        while stop < min(len(i), len(j)) - start and a[i[-1 - stop]] == b[j[-1 - stop]]:
            stop += 1
        ours += i[:start] + i[len(i) - stop :]
        theirs += j[:start] + j[len(j) - stop :]
        i, j = i[start : len(i) - stop], j[start : len(j) - stop]
        both = {a[x] for x in i} & {b[x] for x in j}
        if not both:
            continue
        i, j = [x for x in i if a[x] in both], [x for x in j if b[x] in both]
        n, m = Counter(a[x] for x in i), Counter(b[x] for x in j)
        if len(i) == 1 or sum(n[x] * m[x] for x in both) <= 4 * (len(i) + len(j)):
            for x, y in _rising([a[x] for x in i], [b[x] for x in j]):
                ours.append(i[x])
                theirs.append(j[y])
            continue
        half = len(i) // 2
        x, y = [a[k] for k in i], [b[k] for k in j]
        cut = int((_lengths(x[:half], y) + _lengths(x[:half - 1 : -1], y[::-1])[::-1]).argmax())
        todo += [(i[:half], j[:cut]), (i[half:], j[cut:])]
    return sorted(ours), sorted(theirs)


def _rising(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence, by the longest rising run of the places of equal lines."""
    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    tails: list[int] = []  # least last place in b of a common subsequence of each length
    ends: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect.bisect_left(tails, j)
            node = (i, j, ends[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                ends.append(node)
            else:
                tails[k], ends[k] = j, node
    out = []
    node = ends[-1] if ends else None
    while node:
        out.append(node[:2])
        node = node[2]
    return out[::-1]


_INNER, _LONG, _KEPT = 1, 2, 4


def inner(places: tuple[int, ...], main: int) -> bool:
    """Whether a line is in the main place's element; the page itself is no such element."""
    return places[-1] == main or main != 0 and main in places


class Page:
    """What comparing needs of a page: hashes, lengths, places and kinds of its lines."""

    __slots__ = ("alike", "hashes", "kinds", "lengths", "long", "main", "places", "size")

    def __init__(self, own: list[Line]):
        left = frozenset(kept(own))
        weight: dict[tuple, int] = {}
        for x in own:
            if not x[2]:
                weight[x[4]] = weight.get(x[4], 0) + len(x[0])
        main = max(weight, key=lambda w: (weight[w], w), default=(0,))
        self.main = main[-1]
        self.hashes = array("Q", [xxhash.xxh3_64_intdigest(x[0].encode("utf-8", "surrogatepass")) for x in own])
        self.lengths = array("Q", [len(x[0]) for x in own])
        self.places = array("I", [x[4][-1] for x in own])
        self.kinds = bytes(
            _INNER * inner(x[4], self.main) | _LONG * (x[4] == main and (x[3] < 0 or len(x[0]) > SHORT)) | _KEPT * (k in left) for k, x in enumerate(own)
        )
        self._sums()

    def _sums(self) -> None:
        self.alike = frozenset(self.hashes)
        self.size = sum(n for n, k in zip(self.lengths, self.kinds, strict=True) if k & _KEPT)
        self.long = sum(n for n, k in zip(self.lengths, self.kinds, strict=True) if k & _LONG)

    def __getstate__(self):
        return self.hashes, self.lengths, self.places, self.kinds, self.main

    def __setstate__(self, state):
        self.hashes, self.lengths, self.places, self.kinds, self.main = state
        self._sums()

    def left(self, aligned: list[int]) -> bool:
        """Whether text of its own is left when the aligned lines are taken away."""
        gone = sum(self.lengths[k] for k in aligned if self.kinds[k] & _KEPT)
        return self.size - gone > ALMOST * self.size

    def related(self, aligned: list[int]) -> bool:
        return sum(self.lengths[k] for k in aligned if self.kinds[k] & _LONG) > ALMOST * self.long


class Seen:
    """A page with what its neighbours tell of its lines."""

    __slots__ = ("counted", "differ", "digest", "flagged", "own", "page", "rows", "shared")

    def __init__(self, digest, page: Page, own: list[Line] | None = None):
        self.digest, self.page, self.own, self.rows, self.counted = digest, page, own, [], None
        self.differ = 0  # neighbours that aren't copies
        self.shared: dict[int, int] = {}  # how many of them share a line
        self.flagged: set[int] = set()  # lines that unrelated neighbours share

    def meet(self, other: Seen) -> None:
        x, y = self.page, other.page
        if x.alike.isdisjoint(y.alike):
            self.differ += 1
            other.differ += 1
            return
        if x.hashes == y.hashes:
            return
        ours, theirs = common(x.hashes, y.hashes)
        if not (x.left(ours) and y.left(theirs)):
            return
        related = x.related(ours) or y.related(theirs)
        for seen, aligned in ((self, ours), (other, theirs)):
            seen.differ += 1
            kinds = seen.page.kinds
            for k in aligned:
                if not (related and kinds[k] & _LONG):
                    seen.shared[k] = seen.shared.get(k, 0) + 1
            if not related:
                seen.flagged.update(aligned)

    def places(self) -> tuple[Counter, Counter]:
        """Lines by place, and those that unrelated neighbours share, outside the main place's element; all neighbours must be met."""
        if not self.counted:
            outer = [k for k, kind in enumerate(self.page.kinds) if not kind & _INNER]
            p = self.page.places
            self.counted = Counter(p[k] for k in outer), Counter(p[k] for k in outer if k in self.flagged)
        return self.counted

    def text(self, around: Iterable[Seen]) -> str:
        """Blocks that neither differencing nor markup takes away, one a line; ``around``: the page itself and its neighbours."""
        every, shared, mains = Counter(), Counter(), Counter()
        for x in around:
            mains[x.page.main] += 1
            n, s = x.places()
            every.update(n)
            shared.update(s)
        template = {p for p, s in shared.items() if s >= LEAST and s >= SHARE * every[p]}
        own, page = self.own, self.page
        most = {k for k, n in self.shared.items() if 2 * n > self.differ}
        # articles may share a paragraph, and edited copies their heading
        most = {k for k in most if not page.kinds[k] & _LONG or own[k][3] != -2 and self.shared[k] >= MANY}
        # a short article's main place is that of most pages around it
        usual = max(mains, key=lambda m: (mains[m], m))
        main = usual if usual in page.places else page.main
        by_place = {k for k, x in enumerate(own) if x[4][-1] in template and not inner(x[4], main)}
        gone = most | {k for k in by_place if not own[k][1]}
        split = {x[3] for k, x in enumerate(own) if k not in gone}  # lists with lines of the page's own
        stays = {
            k
            for k in gone
            if own[k][1] and (own[k][3] < 0 or len(own[k][0]) > SHORT)
            or (own[k][1] or inner(own[k][4], main)) and own[k][3] > 0 and own[k][3] in split
        }
        gone -= stays
        return "\n".join(own[k][0] for k in kept(own) if k not in gone)


def main_text(own: list[Line], *near: list[Line]) -> str:
    """Main text of a page by itself, or with neighbours, nearest first or in any order."""
    seen = [Seen(n, Page(x), x) for n, x in enumerate((own, *near))]
    for k, x in enumerate(seen):
        for y in seen[:k]:
            x.meet(y)
    return seen[0].text(seen)


def texts(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(page_id, url, text) of a range's rows in order.

    A row: host, digest of the html, a function that gives the page's lines and :class:`Page`, and page_id and url, or None for a page
    of another range.
    """
    window: deque[Seen] = deque()
    first = done = 0  # numbers of the window's first page and of the next to be told
    host = None

    def tell(n: int) -> Iterator[tuple]:
        x = window[n - first]
        if x.rows:
            low = max(0, n - first - NEAR)
            text = x.text(window[k] for k in range(low, min(len(window), n - first + NEAR + 1)))
            yield from ((*row, text) for row in x.rows)

    def end() -> Iterator[tuple]:
        nonlocal first, done
        while done < first + len(window):
            yield from tell(done)
            done += 1
        window.clear()
        first = done = 0

    for at, digest, parse, row in rows:
        if at != host or not at:
            yield from end()
            host = at
        if not window or window[-1].digest != digest:
            own, page = parse()
            new = Seen(digest, page, own)
            for k in range(max(0, len(window) - NEAR), len(window)):
                new.meet(window[k])
            window.append(new)
        elif row and window[-1].own is None:
            window[-1].own = parse()[0]
        if row:
            window[-1].rows.append(row)
        if first + len(window) - done > 2 * NEAR:
            yield from tell(done)
            window[done - first].rows.clear()
            done += 1
        while first < done - NEAR:
            window.popleft()
            first += 1
    yield from end()


def _ranged(pages: DataFrame) -> tuple[DataFrame, int]:
    """page_id, url, html, host, path, digest and number of the range of the order; number of ranges. Bounds are of a sample of the keys."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    keyed = pages.select("page_id", "url", "html", host.alias("host"), path.alias("path"), F.xxhash64("html").alias("digest"))
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = n * PER_RANGE / max(1, pages.count())
    keys = keyed.select("host", "path", F.col("page_id").cast("long"))
    got = {tuple(r) for r in (keys.sample(min(1.0, share), seed=1) if share < 1 else keys).collect()}
    got = sorted(got, key=lambda k: (k[0], k[1], k[2] is not None, k[2] or 0))
    bounds = [got[b] for b in sorted({len(got) * i // n for i in range(1, n)} - {0})]
    at = F.lit(0)
    if bounds:
        key = lambda h, p, i: F.struct(h.alias("h"), p.alias("p"), i.cast("long").alias("i"))
        own = key(F.col("host"), F.col("path"), F.col("page_id"))
        of = lambda some: F.array(*[key(*map(F.lit, b)) for b in some])
        step = max(1, round(len(bounds) ** 0.5))  # every step-th bound, then those between two of them
        most = F.size(F.filter(of(bounds[step - 1 :: step]), lambda b: b <= own)) if len(bounds) >= step else F.lit(0)
        keyed = keyed.withColumn("coarse", most * step)
        at = F.col("coarse") + F.size(F.filter(F.slice(of(bounds), F.col("coarse") + 1, F.lit(step)), lambda b: b <= own))
    return keyed.withColumn("range", at.cast("int")).drop("coarse"), len(bounds) + 1


def _dealt(rows: DataFrame, n: int, *order: str) -> DataFrame:
    return rows.repartitionById(n, F.col("range")).sortWithinPartitions("range", *order)


_ORDER = ("host", "path", "page_id", "url", "digest")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for part in range(0, b.num_rows, 500):
            yield from b.slice(part, 500).to_pylist()


#: One row a range: its first and last host, whether they are one, digests of its first EDGE runs of the first host and its last EDGE of the last
_EDGES = "range int, first string, last string, starts array<long>, ends array<long>, n_first long"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, first, last, starts, ends, n_first = None, None, None, [], deque(maxlen=EDGE), 0

    def row() -> pa.RecordBatch:
        kinds = (pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
        cols = zip((at, first, last, starts, list(ends), n_first), kinds, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in cols], names=["range", "first", "last", "starts", "ends", "n_first"])

    for r in _rows(batches):
        if r["range"] != at:
            if at is not None:
                yield row()
            at, first, last, starts, ends, n_first = r["range"], r["host"], None, [], deque(maxlen=EDGE), 0
        if r["host"] != last:
            ends.clear()
            last = r["host"]
        if not ends or ends[-1] != r["digest"]:
            ends.append(r["digest"])
            if r["host"] == first:
                n_first += 1
                if len(starts) < EDGE:
                    starts.append(r["digest"])
    if at is not None:
        yield row()


def around(found: dict[int, tuple]) -> list[tuple[int, int, int, str, int]]:
    """(range, 0 before or 2 after, place, host, digest) of the runs beside each range that its pages depend on.

    ``found``: range -> (first host, last host, digests of the first runs, of the last runs, number of runs of the first host).
    """
    out = []
    for side, numbers in ((0, sorted(found)), (2, sorted(found, reverse=True))):
        host, carry = None, []  # runs that lie before (or, backwards, after) the next range, nearest last
        for n in numbers:
            first, last, starts, ends, n_first = found[n]
            near, far = (first, last) if side == 0 else (last, first)
            if host == near and host:
                out += [(n, side, k if side == 0 else -k, host, d) for k, d in enumerate(carry)]
            new = list(ends) if side == 0 else list(starts)[::-1]
            if first == last and host == near and n_first <= EDGE:
                joint = bool(carry and new) and carry[-1] == (new[0])
                carry = (carry + new[joint:])[-EDGE:]
            else:
                carry = new
            host = far
    return out


def apply(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    ranged, n = _ranged(pages)
    beside = spark.createDataFrame([], "range int, part int, place int, host string, digest long, page binary")
    if n > 1:
        keys = ranged.select("range", *_ORDER)
        ends = _dealt(keys, n, *_ORDER).select("range", "host", "digest").transform(map_in_arrow, _edges, _EDGES)
        found = {r[0]: tuple(r)[1:] for r in ends.collect()}  # 2 * EDGE hashes a range
        refs = spark.createDataFrame(around(found), "range int, part int, place int, host string, digest long")

        def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                seen = [pickle.dumps(Page(lines(x.as_py()))) for x in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(seen, pa.binary())], names=["digest", "page"])

        wanted = refs.select(F.col("digest").alias("wanted")).distinct()
        wanted = F.broadcast(wanted) if n <= BROADCAST_RANGES else wanted
        # one page of each digest, picked before any is parsed
        some = ranged.select("digest", "html").join(wanted, F.col("digest") == F.col("wanted"), "left_semi").groupBy("digest").agg(F.first("html").alias("html"))
        marked = some.transform(map_in_arrow, marks, "digest long, page binary").withColumnRenamed("digest", "of")
        beside = refs.join(marked, F.col("digest") == F.col("of")).select("range", "part", "place", "host", "digest", "page")
    own = ranged.withColumns({"part": F.lit(1), "place": F.lit(0), "page": F.lit(None).cast("binary")})
    every = own.unionByName(beside, allowMissingColumns=True).select("range", "part", "place", *_ORDER, "html", "page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parser(r: dict):
            def parse():
                if r["page"] is not None:
                    return None, pickle.loads(r["page"])
                own = lines(r["html"])
                return own, Page(own)

            return parse

        def rows() -> Iterator[tuple]:
            at = None
            for r in _rows(batches):
                if at is not None and r["range"] != at:
                    yield None, None, lambda: ([], Page([])), None
                at = r["range"]
                yield r["host"], r["digest"], parser(r), (r["page_id"], r["url"]) if r["part"] == 1 else None

        held: list[tuple] = []
        for page_id, url, text in texts(rows()):
            held.append((page_id, url, text, len(text)))
            if len(held) == 500:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    dealt = _dealt(every, n, "part", "place", *_ORDER).select("page_id", "url", "html", "host", "range", "part", "digest", "page")
    return dealt.transform(map_in_arrow, run, "page_id long, url string, text string, n_chars long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
    cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest: main text of every page."""
    return apply(table(spark, sf_dir, "pages"))
