"""Main-text extraction with a site style tree.

Pages of one host are merged into a style tree: an element node is a place in the tree (its
ancestors, their child sequences, its tag and class), a style node is one child sequence seen there.
An element whose pages agree on its style has low presentation importance (entropy of the styles);
a leaf whose content recurs on most of its pages has low content importance (entropy of that content
over the pages). A branch's importance combines both from the leaves up, and branches under the
threshold go.

Elements that declare themselves navigation, asides, footers, forms, scripts, adverts, notices,
comments and the like have importance zero and are not descended into. Inside an article only tags,
roles and whole class names of comments, adverts and notices declare that, and never an id, which may
be the slug of a heading; outside of it words of class and id do, but for ids of headings and sections.
Entropy decides on the rest.

A declared article (article, main) has a high prior only: it is the main text if the important text
in it, weighed ``PRIOR`` times, is at least the important text outside of it; else the whole page is
taken. The number of its paragraphs differs from page to page, so inside it a place is told by the
path of tags and classes alone, and what goes are leaves of low content importance: a list or table
only as a whole, a heading only with what follows it, a title (h1) never. A page of whose article more than half would go
is a near copy of others, and keeps it.

Defined cases: null html is the empty text; unclosed and stray tags are tolerated; a null url counts
as a host of its own; repeated rows are extracted each; pages of a host whose declared text is equal
count in the tree once; a place seen on fewer than ``MIN_PAGES`` pages is important; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HEAVY, class_counts, join_classes, slices, stored, whole_groups
from .url_filter import url_host

THRESHOLD, DECAY, MIN_PAGES = 0.3, 0.9, 5
#: What a character of a declared article weighs against one outside of it.
PRIOR = 4

# What HTML itself fixes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle mpadded mphantom menclose merror mspace mmultiscripts semantics mtable mtr mtd".split())
#: An opening tag closes these open ones when they are the innermost block.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
# Elements that declare themselves: tags, roles, and words of class and id.
NOISE_TAGS = frozenset("head nav footer aside form script style noscript template iframe svg annotation annotation-xml button select textarea dialog menu object embed canvas audio video fieldset input title".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert alerts announcement popup modal overlay newsletter subscribe subscription share sharing social related recommended comment comments commentlist discussion replies disqus widget toolbar pagination pager skip login signin signup search topbar".split()
)
#: Whole class names that are declared noise inside an article too.
ARTICLE_NOISE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments comment-list commentlist comments-area comments-section disqus notice notices cookie-notice consent gdpr".split())
#: Declared noise outside of the article only: inside, a header holds the title.
HEADER_WORDS = frozenset("header masthead".split())
#: Inside an article, what repeats in these goes only with all of the element.
UNITS, HEADINGS = frozenset("ul ol dl table figure".split()), frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE_TAGS, ARTICLE_ROLES = frozenset(("article", "main")), frozenset(("article", "main"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:_-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?][^>]*>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-A-Za-z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>=`]+)))?")
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    key: str = ""
    fixed: int | None = None  # declared importance: 0 noise, 1 article
    children: list = field(default_factory=list)  # Node, or str for text


#: Declared noise that stands within a line and doesn't part a block.
_IN_LINE_NOISE = frozenset("annotation annotation-xml button select audio video canvas object embed input".split())


def _declared(tag: str, attributes: str, inside: bool) -> tuple[str, int | None]:
    """(class and id, fixed importance) of an element, ``inside`` an article or not."""
    header = tag == "header" and not inside
    if not attributes.strip():
        return "", 1 if tag in ARTICLE_TAGS else 0 if tag in NOISE_TAGS or header else None
    at = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    key = f"{at.get('class', '')}#{at.get('id', '')}"
    classes, role = at.get("class", "").lower(), at.get("role", "").lower()
    if inside:
        noise = not ARTICLE_NOISE.isdisjoint(classes.split())
    else:
        words = set(re.split(r"[^a-z0-9]+", classes if tag in HEADINGS or tag == "section" else key.lower()))
        noise = bool(words & NOISE_WORDS or words & HEADER_WORDS)
    hidden = not inside and ("hidden" in at or at.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", at.get("style", ""), re.I))
    if tag not in ("html", "body") and (hidden or header or tag in NOISE_TAGS or role in NOISE_ROLES or noise):
        return key, 0
    return key, 1 if tag in ARTICLE_TAGS or role in ARTICLE_ROLES or at.get("itemprop") == "articleBody" else None


def parse(page: str) -> Node:
    """The tree of blocks of a page: inline tags dissolve, what is declared noise keeps no text. Linear in the page."""
    root = Node("html")
    open_: list[Node] = [root]
    tags: Counter[str] = Counter()  # of the open nodes
    articles = 0  # open ones
    block: list[str] = []  # text at the end of the innermost open node
    at, n = 0, len(page)
    muted: list[str] = []  # open tags below a noise element that must end before it does
    muted_tags: Counter[str] = Counter()

    def text(s: str) -> None:
        if s and not muted:
            block.append(s)

    def end_block() -> None:
        if block:
            open_[-1].children.append("".join(block))
            block.clear()

    def close() -> str:
        nonlocal articles
        end_block()
        node = open_.pop()
        tags[node.tag] -= 1
        articles -= node.fixed == 1
        return node.tag

    def mute(tag: str) -> None:
        muted.append(tag)
        muted_tags[tag] += 1

    def unmute() -> str:
        muted_tags[muted[-1]] -= 1
        return muted.pop()

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            text(entities.unescape(page[at:]))
            break
        text(entities.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:  # a closing tag
            if muted:
                if muted_tags[tag]:
                    while unmute() != tag:
                        pass
            elif tag not in INLINE and tags[tag]:
                while close() != tag:
                    pass
            continue
        if tag in RAW and tag not in VOID:
            end = _raw_end(tag).search(page, at)
            at = end.end() if end else n
            continue
        if muted:
            if tag not in VOID:
                if tag in CLOSES and muted[-1] in CLOSES[tag] and len(muted) > 1:
                    unmute()
                mute(tag)
            continue
        key, fixed = _declared(tag, m[3], articles > 0)
        if tag == "br" or tag in VOID:
            text(" " if tag in INLINE else "")
            if tag == "hr":
                end_block()
                open_[-1].children.append(Node("hr"))
            continue
        if tag in INLINE and fixed is None:
            continue
        if fixed == 0 and tag in INLINE | _IN_LINE_NOISE:
            mute(tag)
            continue
        while len(open_) > 1 and open_[-1].tag in CLOSES.get(tag, {"p"}):
            close()
        end_block()
        node = Node(tag, key, fixed)
        open_[-1].children.append(node)
        if fixed == 0:
            mute(tag)
        else:
            open_.append(node)
            tags[tag] += 1
            articles += fixed == 1
    end_block()
    return root


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


def _clean(s: str) -> str:
    return _SPACE.sub(" ", s).strip()


def walk(root: Node) -> Iterator[tuple[int, int, Node | str, bool]]:
    """(number, parent's number, node or text, inside the article) in page order; noise isn't descended into."""
    stack, number = [(root, -1, False)], 0
    while stack:
        x, parent, inside = stack.pop()
        if isinstance(x, Node):
            inside = inside or x.fixed == 1
            if x.fixed != 0:
                stack += [(c, number, inside) for c in reversed(x.children)]
        yield number, parent, x, inside
        number += 1


def main_text(root: Node, dropped: frozenset[int] = frozenset()) -> str:
    """Blocks of the article, or of the whole page where none holds its text, without the ``dropped`` branches."""
    low: set[int] = set()
    tags: dict[int, str] = {}  # of the nodes inside the article
    units: dict[int, int] = {}  # outermost list or table
    outer: list[tuple[int, str]] = []
    leaves: list[tuple[int, str, int, str]] = []
    for number, parent, x, inside in walk(root):
        if inside:
            if isinstance(x, Node):
                tags[number] = x.tag
                if parent in units or x.tag in UNITS:
                    units[number] = units.get(parent, number)
            elif block := _clean(x):
                leaves.append((number, block, units.get(parent, number), tags.get(parent, "")))
        elif number in dropped or parent in low:
            low.add(number)
        elif isinstance(x, str) and (block := _clean(x)):
            outer.append((number, block))
    whole = {unit for number, _, unit, _ in leaves if number not in dropped}
    inner: list[tuple[int, str]] = []
    stays = False  # whether the block after this one does
    for number, block, unit, tag in reversed(leaves):
        stays = unit in whole or tag == "h1" or (tag in HEADINGS and stays)
        if stays:
            inner.append((number, block))
    total, kept, other = (sum(len(block) for _, block, *_ in x) for x in (leaves, inner, outer))
    if 2 * kept < total and total * PRIOR >= other:
        inner = [leaf[:2] for leaf in leaves]
        kept = total
    return "\n".join(block for _, block in (sorted(inner) if leaves and kept * PRIOR >= other else sorted(inner + outer)))


def extract(page: str) -> str:
    """The main text as far as a page alone declares it."""
    return main_text(parse(page))


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts))) >> 1


#: Kinds of style rows; the last counts a page's rows.
ELEMENT, LEAF, FIXED, ARTICLE, TIMES = 0, 1, 2, 3, 4


def style_rows(root: Node, host: str) -> Iterator[tuple[int, int, int, int, int]]:
    """(number, parent, place in the host's style tree, kind, value) of every node outside declared noise.

    The value of an element is its style, of a leaf its content, of declared noise its importance. The
    leaves of an article are its children, their places the paths of tags and classes.
    """
    place, style, seen = {-1: _hash(host)}, {-1: 0}, {-1: 0}
    within: dict[int, tuple[int, int]] = {}  # nodes of an article: its number, the place
    for number, parent, x, inside in walk(root):
        if parent in within:
            article, path = within[parent]
            if not isinstance(x, str):
                within[number] = article, _hash(path, x.tag, x.key)
            elif block := _clean(x):
                yield number, article, _hash(path, "#text"), LEAF, _hash(block)
            continue
        if inside:
            within[number] = number, _hash(host, x.tag, "#article")
            yield number, parent, within[number][1], ARTICLE, 0
            continue
        at = seen[parent] = seen[parent] + 1
        if isinstance(x, str):
            if block := _clean(x):
                yield number, parent, _hash(place[parent], style[parent], at, "#text"), LEAF, _hash(block)
            continue
        own = _hash(place[parent], style[parent], at, x.tag, x.key)
        if x.fixed is not None:
            yield number, parent, own, FIXED, x.fixed
            continue
        place[number], seen[number] = own, 0
        style[number] = _hash(*("#text" if isinstance(c, str) else f"{c.tag} {c.key}" for c in x.children))
        yield number, parent, own, ELEMENT, style[number]


_ROWS = "page long, body long, number int, parent int, place long, kind int, value long"
#: Rows of whole pages whose branches are weighed at once.
WEIGHED_ROWS = 200_000


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The style rows of each page, once a task, and how often the task met it."""
    times: Counter[int] = Counter()
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page", "body", "number", "parent", "place", "kind", "value"])

    for batch in slices(batches):
        rows = []
        for page, host, text in zip(batch.column("page").to_pylist(), batch.column("host").to_pylist(), batch.column("html"), strict=True):
            times[page] += 1
            if times[page] == 1:
                root = parse(text.as_py())
                body = _hash(main_text(root))
                rows += [(page, body, *row) for row in style_rows(root, host)]
        yield batch_of(rows)
    yield batch_of([(page, 0, -1, -1, 0, TIMES, n) for page, n in times.items()])


def _parents(page, number, parent) -> np.ndarray:
    """Where each row's parent is, -1 for none; arrays hold whole pages, by page and number."""
    wide = int(number.max(initial=0)) + 2
    rank = np.unique(page, return_inverse=True)[1] * wide
    up = np.searchsorted(rank + number, rank + parent)
    return np.where(parent < 0, -1, np.minimum(up, len(page) - 1))


def branch_importance(page, number, parent, kind, value, pages, same, styles, entropy) -> np.ndarray:
    """Importance of each row's branch; arrays hold whole pages, by page and number.

    An article's own importance is one. pages: on how many pages the place is; same: on how many with this value; styles: how many values
    it has; entropy: sum of n ln n over their counts n.
    """
    log = np.log(np.maximum(pages, 2))
    own = np.where(kind == ELEMENT, (log - entropy / np.maximum(pages, 1)) / log, 1 - np.log(np.maximum(same, 1)) / log)
    own = np.where(kind == FIXED, value, np.where((pages < MIN_PAGES) | (kind == ARTICLE), 1.0, own))
    up = _parents(page, number, parent)
    # depths by pointer jumping, so that a page of any depth takes few steps
    above, depth = np.where(up < 0, np.arange(len(page)), up), (up >= 0).astype(np.int64)
    while (above[above] != above).any():
        depth += depth[above]
        above = above[above]
    total, children = np.zeros(len(page)), np.zeros(len(page))
    decay = DECAY ** np.maximum(styles, 1)
    by_depth = np.argsort(depth, kind="stable")
    edge = np.searchsorted(depth[by_depth], np.arange(int(depth.max(initial=0)) + 2))
    for level in range(len(edge) - 2, -1, -1):
        at = by_depth[edge[level] : edge[level + 1]]
        inner = at[np.isin(kind[at], (ELEMENT, ARTICLE)) & (children[at] > 0)]
        own[inner] = (1 - decay[inner]) * own[inner] + decay[inner] * total[inner] / children[inner]
        if level:
            np.add.at(total, up[at], own[at])
            np.add.at(children, up[at], 1)
    return own


def _low_branches(threshold: float):
    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "page", WEIGHED_ROWS):
            c = {n: table.column(n).to_numpy() for n in table.column_names}
            order = np.lexsort((c["number"], c["page"]))
            first = np.concatenate([[True], (np.diff(c["page"][order]) != 0) | (np.diff(c["number"][order]) != 0)])  # repeated pages meet
            c = {n: v[order[first]] for n, v in c.items()}
            value = branch_importance(*(c[n] for n in ("page", "number", "parent", "kind", "value", "pages", "same", "styles", "entropy")))
            gone = (value < threshold) & np.isin(c["kind"], (ELEMENT, LEAF)) & (c["parent"] >= 0)
            # An article stays in a low branch. Only leaves are listed, so that a page that loses no text isn't.
            up = _parents(c["page"], c["number"], c["parent"])
            above = np.where(np.isin(c["kind"], (ELEMENT, LEAF)) & (up >= 0), up, np.arange(len(up)))
            while True:
                gone |= gone[above]
                if (above[above] == above).all():
                    break
                above = above[above]
            gone &= c["kind"] == LEAF
            yield pa.RecordBatch.from_arrays([pa.array(c["page"][gone]), pa.array(c["number"][gone])], names=["page", "number"])

    return low


def low_branches(pages: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, tuple[int, int]]:
    """((page, n, numbers), (rows, most rows of a page)) of (page, host, html).

    ``numbers``: the leaves in branches that the host's style tree finds unimportant. Listed are the
    pages that have some, and those that very many rows repeat, ``n`` of them.
    """
    rows = stored(pages.mapInArrow(_merge_rows, _ROWS), "style-tree-rows")  # parsed once for all that follows
    seen, nodes = rows.where(F.col("kind").isin(ELEMENT, LEAF)), rows.where(F.col("kind") != TIMES)
    merged = stored(seen.groupBy("place", "kind", "value").agg(F.count_distinct("body").alias("same"), F.count("*").alias("n")), "style-tree")
    # Inside an article a place holds many leaves of a page.
    wide = seen.groupBy("place").agg(F.count_distinct("body").alias("pages"))
    places = merged.groupBy("place").agg(F.count("*").alias("styles"), F.sum(F.col("same") * F.log("same")).alias("entropy")).join(wide, "place")
    # A content that one page alone has is important at any place.
    shared = stored(merged.where((F.col("same") > 1) | (F.col("kind") == ELEMENT)).drop("kind").join(places, "place"), "style-tree-shared")
    known = join_classes(nodes, shared, ["place", "value"], "left")
    numbers = [F.coalesce(F.col(c), F.lit(1)).cast(t).alias(c) for c, t in (("pages", "long"), ("same", "long"), ("styles", "long"), ("entropy", "double"))]
    known = known.select("page", "number", "parent", "kind", "value", *numbers).repartition("page").sortWithinPartitions("page")
    gone = known.mapInArrow(_low_branches(threshold), "page long, number int").groupBy("page").agg(F.collect_set("number").alias("numbers"))
    times = rows.where(F.col("kind") == TIMES).groupBy("page").agg(F.sum("value").alias("n"))
    counts = class_counts(times)
    listed = F.col("numbers").isNotNull() | (F.col("n") * HEAVY > (counts[0] or 0))
    return stored(times.join(gone, "page", "left").where(listed), "style-tree-branches"), counts


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [main_text(parse(x.as_py()), frozenset(gone or ())) for x, gone in zip(batch.column("html"), batch.column("numbers").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", host: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    host = url_host(F.col(url)) if host is None else host
    rows = pages.select(F.xxhash64(key, url, html).alias("page"), F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    # Few pages are listed where they declare their parts; Spark broadcasts these only if their stored size is small.
    gone, counts = low_branches(rows.select("page", "host", "html"), threshold)
    return join_classes(rows, gone, "page", "left", sparse="numbers", counts=counts).select("page_id", "url", "html", "numbers").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
