"""Main text of web pages by tree scoring.

The scheme is the published one of readability scoring. A page becomes a tree of blocks. Every paragraph earns points
for its length and its commas and passes them on: all to its parent, half to the grandparent, less further up. A
container's points are discounted by the share of its text that stands in links and moved by what its tag, class and id
say. The best container is kept with those of its siblings that score well or read like prose, and with every other
container that scores at least half as well, so that an article in several pieces stays whole; menus, page headers and
footers, sidebars, notices, adverts, forms, comments, scripts and styles inside are left out.

Decisions: a ``header`` inside ``article`` or ``main`` belongs to the text, any other does not; a class or id makes an
element boilerplate when one of its names holds a boilerplate word (``sidebar-content``), unless a name of content
without such a word stands before it (``post share-enabled``) or the name says what its owner has (``has-sidebar``); a
form that holds more than half of the page's text wraps the page and is no form; elements that are not known as blocks
are inline (pictures, unknown tags); ``<br>`` is white space inside its block.

Defined results: null, empty or text-free html gives the empty text; markup that ends early is closed at the end, a
stray ``<`` is text, unknown end tags are ignored; pages without any paragraph keep all text that is not boilerplate;
repeated rows are extracted each; an empty table gives no rows. Work is linear in the page, nothing is cut. Only
page_id, url and html are read.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, text_slices

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden|aria-label)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("#root address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
#: An open element of the second set ends when one of the first set begins.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
DROPPED = frozenset("head script style noscript template iframe object embed svg math canvas audio video map nav footer aside button select textarea input menu dialog title".split())
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner\w*|breadcrumb\w*|captcha|comment\w*|cookie\w*|consent|disqus|discussion|dropdown|foot|footer\w*|form|gdpr|masthead|menu\w*|modal\w*|nav|navbar|navigation|newsletter\w*|notice\w*|notification\w*|outbrain|overlay|pager|pagination|paywall|popup\w*|promo\w*|recommend\w*|related\w*|replies|reply|respond|share\w*|sharing|shoutbox|sidebar\w*|signup|skip|skyscraper|social\w*|sponsor\w*|subscribe\w*|subscription|taboola|tags|toolbar|tooltip|topbar|widget\w*|alert\w*)(?:$|[\s_-]|\d)",
    re.I,
)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|body|content\w*|entry\w*|main\w*|page|post|story\w*|text|blog)(?:$|[\s_-]|\d)", re.I)
_OWNED = re.compile(r"^(?:has|with|no|without|is|hide)[_-]", re.I)
_BAD_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 div section article main body".split())
TAG_POINTS = {"article": 25, "main": 25, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "th": -5, "h1": -5, "h2": -5, "h3": -5, "h4": -5}
MIN_PARAGRAPH = 25


class Node:
    __slots__ = ("tag", "parent", "items", "dropped", "points", "scored", "length", "linked", "hint", "inline")

    def __init__(self, tag: str, parent: Node | None, hint: float = 0.0, dropped: bool = False):
        self.tag, self.parent, self.hint, self.dropped = tag, parent, hint, dropped
        self.items: list = []  # texts and nodes in page order
        self.points, self.scored, self.length, self.linked = 0.0, False, 0, 0
        self.inline = tag not in BLOCKS


def _boilerplate(names: str) -> bool:
    """Whether a class or id names boilerplate before it names content."""
    for name in names.split():
        if _BAD.search(name) and not _OWNED.match(name):
            return True
        if _GOOD.search(name):
            return False
    return False


def _hint(tag: str, attributes: str, in_article: bool) -> tuple[float, bool]:
    """(points from class and id, whether the element is boilerplate)."""
    dropped = tag in DROPPED or tag == "header" and not in_article
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return 0.0, dropped
    hint = 0.0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            bad = _boilerplate(value)
            hint += 25 * bool(_GOOD.search(value)) - 25 * bad
            dropped |= bad and tag not in ("body", "html", "article", "main", "form")
        elif name == "role":
            dropped |= value.lower() in _BAD_ROLE
        elif name == "style":
            dropped |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            dropped |= tag not in ("body", "html")
    return hint, dropped


def parse(page: str) -> Node:
    root = at = Node("#root", None)
    position, end = 0, len(page)

    def close(tags: frozenset | set, barrier: frozenset) -> None:
        """End the nearest open element of ``tags`` that no ``barrier`` encloses."""
        nonlocal at
        node = at
        while node.parent is not None and node.tag not in barrier:
            if node.tag in tags:
                at = node.parent
                return
            node = node.parent

    scope = frozenset(("table", "ul", "ol", "dl", "select", "article", "section", "main", "body", "div", "blockquote"))
    articles = 0
    while position < end:
        m = _TOKEN.search(page, position)
        text = page[position : m.start() if m else end]
        if text:
            at.items.append(text)
        if m is None:
            break
        position = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            node = at
            while node.parent is not None and node.tag != tag:
                node = node.parent
            if node.parent is not None and not (node.inline and not at.inline and node is not at):
                at = node.parent
            articles -= tag in ("article", "main") and articles > 0
            continue
        if tag in CLOSES_P:
            close({"p"}, scope - {"div", "blockquote"} | {"td", "th", "li"} if tag == "p" else scope | {"td", "th", "li"})
        if tag in ENDED_BY:
            close(ENDED_BY[tag], frozenset(("table", "ul", "ol", "dl", "select")))
        hint, dropped = _hint(tag, m[3], articles > 0)
        articles += tag in ("article", "main")
        node = Node(tag, at, hint, dropped)
        at.items.append(node)
        if tag in VOID:
            continue
        if tag in RAW and not m[3].endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, position)
            position = stop.end()
            continue
        if not (m[3].endswith("/") and tag in ("svg", "path")):
            at = node
    return root


def _order(root: Node) -> list[Node]:
    """Kept nodes, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.dropped:
            out.append(node)
            stack.extend(x for x in reversed(node.items) if isinstance(x, Node))
    return out


def _measure(nodes: list[Node]) -> None:
    """Characters of text and of linked text under each node."""
    for node in reversed(nodes):
        own = sum(len(" ".join(x.split())) for x in node.items if isinstance(x, str))
        node.length = own + sum(x.length for x in node.items if isinstance(x, Node))
        node.linked = node.length if node.tag == "a" else sum(x.linked for x in node.items if isinstance(x, Node))


def _own_text(node: Node) -> tuple[int, int]:
    """Characters and commas of the text that belongs to the node's own block, inline children included."""
    size = commas = 0
    stack = [node]
    while stack:
        for x in stack.pop().items:
            if isinstance(x, str):
                size += len(x.strip())
                commas += x.count(",") + x.count("、") + x.count("，")
            elif x.inline and not x.dropped:
                stack.append(x)
    return size, commas


def _score(nodes: list[Node]) -> list[Node]:
    """Containers that have points."""
    found = []

    def add(node: Node, points: float) -> None:
        if not node.scored:
            node.scored = True
            node.points += TAG_POINTS.get(node.tag, 0) + node.hint
            found.append(node)
        node.points += points

    for node in nodes:
        if node.tag not in PARAGRAPHS:
            continue
        size, commas = _own_text(node)
        if size < MIN_PARAGRAPH:
            continue
        points = 1 + commas + min(size // 100, 3)
        up, level = (node.parent if node.tag not in ("article", "main", "body") else node), 0
        while up is not None and up.parent is not None and level < 5:
            add(up, points / (1, 2, 6, 9, 12)[level])
            up, level = up.parent, level + 1
    for node in found:
        node.points *= 1 - node.linked / max(1, node.length)
    return found


def _blocks(roots: list[Node]) -> list[str]:
    """Texts of the blocks in page order, references decoded and white space collapsed."""
    blocks, run = [], []

    def flush() -> None:
        if run:
            if text := " ".join(references.unescape("".join(run)).split()):
                blocks.append(text)
            run.clear()

    stack: list = list(reversed(roots))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.dropped:
            continue
        elif x.tag == "br":
            run.append(" ")
        elif x.inline:
            stack.extend(reversed(x.items))
        else:
            flush()
            stack.append(None)
            stack.extend(reversed(x.items))
    flush()
    return blocks


def _without_forms(root: Node) -> list[Node]:
    """Kept nodes with their measures, once the forms are gone that do not wrap the page."""
    nodes = _order(root)
    _measure(nodes)
    forms = [n for n in nodes if n.tag == "form" and 2 * n.length <= root.length]
    if forms:
        for node in forms:
            node.dropped = True
        nodes = _order(root)
        _measure(nodes)
    return nodes


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    nodes = _without_forms(root)
    found = _score(nodes)
    if not found:
        return "\n".join(_blocks([root]))
    best = max(found, key=lambda n: n.points)
    while best.parent is not None and best.parent.scored and best.parent.points >= best.points and best.parent.tag not in ("body", "html", "#root"):
        best = best.parent
    limit = max(10.0, best.points * 0.2)
    kept = {id(best)}
    for x in best.parent.items if best.parent is not None else ():
        if isinstance(x, Node) and not x.dropped and x is not best:
            density = x.linked / max(1, x.length)
            if x.scored and x.points >= limit or x.tag == "p" and (x.length > 80 and density < 0.25 or 0 < x.length <= 80 and not density):
                kept.add(id(x))
            elif x.tag in ("h1", "h2", "h3", "h4", "ul", "ol", "blockquote", "pre", "table", "dl", "figure", "header") and x.length and density < 0.25:
                kept.add(id(x))
    above, node = set(), best
    while node is not None:
        above.add(id(node))
        node = node.parent
    kept |= {id(x) for x in found if x.points >= max(10.0, best.points * 0.5) and x.linked < 0.25 * x.length and id(x) not in above}
    return "\n".join(_blocks(_topmost(root, kept)))


def _topmost(root: Node, kept: set[int]) -> list[Node]:
    """The nodes of ``kept`` in page order, without those inside another one."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if id(node) in kept:
            out.append(node)
        elif not node.dropped:
            stack.extend(x for x in reversed(node.items) if isinstance(x, Node))
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = pa.array([main_text(t) for t in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], ["page_id", "url", "text"])

    rows = spread(pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].alias("text")))
    return rows.mapInArrow(emit, "page_id long, url string, text string")
