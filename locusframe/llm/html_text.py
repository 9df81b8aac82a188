"""Main text of web pages by tree scoring.

The markup is read into a tree of block elements. Elements that are never part
of an article (menus, page headers and footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments: by tag, role, or a whole word of class
or id) are left out. Words of class and id are doubts only: an element stays if
no other holds the article, and headings, titles of an article's sections and
what names other parts (has-sidebar, no-comments) raise none. Every paragraph passes points, one and more for length
and commas, to its parent and half of them to its grandparent; a container's points
are discounted by its share of link text. The best container is kept, or the
article or main element around it, with those siblings that score alike. Without
such an element, it is widened to hold all containers that score alike and the
sections it is one of, up to the body, where each branch with such a container
is kept; beside it, text that is mostly no link stays, sections in the body as
well as anything in a narrower wrapper, whatever its score.

Blocks keep the page's order; references are decoded, white space in a block
becomes one space, empty blocks go, blocks are joined by a line feed. Nothing
else is dropped, whatever its length. The text of formulas (math) stays, drawings
(svg) go.

The time is linear in the page: open elements are known by name, and what an
element has from its ancestors or descendants is passed on once, from parent to
child or back.

Defined results: null or empty markup, and pages without text outside the parts
named above, give an empty text. Markup cut off anywhere is read as far as it
goes; a tag or comment that never ends is dropped. Repeated rows give repeated
rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read_table

# Element names as HTML defines them.
RAW = ("script", "style", "noscript", "template", "title", "textarea", "iframe", "svg", "annotation", "annotation-xml", "object", "xmp", "noframes")
BLOCKS = frozenset(
    "html head body div section article main header footer nav aside form fieldset figure figcaption p pre blockquote address "
    "h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th details summary dialog menu center hgroup search "
    "button select label legend datalist".split()
)
NEVER = frozenset("head nav footer aside form fieldset dialog menu search button select label legend datalist".split())
#: Element -> elements that its start ends, up to (not past) the others.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "thead": (("caption",), ("table",)),
}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Words of class and id, and roles, of what is no part of an article.
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal "
    "overlay sidebar side nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager comment comments commentlist disqus replies reply respond "
    "discussion footer header masthead share sharing social newsletter subscribe signup login related recommended widget widgets toolbar skip".split()
)
UNLIKELY_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
_KEEP = frozenset(("html", "body", "article", "main"))
#: First words of a class or id that tells what else the page has, and ids of what holds an article.
OTHERS = frozenset("has with no without".split())
HOLDERS = frozenset("article content main".split())
#: Points that a container in a doubted element needs to count, where no other has any.
DOUBTED_LEAST = 5

# A quote opens a value only after "="; one that never closes takes the rest of the page, as in browsers.
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*+(?:\"[^\"]*\"|'[^']*')|=(?!\s*[\"'])|[^>=])*+)(?P<close>>|\Z|=)",
    re.S,
)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
#: The end of a foreign element's start tag that closes it; a slash that ends an unquoted value does not.
_CLOSED = re.compile(r"(?:^|[\s\"'/]|(?:^|\s)[^\s=\"'/]+)/\Z")
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Characters that a paragraph needs to pass points; characters for a further point, and points for length at most.
LEAST, STEP, MOST = 25, 100, 3
#: A sibling of the best container is kept from this share of its score.
SIBLING = 0.2
#: Blocks beside the best container are kept if less than this share of their text is in links.
LINKS = 0.25
_PAGE = frozenset(("html", "body", "#root"))


class Node:
    __slots__ = ("tag", "parent", "dropped", "score", "chars", "link_chars", "likely", "doubt", "doubts", "kept", "sibling", "meets", "branch")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, likely: bool, doubted: bool = False):
        self.tag, self.parent, self.dropped, self.likely = tag, parent, dropped, likely
        self.score = self.chars = self.link_chars = 0.0
        #: Of the elements from the root to this one whose class or id has a word of UNLIKELY, the last, and their number.
        self.doubt: Node | None = self if doubted else parent.doubt if parent is not None else None
        self.doubts: int = int(doubted) + (parent.doubts if parent is not None else 0)


def _attributes(raw: str) -> dict[str, str]:
    """Values by name in lower case; of a repeated name the first, as in browsers."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _hidden(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether an element is never part of an article, by its tag, role or style."""
    if tag in NEVER:
        return True
    if tag == "header":
        return not in_article
    if not attrs or tag in _KEEP:
        return False
    return (
        attrs.get("role", "").strip().lower() in UNLIKELY_ROLES
        or "hidden" in attrs
        or attrs.get("aria-hidden", "").lower() == "true"
        or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I) is not None
    )


def _doubted(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether a class or id speaks against an element; what it has or lacks (has-sidebar, no-comments) does not, nor a heading's."""
    if tag in _KEEP or tag in _HEADINGS or tag == "header":
        return False
    named = [(n, _WORD.findall(_CASE.sub(" ", token).lower())) for n in ("class", "id") for token in attrs.get(n, "").split()]
    named = [(n, words) for n, words in named if words and words[0] not in OTHERS]
    if attrs.get("id", "").strip().lower() in HOLDERS:
        return False
    for name, words in named:
        hits = set(words) & UNLIKELY
        if in_article:
            hits -= {"header"}
            if tag == "section" and name == "id":  # the id of a section of an article is its title
                hits = hits - {"discussion"} if hits.issuperset(words) else set()
        if hits:
            return True
    return False


def blocks_of(page: str) -> tuple[list[tuple[Node, str, int]], list[Node]]:
    """(element, text, characters in links) of every non-empty block outside hidden elements, in page order, and all elements, parents first."""
    root = Node("#root", None, False, False)
    stack, blocks, nodes = [root], [], [root]
    open_at: dict[str, list[int]] = {}  # depths of the open elements of each name

    def last_open(names: Iterable[str]) -> int:
        """Depth of the last open element of these names; 0: none."""
        return max((open_at[n][-1] for n in names if open_at.get(n)), default=0)

    parts: list[str] = []
    links: list[str] = []
    link_at = 0  # depth of the stack where a link is open; 0: none

    def flush() -> None:
        if parts:
            top = stack[-1]
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text and not top.dropped:
                blocks.append((top, text, len(" ".join("".join(links).split()))))
            links.clear()

    def pop_to(depth: int) -> None:
        nonlocal link_at
        flush()
        for node in stack[depth:]:
            open_at[node.tag].pop()
        del stack[depth:]
        if link_at > len(stack):
            link_at = 0

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else size]
        if text:
            parts.append(text)
            if link_at:
                links.append(text)
        if not m:
            break
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        if m["close"] != ">":  # a tag that never ends
            break
        tag = tag.lower()
        if m["end"]:
            if tag == "a":
                link_at = 0
            elif tag in BLOCKS:
                depth = last_open(_HEADINGS if tag in _HEADINGS else (tag,))
                if depth:
                    pop_to(depth)
            continue
        if tag == "svg" and _CLOSED.search(m["attrs"]):
            continue
        if tag in _RAW_END:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else size
            continue
        if tag == "a":
            link_at = len(stack)
        elif tag == "br":
            parts.append(" ")
        elif tag == "hr":
            flush()
        elif tag in BLOCKS:
            flush()
            if stack[-1].tag == "p" or (tag in _HEADINGS and stack[-1].tag in _HEADINGS):
                pop_to(len(stack) - 1)
            if tag in IMPLIED:
                ends, barriers = IMPLIED[tag]
                depth = last_open(ends)
                if depth > last_open(barriers):
                    pop_to(depth)
            parent = stack[-1]
            attrs = _attributes(m["attrs"])
            likely = parent.likely or tag in ("article", "main") or attrs.get("role", "").strip().lower() == "main"
            node = Node(tag, parent, parent.dropped or _hidden(tag, attrs, likely), likely, _doubted(tag, attrs, likely))
            open_at.setdefault(tag, []).append(len(stack))
            stack.append(node)
            nodes.append(node)
    flush()
    return blocks, nodes


def _widened(best: Node, strong: list[Node], nodes: list[Node]) -> tuple[Node, set[int]]:
    """The element below the body that holds ``best`` with all ``strong`` containers, and the body's branches that hold others."""
    path, node = [], best
    while node is not None and node.tag not in _PAGE:
        path.append(node)
        node = node.parent
    if not path:
        return best, set()
    place = {id(n): i for i, n in enumerate(path)}
    # Where each element's way up meets the path, or else the branch of the body that it ends in.
    for node in nodes:
        up = node.parent
        if id(node) in place:
            node.meets, node.branch = place[id(node)], None
        elif node.tag in _PAGE or up is None:
            node.meets, node.branch = None, None
        else:
            node.meets, node.branch = up.meets, node if up.tag in _PAGE else up.branch
    at, branches = 0, set()
    for other in strong:
        if other.meets is not None:
            at = max(at, other.meets)
        elif other.branch is not None:
            branches.add(id(other.branch))
    if branches:
        at = len(path) - 1
    for i in range(at, len(path) - 1):
        if path[i].tag == "section":
            at = i + 1
    return path[at], branches


def _points(node: Node, text: str) -> float:
    """What a block passes on."""
    if len(text) < LEAST or node.tag in _HEADINGS:
        return 0
    return 1 + text.count(",") + min(len(text) / STEP, MOST)


def _undoubted(blocks: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """The blocks outside doubted elements, but for those that hold the article.

    They hold it if no block outside passes points, or none of an article or
    main element where they have one. Of the elements doubted least the one
    with most points counts.
    """
    if not any(node.doubts for node, _, _ in blocks):
        return blocks
    points: dict[tuple[bool, Node | None], float] = {}
    for node, text, inside in blocks:
        if p := _points(node, text) * (1 - inside / len(text) if inside < len(text) else 0):
            key = (node.likely, node.doubt)
            points[key] = points.get(key, 0) + p
    least = {k: p for k, p in points.items() if k[1] is None or p >= DOUBTED_LEAST}
    likely = {k: p for k, p in least.items() if k[0]}
    doubt = min(likely or least, key=lambda k: (k[1].doubts if k[1] else 0, -least[k]), default=(False, None))[1]
    allowed = {id(None)}
    while doubt is not None:
        allowed.add(id(doubt))
        doubt = doubt.parent.doubt if doubt.parent is not None else None
    return [x for x in blocks if id(x[0].doubt) in allowed]


def main_text(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    blocks, nodes = blocks_of(page)
    found = _undoubted(blocks)
    if not found:
        return ""
    for node, text, inside in found:
        node.chars += len(text)
        node.link_chars += inside
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
    blocks = [(node, text) for node, text, _ in found]
    scored: dict[int, Node] = {}
    direct: dict[int, Node] = {}
    for node, text in blocks:
        points = _points(node, text)
        if not points:
            continue
        # Text straight in a container counts for it as a paragraph's does for its parent.
        own = node if node.tag not in ("p", "pre", "blockquote", "li", "td", "dd") else node.parent
        if own is not None:
            direct[id(own)] = own
        for container, share in ((own, 1.0), (own.parent if own else None, 0.5)):
            if container is not None and container.tag != "#root":
                container.score += points * share
                scored[id(container)] = container
    for node in scored.values():
        node.score *= 1 - node.link_chars / max(1.0, node.chars)
        if node.tag in ("article", "main"):
            node.score += 25
    best = max(scored.values(), key=lambda n: n.score, default=None)
    if best is None:
        best = next((n for n, _ in blocks if n.likely), None)
    if best is None:
        return "\n".join(t for _, t in blocks)
    top, node = best, best
    while node is not None:
        if node.tag in ("article", "main"):
            top = node
            if node.tag == "article":
                break
        node = node.parent
    keep = set()
    if not top.likely:
        top, keep = _widened(best, [n for n in direct.values() if n.score >= SIBLING * best.score], nodes)
    top.score = max(top.score, best.score)
    keep.add(id(top))
    for other in scored.values():
        if other.parent is top.parent and other.tag not in ("html", "body") and other.score >= SIBLING * top.score:
            keep.add(id(other))
    beside = ("p", "pre", "blockquote", *_HEADINGS, *(("section",) if top.tag == "section" else ()))
    narrow = top.parent is not None and top.parent.tag not in _PAGE
    for node in nodes:
        up = node.parent
        node.kept = id(node) in keep or (up is not None and up.kept)
        node.sibling = node if up is top.parent else up.sibling if up is not None else None
    out = []
    for node, text in blocks:
        sibling = node.sibling
        if node.kept:
            out.append(text)
        elif node is top.parent and narrow:
            # Text straight in the wrapper.
            out.append(text)
        elif sibling is not None and not top.likely and (narrow or sibling.tag in beside):
            # A sibling that is mostly no link text.
            if sibling.link_chars < LINKS * sibling.chars:
                out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    ).mapInPandas(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
