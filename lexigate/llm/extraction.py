"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Every paragraph passes points to its ancestors,
one plus one per comma plus one per hundred characters (three at most): all to the
parent, half to the grandparent, less further up. A container's points are discounted
by its link density. If the best container lies in an ``article`` or ``main`` element,
that element is kept whole; else the container with those of its siblings that score near
it or are link-poor text or headings. Parts that are no article text (scripts, forms,
menus, footers, adverts, notices, comments and the like) are left out before scoring and
from what is kept: by element, by role, or by a word that is a class or id, or its head or
tail ("menu-top", "site-footer"), but not beside a word of state ("no-sidebar",
"page-with-comments"). The header of an article is its own. A part that a class word
leaves out stays if it holds more than half of the page's paragraphs, unless the word
says comments or other articles.

Text is cut into blocks at block elements; inside a block white space (line breaks
too) becomes one space; blocks are joined by one newline in page order.

Defined cases: null or empty html has empty text; a page without any paragraph keeps
the text of its body; unclosed or stray tags, cut pages and unknown entities are taken
as they stand; on equal scores the first container wins; repeated rows are read one
by one; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed element lists of the HTML standard's rendering rules.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p
pre search section summary table tbody td tfoot th thead tr ul""".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select".split())
# Elements whose start closes an open one of the same group.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
LEFT_OUT = frozenset("""script style noscript template iframe svg math object embed nav footer header aside form
button input select textarea label menu dialog head title fieldset canvas audio video""".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
LEFT_OUT_WORDS = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|gdpr|popup|modal|newsletter|subscribe|"
    r"sidebar|side-bar|nav|navbar|navigation|menu|breadcrumbs?|footer|masthead|share|sharing|social|widget|toolbar|"
    r"pagination|pager|login|signup", re.IGNORECASE)
OTHER_TEXTS = re.compile(r"comments?|disqus|replies|respond|related|recommended", re.IGNORECASE)
STATES = frozenset("no not non has have with without is hide hidden show open closed active enabled".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset(["p", "pre", "td", "blockquote", "li", "dd"])
KEEP_SHARE, PARAGRAPH_SHARE = 0.2, 0.25

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?
|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|</?[A-Za-z][^<]*\Z""", re.DOTALL | re.VERBOSE)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


class Node:
    __slots__ = ("tag", "parent", "children", "points", "dropped", "named", "article")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, named: bool = False):
        self.tag, self.parent, self.dropped, self.named = tag, parent, dropped, named
        self.article: Node | None = parent.article if parent else None  # nearest article, else main
        self.children: list[Node | str] = []
        self.points = 0.0


def _says(words: re.Pattern, names: str) -> bool:
    """Whether a class or id is, begins or ends with one of the words."""
    for name in names.lower().split():
        parts = re.split("[-_]+", name)
        if words.fullmatch(name) or not STATES.intersection(parts) and (
                words.fullmatch(parts[0]) or words.fullmatch(parts[-1])):
            return True
    return False


def _left_out(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """(left out, left out by a class word alone)."""
    if tag in LEFT_OUT and not (tag == "header" and in_article):
        return True, False
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, False
    named = False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value, name = html.unescape(a or b or c), name.lower()
        if name in ("class", "id"):
            if _says(OTHER_TEXTS, value):
                return True, False
            named = named or _says(LEFT_OUT_WORDS, value)
        if name == "role" and value.strip().lower() in LEFT_OUT_ROLES:
            return True, False
        if name == "aria-hidden" and value.strip().lower() == "true":
            return True, False
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes)), named


def parse(page: str) -> Node:
    """Tree of the page; strings are decoded text. Depth is bounded only by the page,
    so nothing here recurses."""
    root = node = Node("", None)
    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        text = page[at:m.start() if m else len(page)]
        if text:
            node.children.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            up = node
            while up is not root and up.tag != tag:
                if tag not in BLOCK and up.tag in BLOCK:
                    up = root  # an inline end does not close a block
                    break
                up = up.parent
            if up is not root:
                node = up.parent
            continue
        if tag in BLOCK:  # a block ends an open paragraph and what is open in it
            up = node
            while up is not root and up.tag not in BLOCK:
                up = up.parent
            if up.tag == "p" or up.tag in ENDS.get(tag, ()):
                node = up.parent
                if tag in ("tr",) and node.tag == "tr":
                    node = node.parent
        out, named = _left_out(tag, m[3], node.article is not None)
        new = Node(tag, node, node.dropped or out, named)
        if tag == "article" or tag == "main" and new.article is None:
            new.article = new
        node.children.append(new)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
            if tag in ("title", "textarea"):
                new.children.append(html.unescape(page[at:end.start() if end else len(page)]))
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            node = new
    _settle(root)
    return root


def _settle(root: Node) -> None:
    """Leave out what a class word names, but for parts with most of the paragraphs."""
    inside: dict[int, int] = {}  # characters of paragraphs below each named part
    open_: list[Node] = []
    total = paragraphs = 0
    for item, ending in _walk(root):
        if isinstance(item, str):
            if paragraphs:
                size = len(" ".join(item.split()))
                total += size
                for part in open_:
                    inside[id(part)] += size
            continue
        paragraphs += (item.tag in PARAGRAPHS) * (-1 if ending else 1)
        if item.named:
            if ending:
                open_.pop()
            else:
                open_.append(item)
                inside[id(item)] = 0
    for item, ending in _walk(root):
        if not isinstance(item, str) and item.named and not ending and 2 * inside[id(item)] <= total:
            item.dropped = True


def _walk(top: Node) -> Iterator[tuple[Node | str, bool]]:
    """Kept nodes and texts in page order; elements come again when they end."""
    stack: list[tuple[Node | str, bool]] = [(top, False)]
    while stack:
        item, ending = stack.pop()
        if isinstance(item, str):
            yield item, False
        elif ending:
            yield item, True
        elif not item.dropped:
            yield item, False
            stack.append((item, True))
            stack.extend((c, False) for c in reversed(item.children))


def blocks(top: Node) -> list[str]:
    out: list[str] = []
    parts: list[str] = []

    def close() -> None:
        if text := " ".join("".join(parts).split()):
            out.append(text)
        parts.clear()

    for item, _ in _walk(top):
        if isinstance(item, str):
            parts.append(item)
        elif item.tag in BLOCK or item.tag == "hr":
            close()
        elif item.tag == "br":
            parts.append(" ")
    close()
    return out


def _measures(root: Node) -> dict[int, tuple[int, int, int]]:
    """(characters, characters in links, commas) below each kept element."""
    found: dict[int, tuple[int, int, int]] = {}
    open_: list[list[int]] = []
    links = 0
    for item, ending in _walk(root):
        if isinstance(item, str):
            text = " ".join(item.split())
            if open_:
                own = open_[-1]
                own[0] += len(text)
                own[1] += len(text) * (links > 0)
                own[2] += text.count(",")
        elif ending:
            own = open_.pop()
            links -= item.tag == "a"
            found[id(item)] = tuple(own)
            if open_:
                for k in range(3):
                    open_[-1][k] += own[k]
        else:
            open_.append([0, 0, 0])
            links += item.tag == "a"
    return found


def main_text(page: str | None) -> str:
    """Blocks of the page's article, joined by newlines."""
    if not page:
        return ""
    root = parse(page)
    size = _measures(root)

    def density(node: Node) -> float:
        chars, linked, _ = size[id(node)]
        return linked / chars if chars else 0.0

    scored: dict[int, Node] = {}
    for item, ending in _walk(root):
        if isinstance(item, str) or ending or item.tag not in PARAGRAPHS:
            continue
        chars, _, commas = size[id(item)]
        if not chars:
            continue
        points = (1 + commas + min(chars / 100, 3)) * (1 - density(item))
        up, level = item.parent, 0
        while up is not None and level < 5:
            if up.tag not in ("", "html"):
                up.points += points / (1, 2, 6, 9, 12)[level]
                scored[id(up)] = up
                level += 1
            up = up.parent
    if not scored:
        return "\n".join(blocks(root))
    value = {k: n.points * (1 - density(n)) for k, n in scored.items()}
    best = max(scored.values(), key=lambda n: value[id(n)])  # the first of equals
    while best.tag in PARAGRAPHS and best.parent.tag not in ("", "html"):
        best = best.parent
    if best.article is not None:
        return "\n".join(blocks(best.article))
    least = max(10.0, KEEP_SHARE * value.get(id(best), 0.0))
    inner = best.parent.tag not in ("", "html", "body")
    out = []
    for item in best.parent.children if best.parent.tag not in ("", "html") else [best]:
        if isinstance(item, str) or item.dropped:
            continue
        chars, linked, _ = size[id(item)]
        link_poor = chars and linked < PARAGRAPH_SHARE * chars and (
            chars >= 80 and (inner or item.tag in PARAGRAPHS) or inner and item.tag in HEADINGS)
        if item is best or value.get(id(item), 0.0) >= least or link_poor:
            out += blocks(item)
    return "\n".join(out)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` without its html, with ``text`` and ``n_chars`` (code points)."""
    names = [c for c in pages.columns if c not in (column, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(column)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    kept = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in names)
    return pages.mapInArrow(run, f"{kept}{', ' if kept else ''}text string, n_chars long")
