"""Main text of web pages by composite text density.

For every node of the page: characters and tags below it, and those of them in links. The
composite density is characters per tag, adjusted for links; the density sum of a node adds up
the densities of its children. The node with the largest sum is the heart of the article; the
least density on its path to the body is the threshold that other parts have to reach to belong
to the article too. Formatting inside a line (``b``, ``span``, ...) is no tag of its own in these
counts. Tags and names are evidence beside the densities: inside the ``article`` or ``main`` element
that holds the heart a part needs a density above zero only, and a heading belongs to the part after it.

Sun, Song, Liao, "DOM based content extraction via text density" (2011). Parts that are never
article text (menus, forms, scripts, ...) leave the page first, and parts whose names say so
(adverts, comments of readers, ...) unless they hold the article (``without_marked``).
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweave.llm.words import pieces

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
    "u", "var", "wbr", "img",
}
#: Inline elements that only format a line; they are not counted as tags.
FORMATS = INLINE - {"a", "img", "label"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that end an open paragraph.
CLOSES_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
#: A start tag ends an open element of these names, up to the given containers.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
#: Elements that are never article text.
DROPPED = {
    "aside", "audio", "button", "canvas", "datalist", "dialog", "footer", "form", "frameset", "head", "iframe", "input", "map",
    "menu", "nav", "noscript", "object", "script", "select", "style", "svg", "template", "textarea", "title", "video",
}
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
#: Words in a class or id that mark what is not the article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?<!\bno[_-])(?<!\bwith[_-])(?<!\bhas[_-])(?<!\bwithout[_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promo(?:s|tion|tions|ted)?|banners?|cookies?|consent|gdpr|"
    r"notices?|notifications?|popups?|modals?|overlays?|newsletters?|subscri(?:be|ption)s?|signup|login|paywall|sidebars?|side-?bar|"
    r"menus?|nav|navbar|navigation|navs?|breadcrumbs?|pagination|pager|header|masthead|footer|foot|comments?|commentlist|disqus|"
    r"replies|respond|social|shar(?:e|es|ing)|related|recommend(?:ed|ations?)|widgets?|toolbars?|search|skip(?:-?link)?|"
    r"copyright|legal|disclaimers?|tags|byline-?ads?)(?:$|[\s_-])",
    re.IGNORECASE,
)
KEPT = {"html", "body", "article", "main"}
#: What may stand in a head; any other element ends it.
IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title", "object"}
#: Marks of nodes: never article text, or named like it.
NEVER, NAMED = 2, 1


class Node:
    __slots__ = ("tag", "parent", "items", "chars", "tags", "link_chars", "link_tags", "density", "total", "breaks", "mark", "depth")

    def __init__(self, tag: str, parent: Node | None, mark: int = 0) -> None:
        self.tag, self.parent, self.mark = tag, parent, mark
        self.depth = parent.depth + 1 if parent else 0
        self.breaks = 0
        #: Child nodes and texts in page order.
        self.items: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _mark(tag: str, attrs: list[tuple[str, str | None]], inside_article: bool) -> int:
    if tag in DROPPED or tag == "header" and not inside_article:
        return NEVER
    if tag in KEPT:
        return 0
    named = 0
    for name, value in attrs:
        if name in ("class", "id") and value and MARKS.search(value):
            named = NAMED
        if name == "role" and value and value.strip().lower() in ROLES:
            return NEVER
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return NEVER
        if name == "style" and value and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return NEVER
    return named


class Page(HTMLParser):
    """The tree of a page, parts that are no article text marked. Broken markup is taken as it comes.

    The open elements are kept by name, so an end tag looks at no other elements than those it ends.
    """

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None)
        self.body: Node | None = None
        self.articles = 0
        self.open: dict[str, list[Node]] = {}
        self.open_marked: list[Node] = []
        self.open_marked_blocks: list[Node] = []
        self.feed(html)
        self.close()

    def _outermost_marked(self) -> Node | None:
        return self.open_marked[0] if self.open_marked else None

    def _innermost(self, tags: set[str]) -> Node | None:
        found = [self.open[t][-1] for t in tags if self.open.get(t)]
        return max(found, key=lambda n: n.depth, default=None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.at.tag == "head" and tag not in IN_HEAD:
            self._end({"head"}, set())
        if tag in CLOSES_P:
            self._end({"p"}, {"article", "section", "div", "td", "li", "body", "main", "blockquote"})
        if tag in ENDS:
            while self._end(*ENDS[tag]):
                pass
        if tag in VOID:
            if tag in ("br", "hr"):
                self.at.items.append(" ")
                self.at.breaks += 1
            return
        if tag in ("html", "body") and (self.body is not None or self._outermost_marked()):
            return
        node = Node(tag, self.at, _mark(tag, attrs, self.articles > 0))
        self.at.items.append(node)
        self.at = node
        self.open.setdefault(tag, []).append(node)
        if node.mark:
            self.open_marked.append(node)
            if tag not in INLINE:
                self.open_marked_blocks.append(node)
        self.articles += tag in ("article", "main")
        if tag == "body":
            self.body = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "a", "span", "script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("body", "html"):
            marked = self._outermost_marked()
            if marked is not None:
                self._leave(marked)
            return
        if tag in VOID:
            return
        small = tag in INLINE or tag == "p"
        self._end({tag}, {"article", "section"} - {tag} if small else set(), small)

    def _end(self, tags: set[str], up_to: set[str], within_marked: bool = False) -> bool:
        """End the innermost open element of these names, unless one that bounds it is further inside."""
        node = self._innermost(tags)
        if node is None:
            return False
        bound = self._innermost(up_to)
        if bound is not None and bound.depth > node.depth:
            return False
        if within_marked and self.open_marked_blocks and self.open_marked_blocks[-1].depth > node.depth:
            return False
        self._leave(node)
        return True

    def _leave(self, node: Node) -> None:
        while self.at is not node.parent:
            left, self.at = self.at, self.at.parent
            self.open[left.tag].pop()
            for waiting in (self.open_marked, self.open_marked_blocks):
                if waiting and waiting[-1] is left:
                    waiting.pop()
            self.articles -= left.tag in ("article", "main")

    def handle_data(self, data: str) -> None:
        self.at.items.append(data)


def _drop(top: Node, dropped: Callable[[Node], bool]) -> None:
    """Leave out the nodes below ``top``, with all they hold; blocks leave a space."""
    waiting = [top]
    while waiting:
        node = waiting.pop()
        if any(type(item) is Node and dropped(item) for item in node.items):
            node.items = [("" if i.tag in INLINE else " ") if type(i) is Node and dropped(i) else i for i in node.items]
        waiting += [item for item in node.items if type(item) is Node]


def without_marked(body: Node) -> None:
    """Leave out what is never article text, and what is named like it and does not hold the article.

    The article is where the page has an ``article`` or ``main`` element. Without one, a named part is
    taken to hold it that has the largest density sum or most of the characters outside links, unless
    there is a heading and a fair share of these characters outside all named parts.
    """
    _drop(body, lambda n: n.mark == NEVER)
    nodes = _in_order(body)
    if not any(n.mark for n in nodes):
        return
    measure(body)
    unlinked = lambda n: n.chars - n.link_chars
    holding: set[Node] = set()
    articles = [n for n in nodes if n.tag in ("article", "main")]
    for n in articles:
        while n not in holding:
            holding.add(n)
            n = body if n is body else n.parent
    if not articles:
        inside: set[Node] = set()
        for n in nodes:  # parents first
            if n.mark or n.parent in inside:
                inside.add(n)
        outer = [n for n in inside if n.parent not in inside]
        outside = unlinked(body) - sum(map(unlinked, outer))
        headed = any(n.tag == "h1" and n not in inside for n in nodes)
        if not headed or outside < unlinked(body) / 4:
            holding.update(_path(max(nodes, key=lambda n: n.total), body))
            holding.update(n for n in nodes if 2 * unlinked(n) > unlinked(body))
    _drop(body, lambda n: n.mark == NAMED and n not in holding)


def _path(node: Node, body: Node) -> list[Node]:
    """The node and all above it up to the body."""
    path = [node]
    while path[-1] is not body:
        path.append(path[-1].parent)
    return path


def _in_order(top: Node) -> list[Node]:
    """All nodes below ``top`` and itself, parents first. Without recursion: pages nest deeply."""
    nodes, at = [top], 0
    while at < len(nodes):
        nodes += [item for item in nodes[at].items if type(item) is Node]
        at += 1
    return nodes


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, body_link_share: float) -> float:
    """Characters per tag, the lower the more of both are in links."""
    if not chars:
        return 0.0
    tags, links, link_tags = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + body_link_share * chars + math.e)
    return chars / tags * math.log(max(chars / links * tags / link_tags, 1.0)) / base if base > 0 else 0.0


def measure(body: Node) -> list[Node]:
    """Set the counts, densities and sums of all nodes of the body."""
    nodes = _in_order(body)
    for node in nodes:
        node.chars = node.link_chars = node.link_tags = 0
        node.tags, node.total = node.breaks, 0.0
    for node in reversed(nodes):
        own = sum(len("".join(item.split())) for item in node.items if type(item) is str)
        node.chars += own
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        if node is not body:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + (node.tag not in FORMATS)
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    share = body.link_chars / max(body.chars, 1)
    for node in reversed(nodes):
        node.density = composite_density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        texts = (len("".join(item.split())) for item in node.items if type(item) is str)
        # A text is a child of one tag that is no link, unless it is in one.
        node.total += sum(0.0 if node.tag == "a" else composite_density(n, 1, 0, 0, share) for n in texts)
        if node is not body:
            node.parent.total += node.density
    return nodes


def blocks(node: Node) -> list[Node | list[Node | str]]:
    """What a node holds, in page order: its block elements, and between them lists of loose text and inline elements."""
    found: list[Node | list[Node | str]] = []
    for item in node.items:
        if type(item) is Node and item.tag not in INLINE:
            found.append(item)
        elif found and type(found[-1]) is list:
            found[-1].append(item)
        else:
            found.append([item])
    return found


def as_node(run: list[Node | str]) -> Node:
    """Loose text counted as if it were one block."""
    block = Node("#text", None)
    nodes = [item for item in run if type(item) is Node]
    block.link_chars, block.link_tags = sum(n.link_chars for n in nodes), sum(n.link_tags for n in nodes)
    block.chars = sum(len("".join(item.split())) for item in run if type(item) is str) + sum(n.chars for n in nodes)
    block.tags = sum(n.tags + (n.tag not in FORMATS) for n in nodes)
    return block


def chosen_parts(body: Node) -> list[Node | list[Node | str]]:
    """The subtrees, and the loose texts between them, that make up the article, in page order.

    Beside the heart stands what reaches the threshold of its path. Inside the innermost ``article`` or
    ``main`` on that path anything counts that is not all links. A heading belongs to the part directly
    after it, and so does loose text between a heading or a part and a part.
    """
    nodes = measure(body)
    heart = max(nodes, key=lambda n: n.total)
    if heart.chars == 0:
        return []
    while heart.tag in INLINE and heart is not body:
        heart = heart.parent
    path = _path(heart, body)
    on_path = set(path)
    threshold = min(n.density for n in path)
    named = next((n for n in path if n.tag in ("article", "main")), None)
    within = set(path[: path.index(named) + 1]) if named else set()
    share = body.link_chars / max(body.chars, 1)

    def chosen(node: Node) -> list[Node | list[Node | str]]:
        """The parts of what a node of the path holds."""
        least = 0.0 if node in within else threshold
        held = []
        for part in blocks(node):
            counts = part if type(part) is Node else as_node(part)
            if counts.chars > counts.link_chars:  # blanks and pure links never belong
                density = composite_density(counts.chars, counts.tags, counts.link_chars, counts.link_tags, share)
                held.append([part, counts in on_path or density >= least])
        for at in range(len(held) - 2, -1, -1):
            part, belongs = held[at]
            if belongs or not held[at + 1][1]:
                continue
            before = held[at - 1] if at else None
            if type(part) is Node:
                held[at][1] = part.tag in HEADINGS
            elif before is not None:
                held[at][1] = before[1] or type(before[0]) is Node and before[0].tag in HEADINGS
        return [h[0] for h in held if h[1]]

    parts, waiting = [], [body]
    while waiting:
        part = waiting.pop()
        if part is heart or type(part) is list:
            parts.append(part)
        elif part in on_path:
            waiting += reversed(chosen(part))
        elif part.parent in within or part.tag in HEADINGS:
            parts.append(part)
        else:
            parts.append(max(_in_order(part), key=lambda n: n.total))
    return parts


def block_text(part: Node | list[Node | str]) -> str:
    """The text of a subtree or of loose text, with a space wherever a block begins or ends."""
    out: list[str] = []
    waiting: list[Node | str] = list(reversed(part)) if type(part) is list else [part]
    while waiting:
        item = waiting.pop()
        if type(item) is str:
            out.append(item)
        else:
            edge = "" if item.tag in INLINE else " "
            out.append(edge)
            waiting.append(edge)
            waiting += reversed(item.items)
    return " ".join("".join(out).split())


def main_text(html: str) -> str:
    """The article of a page as blocks joined by one space; empty if there is none."""
    page = Page(html)
    body = page.body or page.root
    without_marked(body)
    return " ".join(t for t in map(block_text, chosen_parts(body)) if t)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``(id_column, url_column, text, n_chars)`` of every page, in one pass without a shuffle.

    A null or empty page, and one without text, gives the empty text. Broken markup never fails.
    Pages given twice give two equal rows; null ids and urls stay null; an empty table gives an
    empty result; other columns are not read. A worker parses one page at a time, whole.
    """

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                texts = [main_text(html) if html else "" for html in piece.column(2).to_pylist()]
                columns = [piece.column(0), piece.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "url", "text", "n_chars"])

    types = dict(pages.dtypes)
    given = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("text"))
    schema = f"id {types[id_column]}, url {types[url_column]}, text string, n_chars bigint"
    return given.mapInArrow(extracted, schema).withColumnsRenamed({"id": id_column, "url": url_column})
