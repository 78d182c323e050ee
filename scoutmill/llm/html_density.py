"""HTML extraction (operator 8): main text by composite text density.

For every node of a page's tree: characters per tag, adjusted by how much of
it is link text. A node's density sum adds the densities of its children; the
node with the largest sum is the article. The least density on the path from
that node up to the body is the page's threshold: any other subtree off that
path that reaches the threshold and is not mostly links is kept too, so an
article that a page splits into siblings is whole. An article or main element
around the best node is taken with all it holds, and text that stands directly
in a node of the path is a block of the article. Elements that are furniture
by their kind are taken out before densities are counted, and so are those
that a word of their class, id or role marks, unless they hold most of the
page's plain text and no article stands beside them: a wrapper may be named
after the sidebar it also holds. Reader comments and adverts go whatever their
share. A page that would be left without any text is read again without the
other words.

Work is per page in Arrow batches, without a shuffle. Defined cases: a null or
empty page, or one without text, gives an empty string; broken and cut markup is
read as far as it goes; repeated rows are extracted each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements without an end tag, and those whose content is never text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video map datalist".split())
# Elements that are furniture wherever they stand.
FURNITURE = frozenset("nav footer aside button select textarea input label fieldset dialog menu".split())
# Elements that end the line of text before and after them.
BLOCK = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html"
    " li main ol p pre section summary table tbody td tfoot th thead tr ul nav footer aside form dialog menu".split())  # fmt: skip
# Words in a class, id or role that name furniture.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr"
    " notice notices notification alert popup modal overlay newsletter subscribe subscription signup paywall share sharing social related recommended"
    " sidebar side rail widget comment comments commentlist disqus discussion reply replies respond breadcrumb breadcrumbs menu nav navbar navigation"
    " footer masthead toolbar pagination pager tags search skip login complementary contentinfo".split())  # fmt: skip
# Those of them that never name a wrapper of the article (reader comments, adverts, consent, sign-up), and words that turn the word behind them round.
NEVER_WRAPPERS = frozenset(
    "comment comments commentlist disqus reply replies respond ad ads adv advert adverts advertisement advertising adsense sponsor sponsored"
    " cookie cookies consent gdpr newsletter subscribe subscription signup paywall popup modal".split())  # fmt: skip
NEGATIONS = frozenset("has no with without not non".split())
#: Share of the page's plain text from which an element is no furniture, whatever its name.
MOST_OF_PAGE = 0.6
# Start tags that close an open element of the named kinds.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
ENDED_BY_BLOCK = frozenset("h1 h2 h3 h4 h5 h6 p".split())


# A tag that the end of the page cuts through.
CUT_TAG = re.compile(r"<[/!?a-zA-Z][^<>]*\Z")


class Node:
    """An element with its children in page order; strings are text."""

    __slots__ = ("tag", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "parent", "name", "in_article")

    def __init__(self, tag: str, parent: Node | None, name: str = ""):
        self.tag, self.parent, self.children, self.name = tag, parent, [], name
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.in_article = tag in ("article", "main") or parent is not None and parent.in_article


def furniture_name(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> str:
    """What an element's names say: "gone", "furniture" or nothing. A section of an article may be its discussion."""
    if tag in ("body", "html", "article", "main"):
        return ""
    found = "furniture" if tag == "form" else ""
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "gone"
        if name not in ("class", "id", "role") or not value:
            continue
        for token in value.split():
            parts = [part.lower() for part in NAME_PARTS.findall(token)]
            words = {part for before, part in zip(["", *parts], parts, strict=False) if part in FURNITURE_WORDS and before not in NEGATIONS}
            if tag == "section" and in_article:
                words -= {"discussion"}
            if words & NEVER_WRAPPERS:
                return "gone"
            found = "furniture" if words else found
    return found


class TreeBuilder(HTMLParser):
    """Builds the tree of what can be text; silent elements and those of a furniture kind are passed over with all they hold."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None)
        self.at = self.root
        self.passed: list[str] = []  # open elements inside one that is passed over
        self.open: Counter[str] = Counter()  # open elements of the tree by kind

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.passed:
            if tag not in VOID:
                if self.passed[-1] == "p" and tag == "p":
                    return
                self.passed.append(tag)
            return
        if tag in ("html", "body"):
            return
        if tag in VOID:
            if tag in ("br", "hr"):
                self.at.children.append("\n" if tag == "br" else Node("hr", self.at))
            return
        self.close_implied(tag)
        if tag in SILENT or tag in FURNITURE or tag == "header" and not self.at.in_article:
            self.passed.append(tag)
            return
        node = Node(tag, self.at, furniture_name(tag, attrs, self.at.in_article))
        self.at.children.append(node)
        self.at = node
        self.open[tag] += 1

    def rise(self, to: Node) -> None:
        """Close what is open below ``to``."""
        while self.at is not to:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def path(self) -> Iterator[Node]:
        node = self.at
        while node is not None:
            yield node
            node = node.parent

    def close_implied(self, tag: str) -> None:
        if tag in BLOCK:
            for node in self.path():
                if node.tag == "p" or tag in ENDED_BY_BLOCK and node.tag in ENDED_BY_BLOCK:
                    self.rise(node.parent)
                    break
                if node.tag in BLOCK:
                    break
        if tag in CLOSED_BY:
            for node in self.path():
                if node.tag in CLOSED_BY[tag]:
                    self.rise(node.parent)
                    if tag != "tr" or node.tag == "tr":
                        break
                elif node.tag in SCOPE[tag]:
                    break

    def handle_endtag(self, tag: str) -> None:
        if self.passed:
            if tag in self.passed:
                while self.passed.pop() != tag:
                    pass
            elif tag in ("article", "main", "body", "html"):  # an unclosed element can't reach beyond its parents
                self.passed = []
                self.handle_endtag(tag)
            return
        if self.open[tag] > 0:
            self.rise(next(node for node in self.path() if node.tag == tag and node.parent is not None).parent)

    def handle_data(self, data: str) -> None:
        if not self.passed:
            self.at.children.append(data)


def parse(html: str) -> Node:
    """The tree of a page; markup that the parser gives up on ends it there."""
    builder = TreeBuilder()
    builder.feed(CUT_TAG.sub("", html))
    builder.close()
    return builder.root


def bottom_up(root: Node) -> list[Node]:
    """All nodes, children before parents, without recursion: pages can nest thousands deep."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node)]
    return order[::-1]


def without_furniture(root: Node, by_name: bool = True) -> Node:
    """Takes out what is gone by name, and (``by_name``) named furniture, but for one that holds most of the plain text of a page without an article elsewhere."""
    plain: dict[int, int] = {}
    article: dict[int, bool] = {}
    for node in bottom_up(root):
        inner = [c for c in node.children if isinstance(c, Node)]
        hidden = node.name == "gone" or node.tag == "a"
        plain[id(node)] = 0 if hidden else sum(plain[id(c)] for c in inner) + sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        article[id(node)] = plain[id(node)] > 0 and (node.tag in ("article", "main") or any(article[id(c)] for c in inner))
    enough = MOST_OF_PAGE * plain[id(root)]

    def stays(node: Node) -> bool:
        holds_page = plain[id(node)] >= enough > 0 and article[id(node)] >= article[id(root)]
        return not node.name or node.name == "furniture" and (not by_name or holds_page)

    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or stays(c)]
        stack += [c for c in node.children if isinstance(c, Node)]
    return root


def measure(root: Node) -> list[Node]:
    """Fill in counts, densities and density sums; returns the nodes, children first."""
    nodes = bottom_up(root)
    for node in nodes:
        for child in node.children:
            if isinstance(child, Node):
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags + (child.tag == "a")
            else:
                node.chars += len("".join(child.split()))
        if node.tag == "a":
            node.link_chars = node.chars
    body_ratio = root.link_chars / max(root.chars, 1)
    for node in nodes:
        if not node.chars:
            continue
        tags, links, plain = max(node.tags, 1), max(node.link_chars, 1), max(node.chars - node.link_chars, 1)
        base = math.log(node.chars * node.link_chars / plain + body_ratio * node.chars + math.e)
        adjust = math.log(node.chars / links * tags / max(node.link_tags, 1)) / math.log(max(base, 1 + 1e-9)) if base > 1 else math.log(
            node.chars / links * tags / max(node.link_tags, 1) + 1)
        node.density = node.chars / tags * max(adjust, 0.0)
    for node in nodes:
        node.total = sum(c.density for c in node.children if isinstance(c, Node))
    return nodes


def article_nodes(root: Node) -> list[Node | str]:
    """The main text in page order: the subtree of the largest density sum, or the outermost article or main around it,
    subtrees beside its path that reach the path's threshold, and loose text of the path."""
    nodes = measure(root)
    best = max(reversed(nodes), key=lambda n: (n.total, n.density))
    if not best.chars:
        return []
    if best.total == 0:
        return [root]
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path if n.chars)
    best = next((n for n in reversed(path) if n.tag in ("article", "main")), best)
    chosen: list[Node | str] = []
    on_path = set(map(id, path))
    stack: list[Node | str | None] = [root]
    while stack:
        node = stack.pop()
        if node is None:
            chosen.append(Node("hr", None))
        elif isinstance(node, str):
            chosen.append(node)
        elif node is best or id(node) not in on_path:
            mostly_links = node.link_chars * 2 > node.chars
            if node is best or node.chars and (node.density >= threshold or node.tag not in BLOCK) and not mostly_links:
                chosen.append(node)
        else:  # loose text of a node on the path ends where a block of the path starts or ends
            edge = [None] if node.tag in BLOCK else []
            stack += [*edge, *reversed(node.children), *edge]
    return chosen


def blocks_of(nodes: list[Node | str]) -> list[str]:
    """Text of subtrees and loose text by blocks: white space is one space, empty blocks go."""
    found, line = [], []

    def end() -> None:
        text = " ".join("".join(line).split())
        if text:
            found.append(text)
        line.clear()

    stack: list[Node | str | None] = list(reversed(nodes))
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            line.append(item)
        else:
            if item.tag in BLOCK:
                end()
                stack.append(None)
            stack += reversed(item.children)
    end()
    return found


def main_text(html: str | None) -> str:
    """Blocks of the main text in page order, one per line."""
    if not html:
        return ""
    found = blocks_of(article_nodes(without_furniture(parse(html))))
    return "\n".join(found or blocks_of(article_nodes(without_furniture(parse(html), by_name=False))))


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: its id, url, main text and the text's code points."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
