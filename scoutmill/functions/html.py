"""Stored pages to text, and revision lists out of history pages."""

from __future__ import annotations

import html as html_std
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements without text, elements without an end tag.
DROPPED = {"script", "style", "noscript", "iframe", "svg", "canvas"}
VOID = {
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image",
    "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source",
    "spacer", "track", "wbr",
}
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}
WIKI_ROOT = "https://en.wikipedia.org"


@F.pandas_udf(T.StringType())
def unescape_entities(text: pd.Series) -> pd.Series:
    """Named and numeric character references, by the standard table."""
    return text.map(html_std.unescape, na_action="ignore")


def html_basic_text(col: Column, unescape=unescape_entities) -> Column:
    """Tags out, breaks kept, white space collapsed: regular expressions only."""
    text = F.regexp_replace(F.coalesce(col, F.lit("")), r"(?is)<\s*(script|style|noscript|iframe)[^>]*>.*?<\s*/\s*\1\s*>", " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"(?i)</p>", "\n\n")
    text = unescape(F.regexp_replace(text, r"<[^>]+>", " "))
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f\x0B]+", " "), r"^\s+|\s+$", "")


def unescape_common(col: Column) -> Column:
    """The five XML entities and the no-break space, as built-in expressions."""
    for name, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]:
        col = F.replace(col, F.lit(name), F.lit(char))
    return col


def _squeeze(text: str) -> str:
    import re

    return re.sub(r"[ \t\r\f\v]+", " ", text).strip()


class _Markdown(HTMLParser):
    """Collects rendered text per open element; an element renders when it closes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict, list[str]]] = [("", {}, [])]
        self.body: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self._emit("\n")
        elif tag not in VOID:
            self.open.append((tag, dict(attrs), []))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(name == tag for name, _, _ in self.open[1:]):
            while self._close() != tag:
                pass

    def handle_data(self, data):
        self._emit(_squeeze(html_std.unescape(data)) + " ", text=True)

    def handle_comment(self, data):
        self.handle_data(data)

    def _emit(self, piece: str, item: bool = False, text: bool = False):
        # A list shows its items only.
        if self.open[-1][0] not in ("ul", "ol") or item:
            self.open[-1][2].append(piece)

    def _close(self) -> str:
        tag, attrs, pieces = self.open.pop()
        inside = "".join(pieces)
        if tag in DROPPED:
            return tag
        if tag == "body" and self.body is None:
            self.body = pieces
        flat = _squeeze(inside)
        if tag in HEADINGS:
            out = f"{'#' * HEADINGS[tag]} {flat}\n\n" if flat else ""
        elif tag == "p":
            out = f"{flat}\n\n" if flat else ""
        elif tag in ("ul", "ol"):
            out = inside + "\n"
        elif tag == "li":
            out = f"- {flat}\n" if flat else ""
        elif tag == "a":
            href = (attrs.get("href") or "").strip()
            out = f"[{flat}]({href})" if flat and href else flat
        elif tag in ("strong", "b"):
            out = f"**{flat}**" if flat else ""
        elif tag in ("em", "i"):
            out = f"*{flat}*" if flat else ""
        else:
            out = inside
        self._emit(out, item=tag == "li")
        return tag

    def text(self) -> str:
        import re

        self.close()
        while len(self.open) > 1:
            self._close()
        pieces = self.body if self.body is not None else self.open[0][2]
        return re.sub(r"\n{3,}", "\n\n", "".join(pieces)).strip()


def markdown_of(page: str | None) -> str:
    if not page:
        return ""
    parser = _Markdown()
    parser.feed(page)
    return parser.text()


@F.pandas_udf(T.StringType())
def html_to_markdown(page: pd.Series) -> pd.Series:
    """Headings, paragraphs, lists, links and emphasis as markdown."""
    return page.map(markdown_of)


REVISION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("href", "timestamp_text", "editor", "comment", "size", "byte_change")]
    + [T.StructField("tags", T.ArrayType(T.StringType()))]
)


class _History(HTMLParser):
    """Direct list items of the revision lists of a history page: contribution lists first, then the page history, then special lists.

    ``loose`` takes list items that are marked themselves, for pages without any such list.
    """

    def __init__(self, loose: bool = False):
        super().__init__(convert_charrefs=True)
        self.loose, self.lists = loose, 0
        self.stack: list[tuple[str, dict]] = []
        self.items: list[dict] = []
        self.item: dict | None = None
        self.item_depth = 0
        self.capture: list[tuple[int, list[str], str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        attrs = {k: v or "" for k, v in attrs}
        classes = attrs.get("class", "").split()
        parent = self.stack[-1] if self.stack else ("", {})
        self.stack.append((tag, attrs))
        self.lists += tag == "ul" and self._rank(attrs) is not None
        if tag == "li" and self.item is None:
            rank = (0 if re.search("mw-tag|mw-contribution", attrs.get("class", "")) else None) if self.loose else self._rank(parent[1]) if parent[0] == "ul" else None
            if rank is not None:
                self.item, self.item_depth = {"tags": [], "rank": rank}, len(self.stack)
                return
        if self.item is None:
            return
        for field in self._fields(tag, attrs, classes):
            if field in ("tags",) or field not in self.item:
                if field == "date":
                    self.item["date_href"] = attrs.get("href", "")
                if field == "oldid_link":
                    self.item["oldid_href"] = attrs.get("href", "")
                if field != "tags":
                    self.item[field] = ""
                self.capture.append((len(self.stack), [], field))

    @staticmethod
    def _rank(attrs) -> int | None:
        classes = attrs.get("class", "").split()
        return 0 if "mw-contributions-list" in classes else 1 if attrs.get("id") == "pagehistory" else 2 if "special" in classes else None

    @staticmethod
    def _fields(tag, attrs, classes):
        if tag == "a":
            if "mw-changeslist-date" in classes:
                yield "date"
            if "oldid=" in attrs.get("href", ""):
                yield "oldid_link"
            if "mw-userlink" in classes:
                yield "user"
            if "mw-tag-markers" in classes:
                yield "tags"
        elif tag == "bdi":
            yield "bdi"
        elif tag == "span":
            if "comment" in classes:
                yield "comment"
            if "history-size" in classes:
                yield "size"
            if any("mw-plusminus" in c for c in classes):
                yield "byte_change"

    def handle_data(self, data):
        if data.strip():
            for _, parts, _ in self.capture:
                parts.append(data.strip())

    def handle_endtag(self, tag):
        if not any(name == tag for name, _ in self.stack):
            return
        while self.stack:
            name, _ = self.stack[-1]
            depth = len(self.stack)
            for frame in [c for c in self.capture if c[0] == depth]:
                self.capture.remove(frame)
                value = "".join(frame[1])
                if frame[2] == "tags":
                    self.item["tags"].append(value)
                else:
                    self.item[frame[2]] = value
            if self.item is not None and depth == self.item_depth:
                self.items.append(self.item)
                self.item = None
            self.stack.pop()
            if name == tag:
                break

    def rows(self) -> list[dict]:
        self.close()
        if self.stack:
            self.handle_endtag(self.stack[0][0])
        out = []
        for it in sorted(self.items, key=lambda it: it["rank"]):
            dated = "date_href" in it
            href = it.get("date_href") if dated else it.get("oldid_href")
            if href is None:
                continue
            out.append({
                "href": href,
                "timestamp_text": (it.get("date") if dated else it.get("oldid_link")) or None,
                "editor": it["user"] if "user" in it else it.get("bdi"),
                "comment": it.get("comment"),
                "size": it.get("size"),
                "byte_change": it.get("byte_change"),
                "tags": it["tags"] or None,
            })
        return out


@F.pandas_udf(T.ArrayType(REVISION))
def revision_items(page: pd.Series) -> pd.Series:
    """Revision list items of history pages, one array per page."""

    def parse(text):
        if not text:
            return []
        parser = _History()
        parser.feed(text)
        rows = parser.rows()
        if not parser.lists:
            parser = _History(loose=True)
            parser.feed(text)
            rows = parser.rows()
        return rows

    return page.map(parse)
