"""HTML pages: native expressions for titles, texts and links, and a parser for labelled fields, tables and lists."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NOISE = r"(?s)<(script|style|nav|footer|head)[^>]*>.*?</(script|style|nav|footer|head)>|<!--.*?-->"


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, "(?s)<title[^>]*>(.*?)</title>", 1))


def strip(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, _NOISE, " "), "<[^>]*>", " "), r"\s+", " "))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), 1)


class _Fields(HTMLParser):
    """Rows of tables, pairs of definition lists, headings and paragraphs, in the order of the page."""

    NOISE = frozenset("script style nav footer noscript head".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str, str]] = []
        self.text: list[str] = []
        self.cells: list[str] = []
        self.label, self.noise = "", 0

    def take(self) -> str:
        t = " ".join("".join(self.text).split())
        self.text = []
        return t

    def flush(self, kind: str = "text") -> None:
        if t := self.take():
            self.out.append((kind, "", t))

    def handle_starttag(self, tag, attrs):
        if tag in self.NOISE:
            self.noise += 1
        elif tag in ("td", "th", "dt", "dd"):
            self.take()
        elif tag == "tr":
            self.cells = []
        elif tag in ("p", "h1", "h2", "h3", "h4", "li", "div", "br", "article", "table", "dl"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in self.NOISE:
            self.noise = max(0, self.noise - 1)
        elif tag in ("td", "th"):
            if t := self.take():
                self.cells.append(t)
        elif tag == "tr":
            if len(self.cells) == 2:
                self.out.append(("field", self.cells[0].rstrip(":"), self.cells[1]))
            elif self.cells:
                self.out.append(("row", "", " | ".join(self.cells)))
            self.cells = []
        elif tag == "dt":
            self.label = self.take()
        elif tag == "dd":
            self.out.append(("field", self.label.rstrip(":"), self.take()))
        elif tag in ("h1", "h2", "h3", "h4"):
            self.flush("heading")
        elif tag in ("p", "li", "div", "article"):
            self.flush()

    def handle_data(self, data):
        if not self.noise:
            self.text.append(data)


def parse(html: str | None) -> list[tuple[str, str, str]]:
    parser = _Fields()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.out


def fields(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, kind, label, value): what a page states, in its order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(k, i, *x) for k, h in zip(pdf[key], pdf[html], strict=True) for i, x in enumerate(parse(h))]
            yield pd.DataFrame(rows, columns=[key, "pos", "kind", "label", "value"])

    return pages.select(key, html).mapInPandas(run, f"{key} long, pos int, kind string, label string, value string")


# --- whole pages by rules: labelled fields in sections, tables, definition lists, else all of the text


@dataclass(frozen=True)
class Rules:
    """Selectors (tag, .class, [attribute="value"] or [attribute*="part"]) and patterns; the defaults are fixed values."""

    field: str = ".mets-field"
    label: str = ".mets-field-label"
    value: str = ".mets-field-body"
    section: str = ".content-block-sub-title"
    title_strip: tuple[str, ...] = (r"\s*\|.*$", r"\s*-\s*Bid Information.*$")
    least_lines: int = 3
    noise: tuple[str, ...] = ("script", "style", "noscript", "svg", "nav", '[aria-hidden="true"]', '[class*="cookie"]', '[id*="cookie"]', '[class*="dialog"]')
    cut_short: tuple[str, ...] = (r"\s*See more\s*$", r"\s*Read more\s*$", r"\s*Show more\s*$")


CUT_NOTE = " [truncated on portal page]"
NUMBERED_ITEM = re.compile(r"\s+(?=\d{1,2}\.\s+[A-Z])")


@dataclass
class Node:
    tag: str
    attributes: dict[str, str]
    children: list = field(default_factory=list)

    def walk(self) -> Iterator["Node"]:
        """Elements below, in the order of the page, without recursion."""
        held = [c for c in reversed(self.children) if isinstance(c, Node)]
        while held:
            node = held.pop()
            yield node
            held += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self, skip=lambda node: False) -> list[str]:
        out, held = [], list(reversed(self.children))
        while held:
            x = held.pop()
            if isinstance(x, str):
                out += [x.strip()] if x.strip() else []
            elif not skip(x):
                held += reversed(x.children)
        return out

    def text(self) -> str:
        return " ".join(" ".join(self.strings()).split())

    def fits(self, selector: str) -> bool:
        if selector.startswith("."):
            return selector[1:] in self.attributes.get("class", "").split()
        if m := re.fullmatch(r'\[([\w-]+)(\*?)="([^"]*)"\]', selector):
            own = self.attributes.get(m[1])
            return own is not None and (m[3] in own if m[2] else own == m[3])
        return self.tag == selector

    def first(self, selector: str) -> "Node | None":
        return next((n for n in self.walk() if n.fits(selector)), None)


class _Tree(HTMLParser):
    """The elements of a page; closing tags without their element are passed over."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
    ENDS = {"li": "li", "p": "p", "tr": "tr", "td": "td", "th": "td", "dt": "dd", "dd": "dt"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        top = self.open[-1].tag
        if len(self.open) > 1 and (top == tag or self.ENDS.get(tag) == top) and tag in self.ENDS:
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in self.VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.root


def page_title(root: Node, rules: Rules = Rules()) -> str:
    node = root.first("title")
    said = node.text() if node else ""
    for pattern in rules.title_strip:
        said = re.sub(pattern, "", said, flags=re.I)
    return said.strip(" -|")


def field_lines(root: Node, rules: Rules = Rules()) -> tuple[list[str], list[str]]:
    """Lines "label: value" under their sections, and the sections' titles. Values without a label stand together in one line
    under the name of their section; of nested fields the innermost count."""
    out: list[str] = []
    sections: list[str] = []
    loose: list[str] = []

    def close() -> None:
        if loose:
            out.append(f"{sections[-1] if sections else 'Info'}: " + " | ".join(loose))
            loose.clear()

    for node in root.walk():
        if node.fits(rules.section):
            close()
            sections.append(node.text())
            out.extend(["", f"## {sections[-1]}"])
        elif node.fits(rules.field) and node.first(rules.field) is None:
            label, value = (n.text() if (n := node.first(s)) else "" for s in (rules.label, rules.value))
            for mark in rules.cut_short:
                value = re.sub(mark, CUT_NOTE, value, flags=re.I)
            if value and label.rstrip(":"):
                close()
                out.append(f"{label.rstrip(':')}: " + NUMBERED_ITEM.sub("\n", value))
            elif value:
                loose.append(value)
    close()
    return out, sections


def table_lines(root: Node) -> list[str]:
    """Rows of tables: two filled cells as label and value, more between bars."""
    out = []
    for row in (r for t in root.walk() if t.tag == "table" for r in t.walk() if r.tag == "tr"):
        cells = [c.text() for c in row.walk() if c.tag in ("td", "th") and c.text()]
        if cells:
            out.append(f"{cells[0].rstrip(':')}: {cells[1]}" if len(cells) == 2 else " | ".join(cells))
    return out


def definition_lines(root: Node) -> list[str]:
    out = []
    for whole in (n for n in root.walk() if n.tag == "dl"):
        parts = [c for c in whole.children if isinstance(c, Node)]
        out += [f"{a.text().rstrip(':')}: {b.text()}" for a, b in zip(parts, parts[1:], strict=False) if (a.tag, b.tag) == ("dt", "dd")]
    return out


def read_page(html: str, rules: Rules = Rules()) -> dict:
    """One page (page, text, headings, tables) of an HTML file: its title, then what it states by rules; if fewer than
    least_lines of that have a colon, all of its text without noise."""
    root = tree(html)
    said, sections = field_lines(root, rules)
    stated = said + table_lines(root) + definition_lines(root)
    if sum(":" in x for x in stated) < rules.least_lines:
        noise = lambda n: any(n.fits(s) for s in rules.noise)
        body = "\n".join((root.first("body") or root).strings(noise))
    else:
        body = "\n".join(stated).strip()
    title_ = page_title(root, rules)
    return {"page": 1, "text": f"# {title_}\n\n{body}" if title_ else body, "headings": [h for h in [title_, *sections] if h], "tables": [], "is_empty": not body.strip()}
