"""HTML extraction by union-free regular-expression wrappers.

Every page becomes a stream of lines (the texts between two breaks of blocks), each typed by the path of tags around it
(with what a tag's class or id says of its part). Streams of the same host are aligned one after another into the host's
wrapper, a union-free regular expression:

* adjacent equal runs of lines become a repeated group ``(...)+``;
* a line that one side lacks becomes an optional group ``(...)?``; options of which one would stand twice between the same
  two obligatory lines become a repeated group of options ``((a)?(b)?)+``, so a wrapper never outgrows its host's paths;
* lines that differ become a slot ``#``; a line equal on all pages stays a constant of the template. A repeated line has as
  constants what each page has among its turns.

Streams of any length are aligned in one way, by anchors: lines that are the only ones of their kind on both sides, then
lines that are the k-th of their kind between two anchors, each time the longest run of pairs in the order of both sides.

Paths say beforehand where content can be: not in a menu, header, footer, sidebar, notice, advert, form, reader comments or
the like, and on pages with an article (or main) part of their own only there. Of these lines the wrapper's constants are
template, inside an article as elsewhere, if the pages behind their node are ``CONSTANT_PAGES`` at least that differ in the
rest of their main texts: copies count as one page, and a node of fewer pages has no template. Extraction walks each page
once by its host's table of paths.

Pages are folded to their skeletons (repeats folded, texts replaced by a hash) before they are shuffled, so a host with a
third of all pages is a few rows a task; wrappers merge in rounds of ever fewer salts a host (``SALTS``), so no task has
more than a small part of a hot host's rows.

Defined results: null and empty html give empty text; unclosed and truncated markup is read as far as it goes; a page
whose host has no wrapper, or whose tokens its wrapper lacks, goes by the rules of paths alone; repeated rows have equal
results and count once in the wrapper; very long and very deep pages are read whole, in time proportional to their length;
white space is what Unicode calls so; columns named like the results are replaced, all others (whatever their names) pass.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.host_reputation import url_host
from lexloom.llm.store import materialize, quoted

CONSTANT_PAGES = 3
#: Parts of a host's wrapper that are left after each round of merging.
SALTS = (1024, 32, 1)
#: Wrappers of up to this size in all are broadcast to the pages; beyond it pages meet them in a shuffle by host.
BROADCAST_BYTES = 32 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|select|object|title)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements that end inside no line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose texts are no part of an article; a header is, where it stands inside of one.
OUTSIDE = frozenset("nav header footer aside form button menu dialog head fieldset".split())
#: Words of class, id and role that name a part outside of the article.
OUTSIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar side rail aside widget footer header masthead topbar toolbar comment comments reply replies respond disqus share sharing social related recommended recommendations newsletter subscribe subscription signup login search form pagination pager copyright skip complementary contentinfo".split()
)
#: Words that say nothing of a part beside one of those: "comment-list" is outside, "side-by-side" isn't.
NEUTRAL_NAMES = frozenset(
    "js wp id main page site global primary secondary top bottom left right upper lower inner outer box area section wrap wrapper container block panel bar bars list lists item items group holder zone slot unit row col column content link links button buttons icon icons text thread user users reader readers post posts article articles entry story stories".split()
)
HEADER_NAMES = frozenset(["header", "masthead", "banner"])
ARTICLE = frozenset(["article", "main"])
ARTICLE_NAMES = frozenset("article main post entry story".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def tokens(html: str | None) -> Iterator[tuple[str, str, str]]:
    """(kind, name, part): kind "<", "/" or "#" (then name is the raw text); part: see ``part_of``."""
    at, html = 0, html or ""
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            yield "#", html[at : m.start()], ""
        at = m.end()
        if m[3]:
            name = m[3].lower()
            yield ("/", name, "") if m[2] else ("<", name, part_of(name, m[4]))
    if at < len(html):
        yield "#", html[at:], ""


@lru_cache(1 << 14)
def part_of(name: str, attributes: str) -> str:
    """"x" outside, "h" a header (outside, but not inside an article), "m" article, or ""; inline elements have no part."""
    if name in INLINE or name in ("html", "body"):
        return ""
    said = "h" if name == "header" else "x" if name in OUTSIDE else ""
    own = False
    if "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            for token in (m[2] or m[3] or m[4] or "").split():
                words = {w.lower() for w in _WORD.findall(token) if len(w) > 1}
                found = words & OUTSIDE_NAMES
                own |= bool(words & ARTICLE_NAMES) and not found
                if found and words <= OUTSIDE_NAMES | NEUTRAL_NAMES:
                    if not found <= HEADER_NAMES:
                        said = "x"
                    elif not words & ARTICLE_NAMES:
                        said = said or "h"
    if name in ARTICLE:
        return "x" if said and not own else "m"
    return said


#: An opening tag of the first kind ends an open element of the second.
_ENDS = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Closing tags that end nothing beyond the part (article or outside) they stand in.
_WITHIN = frozenset("p li td tr".split())


@lru_cache(1 << 16)
def _step(path: str, segment: str) -> str:
    """The path one element further: a digest, so that a path is as short at any depth."""
    return hashlib.blake2b(f"{path}/{segment}".encode("utf-8", "surrogatepass"), digest_size=6).hexdigest()


def walk(html: str | None) -> Iterator[tuple[str, str, bool, bool]]:
    """(path, text, inside an article, outside) of each text and, with text None, of each break between blocks.

    Elements are nested well: a closing tag ends what stands open in its element, one without its element is passed over.
    Each tag costs the same at any depth; a path stands for the names of the open blocks and their parts.
    """
    names: list[str] = []
    paths, articles, outsides = [""], [False], [False]
    open_at: dict[str, list[int]] = {}
    walls: list[int] = []

    def close(to: int) -> None:
        while len(names) > to:
            open_at[names.pop()].pop()
            paths.pop(), articles.pop(), outsides.pop()
        while walls and walls[-1] >= to:
            walls.pop()

    for kind, name, part in tokens(html):
        if kind == "#":
            yield paths[-1], name, articles[-1], outsides[-1]
            continue
        if name in INLINE:
            continue
        yield paths[-1], None, articles[-1], outsides[-1]
        if kind == "<":
            if name in VOID:
                continue
            if ends := _ENDS.get(name):
                i = len(names) - 1
                if i >= 0 and names[i] == "p" and "p" not in ends:
                    i -= 1
                if i >= 0 and names[i] in ends:
                    close(i)
            if part == "h":
                part = "" if articles[-1] else "x"
            if part:
                walls.append(len(names))
            open_at.setdefault(name, []).append(len(names))
            names.append(name)
            paths.append(_step(paths[-1], f"{part}:{name}"))
            articles.append(articles[-1] or part == "m")
            outsides.append(outsides[-1] or part == "x")
        elif at := open_at.get(name):
            if name not in _WITHIN or not walls or at[-1] >= walls[-1]:
                close(at[-1])


def lines(html: str | None) -> Iterator[list[tuple[str, str, bool]]]:
    """The texts between two breaks: path, raw text, and whether it is content by the rules of paths."""
    steps = list(walk(html))
    article = any(t is not None and m and not x and not t.isspace() for _, t, m, x in steps)
    line: list[tuple[str, str, bool]] = []
    for path, text, inside, outside in steps:
        if text is not None:
            line.append((path, text, not outside and (inside or not article)))
        elif line:
            yield line
            line = []
    if line:
        yield line


def content_of(line: list[tuple[str, str, bool]]) -> tuple[str | None, str]:
    """The content of a line as one text, at the path where it begins; the path is None if the line has none."""
    own = [(p, t) for p, t, content in line if content]
    return next((p for p, t in own if not t.isspace()), None), "".join(entities.unescape(t) for _, t in own)


def mark(text: str) -> str:
    """A short text itself, a hash of a longer one (with a line break, which no text has here), white space set right."""
    text = " ".join(text.split())
    return text if len(text) <= 40 else "\n" + hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


# The wrapper: a list of nodes ["t", path], ["#", path, constant, seen], ["+", nodes], ["?", nodes]. A constant is a
# text that each page behind the node has there, a list of several such texts (of a repeated node), or None for a slot; seen
# holds the marks of the different pages behind the node, or just CONSTANT_PAGES where there are so many.


def _same(a: list, b: list) -> bool:
    if a[0] != b[0]:
        return False
    if a[0] in "t#":
        return a[1] == b[1]
    return len(a[1]) == len(b[1]) and all(_same(x, y) for x, y in zip(a[1], b[1], strict=True))


def _key(node: list) -> str:
    return f"{node[0]}{node[1]}" if node[0] in "t#" else f"{node[0]}({' '.join(map(_key, node[1]))})"


def fold(nodes: list, texts: Callable = set.intersection) -> list:
    """Adjacent equal runs (of up to 6 nodes) become one repeated group; texts joins theirs: set.union within a page."""
    for size in range(1, 7):
        out: list = []
        i = 0
        while i < len(nodes):
            run = nodes[i : i + size]
            j = i + size
            group = run[0] if size == 1 and run[0][0] == "+" else None
            turns = [group[1] if group else run]
            while len(run) == size and j + size <= len(nodes) and all(_same(a, b) for a, b in zip(run, nodes[j : j + size], strict=True)):
                turns.append(nodes[j][1] if group else nodes[j : j + size])
                j += size
            if len(turns) > 1:
                out.append(["+", [merge_nodes(x, texts) for x in zip(*turns, strict=True)]])
                i = j
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def merge_nodes(nodes: Sequence[list], texts: Callable) -> list:
    first = nodes[0]
    if first[0] == "t":
        return first
    if first[0] == "#":
        found = sorted(texts(*(set() if x[2] is None else {x[2]} if isinstance(x[2], str) else set(x[2]) for x in nodes)))
        return ["#", first[1], found if len(found) > 1 else found[0] if found else None, reduce(_seen, (x[3] for x in nodes))]
    return [first[0], [merge_nodes(x, texts) for x in zip(*(x[1] for x in nodes), strict=True)]]


def merge_node(a: list, b: list) -> list:
    return merge_nodes((a, b), set.intersection)


def _seen(a: list | int, b: list | int) -> list | int:
    both = CONSTANT_PAGES if CONSTANT_PAGES in (a, b) else sorted({*a, *b})
    return both if both == CONSTANT_PAGES or len(both) < CONSTANT_PAGES else CONSTANT_PAGES


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (ascending by the first) that ascends by the second, too."""
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        before[n] = last[k - 1] if k else -1
        ends[k : k + 1] = [j]
        last[k : k + 1] = [n]
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def matched(ka: list, kb: list) -> list[tuple[int, int]]:
    """Places of equal keys in the order of both lists: first those that each list has once, then, between two of them,
    the k-th of a key in one list with the k-th in the other."""
    ca, cb = Counter(ka), Counter(kb)
    once = {k: j for j, k in enumerate(kb) if cb[k] == 1 and ca[k] == 1}
    anchors = _rising([(i, once[k]) for i, k in enumerate(ka) if k in once])
    out, i0, j0 = [], 0, 0
    for i1, j1 in [*anchors, (len(ka), len(kb))]:
        turn: Counter = Counter()
        places = {}
        for j in range(j0, j1):
            places[kb[j], turn[kb[j]]] = j
            turn[kb[j]] += 1
        turn.clear()
        pairs = []
        for i in range(i0, i1):
            if (j := places.get((ka[i], turn[ka[i]]))) is not None:
                pairs.append((i, j))
            turn[ka[i]] += 1
        out += _rising(pairs)
        if i1 < len(ka):
            out.append((i1, j1))
        i0, j0 = i1 + 1, j1 + 1
    return out


def align(a: list, b: list, texts: Callable = set.intersection) -> list:
    """A union-free expression that both match: equal nodes in the order of both sides, what lies between as options."""
    if len(a) == len(b) and all(_same(x, y) for x, y in zip(a, b, strict=True)):
        return [merge_node(x, y) for x, y in zip(a, b, strict=True)]
    out, i0, j0 = [], 0, 0
    for i, j in [*matched([_key(_bare(x)) for x in a], [_key(_bare(x)) for x in b]), (len(a), len(b))]:
        out += [x if x[0] == "?" or _any_order(x) else ["?", [x]] for x in a[i0:i] + b[j0:j]]
        if i < len(a):
            out.append(_merged(a[i], b[j]))
        i0, j0 = i + 1, j + 1
    return _gaps(out, texts)


def _any_order(node: list) -> bool:
    """Whether a node is a repeated group of options."""
    return node[0] == "+" and all(x[0] == "?" for x in node[1])


def _gaps(nodes: list, texts: Callable) -> list:
    """nodes with each run of options in which a key stands twice as one repeated group of options, a key once."""
    out: list = []
    gap: list = []

    def flush() -> None:
        flat = [y for x in gap for y in (x[1] if _any_order(x) else [x])]
        own: dict[str, list] = {}
        for x in flat:
            key = _key(_bare(x))
            own[key] = _merged(own[key], x, texts) if key in own else x
        if len(own) < len(flat) or any(map(_any_order, gap)):
            out.append(["+", list(own.values())])
        else:
            out.extend(gap)
        gap.clear()

    for x in nodes:
        if x[0] == "?" or _any_order(x):
            gap.append(x)
        else:
            flush()
            out.append(x)
    flush()
    return out


def _open(node: list) -> tuple[list, set[str]]:
    """What a node looks like to the alignment (a group of one is its own single turn, an option its content), and the marks
    around it."""
    marks = set()
    while node[0] in "+?" and len(node[1]) == 1:
        marks.add(node[0])
        node = node[1][0]
    return node, marks


def _bare(node: list) -> list:
    return _open(node)[0]


def _merged(a: list, b: list, texts: Callable = set.intersection) -> list:
    if _same(a, b):
        return merge_nodes((a, b), texts)
    (x, p), (y, q) = _open(a), _open(b)
    core = merge_nodes((x, y), texts) if _same(x, y) else x
    if "+" in p | q and core[0] != "+":
        core = ["+", [core]]
    return ["?", [core]] if "?" in p | q else core


def skeleton(html: str | None) -> list:
    """A page's folded stream: its lines, each typed by its path; the path holds the tags around it."""
    runs: list[tuple[str, list[str]]] = []
    own = []
    for line in lines(html):
        path, text = content_of(line)
        found = [] if path is None else [(path, mark(text))]
        own += found
        found += [(p, mark(entities.unescape(t))) for p, t, content in line if not content and not t.isspace()]
        for path, text in found:
            if not runs or runs[-1][0] != path:
                runs.append((path, []))
            runs[-1][1].append(text)
    seen = [hashlib.blake2b("\t".join(t for _, t in own).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()]
    nodes = []
    for path, texts in runs:
        node = merge_nodes([["#", path, t, seen] for t in sorted(set(texts))], set.union)
        nodes.append(node if len(texts) == 1 else ["+", [node]])
    return fold(nodes, set.union)


def slots(nodes: list) -> Iterator[tuple[str, str | list | None, list | int]]:
    for node in nodes:
        if node[0] == "#":
            yield node[1], node[2], node[3]
        elif node[0] in "+?":
            yield from slots(node[1])


class Wrapper:
    """A host's expression with, for each path, its pages, content pages and texts (a constant, or None for a slot)."""

    def __init__(self, nodes: list | None = None, pages: int = 0):
        self.nodes, self.pages = nodes, pages

    def add(self, nodes: list, pages: int) -> None:
        if self.nodes is None:
            self.nodes = nodes
        else:
            self.nodes = fold(align(self.nodes, nodes))
        self.pages += pages

    def table(self) -> dict[str, set]:
        """path -> constants of the template"""
        found: dict[str, set] = {}
        for path, constant, seen in slots(self.nodes or []):
            if constant is not None and seen == CONSTANT_PAGES:
                found.setdefault(path, set()).update([constant] if isinstance(constant, str) else constant)
        return found


def _encode(nodes: list) -> str:
    import json

    return json.dumps(nodes, ensure_ascii=False, separators=(",", ":"))


def _settled(nodes: list) -> list:
    """Without the constants that are behind too few pages to be template."""
    out = []
    for x in nodes:
        if x[0] == "#":
            out.append(x if x[3] == CONSTANT_PAGES else ["#", x[1], None, []])
        else:
            out.append(x if x[0] == "t" else [x[0], _settled(x[1])])
    return out


def _merge_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    import json

    whole = Wrapper()
    for nodes, pages in sorted(zip(pdf["nodes"], pdf["pages"], strict=True)):
        whole.add(json.loads(nodes), int(pages))
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "salt": [0], "nodes": [_encode(whole.nodes or [])], "pages": [whole.pages]})


def _merge_last(pdf: pd.DataFrame) -> pd.DataFrame:
    import json

    whole = _merge_rows(pdf)
    return whole.assign(nodes=[_encode(_settled(json.loads(x))) for x in whole["nodes"]])


def infer(pages: DataFrame, salts: Sequence[int] = SALTS) -> DataFrame:
    """(host, nodes, pages): the wrapper of each host as JSON, from all its pages."""
    named = pages.select(url_host(F.col("url")).alias("host"), "html").where("html is not null and html != ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(host, Wrapper()).add(skeleton(page), 1)
            if len(held) >= 5000:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    def rows(held: dict[str, Wrapper]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([_encode(w.nodes) for w in held.values()]), pa.array([w.pages for w in held.values()], pa.int64())], names=["host", "nodes", "pages"])

    parts = named.mapInArrow(run, "host string, nodes string, pages long")
    for k, n in enumerate(salts):
        salted = parts.withColumn("salt", F.pmod(F.xxhash64("nodes"), F.lit(n)).cast("int"))
        parts = salted.groupBy("host", "salt").applyInPandas(_merge_last if k == len(salts) - 1 else _merge_rows, "host string, salt int, nodes string, pages long")
    return parts.select("host", "nodes", "pages")


def read(html: str | None, table: dict[str, set] | None) -> str:
    """The main text of a page by its own parts and its host's template."""
    out = []
    for line in lines(html):
        path, text = content_of(line)
        if path is not None and not (table and (constants := table.get(path)) and mark(text) in constants):
            out.append(text)
    return " ".join(" ".join(out).split())


def extract(pages: DataFrame, salts: Sequence[int] = SALTS) -> DataFrame:
    """pages with text and n_chars."""
    import json

    wrappers = materialize(infer(pages, salts)).select(F.col("host").alias("_host"), F.col("nodes").alias("_nodes"))
    if (wrappers.agg(F.sum(F.octet_length("_nodes") + 200)).first()[0] or 0) <= BROADCAST_BYTES:
        wrappers = F.broadcast(wrappers)
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    rows = pages.select(F.struct(*[quoted(c) for c in kept]).alias("_row"), F.col("html").alias("_html"), url_host(F.col("url")).alias("_host"))
    met = rows.join(wrappers, "_host", "left").select("_row", "_html", "_nodes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for html, nodes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if nodes is not None and nodes not in tables:
                    if len(tables) > 200:
                        tables.clear()
                    tables[nodes] = Wrapper(json.loads(nodes)).table()
                texts.append(read(html, tables.get(nodes)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["_row", "_text", "_n"])

    read_rows = met.mapInArrow(run, T.StructType([met.schema["_row"], T.StructField("_text", T.StringType()), T.StructField("_n", T.LongType())]))
    return read_rows.select(*[quoted(c, "_row") for c in kept], F.col("_text").alias("text"), F.col("_n").alias("n_chars"))
