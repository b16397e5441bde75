"""Main text of web pages by a minimum cut.

A page is cut to blocks of text at block-level tags. A linear classifier gives each block a cost of being called content and one of being called
boilerplate; these are the capacities to the two terminals. Neighbouring blocks, and blocks next to each other under one parent, are
joined by edges whose capacity is what it costs to label them differently: the less, the farther apart they are in the page's tree. The minimum cut is the cheapest
labelling; the blocks on the content side are the text, in page order.

The classifier is a logistic regression, fitted here on blocks of at most `sample_pages` pages (the pages with the least hash of their id), whose labels come from
the page's own semantic tags: blocks inside article or main against blocks of nav, header, footer, aside and form. Each example counts twice, with what tags and names
around it say among its features, and without, so the weights also serve pages that have neither.

Markup inside scripts, styles, comments, templates and the head is no text. Character references are decoded, white space inside a block
becomes one space, blocks are trimmed and joined by one space. Nothing else is dropped, and long pages are read to their end. A null or empty
html, or a page without content blocks, gives an empty text. Every row gives a row; repeated ids and extra columns don't matter. An
empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow.llm.shared import drop_path, only, written

SAMPLE_PAGES = 2000

# HTML's element categories.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td"
    " textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: No text comes from inside these.
SILENT_TAGS = frozenset("script style noscript template head title svg math iframe object canvas select textarea button datalist noframes".split())
RAW_TAGS = frozenset("script style noscript template title iframe textarea noframes xmp".split())
#: An open p ends where one of these begins.
ENDS_P = BLOCK_TAGS - {"br", "body", "html", "option", "title", "button"}
CONTENT_TAGS = frozenset("article main".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog".split())
#: Words in class, id and role that tell what an element is for.
BOILER_NAMES = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer form"
    " gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup"
    " promo promoted promotion related reply replies respond share sharing sidebar signup site-footer site-header skip social sponsor sponsored"
    " subscribe subscription tags toolbar topbar widget widgets banner complementary contentinfo alert".split()
)
CONTENT_NAMES = frozenset("article articlebody body-text content entry entry-content main maincontent post post-body post-content story text".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)", re.S)  # a quote without its partner is a character
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_RAW_END = {tag: re.compile(rf"</{tag}\s*(?:>|\Z)", re.I) for tag in RAW_TAGS}
_SPACE = re.compile(r"\s+")
_NAME_PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    parent: int
    tag: str
    in_content: bool
    in_boiler: bool
    named_boiler: bool
    named_content: bool
    linked: int = 0  # characters inside links
    apart: int = 0  # steps in the page's tree from the block before


def element_marks(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether names in class, id and role speak for boilerplate, and for content."""
    boiler = content = False
    if attributes:
        for m in _ATTR.finditer(attributes):
            name = m[1].lower()
            if name in ("class", "id", "role", "itemprop", "aria-label"):
                for word in (m[2] or m[3] or m[4] or "").lower().split():
                    parts = _NAME_PART.findall(word)
                    if word in BOILER_NAMES or any(p in BOILER_NAMES for p in parts):
                        boiler = True
                    elif word in CONTENT_NAMES or "".join(parts) in CONTENT_NAMES or any(p in CONTENT_NAMES for p in parts):
                        content = True
            elif name in ("hidden", "aria-hidden") and (m[2] or m[3] or m[4] or "").lower() != "false":
                boiler = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", m[0], re.I):
                boiler = True
        if re.search(r"(?:^|\s)hidden(?:\s|/|$)", _ATTR.sub(" ", attributes)):
            boiler = True
    return boiler, content


class _Open:
    """The open elements, and where those of each tag and the blocks are, so that no step looks through all of them."""

    def __init__(self):
        #: (tag, number, content tag above, boilerplate tag above, boilerplate name above, content name above, silent)
        self.stack: list[tuple] = [("", 0, False, False, False, False, False)]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.low = 1  # the least number of open elements since the last block of text

    def push(self, element: tuple) -> None:
        self.places[element[0]].append(len(self.stack))
        if element[0] in BLOCK_TAGS:
            self.blocks.append(len(self.stack))
        self.stack.append(element)

    def last(self, *tags: str) -> int:
        """Where the innermost element of these tags is; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def cut(self, k: int) -> None:
        """Close the elements from k on."""
        for tag, *_ in self.stack[k:]:
            if tag:
                self.places[tag].pop()
        del self.stack[k:]
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()
        self.low = min(self.low, k)

    def forget(self, k: int) -> None:
        """Close an inline element around open blocks: it stays in its place without a name."""
        tag, *rest = self.stack[k]
        self.places[tag].pop()
        self.stack[k] = ("", *rest)


#: What an opening tag ends if it is open, and what hides such an element from it.
_SAME = {"li": ("li",), "option": ("option",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}
_STOP = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table", "tbody", "thead", "tfoot")}


def parse_blocks(page: str) -> list[Block]:
    blocks: list[Block] = []
    open_, number = _Open(), 0
    pieces: list[str] = []
    links = depth_a = depth = 0

    def close() -> None:
        nonlocal links, depth
        if pieces:
            text = _SPACE.sub(" ", "".join(pieces)).strip()
            if text:
                at = open_.blocks[-1] if open_.blocks else len(open_.stack) - 1
                tag, _, in_c, in_b, nb, nc, _ = open_.stack[at]
                parent = open_.stack[open_.blocks[-2]][1] if len(open_.blocks) > 1 else 0
                low = min(open_.low, at + 1)
                blocks.append(Block(text, parent, tag, in_c, in_b, nb, nc, links, max(0, depth - low) + at + 1 - low))
                depth = open_.low = at + 1
            pieces.clear()
        links = 0

    def add(text: str) -> None:
        nonlocal links
        if text and not open_.stack[-1][6]:
            pieces.append(text)
            if depth_a:
                links += len(text)

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            add(html_lib.unescape(page[at:]))
            break
        add(html_lib.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:  # an end tag
            if tag == "a":
                depth_a = 0
            k = open_.last(tag)
            if tag == "p" and not k:
                close()
            if k:
                inside = bool(open_.blocks) and open_.blocks[-1] >= k
                if tag in BLOCK_TAGS:
                    close()
                # An inline element's end does not end the blocks inside it.
                if tag in BLOCK_TAGS or not inside:
                    open_.cut(k)
                else:
                    open_.forget(k)
            continue
        if tag in BLOCK_TAGS:
            close()
        if tag in ENDS_P and (k := open_.last("p")):
            open_.cut(k)
        if tag in _SAME and (k := open_.last(*_SAME[tag])) > open_.last(*_STOP.get(tag, ())):
            open_.cut(k)
        if tag in VOID_TAGS:
            continue
        attributes = m[3] or ""
        if tag in RAW_TAGS:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else size
            continue
        if attributes.endswith("/") and tag in ("svg", "path", "g"):
            continue
        number += 1
        top = open_.stack[-1]
        named_boiler, named_content = element_marks(tag, attributes)
        if tag in CONTENT_TAGS:
            open_.push((tag, number, True, False, named_boiler and top[4], True, top[6]))
        else:
            header = tag == "header" and not top[2]
            open_.push((tag, number, top[2], top[3] or tag in BOILER_TAGS or header, top[4] or named_boiler, top[5] or named_content, top[6] or tag in SILENT_TAGS))
        if tag == "a":
            depth_a = 1
    close()
    return blocks


N_FEATURES, N_TEXT = 13, 9


def features(blocks: list[Block]) -> np.ndarray:
    """Of each block: size, links, sentences, its kind of tag, its neighbours' size; then what the tags and names around it say."""
    rows = np.zeros((len(blocks), N_FEATURES))
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        rows[i, 0] = math.log1p(words)
        rows[i, 1] = min(1.0, b.linked / max(1, len(b.text)))
        rows[i, 2] = min(5, sum(map(b.text.count, ".!?"))) / 5
        rows[i, 3] = b.tag in ("p", "pre", "blockquote")
        rows[i, 4] = b.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        rows[i, 5] = b.tag in ("li", "td", "th", "dd", "dt")
        rows[i, 6] = "©" in b.text or "|" in b.text
    if len(blocks) > 1:
        near = np.zeros(len(blocks))
        near[1:] += rows[:-1, 0] / 2
        near[:-1] += rows[1:, 0] / 2
        rows[:, 7] = near
    rows[:, 8] = 1
    for i, b in enumerate(blocks):
        rows[i, N_TEXT:] = b.in_content, b.in_boiler, b.named_content, b.named_boiler
    return rows


@dataclass(frozen=True)
class Classifier:
    weights: tuple[float, ...]


#: Where there are no pages with semantic tags to learn from.
DEFAULT = Classifier((0.9, -3.0, 2.0, 0.8, 0.6, -0.8, -1.0, 0.2, -2.0, 5.0, -8.0, 2.0, -8.0))


def _gradient(x: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray) -> np.ndarray:
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (n * (p - y))


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, steps: int = 300, driver_rows: int = 200_000) -> Classifier:
    """Logistic regression on blocks whose label the page's own tags give. sample_pages bounds what it learns from. Up to driver_rows different examples are
    summed on the driver; of more, Spark adds up each step's sums over all of them."""
    least = pages.select("page_id").orderBy(F.xxhash64("page_id")).limit(sample_pages)
    chosen = only(pages, "page_id", "html").where("html IS NOT NULL").join(F.broadcast(least), "page_id", "left_semi")

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = [np.zeros((0, N_FEATURES))], []
            for page in batch.column("html").to_pylist():
                blocks = parse_blocks(page)
                rows = features(blocks)
                known = [i for i, b in enumerate(blocks) if b.in_content or b.in_boiler or b.named_boiler]
                alone = rows[known].copy()
                alone[:, N_TEXT:] = 0
                x += [rows[known], alone]
                y += 2 * [float(blocks[i].in_content and not blocks[i].named_boiler and not blocks[i].in_boiler) for i in known]
            flat = np.concatenate(x)
            yield pa.RecordBatch.from_arrays([pa.array(flat.tolist(), pa.list_(pa.float64())), pa.array(y, pa.float64())], names=["x", "y"])

    # Sums over equal examples keep what comes to the driver small.
    rounded = chosen.mapInArrow(examples, "x array<double>, y double").select(F.transform("x", lambda v: F.round(v, 1)).alias("x"), "y")
    counted, path = written(rounded.groupBy("x", "y").count(), "examples")
    of_label = {r["y"]: r["n"] for r in counted.groupBy("y").agg(F.sum("count").alias("n")).collect()}
    if len(of_label) < 2:
        drop_path(pages.sparkSession, path)
        return DEFAULT

    def arrays(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y = np.array(table.column("x").to_pylist()).reshape(-1, N_FEATURES), table.column("y").to_numpy()
        return x, y, table.column("count").to_numpy() / (2.0 * np.where(y == 1, of_label[1.0], of_label[0.0]))

    def added(part) -> np.ndarray:
        """The sum of part(x, y, n) over all examples, by Spark."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum((part(*arrays(b)) for b in batches), np.zeros(N_FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(range(N_FEATURES), pa.int32()), pa.array(total)], names=["i", "v"])

        sums = {r["i"]: r["v"] for r in counted.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        return np.array([sums[i] for i in range(N_FEATURES)])

    if counted.count() <= driver_rows:
        x, y, n = arrays(counted.orderBy("x", "y").toArrow())
        total = lambda part: part(x, y, n)
    else:
        total = added
    w, size = np.array(DEFAULT.weights), total(lambda x, y, n: np.abs(x).T @ n)
    for _ in range(steps):  # Newton's steps would do; gradient steps with a ridge are as good for nine weights
        w -= 2.0 * (total(lambda x, y, n, w=w: _gradient(x, y, n, w)) + 0.002 * w) / (size + 0.1)
    drop_path(pages.sparkSession, path)
    return Classifier(tuple(round(float(v), 4) for v in w))


#: Bounds of a block's cost. What edges cost: NEIGHBOUR is divided by the steps between blocks that follow each other, SIBLING joins blocks under one parent.
CAP, NEIGHBOUR, SIBLING = 14.0, 1.8, 0.8


def max_flow_labels(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut. edges are undirected. Dinic's algorithm."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    adjacent: list[list[int]] = [[] for _ in range(n + 2)]

    def connect(u: int, v: int, there: float, back: float) -> None:
        adjacent[u].append(len(to))
        to.append(v)
        cap.append(there)
        adjacent[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i in range(n):
        through = min(source[i], sink[i])  # flows straight through the node
        if source[i] > through:
            connect(s, i, source[i] - through, 0.0)
        if sink[i] > through:
            connect(i, t, sink[i] - through, 0.0)
    for u, v, c in edges:
        connect(u, v, c, c)
    eps = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = [s]
        for u in queue:
            for e in adjacent[u]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        place = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if cap[e] <= eps)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            moved = False
            while place[u] < len(adjacent[u]):
                e = adjacent[u][place[u]]
                if cap[e] > eps and level[to[e]] == level[u] + 1:
                    path.append(e)
                    u = to[e]
                    moved = True
                    break
                place[u] += 1
            if not moved:
                if not path:
                    break
                level[u] = -1
                u = to[path.pop() ^ 1]


def content_blocks(blocks: list[Block], classifier: Classifier) -> list[bool]:
    """Which blocks are content, by the minimum cut."""
    score = np.clip(features(blocks) @ np.array(classifier.weights), -CAP, CAP).tolist()
    edges = [(i - 1, i, NEIGHBOUR / (1 + blocks[i].apart)) for i in range(1, len(blocks))]
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if (j := last.get(b.parent)) is not None:
            edges.append((j, i, SIBLING))
        last[b.parent] = i
    return max_flow_labels([max(0.0, x) for x in score], [max(0.0, -x) for x in score], edges)


def main_text(page: str, classifier: Classifier) -> str:
    blocks = parse_blocks(page)
    return " ".join(b.text for b, c in zip(blocks, content_blocks(blocks, classifier), strict=True) if c) if blocks else ""


def extract(pages: DataFrame, classifier: Classifier) -> DataFrame:
    """(page_id, url, text) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = [main_text(p or "", classifier) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return only(pages, "page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string")
