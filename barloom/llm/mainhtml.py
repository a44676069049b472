"""Main text of HTML pages by a minimum cut.

A page is read into blocks: stretches of text between block-level tags, with the tags and
attributes around them. A logistic regression, fitted on a few labelled pages of our own, gives
each block its odds of being content; the costs of labelling it either way become the
capacities of its edges to the two terminals. Smoothness edges join neighbouring blocks and
blocks that follow each other below the same parent, stronger the closer they are in the DOM.
The maximum flow's cut labels the blocks: what stays on the source's side is content.

Scripts, styles, templates, titles and form controls are never blocks. Character references are
decoded; white space inside a block becomes one blank; blocks are joined by a newline. A head
ends at the first tag or text that may not stand in it; ``<svg/>`` has no content.

Open elements form a tree of nodes that share their ancestors, so a page costs time and memory in
proportion to its tags, however deep they nest.

Defined cases: null and empty pages give an empty text; text outside any tag is a block.
"""

from __future__ import annotations

import functools
import math
import re
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import text_slices

NEXT, SIBLING = 0.6, 0.9  # capacities of smoothness edges at distance 1
MOST = 12.0  # the largest log odds of a block
SLICE_BYTES = 4 << 20

# HTML element names by role, and name parts that page authors give to boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript title head textarea select option button svg canvas iframe object".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
OUTSIDE = frozenset("nav footer aside form menu dialog fieldset".split())
INSIDE = frozenset("article main".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
FOREIGN = frozenset("svg math".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner\w*|sponsor\w*|promo\w*|side-?bar\w*|rail|widget\w*|menu\w*|nav\w*|breadcrumb\w*|crumbs|"
    r"comments?|commentlist|replies|reply|respond|disqus|discussion|reviews?|cookie\w*|consent|gdpr|notice\w*|alert\w*|popup\w*|modal|overlay|"
    r"share\w*|social|related\w*|recommend\w*|subscribe\w*|newsletter\w*|signup|login|search\w*|footer\w*|header|masthead|copyright|legal|"
    r"pagination|pager|skip|toolbar|tags?|toc)(?=$|[\s_-])"
)
GOOD_NAMES = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|body|text)(?=$|[\s_-])")
FEATURES = ("bias", "outside", "inside", "bad name", "good name", "links", "length", "sentence", "heading", "item", "page header", "hidden")

# Labelled pages of our own; a line is a block, + for content.
TRAINING = """
- nav ul li a|Home
- nav ul li a|Contact us
- div.menu ul li a|Products
- div.header div|My site
- header div|The daily page
- header h1|The daily page
- div.ad|Buy our new phone. Now cheaper than ever before.
- div.advert p|The best offers of the week, only here.
- aside p|More from the author, who writes on gardens and rivers.
- aside h3|Popular
- div.sidebar ul li a|Ten ways to cook rice
- div.sidebar p|Our editor picks the best stories of the month for you.
- div.cookie-notice p|We use cookies. By reading on you agree to our use of them.
- div.notice|Maintenance is planned for Sunday night.
- form p|Leave your address and we write to you.
- form label|Name
- div.comments p|I read this twice and I do not agree with the last part at all.
- section.comments div.comment p|Great read, thank you! I also saw the river last year.
- section.comments h2|3 comments
- div.comment-list li p|First!
- article div.comments p|I never liked this writer, but the text is good.
- article aside p|Read also our guide to the region and its towns.
- article div.share a|Share
- article nav a|Next
- article div.ad|Sponsored: cheap flights to the sea.
- article footer p|Filed under travel
- main form p|Search the archive
- main aside p|Related stories from the archive of the paper.
- footer p|Copyright of the site, all rights reserved.
- footer|Copyright. Terms and conditions apply.
- div.footer a|Imprint
- div.related a|Five quiet towns by the sea
- div.newsletter p|Sign up to get our stories every week.
- p a|Click here
- div.hidden p|Not shown to readers of the page.
+ article h1|A walk along the river
+ article p|We left the house early, before the sun was up, and took the path along the water.
+ article p|Short one.
+ article h2|The mill
+ article ul li|Bring water and good shoes.
+ article blockquote p|The river takes what it wants, she said.
+ article p|Rain.
+ article div p|By noon we had reached the old mill, which has been closed for years.
+ article header h1|Notes on bread
+ article section p|Flour, water, salt; then wait for a day, and wait again.
+ article table tr td|12 grams
+ article pre|x = 1
+ main h1|On maps
+ main p|A map is a drawing of what its maker has seen and of what has been told.
+ main div p|It grows old faster than the land it shows.
+ main ul li|Scale
+ div.content p|The council met on Monday and agreed on the plan for the new bridge.
+ div.content h1|Council agrees on bridge
+ div.post-body p|Then fold the dough, and leave it under a cloth until the evening.
+ div.entry p|All of this was long ago, when the line still ran to the coast.
+ div p|The train was late again, so people stood on the platform and talked about the weather.
+ body p|There is a long story behind this small house, and few people know all of it.
+ div div p|Nobody could say later who had opened the gate, or why the dogs had been so quiet.
+ h1|A house by the sea
"""


class Node:
    """An open element; what its ancestors and itself say about a block is kept as flags."""

    __slots__ = ("tag", "parent", "depth", "flags")

    def __init__(self, tag: str, names: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 1
        flags = parent.flags if parent else 0
        if tag in OUTSIDE:
            flags |= _OUT
        if tag in INSIDE:
            flags |= _IN
        if tag == "header":
            flags |= _HEADER
        if names:
            bad, good = _named(names)
            flags |= (_BAD if bad else 0) | (_GOOD if good else 0) | (_HIDDEN if "hidden" in names else 0)
        self.flags = flags


_OUT, _IN, _HEADER, _BAD, _GOOD, _HIDDEN = (1 << k for k in range(6))


class Block:
    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: Node | None, linked: int):
        self.text, self.node, self.linked = text, node, linked


class _Reader(HTMLParser):
    """Collects blocks; ``path`` is the chain of open elements, ``open`` where each tag stands in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path: list[Node] = []
        self.open: dict[str, list[int]] = {}
        self.blocks_open: list[int] = []  # block elements in the path, and those but p
        self.others_open: list[int] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.silent = self.anchors = self.foreign = 0

    def end_block(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, self.path[-1] if self.path else None, min(self.linked, len(text))))
        self.parts, self.linked = [], 0

    def _end_head(self):
        if self.path and self.path[-1].tag == "head":
            self._cut(len(self.path) - 1)

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self._end_head()
        if tag in VOID:
            if tag in BLOCK:
                self.end_block()
            elif tag == "br":
                self.parts.append(" ")
            return
        if tag in BLOCK:
            self.end_block()
            if tag in CLOSES_P:
                self._close("p", None)
            if tag in ("li", "td", "th", "tr", "dt", "dd"):
                self._close(tag, frozenset(("ul", "ol", "table", "dl", "menu") if tag != "td" else ("tr", "table")))
        names = ""
        for k, v in attrs:
            if v and k in ("class", "id", "role"):
                names += " " + v.lower()
            elif k in ("hidden",) or (k == "aria-hidden" and v == "true") or (k == "style" and v and re.search(r"display\s*:\s*none", v)):
                names += " hidden"
        at = len(self.path)
        self.path.append(Node(tag, names, self.path[-1] if self.path else None))
        self.open.setdefault(tag, []).append(at)
        if tag in BLOCK:
            self.blocks_open.append(at)
            if tag != "p":
                self.others_open.append(at)
        self.silent += tag in SILENT
        self.anchors += tag == "a"
        self.foreign += tag in FOREIGN

    def handle_startendtag(self, tag, attrs):
        if tag in FOREIGN or self.foreign:
            self._end_head()
        else:  # of other elements HTML ignores the slash
            self.handle_starttag(tag, attrs)

    def _last(self, tag) -> int:
        at = self.open.get(tag)
        return at[-1] if at else -1

    def _close(self, tag, until):
        """Close the innermost open ``tag`` unless an element of ``until`` (None: a block but p) lies within it."""
        k = self._last(tag)
        if k >= 0:
            bar = self.others_open[-1:] or [-1] if until is None else [self._last(t) for t in until]
            if k > max(bar):
                self._cut(k)

    def _cut(self, k):
        for node in self.path[k:]:
            t = node.tag
            self.open[t].pop()
            if t in BLOCK:
                self.blocks_open.pop()
                if t != "p":
                    self.others_open.pop()
            self.silent -= t in SILENT
            self.anchors -= t == "a"
            self.foreign -= t in FOREIGN
        del self.path[k:]

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.end_block()
        elif tag == "br":
            self.parts.append(" ")
        k = self._last(tag)
        if k >= 0 and (tag in BLOCK or k > (self.blocks_open[-1] if self.blocks_open else -1)):
            self._cut(k)

    def handle_data(self, data):
        if data.strip():
            self._end_head()
        if not self.silent:
            self.parts.append(data)
            if self.anchors:
                self.linked += len(data.strip())

    def close(self):
        super().close()
        self.end_block()


def blocks(html: str) -> list[Block]:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.blocks


@functools.lru_cache(4096)
def _named(names: str) -> tuple[bool, bool]:
    return bool(BAD_NAMES.search(names)), bool(GOOD_NAMES.search(names))


def features(b: Block) -> list[float]:
    flags, last = (b.node.flags, b.node.tag) if b.node else (0, "")
    on = lambda f: float(bool(flags & f))
    return [
        1.0, on(_OUT), on(_IN), on(_BAD), on(_GOOD), b.linked / len(b.text), min(1.0, math.log1p(len(b.text)) / 6),
        float(b.text[-1] in ".!?…。"), float(last in HEADS), float(last in ("li", "td", "th", "dt", "dd")), float(flags & _HEADER > 0 and not flags & _IN), on(_HIDDEN),
    ]


def _lesson(line: str) -> tuple[list[float], float]:
    where, text = line[2:].split("|")
    node = None
    for step in where.split():
        tag, _, name = step.partition(".")
        node = Node(tag, " " + name if name else "", node)
    return features(Block(text, node, len(text) if node.tag == "a" else 0)), float(line[0] == "+")


@functools.cache
def classifier() -> tuple[float, ...]:
    """Weights of the block features: logistic regression by Newton steps on the labelled pages."""
    lessons = [_lesson(x) for x in TRAINING.strip().splitlines()]
    x, y = np.array([a for a, _ in lessons]), np.array([b for _, b in lessons])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), 0.02)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return tuple(w)


def min_cut(content: list[float], other: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which blocks stay with the source. ``content``: cost of calling a block boilerplate, and
    ``other`` of calling it content; ``edges`` cost their weight if their ends differ."""
    n = len(content)
    kept = [c - o for c, o in zip(content, other, strict=True)]  # what is left after the flow straight through
    graph: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        graph[a][b] = graph[a].get(b, 0.0) + w
        graph[b][a] = graph[b].get(a, 0.0) + w
    while True:  # shortest paths from blocks with supply to blocks with room
        level = {i: 0 for i in range(n) if kept[i] > 1e-9}
        queue, seen_sink = deque(level), False
        while queue:
            i = queue.popleft()
            if kept[i] < -1e-9:
                seen_sink = True
                continue
            for j, c in graph[i].items():
                if c > 1e-9 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not seen_sink:
            return [i in level for i in range(n)]
        turn = [iter(list(graph[i])) for i in range(n)]
        for s in [i for i in level if level[i] == 0]:
            while kept[s] > 1e-9:
                path, i = [s], s
                while kept[i] >= -1e-9 or i == s:
                    for j in turn[i]:
                        if graph[i][j] > 1e-9 and level.get(j, -1) == level[i] + 1:
                            path.append(j)
                            i = j
                            break
                    else:
                        path.pop()
                        if not path:
                            break
                        i = path[-1]
                if not path:
                    break
                flow = min(kept[s], -kept[i], *(graph[a][b] for a, b in zip(path, path[1:])))  # noqa: B905
                for a, b in zip(path, path[1:]):  # noqa: B905
                    graph[a][b] -= flow
                    graph[b][a] += flow
                kept[s] -= flow
                kept[i] += flow
                turn = [iter(list(graph[k])) if k in path else turn[k] for k in range(n)] if n < 64 else turn
                for k in path if n >= 64 else ():
                    turn[k] = iter(list(graph[k]))


def _steps(a: Node | None, b: Node | None) -> int:
    """Steps through the DOM between two elements; over all neighbours no more than twice the elements."""
    n = 0
    while a is not b:
        if b is None or (a is not None and a.depth >= b.depth):
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def labels(found: list[Block]) -> list[bool]:
    w = classifier()
    odds = [max(-MOST, min(MOST, sum(a * b for a, b in zip(w, features(b), strict=True)))) for b in found]
    content, other = [math.log1p(math.exp(x)) for x in odds], [math.log1p(math.exp(-x)) for x in odds]
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, NEXT / max(1, _steps(found[i - 1].node, b.node) - 1)))
        parent = b.node.parent if b.node else None
        if parent in last:
            edges.append((last[parent], i, SIBLING / max(1, _steps(found[last[parent]].node, b.node) - 1)))
        last[parent] = i
    return min_cut(content, other, edges)


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    return "\n".join(b.text for b, good in zip(found, labels(found), strict=True) if good)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, "html", SLICE_BYTES):
        texts = [main_text(h) for h in part.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], names=["row", "text"])


def extracted(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns with the main ``text`` and its length in code points."""
    src = pages.select(F.struct(*[f"`{c}`" for c in keep]).alias("row"), F.col(html_col).cast("string").alias("html"))
    out = src.mapInArrow(_extract, f"row {src.schema['row'].dataType.simpleString()}, text string")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], "text", F.length("text").cast("long").alias("n_chars"))
