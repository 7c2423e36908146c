"""Main text of web pages by a minimum cut between content and boilerplate.

A page is read into blocks: runs of text that no block-level tag interrupts. A logistic
classifier gives each block its log odds of being content; positive ones are a capacity from
the source, negative ones one to the sink. Its features are marks (inside article or main,
inside tags of boilerplate, inside elements whose class, id or role names boilerplate) and
shape (length, share of links, punctuation, kind of tag, text under the same parent). It is
fitted on blocks whose marks are clear, once for each kind of page: with both sorts of marks, and
with the marks of content, of boilerplate, or both hidden, so that shape has to decide where marks
are missing. A page is judged by the weights of its kind. A share `NOISE` of marks is taken to be
wrong, which bounds what marks may cost.

Blocks next to each other, and blocks that follow each other under one parent, are joined by
edges. The capacity of an edge is half the log odds that two clear blocks so joined carry one
label, by their distance in the tree, whether their tags agree, and whether their marks differ.
The minimum cut, found by blocking flows, is the cheapest labelling. Content blocks are joined
in page order. Reading takes time and memory linear in the page, however deep its markup is.

Cases: a null or empty page, and a page without content, give an empty text; broken markup is
read as far as it can be; a null page_id or url is kept; repeated rows are read each; an empty
table gives an empty table; pages without clear blocks are judged by the prior weights below;
other columns are ignored. White space is what Unicode calls so.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from depotlane.llm.tables import read, slices

#: Tags by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HIDDEN = set("script style noscript template head title iframe object svg canvas select textarea button option datalist math audio video".split())
AGAINST = set("nav footer aside form menu dialog".split())
#: Tags that a start tag of the same group ends.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id and role that mark boilerplate.
HINTS = re.compile(
    r"(?:^|[^a-z])(?:ad|ads|advert\w*|adv|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|search"
    r"|sidebar\w*|side|widget\w*|menu\w*|nav\w*|breadcrumb\w*|header|masthead|topbar|footer\w*|copyright|legal|comments?|commentlist|disqus|repl(?:y|ies)|respond|share\w*|sharing|social|related|recommend\w*|pagination|pager|toolbar|navigation|complementary|contentinfo)(?:[^a-z]|$)"
)

HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
ITEMS = set("li dt dd td th caption figcaption summary legend".split())

#: Weights before anything is learnt: constant, inside article or main, tags and hints of boilerplate, log length,
#: share of links, punctuation, heading, item of a list or table, log length of all text under the same parent.
PRIOR = (-3.0, 4.0, -4.0, -4.0, 0.3, -2.0, 0.5, 0.0, -0.5, 0.4)
#: How many labelled blocks the prior weights count as, in the fit of weights and of each class of edges.
STRENGTH = 20.0
#: Share of marks that are taken to be wrong.
NOISE = 0.01
#: Steps in the tree that edges distinguish, and the prior capacity at none; halved with each step.
STEPS, EDGE = 4, 1.0
#: Bounds of what the fit sees: pages, by hash; labelled blocks of either label, by hash.
SAMPLE, LABELLED = 2000, 20000
#: Bytes of pages that a worker holds at once.
HELD = 1 << 22


class Block:
    __slots__ = ("against", "hint", "inside", "linked", "node", "parts", "size", "tag", "under")

    def __init__(self, node: int, tag: str, inside: bool, against: bool, hint: bool):
        self.node, self.tag, self.inside, self.against, self.hint = node, tag, inside, against, hint
        self.parts, self.size, self.linked, self.under = [], 0, 0, 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())

    def label(self) -> int:
        """-1 in boilerplate, 1 in article or main and not in boilerplate, else 0, by marks alone."""
        return -1 if self.against or self.hint else int(self.inside)


class Reader(HTMLParser):
    """Blocks of a page, and the tree of its block-level elements as parents and depths; node 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, bool, bool]] = []  # tag, node of its own, content, tag of boilerplate, hint
        self.levels: list[int] = []  # places in `open` of block-level tags
        self.nodes: list[int] = [0]  # open nodes
        self.parent, self.depth = [0], [0]
        self.tags: Counter[str] = Counter()
        self.hidden = self.inside = self.against = self.hints = 0
        self.blocks: list[Block] = []
        self.fresh = True

    def handle_starttag(self, tag, attributes):
        if tag in VOID:
            if tag == "br":
                self.add(" ")
            elif tag == "hr":
                self.fresh = True
            return
        if tag in BLOCKS:
            self.fresh = True
            if self.levels and self.open[self.levels[-1]][0] in ENDS.get(tag, ()):
                self.shut(self.levels[-1])
        named = " ".join(v for k, v in attributes if v and k in ("class", "id", "role")).lower()
        content, against = tag in ("article", "main"), tag in AGAINST or tag == "header" and not self.inside
        hint = bool(named and tag not in ("html", "body") and HINTS.search(named))
        own = tag in BLOCKS or content or against or hint
        if tag in BLOCKS:
            self.levels.append(len(self.open))
        self.open.append((tag, own, content, against, hint))
        self.tags[tag] += 1
        self.hidden += tag in HIDDEN
        self.inside += content
        self.against += against
        self.hints += hint
        if own:
            self.parent.append(self.nodes[-1])
            self.depth.append(len(self.nodes))
            self.nodes.append(len(self.parent) - 1)

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)
        if tag not in VOID:
            self.handle_endtag(tag)

    def shut(self, k: int) -> None:
        while len(self.open) > k:
            tag, own, content, against, hint = self.open.pop()
            self.tags[tag] -= 1
            self.hidden -= tag in HIDDEN
            self.inside -= content
            self.against -= against
            self.hints -= hint
            if own:
                self.nodes.pop()
            if tag in BLOCKS:
                self.levels.pop()

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.fresh = True
        if self.tags[tag]:  # all that is passed on the way down is closed, so the search costs no more than the opening
            k = len(self.open) - 1
            while self.open[k][0] != tag:
                k -= 1
            self.shut(k)

    def handle_data(self, data):
        self.add(data)

    def add(self, data: str) -> None:
        if self.hidden:
            return
        if self.fresh:
            if not data.strip():
                return
            tag = self.open[self.levels[-1]][0] if self.levels else ""
            self.blocks.append(Block(self.nodes[-1], tag, self.inside > 0, self.against > 0, self.hints > 0))
            self.fresh = False
        block, size = self.blocks[-1], len(data.strip())
        block.parts.append(data)
        block.size += size
        if self.tags["a"]:
            block.linked += size


@dataclass
class Page:
    """Blocks of a page; edges as (earlier block, later block, steps in the tree)."""

    blocks: list[Block]
    edges: list[tuple[int, int, int]]


def parse(html: str | None) -> Page:
    if not html:
        return Page([], [])
    reader = Reader()
    reader.feed(html)
    reader.close()
    found = [b for b in reader.blocks if b.size]
    parent, depth = reader.parent, reader.depth
    under: Counter[int] = Counter()
    last: dict[int, int] = {}
    edges = []
    for i, block in enumerate(found):
        above = parent[block.node]
        under[above] += block.size
        if i:  # walking up from neighbours passes each element once at its start and once at its end
            a, b = found[i - 1].node, block.node
            while a != b:
                if depth[a] >= depth[b]:
                    a = parent[a]
                else:
                    b = parent[b]
            apart = depth[found[i - 1].node] + depth[block.node] - 2 * depth[a] - 2
            edges.append((i - 1, i, min(STEPS - 1, max(0, apart))))
        if last.get(above, i - 1) != i - 1:
            edges.append((last[above], i, 0))
        last[above] = i
    for block in found:
        block.under = under[parent[block.node]]
    return Page(found, edges)


def shape(block: Block) -> list[float]:
    """Features of a block that don't come from its marks."""
    text = "".join(block.parts)
    ends = sum(map(text.count, ".,;:!?"))
    return [
        math.log1p(block.size), block.linked / max(1, block.size), min(1.0, 10 * ends / max(1, block.size)),
        float(block.tag in HEADINGS), float(block.tag in ITEMS), math.log1p(block.under),
    ]


def marks(block: Block) -> list[float]:
    return [float(block.label() > 0), float(block.against), float(block.hint)]


@dataclass
class Model:
    """Weights by kind of page (any marks of content, any of boilerplate), and capacities of edges by (steps, tags agree, marks differ)."""

    weights: dict[tuple[bool, bool], list[float]]
    edges: dict[tuple[int, bool, bool], float]


def prior_edge(steps: int) -> float:
    return EDGE / 2**steps


def kind(a: Block, b: Block, steps: int) -> tuple[int, bool, bool]:
    return steps, a.tag == b.tag, marks(a) != marks(b)


def costs(page: Page, model: Model) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Log odds of the blocks, and capacities of the edges."""
    seen = any(b.inside for b in page.blocks), any(b.against or b.hint for b in page.blocks)
    unary = [sum(w * x for w, x in zip(model.weights[seen], (1.0, *marks(b), *shape(b)), strict=True)) for b in page.blocks]
    links = []
    for a, b, steps in page.edges:
        found = kind(page.blocks[a], page.blocks[b], steps)
        links.append((a, b, model.edges.get(found, 0.0 if found[2] else prior_edge(steps))))
    return unary, links


def content_side(unary: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut (blocking flows over levels)."""
    n = len(unary)
    source, sink = n, n + 1
    to, room, at = [], [], [[] for _ in range(n + 2)]

    def arc(a: int, b: int, there: float, back: float) -> None:
        at[a].append(len(to)), to.append(b), room.append(there)
        at[b].append(len(to)), to.append(a), room.append(back)

    for i, u in enumerate(unary):
        arc(source, i, u, 0.0) if u > 0 else arc(i, sink, -u, 0.0)
    for a, b, w in links:
        arc(a, b, w, w)
    least = 1e-9
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in at[a]:
                if room[e] > least and to[e] not in level:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if sink not in level:
            return [i in level for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if room[e] <= least)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[a] < len(at[a]):
                e = at[a][turn[a]]
                if room[e] > least and level.get(to[e]) == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(at[a]):
                path.append(e)
                a = to[e]
            elif path:
                a = to[path.pop() ^ 1]
                turn[a] += 1
            else:
                break


def main_text(html: str | None, model: Model) -> str:
    page = parse(html)
    if not page.blocks:
        return ""
    return " ".join(b.text() for b, k in zip(page.blocks, content_side(*costs(page, model)), strict=True) if k)


def fit_weights(rows: list[tuple[int, list[float], list[float]]]) -> dict[tuple[bool, bool], list[float]]:
    """Logistic regressions with a ridge towards `PRIOR`, from (label, marks, shape) of clear blocks, for each kind of page."""
    kinds = [(True, True), (True, False), (False, True), (False, False)]
    if not rows:
        return {k: list(PRIOR) for k in kinds}
    y = np.array([r[0] > 0 for r in rows])
    seen, form = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    target = np.where(y, 1 - NOISE, NOISE)
    return {k: ridge(np.column_stack([np.ones(len(y)), seen * np.array([k[0], k[1], k[1]]), form]), target) for k in kinds}


def ridge(x: np.ndarray, target: np.ndarray) -> list[float]:
    """Newton's method, with halved steps where a full one overshoots."""
    prior, weight = np.array(PRIOR), STRENGTH / 10
    loss = lambda b: np.logaddexp(0, x @ b).sum() - target @ (x @ b) + weight * ((b - prior) ** 2).sum() / 2
    beta = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (target - p) - weight * (beta - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(np.full(len(prior), weight)), slope)
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return beta.tolist()


def fit_edges(counts: dict[tuple[int, bool, bool], tuple[int, int]]) -> dict[tuple[int, bool, bool], float]:
    """Capacities from the numbers of edges whose ends carry one label, and two."""
    found = {}
    for which, (one, two) in counts.items():
        before = 0.5 if which[2] else 1 / (1 + math.exp(-2 * prior_edge(which[0])))
        share = min(1 - NOISE, (one + STRENGTH * before) / (one + two + STRENGTH))
        found[which] = max(0.0, math.log(share / (1 - share)) / 2)
    return found


def fit(pages: DataFrame, key: str = "page_id", html: str = "html", sample: int = SAMPLE, labelled: int = LABELLED) -> Model:
    """The model, from at most about `sample` pages and `labelled` blocks of either label."""
    share = min(1.0, sample / max(1, pages.count()))
    part = pages.select(pages[key].alias("key"), pages[html].cast("string").alias("html"))
    part = part.where(F.pmod(F.xxhash64("key", "html", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("html")

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 0, HELD):
                rows = [(b.label(), marks(b), [round(x, 3) for x in shape(b)]) for h in piece.column(0).to_pylist() for b in parse(h).blocks if b.label()]
                columns = [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.list_(pa.float64())) for k in (1, 2))]
                yield pa.RecordBatch.from_arrays(columns, ["label", "marks", "shape"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for piece in slices(batch, 0, HELD):
                for page in map(parse, piece.column(0).to_pylist()):
                    for i, j, steps in page.edges:
                        a, b = page.blocks[i], page.blocks[j]
                        if a.label() and b.label():
                            which = kind(a, b, steps)
                            for view in {which, (*which[:2], False)}:  # as it is, and without marks
                                counts[*view, a.label() == b.label()] += 1
            rows = [(*k, n) for k, n in counts.items()]
            kinds = (pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["steps", "agree", "differ", "one", "n"])

    blocks = part.mapInArrow(clear, "label int, marks array<double>, shape array<double>")
    rows = []
    for label in (-1, 1):
        mixed = F.xxhash64("label", "marks", "shape", F.lit(5))
        rows += blocks.where(F.col("label") == label).orderBy(mixed, "marks", "shape").limit(labelled).collect()
    counts: dict[tuple[int, bool, bool], list[int]] = {}
    found = part.mapInArrow(joined, "steps int, agree boolean, differ boolean, one boolean, n long").groupBy("steps", "agree", "differ", "one").agg(F.sum("n").alias("n"))
    for r in found.collect():  # at most STEPS * 8 rows
        counts.setdefault((r.steps, r.agree, r.differ), [0, 0])[0 if r.one else 1] = r.n
    return Model(fit_weights([(r.label, r.marks, r["shape"]) for r in rows]), fit_edges({k: tuple(v) for k, v in counts.items()}))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """`key`, `url` and text (the main text) of each row."""
    model = fit(pages, key, html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 2, HELD):
                texts = [main_text(h, model) for h in piece.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(texts, pa.string())], ["key", "url", "text"])

    own = pages.select(pages[key].alias("key"), pages[url].cast("string").alias("url"), pages[html].cast("string").alias("html"))
    kind_of_key = own.schema["key"].dataType.simpleString()
    return own.mapInArrow(run, f"key {kind_of_key}, url string, text string").toDF(key, url, "text")


def op5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(read(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES, ORACLES = {"op5_pages": op5_pages}, {}
