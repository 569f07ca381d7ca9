"""Main-text extraction by minimum-cut labelling of a page's blocks."""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.llm.common import arrow_map, pieces, table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]++|<)",
    re.S,
)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden|aria-label)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "textarea", "noscript", "title", "iframe", "template", "xmp", "noframes", "noembed")}

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: An opening tag ends these open elements first.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
#: What an implied end does not reach across.
_SCOPE = frozenset("ul ol dl table div section article main aside nav header footer form blockquote body html".split())
#: Elements that never hold the article.
_APART = frozenset("nav footer aside form button select option dialog menu head svg canvas object audio video map datalist fieldset".split())
_APART_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of class names and ids of what stands around an article.
_APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion promoted dfp doubleclick adsense adslot"
    " nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs pagination pager paging toc skip topbar"
    " sidebar sidebars aside rail widget widgets masthead footer foot colophon copyright legal disclaimer"
    " cookie cookies consent gdpr notice notices banner popup modal overlay lightbox alert toast paywall"
    " comment comments commentlist respond disqus replies reply discussion responses"
    " share sharing social follow like newsletter subscribe subscription signup login signin register search form"
    " related recommended recommendations popular trending teaser teasers outbrain taboola tags hidden".split()
)
_MAIN_WORDS = frozenset("article content post entry story main maintext body text articlebody postbody entrycontent hentry".split())
_SPLIT_NAME = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
#: Elements whose class names say something of the page rather than of the element.
_WHOLE = frozenset(("html", "body"))

#: Capacity of a unit of log-odds. Smoothness, in such units by steps through the tree: of neighbours in page order, of
#: blocks with one parent; and the steps that entering or leaving what stands apart adds.
UNIT = 100
ADJACENT, PROXIMITY, BOUNDARY = 3.0, 3.0, 6
#: Pages whose blocks fit the classifier, about; the weight of all of them against the prior, and the prior's inverse variance.
PAGES, WEIGHT, TIED = 2000, 200.0, 4.0
#: Features of a block and the log-odds of content that each gives before any page is seen. The last three tell how the
#: training labels come about, so training leaves them as they are.
PRIOR = {
    "always": -3.4, "words": 1.2, "links": -6.0, "sentence": 1.5, "commas": 0.3, "prose": 2.0, "heading": 2.5, "list": -0.5, "loose": 3.0, "copyright": -2.0,
    "main_name": 1.5, "article": 2.5, "apart": -10.0,
}
HELD = 3


@dataclass
class Block:
    """A text block: its element and that one's parent by number, how far it lies from the block before, and what it is in."""

    text: str
    words: int
    linked: int
    tag: str
    holder: int
    parent: int
    depth: int
    steps: int
    apart: int  # the number of the outermost element that stands apart from the article, or 0
    article: bool
    named: bool


def _about(attrs: str, tag: str) -> tuple[bool, bool, bool]:
    """Whether an element's attributes set it apart, name it like an article, and mark it as one by role."""
    apart = named = marked = False
    for name, *values in _NAMES.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            if tag in _WHOLE:
                continue
            found = {w.lower() for w in _SPLIT_NAME.split(value) if w}
            apart |= bool(found & _APART_WORDS)
            named |= bool(found & _MAIN_WORDS)
        elif name == "role":
            apart |= value.lower() in _APART_ROLES
            marked |= value.lower() in ("main", "article")
        elif name == "hidden":
            apart = True
        elif name == "style":
            apart |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name == "aria-hidden":
            apart |= value.lower() == "true"
    return apart, named and not apart, marked and not apart


@dataclass
class _Open:
    tag: str
    number: int
    apart: int
    article: bool
    named: bool
    link: bool


class _Stack:
    """Open elements, with the places of each tag's, of block-level and of scoping ones, so that no tag scans them all."""

    def __init__(self) -> None:
        self.all = [_Open("", 0, 0, False, False, False)]
        self.places: dict[str, list[int]] = {}
        self.solid, self.scope = [0], [0]
        self.low = 0  # the least depth of block-level elements since the last block

    def push(self, e: _Open) -> None:
        k = len(self.all)
        self.all.append(e)
        self.places.setdefault(e.tag, []).append(k)
        if e.tag not in _INLINE:
            self.solid.append(k)
        if e.tag in _SCOPE:
            self.scope.append(k)

    def last(self, tag: str) -> int:
        """The place of the innermost open element of a tag, or 0."""
        own = self.places.get(tag)
        return own[-1] if own else 0

    def pop_to(self, k: int) -> None:
        while len(self.all) > k:
            e = self.all.pop()
            self.places[e.tag].pop()
            for own in (self.solid, self.scope):
                if own[-1] == len(self.all):
                    own.pop()
        self.low = min(self.low, len(self.solid))


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order: what stands between two block-level tags, white space made single."""
    out: list[Block] = []
    stack = _Stack()
    number, at, parts, linked, before = 0, 0, [], 0, 1

    def flush() -> None:
        nonlocal parts, linked, before
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                holder, top, depth = stack.all[stack.solid[-1]], stack.all[-1], len(stack.solid)
                parent = stack.all[stack.solid[-2]].number if depth > 1 else 0
                words = text.count(" ") + 1
                low = min(stack.low, depth)
                out.append(Block(text, words, min(linked, words), holder.tag, holder.number, parent, depth - 1, before + depth - 2 * low, top.apart, top.article, top.named))
                stack.low = before = depth
            parts, linked = [], 0

    while m := _TOKEN.match(page, at):
        at = m.end()
        text = m["text"]
        if text is not None:
            if "&" in text:
                text = html.unescape(text)
            parts.append(text)
            if stack.all[-1].link:
                linked += len(text.split())
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"] or m["close2"]:
            if k := stack.last(tag):
                if tag not in _INLINE:
                    flush()
                elif stack.solid[-1] > k:
                    continue  # a misnested inline end leaves the blocks inside it open
                stack.pop_to(k)
            elif tag not in _INLINE:
                flush()
            continue
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            if tag == "textarea" or tag == "title":
                flush()
            at = end.start() if end else len(page)
            close = page.find(">", at)
            at = len(page) if close < 0 else close + 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in _INLINE:
            flush()
            for ended in ("p", *_ENDS.get(tag, ())):
                if (k := stack.last(ended)) and stack.scope[-1] <= k:
                    stack.pop_to(k)
        attrs = m["attrs"] if m["tag"] else m["attrs2"]
        if attrs and attrs.endswith("/") and tag in ("svg", "path"):
            continue
        apart, named, marked = _about(attrs, tag) if attrs else (False, False, False)
        here = stack.all[-1]
        if tag in _APART or tag == "header" and not (here.article or here.named):
            apart = True
        if tag in ("article", "main") and not apart:
            marked = True
        number += 1
        stack.push(_Open(tag, number, here.apart or (number if apart else 0), here.article or marked, here.named or named, here.link or tag == "a"))
    flush()
    return out


def features(b: Block) -> list[float]:
    """In the order of PRIOR."""
    density = b.linked / b.words
    return [
        1.0, min(math.log2(1 + b.words), 5.0), density, float(b.text[-1] in ".!?:;\"”»…)" or ". " in b.text), float("," in b.text),
        float(b.tag in ("p", "blockquote", "pre")), float(b.tag in ("h1", "h2", "h3", "h4") and density < 0.5), float(b.tag in ("li", "td", "dt", "dd", "th")),
        float(b.depth == 0), float("©" in b.text or "copyright" in b.text.lower()), float(b.named), float(b.article), float(b.apart > 0),
    ]


def label(b: Block) -> int | None:
    """What the page's own markup says of a block: 1 in an article, 0 in what stands apart, else nothing."""
    return 0 if b.apart else 1 if b.article else None


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression on rows that stand for ``n`` blocks each, tied to PRIOR; both labels weigh alike.

    Newton's method, as the features are few.
    """
    prior = np.array(list(PRIOR.values()))
    w, free = prior.copy(), len(prior) - HELD
    if not len(y) or len(set(y.tolist())) < 2:
        return w
    share = n * np.where(y == 1, 0.5 / n[y == 1].sum(), 0.5 / n[y == 0].sum()) * WEIGHT
    own = x[:, :free]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-own @ w[:free]))
        slope = own.T @ (share * (y - p)) - TIED * (w[:free] - prior[:free])
        bend = (own * (share * p * (1 - p))[:, None]).T @ own + TIED * np.eye(free)
        step = np.linalg.solve(bend, slope)
        w[:free] += step
        if np.abs(step).max() < 1e-9:
            break
    return np.round(w, 6)


def costs(b: Block, weights: Sequence[float]) -> tuple[int, int]:
    """Capacities to the content and to the boilerplate terminal: what the other label would cost, by the classifier's log-odds."""
    net = round(UNIT * sum(w * x for w, x in zip(weights, features(b))))
    return max(net, 0), max(-net, 0)


def edges(bs: list[Block]) -> dict[tuple[int, int], int]:
    """Smoothness between neighbours in page order and between a block and the last one with its parent.

    Each falls with the steps through the tree from one block to the other.
    """
    out: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(bs):
        near = [(i - 1, ADJACENT, b.steps)] if i else []
        if (j := last.get(b.parent, -1)) >= 0:
            near.append((j, PROXIMITY, 2 if bs[j].holder != b.holder else 0))
        for j, weight, steps in near:
            out[j, i] = out.get((j, i), 0) + round(UNIT * weight / (1 + steps + BOUNDARY * (b.apart != bs[j].apart)))
        last[b.parent] = i
    return out


def min_cut(source: list[int], sink: list[int], smooth: dict[tuple[int, int], int]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut; ``smooth`` are undirected capacities.

    Nodes whose terminal outweighs all their edges are settled first (they are on that side of some minimum
    cut, whatever the rest), and their edges become terminal capacities of the others. What is left is a flow
    network, for ``_reaching``.
    """
    n = len(source)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (i, j), w in smooth.items():
        if w > 0 and i != j:
            near[i][j] = near[i].get(j, 0) + w
            near[j][i] = near[j].get(i, 0) + w
    net = [s - t for s, t in zip(source, sink)]
    around = [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(net[i]) >= around[i]:
            side[i] = net[i] >= 0
            for j, w in near[i].items():
                net[j] += w if side[i] else -w
                around[j] -= w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    core = [i for i in range(n) if side[i] is None]
    if core:
        place = {i: k for k, i in enumerate(core)}
        arcs = [(place[i], place[j], w) for i in core for j, w in near[i].items() if i < j]
        for i, reaches in zip(core, _reaching([max(-net[i], 0) for i in core], [max(net[i], 0) for i in core], arcs)):
            side[i] = reaches
    return [bool(x) for x in side]


def _reaching(excess: list[int], room: list[int], arcs: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes can still reach a terminal when all flow that can has gone to it: the terminal's side of a minimum cut.

    Flow starts as ``excess`` at the nodes, the terminal takes up to ``room`` from each, and arcs carry flow either
    way. Push-relabel: heights are distances to the terminal; a node passes its excess on to lower neighbours and
    rises where it can't. From time to time heights are set to the true distances, by one search back from the
    terminal; what is out of reach then stays so. Excess that meets goes on as one, so long chains and lists of
    undecided blocks take time about in proportion.
    """
    n = len(excess)
    far = n + 2
    out: list[list[int]] = [[] for _ in range(n)]  # arcs by number; arc a ^ 1 is arc a backwards
    head, left = [], []
    for i, j, w in arcs:
        out[i].append(len(head))
        out[j].append(len(head) + 1)
        head += (j, i)
        left += (w, w)
    excess, room = list(excess), list(room)

    def distances() -> list[int]:
        height = [far] * n
        layer = [i for i in range(n) if room[i]]
        for i in layer:
            height[i] = 1
        d = 1
        while layer:
            d += 1
            nxt = []
            for i in layer:
                for a in out[i]:
                    j = head[a]
                    if height[j] == far and left[a ^ 1]:
                        height[j] = d
                        nxt.append(j)
            layer = nxt
        return height

    height = distances()
    at = [0] * n
    queue = deque(i for i in range(n) if excess[i] and height[i] < far)
    work = 0
    while queue:
        if work > 6 * (n + len(head)):
            height, at, work = distances(), [0] * n, 0
            queue = deque(i for i in range(n) if excess[i] and height[i] < far)
            continue
        i = queue.popleft()
        own = out[i]
        while excess[i] and height[i] < far:
            if height[i] == 1 and room[i]:
                d = min(excess[i], room[i])
                excess[i] -= d
                room[i] -= d
                continue
            while at[i] < len(own):
                a = own[at[i]]
                j = head[a]
                if left[a] and height[j] == height[i] - 1:
                    d = min(excess[i], left[a])
                    left[a] -= d
                    left[a ^ 1] += d
                    excess[i] -= d
                    if not excess[j]:
                        queue.append(j)
                    excess[j] += d
                    if not excess[i]:
                        break
                at[i] += 1
            else:
                work += len(own) + 1
                at[i] = 0
                height[i] = 1 if room[i] else min((height[head[a]] + 1 for a in own if left[a]), default=far)
        work += 1
    return [h < far for h in distances()]


def main_text(page: str | None, weights: Sequence[float] = tuple(PRIOR.values())) -> str:
    """The page's main text: its content blocks in page order, one to a line; null or empty gives empty."""
    bs = blocks(page or "")
    if not bs:
        return ""
    both = [costs(b, weights) for b in bs]
    kept = min_cut([s for s, _ in both], [t for _, t in both], edges(bs))
    return "\n".join(b.text for b, k in zip(bs, kept) if k)


def train(pages: DataFrame) -> list[float]:
    """The classifier's weights, fitted on a bounded sample of about PAGES pages (by a hash of page_id), whole ones.

    The labels come from the markup of pages that use it (``label``); blocks without such are left out, and
    where no page uses it the weights are PRIOR's. Blocks come to the driver summed by their features.
    """
    names = list(PRIOR)
    n = pages.count()
    every = max(1, n // PAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html", 4 << 20):
            rows = [([round(v, 1) for v in features(b)], y) for page in batch.column("html").to_pylist() for b in blocks(page or "") if (y := label(b)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.list_(pa.float64())), pa.array([y for _, y in rows], pa.int32())], ["x", "y"])

    sample = pages.select("page_id", "html").where(F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0)
    # features in tenths, so there are few kinds of blocks
    kinds = sample.transform(arrow_map, run, "x array<double>, y int").groupBy("x", "y").agg(F.count("*").alias("n")).collect()
    kinds.sort(key=lambda r: (list(r.x), r.y))
    x = np.array([r.x for r in kinds]).reshape(-1, len(names))
    return fit(x, np.array([r.y for r in kinds], int), np.array([r.n for r in kinds], float)).tolist()


def extract(pages: DataFrame, weights: Sequence[float] = tuple(PRIOR.values())) -> DataFrame:
    """page_id, url, text, n_chars of every page row, from its whole html.

    Blocks are the nodes of a flow network: the classifier's log-odds are the capacities to the two terminals,
    order and DOM proximity those between blocks; a minimum cut tells content from the rest. A page is worked on
    alone: null and empty html give empty text, long and deeply nested pages take time and memory about in
    proportion, also where many blocks are undecided (see ``_reaching``), equal rows give equal results, null ids and urls are kept.
    """
    held = list(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html", 4 << 20):
            texts = [main_text(x, held) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    out = pages.select("page_id", "url", "html").transform(arrow_map, run, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
