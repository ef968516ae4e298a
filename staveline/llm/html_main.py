"""Main text of web pages by minimum-cut labelling.

A page is read into text blocks, each with its open elements. A logistic
classifier on cues of the block (containers around it, words in their class and
id attributes, link density, length, punctuation) gives the cost of calling it
content and that of calling it boilerplate: the capacities of its two terminal
edges. Blocks that follow one another, and successive blocks of one parent
element, are joined by smoothness edges, weaker the less of their path they
share. The minimum cut labels all blocks at once.

Blocks whose terminal costs differ by more than all their smoothness edges
together have the same label in every minimum cut; they are settled first, and
maximum flow (shortest augmenting paths by levels) runs on what is left.

The classifier is trained in the driver on blocks of at most ``SAMPLE`` pages
of up to ``SAMPLE_CHARS`` characters, taken in the order of a hash of the id:
blocks inside explicit content elements against those inside explicit
boilerplate ones. Where the sample lacks either, fixed prior weights are used.
Elements that leave no doubt (navigation, forms, hidden parts ...) and articles
without furniture outweigh the trained part by ``SURE``. Words in class and id
attributes are cues for the classifier only; those that tell of an element's
parts (``has-sidebar``) are no cues, and a smoothness edge between blocks with
and without such a cue is weak.

Reading takes time in proportion to the page: each tag, comment and quote is
walked once, ends that a page lacks are looked for once, and end tags without a
start are known by a count of open elements.

Null and empty pages have an empty text. Unclosed elements, stray end tags and
truncated markup are read as they stand; an element whose content isn't text
(``iframe``, ``svg`` ...) is skipped if it has an end tag, else its content is read
(unclosed scripts, styles and comments reach to the page's end). Repeated rows
are extracted each; other columns are not read, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staveline.llm.tables import small_batches

SAMPLE, SAMPLE_CHARS = 200, 200_000
SURE = 12.0
NEXT, SIBLING, BORDER = 0.8, 1.2, 0.25

#: Elements that start a new block.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without content, and elements whose content isn't text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CODE = frozenset("script style".split())
RAW = CODE | frozenset("noscript template iframe object svg canvas title textarea".split())
#: Elements that hold page furniture, and those that hold the article.
FURNITURE = frozenset("nav aside footer form menu dialog button select search".split())
ARTICLE = frozenset("article main".split())
#: Words in class and id attributes that name page furniture, and the article.
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright "
    "disqus disclaimer footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup privacy promo promoted "
    "related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
GOOD_WORDS = frozenset("article body content entry main post story text".split())

#: Words that say of an attribute's name that it tells of the element's parts.
PARTS = frozenset("has with without no".split())
_MARKUP = re.compile(r"<(?:(!--)|(!\[CDATA\[)|[!?]|(/?)([A-Za-z][A-Za-z0-9:-]*))")
_STOP = re.compile(r"[>\"']")
_END = {name: re.compile(rf"</{name}(?=[\s/>]|$)", re.I) for name in RAW}
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORDS = re.compile(r"[a-z]+")
#: Start tags that end an open paragraph or item of the same kind.
_ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_ENDS = {k: frozenset(v.split()) for k, v in _ENDS.items()}


class Node:
    __slots__ = ("bad", "block", "depth", "doubtless", "good", "links", "name", "parent")

    def __init__(self, name: str, parent: Node | None, attrs: str):
        self.name, self.parent = name, parent
        bad = name in FURNITURE
        good = name in ARTICLE
        main = name == "main"
        sure = bad
        if attrs:
            for key, value in _ATTR.findall(attrs):
                key = key.lower()
                if key == "hidden" or (key == "aria-hidden" and value.strip("\"'").lower() == "true"):
                    bad = sure = True
                elif key == "role":
                    words = set(_WORDS.findall(value.lower()))
                    bad |= bool(BAD_ROLES & words)
                    main |= "main" in words
                    good |= main or "article" in words
                elif name not in ("body", "html", "article", "main"):
                    for token in value.lower().split():
                        words = set(_WORDS.findall(token))
                        if not PARTS & words:
                            good |= bool(GOOD_WORDS & words)
                            # An article's own header is no furniture, by whatever name.
                            bad |= bool(BAD_WORDS & words - {"header"}) or ("header" in words and not GOOD_WORDS & words)
        if parent is None:
            self.depth, self.links, self.block = 0, 0, None
            self.bad, self.good, self.doubtless = bad, good and not bad, sure
            return
        # A page header is furniture, an article's own header isn't.
        if name == "header" and not parent.good:
            bad = True
        self.depth, self.links = parent.depth + 1, parent.links + (name == "a")
        self.block = self if name in BLOCK else parent.block
        self.doubtless = sure or parent.doubtless
        self.bad = bad or (parent.bad and (parent.doubtless or not main))
        self.good = (good and not bad) or parent.good


class Block:
    """A text block: ``shared`` counts the elements on both its path and that of the block before it."""

    __slots__ = ("linked", "node", "shared", "text")

    def __init__(self, text: str, linked: int, node: Node, shared: int):
        self.text, self.linked, self.node, self.shared = text, linked, node, shared


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where the tag that is open at ``at`` ends; ``last`` has the last place of either quote."""
    while m := _STOP.search(page, at):
        k, mark = m.start(), m[0]
        if mark == ">":
            return k
        at, before = k + 1, k - 1
        while page[before].isspace():
            before -= 1
        if page[before] == "=" and k < last[mark]:
            at = page.index(mark, at) + 1
    return len(page)


def blocks(page: str) -> list[Block]:
    """Text blocks in page order: character references decoded, white space single."""
    out: list[Block] = []
    root = Node("#root", None, "")
    node = owner = root
    pieces: list[str] = []
    opened: dict[str, int] = {}
    lacks: set[str] = set()
    last = {'"': page.rfind('"'), "'": page.rfind("'")}
    linked, at = 0, 0
    # The least depth since the last block's owner, the same when this block began, and since this block's owner.
    low = low_then = low_since = 0

    def close() -> None:
        nonlocal linked, low
        if pieces:
            if text := " ".join(html.unescape("".join(pieces)).split()):
                out.append(Block(text, min(linked, len(text)), owner, low_then + 1))
                low = low_since
            pieces.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked, owner, low, low_then, low_since
        if text:
            if not pieces:
                owner = node
                low = min(low, node.depth)
                low_then, low_since = low, node.depth
            pieces.append(text)
            if node.links:
                linked += len(text.strip())

    def leave(up: Node) -> None:
        """Closes all elements below ``up``."""
        nonlocal node, low, low_since
        while node is not up:
            opened[node.name] -= 1
            node = node.parent
        low, low_since = min(low, up.depth), min(low_since, up.depth)

    while at < len(page):
        m = _MARKUP.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[4] is None:
            end = "-->" if m[1] else "]]>" if m[2] else ">"
            stop = page.find(end, at)
            stop = len(page) if stop < 0 else stop
            if m[2]:
                say(html.escape(page[at:stop]))
            at = stop + len(end)
            continue
        name, begin = m[4].lower(), at
        at = _tag_end(page, at, last)
        attrs, at = page[begin:at], at + 1
        if m[3]:
            if name in BLOCK:
                close()
            if opened.get(name):
                up = node
                while up.name != name:
                    up = up.parent
                leave(up.parent)
            continue
        if name in BLOCK:
            close()
            # A new block ends an open paragraph, and an item its like; inline elements left open end with it.
            stops = _ENDS.get(name, frozenset())
            while (up := node.block) and (up.name == "p" or up.name in stops):
                leave(up.parent)
        elif name == "br":
            say("\n")
        if name in VOID or attrs.endswith("/"):
            continue
        if name in RAW and name not in lacks:
            if end := _END[name].search(page, at):
                at = end.start()
                continue
            if name in CODE:
                break
            lacks.add(name)
        node = Node(name, node, attrs)
        opened[name] = opened.get(name, 0) + 1
    close()
    return out


NAMES = ("bias", "bad", "good", "outside", "log_length", "link_density", "stops", "heading", "item", "short")


def features(found: list[Block]) -> np.ndarray:
    """One row for each block."""
    has_article = any(b.node.good and not b.node.bad for b in found)
    out = np.zeros((len(found), len(NAMES)))
    for k, b in enumerate(found):
        n, size = b.node, len(b.text)
        names, up = set(), n
        for _ in range(3):
            names.add(up.name)
            up = up.parent or up
        stops = sum(map(b.text.count, ".,;!?"))
        out[k] = (
            1, n.bad, n.good, has_article and not n.good, min(np.log1p(size), 8) / 4, b.linked / size, min(stops, 6) / 3,
            bool(names & {"h1", "h2", "h3", "h4", "h5", "h6"}), "li" in names, size < 25,
        )
    return out


#: Weights where no page of the sample tells content from furniture.
PRIOR = np.array([-1.0, -7.0, 2.0, -3.0, 1.5, -3.0, 1.0, 0.5, -0.5, -0.5])


def fit(pages: list[str]) -> np.ndarray:
    """Logistic weights from blocks in explicit content and explicit furniture, drawn towards the prior ones."""
    x, y = [], []
    for page in pages:
        found = blocks(page)
        for b, row in zip(found, features(found), strict=True):
            if b.node.bad or b.node.good:
                x.append(row)
                y.append(float(b.node.good and not b.node.bad))
    if not y or min(y) == max(y):
        return PRIOR.copy()
    a, t, w = np.array(x), np.array(y), PRIOR.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.eye(len(w)), a.T @ (p - t) + (w - PRIOR))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def minimum_cut(lean: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the content side: ``lean`` is the cost of boilerplate less that of content."""
    n = len(lean)
    label: list[bool | None] = [None] * n
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in edges:
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    lean = list(lean)
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(lean[i]) > sum(near[i].values()):
            label[i] = lean[i] > 0
            for j, c in near[i].items():
                del near[j][i]
                lean[j] += c if label[i] else -c
                if label[j] is None:
                    todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        side = _max_flow(rest, lean, near)
        for i in rest:
            label[i] = side[i]
    return [bool(x) for x in label]


def _max_flow(nodes: list[int], lean: list[float], near: list[dict[int, float]]) -> dict[int, bool]:
    """Source side after maximum flow; level graphs, walked without recursion, each node's arcs once a level graph."""
    source, sink, tiny = -1, -2, 1e-9
    cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    cap[source], cap[sink] = {}, {}
    for i in nodes:
        if lean[i] > 0:
            cap[source][i], cap[i][source] = lean[i], 0.0
        elif lean[i] < 0:
            cap[i][sink], cap[sink][i] = -lean[i], 0.0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            i = queue.popleft()
            for j, c in cap[i].items():
                if c > tiny and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return {i: i in level for i in nodes}
        ways = {i: [j for j in cap[i] if level.get(j, -1) == level[i] + 1] for i in level}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                flow = min(cap[a][b] for a, b in zip(path, path[1:], strict=False))
                full = 0
                for k in range(len(path) - 1, 0, -1):
                    a, b = path[k - 1], path[k]
                    cap[a][b] -= flow
                    cap[b][a] = cap[b].get(a, 0.0) + flow
                    if cap[a][b] <= tiny:
                        full = k
                del path[full:]  # on from the first arc that is full
                continue
            own = ways[i]
            while own and cap[i][own[-1]] <= tiny:
                own.pop()
            if own:
                path.append(own[-1])
            else:
                path.pop()
                if path:
                    ways[path[-1]].pop()


def label_blocks(found: list[Block], weights: np.ndarray) -> list[bool]:
    """Content or not, for each block of a page."""
    if not found:
        return []
    lean = features(found) @ weights
    for k, b in enumerate(found):
        if b.node.doubtless:
            lean[k] -= SURE
        elif b.node.good and not b.node.bad:
            lean[k] += SURE
    edges, last = [], {}

    def edge(i: int, k: int, weight: float, shared: int) -> None:
        a, b = found[i].node, found[k].node
        share = shared / (max(a.depth, b.depth) + 1)
        edges.append((i, k, weight * share * (1.0 if a.bad == b.bad else BORDER)))

    for k, b in enumerate(found):
        if k:
            edge(k - 1, k, NEXT, b.shared)
        up = b.node.parent
        i = last.get(up)
        if i is not None and i != k - 1:
            edge(i, k, SIBLING, b.node.depth + (found[i].node is b.node))
        last[up] = k
    return minimum_cut(lean.tolist(), edges)


def main_text(page: str | None, weights: np.ndarray) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, keep in zip(found, label_blocks(found, weights), strict=True) if keep)


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``id``, the ``keep`` columns, ``text`` and ``n_chars`` for every page."""
    rows = pages.select(id_col, *keep, F.col(html_col).cast("string").alias("__html"))
    ids = pages.filter(F.col(html_col).isNotNull()).select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE)
    picked = rows.filter(F.length("__html") < SAMPLE_CHARS).join(F.broadcast(ids.distinct()), id_col, "left_semi")
    weights = fit(sorted(r[0] for r in picked.select("__html").limit(2 * SAMPLE).collect()))
    schema = pages.select(id_col, *keep).withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    at = len(keep) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py(), weights) for v in batch.column(at)]
            cols = [*batch.columns[:at], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:at], "text", "n_chars"])

    return small_batches(rows).mapInArrow(run, schema)
