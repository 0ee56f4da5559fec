"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html as html_lib
import math
import re
import sys

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import made_schema, shipped, without

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul caption".split())
CONTAINER = frozenset("html body div section main center article".split())
NEVER = frozenset("head script style noscript template nav footer aside button select datalist option textarea title iframe object embed svg canvas audio video dialog menu search noembed noframes xmp math".split())
PLAIN = frozenset("html body article main".split())
CLOSED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"),
}
CLOSES_P = BLOCK - frozenset("html body head td th tr tbody thead tfoot caption option legend title summary".split())
SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
HEADINGS = {f"h{i}": i for i in range(1, 7)}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())

TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|=|["'])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ASIDE_NAME = re.compile(
    r"(?:^|[-_:])(?:ads?|adv|advert\w*|adsense|adbox|adslot|banner\w*|sponsor\w*|promo\w*|nav\w*|menu\w*|topbar|sidebar\w*|side|breadcrumbs?|footer\w*|header\w*|masthead|cookies?\w*|consent|gdpr|"
    r"notices?|notification\w*|alerts?|popup|modal|overlay|subscri\w*|newsletter|signup|login|comment\w*|repl(?:y|ies)|respond|responses?|feedback|disqus\w*|discussion|share\w*|sharing|social\w*|related\w*|recommend\w*|"
    r"widget\w*|toolbar|pagination|pager|search\w*|copyright|disclaimer|skip|hidden)(?:$|[-_:])", re.I)
PUNCTUATION = re.compile(r"[.,;:!?、。，？！،؟…]")
DIGITS = re.compile(r"\d+")

#: Text and punctuation a block count less and less beyond these.
TEXT_KNEE, MARK_KNEE = 500.0, 5.0
#: Two groups of paths are apart if their mean scores differ by this factor.
APART = 7.0
#: Prior of a path below a <form> or a name of advertising, notices or comments,
#: and of one in the page's only <article> (or <main>).
MARKED, LANDMARK = 1e-3, 1e3
#: The score of a short paragraph: where all paths are marked, less is no article.
PARAGRAPH = 80.0


class _Node:
    """An open element. ``path`` numbers its tag path; ``container`` is the
    innermost element around text that isn't part of running text."""

    __slots__ = ("name", "path", "out", "marked", "block", "container", "above", "plain", "article", "main", "opened", "closed")

    def __init__(self, name: str, up: _Node | None, path: int, out: bool, marked: bool, count: int):
        self.name, self.path, self.out, self.marked, self.opened, self.closed = name, path, out, marked, count, math.inf
        self.block = self if up is None or name in BLOCK else up.block
        holds = up is None or name in CONTAINER
        self.container = self if holds else up.container
        self.above = (up.container if up else None) if holds else up.above
        self.plain = holds or name == "p" and up.block is up.container
        self.article = up.article if up and up.article else self if name == "article" else None
        self.main = up.main if up and up.main else self if name == "main" else None

    def holds(self, other: _Node) -> bool:
        return self.opened <= other.opened < self.closed


class _Block:
    """A run of text between block boundaries."""

    __slots__ = ("text", "node", "linked", "size")

    def __init__(self, text: str, node: _Node, linked: int):
        self.text, self.node, self.linked, self.size = text, node, min(linked, len(text)), len(text)


def _traits(name: str, attributes: str, in_article: bool) -> tuple[str, bool, bool]:
    """Path label of an element (digits aside), whether it never holds an
    article's text, and whether its kind or name speaks against that."""
    out = name in NEVER or name == "header" and not in_article
    marked, label = name == "form", name
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), html_lib.unescape(m[2] or m[3] or m[4] or "")
        if key in ("class", "id"):
            names = value.split()
            if key == "class" and names:
                label += "." + DIGITS.sub("", names[0])
            marked |= name not in PLAIN and any(ASIDE_NAME.search(x) for x in names)
        elif key == "role":
            out |= value.lower() in ROLES
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDDEN.search(value):
            out |= name not in PLAIN
    return label, out, marked


class _Reader:
    """Cuts a page into blocks. Every element is opened and closed once, its
    ancestors are never walked, and paths are numbered, so time and memory grow
    with the page's length however deep its elements nest."""

    def __init__(self):
        self.count, self.paths = 0, {}
        root = _Node("", None, 0, False, False, 0)
        self.stack, self.open = [root], {}
        self.blocks: list[_Block] = []
        self.pieces: list[str] = []
        self.linked, self.link_at = 0, 0

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.blocks.append(_Block(text, self.stack[-1].block, self.linked))
        self.pieces.clear()
        self.linked = 0

    def add(self, raw: str) -> None:
        if raw and not self.stack[-1].out:
            text = html_lib.unescape(raw)
            self.pieces.append(text)
            self.linked += len(text) if self.link_at else 0

    def push(self, name: str, label: str, out: bool, marked: bool) -> None:
        up = self.stack[-1]
        self.count += 1
        path = self.paths.setdefault((up.path, label), len(self.paths) + 1) if name in BLOCK else up.path
        self.stack.append(_Node(name, up, path, out or up.out, marked or up.marked, self.count))
        self.open.setdefault(name, []).append(len(self.stack) - 1)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            node = self.stack.pop()
            node.closed = self.count + 1
            self.open[node.name].pop()
        if self.link_at > at:
            self.link_at = 0

    def last(self, names) -> int:
        """Place in the stack of the innermost open element of these names; 0 for none."""
        return max((self.open[x][-1] for x in names if self.open.get(x)), default=0)

    def end(self, name: str) -> None:
        if name == "a":
            self.link_at = 0
        where = self.last((name,))
        if name in BLOCK:
            self.flush()
            if where:
                self.cut(where)
        elif where and all(s.name not in BLOCK for s in self.stack[where + 1 : where + 2]):
            self.cut(where)

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.pieces.append(" ")
            return
        if name in BLOCK:
            self.flush()
            p = self.last(("p",)) if name in CLOSES_P else 0
            if p:
                self.cut(p)
            inner = self.last(CLOSED_BY[name]) if name in CLOSED_BY else 0
            if inner > (self.last([x for x in SCOPE[name] if x not in CLOSED_BY[name]]) if inner else 0):
                self.cut(min(i for x in CLOSED_BY[name] for i in self.open.get(x, [])[-1:] if i >= inner))
        if name in VOID:
            return
        top = self.stack[-1]
        label, out, marked = _traits(name, attributes, bool(top.article or top.main))
        if name == "a":
            self.link_at = len(self.stack)
        # Inline elements matter only where their text is left out.
        if name in BLOCK or out or marked or top.block is not top:
            if not (attributes.rstrip().endswith("/") and name in ("svg", "path", "use", "math")):
                self.push(name, label, out or marked and name not in BLOCK, marked)

    def read(self, page: str) -> list[_Block]:
        at, n = 0, len(page)
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                self.add(page[at:])
                break
            m = TOKEN.match(page, lt)
            if not m:
                self.add(page[at : lt + 1])
                at = lt + 1
                continue
            self.add(page[at:lt])
            at = m.end()
            if not m[1]:
                continue
            name = m[1].lower()
            if page[lt + 1] == "/":
                self.end(name)
                continue
            self.start(name, m[2])
            if name in RAW:
                stop = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = stop.start() if stop else n
        self.flush()
        return self.blocks


def path_scores(blocks: list[_Block]) -> dict[int, float]:
    """A fused score for each tag path of ``blocks``.

    Text and punctuation marks a block, links left out, are averaged over the
    path, flattened beyond a knee and multiplied. A path whose text is spread
    over many elements of one kind, as reader comments are, counts less, by the
    root of its concentration; so do links. Paths through lists, tables, quotes
    and captions are smoothed: they take half their score from the paragraphs of
    the container around them, as they belong to its running text.
    """
    totals: dict[int, list] = {}
    for b in blocks:
        t = totals.setdefault(b.node.path, [0, 0, 0, 0, b.node, {}])
        t[0] += 1
        t[1] += b.size - b.linked
        t[2] += len(PUNCTUATION.findall(b.text))
        t[3] += b.size
        t[5][b.node.container.opened] = t[5].get(b.node.container.opened, 0) + b.size
    raw, around = {}, {}
    for path, (n, free, marks, size, node, held) in totals.items():
        text, mark = free / n, marks / n
        fused = text / (1 + text / TEXT_KNEE) * (0.1 + mark / (1 + mark / MARK_KNEE))
        raw[path] = fused * math.sqrt(sum(x * x for x in held.values())) / size
        if node.plain:
            a = around.setdefault(node.container.path, [0.0, 0])
            a[0] += raw[path] * size
            a[1] += size
    out = {}
    for path, (_, free, _, size, node, _) in totals.items():
        score = raw[path]
        if not node.plain:
            outer = [c for c in (node.container, node.container.above) if c and c.path in around][:1]
            score = (score + around[outer[0].path][0] / around[outer[0].path][1]) / 2 if outer else score
        out[path] = score * (free / size) ** 2
    return out


def cut_scores(scores: list[float]) -> float:
    """The least score of the upper cluster of positive ``scores``.

    The logarithms are cut in two where the groups' means lie farthest apart in
    the sense of Otsu, and the upper group again, until the two means differ by
    less than the factor ``APART``: from there on all is of one kind.
    """
    logs = sorted(math.log(x) for x in scores)
    while len(logs) > 1:
        total, below, best = sum(logs), 0.0, (-1.0, 0, 0.0)
        for k in range(1, len(logs)):
            below += logs[k - 1]
            gap = (total - below) / (len(logs) - k) - below / k
            best = max(best, (k * (len(logs) - k) * gap * gap, k, gap))
        if best[2] < math.log(APART):
            break
        logs = logs[best[1] :]
    return math.exp(logs[0]) * (1 - 1e-9)


def _landmark(blocks: list[_Block]):
    """The page's only outermost <article>, or else its only <main>, if a fifth
    of the unmarked text lies in it."""
    total = sum(b.size for b in blocks if not b.node.marked)
    for of in (lambda b: b.node.article, lambda b: b.node.main):
        held: dict[int, list] = {}
        for b in blocks:
            if of(b):
                h = held.setdefault(id(of(b)), [of(b), 0])
                h[1] += 0 if b.node.marked else b.size
        if len(held) == 1:
            node, size = next(iter(held.values()))
            return node if 5 * size >= total else None
    return None


def main_text(page: str | None) -> str:
    """The article's blocks, one a line; empty for a null, empty or textless page.

    Every tag path gets a fused score (``path_scores``) times its prior, and the
    paths above the cut between clusters of scores (``cut_scores``) hold the
    article: all their blocks are returned and no others, but for headings. A
    heading is returned if a returned block stands under it, before a heading
    as high, and inside its container, or for <h1> inside the one around that;
    and if it lies in the page's only <article> or <main>, where that holds the
    block.

    Navigation, headers, footers, asides, scripts, hidden elements and the like
    are left out by element and role. Forms, and names of advertising, notices
    or comments, only lower a path's prior; being in the page's only <article>
    or <main> raises it. Where every path is marked so, only paths that read
    like paragraphs are an article.
    """
    if not page:
        return ""
    blocks = _Reader().read(page)
    body = [b for b in blocks if b.node.name not in HEADINGS]
    landmark = _landmark(blocks)
    inside = lambda node: landmark is None or landmark.holds(node)
    scores = path_scores(body)
    nodes = {b.node.path: b.node for b in body}
    marked = [p for p, n in nodes.items() if n.marked]
    if len(marked) == len(nodes):
        scores = {p: s for p, s in scores.items() if s >= PARAGRAPH}
    prior = lambda n: (MARKED if n.marked else 1.0) * (LANDMARK if landmark is not None and landmark.holds(n) else 1.0)
    scores = {p: s * prior(nodes[p]) for p, s in scores.items() if s > 0}
    bar = cut_scores(list(scores.values())) if scores else math.inf
    chosen = {i for i, b in enumerate(blocks) if b.node.name not in HEADINGS and scores.get(b.node.path, 0.0) >= bar}
    if not chosen:
        titles = [b.text for b in blocks if b.node.name in HEADINGS and not b.node.marked and landmark is not None and inside(b.node)]
        return "\n".join(titles)
    under: list[int | None] = [None] * 7
    for i in range(len(blocks) - 1, -1, -1):
        level = HEADINGS.get(blocks[i].node.name)
        if i in chosen:
            under = [i] * 7
        elif level:
            first, node = under[level], blocks[i].node
            around = [node.container, *([node.container.above] if level == 1 and node.container.above else [])]
            if first is not None and not node.marked and any(c.holds(blocks[first].node) for c in around) and (not inside(blocks[first].node) or inside(node)):
                chosen.add(i)
            under[level:] = [None] * (7 - level)
    return "\n".join(blocks[i].text for i in sorted(chosen))


def extract_batches(batches):
    for batch in batches:
        texts = [main_text(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])


def extract_pages(pages: DataFrame, html: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``carry`` and the main text of every row; see ``main_text``. A null html
    gives an empty text. Repeated rows each get their text; other columns of
    ``pages`` are left behind, as is a carried column called ``text``."""
    carry = without(carry, "text")
    given = pages.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{html}`").alias("_html"))
    return given.mapInArrow(extract_batches, made_schema(pages, carry, text="string"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; nulls, empty pages and repeated rows as in
    ``extract_pages``."""
    out = extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


shipped(sys.modules[__name__])
