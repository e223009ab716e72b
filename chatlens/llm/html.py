"""HTML main-text extraction by a tree-structured graphical model.

Block elements of a page's DOM are the nodes; each is content or not. A node's own potential
is linear in its features (tag, class and id words, text length, link density, ...), and a potential
on each parent-child edge says how labels go together. Sum-product message passing, once
upward and once downward, gives the exact marginal of every node; a text block is kept if the
marginal of its element is at least a half.

The weights are trained from labelled pages by the same message passing (gradient of the
conditional likelihood). The pages come from a grammar of layouts: articles and other
containers among menus, headers, footers, sidebars, notices, adverts, forms and reader
comments, with ``data-y`` naming the label of what follows below. ``pages`` and ``seed`` bound
and fix the sample. A good part of its elements bear invented class words, so that tags and the
shape of the text can carry a page alone; words that few training pages bear weigh nothing, and each
kind of feature has buckets of its own, so that an unknown word hardly meets a known one's.
If no element reaches a half, but the page has running prose, the threshold is half the best marginal of it.

Scripts, styles, forms and the like never hold text, whatever the model says; but a form around
the whole page, outside which next to nothing stands, is an element like others.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Buckets of features of the element, of its words, and of the tags and words around it.
_SHAPES, _WORDS = 1 << 13, 1 << 17
BUCKETS, TRAIN_PAGES, SEED, PAGES_AT_ONCE = _SHAPES + 2 * _WORDS, 700, 5, 100
#: Pages of the sample that bear a feature, at least, for it to weigh anything.
LEAST_PAGES = 8
#: Characters of a block of prose, and of all of it, that make a page one with running prose.
PROSE, RUNNING = 60, 120

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
SKIP = RAW | frozenset("head form button select option svg math object audio video canvas datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
#: An open element (key) that the start of any of these ends.
_BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                    "header hgroup hr li main menu nav ol p pre section summary table tbody thead tfoot tr td th ul".split())
_ENDS = {"p": _BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
         "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option"]),
         "button": frozenset(["button"])}
#: How far up an implied end may reach.
_WALLS = {"p": frozenset("table td th button object article section div blockquote li dd body".split()), "li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]),
          "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "option": frozenset(["select", "datalist"]), "button": frozenset("table td th object template".split())}
#: Start tags that may stand in head; any other, and any text, ends it.
_IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head html".split())
#: Start tags that end svg and math, unless an element between takes HTML.
_NOT_FOREIGN = _BLOCKS | frozenset("b big body br code dd dt em embed font h1 head hr i img meta nobr pre ruby s small span strong strike sub sup tt u var".split())
_TAKES_HTML = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
#: Left open, these end where a block starts; other skipped elements left open are not skipped.
_PHRASES = frozenset("button select option datalist svg math".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_ATTR = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    words: list[str] = field(default_factory=list)  # of class, id, role
    label: int | None = None
    chars: int = 0  # text below
    links: int = 0  # of it, inside links
    blocks: int = 0
    prose: int = 0  # of them, whole sentences that are not links
    order: int = 0


@dataclass
class Page:
    """Block elements in page order, and (element, text) of the text blocks in page order."""

    nodes: list[Node]
    blocks: list[tuple[int, str]]


def _closes_itself(attributes: str) -> bool:
    """The tag ends in '/>', and the slash is not the end of an unquoted value."""
    if not attributes.endswith("/"):
        return False
    rest = attributes[:-1]
    cut = max(rest.rfind(c) for c in " \t\n\f\r\"'") + 1
    name, is_value, value = rest[cut:].partition("=")
    return not (value if is_value else name and rest[:cut].rstrip().endswith("="))


def parse(source: str) -> Page:
    """Tolerant DOM of block elements: implied ends of head, p, li, table parts, svg; stray ends
    are ignored; unclosed elements end with their parent. One that is skipped and has no end
    tag hides nothing behind it: see ``_PHRASES``."""
    page, unclosed = _parse(source, frozenset())
    page = _parse(source, unclosed)[0] if unclosed else page
    if page.nodes[0].chars < 400 and "<form" in source.lower():  # a form may be around all of it
        page, forms = page, _parse(source, unclosed, SKIP - {"form"})[0]
        page = forms if forms.nodes[0].chars > 4 * page.nodes[0].chars + 200 else page
    return page


def _parse(source: str, unclosed: frozenset[int], skip: frozenset[str] = SKIP) -> tuple[Page, frozenset[int]]:
    """The page, and the places of start tags of skipped elements without an end tag; those in
    ``unclosed`` are known as such."""
    nodes = [Node("body", -1, 0)]
    blocks: list[tuple[int, str]] = []
    stack: list[tuple[str, int, bool, int]] = [("body", 0, False, -1)]  # tag, block element, skipped, place
    foreign = 0  # svg and math elements open
    starts: dict[str, int] = {}  # skipped element -> place of its last start without an end so far
    open_ends: set[int] = set()
    ended: set[int] = set()  # by the start of another element, as the rules say
    buffer: list[str] = []
    opened_now: Counter[str] = Counter(["body"])  # tags of the open elements
    links, link_chars, at, low = 0, 0, 0, None

    def flush() -> None:
        nonlocal link_chars
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                owner = stack[-1][1]
                blocks.append((owner, text))
                share = min(link_chars, len(text))
                n = nodes[owner]
                n.chars += len(text)
                n.links += share
                n.blocks += 1
                n.prose += is_prose(text) and 3 * share < len(text)
            link_chars = 0

    def say(text: str) -> None:
        nonlocal link_chars
        if stack[-1][0] == "head" and text.strip(" \t\n\f\r"):
            close(len(stack) - 1)
        if not stack[-1][2] and text:
            buffer.append(text)
            if links:
                link_chars += len(text)

    def close(depth: int) -> None:
        nonlocal links, foreign
        while len(stack) > depth:
            tag = stack[-1][0]
            foreign -= tag in ("svg", "math")
            if tag not in INLINE:
                flush()
            links -= tag == "a"
            opened_now[tag] -= 1
            stack.pop()

    for m in _TOKEN.finditer(source):
        if m.start() < at:
            continue
        say(source[at:m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, end = name.lower(), bool(m[1] or m[4])
        if end:
            starts.pop(tag, None)
            if opened_now[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
            continue
        if stack[-1][0] == "head" and tag not in _IN_HEAD:
            close(len(stack) - 1)
        if tag in ("html", "body"):
            continue
        if foreign:
            if _closes_itself(m[3] or m[6] or ""):
                continue
            if tag in _NOT_FOREIGN:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ("svg", "math"):
                        close(k)
                        break
                    if stack[k][0] in _TAKES_HTML:
                        break
        if unclosed and stack[-1][2] and tag in _BLOCKS:
            for k in range(1, len(stack)):
                if stack[k][0] in _PHRASES and stack[k][3] in unclosed:
                    close(k)
                    break
        if tag not in INLINE:
            for opened in ("p", "li", "dt", "dd", "td", "th", "tr", "option", "button"):
                if tag in _ENDS[opened] and opened_now[opened]:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == opened:
                            ended.add(stack[k][3])
                            close(k)
                            break
                        if stack[k][0] in _WALLS[opened]:
                            break
        if tag == "br":
            say(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag in ("svg", "math") and _closes_itself(m[3] or m[6] or ""):
            continue
        skipped = stack[-1][2] or tag in skip and (m.start() not in unclosed or tag in _PHRASES)
        if tag in skip and tag not in RAW and tag != "head":
            if tag in starts:
                open_ends.add(starts[tag])
            starts[tag] = m.start()
            foreign += tag in ("svg", "math")
        if tag in RAW:
            if low is None:
                low = source.lower()
            stop = low.find("</" + tag, at) if len(low) == len(source) else -1
            if stop < 0 and len(low) != len(source):
                found = re.compile("</" + tag, re.I).search(source, at)
                stop = found.start() if found else -1
            stop = len(source) if stop < 0 else stop
            close_at = source.find(">", stop)
            at = len(source) if close_at < 0 else close_at + 1
            continue
        owner = stack[-1][1]
        if tag not in INLINE:
            flush()
            node = Node(tag, owner, nodes[owner].depth + 1, order=len(nodes))
            if m[3] or m[6]:
                for a in _ATTR.finditer(m[3] or m[6]):
                    value, key = a[2] or a[3] or a[4] or "", a[1].lower()
                    if key in ("class", "id", "role", "itemprop"):
                        node.words += [w.lower() for w in _PART.findall(value)]
                    elif key == "data-y":
                        node.label = int(value)
            owner = len(nodes)
            nodes.append(node)
        links += tag == "a"
        stack.append((tag, owner, skipped, m.start()))
        opened_now[tag] += 1
    say(source[at:])
    close(1)
    flush()
    for n in reversed(nodes):  # a parent comes before its children
        if n.parent >= 0:
            up = nodes[n.parent]
            up.chars, up.links, up.blocks, up.prose = up.chars + n.chars, up.links + n.links, up.blocks + n.blocks, up.prose + n.prose
    return Page(nodes, blocks), frozenset((open_ends | set(starts.values())) - ended)


def is_prose(text: str) -> bool:
    """A sentence of some length, by its marks."""
    return len(text) >= PROSE and text.rstrip("\"'”’»)")[-1:] in ".!?…:。！？।" and " " in text


@cache
def _bucket(name: str) -> int:
    h = zlib.crc32(name.encode())
    if name.startswith("word="):
        return _SHAPES + h % _WORDS
    return _SHAPES + _WORDS + h % _WORDS if name.startswith("in=") else h % _SHAPES


def features(page: Page) -> tuple[list[int], list[int], list[int], list[int]]:
    """(node, bucket) of the features that are on, but for those of the elements around; and of what
    each element is to all below it: its tag and words, where no element around it has them."""
    at, on, from_, give = [], [], [], []
    total = max(page.nodes[0].chars, 1)
    path: set[str] = set()  # tags and words of the open elements
    opened: list[tuple[int, list[str]]] = []  # nodes come in page order: a stack
    for i, n in enumerate(page.nodes):
        while opened and opened[-1][0] != n.parent:
            path.difference_update(opened.pop()[1])
        fresh = [w for w in dict.fromkeys((*n.words, n.tag)) if w not in path]
        path.update(fresh)
        opened.append((i, fresh))
        density = n.links / n.chars if n.chars else 0.0
        names = ["bias", "tag=" + n.tag, f"chars={min(n.chars, 100_000).bit_length() // 2}", f"links={int(density * 4)}",
                 f"share={int(4 * n.chars / total)}", "leaf" if n.blocks <= 1 else "inner", "empty" if not n.chars else "text"]
        up = page.nodes[n.parent] if n.parent >= 0 else n
        mean = n.chars // n.blocks if n.blocks else 0
        names += [f"mean={mean.bit_length()}", f"prose={min(n.prose, 4)}", f"of_prose={int(4 * n.prose / max(page.nodes[0].prose, 1))}",
                  f"of_parent={int(4 * n.chars / max(up.chars, 1))}", f"parent_links={int(4 * up.links / max(up.chars, 1))}"]
        names += ["word=" + w for w in dict.fromkeys(n.words)]
        at += [i] * len(names)
        on += [_bucket(x) for x in names]
        from_ += [i] * len(fresh)
        give += [_bucket("in=" + w) for w in fresh]
    return at, on, from_, give


class Forest:
    """Trees of many pages side by side, level by level, for message passing."""

    def __init__(self, pages: list[Page]) -> None:
        parent, depth, at, on, from_, give, base = [], [], [], [], [], [], 0
        self.first = [0]
        for p in pages:
            parent += [n.parent + base if n.parent >= 0 else -1 for n in p.nodes]
            depth += [n.depth for n in p.nodes]
            a, o, f, g = features(p)
            at += [x + base for x in a]
            on += o
            from_ += [x + base for x in f]
            give += g
            base += len(p.nodes)
            self.first.append(base)
        self.parent, depth = np.array(parent, dtype=np.int64), np.array(depth, dtype=np.int64)
        self._at, self._on, self.n = np.array(at, dtype=np.int64), np.array(on, dtype=np.int64), base
        self._from, self._give = np.array(from_, dtype=np.int64), np.array(give, dtype=np.int64)
        by = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[by], np.arange(1, (depth.max() if base else 0) + 2))
        self.levels = [by[s:e] for s, e in zip([0, *cuts[:-1]], cuts, strict=True)]

    @cached_property
    def _all(self) -> tuple[np.ndarray, np.ndarray]:
        around = [[] for _ in range(self.n)]
        for i, g in zip(self._from.tolist(), self._give.tolist(), strict=True):
            around[i].append(g)
        at, on = [], []
        for lv in self.levels:
            for i in lv.tolist():
                if (k := self.parent[i]) >= 0:
                    at += [i] * len(around[k])
                    on += around[k]
                    around[i] = around[k] + around[i]
        return np.concatenate([self._at, np.array(at, dtype=np.int64)]), np.concatenate([self._on, np.array(on, dtype=np.int64)])

    @property
    def at(self) -> np.ndarray:
        """Node of each feature that is on; those of the elements around are listed at every node,
        which training pages bear (``marginals`` hands their sum down instead)."""
        return self._all[0]

    @property
    def on(self) -> np.ndarray:
        """Bucket of each feature that is on."""
        return self._all[1]

    def marginals(self, weights: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(node marginals of label 1; expected edge counts (2, 2); log partition).
        edge[a, b]: log potential of parent a over child b."""
        own = np.zeros((self.n, 2))
        own[:, 1] = np.bincount(self._at, weights=weights[self._on], minlength=self.n)
        around = np.bincount(self._from, weights=weights[self._give], minlength=self.n)
        for lv in self.levels[1:]:
            own[lv, 1] += around[self.parent[lv]]
            around[lv] += around[self.parent[lv]]
        below, up = own.copy(), np.zeros((self.n, 2))
        for lv in self.levels[:0:-1]:  # upward: what a child says to its parent
            up[lv] = np.logaddexp(edge[None, :, 0] + below[lv, 0, None], edge[None, :, 1] + below[lv, 1, None])
            np.add.at(below, self.parent[lv], up[lv])
        belief = below.copy()
        counts = np.zeros((2, 2))
        for lv in self.levels[1:]:  # downward: the parent without the child's own message
            rest = belief[self.parent[lv]] - up[lv]
            down = np.logaddexp(edge[None, 0, :] + rest[:, 0, None], edge[None, 1, :] + rest[:, 1, None])
            belief[lv] = below[lv] + down
            joint = rest[:, :, None] + edge[None] + below[lv][:, None, :]
            joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
            counts += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        top = belief.max(axis=1, keepdims=True)
        p = np.exp(belief - top)
        roots = self.levels[0] if self.levels else np.zeros(0, np.int64)
        log_z = float((top[roots, 0] + np.log(p[roots].sum(axis=1))).sum())
        return p[:, 1] / p.sum(axis=1), counts, log_z


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    edge: np.ndarray


def _fill_labels(page: Page) -> np.ndarray:
    """Labels of all nodes: own mark or that of the nearest marked ancestor; an element without any
    follows the larger part of its text."""
    y = np.full(len(page.nodes), -1)
    for i, n in enumerate(page.nodes):
        y[i] = n.label if n.label is not None else (y[n.parent] if n.parent >= 0 else -1)
    text = np.zeros((len(page.nodes), 2))
    for owner, block in page.blocks:
        k = owner
        while k >= 0:
            text[k, max(y[owner], 0)] += len(block)
            k = page.nodes[k].parent
    return np.where(y < 0, text[:, 1] > text[:, 0], y).astype(int)


def train(pages: int = TRAIN_PAGES, seed: int = SEED, steps: int = 250, l2: float = 0.02) -> Model:
    """Conditional likelihood ascent on ``pages`` labelled pages."""
    rng = random.Random(seed)
    sample = [parse(labelled_page(rng)) for _ in range(pages)]
    forest = Forest(sample)
    y = np.concatenate([_fill_labels(p) for p in sample])
    seen = np.bincount(forest.on, weights=y[forest.at], minlength=BUCKETS)
    child = np.flatnonzero(forest.parent >= 0)
    pairs = np.bincount(2 * y[forest.parent[child]] + y[child], minlength=4).reshape(2, 2).astype(float)
    page_of = np.searchsorted(forest.first, forest.at, side="right")
    borne = np.unique(page_of.astype(np.int64) * BUCKETS + forest.on) % BUCKETS
    known = np.bincount(borne, minlength=BUCKETS) >= LEAST_PAGES
    w, edge = np.zeros(BUCKETS), np.zeros((2, 2))
    gw, ge = np.full(BUCKETS, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(steps):  # AdaGrad
        p, counts, _ = forest.marginals(w, edge)
        dw = (seen - np.bincount(forest.on, weights=p[forest.at], minlength=BUCKETS) - l2 * w) / pages
        de = (pairs - counts - l2 * edge) / pages
        gw, ge = gw + dw ** 2, ge + de ** 2
        w, edge = w + known * (0.5 * dw / np.sqrt(gw)), edge + 0.5 * de / np.sqrt(ge)
    return Model(w, edge)


def main_texts(sources: list[str], model: Model) -> list[str]:
    """Main text of each page: its content blocks, one per line."""
    out = []
    for s in range(0, len(sources), PAGES_AT_ONCE):
        pages = [parse(x) for x in sources[s:s + PAGES_AT_ONCE]]
        forest = Forest(pages)
        content = forest.marginals(model.weights, model.edge)[0]
        for page, base in zip(pages, forest.first, strict=False):
            least = 0.5
            if page.blocks and not any(content[base + owner] >= 0.5 for owner, _ in page.blocks):
                prose = [(content[base + owner], len(text)) for owner, text in page.blocks if is_prose(text)]
                if sum(n for _, n in prose) >= RUNNING:
                    least = max(p for p, _ in prose) / 2
            out.append("\n".join(text for owner, text in page.blocks if content[base + owner] >= least))
    return out


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages`` (page_id, url, html).

    Null and empty html give an empty text. Repeated rows get equal results, null ids and
    urls stay; other columns of ``pages`` are not used. An empty table gives no rows. White
    space inside a block (line breaks and no-break spaces too) becomes one space.
    """
    model = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, len(b), 256):
                part = b.slice(s, 256)
                texts = main_texts([x or "" for x in part.column(2).to_pylist()], model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


# --- labelled pages -------------------------------------------------------------------

_CONTENT = ("<article>", "<article class='post'>", "<main>", "<div class='content'>", "<div id='content'>", "<div class='entry-content'>",
            "<div class='article-body'>", "<section class='story'>", "<div class='post-body text'>", "<div itemprop='articleBody'>", "<main id='main'>",
            "<div role='main'>", "<article class='entry hentry'>", "<div class='artikel beitrag'>", "<div id='inhalt'>", "<div class='contenido'>", "<div class='contenu'>", "<div class='prose'>")
_PLAIN = ("<div>", "<div class='wrap'>", "<div class='container'>", "<div id='page'>", "<div class='row'>", "<div class='inner col'>", "<section>")
_MENU = ("<nav>", "<div class='menu'>", "<ul class='nav navbar'>", "<nav class='main-navigation'>", "<div id='nav' role='navigation'>", "<menu>",
         "<div class='breadcrumbs'>", "<div class='pagination'>", "<div class='share social'>", "<div class='tags'>", "<div class='toc menu'>")
_SIDE = ("<aside>", "<div class='sidebar'>", "<div id='sidebar' class='widget-area'>", "<aside class='related'>", "<div class='widget recent'>",
         "<div class='related-posts'>", "<section class='sidebar promo'>", "<div role='complementary'>", "<div class='side-bar left'>", "<aside class='author-bio about'>", "<div class='trending most-read'>")
_NOTE = ("<div class='ad'>", "<div class='advert'>", "<div class='ads banner'>", "<div id='ad-top' class='sponsored'>", "<div class='notice'>",
         "<div class='cookie-notice'>", "<div class='alert consent'>", "<div id='cookies' class='banner'>", "<section class='newsletter subscribe'>",
         "<div class='promo advertisement'>", "<p class='notice'>", "<div class='popup modal'>", "<div class='cookie-banner gdpr'>", "<div class='ad-slot'>", "<div class='sponsor promotion'>", "<div class='warning message'>", "<div class='signup login'>", "<div class='privacy-notice'>", "<ins class='adsbygoogle'>", "<div class='disclaimer'>", "<div role='alert'>", "<div class='werbung anzeige'>", "<div class='hinweis'>", "<div class='publicidad'>", "<div class='publicite'>")
_HEAD = ("<header>", "<div id='header'>", "<div class='site-header top'>", "<header class='masthead'>", "<div role='banner'>")
_FOOT = ("<footer>", "<div id='footer'>", "<div class='site-footer copyright'>", "<footer class='bottom'>", "<div role='contentinfo'>", "<div class='copyright'>", "<div class='fuss fusszeile'>", "<div id='impressum'>", "<div class='pied'>")
_TALK = ("<section class='comments'>", "<div id='comments'>", "<div class='comment-list'>", "<ol class='commentlist'>", "<div class='disqus thread'>", "<section id='reviews' class='comments'>",
         "<div class='responses comments-area'>", "<div class='leserkommentare kommentare'>", "<section id='commentaires'>", "<div class='comentarios'>", "<div class='kommentar liste'>", "<div class='reader-comments'>", "<section class='discussion replies'>", "<div class='user-comments feedback'>", "<aside class='comments'>")


def _marked(opening: str, label: int) -> str:
    return opening[:-1] + f" data-y='{label}'>"


def _closing(opening: str) -> str:
    return "</" + re.match(r"<(\w+)", opening)[1] + ">"


def labelled_page(rng: random.Random, inventing: float = 0.45) -> str:
    """A random page; ``data-y`` marks what is content (1) and what is not (0). inventing: how often its class words
    say nothing."""
    def words(n: int) -> str:
        return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))

    def sentence(short: bool = False) -> str:
        return words(rng.randint(1, 4) if short else rng.randint(5, 60)).capitalize() + "."

    invented = rng.random() < inventing
    brief = not invented and rng.random() < 0.12  # an article of a few words

    def box(opening: str, label: int, inner: str) -> str:
        if invented and rng.random() < 0.85:
            tag = re.match(r"<(\w+)", opening)[1]
            tag = "div" if tag in ("article", "main", "section", "footer") and rng.random() < 0.5 else tag
            names = " ".join(rng.choice(("", "x-", "css-")) + words(1) for _ in range(rng.randint(1, 3)))
            opening = f"<{tag} class='{names}'>" if rng.random() < 0.8 else f"<{tag}>"
        return _marked(opening, label) + inner + _closing(opening)

    def link(n: int = 2) -> str:
        return f"<a href='/{words(1)}'>{words(rng.randint(1, n))}</a>"

    def para() -> str:
        body = sentence(rng.random() < (0.95 if brief else 0.2))
        if rng.random() < 0.3:
            body += " " + link(4) + " " + sentence(True)
        if rng.random() < 0.2:
            body = f"<b>{body}</b>" + ("<br>" if rng.random() < 0.5 else "")
        return f"<p>{body}</p>" if rng.random() < 0.9 else f"<p>{body}"

    def listing(n: int) -> str:
        return "<ul>" + "".join(f"<li>{link(3)}</li>" for _ in range(n)) + "</ul>"

    def menu() -> str:
        o = rng.choice(_MENU)
        inner = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 9))) if o.startswith("<ul") else (
            listing(rng.randint(2, 9)) if rng.random() < 0.7 else " | ".join(link() for _ in range(rng.randint(2, 6))))
        return box(o, 0, inner)

    def side() -> str:
        inner = f"<h3>{words(2)}</h3>" + (listing(rng.randint(2, 6)) if rng.random() < 0.6 else "".join(f"<p>{sentence()}</p>" for _ in range(rng.randint(1, 3))))
        return box(rng.choice(_SIDE), 0, inner)

    def note() -> str:
        o = rng.choice(_NOTE)
        inner = sentence(rng.random() < 0.5)
        return box(o, 0, inner if o.startswith("<p") or rng.random() < 0.5 else f"<p>{inner}</p>")

    def talk() -> str:
        o = rng.choice(_TALK)
        one = "<li class='comment'>" if o.startswith("<ol") else rng.choice(("<div class='comment'>", "<article class='comment'>", "<div class='comment-body'>", "<div>"))
        said = "".join(one + (f"<span class='author'>{words(1)}</span>" if rng.random() < 0.5 else "") + "".join(f"<p>{sentence()}</p>" for _ in range(rng.randint(1, 3))) + _closing(one)
                       for _ in range(rng.randint(1, 6)))
        return box(o, 0, (f"<h2>{words(2)}</h2>" if rng.random() < 0.6 and not o.startswith("<ol") else "") + said)

    def content() -> str:
        parts = [f"<h1>{words(rng.randint(2, 10))}</h1>"] if rng.random() < 0.85 else []
        if parts and rng.random() < 0.08:
            parts = ["<header>" + parts[0] + "</header>"]
        for _ in range(rng.choice((0, 1, 1, 2, 3, 5, 8, 15))):
            kind = rng.random()
            if kind < 0.75:
                parts.append(para())
            elif kind < 0.82:
                parts.append(f"<h2>{words(rng.randint(1, 6))}</h2>")
            elif kind < 0.87:
                parts.append("<ul>" + "".join(f"<li>{sentence(rng.random() < 0.5)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote>{sentence()}</blockquote>")
            elif kind < 0.92:
                parts.append("<table>" + "".join(f"<tr><td>{words(2)}</td><td>{words(3)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.93:
                parts.append(f"<pre>{sentence()}</pre>")
            elif kind < 0.97:
                parts.append(note())
            else:
                parts.append(rng.choice((side, menu))())
        if not parts:
            parts = [para()]
        if rng.random() < 0.15:
            parts.append(talk())
        body = "".join(parts)
        if rng.random() < 0.2:
            body = rng.choice(_PLAIN) + body + "</div>"
        return box(rng.choice(_CONTENT), 1, body)

    top, bottom = [], []
    if rng.random() < 0.6:
        top.append(box(rng.choice(_HEAD), 0, (f"<h1>{words(2)}</h1>" if rng.random() < 0.75 else words(2)) + (f"<p>{sentence()}</p>" if rng.random() < 0.4 and not invented else "")
                       + (menu() if rng.random() < 0.5 else "")))
    for make, share in ((menu, 0.7), (note, 0.5), (side, 0.25)):
        if rng.random() < share:
            top.append(make())
    for make, share in ((talk, 0.3), (side, 0.4), (note, 0.3), (menu, 0.2)):
        if rng.random() < share:
            bottom.append(make())
    if rng.random() < 0.7:
        o = rng.choice(_FOOT)
        bottom.append(box(o, 0, sentence(rng.random() < 0.5) if rng.random() < 0.5 else f"<p>{sentence()}</p>" + (listing(3) if rng.random() < 0.4 else "")))
    rng.shuffle(top)
    middle = content()
    if rng.random() < 0.5:
        o = rng.choice(_PLAIN)
        inside = rng.choice(("middle", "all"))
        middle = o + middle + _closing(o) if inside == "middle" else o + "".join(top) + middle + _closing(o)
        top = top if inside == "middle" else []
    script = "<script>var t = '</p>' + 1;</script>" if rng.random() < 0.5 else ""
    form = f"<form><p>{sentence(True)}</p><input></form>" if rng.random() < 0.3 else ""
    return f"<!DOCTYPE html><html><head><title>{words(3)}</title></head><body>{script}{''.join(top)}{form}{middle}{''.join(bottom)}</body></html>"
