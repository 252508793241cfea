"""Main text of web pages from flat text blocks.

A page is read once into blocks: runs of text between block-level tags. Of
each block and its neighbours the number of words and the share of words in
links are known, and of the block which elements enclose it. A decision tree,
grown here on the labelled blocks of a small table of pages, keeps or drops each
block. Where elements mark the article, the tree uses that; elsewhere words and
link densities of a block and its neighbours decide. What class names say is
one feature among the others: it is needed for notices and comments that look
like the article's own text.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare, slices

#: Tags that end a block; fixed values.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content isn't text of the page; fixed values.
RAW_TAGS = frozenset("script style noscript template iframe svg math canvas object textarea title noframes audio video".split())
#: Elements that may enclose blocks and are remembered; fixed values.
SCOPES = frozenset("article aside body div footer form header main menu nav section ul ol table dl details dialog fieldset select button".split())
#: Elements that hold no article text, lists, and elements of forms; fixed values.
BESIDE_TAGS, LIST_TAGS, FORM_TAGS = frozenset("nav footer aside menu dialog".split()), frozenset("ul ol menu dl select".split()), frozenset("form select button fieldset".split())
#: Parts of names that say what isn't the article, what is, where something is, and parts that say nothing; fixed values.
BOILER_NAMES = frozenset(
    "ad ads advert advertisement adbox adsbygoogle banner outbrain taboola sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal newsletter subscribe signup sidebar rail widget "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar header masthead footer copyright disclaimer share sharing social related recommended trending "
    "comment comments commentlist replies reply disqus respond search login contentinfo complementary".split()
)
CONTENT_NAMES = frozenset("article post entry content story body text main".split())
PLACE_NAMES = frozenset("site page top bottom left right global primary secondary reader readers user users wrap wrapper container area section block box bar list inner outer item items links link form posts stories button buttons widget thread".split())
STATE_FIRST, STATE_LAST = frozenset("has no is with tag category js format status".split()), frozenset("on off open closed enabled disabled".split())

_TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?])")
_ATTR_END = re.compile(r"""[>"']""")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SEPARATOR = re.compile(r"[-_]+")
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=$|[\s=])|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW_TAGS}


@lru_cache(maxsize=4096)
def name_hint(attributes: str) -> str:
    """What an element's class, id and role say: ``header``, ``boiler``, ``content`` or nothing.

    A name counts if all its parts are known words and one of them tells; names
    of states (``has-sidebar``, ``comments-open``, ``tag-politics``) don't count.
    """
    hint = ""
    for token in _HUMP.sub("-", " ".join("".join(g) for g in _NAMES.findall(attributes))).lower().split():
        parts = [p for p in _SEPARATOR.split(token) if p and not p[0].isdigit()]
        if not parts or parts[0] in STATE_FIRST or parts[-1] in STATE_LAST or not all(p in BOILER_NAMES or p in CONTENT_NAMES or p in PLACE_NAMES for p in parts):
            continue
        telling = [p for p in parts if p in BOILER_NAMES]
        if telling:
            hint = "header" if set(telling) <= {"header", "masthead"} and hint != "boiler" else "boiler"
        elif not hint and any(p in CONTENT_NAMES for p in parts):
            hint = "content"
    return hint


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    inside: _Scope
    heading: bool


class _Scope(NamedTuple):
    """What is known of blocks in an element."""

    name: str
    article: bool = False  # in article or main
    content: bool = False  # in an element named as content
    beside: bool = False  # in nav, footer, aside, a page's header, a dialog or a hidden element
    form: bool = False
    named: bool = False  # in an element named as boilerplate
    wrapped: bool = False  # in an article that is itself in such an element
    listed: bool = False


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, in time linear in its length. Unclosed and truncated markup is read as far as it goes."""
    out: list[Block] = []
    held: list[str] = []
    linked: list[str] = []
    scopes = [_Scope("")]
    opened: Counter[str] = Counter()
    in_link = heading = 0
    at, n = 0, len(page)

    def text(piece: str) -> None:
        if piece:
            held.append(piece)
            if in_link:
                linked.append(piece)

    def close() -> None:
        if not held:
            return
        words = entities.unescape("".join(held)).split()
        if words:
            link_words = len(entities.unescape(" ".join(linked)).split()) if linked else 0
            out.append(Block(" ".join(words), len(words), min(link_words, len(words)), scopes[-1], bool(heading)))
        held.clear()
        linked.clear()

    while at < n:
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        if m.group() == "<!--":
            end = page.find("-->", m.end())
            at = n if end < 0 else end + 3
            continue
        # The tag's end: the first > outside quotes; if a quote never ends, the first >.
        end = m.end()
        while True:
            e = _ATTR_END.search(page, end)
            if not e:
                end = -1
                break
            if e.group() == ">":
                end = e.start()
                break
            quote = page.find(e.group(), e.end())
            if quote < 0:
                end = page.find(">", e.start())
                break
            end = quote + 1
        if end < 0:
            break  # cut off inside a tag
        attributes, at = page[m.end() : end], end + 1
        name = (m.group(2) or "").lower()
        closing = m.group(1) == "/"
        if not name:
            continue
        if name in RAW_TAGS and not closing:
            if attributes.endswith("/") and name in ("svg", "math", "iframe", "object"):
                continue
            over = _RAW_END[name].search(page, at)
            if name in BLOCK_TAGS or name in ("textarea", "iframe", "audio", "video"):
                close()
            end = page.find(">", over.end()) if over else -1
            at = n if end < 0 else end + 1
            continue
        if name == "a":
            in_link = 0 if closing else 1
        elif name in ("br", "img", "input"):
            text(" ")
        if name in BLOCK_TAGS:
            close()
            if name[0] == "h" and name[1:].isdigit():
                heading = 0 if closing else 1
            elif not closing:
                heading = 0
            if closing or name in ("p", "li", "div", "nav", "article", "footer"):
                in_link = 0
        if name not in SCOPES:
            continue
        if not closing:
            scopes.append(_inside(scopes[-1], name, attributes))
            opened[name] += 1
        elif opened[name]:  # what was opened since is closed with it, so each scope is left once
            while True:
                gone = scopes.pop().name
                opened[gone] -= 1
                if gone == name:
                    break
    close()
    return out


def _inside(outer: _Scope, name: str, attributes: str) -> _Scope:
    """The scope that an element opens. The outermost article or main takes back what names and forms around it said."""
    hint = name_hint(attributes) if "=" in attributes else ""
    _, article, content, beside, form, named, wrapped, listed = outer
    if name in ("article", "main"):
        if not article:
            article, form, wrapped, named = True, False, wrapped or named, False
    elif name != "body":
        if hint == "boiler" or (hint == "header" and not article and not content):
            named = True
        elif hint == "content":
            content = True
    beside = beside or name in BESIDE_TAGS or (name == "header" and not article and not content) or _HIDDEN.search(attributes) is not None
    return _Scope(name, article, content, beside, form or name in FORM_TAGS, named, wrapped, listed or name in LIST_TAGS)


#: Names of the features, in order: of words and links of a block and its neighbours, of elements, and of class names.
FEATURES = (
    "words", "density", "words before", "density before", "words after", "density after",
    "heading", "in list", "in article", "outside the article", "in an element beside the article",
    "in named content", "outside the named content", "in named boilerplate",
)
NEIGHBOURS, NAMES = slice(2, 6), slice(11, 14)


def features(found: list[Block]) -> np.ndarray:
    """A row for each block of a page. Words count to 200 and, before the first block and after the last, as none."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b.words for b in found], float)
    density = np.array([b.linked for b in found]) / words
    article, content, beside, form, named, wrapped, listed = np.array([b.inside[1:] for b in found], bool).T
    heading = np.array([b.heading for b in found], bool)
    beside = beside | form
    # An article in an element named as boilerplate is believed, unless the page has one that is not.
    named = named | (wrapped & (article & ~beside & ~named & ~wrapped).any())
    outside = ~article & (article & ~beside & ~named).any()
    unnamed = ~content & (content & ~beside & ~named).any()
    before, after = (lambda x: np.concatenate([[0], x[:-1]])), (lambda x: np.concatenate([x[1:], [0]]))
    w = np.minimum(words, 200)
    return np.column_stack([w, density, before(w), before(density), after(w), after(density), heading, listed, article, outside, beside, content, unnamed, named]).astype(float)


#: The labelled pages. A block's text begins with + (kept) or - (dropped). {s}, {m}, {l} and {x} stand for runs of 1 to 3,
#: 4 to 14, 15 to 60 and 1 to 60 words, {t} for a title, {B}, {C} and {A} for a class name of boilerplate, of content, of any kind.
_MENU, _ROW = "<li><a>-{s}</a></li><li><a>-{s}</a></li><li><a>-{s}</a></li>", "<a>{s}</a> | <a>{s}</a> | <a>{s}</a>"
LABELLED = (
    # The article is marked by an element: lengths say nothing.
    "<nav><ul>" + _MENU + "</ul></nav><div class={A}>-{x}</div><article><h1>+{t}</h1><p>+{x}</p><p>+{x}</p><p>+{x}</p></article><footer>-{x}</footer>",
    "<header><a>-{s}</a></header><main><h1>+{t}</h1><p>+{x}</p><ul><li>+{x}</li><li>+{s}</li></ul><p>+{x}</p><aside><p>-{x}</p><a>-{m}</a></aside></main><footer><p>-{x}</p><p><a>-{s}</a></p></footer>",
    "<article><h2>+{t}</h2><p>+{m} <a>{s}</a></p><p><a>+{m}</a></p><p>+{x}</p><form>-{m}<button>-{s}</button></form><p>+{x}</p><div class={B}><p>-{x}</p><p>-{x}</p></div></article><div>-{x}</div>",
    "<div>-{x}</div><article><h1>+{t}</h1><p>+{x}</p><ul><li><a>+{s}</a></li><li><a>+{m}</a></li></ul><p>+{x}</p><nav><a>-{s}</a></nav></article><div><p>-{x}</p><p>-{x}</p></div>",
    "<div class={B}><p>-{x}</p></div><article><table><tr><td>+{s}</td><td>+{s}</td></tr></table><p>+{x}</p><div class={C}><p>+{x}</p></div></article><footer><ul>" + _MENU + "</ul></footer>",
    "<div class={B}><article><h1>+{t}</h1><p>+{x}</p><p>+{x}</p></article><p>-{x}</p></div>",
    "<form><article><h1>+{t}</h1><p>+{x}</p><p>+{x}</p></article><input><p>-{s}</p></form>",
    "<article><h1>+{t}</h1><p>+{x}</p><section class={B}><article><p>-{x}</p></article><article><p>-{x}</p></article></section></article>",
    "<article><h1>+{t}</h1><p>+{x}</p><p>+{x}</p></article><div class={B}><article><h3>-{t}</h3><p>-{x}</p></article><article><p>-{x}</p></article></div>",
    # It is marked by a name, or what isn't it is.
    "<div class={B}>-{x} <a>{s}</a></div><div class={C}><h1>+{t}</h1><p>+{x}</p><p>+{x}</p><ul><li>+{x}</li></ul></div><div class={B}><p>-{x}</p><p>-{x}</p></div>",
    "<div>-{x}</div><div class={C}><h1>+{t}</h1><p>+{x}</p><p><a>+{m}</a></p><div class={B}><p>-{x}</p></div><p>+{x}</p></div><div>-{x}</div><div>-" + _ROW + "</div>",
    "<div class={B}>-" + _ROW + "</div><h1>+{t}</h1><p>+{l}</p><p>+{m}</p><p>+{l}</p><div class={B}><p>-{l}</p></div><div class={B}><h3>-{t}</h3><p>-{x}</p></div>",
    "<div class={B}><p>-{x}</p></div><p>+{l}</p><p>+{l}</p><p>+{s}</p><p>+{l}</p><div class={B}>-{x}</div>",
    # Nothing is marked: words and links of blocks and their neighbours tell.
    "<div>-" + _ROW + "</div><h1>+{t}</h1><p>+{l}</p><p>+{l}</p><p>+{m}</p><p>+{l}</p><div>-{s} <a>{m}</a></div><div>-" + _ROW + "</div>",
    "<ul>" + _MENU + "</ul><div>-{m}</div><h1>+{t}</h1><p>+{l}</p><p>+{s}</p><p>+{l}</p><p>+{l}</p><ul>" + _MENU + "</ul><div>-{m}</div>",
    "<ul>" + _MENU + "</ul><h1>+{t}</h1><p>+{l}</p><p>+{m}</p><p>+{l}</p><ul>" + _MENU + "</ul>",
    "<div><a>-{s}</a></div><div><a>-{m}</a> <a>{s}</a></div><h2>+{t}</h2><div>+{l}</div><div>+{l}</div><h2>+{t}</h2><div>+{l}</div><div><a>-{m}</a></div><div>-{s}</div>",
    "<div><a>-{s}</a></div><div><a>-{m}</a> <a>{s}</a></div><div>+{l}</div><div>+{l}</div><div>+{m}</div><div>+{l}</div><div><a>-{s}</a> <a>{s}</a></div><div>-{s}</div>",
    "<div><a>-{m}</a></div><div><a>-{l}</a></div><p>+{l}</p><p>+{l}<a>{s}</a></p><p>+{l}</p><div><a>-{l}</a> {s}</div><div><a>-{l}</a></div>",
    "<ul>" + _MENU + "</ul><p>+{l}</p><p>+{l}<a>{s}</a></p><p>+{l}</p><p>-<a>{m}</a> {s} <a>{s}</a></p>",
    "<h1>+{t}</h1><p>+{l}</p><p>+{l}</p><p>+{x}</p><p>+{l}</p>",
    "<p>+{l}</p><p>+{x}</p>", "<p>+{x}</p>", "<h1>+{t}</h1><p>+{x}</p>",
    "<p>+{l}</p><p><a>+{m}</a></p><p>+{l}</p><p>+{l}</p>",
)
#: Runs of words that each page is taken with.
VARIANTS = 24
_RUNS = {"s": (1, 3), "m": (4, 14), "l": (15, 60), "x": (1, 60), "t": (3, 12)}


def labelled(pages: tuple[str, ...] = LABELLED, variants: int = VARIANTS, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of the labelled pages, each page taken with several runs of words."""
    rng = random.Random(seed)
    boiler, content = sorted(BOILER_NAMES - {"header", "masthead"}), sorted(CONTENT_NAMES)

    def fill(m: re.Match) -> str:
        kind = m.group(1)
        if kind in _RUNS:
            return " ".join(["word"] * rng.randint(*_RUNS[kind]))
        return rng.choice({"B": boiler, "C": content, "A": [*boiler, *["c1", "x", "row"] * 20]}[kind])

    xs, ys = [], []
    for page in pages:
        for _ in range(variants):
            found = blocks(re.sub(r"\{(\w)\}", fill, page))
            xs.append(features(found))
            ys += [b.text[0] == "+" for b in found]
    return np.concatenate(xs), np.array(ys, float)


class Tree:
    """A binary decision tree grown by Gini impurity; leaves hold ``least`` blocks or more."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 3):
        self.least = least
        self.root = self._grow(x, y, depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        share = float(y.mean())
        if depth == 0 or share in (0.0, 1.0):
            return share >= 0.5
        best = None
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, kept = x[order, f], np.cumsum(y[order])
            at = np.flatnonzero(v[1:] > v[:-1]) + 1  # rows below the cut
            at = at[(at >= self.least) & (at <= len(y) - self.least)]
            if len(at):
                low = kept[at - 1]
                high = kept[-1] - low
                gini = low * (at - low) / at + high * (len(y) - at - high) / (len(y) - at)
                i = int(np.argmin(gini))
                if best is None or gini[i] < best[0] - 1e-9:
                    best = (gini[i], f, (v[at[i]] + v[at[i] - 1]) / 2)
        if best is None:
            return share >= 0.5
        _, f, cut = best
        low = x[:, f] < cut
        return f, float(cut), self._grow(x[low], y[low], depth - 1), self._grow(x[~low], y[~low], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if isinstance(node, bool):
                out[rows] = node
            elif len(rows):
                f, cut, low, high = node
                below = x[rows, f] < cut
                stack += [(low, rows[below]), (high, rows[~below])]
        return out


@lru_cache(maxsize=1)
def tree() -> Tree:
    return Tree(*labelled())


def main_text(page: str | None, grown: Tree | None = None) -> str:
    found = blocks(page or "")
    keep = (grown or tree()).predict(features(found))
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (empty if none), n_chars (code points).

    Null html is empty, and so is the text of an empty page. Pages of any length
    are read whole, in time linear in it. Repeated page_ids and equal pages give
    a row each; an empty table gives none; other columns are ignored. One narrow
    pass: the tree is grown once in the driver and goes with the tasks.
    """
    prepare(pages.sparkSession)
    grown = tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(p, grown) for p in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
