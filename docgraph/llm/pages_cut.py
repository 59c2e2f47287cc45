"""Main text of web pages by minimum-cut labelling.

A page becomes the sequence of its text blocks. A linear classifier gives each block a cost for either label
(terminal capacities); neighbouring blocks and blocks close in the DOM are tied by smoothness edges; the
minimum cut of that graph separates content from boilerplate. Blocks inside elements that never hold main
text (scripts, styles, forms, navigation and the like) are tied to the boilerplate side for good.

Defined cases: a null or empty page gives an empty text; unclosed and stray tags are taken as browsers do in
the main (a new paragraph ends the last one, an end tag closes up to its element, and is ignored if there is
none); a page cut off in the middle of a tag, a comment or a script ends there.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import map_slices

#: Element names by their role in a page.
RAW = frozenset("script style noscript template iframe textarea title svg select canvas audio video".split())
NEVER = RAW | frozenset("head form button nav footer aside dialog menu option input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul center head".split())
CLOSES_P = BLOCK - frozenset("html body head".split())
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that mark boilerplate or content.
BAD_WORDS = frozenset("ad ads adv advert advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer foot bottom sidebar side aside widget related recommended popular trending share sharing social follow subscribe newsletter signup login register cookie cookies consent gdpr notice notification alert popup modal overlay disclaimer copyright legal comment comments comment-list discussion disqus reply replies respond reaction pagination pager tags tagcloud search form toolbar hidden complementary contentinfo".split())
GOOD_WORDS = frozenset("article content main post entry story body text maincontent articlebody".split())
#: First words of compound class names that speak of other things than their element (with-sidebar, category-legal).
ABOUT_WORDS = frozenset("with no has have without category cat tag type format status topic section layout js is".split())
#: First words that name what an element belongs to; its last word says what it is (post-comments, entry-footer).
PART_WORDS = frozenset("post page entry article".split())
#: Last words of compound names that speak of a state (nav-open, ad-free, social-share-enabled).
STATE_WORDS = frozenset("open opened close closed enabled disabled free active inactive visible on off collapsed expanded ready loaded less driven".split())
#: Names of reader comments, alone or before a word for a container.
COMMENT_WORDS = frozenset("comment comments commentlist discussion disqus response responses reply replies reactions".split())
CONTAINER_WORDS = frozenset("area list section wrapper container wrap box block thread item inner".split())
#: Of the former, those that only name a part where a content word stands beside them (article-header).
HEADER_WORDS = frozenset("header top masthead".split())

_TOKEN = re.compile(r"<!--|<!\[CDATA\[|<[!?]|</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_TAG_END = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*>""")
_SPACES = re.compile(r"[\s]+")
_WORD_SPLIT = re.compile(r"[^a-z0-9]+")

#: Fixed weights of the block classifier, in nats for content: bias, words, link share, sentence end, heading,
#: in article/main, boilerplate word near, content word near, paragraph, list item.
WEIGHTS = np.array([-0.6, 0.35, -3.5, 0.8, 0.2, 3.0, -9.0, 1.2, 1.2, -0.4])
#: How much a boilerplate word in a compound name counts against a name of its own, and what is left of a wrapper's
#: word below a content element.
COMPOUND, THROUGH = 0.7, 0.3
#: Smoothness between neighbours in the page, at DOM distance 0, and what each step in the DOM takes off.
SMOOTH, DECAY = 1.2, 0.45
NEVER_COST = 1e6
#: DOM distance from which on blocks count as unrelated.
FAR = 12


@dataclass
class Block:
    text: str
    node: "_Node"
    features: list[float]
    never: bool


class _Node:
    __slots__ = ("tag", "depth", "bad", "good", "never", "article", "in_article", "comments", "parent")

    def __init__(self, tag: str, attributes: str, parent: "_Node | None") -> None:
        self.tag, self.depth, self.parent = tag, parent.depth + 1 if parent else 0, parent
        names, hidden, roles = "", "", ""
        for name, a, b, c in _ATTRIBUTE.findall("" if tag in ("html", "body") else attributes):
            value = a or b or c
            low = name.lower()
            # labels for readers are free text and say nothing about the element's part in the page
            if low in ("class", "id", "role", "itemprop"):
                names += " " + value.lower()
                roles += " " + value.lower() if low in ("role", "itemprop") else ""
            elif low == "hidden" or low == "aria-hidden" and value.lower() == "true" or low == "style" and "display:none" in value.lower().replace(" ", ""):
                hidden = "hidden"
        whole = names.split()
        compound = [t for t in (_WORD_SPLIT.split(n) for n in whole) if len(t) > 1 and t[0] not in ABOUT_WORDS and t[-1] not in STATE_WORDS]
        words = set(whole) | {w for t in compound for w in (t[-1:] if t[0] in PART_WORDS else t)}
        good = (set(whole) | {w for t in compound for w in t}) & GOOD_WORDS
        bad = BAD_WORDS - (HEADER_WORDS if good else frozenset())
        reader = bool(set(whole) & COMMENT_WORDS) or any(t[-1] in COMMENT_WORDS or t[0] in COMMENT_WORDS and (t[-1] in CONTAINER_WORDS or t[-1].isdigit()) for t in compound)
        own = 1.0 if hidden or set(whole) & bad or reader else COMPOUND if words & bad else 0.0
        said = set(roles.split())
        is_article = tag == "article" or bool(said & {"article", "articlebody"})
        root = is_article or tag == "main" or bool(set(whole) & {"main", "maincontent", "articlebody"})
        outer = root and not (parent and parent.in_article)
        if outer and not reader and not hidden:
            own = 0.0  # what an article is called is its subject
        # a wrapper's name counts for what it wraps, less below an element that says it holds the content, unless they
        # are reader comments, each of which may be an article
        self.comments = reader or bool(parent and parent.comments)
        through = THROUGH if outer and not self.comments else 1.0
        self.bad = max(own, (parent.bad if parent else 0.0) * through)
        self.good = bool(good) or bool(parent and parent.good)
        self.never = tag in NEVER or bool(hidden) or bool(parent and parent.never) or tag == "header" and not (parent and parent.article)
        self.in_article = is_article or bool(parent and parent.in_article)
        self.article = tag in ("article", "main") or bool(said & {"main", "article", "articlebody"}) or bool(parent and parent.article)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with features and DOM paths."""
    out: list[Block] = []
    root = _Node("html", "", None)
    stack = [root]
    parts: list[str] = []
    linked = 0
    owner = root

    def flush() -> None:
        nonlocal parts, linked
        text = _SPACES.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            n = text.count(" ") + 1
            tags = owner.tag
            out.append(Block(text, owner, [1.0, min(math.log1p(n), 4.0), min(1.0, linked / len(text)), float(text[-1] in ".!?:;\"'”»…"), float(tags in HEADINGS), float(owner.article), float(owner.bad), float(owner.good), float(tags == "p"), float(tags == "li")], owner.never))
        parts, linked = [], 0

    def block_owner() -> _Node:
        for node in reversed(stack):
            if node.tag in BLOCK or node.tag in NEVER:
                return node
        return root

    def add(text: str) -> None:
        nonlocal linked, owner
        if not text:
            return
        if not parts:
            owner = block_owner()
        parts.append(text)
        if any(node.tag == "a" for node in stack[-6:]):
            linked += len(text.strip())

    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        opened = found[0]
        if opened == "<!--":
            stop = page.find("-->", found.end())
            at = end if stop < 0 else stop + 3
            continue
        if found[1] is None:
            stop = page.find(">", found.end())
            at = end if stop < 0 else stop + 1
            continue
        closing = _TAG_END.match(page, found.end())
        if not closing:
            stop = page.find(">", found.end())
            if stop < 0:
                break
            attributes, at = page[found.end() : stop], stop + 1
        else:
            attributes, at = page[found.end() : closing.end() - 1], closing.end()
        tag = found[1].lower()
        if opened.startswith("</"):
            if tag in BLOCK or tag in NEVER:
                if any(node.tag == tag for node in stack[1:]):
                    flush()
                    while stack.pop().tag != tag:
                        pass
                elif tag == "p":
                    flush()
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i]
                        break
                    if stack[i].tag in BLOCK:
                        break
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCK or tag in NEVER:
            flush()
            if tag in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        del stack[i:]
                        break
                    if stack[i].tag in BLOCK:
                        break
            if tag in SIBLINGS:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if stack[i].tag in SIBLINGS[tag]:
                        break
        node = _Node(tag, attributes, stack[-1])
        if tag in RAW:
            stop = re.compile(f"</{re.escape(tag)}", re.IGNORECASE).search(page, at)
            if not stop:
                break
            close = page.find(">", stop.end())
            at = end if close < 0 else close + 1
            continue
        if not attributes.endswith("/"):
            stack.append(node)
    flush()
    return out


def distance(a: _Node, b: _Node) -> int:
    """Steps in the DOM from one block's element to the other's, FAR at most."""
    steps = 0
    while a is not b and steps < FAR:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def minimum_cut(costs: np.ndarray, edges: list[tuple[int, int, float]]) -> list[bool]:
    """Content labels of the minimum cut. costs[i] > 0: what calling block i boilerplate costs; < 0: what
    calling it content costs. Max-flow by shortest augmenting paths with level graphs."""
    n = len(costs)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def tie(a: int, b: int, forth: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(forth)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, c in enumerate(costs.tolist()):
        if c > 0:
            tie(source, i, c, 0.0)
        elif c < 0:
            tie(i, sink, -c, 0.0)
    for a, b, w in edges:
        tie(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                pushed = min(room[e] for e in path)
                for e in path:
                    room[e] -= pushed
                    room[e ^ 1] += pushed
                first = next(k for k, e in enumerate(path) if room[e] <= tiny)
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            while turn[a] < len(head[a]):
                e = head[a][turn[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(head[a]):
                path.append(head[a][turn[a]])
                a = to[path[-1]]
            elif not path:
                break
            else:
                level[a] = -1
                a = to[path.pop() ^ 1]


def main_text(page: str | None, weights: np.ndarray = WEIGHTS, smooth: float = SMOOTH, decay: float = DECAY) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    costs = np.array([b.features for b in found]) @ weights
    costs = np.where([b.never for b in found], -NEVER_COST, costs)
    edges = []
    last_at: dict[int, int] = {}
    for i, block in enumerate(found):
        if i:
            edges.append((i - 1, i, smooth * decay ** distance(found[i - 1].node, block.node)))
        # DOM proximity: the last block below the same parent, though others may stand between
        parent = id(block.node.parent)
        if parent in last_at and last_at[parent] != i - 1:
            edges.append((last_at[parent], i, smooth * decay**2))
        last_at[parent] = i
    return "\n".join(b.text for b, keep in zip(found, minimum_cut(costs, edges)) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p) for p in part.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_slices(slim, "html", step, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
