"""Main text of web pages: blocks labelled content or boilerplate by a minimum cut."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from evalspark.llm.common import plain

# Element roles of HTML and name parts that sites give to what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe select option".split())  # nothing that a page shows as text
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A) for tag in RAW}
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead
tr ul""".split())
ASIDE = frozenset("nav footer aside form menu dialog button header".split())
MAIN = frozenset("article main".split())
CLOSES = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
ASIDE_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|disqus|footer|header|login|masthead|menu|modal|nav"
                        r"|navbar|navigation|newsletter|notices?|pager|pagination|popup|promo\w*|related|replies|respond|share|sharing|sidebar"
                        r"|signup|skip|social|sponsor\w*|subscribe|toolbar|topbar|widget)(?:$|[\s_-])", re.I)
MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text)(?:$|[\s_-])", re.I)
WHITE = re.compile(r"\s+")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.S)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
UNIT = 10


@dataclass
class Block:
    """A stretch of text without a block boundary: its raw text, the part of it in links, and the open elements."""

    path: tuple[tuple[int, str, str], ...]
    text: list[str] = field(default_factory=list)
    linked: int = 0


def blocks_of(html: str) -> list[Block]:
    """Blocks in page order. End tags that may be left out are supplied; raw elements end only at their own end tag."""
    stack: list[tuple[int, str, str]] = []
    out, current, links, made, at = [], None, 0, 0, 0
    while at < len(html):
        m = TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                if current is None:
                    current = Block(tuple(stack))
                    out.append(current)
                current.text.append(m[0])
                current.linked += len(m[0].strip()) if links else 0
            continue
        tag = tag.lower()
        if not m[1]:
            if tag in RAW:
                if not m[3].rstrip().endswith("/"):
                    end = RAW_END[tag].search(html, at)
                    at = len(html) if end is None else end.start()
                continue
            for open_tag, by in CLOSES.items():
                if tag in by and any(s[1] == open_tag for s in stack[-3:]):
                    while stack and stack.pop()[1] != open_tag:
                        pass
            if tag in VOID:
                if tag == "br" and current is not None:
                    current.text.append(" ")
                if tag == "hr":
                    current = None
                continue
            names = " ".join(a or b or c for a, b, c in NAMES.findall(m[3]))
            made += 1
            if tag in BLOCK:
                stack.append((made, tag, names))
                current = None
            links += tag == "a"
        elif tag == "a":
            links = max(0, links - 1)
        elif tag in BLOCK:
            if any(s[1] == tag for s in stack):
                while stack.pop()[1] != tag:
                    pass
            current = None
    return out


def costs(b: Block, text: str) -> tuple[int, int]:
    """What it costs to call the block boilerplate, and to call it content: the positive and the negative part of a
    linear score over roles of the open elements, their names, links, length and sentence ends."""
    score = 0
    for depth, (_, tag, names) in enumerate(b.path):
        in_main = any(p[1] in MAIN for p in b.path[:depth])
        if tag in ASIDE:
            score -= 20 if tag == "header" and in_main else 80
        elif tag in MAIN:
            score += 40
        if names and tag not in ("html", "body"):
            score -= 80 * bool(ASIDE_NAME.search(names)) * (tag not in MAIN)
            score += 15 * bool(MAIN_NAME.search(names))
    length = len(text)
    score += min(20, length // 20) - 10
    score -= 40 * b.linked // max(1, length)
    score += 6 * bool(text[-1] in ".!?…。\"”»") + 10 * bool(b.path and b.path[-1][1] in ("p", "h1", "pre", "blockquote"))
    return max(0, score) * UNIT, max(0, -score) * UNIT


def minimum_cut(keep: list[int], drop: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut: capacity keep from the source, drop to the sink, and
    undirected edges between nodes. Shortest augmenting paths in level graphs; terminals settle against each other first."""
    n = len(keep)
    source, sink = n, n + 1
    to: list[list[int]] = [[] for _ in range(n + 2)]
    head, room = [], []

    def link(a: int, b: int, there: int, back: int) -> None:
        to[a].append(len(head))
        head.append(b)
        room.append(there)
        to[b].append(len(head))
        head.append(a)
        room.append(back)

    for i, (k, d) in enumerate(zip(keep, drop)):
        both = min(k, d)
        if k > both:
            link(source, i, k - both, 0)
        elif d > both:
            link(i, sink, d - both, 0)
    for a, b, w in edges:
        link(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in to[u]:
                if room[e] and level[head[e]] < 0:
                    level[head[e]] = level[u] + 1
                    queue.append(head[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        tried = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if not room[e])
                u = head[path[cut] ^ 1]
                del path[cut:]
                continue
            while tried[u] < len(to[u]):
                e = to[u][tried[u]]
                if room[e] and level[head[e]] == level[u] + 1:
                    path.append(e)
                    u = head[e]
                    break
                tried[u] += 1
            else:
                if not path:
                    break
                level[u] = -1
                u = head[path.pop() ^ 1]


def main_text(html: str | None) -> str:
    """Blocks on the content side of the cut, in page order, one per line. Neighbours in the page are tied together, and
    more so the more open elements they share; so are successive blocks of one parent."""
    found = []
    for b in blocks_of(html or ""):
        text = WHITE.sub(" ", unescape("".join(b.text))).strip()
        if text:
            found.append((b, text))
    terminal = [costs(b, t) for b, t in found]
    edges, last = [], {}
    for i, (b, _) in enumerate(found):
        if i:
            before = found[i - 1][0].path
            shared = sum(x == y for x, y in zip(before, b.path))
            edges.append((i - 1, i, 8 * UNIT * shared // max(len(before), len(b.path), 1)))
        parent = b.path[:-1]
        if parent in last and last[parent] < i - 1:
            edges.append((last[parent], i, 4 * UNIT))
        last[parent] = i
    side = minimum_cut([t[0] for t in terminal], [t[1] for t in terminal], edges)
    return "\n".join(t for (_, t), s in zip(found, side) if s)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row. Map-only. NULL or empty html, and pages without an article,
    give an empty text. Whole pages are read, of any length. Other columns are not read."""
    base = plain(pages, page_id=id_col, url=url_col, html=html_col)
    kinds = dict(base.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return base.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
