"""HTML extraction: labelling blocks as content or boilerplate by a minimum cut.

A page is read into blocks of text.  A linear classifier gives each block its
costs of being content or boilerplate, which become its capacities to the two
terminals.  Blocks that follow each other and blocks that are close in the
DOM are joined by smoothness edges, weak ones where the blocks' surroundings
differ (one in a menu, the other in an article).  The minimum cut, found by
max-flow, labels the blocks: a line of links or a word by itself goes with the
article around it, whatever its own costs say.  All costs are of the edges'
order, so none is a veto.  Blocks whose own cost outweighs all their edges are
settled beforehand: a minimum cut with that label exists, so the flow only has
to run over what is left.

Defined results: a null or empty page, or one without content, gives an empty
text; unclosed elements end where HTML would end them or with the page; a tag
or comment that never ends is text or runs to the page's end; very long pages
are read in one pass whose time grows with their length; where both labels cost
the same, a block is boilerplate; repeated rows give repeated results; an empty
table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# -- fixed values: kinds of elements and words of class and id attributes
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
SILENT = frozenset("script style noscript template svg math iframe object textarea select button canvas audio video title head".split())
FIELDS = frozenset("form fieldset input label option legend dialog menu nav aside".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "masthead topbar footer copyright sidebar cookie cookies consent gdpr popup modal overlay paywall newsletter subscribe subscription signup login "
    "share sharing comment comments comentarios kommentare commentaires disqus reactions".split()
)
#: Words that boilerplate often has, and articles sometimes.
LIKELY_WORDS = frozenset(
    "header foot legal toc aside rail widget related recommended recommendations popular trending teaser notice notices alert social follow "
    "reply replies respond form search tags".split()
)
CONTENT_WORDS = frozenset("article content main post entry story body text".split())

_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_MARK = re.compile("[>\"']")
_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in SILENT}
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"\shidden(?:[\s=>/]|$)|display\s*:\s*none", re.I)
_NAMES = re.compile(r"[a-z]+")


class Block:
    """``against`` is what its elements say against it, ``ground`` the element that says most of it, ``words`` for it."""

    __slots__ = ("text", "tag", "links", "path", "against", "ground", "words", "inside")

    def __init__(self, text: str, tag: str, links: int, path: int, against: float, ground: int, words: int, inside: bool):
        self.text, self.tag, self.links, self.path, self.against, self.ground, self.words, self.inside = text, tag, links, path, against, ground, words, inside


def tags_of(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of the tags; name is empty for what holds no text, as comments and scripts.

    The page is gone over once: what is looked for in vain (a quote, the end of
    a comment) is remembered, so nothing is looked for twice.
    """
    n, at = len(page), 0
    last = page.rfind(">")
    gone: set[str] = set()  # quotes that don't occur any more
    strict = True  # whether quoted ">" belong to attributes
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        if start >= last:
            return  # no tag ends any more
        m = _NAME.match(page, start)
        if m is None:
            if page[start + 1] in "!?/":
                at = page.find(">", start) + 1
                yield start, at, "", False, ""
            else:
                at = start + 1
            continue
        end = -1
        if strict:
            i = m.end()
            while (x := _MARK.search(page, i)) is not None:
                if x[0] == ">":
                    end = x.start()
                    break
                i = x.end()
                if x[0] not in gone:
                    close = page.find(x[0], i)
                    if close < 0:
                        gone.add(x[0])
                    else:
                        i = close + 1
            strict = end >= 0
        if end < 0:
            end = page.find(">", m.end())
        name, closing = m[1].lower(), page[start + 1] == "/"
        at = end + 1
        if name in SILENT and not closing:
            x = _ENDS[name].search(page, at)
            if x is None and name == "head":
                yield start, at, "", False, ""
                continue
            at = n if x is None else x.end()
            yield start, at, "", False, ""
        else:
            yield start, at, name, closing, page[m.end() : end]


def blocks_of(page: str) -> tuple[list[Block], list[int]]:
    """The page's blocks in order, and the parent of each element that holds any."""
    blocks: list[Block] = []
    parents = [-1]
    # (tag, element, against, ground, words, inside an article)
    stack: list[tuple[str, int, float, int, int, bool]] = [("", 0, 0.0, 0, 0, False)]
    open_tags: Counter[str] = Counter()
    pieces: list[str] = []
    links = 0
    link_from = -1

    def flush() -> None:
        nonlocal pieces, links, link_from
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                if link_from >= 0:
                    links += sum(map(len, pieces[link_from:]))
                tag, element, against, ground, words, inside = stack[-1]
                blocks.append(Block(text, tag, min(links, len(text)), element, against, ground, words, inside))
            pieces = []
        links = 0
        link_from = 0 if link_from >= 0 else -1

    def pop(to: int) -> None:
        for x in stack[to:]:
            open_tags[x[0]] -= 1
        del stack[to:]

    at = 0
    for start, end, tag, closing, attrs in tags_of(page):
        if start > at:
            piece = page[at:start]
            pieces.append(unescape(piece) if "&" in piece else piece)
        at = end
        if tag == "a":
            if closing:
                if link_from >= 0:
                    links += sum(map(len, pieces[link_from:]))
                link_from = -1
            elif link_from < 0:
                link_from = len(pieces)
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in BLOCKS:
            continue
        flush()
        if closing:
            if open_tags[tag] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        pop(i)
                        break
                    if tag == "p" and stack[i][0] not in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                        break
            link_from = -1
            continue
        top = stack[-1][0]
        if top == "p" or tag == "li" == top or (tag in ("td", "th") and top in ("td", "th")) or (tag == "tr" and top in ("td", "th", "tr")) or (tag in ("dt", "dd") and top in ("dt", "dd")):
            while len(stack) > 1 and stack[-1][0] in ("p", "li", "td", "th", "dt", "dd") or (tag == "tr" and stack[-1][0] == "tr"):
                top = stack[-1][0]
                pop(len(stack) - 1)
                if top != "p" and not (tag == "tr" and top in ("td", "th")):
                    break
        if tag == "hr":
            continue
        _, element, against, ground, words, inside = stack[-1]
        parents.append(element)
        own = 0.0
        if tag in ("article", "main"):
            inside = True
        elif tag in FIELDS or (tag in ("footer", "header") and not inside):
            own = AGAINST_ELEMENT
        elif tag == "footer":
            own = AGAINST_LIKELY
        if attrs:
            names = set()
            for value in _ATTR.findall(attrs):
                names.update(_NAMES.findall(value.lower()))
            if names and tag not in ("article", "main", "body", "html"):
                if names & BOILER_WORDS:
                    own = max(own, AGAINST_WORD)
                elif names & LIKELY_WORDS:
                    own = max(own, AGAINST_LIKELY)
            if names & CONTENT_WORDS:
                words += 1
            if _HIDDEN.search(attrs):
                own = AGAINST_HIDDEN
        if own > against:
            against, ground = own, len(parents) - 1
        stack.append((tag, len(parents) - 1, against, ground, words, inside))
        open_tags[tag] += 1
    if at < len(page):
        piece = page[at:]
        pieces.append(unescape(piece) if "&" in piece else piece)
    flush()
    return blocks, parents


#: What menus, forms and the like, class names and hidden elements say against a block.
AGAINST_ELEMENT, AGAINST_WORD, AGAINST_LIKELY, AGAINST_HIDDEN = 8.0, 8.0, 3.0, 12.0
#: Weights of the classifier, in units of a smoothness edge between neighbours.
W_INSIDE, W_OUTSIDE, W_WORDS, W_LINKS, W_SENTENCE, W_LONG, W_SHORT, W_TITLE, W_ROW = 2.5, -2.5, 1.0, -2.5, 1.0, 3.0, -1.0, 1.5, -0.5
#: Smoothness of blocks that follow each other, and of blocks near in the DOM; less of it on different ground.
ADJACENT, SIBLING, COUSIN, OTHER_GROUND = 1.0, 1.5, 0.5, 0.125


def costs(blocks: list[Block]) -> list[float]:
    """Net cost of calling each block boilerplate: above 0 it looks like content."""
    framed = any(b.inside and b.against <= AGAINST_LIKELY for b in blocks)
    out = []
    for b in blocks:
        n = len(b.text)
        s = W_WORDS * min(b.words, 2) + W_LINKS * (b.links / n) - b.against
        if framed:
            s += W_INSIDE if b.inside else W_OUTSIDE
        s += W_SENTENCE + W_LONG * min(1.0, n / 200) if n >= 60 or b.text[-1:] in ".!?" else W_SHORT
        if b.tag in ("h1", "h2", "h3"):
            s += W_TITLE
        elif b.tag in ("li", "td", "th", "option", "div"):
            s += W_ROW
        out.append(s)
    return out


def smoothness(blocks: list[Block], parents: list[int]) -> list[tuple[int, int, float]]:
    """Edges between neighbours on the page and between blocks near in the DOM."""
    edges = []
    last: dict[int, int] = {}

    def edge(j: int, i: int, w: float) -> None:
        a, b = blocks[j], blocks[i]
        edges.append((j, i, w if a.ground == b.ground and a.inside == b.inside else w * OTHER_GROUND))

    for i, b in enumerate(blocks):
        if i:
            edge(i - 1, i, ADJACENT)
        up = parents[b.path]
        if up >= 0:
            j = last.get(up)
            if j is not None:
                edge(j, i, SIBLING)
            last[up] = i
            high = parents[up]
            if high >= 0:
                j = last.get(~high)
                if j is not None and parents[blocks[j].path] != up:
                    edge(j, i, COUSIN)
                last[~high] = i
    return edges


def min_cut(net: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of a minimum cut: true on the side of the content terminal.

    Blocks whose net cost is at least the weight of their open edges are settled
    first; their edges then count towards their neighbours' costs.
    """
    n = len(net)
    net = list(net)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(net[i]) >= sum(near[i].values()) - 1e-12:
            label[i] = net[i] > 0
            for j, w in near[i].items():
                net[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    open_nodes = [i for i in range(n) if label[i] is None]
    if open_nodes:
        for i, side in zip(open_nodes, _flow_sides(open_nodes, net, near)):
            label[i] = side
    return [bool(x) for x in label]


def _flow_sides(nodes: list[int], net: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Dinic's max-flow over the open blocks; which of them the content terminal reaches in the end."""
    index = {v: k for k, v in enumerate(nodes)}
    src, dst = len(nodes), len(nodes) + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(len(nodes) + 2)]

    def arc(a: int, b: int, c: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for v, k in index.items():
        if net[v] > 0:
            arc(src, k, net[v], 0.0)
        elif net[v] < 0:
            arc(k, dst, -net[v], 0.0)
        for u, w in near[v].items():
            if index[u] > k:
                arc(k, index[u], w, w)
    while True:
        depth = [-1] * len(out)
        depth[src] = 0
        queue = deque([src])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > 1e-9 and depth[to[e]] < 0:
                    depth[to[e]] = depth[a] + 1
                    queue.append(to[e])
        if depth[dst] < 0:
            return [depth[k] >= 0 for k in range(len(nodes))]
        tried = [0] * len(out)
        while True:
            path: list[int] = []
            a = src
            while a != dst:
                while tried[a] < len(out[a]):
                    e = out[a][tried[a]]
                    if cap[e] > 1e-9 and depth[to[e]] == depth[a] + 1:
                        break
                    tried[a] += 1
                else:
                    if not path:
                        break
                    a = to[path.pop() ^ 1]
                    tried[a] += 1
                    continue
                path.append(e)
                a = to[e]
            if a != dst:
                break
            push = min(cap[e] for e in path)
            for e in path:
                cap[e] -= push
                cap[e ^ 1] += push


def main_text(page: str | None) -> str:
    """The article of a page: its content blocks, joined by empty lines."""
    if not page:
        return ""
    blocks, parents = blocks_of(page)
    keep = min_cut(costs(blocks), smoothness(blocks, parents))
    return "\n\n".join(b.text for b, k in zip(blocks, keep) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars.  Pages are independent: one pass, no shuffle."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
