"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks, the texts between block-level tags, and the elements around them; both are nodes of a graph.
A linear classifier gives each node's cost of being boilerplate or content, which becomes its capacity to the source or
the sink: a block is judged by its text, an element by its tag, role and class names, once for each block beneath it.
Edges keep labels smooth: between neighbours in the page, heavier the closer they stand in the DOM, and between an element
and what it holds.  The maximum flow's cut is the labelling of least total cost, and blocks on the source's side are the
text.  So neither mark decides alone: a mark outweighs the text of its blocks, long texts outweigh their short neighbours,
and an article that holds little of a page's text doesn't outweigh the rest.  Where pages have no marks, texts and links, and the
part of the page that most of its words stand in, tell its article from what is around it.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?", re.S)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose content is no text of the page; it ends at their own end tag only.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label map mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_DROPPED_TAGS = set("nav footer aside form button select option datalist menu dialog canvas svg math audio video object head fieldset legend output".split())
_DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
_DROPPED_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead comment comments disqus "
    "commentlist respond reply replies cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets toolbar "
    "search pagination pager topbar skip form".split()
)
_ARTICLE_NAMES = {"article", "entry", "post", "story", "content", "main", "body", "text"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "a": {"a"}}
_SCOPES = {"article", "main", "section", "div", "ul", "ol", "dl", "table", "nav", "aside", "header", "footer", "form", "body"}
#: Elements that stand for the page, which has no label.
_WHOLE = {"html", "body"}
#: Capacities are whole numbers: costs times this.
_SCALE = 1000


#: What fit_costs finds on pages that hold articles, adverts, menus and footers: evidence for content is positive.
WEIGHTS = {"bias": -0.196, "words": 0.546, "links": -1.016, "heading": 0.473, "item": -1.016, "apart": -1.174, "marked": -1.693, "article": 1.333, "outside": -1.174}
#: A text's cost at most, an element's pull on each block beneath it, and the pull of neighbours in one element: a mark
#: outweighs text and pulls together, and a pull outweighs a text.
TEXT_MOST, PULL, NEAR = 0.6, 1.5, 0.6


#: What share of a page's words an element holds that is taken for the page's main part.
BULK = 0.6

#: Levels of the DOM; deeper elements stand side by side on the last one, as in browsers, which limit the depth too.
MOST_DEPTH = 128


class Block:
    __slots__ = ("holder", "linked", "tag", "text")

    def __init__(self, text: str, tag: str, holder: int, linked: float):
        self.text, self.tag, self.holder, self.linked = text, tag, holder, linked


class Page:
    """Blocks in page order and the elements that hold them, by number in page order; element 0 is the page."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.parent, self.depth, self.marked, self.article = [-1], [0], [False], [False]
        self.bulk = 0  # the main part, which features finds

    def add(self, parent: int, marked: bool, article: bool) -> int:
        if self.depth[parent] >= MOST_DEPTH:
            marked, article = marked or self.marked[parent], article or self.article[parent]
            parent = self.parent[parent]
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.marked.append(marked)
        self.article.append(article)
        return len(self.parent) - 1

    def clear_marks(self) -> None:
        """Marks around an article with more than half of the page's words, such as a wrapper's name, say nothing of it."""
        words = [0] * len(self.parent)
        for b in self.blocks:
            words[b.holder] += b.text.count(" ") + 1
        for i in range(len(words) - 1, 0, -1):
            words[self.parent[i]] += words[i]
        for i in range(1, len(words)):
            if self.article[i] and 2 * words[i] > words[0]:
                i = self.parent[i]
                while i > 0:
                    self.marked[i] = False
                    i = self.parent[i]
                return

    def apart(self, a: int, b: int) -> int:
        """Steps from element a to element b in the DOM."""
        steps, parent, depth = 0, self.parent, self.depth
        while a != b:
            if depth[a] >= depth[b]:
                a = parent[a]
            else:
                b = parent[b]
            steps += 1
        return steps


def _marks(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is marked as boilerplate, or as an article."""
    dropped, article = name in _DROPPED_TAGS, name in ("article", "main")
    if attributes:
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key in ("class", "id"):
                parts = {x.lower() for x in _NAME_PARTS.findall(value)}
                found = parts & _DROPPED_NAMES
                if found and not (found == {"header"} and parts & _ARTICLE_NAMES):
                    dropped = True
            elif key == "role":
                dropped |= value.lower() in _DROPPED_ROLES
                article |= value.lower() in ("main", "article")
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                dropped = True
    return dropped, article


def parse(html: str) -> Page:
    """Blocks and elements of a page; unclosed and cut-off markup is read as far as it goes."""
    page = Page()
    stack = [("", 0, "", False)]  # name, element (inline ones without marks have none of their own), its name, in an article
    opened: Counter = Counter()
    text: list[str] = []
    linked = pos = 0
    size = len(html)

    def close() -> None:
        nonlocal linked
        if text:
            raw = "".join(text)
            plain = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if plain:
                page.blocks.append(Block(plain, stack[-1][2], stack[-1][1], min(1.0, linked / max(1, len(raw.strip())))))
            text.clear()
        linked = 0

    def cut(i: int) -> None:
        for entry in stack[i:]:
            opened[entry[0]] -= 1
        del stack[i:]

    while pos < size:
        m = _TAG.search(html, pos)
        start = m.start() if m else size
        if start > pos:
            piece = html[pos:start]
            text.append(piece)
            if opened["a"]:
                linked += len(piece.strip())
        if not m:
            break
        pos = m.end() if m.end() > start else start + 1
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name not in _INLINE:
                close()
            if opened[name] <= 0:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    if name in _INLINE and page.marked[stack[i][1]] and stack[i][1] != stack[i - 1][1]:
                        close()
                    cut(i)
                    break
                if name in _INLINE and stack[i][0] in _SCOPES:
                    break
            continue
        if name in _RAW:
            close()
            end = _RAW_END[name].search(html, pos)
            pos = end.end() if end else size
            continue
        if name not in _INLINE:
            close()
        if name in _VOID:
            continue
        if name in _CLOSES and any(opened[x] > 0 for x in _CLOSES[name]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in _CLOSES[name]:
                    cut(i)
                elif stack[i][0] in _SCOPES and name != "a":
                    break
                if not any(opened[x] > 0 for x in _CLOSES[name]):
                    break
        marked, article = _marks(name, m[3])
        _, around, holder, inside = stack[-1]
        if name == "header" and not inside:
            marked = True
        if marked and name in _INLINE:
            close()
        if not (m[3] or "").endswith("/") or name not in ("a", "span"):
            own = page.add(around, marked, article) if (marked or name not in _INLINE) and name not in _WHOLE else around
            stack.append((name, own, holder if name in _INLINE else name, inside or article))
            opened[name] += 1
    close()
    page.clear_marks()
    return page


def min_cut(scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels (True: with the source) of least cost: |score| for each node against its sign, w for each split edge.

    A node whose score outweighs all its edges keeps its sign in any least cut, so it is settled first and its edges
    become its neighbours' scores; the maximum flow runs on what is left.
    """
    n = len(scores)
    scores, label, tied = list(scores), [None] * n, [0] * n
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
            tied[a] += w
            tied[b] += w
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if label[i] is None and abs(scores[i]) >= tied[i]:
            label[i] = scores[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                tied[j] -= w
                scores[j] += w if label[i] else -w
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i in _source_side(rest, scores, near):
            label[i] = True
    return [bool(x) for x in label]


def _source_side(nodes: list[int], scores: list[int], near: list[dict[int, int]]) -> set[int]:
    """Nodes on the source's side of a minimum cut, by shortest augmenting paths in level graphs."""
    source, sink = -1, -2
    room: dict[int, dict[int, int]] = {i: dict(near[i]) for i in nodes}
    room[source], room[sink] = {}, {}
    for i in nodes:
        if scores[i] > 0:
            room[source][i] = scores[i]
            room[i][source] = 0
        elif scores[i] < 0:
            room[i][sink] = -scores[i]
            room[sink][i] = 0
    arcs = {i: list(room[i]) for i in room}
    while True:
        level, front = {source: 0}, [source]
        while front and sink not in level:
            ahead = []
            for i in front:
                for j, c in room[i].items():
                    if c > 0 and j not in level:
                        level[j] = level[i] + 1
                        ahead.append(j)
            front = ahead
        if sink not in level:
            return {i for i in level if i >= 0}
        turn = dict.fromkeys(level, 0)
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                least = min(room[a][b] for a, b in zip(path, path[1:]))
                full = None
                for at, (a, b) in enumerate(zip(path, path[1:])):
                    room[a][b] -= least
                    room[b][a] += least
                    if full is None and not room[a][b]:
                        full = at
                del path[full + 1 :]  # back to where the first full arc begins
                continue
            own, room_i, t, ahead = arcs[i], room[i], turn[i], level[i] + 1
            while t < len(own) and not (room_i[own[t]] > 0 and level.get(own[t]) == ahead):
                t += 1
            turn[i] = t
            if t < len(own):
                path.append(own[t])
            else:
                path.pop()
                level[i] = -5


def main_part(page: Page, words: list[int]) -> int:
    """The innermost element that holds most of a page's words (by block) in more than one text; 0 if none but the page does.

    From the page on, the element beneath that holds BULK of the words is gone into, as long as there is one.
    """
    n, parent = len(page.parent), page.parent
    held, texts = [0] * n, [0] * n
    for w, b in zip(words, page.blocks):
        held[b.holder] += w
        texts[b.holder] = 1
    for i in range(n - 1, 0, -1):
        held[parent[i]] += held[i]
        texts[parent[i]] += texts[i]
    best = 0
    for i in range(1, n):  # in page order, so an element comes after the one around it
        if parent[i] == best and held[i] >= BULK * held[0] and texts[i] > 1:
            best = i
    return best


def features(page: Page) -> tuple[list[dict[str, float]], list[dict[str, float]]]:
    """What the classifier knows of each block, by its text and place, and of each element, by its markup.

    A block is apart if it stands outside of the page's main part (main_part), which no mark has a say in but that words beneath
    marks don't count.
    Articles count as far as they hold more than half of the words that no mark covers, and so does standing outside:
    in a part of the page that holds no article beside one that does.
    """
    n, parent, blocks = len(page.parent), page.parent, page.blocks
    covered, inside, holds = list(page.marked), list(page.article), list(page.article)
    for i in range(1, n):
        covered[i] |= covered[parent[i]]
        inside[i] |= inside[parent[i]]
    for i in range(n - 1, 0, -1):
        if holds[i] and not covered[i]:
            holds[parent[i]] = True
    words = [b.text.count(" ") + 1 for b in blocks]
    free = sum(w for w, b in zip(words, blocks) if not covered[b.holder])
    reach = max(0.0, 2 * sum(w for w, b in zip(words, blocks) if inside[b.holder] and not covered[b.holder]) / free - 1) if free else 0.0
    of_blocks, of_elements = [], []
    bulk = page.bulk = main_part(page, [0 if covered[b.holder] else w for w, b in zip(words, blocks)])
    within = [i == bulk for i in range(n)]
    for i in range(1, n):
        within[i] |= within[parent[i]]
    for w, b in zip(words, blocks):
        found = {"bias": 1.0, "words": min(math.log2(w), 5.0), "links": b.linked, "heading": float(b.tag in _HEADINGS), "item": float(b.tag == "li")}
        if bulk and not within[b.holder]:
            found["apart"] = 1.0
        if reach and holds[b.holder] and not inside[b.holder]:
            found["outside"] = reach
        of_blocks.append(found)
    for i in range(n):
        found = {}
        if page.marked[i]:
            found["marked"] = 1.0
        if page.article[i] and not (i and inside[parent[i]]):
            found["article"] = reach
        elif reach and i and not inside[i] and not holds[i] and holds[parent[i]]:
            found["outside"] = reach
        of_elements.append(found)
    return of_blocks, of_elements


def cost(found: dict[str, float], weights: dict[str, float]) -> float:
    """Evidence for content, positive, or boilerplate, negative; a text's own share of it is bounded by TEXT_MOST."""
    text = sum(weights[k] * v for k, v in found.items() if k in _TEXT)
    return max(-TEXT_MOST, min(TEXT_MOST, text)) + sum(weights[k] * v for k, v in found.items() if k not in _TEXT)


_TEXT = ("bias", "words", "links", "heading", "item")
_MARKUP = ("apart", "marked", "article", "outside")


def graph(page: Page, weights: dict[str, float] = WEIGHTS) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Capacities to the terminals (positive: source) and edges: blocks are nodes 0.., elements follow.

    An element counts once for each block beneath it, in its cost and in its edge to the element around it.  Marked elements and
    the main part have no such edge, as what they hold tells nothing of what stands around them, and the page as a whole has no label.
    """
    blocks, n, parent = page.blocks, len(page.blocks), page.parent
    of_blocks, of_elements = features(page)
    beneath = [0] * len(parent)
    for b in blocks:
        beneath[b.holder] += 1
    for i in range(len(parent) - 1, 0, -1):
        beneath[parent[i]] += beneath[i]
    scores = [round(_SCALE * cost(f, weights)) for f in of_blocks]
    scores += [round(_SCALE * cost(f, weights) * m) if f else 0 for f, m in zip(of_elements, beneath)]
    pull = round(_SCALE * PULL)
    edges = [(i, n + b.holder, pull) for i, b in enumerate(blocks) if b.holder]
    edges += [(n + i, n + parent[i], pull * beneath[i]) for i in range(1, len(parent)) if parent[i] and beneath[i] and not page.marked[i] and i != page.bulk]
    for i in range(1, n):
        apart = page.apart(blocks[i - 1].holder, blocks[i].holder)
        edges.append((i - 1, i, round(_SCALE * NEAR * 4 / (2 + apart) ** 2)))
    return scores, edges


def label_blocks(page: Page, weights: dict[str, float] = WEIGHTS) -> list[bool]:
    """True for content."""
    return min_cut(*graph(page, weights))[: len(page.blocks)]


def fit_costs(pages: DataFrame, most: int = 2000, html: str = "html", rounds: int = 20, decay: float = 1e-2) -> dict[str, float]:
    """Weights of a logistic regression on the blocks of at most `most` pages, those whose text hashes lowest.

    Blocks in an article without marks are content, blocks under marks boilerplate, others are left out.  Half of the
    blocks hide their marks, and half their place, so that texts are learned too.
    """
    names = _TEXT + _MARKUP

    def make(batch):
        rows = []
        for h in batch.column("html").to_pylist():
            page = parse(h)
            of_blocks, of_elements = features(page)
            for i, (b, found) in enumerate(zip(page.blocks, of_blocks)):
                own, at = dict(found), b.holder
                while at >= 0:
                    for k, v in of_elements[at].items():
                        own[k] = max(own.get(k, 0.0), v)
                    at = page.parent[at]
                label = 0.0 if own.get("marked") else 1.0 if own.get("article") else None
                if label is not None:
                    hide = (i * 2654435761 + len(h)) >> 7
                    own = {k: v for k, v in own.items() if k in _TEXT or (hide >> (k == "marked")) & 1}
                    rows.append([own.get(k, 0.0) for k in names] + [label])
        return {"row": [np.array(r).tobytes() for r in rows]}

    sample = pages.where(F.length(html) > 0).select(F.col(html).alias("html")).orderBy(F.xxhash64("html"), "html").limit(most)
    rows = [r["row"] for r in mapped(sample, "html", make, "row binary").collect()]  # numbers of the bounded sample
    data = np.frombuffer(b"".join(rows)).reshape(-1, len(names) + 1)
    x, y, w = data[:, :-1], data[:, -1], np.zeros(len(names))
    for _ in range(rounds):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) / max(1, len(y)) + decay * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / max(1, len(y)) + decay * np.eye(len(names))
        w = w - np.linalg.solve(curve, slope)
    return dict(zip(names, w.tolist(), strict=True))


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = parse(html)
    return " ".join(b.text for b, kept in zip(page.blocks, label_blocks(page), strict=True) if kept)


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars (code points) of every row.

    Null and empty pages, and pages without content blocks, have the empty text.  Nothing is shuffled.
    """

    def make(batch):
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return mapped(rows, "html", make, "page_id long,url string,text string,n_chars long").withColumnRenamed("page_id", key)
