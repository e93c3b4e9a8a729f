"""Main text of web pages by scoring the tree: paragraphs pass points up, links discount, the best container stays.

A page becomes a tree of elements and text blocks. Every block outside links gives its points (one, and
more for length and commas; a share of one if it is very short) to its parent in full, to its grandparent by half and on upwards by less; article
and main elements take them in full from any depth. A container's score is its points times the share of its
characters outside links. Tags, classes, ids and roles are weights: what lies in a part named like an advert, a
menu, comments and the like counts for little, in it and above it, but the part is chosen if nothing else on
the page scores higher. The best container is kept, with those siblings that score or read like it and the
headings beside it. Of what is kept, parts of such names or tags (navigation, footers, asides, forms) are left
out, unless a name of several words, one of them a mark, holds most of the container's text; so are
link-only lists before the first and after the last paragraph where the container is the whole body. Nothing
else is dropped. Form controls, hidden elements, scripts and styles are never text.

Edge cases. A null, empty or textless page gives the empty text. A null id or url is kept; repeated rows
are each extracted. Equal scores go to the container that opens first. Unclosed, crossing or cut-off tags
close where HTML closes them or at the end of the page; an unclosed title, frame, template or noscript is
read as if its tag were not there. An empty table gives no rows. Extra columns are ignored, whatever their
names. A page is read whole, in time linear in its length and depth of tags.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.words import pieces
from foliospark.sources import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
OPEN_ENDED = frozenset("script style textarea".split())  # unclosed, they go on to the end of the page
FOREIGN = frozenset("svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTROLS = frozenset("button select option input label head audio video canvas map datalist object".split())  # never text
#: Weights of tags that are seldom article text.
TAGS = {"nav": 0.05, "footer": 0.1, "aside": 0.1, "dialog": 0.1, "menu": 0.1, "form": 0.3, "fieldset": 0.3, "header": 0.2}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
MARKED = 0.15
NAMED = 1.25
UNITS = {"article": 1.2, "main": 1.1}
#: Parts of class and id names that mark what is no article text.
MARKS = frozenset(
    """sponsor sponsored sponsors promo promos promotion banner banners
    breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert
    alerts popup modal overlay newsletter subscribe subscription signup login register footer masthead nav navbar navigation menu menus
    submenu sidebar sidebars share sharing social related recommended recommendations widget widgets toolbar pagination pager skip
    topbar copyright disclaimer paywall header""".split()
)
#: As MARKS, in names of any number of words.
STRONG = frozenset("ad ads advert advertisement adverts advertising adsense comment comments commentlist disqus respond reply replies".split())
GOOD = frozenset("article body content entry main post story text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEGATED = frozenset("has with no without is not hide show".split())
PARAGRAPHS = HEADINGS | {"p", "pre", "li", "td", "blockquote"}
CLOSES_P = BLOCK - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "head", "body"}
#: An opening tag closes an open element of these names, up to one of the fences.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "body": ({"head"}, {"html"}),
}
LEAST = 25
TINY = 1e-9

_TAG = re.compile(r"<(?:!--|([!?])|(/?)([A-Za-z][^\s/>]*))")
_REST = re.compile(r"""(?:[^>=]|=\s*+(?:"[^"]*"|'[^']*')?)*+>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_END_OF = {name: re.compile(rf"<(/?){name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


class Node:
    """An element: its place in the tree, its weights, and what scoring adds up."""

    __slots__ = ("above", "hidden", "linked", "links", "loose", "order", "parent", "points", "size", "suspect", "tag", "unit", "weight")

    def __init__(self, tag: str, parent: Node | None, order: int) -> None:
        self.tag, self.parent, self.order = tag, parent, order
        self.hidden = bool(parent and parent.hidden)
        self.linked = tag == "a" or bool(parent and parent.linked)
        self.unit = UNITS.get(tag, 0.0)
        self.above = parent if parent is None or parent.unit else parent.above  # the nearest article or main around it
        self.suspect = self.loose = False  # loose: only by a part of a longer name
        self.weight = parent.weight if parent else 1.0  # of its suspect ancestors and itself
        self.points = self.size = self.links = 0.0

    def weigh(self, factor: float, loose: bool = False) -> None:
        self.loose = loose and (self.loose or not self.suspect)
        self.suspect = True
        self.weight = max(TINY, self.weight * factor)


def _marks(value: str) -> tuple[bool, bool]:
    """(marked, only as a part of a longer name) of class and id names."""
    loose = False
    for name in value.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if not parts or parts[0] in NEGATED:
            continue
        if any(p in STRONG for p in parts) or len(parts) == 1 and parts[0] in MARKS:
            return True, False
        loose = loose or any(p in MARKS for p in parts)
    return loose, loose


def _judge(node: Node, attributes: str) -> float:
    """Set the node's weights by its tag and attributes; returns the weight of its own good name."""
    tag, parent = node.tag, node.parent
    if tag in CONTROLS or tag in FOREIGN:
        node.hidden = True
    if tag in TAGS and (tag != "header" or parent is None or parent.tag in ("html", "body")):
        node.weigh(TAGS[tag])
    if not attributes:
        return 1.0
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        node.hidden = True
    role = found.get("role", "").lower()
    if role in UNITS:
        node.unit = UNITS[role]
    if tag in ("html", "body"):
        return 1.0
    names = f"{found.get('class', '')} {found.get('id', '')}"
    marked, loose = _marks(names)
    if role in ROLES:
        node.weigh(MARKED)
    if marked and tag != "main" and not (loose and tag == "article"):
        node.weigh(MARKED, loose)
    return NAMED if not node.suspect and any(p.lower() in GOOD for p in _PARTS.findall(names)) else 1.0


def _tag_end(page: str, at: int) -> int:
    """Past the > of the tag whose name ends at `at`; a > inside a quoted value does not count."""
    end = _REST.match(page, at)
    return end.end() if end else len(page)


def blocks(page: str) -> tuple[list[tuple[Node, str, int]], list[Node], list[float]]:
    """(block element, text, characters in links) of each text block in page order, all elements and the weights of their good names."""
    root = Node("html", None, 0)
    nodes, stack, open_, out = [root], [root], {}, []
    texts: list[str] = []
    named = [1.0]
    linked = 0
    holder = root

    def flush() -> None:
        nonlocal linked
        if texts:
            s = " ".join("".join(texts).split())
            if s:
                out.append((holder, s, min(linked, len(s))))
            texts.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal holder
        if any(n.tag in BLOCK for n in stack[depth:]):
            flush()
        for n in stack[depth:]:
            open_[n.tag] -= 1
        del stack[depth:]
        holder = next((n for n in reversed(stack) if n.tag in BLOCK), root)

    here, size = 0, len(page)
    raw_ends: dict[str, list[re.Match]] = {}
    while here < size:
        m = _TAG.search(page, here)
        stop = m.start() if m else size
        if stop > here and not stack[-1].hidden:
            s = page[here:stop]
            if "&" in s:
                s = html.unescape(s)
            texts.append(s)
            if stack[-1].linked:
                linked += len(" ".join(s.split()))
        if not m:
            break
        if page.startswith("<!--", stop):
            end = page.find("-->", stop + 4)
            here = size if end < 0 else end + 3
            continue
        if m[1]:
            here = _tag_end(page, stop)
            continue
        name, end = m[3].lower(), _tag_end(page, m.end())
        here = end
        if m[2]:
            if open_.get(name):
                close(max(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name) if stack[-1].tag != name else len(stack) - 1)
            elif name == "br" or name == "p":
                flush()
            continue
        if name in ("html",):
            continue
        if name in RAW:
            if page[end - 2 : end] != "/>" or name != "iframe":
                if name not in raw_ends:  # tags of this name from here on
                    raw_ends[name] = list(_END_OF[name].finditer(page, end))[::-1]
                left = raw_ends[name]
                while left and (left[-1].start() < end or name in OPEN_ENDED and not left[-1][1]):
                    left.pop()
                if left and left[-1][1]:
                    here = _tag_end(page, left[-1].end())
                elif name in OPEN_ENDED:
                    here = size
            continue
        if name in BLOCK and name not in ("html", "body") and any(open_.get(f) for f in FOREIGN):
            close(next(i for i in range(1, len(stack)) if stack[i].tag in FOREIGN))  # block tags end foreign content
        if name in CLOSES_P and open_.get("p"):
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p" or stack[i].tag in ("td", "th", "button", "caption")), 0)
            if k and stack[k].tag == "p":
                close(k)
        if name in IMPLIED:
            these, fences = IMPLIED[name]
            if any(open_.get(t) for t in these):
                depth = None
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in fences:
                        break
                    if stack[i].tag in these:
                        depth = i
                if depth:
                    close(depth)
        if name in BLOCK:
            flush()
        if name in VOID:
            if name in ("br", "hr", "img") and texts:
                texts.append(" ")
            continue
        if name in FOREIGN and page[end - 2 : end] == "/>":
            continue
        node = Node(name, stack[-1], len(nodes))
        named.append(_judge(node, page[m.end() : end - 1]))
        nodes.append(node)
        stack.append(node)
        open_[name] = open_.get(name, 0) + 1
        if name in BLOCK:
            holder = node
    flush()
    return out, nodes, named


def _pass_up(holder: Node, points: float) -> None:
    """Add a block's points to its container and upwards; what leaves a suspect element has its weight."""
    start = holder.parent if holder.tag in PARAGRAPHS and holder.parent else holder
    node: Node | None = start
    for level in range(5):
        if node is None:
            break
        if not node.unit:
            node.points += points * (start.weight / node.weight) * (1.0 if level == 0 else 0.5 if level == 1 else 1 / (3 * level))
        node = node.parent
    node = start if start.unit else start.above
    while node is not None:
        node.points += points * (start.weight / node.weight) * node.unit
        node = node.above


def _best(nodes: list[Node], scores: list[float]) -> Node:
    """The container of the highest score; of equal ones the first."""
    return nodes[max(range(len(nodes)), key=lambda i: (scores[i], -i))]


def _menus(found: list[tuple[Node, str, int]], state: list[bool], scored: set[int]) -> set[int]:
    """Of a whole body: places of link-only blocks before the first and after the last scored block."""
    inside = [i for i, (h, _, _) in enumerate(found) if state[h.order] and i in scored]
    return {i for i, (_, s, linked) in enumerate(found) if inside and not inside[0] <= i <= inside[-1] and linked * 10 >= len(s) * 8}


def extract(page: str | None, choose: Callable[[list[Node], list[float]], Node] = _best) -> str:
    """The main text of one page; `choose` picks the container from the elements and their scores."""
    found, nodes, named = blocks(page or "")
    if not found:
        return ""
    prose = {i for i, b in enumerate(found) if b[2] * 2 < len(b[1])} or set(range(len(found)))
    scored = {i for i in prose if len(found[i][1]) >= LEAST}
    for i in sorted(prose):
        holder, s, _ = found[i]
        _pass_up(holder, 1 + s.count(",") + min(len(s) / 100, 3.0) if i in scored else 0.5 * len(s) / LEAST)
    for holder, s, linked in found:
        holder.size += len(s)
        holder.links += linked
    for node in reversed(nodes[1:]):
        if not node.suspect:
            node.parent.size += node.size
            node.parent.links += node.links
    scores = [n.points * n.weight * w * (1 - n.links / n.size) if n.size else 0.0 for n, w in zip(nodes, named, strict=True)]
    best = choose(nodes, scores)
    kept = {best.order}
    least = max(10.0, 0.2 * scores[best.order])
    for node in nodes:
        if node.parent is best.parent and node is not best and not node.suspect and node.size:
            links = node.links / node.size
            reads = node.tag == "p" and (node.size > 80 and links < 0.25 or LEAST <= node.size <= 80 and not node.links)
            if scores[node.order] >= least or reads or node.tag in HEADINGS and links < 0.5:
                kept.add(node.order)
    state = [False] * len(nodes)
    for node in nodes:
        up = node.parent
        stays = not node.suspect or node.loose and node.size > best.size
        state[node.order] = node.order in kept or up is not None and state[up.order] and stays
    menus = _menus(found, state, scored) if best.tag in ("html", "body") else set()
    return "\n".join(s for i, (holder, s, _) in enumerate(found) if state[holder.order] and i not in menus)


def main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) for every row of pages."""
    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b, 2)):
            texts = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))
