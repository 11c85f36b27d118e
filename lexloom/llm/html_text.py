"""Main text of web pages by tag-path ratios.

A page is read into leaves (blocks of text) with their root-to-leaf tag path. Per path, text length and punctuation are
summed over all its leaves and divided by the number of leaves. The two ratios are laid over the leaves in page order,
smoothed by a Gaussian, fused into their product, and paths whose fused ratio reaches the threshold are content. All
blocks of such paths are text, and so is what stands with them: in the same article, main part or container, and the
headings right above. Names of classes and ids never take text out: an element with a name of page furniture lowers the
ratio of the paths through it, unless it holds the bulk of the page, as a layout's wrapper does.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced

#: Elements of HTML by their parsing rules (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends these open elements, up to the elements that bound them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
P_BOUNDS = frozenset("button table td th article section div aside li".split())
#: Blocks that stand within a container rather than being one.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption hgroup center address summary".split())

#: What is never article text, by element or role.
NOT_TEXT = frozenset("head nav footer script style template noscript svg math canvas iframe object embed audio video select datalist option button input textarea dialog menu title".split())
NOT_ROLES = frozenset("navigation banner contentinfo search dialog alertdialog alert menu menubar toolbar".split())
#: Elements, roles and words of classes and ids that speak of furniture, whatever stands with them ...
FURNITURE_TAGS = frozenset("aside form".split())
FURNITURE_ROLES = frozenset("complementary form".split())
FURNITURE = frozenset(
    """ad ads advert adverts advertisement advertising adslot sponsor sponsored sponsors promo promos nav navbar navigation menu menus breadcrumb breadcrumbs
    pagination pager toc topbar toolbar masthead footer sidebar sidebars rail comment comments commentlist disqus cookie cookies consent gdpr popup modal
    newsletter signup login share sharing recommended recommendations""".split()
)
#: ... and words that do so only in a name of nothing but such words and those of NEUTRAL.
MAYBE = frozenset(
    """banner banners promotion skip header side aside widget widgets related popular trending respond replies reply discussion feedback notice notices overlay alert disclaimer legal
    copyright subscribe subscription social follow form search hidden""".split()
)
NEUTRAL = frozenset(
    """and bar block body bottom box button buttons container content elements group icon icons inner inline item items left link links list main more outer panel
    articles posts reading stories topics products right section site small text the top wrap wrapper area js""".split()
)
#: Words of names that speak of a layout, or of what is not there.
LAYOUT = frozenset("layout with has no not without page template open enabled free".split())
#: Words of names of the article itself.
ARTICLE = frozenset("article content entry main post story".split())
#: Names of the page's own frame that an article may carry too.
FRAME = frozenset("html body main article".split())

#: Weights of the smoothing, over this many leaves on either side.
RADIUS, SIGMA = 2, 1.0
#: Paths count as content from this part of the standard deviation of the fused ratios on.
THRESHOLD = 0.5
#: The fused ratio of a path through furniture is taken by this factor.
LOWERED = 0.01
#: Furniture that holds such parts of the text around it may be a layout's wrapper; see wrappers().
BULK, SOME, REST = 0.5, 0.25, 0.01
#: A block outside any article whose text lies in links by this part is a menu, where the page's body is the container.
LINKED = 0.8

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_BROKEN = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z]+", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；]")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(eq=False)
class Node:
    tag: str
    parent: Node | None
    number: int  # in page order
    out: bool = False
    path: int = 0
    furniture: Node | None = None  # the innermost such element that holds the node, itself included
    frame: Node | None = None  # the outermost article, else main, that holds it
    box: Node | None = None  # where it has none, the innermost element that holds it and is no part of a text itself
    last: int = 0  # the last number below the node
    firsts: int = 0  # for furniture: how many of the page's first h1, main and article it holds
    mass: float = 0.0  # for furniture: of prose within
    own: float = 0.0  # and of prose in no further furniture
    lowers: bool = False


@dataclass(eq=False)
class Block:
    """Leaves without a block boundary between them."""

    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    marks: int = 0
    lowered: bool = False


def looked_at(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is never text, and whether it is furniture."""
    if tag in NOT_TEXT:
        return True, False
    furniture, names = tag in FURNITURE_TAGS, []
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False
        if name == "role":
            if value.lower() in NOT_ROLES:
                return True, False
            furniture |= value.lower() in FURNITURE_ROLES
        elif name == "style" and _HIDES.search(value):
            return True, False
        elif name in ("class", "id") and tag not in FRAME:
            names += value.split()
    return False, furniture or bool(names) and named(names)


def named(names: list[str]) -> bool:
    """Whether names of classes and ids speak of furniture."""
    split = [{w.lower() for w in _WORD.findall(_CAMEL.sub(" ", name))} for name in names]
    split = [words for words in split if not words & LAYOUT]
    if any(words & FURNITURE for words in split):
        return True
    return any(words & MAYBE and words <= MAYBE | NEUTRAL for words in split) and not any(words & ARTICLE and not words & MAYBE for words in split)


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, each at its innermost block element; text that is never article text is left out."""
    root = Node("", None, 0)
    root.box = root
    stack, block, found = [root], None, []
    opened: dict[str, list[int]] = defaultdict(list)  # of each tag, where in the stack it is open
    paths: dict[tuple[int, str, bool], int] = {}
    hiding: list[tuple[str, int]] = []  # open inline elements that hide what they hold, and how deep they are
    hidden: dict[str, int] = defaultdict(int)
    links = 0  # open links
    first_seen: set[str] = set()
    pieces: list[Node] = []  # furniture in page order
    at, n, number = 0, len(page), 0

    def add(text: str) -> None:
        nonlocal block
        top = stack[-1]
        if top.out or hiding:
            return
        if block is None or block.node is not top:
            block = Block(top)
            found.append(block)
        text = html.unescape(text) if "&" in text else text
        block.parts.append(text)
        if links:
            block.linked += len(text.strip())

    def cut(depth: int) -> None:
        """Closes all elements from that place of the stack on."""
        nonlocal block, links
        while len(stack) > depth:
            node = stack.pop()
            node.last = number
            opened[node.tag].pop()
        while hiding and hiding[-1][1] >= depth:
            hidden[hiding.pop()[0]] -= 1
        block, links = None, 0

    def close_to(names, bounds) -> None:
        bound = max((opened[b][-1] for b in bounds if opened[b]), default=0)
        first = [d for t in names for d in opened[t][-1:] if d > bound]
        if not first:
            return
        depth = min(first)
        for t in names:  # all open ones above the bound go, the outermost with them
            own = opened[t]
            i = len(own)
            while i and own[i - 1] > bound:
                i -= 1
            if i < len(own):
                depth = min(depth, own[i])
        cut(depth)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        m = _TAG.match(page, lt) or _BROKEN.match(page, lt)
        if m is None:
            add("<")
            at = lt + 1
            continue
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:  # a comment or declaration
            continue
        if m[1]:
            if tag in INLINE:
                if tag == "a":
                    links = max(0, links - 1)
                if hidden[tag]:
                    i = max(i for i, (t, _) in enumerate(hiding) if t == tag)
                    del hiding[i]
                    hidden[tag] -= 1
            elif tag == "br":
                add(" ")
            elif tag not in VOID:
                if opened[tag]:
                    cut(opened[tag][-1])
                block = None
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            if not tag == "xmp":
                continue
        if tag == "br":
            add("\n")
            continue
        if tag in VOID:
            if tag == "hr":
                close_to({"p"}, {"button"})
                block = None
            continue
        if tag in INLINE:
            if tag == "a":
                links += 1
            if looked_at(tag, m[3])[0]:
                hiding.append((tag, len(stack) - 1))
                hidden[tag] += 1
            continue
        if tag in ("html", "body") and opened[tag]:
            continue
        if tag in CLOSES_P:
            close_to({"p"}, P_BOUNDS if tag != "p" else {"button", "table"})
        if tag in ENDS:
            close_to(*ENDS[tag])
        if m[3].endswith("/") and tag in ("svg", "path"):
            continue
        top = stack[-1]
        out, furniture = looked_at(tag, m[3])
        out |= tag == "header" and not opened["article"] and not opened["main"]
        number += 1
        node = Node(tag, top, number, top.out or out, paths.setdefault((top.path, tag, furniture), len(paths) + 1), top.furniture, top.frame)
        if furniture and not node.out:
            node.furniture = node
            pieces.append(node)
        if node.frame is None or node.frame.tag == "main" and tag == "article":
            node.frame = node if tag in ("article", "main") else node.frame
        node.box = top.box if tag in PARTS else node
        if tag in ("h1", "main", "article") and tag not in first_seen and not node.out:
            first_seen.add(tag)
            if node.furniture:
                node.furniture.firsts += 1
        opened[tag].append(len(stack))
        stack.append(node)
        block, links = None, 0
    cut(1)
    root.last = number
    for b in found:
        b.text = " ".join("".join(b.parts).split())
        b.marks = len(_PUNCTUATION.findall(b.text))
    found = [b for b in found if b.text]
    wrappers(found, pieces)
    return found


def prose(b: Block) -> float:
    return len(b.text) * (1.0 if b.marks else 0.01)


def wrappers(found: list[Block], pieces: list[Node]) -> None:
    """Tells furniture from wrappers that only carry its names, and marks the blocks in furniture as lowered.

    Of the prose around an element (of the page, or of the wrapper that it is in), a wrapper holds at least BULK, and nearly
    all that is in no other furniture (REST) or the page's first headline, article or main part; with one of these SOME will do.
    """
    total = own = 0.0
    for b in found:
        total += prose(b)
        if b.node.furniture:
            b.node.furniture.own += prose(b)
        else:
            own += prose(b)
    for e in reversed(pieces):
        e.mass += e.own
        if e.parent.furniture:
            e.parent.furniture.mass += e.mass
            e.parent.furniture.firsts += e.firsts
    for e in pieces:  # from the outside in
        around = e.parent.furniture
        all_, free = (around.mass, around.own) if around else (total, own)
        wraps = e.mass >= SOME * all_ if e.firsts and e.mass > free else e.mass >= BULK * all_ and (bool(e.firsts) or free <= REST * all_)
        e.lowers = around is not None and around.lowers or not wraps
    for b in found:
        b.lowered = b.node.furniture is not None and b.node.furniture.lowers


def smoothed(values: list[float]) -> list[float]:
    weights = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for d, w in zip(range(-RADIUS, RADIUS + 1), weights, strict=True):
            if 0 <= i + d < len(values):
                total += w * values[i + d]
                weight += w
        out.append(total / weight)
    return out


def content_paths(found: list[Block]) -> set[tuple[int, bool]]:
    """Paths (and whether through furniture) whose fused ratio reaches the threshold; the one with most of it always does."""
    length, marks, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    keys = [(b.node.path, b.lowered) for b in found]
    for b, key in zip(found, keys, strict=True):
        length[key] += len(b.text)
        marks[key] += b.marks
        leaves[key] += 1
    text_ratio = smoothed([length[k] / leaves[k] for k in keys])
    mark_ratio = smoothed([marks[k] / leaves[k] for k in keys])
    fused = [t * (1 + m) * (LOWERED if k[1] else 1) for t, m, k in zip(text_ratio, mark_ratio, keys, strict=True)]
    mean = sum(fused) / len(fused)
    threshold = THRESHOLD * math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused))
    ratio, whole = defaultdict(float), defaultdict(float)
    for f, k in zip(fused, keys, strict=True):
        ratio[k] += f / leaves[k]
        whole[k] += f
    return {k for k, f in ratio.items() if f >= threshold} | {max(whole, key=whole.get)}


def main_text(page: str | None) -> str:
    """The article's blocks, white space in each as single spaces, joined by newlines; empty if there is none."""
    found = blocks(page or "")
    if not found:
        return ""
    paths = content_paths(found)
    chosen = [(b.node.path, b.lowered) in paths for b in found]
    spans: list[tuple[int, int, Node, bool]] = []
    for b, good in zip(found, chosen, strict=True):
        if good:
            node = b.node.frame or b.node.box
            if not spans or spans[-1][2] is not node or spans[-1][3] != b.lowered:
                spans.append((node.number, node.last, node, b.lowered))
    # containers nest or stand apart, so the one that began last among those that reach a block is looked at first
    kept = list(chosen)
    for allowed in (False, True):
        own = sorted({s[:2]: s for s in spans if s[3] == allowed}.values(), key=lambda s: (s[0], -s[1]))
        open_: list[tuple[int, int, Node, bool]] = []
        i = 0
        for k in sorted(range(len(found)), key=lambda k: found[k].node.number):
            b = found[k]
            while i < len(own) and own[i][0] <= b.node.number:
                if not open_ or own[i][1] > open_[-1][1] or open_[-1][1] < own[i][0]:
                    open_.append(own[i])
                i += 1
            while open_ and open_[-1][1] < b.node.number:
                open_.pop()
            if open_ and not kept[k] and b.lowered <= allowed:
                kept[k] = not (open_[-1][2].tag in ("", "html", "body") and b.node.frame is None and b.linked >= LINKED * len(b.text))
    for k in range(len(found) - 2, -1, -1):
        if not kept[k] and kept[k + 1] and found[k].node.tag in HEADINGS and not found[k].lowered:
            kept[k] = True
    return "\n".join(b.text for b, good in zip(found, kept, strict=True) if good)


def html_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of each page: id, url, text, n_chars (code points).

    Null or empty html, or html without text, gives an empty text. Every row gives one row; ids and urls may be null or
    repeat, other columns are no matter. Pages are read whole, one at a time within a slice of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            texts = [main_text(t) for t in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[id_col, url_col, "text", "n_chars"],
            )

    rows = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("html"))
    return rows.mapInArrow(run, f"`{id_col}` long, `{url_col}` string, text string, n_chars long")
