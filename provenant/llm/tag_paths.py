"""Main text of web pages by tag-path ratios.

A page is read into its text leaves; each belongs to a block, the nearest block element, with its root-to-leaf path of
tags. Per path, the length of text and the punctuation marks of its blocks are added up and divided by their number:
running text has long blocks with punctuation on few paths, menus have many short ones without. The two ratios are
fused, smoothed along the page, averaged per path and lowered by the share of its text that is linked. A threshold from
their spread selects the paths; only blocks on selected paths are main text. Blocks above the whole spread elect the
containers: the article or main elements that hold them, else the lowest element with all of them. Inside an article
links weigh half, so short headings and last lines, which their neighbours lift, stay. Elements that are never part of
an article (menus, page headers and footers, sidebars, notices, adverts, forms, reader comments, scripts) neither vote
nor count. A form, or an element that its class or id makes one of them, is taken for a layout around the page instead
if it holds a main element, most of the page's text, or an article with half of it; reader comments only if they hold a
main element or all text. Work is linear in the page, however deep its elements are nested.

Each page is one row of one Arrow batch; nothing is shuffled.

Cases: a null or empty page, and one without text, has an empty text. Markup that is not closed is closed by the elements
around it; an unfinished tag is text. Rows that repeat a page_id are read separately; only named columns are read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>|</?[A-Za-z][^\s/>]*+(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+>", re.S)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")

#: Elements without an end tag, elements whose content is not markup, and elements that start a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template svg".split())
BLOCK = frozenset(("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td "
                   "tfoot th thead tr ul").split())
#: An opening tag of the first kind closes an open element of the second kinds, up to the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "body": {"head"}}
CONTAINERS = frozenset("article aside body div fieldset footer form header main nav ol section table tbody td th ul dl blockquote html".split())
#: What is never part of an article: by element, by role, and by words of class and id.
ASIDE_TAGS = frozenset("nav footer aside form head noscript button select dialog menu object".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
ASIDE_WORDS = frozenset((
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner breadcrumb breadcrumbs comment comments "
    "commentlist cookie cookies consent disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices "
    "notification pagination pager popup related replies reply respond share sharing sidebar skip social subscribe toolbar widget").split())
#: Of these, what may hold more text than the article.
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: An element with such a class or id is an article whose header holds the title.
ARTICLE_WORDS = frozenset("article entry post story".split())
#: The part of the spread that a path must reach, what a link costs inside an article, and the part of the largest
#: article that a further one must hold.
THRESHOLD, ARTICLE_LINKS, FURTHER = 0.5, 0.5, 0.25
#: A form, or an element with such a word, with this share of the page's text is its layout.
LAYOUT = 0.75
_WORDS = re.compile(r"[a-z]+")
KEPT, DOUBTFUL, COMMENTS, ASIDE = range(4)


@dataclass
class Element:
    tag: str
    parent: Element | None
    aside: bool
    path: int
    depth: int = 0
    own: int = KEPT
    article: bool = False
    linked: bool = False
    holder: Element | None = None
    votes: int = 0


@dataclass
class Leaf:
    text: str
    element: Element
    block: int


def _aside_kind(tag: str, markup: str, parent: Element) -> int:
    kind = DOUBTFUL if tag == "form" else KEPT
    if tag in ASIDE_TAGS and kind == KEPT:
        return ASIDE
    inside = parent.article
    if tag == "header" and not inside:
        return ASIDE
    for name, value in _attributes(markup):
        if name == "role" and value in ASIDE_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return ASIDE
        if name == "style" and "display:none" in value.replace(" ", ""):
            return ASIDE
        if name in ("class", "id") and tag not in ("html", "body", "article", "main") and (words := ASIDE_WORDS & set(_WORDS.findall(value))):
            # A header of the article itself holds its title.
            if not (inside and words == {"header"}):
                kind = max(kind, COMMENTS if words & COMMENT_WORDS else DOUBTFUL)
    return kind


def _attributes(markup: str) -> Iterator[tuple[str, str]]:
    return ((name.lower(), (a or b or c).lower()) for name, a, b, c in _ATTRIBUTE.findall(markup))


def _is_article(tag: str, markup: str) -> bool:
    return tag in ("article", "main") or tag in ("div", "section") and any(
        name in ("class", "id") and ARTICLE_WORDS & set(value.split()) for name, value in _attributes(markup))


def _settle(elements: list[Element], leaves: list[Leaf]) -> None:
    """Which elements are aside, once it is known what they hold; parents come before children."""
    for element in elements:
        element.aside = element.parent.aside or element.own == ASIDE
    if not any(e.own in (DOUBTFUL, COMMENTS) for e in elements):
        return
    held: dict[int, int] = defaultdict(int)
    total = 0
    for leaf in leaves:
        if not leaf.element.aside:
            size = len(leaf.text.strip())
            held[id(leaf.element)] += size
            total += size
    marked: set[int] = set()
    articles: dict[int, int] = defaultdict(int)
    for element in reversed(elements):
        here, up = id(element), id(element.parent)
        held[up] += held[here]
        found = held[here] if element.tag in ("article", "main") and not element.aside else 0
        if here in marked or found and element.tag == "main":
            marked.add(up)
        articles[up] = max(articles[up], articles[here], found)
    for element in elements:
        layout = False
        if element.own in (DOUBTFUL, COMMENTS):
            size = held[id(element)]
            layout = id(element) in marked or size and size == total or element.own == DOUBTFUL and (
                size >= LAYOUT * total or 2 * articles[id(element)] >= total) and size
        element.aside = element.parent.aside or element.own != KEPT and not layout


def leaves_of(page: str) -> list[Leaf]:
    return read(page)[1]


def read(page: str) -> tuple[list[Element], list[Leaf]]:
    """The elements, parents first, and the visible text leaves in page order, with their elements and blocks."""
    root = Element("", None, False, 0)
    root.holder = root
    paths: dict[tuple[int, str], int] = {}
    stack, out, block, at, n = [root], [], 0, 0, len(page)
    elements: list[Element] = []

    def text(part: str) -> None:
        if part and not part.isspace() or part and out and out[-1].block == block:
            out.append(Leaf(entities.unescape(part), stack[-1], block))

    while at < n:
        found = _TOKEN.search(page, at)
        if found is None:
            text(page[at:])
            break
        text(page[at:found.start()])
        markup, at = found[0], found.end()
        if markup[1] in "!?":
            continue
        tag = _NAME.match(markup)[1].lower()
        if markup[1] == "/":
            if tag in BLOCK:
                block += 1
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCK and stack[i].tag in CONTAINERS:
                    break
            continue
        if tag == "br":
            text(" ")
        if tag in BLOCK:
            block += 1
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end and not markup.endswith("/>") else (at if markup.endswith("/>") else n)
            continue
        shut = CLOSES.get(tag) or ({"p"} if tag in BLOCK else None)
        if shut:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in shut:
                    del stack[i:]
                    break
                if stack[i].tag in CONTAINERS:
                    break
        parent = stack[-1]
        path = paths.setdefault((parent.path, tag), len(paths) + 1)
        here = Element(tag, parent, False, path, parent.depth + 1, _aside_kind(tag, markup, parent),
                       parent.article or _is_article(tag, markup), parent.linked or tag == "a")
        here.holder = here if tag in BLOCK else parent.holder
        stack.append(here)
        elements.append(here)
    _settle(elements, out)
    return [root, *elements], out


@dataclass
class Block:
    holder: Element
    size: int = 0
    marks: int = 0
    linked: int = 0


def scores(leaves: list[Leaf]) -> list[float]:
    """Fused and smoothed path ratio of each leaf's block, lowered by links; 0 for what is aside."""
    blocks: dict[int, Block] = {}
    for leaf in leaves:
        if not leaf.element.aside and (size := len(leaf.text.strip())):
            block = blocks.setdefault(leaf.block, Block(leaf.element.holder))
            block.size += size
            block.marks += len(_PUNCTUATION.findall(leaf.text))
            block.linked += size * leaf.element.linked
    size, marks, linked, count = (defaultdict(int) for _ in range(4))
    for block in blocks.values():
        path = block.holder.path
        size[path] += block.size
        marks[path] += block.marks
        linked[path] += block.linked
        count[path] += 1
    # Log scale, so that one huge block does not raise the threshold above ordinary paragraphs.
    raw = [0.0, *(math.log1p(size[p] / count[p] * (1.0 + marks[p] / count[p])) for x in blocks.values() for p in (x.holder.path,)), 0.0]
    fused = {}
    for i, (name, block) in enumerate(blocks.items(), 1):
        path = block.holder.path
        near = max(raw[i], 0.25 * raw[i - 1] + 0.5 * raw[i] + 0.25 * raw[i + 1])
        cost = ARTICLE_LINKS if block.holder.article else 1.0
        fused[name] = near * (1.0 - cost * linked[path] / size[path])
    return [0.0 if x.element.aside else fused.get(x.block, 0.0) for x in leaves]


def selected_paths(leaves: list[Leaf], score: list[float]) -> tuple[set[int], float]:
    """The paths whose mean score over their blocks reaches its part of the spread, and the spread."""
    by_block = {x.block: (x.element.holder.path, s) for x, s in zip(leaves, score) if not x.element.aside and x.text.strip()}
    values = [s for _, s in by_block.values()]
    mean = sum(values) / len(values)
    spread = math.sqrt(sum((x - mean) ** 2 for x in values) / len(values))
    of_path: dict[int, list[float]] = defaultdict(list)
    for path, value in by_block.values():
        of_path[path].append(value)
    chosen = {p for p, x in of_path.items() if sum(x) / len(x) >= max(THRESHOLD * spread, 1e-9)}
    return chosen or set(of_path), spread


def main_text(page: str) -> str:
    elements, leaves = read(page)
    if not any(not x.element.aside and x.text.strip() for x in leaves):
        return ""
    score = scores(leaves)
    paths, spread = selected_paths(leaves, score)
    kept = [i for i, x in enumerate(leaves) if not x.element.aside and x.element.holder.path in paths]
    strong = [leaves[i] for i in kept if leaves[i].text.strip() and score[i] >= spread]
    inside = _containers(elements, strong or [leaves[i] for i in kept if leaves[i].text.strip()])
    blocks: dict[int, list[str]] = defaultdict(list)
    for i in kept:
        if id(leaves[i].element) in inside:
            blocks[leaves[i].block].append(leaves[i].text)
    lines = (_SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def _containers(elements: list[Element], voters: list[Leaf]) -> set[int]:
    """The elements inside the elected articles, else inside the lowest element with all votes."""
    total = 0
    for leaf in voters:
        leaf.element.votes += len(leaf.text.strip())
        total += len(leaf.text.strip())
    for element in reversed(elements[1:]):
        element.parent.votes += element.votes
    marked = sorted((e for e in elements if e.tag in ("article", "main") and e.votes), key=lambda e: (-e.votes, -e.depth))
    elected, around = set(), set()
    for element in marked:
        if element.votes >= FURTHER * marked[0].votes and id(element) not in around and not _below(element, elected, around):
            elected.add(id(element))
            while element is not None and id(element) not in around:
                around.add(id(element))
                element = element.parent
    if not elected:
        whole = [e for e in elements if e.votes == total and e.holder is e]
        elected = {id(max(whole, key=lambda e: e.depth))}
    for element in elements[1:]:
        if id(element.parent) in elected:
            elected.add(id(element))
    return elected


def _below(element: Element, elected: set[int], around: set[int]) -> bool:
    """Whether an element lies in an elected one; the first element above that is around one decides."""
    while element is not None and id(element) not in around:
        element = element.parent
    return element is not None and id(element) in elected


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page its id, url and main text."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], names=["page_id", "url", "text"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return rows.mapInArrow(run, f"{kinds}, text string").withColumn("n_chars", F.length("text").cast("long"))
