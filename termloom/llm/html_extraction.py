"""Main text of web pages by scoring the tree of their elements.

Parts of a page that are never its text (navigation, forms, scripts, notices)
go first, by element and by the words of their class and id. Every paragraph
then passes points for its length and its commas to its ancestors, fewer the
further up; a container's points are discounted by the share of its text that
is links. The best container is kept with those siblings that score near it or
are plain paragraphs. Blocks stand in page order.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.batches import text_slices, texts_of

# Elements of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style noscript template iframe textarea title xmp noframes".split())
DROPPED = frozenset(
    "head script style noscript template iframe textarea title nav header footer aside form button "
    "select option menu dialog svg math canvas object audio video map xmp noframes input label fieldset".split()
)
BLOCK = frozenset(
    "html body address article aside blockquote br center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements whose own text counts as a paragraph.
PARAGRAPH = frozenset("p pre blockquote td th li dd dt h1 h2 h3 h4 h5 h6 div section article main".split())
#: A start tag of the key closes an open element of the value, up to a boundary.
P_CLOSERS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
ITEM_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
               "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ITEM_BOUNDARY = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"},
                 "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
#: Words of class, id and role that mark parts beside the text.
ASIDE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adbox banner sponsor sponsored promo promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side rail aside header "
    "masthead footer foot comment comments commentlist discussion disqus respond replies reply "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended widget "
    "toolbar pagination pager search form contentinfo complementary toc skip hidden".split()
)
#: Words that overrule them on a container.
TEXT_WORDS = frozenset("article body content entry main post story text".split())

POINTS_PER_CHARACTERS = 100
SIBLING_SHARE = 0.2
#: Ancestors that points are passed to; beyond them the points are too few to matter.
PASS_LEVELS = 5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    # A tag with an open quote.
    r"|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(
    r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.DOTALL
)
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


@dataclass(slots=True, eq=False)
class Element:
    name: str
    parent: Element | None = None
    dropped: bool = False
    children: list = field(default_factory=list)
    points: float = 0.0
    n_chars: int = 0
    n_link_chars: int = 0


def is_beside_text(name: str, attributes: str) -> bool:
    """Whether an element is no part of the text, by its name, class, id and role."""
    if name in DROPPED:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    words: set[str] = set()
    for match in ATTRIBUTE.finditer(attributes):
        key = match[1].lower()
        value = (match[2] or match[3] or match[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key in ("class", "id", "role"):
            words.update(WORD.findall(value))
    return bool(words & ASIDE_WORDS) and not words & TEXT_WORDS


def parse(page: str) -> Element:
    """The tree of a page. Unclosed and stray tags are taken as browsers mostly do."""
    root = Element("#root")
    node, position, length = root, 0, len(page)
    # Open elements by name, so that a stray tag needs no look at all of them.
    opened: Counter[str] = Counter()

    def leave(node: Element, to: Element) -> Element:
        while node is not to:
            opened[node.name] -= 1
            node = node.parent
        return to

    while position < length:
        match = TOKEN.search(page, position)
        if match is None:
            node.children.append(page[position:])
            break
        if match.start() > position:
            node.children.append(page[position : match.start()])
        position = match.end()
        name = match[2]
        if name is None:
            continue
        name = name.lower()
        if match[1]:
            if opened[name]:
                node = leave(node, _close(node, name))
            continue
        if name in P_CLOSERS and opened["p"] or any(opened[x] for x in ITEM_CLOSES.get(name, ())):
            node = leave(node, _make_room(node, name))
        element = Element(name, node, node.dropped or is_beside_text(name, match[3]))
        node.children.append(element)
        if name in RAW_TEXT:
            # Everything up to the end tag is no markup.
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, position)
            position = end.end() if end else length
        elif name not in VOID and (
            # A slash on an element with content does not close it.
            not match[3].rstrip().endswith("/") or name in BLOCK | DROPPED and name not in ("br", "hr")
        ):
            node = element
            opened[name] += 1
    return root


def _close(node: Element, name: str) -> Element:
    """The node to go on with after an end tag."""
    at = node
    while at.parent is not None and at.name != name:
        if at.name in ("td", "th") and name not in BLOCK:
            return node
        at = at.parent
    return at.parent if at.parent is not None else node


def _make_room(node: Element, name: str) -> Element:
    """Close what a start tag of `name` implies to be at its end."""
    if name in P_CLOSERS:
        at = node
        while at.parent is not None and at.name not in ("p",) and at.name not in BLOCK:
            at = at.parent
        if at.name == "p":
            node = at.parent
    if name in ITEM_CLOSES:
        at, last = node, None
        while at.parent is not None and at.name not in ITEM_BOUNDARY[name]:
            if at.name in ITEM_CLOSES[name]:
                last = at
            at = at.parent
        if last is not None:
            node = last.parent
    return node


def _measure(root: Element) -> list[Element]:
    """Set text and link lengths of the kept elements; return them, children first."""
    order, stack = [], [root]
    while stack:
        element = stack.pop()
        order.append(element)
        stack += [c for c in element.children if isinstance(c, Element) and not c.dropped]
    order.reverse()
    for element in order:
        for child in element.children:
            if isinstance(child, str):
                element.n_chars += len(child.strip())
            elif not child.dropped:
                element.n_chars += child.n_chars
                element.n_link_chars += child.n_link_chars
        if element.name == "a":
            element.n_link_chars = element.n_chars
    return order


def _own_text(element: Element) -> tuple[int, int]:
    """Characters and commas of an element's text outside of blocks below it."""
    n_chars = n_commas = 0
    stack = list(element.children)
    while stack:
        child = stack.pop()
        if isinstance(child, str):
            n_chars += len(child.strip())
            n_commas += child.count(",") + child.count("，") + child.count("、")
        elif not child.dropped and child.name not in BLOCK:
            stack += child.children
    return n_chars, n_commas


def _link_density(element: Element) -> float:
    return element.n_link_chars / element.n_chars if element.n_chars else 0.0


def main_elements(root: Element) -> list[Element]:
    """The best container and the siblings kept with it, in page order."""
    order = _measure(root)
    for element in order:
        if element.name not in PARAGRAPH:
            continue
        n_chars, n_commas = _own_text(element)
        if not n_chars:
            continue
        points = (1 + n_commas + n_chars / POINTS_PER_CHARACTERS) * (1 - _link_density(element))
        # A paragraph counts for its containers; loose text counts for the element itself.
        at = element if element.name in ("div", "section", "article", "main", "td") else element.parent
        share = 1.0
        for _ in range(PASS_LEVELS):
            if at is None:
                break
            at.points += points * share
            share /= 2
            at = at.parent
    best, most = root, -1.0
    for element in order:
        score = element.points * (1 - _link_density(element))
        if score > most:
            best, most = element, score
    # An article or main element around the best container holds the text as a whole.
    at = best
    while at is not None:
        if at.name in ("article", "main"):
            best = at
        at = at.parent
    if best.parent is None:
        return [best]
    kept = []
    for sibling in best.parent.children:
        if isinstance(sibling, str) or sibling.dropped:
            continue
        score = sibling.points * (1 - _link_density(sibling))
        near = sibling.points > 0 and score >= SIBLING_SHARE * most and best.name not in ("article", "main")
        same = sibling.name == best.name == "article" and score >= SIBLING_SHARE * most
        plain = sibling.name in ("p", "pre", "blockquote", "h1", "h2") and best.name not in ("article", "main") and _link_density(sibling) < 0.25
        if sibling is best or near or same or plain:
            kept.append(sibling)
    return kept


def blocks_of(elements: list[Element]) -> list[str]:
    """Blocks of text below `elements` in page order, white space made single."""
    blocks, current = [], []

    def end() -> None:
        text = SPACE.sub(" ", html.unescape("".join(current))).strip()
        current.clear()
        if text:
            blocks.append(text)

    # None marks the end of a block.
    stack: list = list(reversed(elements))
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            current.append(item)
        elif not item.dropped:
            if item.name in BLOCK:
                end()
                stack.append(None)
            stack += reversed(item.children)
    end()
    return blocks


def main_text(page: str) -> str:
    """The main text of a page, blocks joined by a space; empty if there is none."""
    return " ".join(blocks_of(main_elements(parse(page))))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages` (page_id, url, html).

    Whole pages; a null page has an empty text, repeated rows a row each.
    """
    names = ["page_id", "url", "text", "n_chars"]

    def extract_texts(batches):
        for batch in batches:
            for part in text_slices(batch, "html"):
                texts = [main_text(page) for page in texts_of(part, "html")]
                columns = [
                    part.column("page_id"),
                    part.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(text) for text in texts], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(
        extract_texts, "page_id bigint, url string, text string, n_chars bigint"
    )
