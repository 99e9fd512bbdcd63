"""Main text of a page: flat blocks classified by their own and their neighbours' shape.

A page is cut at block tags into flat runs of text. Each block has its word count and link density, those
of the blocks before and after it, and whether its containers are named like the frame of a page (menus,
sidebars, forms, ...) or like its content. A compound name of a layout or a state (``has-header``) says nothing, nor
does one of a topic beside a name of the content (``post tags-none``); the header of an article is part of it. An
article or content container takes back what the names of wrappers around it say, and a form with parts of a page in
it is a wrapper, too. What is hidden is not content. A small decision tree over these, trained on the labelled
table below, tells content from the rest.

Cases: a null or empty page has an empty text; broken markup (unclosed tags, comments or quotes) is read to
the end; pages of any length are read whole; equal rows get equal rows; an empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr img svg path input math mrow mi mn mo mtext ms mspace msup "
    "msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom mtable mtr mtd semantics annotation".split()
)
#: Skipped as they stand, up to their closing tag or the end of the page.
RAW = frozenset("script style iframe textarea title".split())
#: Skipped with all inside, at most up to the end of their parent.
SKIPPED = frozenset("noscript template object svg select annotation".split())
#: Elements that end an svg, and other skipped elements that are never closed.
STARTS = frozenset(
    "address article aside blockquote body center dd div dl dt footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre "
    "section table ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FRAME_TAGS = frozenset("nav footer aside menu dialog button label fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
#: Words in a class, id or role that name a part of the frame of a page.
FRAME_WORDS = frozenset(
    "ad ads advert advertisement advertising alert author banner bio breadcrumb breadcrumbs byline comment "
    "comments consent cookie cookies copyright disclaimer disqus footer form header legal login masthead menu "
    "meta modal nav navbar navigation newsletter notice notification overlay pagination popup privacy promo "
    "promotion related reply replies search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription tags toolbar topbar widget widgets".split()
)
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
ARTICLE_HEADER = frozenset("header".split())
#: Words that name a part of the frame unless they are inside an article, where they name a section of it.
OUTSIDE_WORDS = frozenset("discussion discussions feedback guestbook reactions respond response responses".split())
#: Words of the frame that hold even beside a name of the content.
PLACE_WORDS = frozenset(
    "banner breadcrumb breadcrumbs comment comments disqus footer menu nav navbar navigation reply replies sidebar".split()
)
#: Words that make a name one of a layout, a state or a topic, not of a part of the page.
STATE_WORDS = frozenset(
    "has no not none with without is category tag topic fixed sticky enabled disabled active open closed".split()
)
WRAP_WORDS = frozenset("wrap wrapper container layout".split())
#: Elements that a form around a whole page has and one to fill in has not.
PAGE_PARTS = frozenset("article main nav header footer h1 h2".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|(?=<)|\Z)"
    r"|([^<]+|<)",
    re.DOTALL,
)
_NAME = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_HIDDEN = re.compile(
    r"""(?:^|\s)(?:hidden(?=[\s=/]|\Z)(?!\s*=\s*["']?until-found)|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.IGNORECASE
)
_NEXT_LINK = re.compile(r"<(/?)a(?=[\s/>])", re.IGNORECASE)
_SPACE = re.compile(r"\s+")

FEATURES = (
    "words",
    "link_density",
    "words_before",
    "link_density_before",
    "words_after",
    "link_density_after",
    "frame",
    "content",
)

# The labelled table: one block a row (the features in order, then 1 for content, 0 for the rest).
# frame: 1 if a container is named like a part of a page's frame. content: 1 inside an article.
LABELLED = """
1 1.0 0 0.0 1 1.0 1 0 0
1 1.0 1 1.0 1 1.0 1 0 0
2 1.0 1 1.0 8 0.0 1 0 0
3 1.0 2 1.0 2 1.0 0 0 0
1 1.0 1 1.0 1 1.0 0 0 0
2 0.5 1 1.0 3 1.0 0 0 0
8 0.0 1 1.0 9 0.0 1 0 0
14 0.0 6 1.0 12 0.0 1 0 0
40 0.0 3 0.0 25 0.0 1 0 0
60 0.1 30 0.0 10 0.5 1 0 0
5 0.0 80 0.0 0 0.0 1 0 0
12 0.0 120 0.0 0 0.0 1 0 0
9 0.2 45 0.0 0 0.0 1 0 0
25 0.0 10 0.0 30 0.0 1 0 0
35 0.0 25 0.0 28 0.0 1 1 0
6 0.0 70 0.0 20 0.0 1 1 0
18 0.1 90 0.0 7 0.0 1 1 0
90 0.0 60 0.0 40 0.0 1 1 0
3 1.0 50 0.0 4 1.0 1 1 0
2 0.0 60 0.0 1 1.0 1 1 0
9 0.0 8 0.0 30 0.0 0 1 1
6 0.0 14 0.0 25 0.0 0 1 1
30 0.0 9 0.0 80 0.0 0 1 1
1 0.0 45 0.0 60 0.0 0 1 1
2 0.0 1 0.0 3 0.0 0 1 1
120 0.0 30 0.0 12 0.0 0 1 1
250 0.05 120 0.0 60 0.0 0 1 1
7 0.0 200 0.0 9 0.0 0 1 1
45 0.2 20 0.0 70 0.1 0 1 1
4 1.0 60 0.0 50 0.0 0 1 1
1 1.0 2 0.0 3 0.0 0 1 1
15 0.5 30 0.1 22 0.0 0 1 1
55 0.0 7 0.0 0 0.0 0 1 1
3 0.0 0 0.0 0 0.0 0 1 1
40 0.0 6 0.0 60 0.0 0 0 1
80 0.0 45 0.0 70 0.1 0 0 1
25 0.1 60 0.0 50 0.0 0 0 1
18 0.0 90 0.0 75 0.0 0 0 1
150 0.0 4 0.0 3 1.0 0 0 1
33 0.0 2 1.0 48 0.0 0 0 1
12 0.0 70 0.0 65 0.0 0 0 1
7 0.0 55 0.0 80 0.0 0 0 1
60 0.2 3 0.0 2 0.0 0 0 1
6 0.0 2 1.0 3 1.0 0 0 0
4 0.0 1 1.0 2 0.0 0 0 0
3 0.0 5 0.0 4 0.0 0 0 0
9 0.9 30 0.0 8 1.0 0 0 0
20 0.8 12 0.9 15 0.8 0 0 0
30 0.7 5 1.0 6 1.0 0 0 0
5 0.0 40 0.0 2 1.0 0 0 0
2 0.0 3 0.5 1 1.0 0 0 0
8 0.0 0 0.0 4 1.0 0 0 0
30 0.0 9 0.0 2 1.0 0 1 1
45 0.0 40 0.0 5 1.0 0 1 1
6 0.0 30 0.0 1 1.0 0 1 1
20 0.0 1 1.0 1 1.0 0 1 1
8 0.0 2 1.0 30 0.0 0 1 1
60 0.1 3 1.0 4 1.0 0 1 1
90 0.0 60 0.0 3 0.9 0 1 1
3 1.0 30 0.0 3 1.0 0 1 1
2 1.0 3 1.0 2 1.0 0 1 1
4 1.0 4 1.0 25 0.0 0 1 1
12 0.9 40 0.0 6 1.0 0 1 1
40 0.0 6 0.0 3 1.0 0 0 1
25 0.0 60 0.0 2 1.0 0 0 1
18 0.0 75 0.0 4 1.0 0 0 1
55 0.1 2 1.0 2 1.0 0 0 1
30 0.0 1 1.0 45 0.0 0 0 1
85 0.0 70 0.0 4 1.0 0 0 1
75 0.0 3 1.0 90 0.0 0 0 1
9 0.0 5 1.0 4 1.0 0 0 0
4 0.0 60 0.0 3 1.0 0 0 0
6 0.0 90 0.0 1 1.0 0 0 0
3 1.0 60 0.0 4 1.0 0 0 0
6 1.0 80 0.0 0 0.0 0 0 0
20 0.0 60 0.0 50 0.0 1 0 0
70 0.0 2 1.0 3 1.0 1 0 0
12 0.0 45 0.0 3 1.0 1 1 0
40 0.0 55 0.0 2 1.0 1 1 0
6 0.0 0 0.0 8 0.0 0 0 1
8 0.0 6 0.0 7 0.0 0 0 1
7 0.0 8 0.0 0 0.0 0 0 1
10 0.0 7 0.0 12 0.0 0 0 1
12 0.0 9 0.0 9 0.0 0 0 1
9 0.0 14 0.0 6 0.0 0 0 1
9 0.0 9 0.0 2 0.0 0 0 1
9 0.0 2 1.0 8 0.0 0 0 1
8 0.0 0 0.0 9 0.0 0 0 1
11 0.0 0 0.0 7 0.0 0 0 1
4 1.0 0 0.0 3 1.0 0 0 0
3 1.0 0 0.0 5 1.0 0 0 0
2 1.0 0 0.0 60 0.0 0 0 0
3 1.0 4 1.0 70 0.0 0 0 0
22 0.0 0 0.0 5 0.0 0 1 1
40 0.0 0 0.0 0 0.0 0 1 1
18 0.0 0 0.0 30 0.0 0 1 1
9 0.0 0 0.0 40 0.0 0 1 1
5 0.0 0 0.0 2 1.0 0 1 1
60 0.0 0 0.0 50 0.0 0 0 1
30 0.0 0 0.0 0 0.0 0 0 1
20 0.0 0 0.0 30 0.0 0 0 1
16 0.0 0 0.0 5 0.0 0 0 1
35 0.0 0 0.0 3 1.0 0 0 1
24 0.0 4 1.0 0 0.0 0 0 1
7 0.0 0 0.0 3 1.0 0 1 1
8 0.0 30 0.0 2 1.0 0 1 1
9 0.0 12 0.0 1 1.0 0 1 1
6 1.0 0 0.0 70 0.0 0 0 0
5 1.0 3 1.0 60 0.0 0 0 0
6 1.0 5 1.0 12 0.0 0 0 0
1 0.0 0 0.0 0 0.0 0 0 0
8 0.0 0 0.0 20 1.0 0 1 1
9 0.0 9 0.0 6 1.0 0 1 1
7 1.0 30 0.0 9 1.0 0 1 1
8 0.0 50 0.0 4 1.0 0 1 1
7 0.0 3 1.0 8 1.0 0 1 1
8 0.9 40 0.0 10 0.0 0 0 0
10 1.0 60 0.0 0 0.0 0 0 0
14 1.0 90 0.0 3 1.0 0 0 0
25 0.9 70 0.0 20 1.0 0 0 0
12 1.0 45 0.0 60 0.0 0 0 0
15 0.8 60 0.0 4 0.0 0 1 1
25 1.0 3 0.0 40 0.0 0 1 1
8 0.0 2 0.0 1 0.0 0 1 1
7 0.0 0 0.0 0 0.0 0 1 1
8 0.0 0 0.0 3 0.0 0 1 1
"""


@dataclass(frozen=True)
class Tree:
    """A decision tree as arrays; a leaf has feature -1 and the share of content as its value."""

    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    value: tuple[float, ...]

    def is_content(self, rows: np.ndarray) -> np.ndarray:
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right, value = np.array(self.left), np.array(self.right), np.array(self.value)
        at = np.zeros(len(rows), dtype=np.int64)
        while (inner := feature[at] >= 0).any():
            goes_left = rows[np.arange(len(rows)), feature[at]] <= threshold[at]
            at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
        return value[at] >= 0.5


def train(rows: np.ndarray, content: np.ndarray, depth: int = 6, least: int = 1) -> Tree:
    """Tree by the largest fall of the Gini impurity; the first of equal splits is taken."""
    nodes: list[list] = []

    def impurity(y: np.ndarray) -> float:
        return 2 * y.mean() * (1 - y.mean()) * len(y) if len(y) else 0.0

    def grow(chosen: np.ndarray, depth: int) -> int:
        y = content[chosen]
        place = len(nodes)
        nodes.append([-1, 0.0, place, place, float(y.mean())])
        best = (1e-9, -1, 0.0)
        if depth:
            for f in range(rows.shape[1]):
                values = np.unique(rows[chosen, f])
                for t in (values[1:] + values[:-1]) / 2:
                    low = rows[chosen, f] <= t
                    if min(low.sum(), (~low).sum()) < least:
                        continue
                    gain = impurity(y) - impurity(y[low]) - impurity(y[~low])
                    if gain > best[0] + 1e-9:
                        best = (gain, f, float(t))
        _, f, t = best
        if f >= 0:
            low = rows[chosen, f] <= t
            nodes[place][:2] = [f, t]
            nodes[place][2] = grow(chosen[low], depth - 1)
            nodes[place][3] = grow(chosen[~low], depth - 1)
        return place

    grow(np.arange(len(rows)), depth)
    return Tree(*(tuple(n[i] for n in nodes) for i in range(5)))


@cache
def default_tree() -> Tree:
    table = np.array([line.split() for line in LABELLED.strip().splitlines()], dtype=float)
    return train(table[:, :-1], table[:, -1])


@dataclass
class Block:
    text: str
    words: int
    linked: int
    frame: bool
    content: bool


def _kind(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element is named like the frame or like the content of a page, and is a container of the content.

    ``inside``: whether it stands in an article or content container.
    """
    names = [
        (attribute.lower(), {p.lower() for p in _PART.findall(name)})
        for attribute, *values in (_NAME.findall(attributes) if attributes else ())
        for name in next(filter(None, values), "").split()
    ]
    beside = any(parts and parts <= CONTENT_WORDS for _, parts in names)
    named = content = holds = False
    for attribute, parts in names:
        frame = parts & FRAME_WORDS
        of_article = parts & CONTENT_WORDS
        if of_article or inside and tag in ARTICLE_HEADER:
            frame -= ARTICLE_HEADER
        if not inside:
            frame |= parts & OUTSIDE_WORDS
        layout = parts & STATE_WORDS or of_article and parts & WRAP_WORDS
        topic = beside and len(parts) > 1 and not parts & PLACE_WORDS
        named = named or bool(frame) and not layout and not topic
        content = content or bool(of_article) and not layout
        whole = bool(parts) and parts <= CONTENT_WORDS
        holds = holds or whole and (attribute in ("id", "role") or len(parts) > 1)
    if tag in CONTENT_TAGS:
        return False, True, not named
    frame = named and tag not in ("html", "body")
    return frame, content and not frame, holds and not named


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order; blocks without text are left out."""
    found: list[Block] = []
    pieces: list[tuple[str, bool]] = []
    # Of each open element: the tag, and what it adds to the counts below. An element that holds the content takes
    # away what names of wrappers around it have added to ``named``.
    open_tags: list[tuple[str, int, int, int]] = []
    places: dict[str, list[int]] = {}  # of each tag, where it is open
    frames = named = contents = links = 0
    # Of each open form: its place among the open elements, its first block, and whether it has parts of a page.
    forms: list[list[int]] = []
    # Places of the skipped elements among the open ones; the last closing tag of each of their names.
    skipped: list[int] = []
    last_close: dict[str, int] = {}
    loose = False  # the link at hand is never closed

    def close_block() -> None:
        nonlocal links, loose
        text = _SPACE.sub(" ", html.unescape("".join(p for p, _ in pieces))).strip()
        if text:
            linked = sum(len(p.split()) for p, link in pieces if link)
            found.append(Block(text, len(text.split()), linked, frames + named > 0, contents > 0))
        pieces.clear()
        if loose:
            links, loose = 0, False

    def close(place: int) -> None:
        nonlocal frames, named, contents
        for tag, frame, name, content in reversed(open_tags[place:]):
            places[tag].pop()
            frames -= frame
            named -= name
            contents -= content
        del open_tags[place:]
        while skipped and skipped[-1] >= place:
            skipped.pop()
        while forms and forms[-1][0] >= place:
            _, first, page_parts = forms.pop()
            for block in found[first:] if not page_parts else ():
                block.frame = True

    def opened(tag: str, frame: int, name: int, content: int) -> None:
        places.setdefault(tag, []).append(len(open_tags))
        open_tags.append((tag, frame, name, content))

    def last_closing(tag: str) -> int:
        if tag not in last_close:
            last_close[tag] = max((m.start() for m in re.finditer(rf"</{tag}\b", page, re.IGNORECASE)), default=-1)
        return last_close[tag]

    at = 0
    while at < len(page):
        match = _TOKEN.match(page, at)
        if match is None:  # a tag with an open quote: its name alone is skipped
            if not skipped:
                pieces.append((page[at], links > 0))
            at += 1
            continue
        at = match.end()
        closing, tag, attributes, text = match.groups()
        if text is not None:
            if not skipped:
                pieces.append((text, links > 0))
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if tag == "a":
                links, loose = 0, False
            if tag not in INLINE:
                close_block()
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in RAW or tag == "head":
            if tag not in INLINE:
                close_block()
            end = None
            if last_closing(tag) >= at:
                end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
            if end:
                at = end.end()
            elif tag != "head":  # an open head has nothing but its own elements to skip
                at = len(page)
            continue
        if skipped and tag in STARTS:
            first = open_tags[skipped[0]][0]
            if first == "svg" or last_close[first] < at:
                close(skipped[0])
        if tag in SKIPPED:
            if tag not in INLINE:
                close_block()
            if tag == "svg" and attributes.rstrip().endswith("/"):
                continue
            last_closing(tag)
            skipped.append(len(open_tags))
            opened(tag, 0, 0, 0)
            continue
        if tag == "a":
            after = _NEXT_LINK.search(page, at)
            links, loose = int("href" in attributes.lower()), after is None or not after.group(1)
        if tag in INLINE:
            continue
        close_block()
        if tag in VOID:
            continue
        if tag == "p" and open_tags and open_tags[-1][0] == "p":
            close(len(open_tags) - 1)  # paragraphs do not nest
        name, content, holds = _kind(tag, attributes, contents > 0)
        if tag in ARTICLE_HEADER and not contents:
            name, content, holds = True, False, False
        if holds or tag in PAGE_PARTS:
            for form in reversed(forms):
                if form[2]:
                    break  # and so have all around it
                form[2] = True
        if tag == "form":
            forms.append([len(open_tags), len(found), False])
        added = -named if holds else int(name)
        frame = int(tag in FRAME_TAGS or _HIDDEN.search(attributes) is not None)
        opened(tag, frame, added, int(content))
        frames += frame
        named += added
        contents += content
    close_block()
    close(0)
    return found


def features(found: list[Block]) -> np.ndarray:
    """One row per block, see ``FEATURES``."""
    words = np.array([b.words for b in found], dtype=float)
    density = np.array([b.linked / b.words for b in found], dtype=float)
    before = [np.concatenate(([0.0], v[:-1])) for v in (words, density)]
    after = [np.concatenate((v[1:], [0.0])) for v in (words, density)]
    frame = np.array([b.frame for b in found], dtype=float)
    content = np.array([b.content for b in found], dtype=float)
    return np.stack([words, density, *before, *after, frame, content], axis=1)


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    kept = tree.is_content(features(found))
    return " ".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    tree = tree or default_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, tree) for p in batch.column("html").to_pylist()]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.record_batch([*columns, lengths], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
