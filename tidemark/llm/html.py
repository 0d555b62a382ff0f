"""Main text of HTML pages: flat text blocks, classified by a decision tree.

A page is cut at tags that start or end a block. Each block knows its words, the share of them inside
links, the same of the blocks before and after it, and whether it stands in an article, in a region that
pages use for navigation, notices and the like, or under a name that says so. A small decision tree is
grown on a labelled table of blocks (:data:`LABELLED`) and says which blocks are main text; these are
joined in page order. Half of the table's rows come from pages without article elements and telling names, where
words and links of the block and its neighbours decide; in an article they tell lists of links from text.

Scripts, styles and other unseen elements, comments and markup are never text. Character references are
decoded, also when they are cut off or unknown (then they stay as they are); white space inside a block
becomes one space.

Defined cases. Null or empty html gives the empty text. Broken markup: an element that is not closed ends
with its nearest closed ancestor or with the page, a head also with the first element that cannot stand in it; end tags without a start are passed over; an
unfinished tag or comment at the end is dropped. A page without article or main element is judged by words
and links alone; a short last block of such a page counts as a footer, a list of nothing but links as a menu. Very long
pages are parsed whole, in memory in proportion to the page. Repeated rows give repeated results; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.trees import classify, grow

#: HTML element names by their role.
UNSEEN = set("script style noscript template svg math iframe object canvas head title select option textarea button".split())
RAW = set("script style noscript template svg math iframe object canvas title select textarea".split())
ASIDE = set("nav header footer aside form menu dialog fieldset".split())
BODY = set("article main".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class or id names that say what a region is.
ASIDE_NAMES = re.compile(
    r"(?:^|[\W_])(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|aside|ad|ads|adv|advert|advertisement|banner|"
    r"sponsor|sponsored|promo|cookie|cookies|consent|notice|popup|modal|newsletter|subscribe|share|sharing|social|related|"
    r"recommended|breadcrumb|breadcrumbs|comment|comments|disqus|pagination|pager|widget|login|signup|search|"
    r"toolbar|copyright|legal|disclaimer)(?:$|[\W_])"
)
BODY_NAMES = re.compile(
    r"(?:^|[\W_])(?:article|articlebody|content|main|post|entry|story|body|text)(?:$|[\W_])"
)
#: Elements that can stand in a head; any other one closes it.
IN_HEAD = set("base basefont bgsound link meta noscript script style template title".split())
#: Elements that an opening tag of the same kind closes.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S
)
_NAMED = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_END_RAW = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}
_SPACE = re.compile(r"\s+")

#: Words, words in links, the same before and after, in an article, in a region aside, a heading; label.
FIELDS = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "aside", "heading")
LABELLED = [
    # article paragraphs, long, short and very short, between others and at the edges
    (80, 0.00, 60, 0.00, 90, 0.00, 1, 0, 0, 1),
    (35, 0.05, 80, 0.00, 12, 0.00, 1, 0, 0, 1),
    (3, 0.00, 40, 0.00, 25, 0.00, 1, 0, 0, 1),
    (1, 0.00, 2, 0.00, 1, 0.00, 1, 0, 0, 1),
    (12, 0.00, 0, 0.00, 9, 0.80, 1, 0, 0, 1),
    (45, 0.00, 9, 0.00, 8, 0.20, 1, 0, 0, 1),
    (8, 0.00, 0, 0.00, 60, 0.00, 1, 0, 1, 1),
    (2, 0.00, 14, 1.00, 120, 0.00, 1, 0, 1, 1),
    (10, 0.40, 50, 0.00, 50, 0.00, 1, 0, 0, 1),
    (6, 1.00, 70, 0.00, 30, 0.00, 1, 0, 0, 1),
    (200, 0.01, 3, 1.00, 3, 1.00, 1, 0, 0, 1),
    (2, 0.00, 1, 0.00, 30, 0.00, 1, 0, 1, 1),
    (5, 0.00, 0, 0.00, 0, 0.00, 1, 0, 0, 1),
    (4, 0.00, 2, 1.00, 9, 0.00, 1, 0, 1, 1),
    (7, 0.20, 5, 0.00, 6, 1.00, 1, 0, 0, 1),
    (8, 0.00, 8, 0.00, 4, 0.00, 1, 0, 0, 1),
    (6, 0.00, 60, 0.00, 0, 0.00, 1, 0, 0, 1),
    (1, 1.00, 3, 0.00, 3, 0.00, 1, 0, 0, 1),
    (5, 0.80, 40, 0.10, 7, 0.00, 1, 0, 0, 1),
    (9, 0.90, 2, 0.00, 90, 0.00, 1, 0, 0, 1),
    (3, 0.00, 70, 0.00, 12, 0.00, 1, 0, 0, 1),
    (4, 0.00, 10, 0.00, 1, 1.00, 1, 0, 0, 1),
    (2, 0.00, 0, 0.00, 2, 1.00, 1, 0, 0, 1),
    (20, 0.00, 1, 1.00, 0, 0.00, 1, 0, 0, 1),
    # paragraphs of an article after or before one with links, and links that stand alone
    (10, 0.00, 12, 0.20, 9, 0.00, 1, 0, 0, 1),
    (4, 0.00, 6, 1.00, 30, 0.00, 1, 0, 0, 1),
    (8, 0.00, 10, 0.40, 40, 0.00, 1, 0, 0, 1),
    (5, 0.00, 3, 0.60, 20, 0.00, 1, 0, 0, 1),
    (12, 0.00, 1, 1.00, 20, 0.00, 1, 0, 0, 1),
    (2, 0.00, 1, 1.00, 2, 0.00, 1, 0, 0, 1),
    (15, 0.00, 9, 1.00, 4, 0.00, 1, 0, 0, 1),
    (2, 0.00, 100, 0.00, 1, 0.00, 1, 0, 0, 1),
    (3, 0.00, 12, 0.00, 1, 1.00, 1, 0, 0, 1),
    (4, 1.00, 30, 0.00, 2, 0.00, 1, 0, 0, 1),
    (5, 1.00, 20, 0.00, 0, 0.00, 1, 0, 0, 1),
    (5, 1.00, 30, 0.00, 5, 0.00, 1, 0, 0, 1),
    (8, 1.00, 20, 0.00, 6, 0.00, 1, 0, 0, 1),
    (3, 1.00, 8, 0.20, 12, 0.00, 1, 0, 0, 1),
    # lists of links inside an article or content division
    (2, 1.00, 1, 0.00, 2, 1.00, 1, 0, 0, 0),
    (2, 1.00, 2, 1.00, 2, 1.00, 1, 0, 0, 0),
    (3, 1.00, 60, 0.00, 3, 1.00, 1, 0, 0, 0),
    (4, 1.00, 3, 1.00, 30, 0.00, 1, 0, 0, 0),
    (3, 1.00, 3, 1.00, 0, 0.00, 1, 0, 0, 0),
    (1, 1.00, 0, 0.00, 1, 1.00, 1, 0, 0, 0),
    (5, 0.90, 4, 1.00, 6, 0.90, 1, 0, 0, 0),
    (12, 1.00, 9, 1.00, 14, 1.00, 1, 0, 0, 0),
    (7, 0.90, 35, 0.00, 5, 1.00, 1, 0, 0, 0),
    (9, 1.00, 11, 1.00, 90, 0.00, 1, 0, 0, 0),
    (31, 1.00, 30, 1.00, 29, 1.00, 1, 0, 0, 0),
    (40, 1.00, 50, 1.00, 2, 0.00, 1, 0, 0, 0),
    # regions aside, in an article or not
    (1, 1.00, 1, 1.00, 1, 1.00, 0, 1, 0, 0),
    (2, 1.00, 0, 0.00, 2, 1.00, 0, 1, 0, 0),
    (9, 0.00, 1, 1.00, 10, 0.00, 0, 1, 0, 0),
    (15, 0.00, 30, 0.00, 0, 0.00, 0, 1, 0, 0),
    (60, 0.00, 40, 0.00, 40, 0.00, 0, 1, 0, 0),
    (120, 0.02, 2, 1.00, 2, 1.00, 0, 1, 0, 0),
    (4, 0.00, 20, 0.00, 35, 0.00, 1, 1, 0, 0),
    (50, 0.00, 80, 0.00, 80, 0.00, 1, 1, 0, 0),
    (3, 0.00, 90, 0.00, 25, 0.00, 1, 1, 1, 0),
    (5, 0.90, 60, 0.00, 0, 0.00, 1, 1, 0, 0),
    # pages without telling names: title and short paragraphs between others
    (6, 0.00, 8, 0.00, 13, 0.00, 0, 0, 1, 1),
    (7, 0.00, 8, 0.00, 7, 0.00, 0, 0, 1, 1),
    (2, 0.00, 12, 0.00, 2, 0.00, 0, 0, 1, 1),
    (8, 0.00, 1, 1.00, 8, 0.00, 0, 0, 1, 1),
    (5, 0.00, 4, 1.00, 12, 0.00, 0, 0, 1, 1),
    (7, 0.00, 3, 1.00, 20, 0.00, 0, 0, 1, 1),
    (2, 0.00, 2, 0.00, 32, 0.00, 0, 0, 0, 1),
    (1, 0.00, 61, 0.00, 1, 0.00, 0, 0, 0, 1),
    (2, 0.00, 64, 0.00, 5, 0.00, 0, 0, 0, 1),
    (5, 0.00, 2, 0.00, 48, 0.00, 0, 0, 0, 1),
    (4, 0.00, 5, 0.00, 12, 0.00, 0, 0, 0, 1),
    (5, 0.00, 74, 0.00, 4, 0.00, 0, 0, 0, 1),
    (6, 0.00, 13, 0.00, 9, 0.00, 0, 0, 0, 1),
    (8, 0.00, 26, 0.00, 11, 0.00, 0, 0, 0, 1),
    (2, 0.00, 12, 0.00, 19, 0.00, 0, 0, 0, 1),
    (1, 0.00, 1, 0.00, 2, 0.00, 0, 0, 0, 1),
    (3, 0.00, 4, 0.00, 11, 0.00, 0, 0, 0, 1),
    (14, 0.00, 1, 0.00, 14, 0.00, 0, 0, 0, 1),
    (2, 0.00, 2, 0.00, 1, 0.00, 0, 0, 0, 1),
    (3, 0.00, 26, 0.00, 1, 0.00, 0, 0, 0, 1),
    (12, 0.00, 50, 0.30, 10, 0.00, 0, 0, 0, 1),
    (8, 0.00, 40, 0.20, 30, 0.00, 0, 0, 0, 1),
    (40, 0.00, 50, 0.00, 0, 0.00, 0, 0, 0, 1),
    (30, 0.00, 3, 1.00, 0, 0.00, 0, 0, 0, 1),
    (24, 0.00, 2, 1.00, 40, 0.00, 0, 0, 0, 1),
    (90, 0.00, 10, 0.00, 0, 0.00, 0, 0, 0, 1),
    (30, 0.00, 5, 0.00, 0, 0.00, 0, 0, 0, 1),
    # the same pages: an advert after the menu, a line of rights at the end
    (11, 0.00, 1, 1.00, 2, 0.00, 0, 0, 0, 0),
    (9, 0.00, 1, 1.00, 10, 0.00, 0, 0, 0, 0),
    (12, 0.00, 1, 1.00, 8, 0.00, 0, 0, 0, 0),
    (4, 0.00, 1, 1.00, 7, 0.00, 0, 0, 0, 0),
    (15, 0.00, 1, 1.00, 13, 0.00, 0, 0, 0, 0),
    (11, 0.00, 5, 0.00, 0, 0.00, 0, 0, 0, 0),
    (11, 0.00, 143, 0.00, 0, 0.00, 0, 0, 0, 0),
    (14, 0.00, 17, 0.00, 0, 0.00, 0, 0, 0, 0),
    (15, 0.00, 58, 0.00, 0, 0.00, 0, 0, 0, 0),
    (8, 0.00, 1, 0.00, 0, 0.00, 0, 0, 0, 0),
    (2, 0.00, 30, 0.00, 1, 1.00, 0, 0, 0, 0),
    # pages without an article element: words and links decide
    (60, 0.00, 50, 0.00, 70, 0.00, 0, 0, 0, 1),
    (90, 0.10, 2, 1.00, 60, 0.00, 0, 0, 0, 1),
    (30, 0.00, 0, 0.00, 25, 0.00, 0, 0, 0, 1),
    (22, 0.00, 80, 0.00, 1, 1.00, 0, 0, 0, 1),
    (9, 0.00, 45, 0.00, 60, 0.00, 0, 0, 0, 1),
    (7, 0.00, 40, 0.00, 35, 0.05, 0, 0, 0, 1),
    (6, 0.00, 1, 1.00, 70, 0.00, 0, 0, 1, 1),
    (4, 0.00, 60, 0.00, 50, 0.00, 0, 0, 1, 1),
    (50, 0.00, 3, 0.00, 2, 0.00, 0, 0, 0, 1),
    (40, 0.00, 2, 0.00, 2, 1.00, 0, 0, 0, 1),
    (100, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 1),
    (20, 0.00, 5, 0.00, 5, 0.00, 0, 0, 0, 1),
    (13, 0.05, 3, 0.00, 4, 0.00, 0, 0, 0, 1),
    (70, 0.20, 1, 1.00, 1, 1.00, 0, 0, 0, 1),
    (2, 0.00, 50, 0.00, 40, 0.00, 0, 0, 0, 1),
    (3, 0.00, 4, 1.00, 50, 0.00, 0, 0, 1, 1),
    (3, 0.00, 0, 0.00, 50, 0.00, 0, 0, 1, 1),
    (3, 0.00, 40, 0.00, 0, 0.00, 0, 0, 0, 0),
    (3, 0.00, 2, 1.00, 40, 0.00, 0, 0, 0, 0),
    (14, 1.00, 2, 0.00, 20, 0.00, 0, 0, 0, 0),
    (30, 0.80, 60, 0.00, 60, 0.00, 0, 0, 0, 0),
    (2, 1.00, 60, 0.00, 60, 0.00, 0, 0, 0, 0),
    (1, 1.00, 1, 1.00, 2, 1.00, 0, 0, 0, 0),
    (3, 1.00, 0, 0.00, 1, 1.00, 0, 0, 0, 0),
    (2, 0.00, 1, 1.00, 3, 1.00, 0, 0, 0, 0),
    (5, 0.60, 70, 0.00, 4, 0.80, 0, 0, 0, 0),
    (25, 0.90, 30, 0.00, 40, 0.80, 0, 0, 0, 0),
    (40, 0.70, 3, 0.50, 2, 1.00, 0, 0, 0, 0),
    (6, 0.00, 3, 1.00, 4, 0.00, 0, 0, 0, 0),
    (4, 0.00, 5, 0.20, 0, 0.00, 0, 0, 0, 0),
    (8, 0.00, 4, 0.90, 2, 1.00, 0, 0, 1, 0),
]


def trained(table: list[tuple] | None = None) -> tuple:
    rows = np.array(table or LABELLED, dtype=float)
    return grow(rows[:, :-1], rows[:, -1])


class Block:
    __slots__ = ("parts", "linked", "article", "aside", "heading")

    def __init__(self, article: bool, aside: bool, heading: bool):
        self.parts: list[str] = []
        self.linked: list[bool] = []
        self.article, self.aside, self.heading = article, aside, heading


def blocks(page: str) -> list[tuple[str, tuple]]:
    """The page's text blocks with (words, link share, in an article, aside, heading)."""
    # An open element: name, in an article, aside, linked, heading.
    open_: list[tuple[str, bool, bool, bool, bool]] = [("", False, False, False, False)]
    found: list[Block] = []
    block: Block | None = None
    hidden, at = 0, 0

    def cut(k: int) -> None:
        """Closes the open elements from ``k`` on."""
        nonlocal hidden
        hidden -= sum(e[0] in UNSEEN for e in open_[k:])
        del open_[k:]

    def say(text: str) -> None:
        nonlocal block
        _, article, aside, linked, heading = open_[-1]
        if block is None:
            if not text.strip():
                return
            block = Block(article, aside, heading)
            found.append(block)
        block.parts.append(text)
        block.linked.append(linked)

    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not hidden:
            say(text)
        if m is None:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        inline = name in INLINE
        if not inline:
            block = None
        if m[1]:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == name:
                    if any(e[0] not in INLINE for e in open_[k:]):
                        block = None
                    cut(k)
                    break
            continue
        if not m[4]:
            break  # an unfinished tag
        if open_[-1][0] == "head" and name not in IN_HEAD:
            cut(len(open_) - 1)
        if name in RAW:
            end = _END_RAW[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID:
            continue
        for other in SELF_CLOSING.get(name, ()):
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == other:
                    cut(k)
                    break
                if open_[k][0] not in INLINE:
                    break
        if m[3].rstrip().endswith("/") and not inline:
            continue
        _, article, aside, linked, heading = open_[-1]
        if name in BODY:
            article, aside = True, aside
        elif name in ASIDE and not (name == "header" and article):
            aside = True
        if m[3] and not inline and name not in ("body", "html", "article", "main"):
            for named in _NAMED.finditer(m[3]):
                value = (named[1] or named[2] or named[3] or "").lower()
                known = ASIDE_NAMES.search(value)
                if known and not (article and "header" in known[0]):  # an article's own header stays
                    aside = True
                elif BODY_NAMES.search(value):
                    article = True
        if name in UNSEEN:
            hidden += 1
        open_.append((name, article, aside, linked or name == "a", heading or name in ("h1", "h2", "h3", "h4", "h5", "h6")))
    out = []
    for b in found:
        words = links = 0
        for part, linked in zip(b.parts, b.linked, strict=True):
            n = len(part.split())
            words += n
            links += n * linked
        text = _SPACE.sub(" ", references.unescape("".join(b.parts))).strip()
        if text:
            out.append((text, (words, links / max(1, words), int(b.article), int(b.aside), int(b.heading))))
    return out


def main_text(page: str | None, tree: tuple) -> str:
    found = blocks(page or "")
    none = ("", (0, 0.0, 0, 0, 0))
    kept = []
    for k, (text, (words, links, article, aside, heading)) in enumerate(found):
        before = (found[k - 1] if k else none)[1]
        after = (found[k + 1] if k + 1 < len(found) else none)[1]
        if classify(tree, (words, links, before[0], before[1], after[0], after[1], article, aside, heading)):
            kept.append(text)
    return " ".join(kept)


def extract_text(pages: DataFrame, table: list[tuple] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html)."""
    tree = trained(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                texts = [main_text(page, tree) for page in part.column(2).to_pylist()]
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
                )

    plain = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = pages.schema["page_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"page_id {kind}, url string, text string").withColumn(
        "n_chars", F.char_length("text").cast("long")
    )
