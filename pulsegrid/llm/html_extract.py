"""Main text of web pages by two-pass block rules (operator 4).

A page is cut into blocks at block-level tags. Only what is never text is left out beforehand: scripts, styles and other
raw elements, the head, buttons and lists of choices, and hidden elements. Every other block passes the rules.

First pass: length and stop-word density give a block points, a high link density makes it bad. Its place moves
the points: up inside an article or main element, down in an element whose tag, role, class or id marks a menu,
header, footer, sidebar, notice, advert, form or reader comments, and a little down outside of an article that has good
text. Points make the block good, bad or ambiguous; headings are ambiguous. A mark isn't believed where the text speaks
against it: on an element around the page's only article, or around its main heading and most of its
unlinked text. On a page with hardly any stop words length counts for them too.

Second pass: ambiguous blocks take the label of the nearest decided blocks on both sides, those of an article
from blocks of an article. Where the two differ, a block inside is good, one outside follows the nearer, or is bad
if the page has an article with good text. Ambiguous blocks of an article without decided ones are good, and so are
those of a page without any article and good block.

Defined cases: a null html is the empty page; a page without good blocks has the text ''; an empty table gives no rows;
null ids pass; unclosed, misplaced and truncated tags are read as browsers do as far as blocks go;
pages of any length and depth are read whole, in linear time; repeated rows give repeated rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Function words of four languages.
STOP_WORDS = frozenset(
    """
    a an and are as at be been but by can do for from had has have he her his i if in is it its not of on one or she so
    that the their there they this to was we were what when which who will with would you
    aber als am auch auf aus bei bin bis das dem den der des die durch ein eine einer er es für hat ich im ist mit nach
    nicht noch nur oder sein sich sie sind und von vor war was wie wird zu zum zur
    au aux avec ce ces dans du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour que qui sa se
    ses son sont sur un une vous
    al como con del el ella ellos era esta este ha las lo los más muy no o para pero por porque se sin su sus todo y
    """.split()
)
# HTML's elements by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object textarea title xmp".split())
LEFT_OUT = frozenset("head button select option canvas audio video".split()) | RAW
MARKED_TAGS = frozenset("nav footer aside dialog menu form fieldset label".split())
CLOSED_BY_SAME = frozenset("p li dt dd tr td th".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
# Parts of class and id names that mark what isn't the article.
MARKS = frozenset(
    """
    ad ads adv advert adverts advertisement adbox adsense sponsor sponsored promo promotion banner menu nav navbar navigation
    breadcrumb breadcrumbs sidebar sidenav rail footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert
    popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget
    comment comments disqus respond discussion pager pagination tags disclaimer copyright skip hidden
    """.split()
)
COMMENT_MARKS = frozenset("comment comments disqus respond discussion".split())
HEADER_MARKS = frozenset(["header", "siteheader", "pageheader"])
ARTICLE_MARKS = frozenset("article articlebody content maincontent entry post story main body".split())
NO_MARKS = frozenset("no has with without".split())  # what follows in a name says nothing of the element's own text
TOPICS = frozenset("tag tags category cat topic format type status".split())  # nor does what follows these at its begin

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>=]|=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|[="'])*+)(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")

LONG, STOPS_LOW, STOPS_HIGH, LINKS_HIGH, LINKS_HIGH_INSIDE = 140, 0.06, 0.12, 0.34, 0.6
FEW = 8  # words, below which a stop word says nothing
FOREIGN = 0.02
INSIDE, BESIDE, MARKED = 3, -1, -8
GOOD, BAD, UNSURE = 1, 0, None


@dataclass(eq=False)
class Mark:
    """An element that its tag, role or names mark as boilerplate, and what its text says to that."""

    outer: Mark | None
    sure: bool  # never doubted: reader comments, what an article's header says beside its heading
    in_article: bool
    chars: int = 0
    inside: int = 0
    titled: bool = False
    believed: bool = True


@dataclass
class Block:
    """A run of text between block-level tags."""

    text: str
    linked: int
    inside: bool = False
    heading: str = ""
    mark: Mark | None = None
    words: int = 0
    stops: int = 0

    def __post_init__(self) -> None:
        words = WORD.findall(self.text)
        self.words, self.stops = len(words), sum(w.lower() in STOP_WORDS for w in words)

    @property
    def links(self) -> float:
        return self.linked / len(self.text)

    @property
    def marked(self) -> bool:
        return self.mark is not None and self.mark.believed

    def label(self, place: int, foreign: bool) -> int | None:
        """First pass: good, bad or ambiguous, with the points of the block's place."""
        size, links = len(self.text), self.links
        if links > (LINKS_HIGH_INSIDE if place == INSIDE else LINKS_HIGH):
            return BAD
        if self.heading and place != MARKED:
            return UNSURE
        density = self.stops / self.words if self.words >= FEW else 0.0
        length = (size >= LONG) + (size >= LONG // 2)
        points = place + length + (length if foreign else (density >= STOPS_LOW) + (density >= STOPS_HIGH))
        if place != INSIDE:
            points -= 2 * self.text.startswith(("©", "Copyright")) + (links > 0 and not length)
        return GOOD if points >= 4 else BAD if points < 0 else UNSURE


@dataclass(slots=True)
class Element:
    """An open element: what it and those around it say of the text inside."""

    tag: str
    out: bool = False
    inside: bool = False
    heading: str = ""
    mark: Mark | None = None
    beyond: Mark | None = None  # the mark around an article's own header, which its headings keep
    in_header: bool = False
    names: bool = False  # an inline element marked by its names


def _attributes(attributes: str) -> tuple[bool, bool, bool, bool, bool]:
    """Whether attributes hide an element, and mark it as boilerplate, reader comments, a page header, the article."""
    hidden = role = names = comments = header = article = False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and UNSEEN.search(value)):
            hidden = True
        elif key == "role":
            role |= value.lower() in ROLES
            article |= value.lower() in ("main", "article")
        elif key in ("class", "id"):
            for name in value.split():
                parts = [p.lower() for p in NAME_PARTS.findall(name)]
                parts = parts[: next((i for i, p in enumerate(parts) if p in NO_MARKS), len(parts))]
                if len(parts) > 1 and parts[0] in TOPICS:
                    continue
                own = not MARKS.isdisjoint(parts)
                names |= own
                comments |= not COMMENT_MARKS.isdisjoint(parts)
                header |= name.lower().replace("-", "").replace("_", "") in HEADER_MARKS
                article |= not own and not ARTICLE_MARKS.isdisjoint(parts)
    return hidden, role or comments or (names and not article), comments, header, article and not role and not comments


def blocks_of(page: str) -> tuple[list[Block], list[Mark]]:
    """The page's blocks in page order, and its marks, outer ones first."""
    out: list[Block] = []
    marks: list[Mark] = []
    stack = [Element("")]
    open_tags: Counter[str] = Counter()
    text: list[str] = []
    linked = named = at = 0
    link = False

    def flush() -> None:
        nonlocal linked, named
        if text:
            joined = SPACE.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                top, size = stack[-1], len(joined)
                mark = top.beyond if top.heading and top.in_header else top.mark
                if mark is None and 2 * named > size:
                    mark = Mark(None, True, top.inside)
                    marks.append(mark)
                out.append(Block(joined, min(linked, size), top.inside, top.heading, mark))
            text.clear()
        linked = named = 0

    def add(piece: str) -> None:
        nonlocal linked, named
        if not stack[-1].out:
            text.append(piece)
            linked += len(piece.strip()) if link else 0
            named += len(piece.strip()) if stack[-1].names else 0

    def pop() -> None:
        open_tags[stack.pop().tag] -= 1

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        inline = tag in INLINE
        if not inline:
            flush()
        if m[1]:
            link = link and tag != "a" and inline
            if open_tags[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag in RAW:  # its content is no markup
            if not (m[3].rstrip().endswith("/") and tag in ("svg", "math")):
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                at = n if end is None else end.start()
                close = page.find(">", at)
                at = n if close < 0 else close + 1
            continue
        if tag == "br":
            add(" ")
        if tag in VOID:
            continue
        if tag == "a":
            link = "href" in m[3].lower()
        if not inline and (stack[-1].tag == "p" or (tag in CLOSED_BY_SAME and stack[-1].tag == tag)):
            pop()
        hidden, marked, comments, header, article = _attributes(m[3]) if m[3] else (False,) * 5
        top = stack[-1]
        if inline:
            if hidden or marked or open_tags[tag]:
                stack.append(Element(tag, top.out or hidden, top.inside, top.heading, top.mark, top.beyond, top.in_header, top.names or marked))
                open_tags[tag] += 1
            continue
        mark, beyond, in_header = top.mark, top.beyond, top.in_header
        own_header = tag == "header" or header
        if own_header and top.inside and not in_header:
            beyond, in_header = mark, True
            mark = Mark(mark, True, True)
            marks.append(mark)
        elif tag not in ("html", "body", "main") and (marked or own_header or tag in MARKED_TAGS):
            mark = Mark(mark, comments, top.inside)
            marks.append(mark)
        inside = top.inside or tag == "main" or (tag == "article" and not marked) or (article and tag in ("div", "section", "td"))
        stack.append(Element(tag, top.out or hidden or tag in LEFT_OUT, inside, top.heading or (tag if tag in HEADINGS else ""), mark, beyond, in_header))
        open_tags[tag] += 1
    flush()
    return out, marks


def doubt(blocks: list[Block], marks: list[Mark]) -> None:
    """Marks that the text speaks against aren't believed."""
    total = sum(len(b.text) for b in blocks if b.links <= LINKS_HIGH)
    inside = sum(b.inside for b in blocks)
    for b in blocks:
        if b.mark is not None:
            b.mark.chars += len(b.text) if b.links <= LINKS_HIGH else 0
            b.mark.inside += b.inside
            b.mark.titled |= b.heading == "h1"
    for mark in reversed(marks):
        if mark.outer is not None:
            mark.outer.chars += mark.chars
            mark.outer.inside += mark.inside
            mark.outer.titled |= mark.titled
    for mark in marks:
        around = mark.inside == inside and inside > 0 and not mark.in_article
        most = mark.titled and 2 * mark.chars > total and (inside == mark.inside or mark.in_article)
        mark.believed = mark.sure or not (around or most)
        if mark.outer is not None:
            mark.believed |= mark.outer.believed


def labels(blocks: list[Block], marks: list[Mark]) -> list[int]:
    """Both passes."""
    doubt(blocks, marks)
    plain = [b for b in blocks if not b.marked and b.links <= LINKS_HIGH]
    foreign = sum(b.stops for b in plain) < FOREIGN * sum(b.words for b in plain)
    within = [b.inside and not b.marked for b in blocks]
    first = [b.label(MARKED if b.marked else INSIDE if w else 0, foreign) for b, w in zip(blocks, within, strict=True)]
    article = any(w and v == GOOD for w, v in zip(within, first, strict=True))
    if article:
        first = [v if w or b.marked else b.label(BESIDE, foreign) for b, w, v in zip(blocks, within, first, strict=True)]
    none_good = not any(within) and GOOD not in first
    sides: list[list[tuple[int, int] | None]] = [[None, None] for _ in blocks]
    for side, order in ((0, range(len(blocks))), (1, range(len(blocks) - 1, -1, -1))):
        near: dict[bool, tuple[int, int]] = {}  # nearest decided block so far: of an article, of all
        for i in order:
            sides[i][side] = near.get(within[i])
            if first[i] is not UNSURE:
                near[False] = (i, first[i])
                if within[i]:
                    near[True] = near[False]
    out = []
    for i, (b, v) in enumerate(zip(blocks, first, strict=True)):
        if v is UNSURE:
            left, right = sides[i]
            decided = {s[1] for s in (left, right) if s}
            if none_good or (within[i] and not decided):
                v = GOOD
            elif not decided:
                v = BAD
            elif len(decided) == 1:
                v = decided.pop()
            elif within[i]:
                v = GOOD
            elif article:
                v = BAD
            else:
                v = left[1] if i - left[0] <= right[0] - i and not b.heading else right[1]
        out.append(v)
    return out


def main_text(page: str | None) -> str:
    """Text of a page's good blocks."""
    blocks, marks = blocks_of(page or "")
    return "\n\n".join(b.text for b, v in zip(blocks, labels(blocks, marks), strict=True) if v == GOOD)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` for every row."""
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [main_text(v.as_py()) for v in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return base.mapInArrow(run, "page_id long, url string, text string, n_chars long")
