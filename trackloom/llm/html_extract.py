"""Main text of web pages by two-pass block rules.

A page is read into blocks of text. The first pass decides each block by its share of linked characters, its length and
its share of stop words; short blocks stay undecided. The second pass gives an undecided block the label of its nearest
decided neighbours. Elements and names that mark a page's apparatus count against a block, but for a wrapper that holds
the page; an article element is the article, unless it is outweighed by a story beside it.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Elements whose text is never shown as text, and those that hold a page's apparatus.
HIDDEN = frozenset("head script style noscript template iframe object svg math canvas audio video map select option datalist textarea button".split())
APPARATUS = frozenset("nav footer aside form dialog menu".split())
#: Of those, what is never a wrapper of the article as long as any text stands outside.
NEVER = frozenset("nav footer aside dialog menu header".split())
MAIN = frozenset("article main".split())
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that name a page's apparatus.
NAMED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|footer|sidebar|side|widget|related|share|social|comments?|disqus|respond|replies|reply|cookies?|consent|notice|popup|modal|newsletter|subscribe|login|signup|search|pagination|pager|copyright|legal|contentinfo|complementary|navigation)(?:$|[\s_-])", re.I)
#: The same for a page's head, which within an article is the article's own.
HEADING = re.compile(r"(?:^|[\s_-])(?:header|masthead|banner)(?:$|[\s_-])", re.I)
#: Fixed list: frequent function words of the four languages of the corpus.
STOP_WORDS = frozenset(
    "the of and to in a is that it was for on are with as by at from this be or an he not his have had which you but they "
    "de la le les et des en un une du que est pour dans par sur pas au plus avec ce il se ne qui sont "
    "der die das und den von zu mit ist des sich ein eine nicht auf dem im für auch als an es war "
    "el los las y por con para del se una no lo su al como más o pero sus".split()
)
#: First pass: most linked share; length in characters from which a block is long; least share of stop words of good
#: text; share under which a long block outside the article is no prose.
LINKED, LONG, STOPPED, PROSE = 0.5, 70, 0.08, 0.02
GOOD, BAD, OPEN = "good", "bad", "open"
#: Share of the good text under which an article element may be another story's card; how many times the text outside a
#: wrapper must hold; how many wrappers may be within each other.
CARD, TIMES, LET_OFF = 0.3, 4, 8
#: Names of readers' parts, which may be longer than the article.
READERS = re.compile(r"comment|disqus|respond|repl(?:y|ies)", re.I)


@dataclass
class Block:
    text: str
    linked: float
    in_main: bool
    #: Number of the innermost marked element around it, or -1.
    mark: int
    head: bool


@dataclass
class Mark:
    """A marked element: the marked element around it or -1; whether it is never a wrapper; whether one of its names is
    exactly one of apparatus; whether it is a readers' part."""

    around: int
    never: bool
    exact: bool
    readers: bool


class Reader(HTMLParser):
    """Blocks of a page in their order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        #: Open elements by name and mark: the number of a marked element, or -1.
        self.open: list[tuple[str, int]] = []
        self.names: Counter[str] = Counter()
        self.hidden = self.main = self.links = 0
        self.within: list[int] = []
        self.marks: list[Mark] = []
        self.parts: list[tuple[str, bool]] = []

    def end_block(self) -> None:
        text = " ".join("".join(t for t, _ in self.parts).split())
        if text:
            linked = sum(len("".join(t.split())) for t, on in self.parts if on)
            self.blocks.append(Block(text, linked / max(1, len(text.replace(" ", ""))), self.main > 0, self.within[-1] if self.within else -1, self.names["h1"] > 0))
        self.parts = []

    def count(self, tag: str, mark: int, by: int) -> None:
        self.names[tag] += by
        self.hidden += by * (tag in HIDDEN)
        self.main += by * (tag in MAIN)
        self.links += by * (tag == "a")
        if mark >= 0:
            self.within.append(mark) if by > 0 else self.within.pop()  # elements close from the inside

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.end_block()
        if tag in VOID:
            self.parts.append((" " if tag == "br" else "", False))
            return
        if tag in BLOCKS and tag != "html" and self.names["head"]:  # a head that wasn't closed
            self.close_from(next(k for k, (name, _) in enumerate(self.open) if name == "head"))
        marked, mark = tag in APPARATUS or tag == "header" and not self.main, -1
        if tag not in ("html", "body", "article", "main"):
            names = [v for k, v in attrs if k in ("class", "id", "role") and v]
            marked = marked or any(NAMED.search(v) or not self.main and HEADING.search(v) for v in names)
            if marked:
                mark = len(self.marks)
                exact = any(NAMED.fullmatch(x) for v in names for x in v.split())
                self.marks.append(Mark(self.within[-1] if self.within else -1, tag in NEVER, exact, any(READERS.search(v) for v in names)))
        if tag == "p" or tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
            self.close_implied(tag)
        self.open.append((tag, mark))
        self.count(tag, mark, 1)

    def close_implied(self, tag: str) -> None:
        """A paragraph, list item or cell ends where the next one begins."""
        if not self.names[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name == tag:
                self.close_from(k)
                return
            if name in BLOCKS:
                return

    def close_from(self, k: int) -> None:
        for name, mark in reversed(self.open[k:]):
            self.count(name, mark, -1)
        del self.open[k:]

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self.end_block()
        self.parts.append((" " if tag == "br" else "", False))

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.end_block()
        if not self.names[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.close_from(k)
                return
            if self.open[k][0] in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                return

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append((data, self.links > 0))

    def finish(self) -> list[Block]:
        self.close()
        self.end_block()
        return self.blocks


def stopped(text: str) -> tuple[int, float]:
    """Words of a text and the share of stop words among them."""
    words = [w.strip(".,;:!?\"'()").lower() for w in text.split()]
    return len(words), sum(w in STOP_WORDS for w in words) / len(words)


def first_pass(block: Block, known: bool = True) -> str:
    """What a block is by its own text; known: whether the page is in a language whose stop words are known."""
    if block.linked > LINKED:
        return OPEN if block.in_main and len(block.text) < LONG and block.linked < 0.9 else BAD
    words, share = stopped(block.text)
    if len(block.text) >= LONG:
        if share >= STOPPED or block.in_main or not known:
            return GOOD
        return BAD if share < PROSE else OPEN
    return GOOD if block.in_main and share >= STOPPED and words >= 4 else OPEN


def second_pass(blocks: list[Block], labels: list[str]) -> list[bool]:
    """Whether each block stays. An undecided block takes the label that its nearest decided neighbours before and
    after share; where they differ, or there is none, it stays if it is in the article, or if there is no article and
    the nearer neighbour is good."""
    n = len(blocks)
    before, after = [-1] * n, [-1] * n
    seen = -1
    for k in range(n):
        before[k] = seen
        seen = k if labels[k] != OPEN else seen
    seen = -1
    for k in range(n - 1, -1, -1):
        after[k] = seen
        seen = k if labels[k] != OPEN else seen
    kept = []
    for k, block in enumerate(blocks):
        if labels[k] != OPEN:
            kept.append(labels[k] == GOOD)
            continue
        near = [j for j in (before[k], after[k]) if j >= 0]
        if block.in_main:
            inside = [labels[j] for j in near if blocks[j].in_main]
            kept.append(GOOD in inside or not inside)
        elif len({labels[j] for j in near}) == 1:
            kept.append(labels[near[0]] == GOOD)
        else:
            kept.append(bool(near) and labels[min(near, key=lambda j: abs(j - k))] == GOOD)
    return kept


def long_text(blocks: list[Block]) -> int:
    return sum(len(b.text) for b in blocks)


def plain_marks(blocks: list[Block], labels: list[str], marks: list[Mark]) -> list[bool]:
    """For each marked element whether it, and all around it, are wrappers of the page and not its apparatus.

    Where no text stands outside of marked elements, the one with the most good text is a wrapper, and again within it.
    Where some does, only an element that holds many times as much of it can be one, if it has the page's heading or its
    names only remind of apparatus (as no-sidebar does), and never a foot, a menu or an aside."""
    wrapper, plain = [False] * len(marks), [False] * len(marks)
    for _ in range(LET_OFF):
        size, head = [0] * len(marks), [False] * len(marks)
        outside = 0
        for b, label in zip(blocks, labels, strict=True):
            if b.mark < 0 or plain[b.mark]:
                outside += len(b.text) * (b.linked <= LINKED)
            if b.mark >= 0:
                size[b.mark] += len(b.text) * (label == GOOD)
                head[b.mark] |= b.head
        for m in range(len(marks) - 1, -1, -1):  # what lies within has the higher number
            if (around := marks[m].around) >= 0:
                size[around] += size[m]
                head[around] |= head[m]
        fit = [m for m, x in enumerate(marks) if not wrapper[m] and size[m] and not x.readers and (not outside or not x.never and size[m] > TIMES * outside and (head[m] or not x.exact))]
        if not fit:
            break
        wrapper[max(fit, key=lambda m: (size[m], -m))] = True
        for m, x in enumerate(marks):
            plain[m] = wrapper[m] and (x.around < 0 or plain[x.around])
    return plain


def kept_blocks(blocks: list[Block], marks: list[Mark]) -> list[Block]:
    """The blocks of the article."""
    known = any(len(b.text) >= LONG and stopped(b.text)[1] >= STOPPED for b in blocks)
    wrapped = plain_marks(blocks, [first_pass(b, known) for b in blocks], marks)
    plain = lambda b: b.mark < 0 or wrapped[b.mark]
    inside = [b for b in blocks if b.in_main and plain(b)]
    beside = [b for b in blocks if not b.in_main and plain(b)]
    if inside:
        story = [b for b in beside if first_pass(b, known) == GOOD]
        held, other = long_text(inside), long_text(story)
        # a story that is longer by far, and of longer paragraphs or with the page's heading: the article element is a card
        if held < CARD * (held + other) and (max(len(b.text) for b in story) > held or any(b.head for b in beside) and not any(b.head for b in inside)):
            blocks = [b for b in blocks if not b.in_main]
        else:
            blocks = [b for b in blocks if b.in_main]
    else:
        for b in blocks:
            b.in_main = False
    kept = second_pass(blocks, [first_pass(b, known) if plain(b) else BAD for b in blocks])
    if not any(kept):  # too little to decide by: all that is neither linked nor apparatus
        kept = [plain(b) and b.linked <= LINKED for b in blocks]
    return [b for b, stays in zip(blocks, kept, strict=True) if stays]


def main_text(html: str | None) -> str:
    """The article of a page: its blocks, each with single spaces, joined by an empty line. Null, empty or without text: empty."""
    if not html:
        return ""
    reader = Reader()
    reader.feed(html)
    return "\n\n".join(b.text for b in kept_blocks(reader.finish(), reader.marks))


def extract(pages: DataFrame, *, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns of pages (or those in keep) but the html, with text and n_chars (its code points).

    Every row is read whole and by itself, repeated or not. Columns of pages named text or n_chars give way."""
    bound_batches(pages.sparkSession)
    columns = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars", html_col)]
    rows = pages.select(*columns, F.col(html_col).alias("_html"))
    fields = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns), "text string, n_chars long"])

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*columns, "text", "n_chars"])

    return rows.mapInArrow(run, fields)
