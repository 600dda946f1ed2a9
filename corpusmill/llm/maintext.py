"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. The first pass decides blocks by where they stand,
by the share of their text inside links, by length and by the share of stop words. Short or
unclear blocks stay open; the second pass gives them the label of their nearest decided neighbours.

Class names, ids and roles that speak of menus, adverts and the like decide about what stands in
their element, unless that leaves nothing of the page: then the names on elements that hold more
than half of its text are not believed. Where the stop words of no listed language occur, length and
link density decide alone. Time is in step with the page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.base import query, slices, sql_type, table

# Most frequent function words of four languages (fixed values).
STOP_WORDS = frozenset(
    (
        "a an and are as at be but by for from had has have he her his i in is it its not of on or "
        "she that the their they this to was we were what which who will with you "
        "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on "
        "ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
        "als auch auf aus bei das dem den der des die durch ein eine einen er es für hat ich im in "
        "ist mit nach nicht noch oder sich sie sind so um und von war wie zu zum zur über "
        "al como con de del el en era es esta este fue ha la las lo los más no o para pero por que "
        "se ser si sin sobre su sus también un una y ya"
    ).split()
)

BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# The text up to the end tag is no markup.
RAW_TAGS = frozenset("script style textarea title xmp noembed noframes".split())
# Elements that never hold the main text.
OUTSIDE_TAGS = frozenset(
    "aside button canvas datalist dialog fieldset footer form head iframe math menu nav noscript "
    "object script select style svg template textarea title".split()
)
CONTAINER_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# Words in a class, id or role that mark what is not the article, if the name says nothing else
# beside them and the plain words below.
OUTSIDE_NAMES = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments "
    "complementary consent contentinfo cookie cookies disqus footer gdpr header masthead menu modal nav "
    "navbar navigation newsletter notice notices pagination popup promo promotion related respond "
    "search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)

PLAIN_NAMES = frozenset(
    "area bar block body bottom box container content foot global head inner item items left link links list "
    "main outer panel primary right row secondary section site slot text title top unit wrap wrapper".split()
)

SHORT = 70
LONG = 200
STOP_LOW = 0.10
STOP_HIGH = 0.20
# Below this share over all long blocks of a page, no list of stop words fits its language.
STOP_NONE = 0.05
LINKS = 0.4
# A sign of these scripts, which have no spaces or few, says as much as three letters.
_DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\U00020000-\U0003ffff]")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.DOTALL
)
# A tag with a quote that nothing closes, to the end of the page; from there on quotes mean nothing.
_UNCLOSED = re.compile(r"</?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*+(?:\"[^\"]*|'[^']*)\Z", re.DOTALL)
_LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>|<[!?][^>]*>", re.DOTALL)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"\w+")

GOOD, BAD, OPEN = "good", "bad", "open"


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    heading: bool
    outside: bool  # stands in an element that is not the article
    contained: bool  # stands in an article element
    mark: int = -1  # innermost element around it whose name speaks against it
    label: str = OPEN


@dataclass
class _Open:
    """An open element, with what it hands down to those inside."""

    tag: str
    outside: bool
    contained: bool
    mark: int


@dataclass
class _Reader:
    """Open elements and the block that is being read."""

    stack: list[_Open] = field(default_factory=list)
    count: Counter = field(default_factory=Counter)
    lists: list[str] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    # For every element with a telling name the one around it, or -1.
    marks: list[int] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    heading: bool = False

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.stack[-1] if self.stack else _ROOT
            self.blocks.append(Block(text, self.linked, self.heading, top.outside, top.contained, top.mark))
        self.parts, self.linked = [], 0

    def add(self, raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if self.count["a"]:
            self.linked += len("".join(text.split()))

    def open(self, tag: str, attributes: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
            # A paragraph ends where the next block begins, a list item at the next item.
            self.close("p")
            if tag == "li" and self.lists and self.lists[-1] == "li":
                self.close("li")
            self.heading = tag in HEADINGS
        if tag in VOID_TAGS:
            return
        top = self.stack[-1] if self.stack else _ROOT
        contained = top.contained or tag in CONTAINER_TAGS
        outside = top.outside or tag in OUTSIDE_TAGS or (tag == "header" and not contained)
        mark = top.mark
        if not outside and attributes and tag not in CONTAINER_TAGS and tag not in ("html", "body"):
            outside = bool(_HIDDEN.search(attributes))
            if not outside and _speaks_against(attributes, contained):
                self.marks.append(mark)
                mark = len(self.marks) - 1
        self.stack.append(_Open(tag, outside, contained, mark))
        self.count[tag] += 1
        if tag in _LISTS:
            self.lists.append(tag)

    def close(self, tag: str) -> None:
        while self.count[tag]:
            name = self.stack[-1].tag
            if name in BLOCK_TAGS:
                self.flush()
                self.heading = False
            self.stack.pop()
            self.count[name] -= 1
            if name in _LISTS:
                self.lists.pop()
            if name == tag:
                break


_ROOT = _Open("", False, False, -1)
_LISTS = frozenset(("li", "ul", "ol"))


def _speaks_against(attributes: str, contained: bool) -> bool:
    """Is there a name like ``sidebar`` or ``site-footer``? ``has-sidebar`` or ``ad-free`` is none."""
    for name in " ".join(n.strip("\"'") for n in _NAMES.findall(attributes)).split():
        words = {w.lower() for w in _PART.findall(name)}
        # The header of an article holds its title.
        telling = words & OUTSIDE_NAMES - ({"header"} if contained else set())
        if telling and words <= OUTSIDE_NAMES | PLAIN_NAMES:
            return True
    return False


def _read(page: str) -> _Reader:
    reader, at, token_of = _Reader(), 0, _TOKEN
    while at < len(page):
        place = page.find("<", at)
        if place < 0:
            reader.add(page[at:])
            break
        token = token_of.match(page, place)
        if token is None and token_of is _TOKEN and _UNCLOSED.match(page, place):
            token_of = _LOOSE
            token = token_of.match(page, place)
        if token is None:
            reader.add(page[at : place + 1])
            at = place + 1
            continue
        if place > at:
            reader.add(page[at:place])
        at = token.end()
        if not token[2]:
            continue
        tag = token[2].lower()
        if token[1]:
            reader.close(tag)
        elif tag == "br":
            reader.add(" ")
        else:
            reader.open(tag, token[3])
            if tag in RAW_TAGS:
                end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
                reader.close(tag)
    reader.flush()
    return reader


def read_blocks(page: str) -> list[Block]:
    """Blocks of a page in order; text directly in inline markup belongs to the block around it.

    Blocks in an element whose name speaks against it count as outside, unless nothing else is left.
    """
    reader = _read(page)
    plain = [b.outside for b in reader.blocks]
    believed = [True] * len(reader.marks)
    _set_outside(reader, plain, believed)
    if reader.marks and not any(b.label == GOOD for b in label_blocks(reader.blocks)):
        # Which named elements hold most of the text? A name stands before those inside it.
        held = [0] * len(reader.marks)
        for block, outside in zip(reader.blocks, plain):
            if block.mark >= 0 and not outside:
                held[block.mark] += len(block.text)
        for mark in range(len(held) - 1, -1, -1):
            if reader.marks[mark] >= 0:
                held[reader.marks[mark]] += held[mark]
        total = sum(len(b.text) for b, outside in zip(reader.blocks, plain) if not outside)
        _set_outside(reader, plain, [2 * h <= total for h in held])
    return reader.blocks


def _set_outside(reader: _Reader, plain: list[bool], believed: list[bool]) -> None:
    against: list[bool] = []
    for mark, parent in enumerate(reader.marks):
        against.append(believed[mark] or (parent >= 0 and against[parent]))
    for block, outside in zip(reader.blocks, plain):
        block.outside = outside or (block.mark >= 0 and against[block.mark])


def _weight(text: str) -> int:
    """Length in letters."""
    return len(text) + 2 * len(_DENSE.findall(text))


def _links(block: Block) -> float:
    return block.linked / max(len(block.text.replace(" ", "")), 1)


def _stop_words(text: str) -> tuple[int, int]:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def _decide(block: Block, listed: bool) -> str:
    """First pass; ``listed`` says that the page's language has stop words here."""
    if block.outside or _links(block) > LINKS:
        return BAD
    if _weight(block.text) < SHORT or block.heading:
        return OPEN
    if not listed:
        return GOOD
    stop, words = _stop_words(block.text)
    share = stop / max(words, 1)
    if share >= STOP_HIGH or (share >= STOP_LOW and len(block.text) > LONG):
        return GOOD
    # Inside an article element a block of few stop words may be a list of names or a table.
    return OPEN if block.contained or share >= STOP_LOW else BAD


def label_blocks(blocks: list[Block]) -> list[Block]:
    """Both passes. Blocks outside an article element do not vote on blocks inside one."""
    long = [b.text for b in blocks if not b.outside and not b.heading and _links(b) <= LINKS and _weight(b.text) >= SHORT]
    stop, words = (sum(n) for n in zip(*map(_stop_words, long))) if long else (0, 0)
    listed = stop >= STOP_NONE * words
    decided = [_decide(b, listed) for b in blocks]
    before, after = (_nearest(blocks, decided, step) for step in (1, -1))
    for i, block in enumerate(blocks):
        block.label = decided[i]
        if decided[i] != OPEN:
            continue
        near = [j for j in (before[i], after[i]) if j is not None]
        if not near:
            # Nothing around is decided: inside an article element that is the article.
            block.label = GOOD if block.contained else BAD
        elif block.heading and after[i] is not None:
            block.label = decided[after[i]]
        else:
            # The nearer one; the article wins a tie.
            block.label = decided[min(near, key=lambda j: (abs(j - i), decided[j] != GOOD))]
    return blocks


def _nearest(blocks: list[Block], decided: list[str], step: int) -> list[int | None]:
    """For every block the last decided one on the way to it that may vote on it."""
    # Inside an article element only blocks of the article vote, elsewhere those outside of one.
    last: dict[bool, int | None] = {False: None, True: None}
    out: list[int | None] = [None] * len(blocks)
    for i in range(len(blocks))[::step]:
        block = blocks[i]
        out[i] = last[block.contained]
        if decided[i] != OPEN and not (block.contained and block.outside):
            last[block.contained] = i
    return out


def main_text(page: str) -> str:
    """Text of the good blocks, one per line; empty if there are none."""
    return "\n".join(b.text for b in label_blocks(read_blocks(page)) if b.label == GOOD)


def extract_main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """``(*keep, text, n_chars)``: one row per page; null and empty pages give an empty text.

    Pages are read whole; repeated rows and nulls in ``keep`` stay; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cells in slices(batches, len(keep)):
            texts = [main_text(c) for c in cells]
            yield pa.record_batch(
                [*(part.column(i) for i in range(len(keep))), pa.array(texts, pa.string())]
                + [pa.array([len(t) for t in texts], pa.int64())],
                [*keep, "text", "n_chars"],
            )

    kept = ", ".join(f"`{c}` {sql_type(pages, c)}" for c in keep)
    return pages.select(*keep, html).mapInArrow(work, f"{kept}, text string, n_chars bigint")


@query("op2_main_text")
def _op2(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(table(spark, folder, "pages"))
