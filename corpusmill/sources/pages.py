"""Text and links of stored web pages, and page texts put together."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.batches import sliced
from corpusmill.functions.text import blank_to_null, strip_ws
from corpusmill.sources.selectors import Element, Selector

# Shortest text that counts as extracted.
MIN_CHARS = 200
# A block is prose when it is this long and mostly outside links.
_BLOCK_CHARS = 40
_LINK_SHARE = 0.5

# Columns that a parse makes: their types in Spark and in Arrow.
_MADE: dict[str, tuple[str, pa.DataType]] = {
    "extract_method": ("string", pa.string()),
    "text": ("string", pa.string()),
    "full_text": ("string", pa.string()),
    "links": (
        "array<struct<position:int,url:string,text:string>>",
        pa.list_(pa.struct([("position", pa.int32()), ("url", pa.string()), ("text", pa.string())])),
    ),
}

_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = {"script", "style", "noscript"}
_RAW = {"script", "style", "template"}
_BLOCKS = set(
    "address article aside blockquote body dd div dl dt footer form h1 h2 h3 h4 h5 h6 header "
    "li main nav ol p pre section table td th tr ul".split()
)
# Elements that end where the next of their kind begins, and what they may be nested in.
_ITEMS: dict[str, tuple[set[str], frozenset[str]]] = {
    "li": ({"li"}, frozenset({"ul", "ol"})),
    "p": ({"p"}, frozenset({"div", "td", "li"})),
    "dt": ({"dt", "dd"}, frozenset({"dl"})),
    "dd": ({"dt", "dd"}, frozenset({"dl"})),
    "tr": ({"tr"}, frozenset({"table"})),
    "td": ({"td", "th"}, frozenset({"tr", "table"})),
    "th": ({"td", "th"}, frozenset({"tr", "table"})),
}


class _Page(HTMLParser):
    """Collects text nodes, prose blocks and link targets of one page."""

    def __init__(self, selector: Selector) -> None:
        super().__init__(convert_charrefs=True)
        # Tags of the open elements; for selectors the same with their attributes, where elements
        # without an end tag end as browsers see it.
        self.path: list[str] = []
        self.above: list[Element] = []
        self.nodes: list[str] = []
        self.blocks: list[list[str]] = [[]]
        self.linked: list[int] = [0]
        self.anchors: list[dict] = []
        self.selector = selector
        self.open_anchors: list[tuple[int, dict]] = []
        self.run: list[str] = []

    def _flush(self) -> None:
        text, self.run = "".join(self.run), []
        if not text:
            return
        inside = set(self.path)
        if not inside & _RAW:
            for _, anchor in self.open_anchors:
                anchor["text"].append(text)
        if inside & (_HIDDEN | _RAW):
            return
        self.nodes.append(text)
        piece = " ".join(text.split())
        if piece:
            self.blocks[-1].append(piece)
            self.linked[-1] += len(piece) if "a" in inside else 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._flush()
        if tag in _BLOCKS:
            self._new_block()
        if tag in _ITEMS:
            self._close(*_ITEMS[tag])
        element = (tag, dict(attrs))
        if self.selector.matches(element, self.above):
            anchor = {"href": (element[1].get("href") or "").strip(), "text": []}
            self.anchors.append(anchor)
            if tag not in _VOID:
                self.open_anchors.append((len(self.path), anchor))
        if tag not in _VOID:
            self.path.append(tag)
            self.above.append(element)

    def _close(self, tags: set[str], within: frozenset[str] = frozenset()) -> None:
        """Close the innermost open element of ``tags``, unless one of ``within`` was opened in it."""
        for i in range(len(self.above) - 1, -1, -1):
            if self.above[i][0] in tags:
                del self.above[i:]
                return
            if self.above[i][0] in within:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if tag in _BLOCKS:
            self._new_block()
        self._close({tag})
        if tag in self.path:
            depth = len(self.path) - 1 - self.path[::-1].index(tag)
            del self.path[depth:]
            self.open_anchors = [pair for pair in self.open_anchors if pair[0] < depth]

    def handle_data(self, data: str) -> None:
        self.run.append(data)

    def handle_comment(self, data: str) -> None:
        self._flush()

    def handle_decl(self, decl: str) -> None:
        self._flush()

    def _new_block(self) -> None:
        if self.blocks[-1]:
            self.blocks.append([])
            self.linked.append(0)

    def finish(self, html: str) -> "_Page":
        self.feed(html)
        self.close()
        self._flush()
        return self

    def full_text(self) -> str:
        lines = (line.strip() for line in "\n".join(self.nodes).splitlines())
        return "\n".join(line for line in lines if line)

    def main_text(self) -> str:
        """Blocks that read as prose rather than navigation."""
        kept = []
        for pieces, linked in zip(self.blocks, self.linked):
            text = " ".join(pieces)
            if len(text) >= _BLOCK_CHARS and linked < _LINK_SHARE * len(text):
                kept.append(text)
        return "\n".join(kept)


def _links(page: _Page, base: str, same_domain_only: bool) -> list[dict]:
    host = urlparse(base).netloc
    found: dict[str, str] = {}
    for anchor in page.anchors:
        if not anchor["href"]:
            continue
        try:
            target = urljoin(base, anchor["href"])
            foreign = urlparse(target).netloc not in ("", host)
        except ValueError:
            continue
        if not (same_domain_only and foreign):
            found.setdefault(target, " ".join(" ".join(t.strip() for t in anchor["text"]).split()))
    return [{"position": i, "url": u, "text": t} for i, (u, t) in enumerate(found.items())]


def page_extract(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    same_domain_only: bool = False,
    selector: str = "a",
) -> DataFrame:
    """Text, extraction method, links and markup of each page, in one parse.

    ``text`` is the prose of the page (method ``main``) when that has at least
    200 characters, else all visible text (``full``). ``selector`` says which elements are links,
    see :class:`Selector`. Broken markup never fails a task.
    """
    return _extracted(pages, key, url, html, same_domain_only, selector, markup=True)


def _extracted(
    pages: DataFrame,
    key: str,
    url: str = "url",
    html: str = "html",
    same_domain_only: bool = False,
    selector: str = "a",
    made: Sequence[str] = tuple(_MADE),
    markup: bool = False,
) -> DataFrame:
    """Key, URL and the ``made`` columns of each page; what nobody asked for is not put together."""
    # A selector that is none fails here and not in a task.
    Selector(selector)
    kind = pages.schema[key].dataType.simpleString()
    names = [key, url, *made] + [html] * markup

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Selector(selector)
        for part in sliced(batches, 2):
            out: dict[str, list] = {name: [] for name in made}
            for address, source in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                page = _Page(wanted).finish(source if isinstance(source, str) else "")
                cells = {}
                if "links" in out:
                    cells["links"] = _links(page, address if isinstance(address, str) else "", same_domain_only)
                if "text" in out:
                    main, whole = page.main_text(), page.full_text()
                    good = len(main) >= MIN_CHARS
                    cells |= {"extract_method": "main" if good else "full", "text": main if good else whole, "full_text": whole}
                for name, column in out.items():
                    column.append(cells[name])
            columns = [pa.array(column, _MADE[name][1]) for name, column in out.items()]
            yield pa.record_batch([part.column(0), part.column(1), *columns] + [part.column(2)] * markup, names)

    return pages.select(key, url, html).mapInArrow(
        parse, ", ".join([f"{key} {kind}, {url} string", *(f"{n} {_MADE[n][0]}" for n in made)] + [f"{html} string"] * markup)
    )


def page_text(pages: DataFrame, key: str = "page_id", **options) -> DataFrame:
    """Text of each page and the method that gave it."""
    made = ("extract_method", "text", "full_text")
    return _extracted(pages, key, made=made, **options).select(key, *made)


def page_links(pages: DataFrame, key: str = "page_id", url: str = "url", **options) -> DataFrame:
    """One row per distinct link of a page, in document order."""
    links = _extracted(pages, key, url, made=("links",), **options).select(
        key, F.col(url).alias("page_url"), F.explode("links").alias("l")
    )
    return links.select(key, "page_url", "l.position", "l.url", "l.text")


def link_targets(pages: DataFrame, key: str = "page_id", url: str = "url", **options) -> DataFrame:
    """One row per linked address: its first parent and the number of parents.

    Counting before any join keeps an address that every page links to small.
    """
    links = page_links(pages, key, url, **options)
    return links.groupBy(F.col("url").alias("child_url")).agg(
        F.min("page_url").alias("parent_url"), F.count(F.lit(1)).alias("parents")
    )


def expand_links(pages: DataFrame, key: str = "page_id", url: str = "url", **options) -> DataFrame:
    """Child pages reachable from the given pages, with their parent.

    ``fetched`` tells whether the child is among the stored pages; the others
    are the frontier still to be fetched.
    """
    known = pages.select(F.col(url).alias("child_url"), F.col(key).alias("child_id"))
    known = known.groupBy("child_url").agg(F.min("child_id").alias("child_id"))
    return (
        link_targets(pages, key, url, **options)
        .join(known, "child_url", "left")
        .select(
            "child_url", "parent_url", "parents", "child_id",
            F.col("child_id").isNotNull().alias("fetched"),
        )
    )


def join_pages(df: DataFrame, key: str, position: str, text: str, alias: str = "text") -> DataFrame:
    """Texts of one document stripped, blanks dropped, joined by an empty line in order."""
    chunk = blank_to_null(strip_ws(F.col(text)))
    ordered = F.array_sort(F.collect_list(F.when(chunk.isNotNull(), F.struct(position, chunk.alias("t")))))
    return df.groupBy(key).agg(F.array_join(ordered["t"], "\n\n").alias(alias))


def first_long_text(candidates: Sequence[tuple[str, Column]], least: int = MIN_CHARS) -> Column:
    """Struct ``(method, text)`` of the first candidate with enough characters."""
    nothing = F.struct(F.lit("unparsed").alias("method"), F.lit("").alias("text"))
    picks = [
        F.when(F.length(text) >= least, F.struct(F.lit(name).alias("method"), text.alias("text")))
        for name, text in candidates
    ]
    return F.coalesce(*picks, nothing)


def assemble_pages(
    df: DataFrame, key: str, position: str, extractors: Sequence[tuple[str, str]]
) -> DataFrame:
    """Document texts from page texts: the first extractor with 200 characters wins.

    ``extractors`` are ``(method, column)``: alternative texts of the same page.
    A document's text is one cell, so its pages meet in one task; the key must
    name a document, not a source.
    """
    ordered = {}
    for method, column in extractors:
        chunk = blank_to_null(strip_ws(F.col(column)))
        pairs = F.collect_list(F.when(chunk.isNotNull(), F.struct(position, chunk.alias("t"))))
        ordered[method] = F.array_join(F.array_sort(pairs)["t"], "\n\n")
    joined = df.groupBy(key).agg(*[text.alias(f"__{m}") for m, text in ordered.items()])
    best = first_long_text([(m, F.col(f"__{m}")) for m in ordered])
    return joined.select(key, best.alias("b")).select(key, "b.method", "b.text")
