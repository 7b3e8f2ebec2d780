"""Main text of web pages by nearest-URL page differencing.

A page is cut into blocks of text. Within a host the distinct pages are ordered by URL path and each is compared with its
nearest neighbours on both sides; the two sequences of blocks are aligned by a longest common subsequence, and blocks that a
page shares with most of its neighbours are template, not text: they are deleted. What the markup itself says is checked
afterwards and wins: blocks of elements that are never text (menus, forms, adverts, comments and so on) go although no
neighbour shares them, and where a page marks its article, exactly that is kept, so that passages which several articles
quote survive.

The comparison works on 64-bit hashes of blocks, in ranges of (host, path) over many tasks, so a host may hold any part of the
pages. Texts move only for pages of which differencing deletes something.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.url_filter import host_column, path_column
from tablewarden.session import cut

#: Comments, declarations and tags; a quoted attribute may hold ``>``, one whose quote never ends may not.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+>|[^>]*(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
SPACE = re.compile(r"\s+")
#: Elements whose content is no text of the page and no markup: skipped up to their end tag.
RAW = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)|\Z", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg")}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that hold no text of the page, and the same said by roles and by words in class names and ids. A word of the
#: second set counts only beside no word of the third.
NEVER_TEXT = frozenset("head nav header footer aside form button select option dialog menu canvas object audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
COMMENTS = frozenset("comment comments reply replies disqus".split())
STRONG = COMMENTS | frozenset("ad ads adbox advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination newsletter subscribe signup popup modal share sharing social related".split())
WEAK = frozenset("header footer masthead banner notice notices alert toolbar widget login search".split())
TEXT = frozenset("article content entry main post story text body title headline".split())
#: Kinds of blocks: of an element that is never text, of the marked article, of no such element.
NEVER, ARTICLE, OPEN = 0, 1, 2
#: Neighbours on each side that a page is compared with, and pages that a task compares at once.
NEIGHBOURS, SPAN = 2, 1024
#: Bits of the table from which an alignment is traced; larger ones are halved first.
TABLE_BITS = 1 << 28


def said_of(name: str, attributes: str) -> tuple[bool, bool]:
    """(never text of the page, its main element) by an element's name and attributes."""
    never, main = name in NEVER_TEXT, name == "main"
    if never or len(attributes) < 4 or name in ("html", "body"):
        return never, main
    said: dict[str, str] = {}
    for key, *values in ATTRIBUTE.findall(attributes):
        said.setdefault(key.lower(), next(filter(None, values), ""))  # of an attribute that is repeated the first counts
    role = said.get("role", "").lower()
    words = {w.lower() for w in NAME_WORD.findall(f"{said.get('class', '')} {said.get('id', '')}")}
    main = main or role == "main"
    if main or name == "article":
        return bool(words & COMMENTS) and not main, main
    return "hidden" in said or role in ROLES or bool(words & STRONG) or bool(words & WEAK and not words & TEXT), main


class Blocks:
    """Collects the blocks of a page from its tags. An element that isn't closed ends with the one around it; a paragraph
    or list item also where the next block begins. A header inside of the article keeps its headings."""

    def __init__(self):
        self.found: list[tuple[int, bool, str]] = []
        self.text: list[str] = []
        self.stack: list[tuple[str, str, bool, bool]] = []  # element, why it is never text, inside article, inside main
        self.open: dict[str, int] = {}

    def end_block(self) -> None:
        if self.text:
            joined = SPACE.sub(" ", html.unescape("".join(self.text))).strip()
            self.text.clear()
            if joined:
                _, never, article, main = self.stack[-1] if self.stack else ("", "", False, False)
                self.found.append((NEVER if never else ARTICLE if article else OPEN, main, joined))

    def never(self) -> str:
        return self.stack[-1][1] if self.stack else ""

    def never_around(self, name: str) -> str:
        """What holds around the innermost open element of that name."""
        at = max(i for i, entry in enumerate(self.stack) if entry[0] == name)
        return self.stack[at - 1][1] if at else ""

    def leave(self, name: str) -> None:
        while True:
            left = self.stack.pop()[0]
            self.open[left] -= 1
            if left == name:
                return

    def start(self, name: str, attributes: str) -> None:
        never_text, is_main = said_of(name, attributes)
        if name in INLINE:
            # an inline element splits no block, unless it is no text itself or inside of one of its name that isn't
            if name == "br":
                self.text.append(" ")
            if name in VOID or not (never_text or self.open.get(name)):
                return
            if never_text and not self.never():
                self.end_block()
        else:
            self.end_block()
        if name in VOID:
            return
        if name not in INLINE and self.stack:
            last = self.stack[-1][0]
            if last == "p" or last in HEADINGS or last == name == "li":
                self.leave(last)
        _, never, article, main = self.stack[-1] if self.stack else ("", "", False, False)
        if never == "header in article" and name in HEADINGS:
            never = ""
        elif not never and never_text:
            never = "header in article" if name == "header" and article else name
        self.stack.append((name, never, article or name == "article", main or is_main))
        self.open[name] = self.open.get(name, 0) + 1

    def end(self, name: str) -> None:
        if name not in INLINE:
            self.end_block()
        if self.open.get(name):
            if name in INLINE and self.never() and not self.never_around(name):
                self.end_block()
            self.leave(name)


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(kind, text) of all blocks of a page in order, references decoded, white space collapsed, empty ones left out.
    Where a page has no article but a main element, that is its article."""
    blocks, at = Blocks(), 0
    while at < len(page):
        tag = TAG.search(page, at)
        if tag is None:
            blocks.text.append(page[at:])
            break
        if tag.start() > at:
            blocks.text.append(page[at : tag.start()])
        at = tag.end()
        name = (tag.group(2) or "").lower()
        if tag.group(1):
            blocks.end(name)
        elif name in RAW:
            at = RAW[name].search(page, at).end()
        elif name:
            blocks.start(name, tag.group(3))
    blocks.end_block()
    marked = any(kind == ARTICLE for kind, _, _ in blocks.found)
    return [(ARTICLE if kind == OPEN and main and not marked else kind, text) for kind, main, text in blocks.found]


def prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each prefix of ``b``."""
    vector = rows_of(a, b)[-1] if a else (1 << len(b)) - 1
    bits = np.unpackbits(np.frombuffer(vector.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def rows_of(a: list[int], b: list[int]) -> list[int]:
    """A bit vector for each prefix of ``a``: bit j is 0 where the common subsequence grows with ``b[j]``."""
    where: dict[int, int] = {}
    for j, value in enumerate(b):
        where[value] = where.get(value, 0) | 1 << j
    full = (1 << len(b)) - 1
    vector, rows = full, []
    for value in a:
        both = vector & where.get(value, 0)
        vector = ((vector + both) | (vector - both)) & full
        rows.append(vector)
    return rows


def aligned(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, in order."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    end = 0
    while end < min(len(a), len(b)) - low and a[-1 - end] == b[-1 - end]:
        end += 1
    found, tail = list(range(low)), list(range(len(a) - end, len(a)))
    both = set(a[low : len(a) - end]) & set(b[low : len(b) - end])
    places = [i for i in range(low, len(a) - end) if a[i] in both]
    mine, other = [a[i] for i in places], [x for x in b[low : len(b) - end] if x in both]
    if len(mine) * len(other) > TABLE_BITS and len(mine) > 1:
        half = len(mine) // 2
        split = int(np.argmax(prefix_lengths(mine[:half], other) + prefix_lengths(mine[:half - 1 : -1], other[::-1])[::-1]))
        chosen = aligned(mine[:half], other[:split]) + [half + i for i in aligned(mine[half:], other[split:])]
    else:
        chosen, rows, i, j = [], rows_of(mine, other), len(mine), len(other)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if not i or rows[i - 1] >> (j - 1) & 1:
                    chosen.append(i)
                    j -= 1
        chosen.reverse()
    return found + [places[i] for i in chosen] + tail


def shared_blocks(pages: list[list[int]], hosts: list[str], at: int) -> list[int]:
    """Blocks of page ``at`` that it shares with most of its neighbours of the same host."""
    near = [i for i in range(max(0, at - NEIGHBOURS), min(len(pages), at + NEIGHBOURS + 1)) if i != at and hosts[i] == hosts[at]]
    votes = np.zeros(len(pages[at]), np.int64)
    for i in near:
        votes[aligned(pages[at], pages[i])] += 1
    return np.flatnonzero(2 * votes > len(near)).tolist()


def sketches(pages: DataFrame, trust_markup: bool) -> DataFrame:
    """host, path, key, content, blocks, open: hashes of the blocks of each page that may be text; ``content`` is one of
    all of them, ``open`` says that no article is marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, hashes, ends, is_open = [], [], [0], []
            for page in batch.column("html"):
                blocks = blocks_of(page.as_py() or "")
                mine = [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for kind, t in blocks if kind != NEVER or not trust_markup]
                is_open.append(not trust_markup or not any(kind == ARTICLE for kind, _ in blocks))
                content.append(xxhash.xxh64_intdigest(np.array(mine, np.int64).tobytes()) - (1 << 63))
                hashes += mine
                ends.append(len(hashes))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes, pa.int64()))
            columns = [batch.column("host"), batch.column("path"), batch.column("key"), pa.array(content, pa.int64()), lists, pa.array(is_open, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "path", "key", "content", "blocks", "open"])

    return pages.select("host", "path", "key", "html").mapInArrow(run, "host string, path string, key bigint, content bigint, blocks array<bigint>, open boolean")


def deletions(sketched: DataFrame) -> DataFrame:
    """(key, shared): the blocks that differencing deletes, for pages without a marked article that lose any."""
    group = ["host", "content"]
    pages = sketched.where("host <> ''").groupBy(*group).agg(F.min("path").alias("path"), F.first("blocks").alias("blocks"), F.max("open").alias("open"))
    pages = pages.repartitionByRange("host", "path", "content").sortWithinPartitions("host", "path", "content")
    pages = cut(pages.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    rows, start = [], 0
    for r in sorted(pages.groupBy("part").count().collect()):  # one row a partition
        rows.append((r["part"], start))
        start += r["count"]
    starts = pages.sparkSession.createDataFrame(rows, "part int, start bigint")
    numbered = pages.join(F.broadcast(starts), "part").withColumn("number", F.col("start") + F.col("place"))
    # a span of pages also gets the last pages of the span before it and the first ones of the span behind it
    spans = F.array_distinct(F.array(*[F.floor((F.col("number") + d) / SPAN).cast("long") for d in (-NEIGHBOURS, 0, NEIGHBOURS)]))
    spread = numbered.select(*group, "blocks", "open", "number", F.explode(spans).alias("span"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        hosts, blocks = table.column("host").to_pylist(), table.column("blocks").to_pylist()
        span, numbers = table.column("span")[0].as_py(), table.column("number").to_pylist()
        asked = [i for i, x in enumerate(table.column("open").to_pylist()) if x and numbers[i] // SPAN == span]
        shared = [shared_blocks(blocks, hosts, i) for i in asked]
        chosen = [k for k, x in enumerate(shared) if x]
        out = table.select(group).take(pa.array([asked[k] for k in chosen], pa.int64()))
        return out.append_column("shared", pa.array([shared[k] for k in chosen], pa.list_(pa.int32())))

    found = spread.groupBy("span").applyInArrow(run, "host string, content bigint, shared array<int>")
    return sketched.join(found, group).groupBy("key").agg(F.first("shared").alias("shared"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", trust_markup: bool = True) -> DataFrame:
    """page_id, url, text: the main text of every page, its blocks joined by newlines.

    Blocks begin and end where block elements do; character references are decoded and white space inside of a block,
    line breaks too, becomes one space. Pages of one host (as in ``url_filter``) are compared with up to two distinct
    neighbours on each side, by path; pages with equal blocks are one page there, so copies of a page don't delete its
    text. A block shared in place (aligned by a longest common subsequence) with more than half of the neighbours is
    deleted; a host's only page loses nothing. Then the markup is followed: elements that are never text are left out,
    and a page that marks its article (or else its main element) gives all blocks of that and no others. With
    ``trust_markup=False`` differencing alone decides.

    One row per row of ``pages``, repeated ids, URLs and rows as often as they occur. Null and empty pages give an empty
    text, as do pages of template only; a null url, or one without host, takes part in no comparison. Broken markup is
    read as browsers would, as far as blocks go; pages of any length are read whole. Other columns don't matter. Hashes
    of blocks are shuffled; pages themselves are joined to the deletions, which Spark broadcasts if they are few.
    """
    url, page = F.col(url_col), F.col(html_col)
    host, path = host_column(url), path_column(url)
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), page.alias("html"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("key", F.xxhash64("url", "html"))
    sketched = cut(sketches(rows, trust_markup))
    found = cut(deletions(sketched))
    joined = rows.select("page_id", "url", "html", "key").join(found, "key", "left").select("page_id", "url", "html", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, shared in zip(batch.column("html"), batch.column("shared"), strict=True):
                blocks = blocks_of(page.as_py() or "")
                if trust_markup:
                    blocks = [b for b in blocks if b[0] != NEVER]
                    marked = [b for b in blocks if b[0] == ARTICLE]
                    blocks = marked or blocks
                gone = set(shared.as_py() or ())
                texts.append("\n".join(text for i, (_, text) in enumerate(blocks) if i not in gone))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string")
