"""Main text of web pages by differencing pages that are near each other by URL.

Pages of a host are put in the order of their paths, and each page is paired
with the neighbour that shares the longer beginning of the path. Both pages are
cut into lines, one for each block of markup; the lines in a longest common
subsequence of the two are shared, which is what templates look like.

What the markup says for certain goes before that: menus, footers, adverts and
their kin are never text. The paragraphs, headings and list items of an article
are text even when a neighbour has them too, as neighbours may be copies of one
article. Other lines of an article, and all lines where a page marks no article,
are text if they are not shared.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, hash64, written
from .sequences import common_places

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?/a-zA-Z][^>]*>", re.DOTALL)
_RAW = re.compile(r"</(script|style|textarea|title|noscript|iframe|template|svg|select|button)\b[^>]*>", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_MARK = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
#: Elements whose content is never text,
RAW = frozenset("script style textarea title noscript iframe template svg select button".split())
#: elements that hold what surrounds the text,
AROUND = frozenset("nav footer aside form header menu dialog".split())
#: words in classes, ids and roles that say the same,
AROUND_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|sidebar|cookies?\w*|consent|notice\w*|gdpr|popup|modal|newsletter|"
    r"subscribe\w*|signup|share|sharing|social|related|recommended|comments?|comment-\w+|replies|respond|disqus|contentinfo|navigation|complementary|search|login|toolbar|pagination|pager|widget)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: such a word alone, or with what such parts of a page are called, which is what counts within an article,
AROUND_PART = re.compile(
    r"(?:ads?|advert|adbox|banner|sponsored|promo|breadcrumbs?|sidebar|cookies?|consent|popup|modal|newsletter|subscribe|signup|share|sharing|social|related|recommended|comments?|replies|respond|disqus|toolbar|pagination|pager|widget)"
    r"(?:[_-](?:area|bar|block|box|buttons?|container|form|icons?|links?|list|section|thread|widget|wrapper|\d+))?",
    re.IGNORECASE,
)
#: on elements that hold others,
PARTS = frozenset("div section ul ol span table".split())
#: elements that end a line,
BLOCK = frozenset("address article aside blockquote body br dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: elements that never hold anything,
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: and elements of running text.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption".split())
_CLOSES_P = BLOCK - {"br"}
NOT_TEXT, OPEN, INSIDE, ARTICLE = 0, 1, 2, 3


def page_lines(source: str | None) -> tuple[list[str], list[int]]:
    """(lines, what the markup says of each) of a page."""
    lines: list[str] = []
    zones: list[int] = []
    stack: list[tuple[str, bool, bool]] = []  # element, inside surroundings, inside an article
    part: list[str] = []
    around = article = text = False

    def end() -> None:
        line = _SPACE.sub(" ", html.unescape("".join(part))).strip()
        part.clear()
        if line:
            lines.append(line)
            zones.append(NOT_TEXT if around else (ARTICLE if text else INSIDE) if article else OPEN)

    def state() -> None:
        nonlocal around, article, text
        around, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        text = False
        for name, *_ in reversed(stack):
            if name in TEXT:
                text = True
            if name in ("article", "main"):
                break

    source, at = source or "", 0
    while at < len(source):
        m = _TOKEN.search(source, at)
        if m is None:
            part.append(source[at:])
            break
        part.append(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), m[1]
        if name in RAW:
            if not closing and not m[3].endswith("/"):
                stop = next((x for x in _RAW.finditer(source, at) if x[1].lower() == name), None)
                at = stop.end() if stop else len(source)
            continue
        if name in BLOCK:
            end()
        if name in VOID:
            continue
        if closing:
            if any(x[0] == name for x in stack):
                if name not in BLOCK or all(x[0] not in ("article", "main", "body") for x in stack[_last(stack, name) + 1 :]):
                    del stack[_last(stack, name) :]
        elif not m[3].endswith("/"):
            if name in _CLOSES_P and stack:
                p = _last(stack, "p")
                if p >= 0 and not any(x[0] in BLOCK for x in stack[p + 1 :]):
                    del stack[p:]
            if name == "li" and (k := _last(stack, "li")) >= 0 and not any(x[0] in ("ul", "ol", "menu") for x in stack[k + 1 :]):
                del stack[k:]
            outer_around, outer_article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            inside = outer_article or name in ("article", "main")
            values = [x or y or z for x, y, z in _MARK.findall(m[3])] if m[3] and name not in ("article", "main", "body", "html") else []
            if outer_article:  # ids and classes are often slugs of headings there
                marked = name in PARTS and any(AROUND_PART.fullmatch(part) for v in values for part in v.split())
            else:
                marked = any(map(AROUND_NAME.search, values))
            # a header inside an article holds its headline
            stack.append((name, outer_around or marked or (name in AROUND and not (name == "header" and outer_article)), inside))
        if name in BLOCK or closing:
            state()
    end()
    return lines, zones


def _last(stack: list[tuple[str, bool, bool]], name: str) -> int:
    return next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)


def main_text(lines: list[str], zones: list[int], shared: set[int]) -> str:
    """The text of a page, its lines joined by a space."""
    least = INSIDE if ARTICLE in zones or INSIDE in zones else OPEN
    return " ".join(s for k, (s, z) in enumerate(zip(lines, zones, strict=True)) if z == ARTICLE or (z >= least and k not in shared))


def _host_and_path(url: str) -> tuple:
    return F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?([^/?#]*)", 1)), F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?[^/?#]*(.*)$", 1)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``place``: its rows' numbers, from 0, in ``order`` over all partitions.

    Rows are dealt by ranges and numbered within their partitions; the
    partitions' sizes, as many numbers as there are partitions, are added up.
    """
    local = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ordered = written(local, "ordered")
    local = ordered.withColumn("_part", F.shiftright("_id", 33))
    sizes = local.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_before"))
    placed = local.join(F.broadcast(sizes), "_part").withColumn("place", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_before")
    placed.written_to = ordered.written_to
    return placed


def page_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of the text) of every row of ``pages`` (page_id, url, html).

    Character references are decoded, white space within a line becomes one
    space, and lines are joined by one space; nothing is capped. A null or empty
    page has an empty text. Pages without a url form one host of their own. A
    host with one page has no neighbour: the markup alone decides. Pages of
    a host with the same lines count as one, so repeated rows and copies do not
    delete each other. Rows with null ids are kept. Other
    columns are ignored.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", "html")
    # the key of a row: all of what orders it, and a digest of the page, so that equal keys mean equal rows
    key = F.xxhash64("page_id", "url", "html")

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [np.array([hash64(s) for s in page_lines(t)[0]], np.uint64).view(np.int64) for t in b["html"]]
            yield pd.DataFrame({"row": b["row"], "url": b["url"], "lines": made})

    lines = rows.select(key.alias("row"), F.coalesce("url", F.lit("")).alias("url"), "html").mapInPandas(hashes, "row long, url string, lines array<long>")
    host, path = _host_and_path("url")
    lines = lines.select("row", host.alias("host"), path.alias("path"), "lines").withColumn("same", F.xxhash64("host", "lines"))
    lines = written(lines, "lines")
    # pages of a host with the same lines are one: a copy says nothing about the template
    single = lines.groupBy("host", "same").agg(F.min("path").alias("path"), F.min("lines").alias("lines"))
    single = numbered(single, ["host", "path", "same"])
    beside = lambda step, name: single.select((F.col("place") - step).alias("place"), F.struct("host", "path", "lines").alias(name))
    trio = single.join(beside(-1, "last"), "place", "left").join(beside(1, "next"), "place", "left")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for same, host, path, own, last, after in zip(b["same"], b["host"], b["path"], b["lines"], b["last"], b["next"], strict=True):
                near = [x for x in (last, after) if x is not None and x["host"] == host]
                if near:
                    best = max(near, key=lambda x: _shared_start(path, x["path"]))
                    out.append((same, host, sorted(common_places(list(own), list(best["lines"])))))
            if out:
                yield pd.DataFrame(out, columns=["same", "host", "shared"])

    shared = trio.mapInPandas(compare, "same long, host string, shared array<int>")
    shared = lines.select("row", "host", "same").distinct().join(shared, ["host", "same"]).groupBy("row").agg(F.min("shared").alias("shared"))
    shared = written(shared.withColumnRenamed("row", "_row"), "shared").hint("merge")  # not broadcast: it grows with the table
    discard(lines, single)

    def text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [main_text(*page_lines(t), set() if s is None else set(s)) for t, s in zip(b["html"], b["shared"], strict=True)]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": made})

    joined = rows.withColumn("row", key).join(shared, F.col("row") == F.col("_row"), "left").select("page_id", "url", "html", "shared")
    return joined.mapInPandas(text, f"page_id {kind}, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))


def _shared_start(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n
