"""Main text of web pages by line-block distribution.

1. Markup is stripped into lines: a block tag or <br> ends a line; character
   references are decoded; white space becomes one space. Text of elements that
   never hold an article (scripts, styles, forms, navigation, page headers and
   footers, sidebars, and elements whose class, id or role says menu, advert,
   notice, comments and so on) leaves a line of length 0, a gap.
2. Text lengths are summed over sliding windows of ``WINDOW`` lines, a line counting
   up to ``LINE`` characters, so that no single one sets the scale. A surge is a line
   where the window sum rises to a share of the page's largest; a dive is where it
   falls to the floor. Lines with most of their text in links count 0.
3. The text between a surge and its dive is kept, blocks joined by one space.

An article mark (``article``, ``main``, role=main) is a prior. If the marked lines hold
at least ``TRUSTED`` of the text that the windows keep of the whole page, the windows
go over the marked lines alone, where the floor is an empty window, as gaps alone
end the text. A mark around less, a teaser say, is passed over.

A tag that the page ends in has no text. A quote counts as one after ``=`` only.
A null or empty page has an empty text. Unclosed tags, missing ends and stray
closing tags are accepted; a repeated page_id is extracted once per row. Extra
columns are ignored. The whole page is read, whatever its length.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.llm import text as tx

WINDOW = 3
#: A surge is this share of the largest window sum, a dive's floor is this share.
SURGE, FLOOR = 0.2, 0.1
LINKED = 0.5
#: Characters of a line that its window counts at most; all of a kept line is kept.
LINE = 300
#: Share of the kept text from which on an article mark is believed.
TRUSTED = 0.5

# possessive, and open to the page's end: no part of a page is scanned again for each of its tags
_ATTRIBUTES = r"(?:[^>=]+|=\s*+\"[^\"]*\"|=\s*+'[^']*'|=)*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|textarea|title|svg|math|iframe|object|select)\b"
    rf"{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({_ATTRIBUTES})(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I)
_NAMED = re.compile(r"(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)")
_HIDDEN = re.compile(r"(?:^|[\s/])hidden(?=[\s=/]|\Z)", re.I)
_UNSEEN = re.compile(r"(?<![\w-])(?:style\s*=\s*(?:\"[^\"]*|'[^']*|[^\s>]*)display\s*:\s*none|aria-hidden\s*=\s*[\"']?true)", re.I)
_WORDS = re.compile(r"[a-z]+")

# Element names of HTML, by what they do to the text.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre search section summary table tbody "
    "td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form button menu dialog head search".split())
#: Names beside which the word header marks an article's own heading.
OWN_WORDS = frozenset("article content entry post story title".split())
# Words of class, id and role names that mark what is no article.
OFF_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary "
    "consent contentinfo cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter "
    "notice notices pager pagination popup promo promoted promotion related replies reply respond share sharing sidebar signup "
    "skip social sponsor sponsored subscribe toolbar widget".split())
#: Whole class names of an article element that is a reader's comment.
COMMENTS = frozenset("comment reply response".split())
#: Names that mark readers' talk where they stand outside the article.
TALK = frozenset("discussion discussions responses".split())


def _off(name: str, attributes: str, in_article: bool) -> bool:
    if name in DROPPED or (name == "header" and not in_article):
        return True
    if name in ("html", "body", "main"):
        return False
    if _HIDDEN.search(_VALUE.sub("=", attributes)) or _UNSEEN.search(attributes):
        return True
    for m in _NAMED.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if name == "article":
            if m[1].lower() == "class" and COMMENTS & set(value.split()):
                return True
            continue
        found = set(_WORDS.findall(value))
        if in_article or found & OWN_WORDS:
            found.discard("header")
        if m[1].lower() != "aria-label" and (OFF_WORDS & found or (not in_article and TALK & found)):
            return True
    return False


class _Lines:
    """Lines of a page: text, length outside links, and whether inside a marked article."""

    def __init__(self, page: str):
        self.rows: list[tuple[str, int, bool]] = []
        self.parts: list[str] = []
        self.loose = 0
        self.link = 0
        self.marked = False
        self.off: str | None = None
        self.depth = 0
        self.main: list[str] = []
        at = 0
        for m in _TOKEN.finditer(page):
            if m.start() > at:
                self.add(page[at : m.start()])
            at = m.end()
            if m[3]:
                self.tag(m[3].lower(), bool(m[2]), m[4] or "")
            elif m[1] and self.off is None and m[1].lower() in ("title", "textarea", "select"):
                self.end()
        if at < len(page):
            self.add(page[at:])
        self.end()

    def add(self, raw: str) -> None:
        if self.off is None:
            self.parts.append(raw)
            if not self.link:
                self.loose += len(raw.strip())

    def end(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            self.rows.append((text, self.loose, bool(self.main)))
        self.parts, self.loose = [], 0

    def gap(self) -> None:
        self.end()
        self.rows.append(("", 0, bool(self.main)))

    def tag(self, name: str, closing: bool, attributes: str) -> None:
        if self.off is not None:
            if name == self.off:
                self.depth += -1 if closing else 1
                if self.depth == 0:
                    self.off = None
            elif closing and name in ("article", "main", "body", "html") and name in (*self.main, "body", "html"):
                self.off, self.depth = None, 0
                self.tag(name, closing, attributes)
            elif not closing and name in ("article", "main") and self.off not in ("form",) and not self.marked and not _off(name, attributes, False):
                self.off, self.depth = None, 0  # an unclosed element before the article
                self.tag(name, closing, attributes)
            return
        if not closing and name not in VOID and _off(name, attributes, bool(self.main)):
            self.gap()
            self.off, self.depth = name, 1
            return
        if name in BLOCKS:
            self.end()
        if name == "a":
            self.link = 0 if closing else 1
        if not closing and (name in ("article", "main") or re.search(r"\brole\s*=\s*[\"']?main\b", attributes, re.I)):
            self.main.append(name)
            self.marked = True
        elif closing and name in self.main:
            while self.main.pop() != name:
                pass


def _between(lengths: list[int], surge: float, floor: float) -> list[int]:
    """The lines with length between the surges and dives of the window sums, thresholds as shares of the largest."""
    counted = [min(n, LINE) for n in lengths]
    sums = [sum(counted[i : i + WINDOW]) for i in range(len(counted))]
    top = max(sums, default=0)
    kept, i = [], 0
    while top and i < len(sums):
        if not sums[i] or sums[i] < surge * top:
            i += 1
            continue
        while i < len(sums) and sums[i] > floor * top:
            if lengths[i]:
                kept.append(i)
            i += 1
    return kept


def main_text(page: str | None) -> str:
    """The text between the surges and dives of one page."""
    rows = _Lines(page or "").rows
    kept = _between([len(text) if loose >= LINKED * len(text) else 0 for text, loose, _ in rows], SURGE, FLOOR)
    marked = [len(text) if inside else 0 for text, _, inside in rows]
    if any(marked) and sum(marked) >= TRUSTED * sum(len(rows[i][0]) for i in kept):
        kept = _between(marked, 0.0, 0.0)
    return " ".join(rows[i][0] for i in kept)


def _extract(batches):
    for batch in batches:
        pages = batch.column("html").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array([main_text(p) for p in pages], pa.string())],
            ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"))
    out = rows.mapInArrow(_extract, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(tx.table(spark, sf_dir, "pages"))
