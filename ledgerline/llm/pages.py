"""Main text of web pages by the distribution of text over line blocks (operator 12).

Stripping the markup leaves one line for each block element; what stands in menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments leaves a blank one. The text lengths of WINDOW lines in a row, links
not counted, make a distribution along the page: it surges where running text begins and dives to nothing where it ends.
The lines between are kept. Where a page marks its article, the lines outside it are blank too, and the surge and the
dive lie at the article's own ends.
"""

from __future__ import annotations

import html
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import read_table

#: Lines whose lengths are summed up.
WINDOW = 3
#: A window surges from so many characters on, and from this part of the page's fullest window.
SURGE_CHARS = 80
SURGE_PART = 1 / 6
#: Before the first heading or line of so many characters, a surge has not begun.
FIRST_CHARS = 20
#: Of several articles on a page, those with this part of the longest one's text are main text.
ARTICLE_PART = 0.5

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead "
    "tr ul".split()
)
SPACES = frozenset(("br", "td", "th", "wbr"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that end an open paragraph.
CLOSES_P = BLOCKS - {"body", "caption", "head", "html", "tbody", "tfoot", "thead", "tr"}
#: Their content is no markup, and no text of the page.
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
BOILERPLATE = frozenset(
    "aside audio button canvas dialog footer form head menu nav noscript object select svg template video".split()
)
#: Words in class, id or role that name boilerplate.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising aside banner breadcrumb breadcrumbs comment comments complementary "
    "consent contentinfo cookie cookies discussion disqus footer gdpr header login masthead menu menubar modal nav navbar "
    "navigation newsletter notice notices notification overlay pagination popup promo promotion recommended related "
    "replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
NEVER = frozenset(("html", "body", "main", "article"))

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>""", re.S
)
NAMING = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|[\s"'])(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
WORD = re.compile(r"[a-z]+")
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}

#: What a line belongs to.
PLAIN, HARD, HEADER = 0, 1, 2


def _names_boilerplate(attributes: str) -> bool:
    if "=" not in attributes and "hidden" not in attributes:
        return False
    if HIDDEN.search(attributes):
        return True
    return any(
        not NAMES.isdisjoint(WORD.findall(html.unescape(a or b or c).lower())) for a, b, c in NAMING.findall(attributes)
    )


class Lines:
    """The lines of one page: text, characters outside links and blanks, whether a heading, and the number of its article and of
    its main element (0: none). A line of boilerplate has no text; other blocks without text are no lines."""

    def __init__(self, page: str, by_name: bool):
        self.text: list[str] = []
        self.length: list[int] = []
        self.heading: list[bool] = []
        self.article: list[int] = []
        self.main: list[int] = []
        self._parts: list[str] = []
        self._linked = 0
        self._swallowed = False
        self._stack: list[tuple[str, int]] = []
        self._count = {PLAIN: 0, HARD: 0, HEADER: 0}
        self._open = dict.fromkeys(("a", "article", "main", *HEADINGS), 0)
        self._numbers = {"article": 0, "main": 0}
        self._read(page, by_name)
        self._flush()

    def _flush(self) -> None:
        text = " ".join("".join(self._parts).split())
        if not text and not self._swallowed:
            return
        self.text.append(text)
        self.length.append(len(text.replace(" ", "")) - self._linked)
        self.heading.append(any(self._open[h] for h in HEADINGS))
        self.article.append(self._numbers["article"] if self._open["article"] else 0)
        self.main.append(self._numbers["main"] if self._open["main"] else 0)
        self._parts, self._linked, self._swallowed = [], 0, False

    def _push(self, name: str, kind: int) -> None:
        if name in ("article", "main") and not self._open[name]:
            self._numbers[name] += 1
        self._stack.append((name, kind))
        self._count[kind] += 1
        if name in self._open:
            self._open[name] += 1

    def _pop_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            name, kind = self._stack.pop()
            self._count[kind] -= 1
            if name in self._open:
                self._open[name] -= 1

    def _close(self, name: str, within: frozenset[str] = frozenset()) -> None:
        """End the innermost open element of that name, if it is open, and if no element of within stands between."""
        for depth in range(len(self._stack) - 1, -1, -1):
            if self._stack[depth][0] == name:
                return self._pop_to(depth)
            if self._stack[depth][0] in within:
                return None
        return None

    def _kind(self, name: str, attributes: str, by_name: bool) -> int:
        if name == "header":
            return HEADER if self._open["article"] else HARD
        if name in BOILERPLATE or (by_name and name not in NEVER and _names_boilerplate(attributes)):
            return HARD
        return PLAIN

    def _say(self, text: str) -> None:
        heads = self._count[HEADER] and not any(self._open[h] for h in HEADINGS)
        if text and not self._count[HARD] and not heads:
            text = html.unescape(text)
            self._parts.append(text)
            if self._open["a"]:
                self._linked += len("".join(text.split()))
        elif text and not text.isspace():
            self._swallowed = True

    def _read(self, page: str, by_name: bool) -> None:
        at, end = 0, len(page)
        while at < end:
            token = TOKEN.search(page, at)
            if token is None:
                return self._say(page[at:])
            self._say(page[at : token.start()])
            at = token.end()
            if token[2] is None:
                continue
            name = token[2].lower()
            if name in BLOCKS:
                self._flush()
            elif name in SPACES:
                self._say(" ")
            if token[1]:
                self._close(name, CLOSES_P - {"p"} if name == "p" else frozenset())
            elif name in RAW:
                closing = RAW_ENDS[name].search(page, at)
                at = closing.start() if closing else end
            else:
                if name in CLOSES_P:
                    self._close("p", CLOSES_P - {"p"})
                if name in ("li", "dd", "dt", "option", "tr", "td", "th"):
                    self._close(name, frozenset(("ul", "ol", "dl", "table", "menu", "select")))
                if name not in VOID and not token[3].endswith("/"):
                    self._push(name, self._kind(name, token[3], by_name))
        return None


def _articles(lines: Lines) -> list[int]:
    """Lengths of the lines that can be main text: those of the page's articles, else of its main element, else all."""
    for places in (lines.article, lines.main):
        total: dict[int, int] = {}
        for place, text in zip(places, lines.text):
            if place and text:
                total[place] = total.get(place, 0) + len(text)
        if total:
            least = ARTICLE_PART * max(total.values())
            return [len(t) if total.get(p, 0) >= least else 0 for p, t in zip(places, lines.text)]
    return []


def _between(weights: list[int], surge: float) -> list[tuple[int, int]]:
    """Runs of lines (start, end) from a surge of the window's sum to the dive to zero after it."""
    sums = [0, *accumulate(weights)]
    n = len(weights)
    window = [sums[min(n, i + WINDOW)] - sums[i] for i in range(n)]
    runs, at = [], 0
    while at < n:
        if not weights[at] or window[at] < surge:
            at += 1
            continue
        end = at
        while end < n and window[end]:
            end += 1
        runs.append((at, end))
        at = end + 1
    return runs


def main_text(page: str | None) -> str:
    """The page's main text: its blocks in order, one a line; empty if there is none."""
    if not page:
        return ""
    for by_name in (True, False):
        lines = Lines(page, by_name)
        marked = _articles(lines)
        if marked:
            kept = _between(marked, 1)
            return "\n".join(lines.text[i] for start, end in kept for i in range(start, end) if marked[i])
        sums = [0, *accumulate(lines.length)]
        fullest = max((sums[min(len(sums) - 1, i + WINDOW)] - sums[i] for i in range(len(lines.length))), default=0)
        if not fullest:
            continue
        surge = max(min(SURGE_CHARS, fullest), SURGE_PART * fullest)
        kept = []
        for start, end in _between(lines.length, surge):
            while start < end and not lines.heading[start] and lines.length[start] < min(FIRST_CHARS, fullest):
                start += 1
            kept += [t for t in lines.text[start:end] if t]
        if kept:
            return "\n".join(kept)
    return ""


@F.arrow_udf(StringType())
def _main_texts(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p.as_py()) for p in pages], pa.string())


def extract(pages: DataFrame, html_col: str | Column = "html", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """pages with text_col, the main text of html_col, and chars_col, its number of code points.

    A null or empty page has the empty text, as has one without text outside boilerplate; rows that repeat are read
    alike; an empty table gives an empty table. Other columns stay; one that has the name of a new column is replaced.
    Every page is read whole, in time linear in its length.
    """
    column = F.col(html_col) if isinstance(html_col, str) else html_col
    return pages.withColumn(text_col, _main_texts(column)).withColumn(chars_col, F.char_length(text_col).cast("long"))


def op12_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; see extract for nulls, repeats and pages without text."""
    return extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


#: The pages of the tables mark their article, hold no boilerplate in it and only these character references.
ORACLE_SQL = r"""
WITH marked AS (
    SELECT page_id, url, regexp_replace(coalesce(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), ''),
        '(?is)<!--.*?-->', '', 'g') AS body
    FROM pages
), blocks AS (
    SELECT page_id, url, list_transform(string_split_regex(body, '(?i)</?(?:p|div|h[1-6]|ul|ol|li|section|blockquote)(?:\s[^>]*)?>'),
        lambda b: regexp_replace(regexp_replace(b, '(?i)<br[^>]*>', ' ', 'g'), '(?i)</?[a-z][^>]*>', '', 'g')) AS parts
    FROM marked
), decoded AS (
    SELECT page_id, url, list_transform(parts, lambda b: trim(regexp_replace(
        regexp_replace(replace(replace(replace(replace(regexp_replace(b, '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'),
            '&amp;?', '&', 'g'), '[\s\x{A0}]+', ' ', 'g'))) AS parts
    FROM blocks
), joined AS (
    SELECT page_id, url, coalesce(array_to_string(list_filter(parts, lambda b: b <> ''), chr(10)), '') AS text FROM decoded
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM joined
"""
