"""Main text of web pages by two passes of block rules.

A page is read tag by tag into blocks: what stands between two block-level tags. The first pass
decides blocks by themselves. Bad are blocks in menus, footers, sidebars, forms and the like by
their tags, and blocks that are mostly links. Good are long blocks of few links with enough stop
words, and very long ones with a few, or with sentences. All others, mostly short, stay open.

Names of classes only tilt: an element so named as if it were no part of the text is bad with
all in it, unless it holds ``MOST`` of the page's good text; then it is around the text.

The second pass gives open blocks the label of the nearest decided block, first within the same
article; a heading looks ahead before it looks back; an article or main element in which nothing
is decided is good as a whole, and so are, on a page without a good block and without open ones
in an article, all open blocks.

Text of a block has its character references decoded and its white space made single; blocks
are joined by one space in page order. Nothing else is dropped or cut.

Defined results: null or empty html has the empty text; markup that never closes runs to the
end of the page; pages of any length are read whole and in linear time; equal rows get equal
results; an empty table gives an empty table; input columns named text or n_chars are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import map_columns, prepared

#: Length of a long block and of one that needs few stop words, share of stop words, shares of linked characters.
LONG, VERY_LONG, STOP_SHARE, STOP_SHARE_LOW, LINKS_BAD, LINKS_GOOD = 70, 200, 0.2, 0.05, 0.5, 0.25
#: Ends of sentences in a very long block that make it text in any language, and the share of good text that no box beside the text has.
SENTENCES, MOST = 2, 0.8

# Common words of four languages, and HTML element names.
STOP_WORDS = frozenset(
    """
    a an and are as at be but by for from had has have he her his i if in is it its not of on or our she so
    that the their them there they this to was we were what when which who will with would you your
    au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou
    par pas plus pour qu que qui sa se ses son sont sur un une vous
    aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es
    für hat hatte ich ihr im in ist mit nach nicht noch nur oder sich sie sind so über um und uns von vor war
    wie wir wird zu zum zur
    al con como de del el ella en era es esta este ha hay la las lo los más me mi muy no nos o para pero por que
    se si sin sobre son su sus también un una y ya
    """.split()
)
BLOCK_TAGS = frozenset(
    """
    address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main
    menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul
    """.split()
)
BAD_TAGS = frozenset("nav aside footer form menu button select option fieldset dialog iframe object svg math canvas audio video template noscript head header".split())
RAW_TAGS = frozenset("script style textarea title xmp noembed noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Start tags that end an open element of the same kind, and the elements beyond which they do not look.
SIBLINGS = {
    **dict.fromkeys(("li",), (("li",), ("ul", "ol", "menu"))), **dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl",))),
    **dict.fromkeys(("td", "th"), (("td", "th"), ("tr", "table"))), **dict.fromkeys(("tr",), (("tr",), ("table",))),
}
BAD_NAMES = frozenset(
    """
    ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary
    consent contentinfo cookie cookies copyright disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter
    notice overlay pager pagination popup promo promoted promotion recommended related respond search share
    sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget
    """.split()
)

#: Words before a name that say something of the page and not of the element, and words that name no kind.
STATES = frozenset("has no not with without is hide show".split())
PLAIN_NAMES = frozenset("area bar block box container content group inner item items list outer panel section unit wrap wrapper".split())

_TOKEN = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|[!?][^>]*+>)")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT, _CAMEL = re.compile(r"[^a-z]+"), re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW_TAGS}
_HEADING = re.compile("h[1-6]$")
# Ends of sentences, and signs of scripts without blanks between words.
_SENTENCE_END = re.compile(r"[.!?\u0964\u06d4](?:\s|$)|[\u3002\uff01\uff1f\uff0e]")
_WIDE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7a3\U00020000-\U0003fffd]")


class Block:
    __slots__ = ("text", "linked", "bad", "main", "heading", "box")

    def __init__(self, text: str, linked: int, bad: bool, main: int, heading: bool, box: int = 0):
        self.text, self.linked, self.bad, self.main, self.heading, self.box = text, linked, bad, main, heading, box


def suspect(attributes: str) -> bool:
    """Whether a class, id or role names something beside the text: by its first or last word that names a kind."""
    for m in _NAMES.finditer(attributes):
        for name in (m.group(1) or m.group(2) or m.group(3) or "").split():
            words = [w for w in _SPLIT.split(_CAMEL.sub(" ", name).lower()) if w]
            if not words or words[0] in STATES:
                continue
            whole = "".join(words)
            while len(words) > 1 and words[-1] in PLAIN_NAMES:
                words.pop()
            if whole in BAD_NAMES or words[0] in BAD_NAMES or words[-1] in BAD_NAMES:
                return True
    return False


def hidden(attributes: str) -> bool:
    return ("hidden" in attributes or "display" in attributes) and bool(_HIDDEN.search(attributes))


class Page:
    """The open elements while a page is read. Each is left once and found by its tag, so all work is linear."""

    def __init__(self):
        self.out: list[Block] = []
        self.text: list[str] = []
        self.stack: list[tuple[str, bool, int, int, bool]] = []  # tag, bad, number of the article, box, block-level
        self.places: dict[str, list[int]] = {}  # of open elements by tag
        self.levels: list[int] = []  # of open block-level elements
        self.above: list[int] = [0]  # the box around each box
        self.linked = self.articles = 0
        self.link: int | None = None  # how many elements were open when the link began
        self.heading = False

    def put(self, piece: str) -> None:
        if piece:
            self.text.append(piece)
            if self.link is not None:
                self.linked += len(piece.strip())

    def close(self) -> None:
        if self.text:
            one = " ".join(unescape("".join(self.text)).split())
            if one:
                _, bad, main, box, _ = self.stack[-1] if self.stack else ("", False, 0, 0, False)
                self.out.append(Block(one, self.linked, bad, main, self.heading, box))
        self.text, self.linked = [], 0

    def last(self, *tags: str) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def leave(self, place: int) -> None:
        """End the element at a place and all within."""
        around = self.stack[place - 1] if place else ("", False, 0, 0, False)
        if self.stack[-1][1:4] != around[1:4]:
            self.close()
        while len(self.stack) > place:
            tag, _, _, _, level = self.stack.pop()
            self.places[tag].pop()
            if level:
                self.levels.pop()
        if self.link is not None and self.link > len(self.stack):
            self.link = None

    def end(self, tag: str) -> None:
        place = self.last(tag)
        if place >= 0 and (tag in BLOCK_TAGS or not self.levels or place > self.levels[-1]):  # no inline end tag ends a block
            self.leave(place)

    def start(self, tag: str, attributes: str) -> None:
        level = tag in BLOCK_TAGS
        if level and self.levels and self.stack[self.levels[-1]][0] == "p":
            self.leave(self.levels[-1])
        if tag in SIBLINGS:
            same, within = SIBLINGS[tag]
            if (place := self.last(*same)) > self.last(*within):
                self.leave(place)
        if tag in VOID_TAGS:
            return
        _, bad, main, box, _ = around = self.stack[-1] if self.stack else ("", False, 0, 0, False)
        if tag in MAIN_TAGS and not main:
            self.articles += 1
            main = self.articles
        bad = bad or tag in BAD_TAGS and not (tag == "header" and main)
        if attributes and tag not in ("body", "html"):
            bad = bad or hidden(attributes)
            if not bad and suspect(attributes) and not (tag in MAIN_TAGS and not around[2] and not box):
                self.above.append(box)
                box = len(self.above) - 1
        if (bad, main, box) != around[1:4]:
            self.close()
        self.places.setdefault(tag, []).append(len(self.stack))
        if level:
            self.levels.append(len(self.stack))
        self.stack.append((tag, bad, main, box, level))


def read(html: str) -> Page:
    """The page with its blocks in order, those without visible text left out."""
    page = Page()
    at, end = 0, len(html)
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            page.put(html[at:])
            break
        page.put(html[at:lt])
        m = _TOKEN.match(html, lt)
        if not m:
            rest = html[lt + 1 : lt + 2]
            if rest.isalpha() or rest == "/":  # a tag that is cut off by the end of the page, or has an open quote
                gt = html.find(">", lt)
                at = end if gt < 0 else gt + 1
            else:
                page.put("<")
                at = lt + 1
            continue
        at = m.end()
        if m.group(2) is None:
            if html.startswith("<!--", lt):
                to = html.find("-->", lt + 4)
                at = end if to < 0 else to + 3
            continue
        tag, closing = m.group(2).lower(), bool(m.group(1))
        if tag in RAW_TAGS:
            if not closing:
                found = _ENDS[tag].search(html, at)
                at = found.end() if found else end
            continue
        if tag in BLOCK_TAGS:
            page.close()
            if _HEADING.match(tag):
                page.heading = not closing
            elif tag != "br":
                page.heading = False
        if closing:
            page.end(tag)
            if tag == "a":
                page.link = None
        else:
            page.start(tag, m.group(3))
            if tag == "a":
                page.link = len(page.stack)
    page.close()
    return page


def blocks(html: str) -> list[Block]:
    return read(html).out


def label(b: Block) -> bool | None:
    """First pass: True for good, False for bad, None for open."""
    n = len(b.text)
    links = min(1.0, b.linked / n)
    if b.bad or links > LINKS_BAD or (n < LONG and b.text[0] == "©" and not b.main):
        return False
    n += len(_WIDE.findall(b.text))  # a sign of these says as much as several letters
    if n < LONG or links > LINKS_GOOD or b.heading:
        return None
    words = b.text.lower().split()
    share = sum(w.strip(".,;:!?()\"'*$%&#") in STOP_WORDS for w in words) / len(words)
    if share >= STOP_SHARE or (n >= VERY_LONG and (share >= STOP_SHARE_LOW or b.main or len(_SENTENCE_END.findall(b.text)) >= SENTENCES)):
        return True
    return None


def beside(page: Page, first: list[bool | None]) -> list[bool]:
    """Which boxes are beside the text, with all within: those that do not hold most of the good text."""
    held = [0] * len(page.above)
    scope = any(b.main and x is not False for b, x in zip(page.out, first, strict=True))  # an article, if there is one, is where the text is
    for b, x in zip(page.out, first, strict=True):
        if x and (b.main or not scope):
            held[b.box] += len(b.text)
    for i in range(len(held) - 1, 0, -1):  # a box comes after the one around it
        held[page.above[i]] += held[i]
    out = [False] * len(held)
    for i in range(1, len(held)):
        out[i] = out[page.above[i]] or held[i] < MOST * held[0] or not held[0]
    if all(x is False or out[b.box] for b, x in zip(page.out, first, strict=True)):
        return [False] * len(held)  # nothing would be left
    return out


def decided(page: Page) -> list[bool]:
    """Both passes."""
    first = [label(b) for b in page.out]
    if len(page.above) > 1:
        aside = beside(page, first)
        first = [False if aside[b.box] else x for b, x in zip(page.out, first, strict=True)]
    page = page.out
    if True not in first and not any(b.main and x is None for b, x in zip(page, first, strict=True)):
        return [x is None for x in first]  # menus and footers say nothing of a text in which nothing is decided
    n = len(page)
    out = list(first)
    before: list[tuple[int, bool] | None] = []  # nearest decided block on either side, with its place
    after: list[tuple[int, bool] | None] = [None] * n
    for near, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last: dict[int, tuple[int, bool]] = {}
        any_: tuple[int, bool] | None = None
        for i in order:
            got = last.get(page[i].main) if page[i].main else any_
            if near is before:
                before.append(got)
            else:
                after[i] = got
            if first[i] is not None:
                any_ = (i, bool(first[i]))
                if first[i] or not page[i].main:  # a box or a list of links inside an article says nothing of the article
                    last[page[i].main] = any_
    for i in range(n):
        if first[i] is None:
            b, a = before[i], after[i]
            if b is None and a is None:
                out[i] = bool(page[i].main)
            elif page[i].heading and a is not None:
                out[i] = a[1]
            elif b is None or a is None:
                out[i] = (b or a)[1]
            elif b[1] == a[1]:
                out[i] = b[1]
            else:
                d, e = i - b[0], a[0] - i
                out[i] = (b[1] if d < e else a[1]) if d != e else bool(page[i].main)
    return [bool(x) for x in out]


def main_text(html: str | None) -> str:
    page = read(html or "")
    return " ".join(b.text for b, good in zip(page.out, decided(page), strict=True) if good)


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """Append ``text`` and ``n_chars`` (code points) to each page."""

    def make() -> Callable:
        def work(values: list) -> list:
            texts = [main_text(v) for v in values]
            return [texts, [len(t) for t in texts]]

        return work

    return map_columns(pages, [html], [("text", T.StringType()), ("n_chars", T.LongType())], make)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = prepared(spark).read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extracted(pages).select("page_id", "url", "text", F.col("n_chars"))
