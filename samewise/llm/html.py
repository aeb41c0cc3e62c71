"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Pass one decides blocks: bad inside menus, headers, footers,
sidebars, forms and elements whose class, id or role names such a part, an advert, a notice or reader comments;
bad if most of it is link text, unless it stands between two good blocks; good if long with many stop words; bad if long with
few of them, unless it stands between two good ones or in an <article> or <main>; on a page with no good block and under KNOWN_SHARE of stop words, which
is in none of their languages, long blocks are good without them; all else is undecided. Pass two gives an
undecided block the label of the nearest decided neighbour: in an article or main element among those of the
same element that were decided by their words or links (without any it is good), elsewhere among all (without
any it is bad); at equal distance good wins. On a page with no good block all undecided ones are good. Scripts, styles, head and comments of the markup are no blocks.

A name hints at a part if it consists of hint words, numbers and words like "box" or "left" only (sidebar-2,
adBox), has a word for reader comments (wp-comments-list) or begins or ends with one for sidebars or adverts (ad-top-1); not related-work,
has-sidebar, ad-free or data-id. An article whose name hints at comments is a comment. Inside a line an element with a hint is left out of its block,
which else stays whole. An element with a hint, or a form, is no such part if it holds the page's main element, nearly
all of its long text, or its articles with half of that text. Paragraphs, list items, table cells and rows end where the next begins.

Edge cases: null or empty html gives an empty text; markup may be cut off anywhere: an unfinished tag is
dropped, an unfinished script, style or comment ends with the page; repeated rows are extracted each; very long
pages take time in proportion to their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape
from itertools import groupby
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LONG_CHARS, STOP_SHARE, LINK_SHARE, WRAPPED, KNOWN_SHARE = 70, 0.15, 0.5, 0.1, 0.05

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a about after all an and are as at be been but by can for from had has have he her his if in into is it its more
    not of on one or our out she that the their there they this to up was we were what when which who will with you
    aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer es für hat im ist mit
    nach nicht noch nur oder sich sie sind so über um und uns vom von vor war werden wie wir zu zum zur
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas
    plus pour qu que qui sa se ses son sont sur un une vous
    al como con del el ella ellos era es esta este esto han hay la las lo los me muy más ni no nos para pero por porque
    que se sin sobre su sus también tiene un una uno y ya""".split()
)
# Words in class and id attributes that name parts outside the article.
HINTS = frozenset(
    """ad ads advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent gdpr notice
    alert popup modal overlay newsletter subscribe signup login sidebar rail aside menu nav navbar navigation breadcrumb
    breadcrumbs pagination pager toolbar masthead footer comment comments commentlist respond reply replies disqus social
    share sharing related recommended widget form search skip advertising adslot cookieconsent""".split()
)
# Parts that a name of such a part may have besides.
_BESIDES = frozenset(
    """area article articles bar block body bottom box button buttons col column container content entry extra fixed global
    group header heading icons inner item items law left link links list main outer page panel post posts primary right row
    secondary section site slot small sticky stories text thread title tools top unit user wrap wrapper zone""".split()
)
# Hints at reader comments.
_COMMENTS = frozenset("comment comments commentlist respond reply replies disqus reviews".split())
# Words that make any name a part if they come last, or first; words of states and of what is not there,
# whose names are no parts; and first and last words of parts that neither word names alone.
_ENDS = frozenset("comment comments commentlist disqus sidebar rail ad ads advert adverts advertisement advertising".split())
_STARTS = frozenset("comment comments disqus sidebar ad ads advert adverts advertisement advertising cookieconsent".split())
_STATES = frozenset("has have no not with without is are show hide open opened closed enabled disabled active free off on less".split())
_PAIRS = frozenset(
    (first, last) for firsts, lasts in (
        ("global site", "header headers"), ("user users customer customers reader readers visitor guest", "reviews review"),
        ("related recommended", "news content reads reading topics videos"), ("cookie cookies gdpr consent", "message warning policy info prompt"),
    ) for first in firsts.split() for last in lasts.split()
)
# Elements of HTML by their part here.
_BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot
    th thead tr ul""".split()
)
_BAD = frozenset("nav footer aside menu dialog".split())
_SKIP = frozenset("script style noscript template svg math textarea select button iframe object head title".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_MAIN = frozenset("article main".split())
# Elements whose end tag may be left out, by the group of which one begins where another ends, and the
# elements that the search for an open one does not look beyond.
_ITEMS = {"p": "p", "li": "li", "dt": "dl", "dd": "dl", "tr": "tr", "td": "td", "th": "td"}
_SCOPES = {"ul": ("li",), "ol": ("li",), "menu": ("li",), "dl": ("dl",), "table": ("tr", "td"), "tr": ("td",)}

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z)|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile(r"[^\W\d_]+")


def _hint(attributes: str) -> frozenset[str]:
    """The hints of the first name in class, id or role that consists of hints, numbers and what may stand besides, or
    that has a word for comments or begins or ends with one for sidebars or adverts."""
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role"):
            for name in (m[2] or m[3] or m[4] or "").split():
                words = [x.lower() for x in _PART.findall(name)]
                parts = set(words)
                if (hints := parts & HINTS) and parts - hints <= _BESIDES:
                    return frozenset(hints)
                if len(words) < 2 or parts & _STATES:
                    continue
                if said := parts & {"comment", "comments", "commentlist", "disqus"}:
                    return frozenset(said)
                if words[-1] in _ENDS or (words[0], words[-1]) in _PAIRS:
                    return frozenset({words[-1]})
                if words[0] in _STARTS:
                    return frozenset({words[0]})
    return frozenset()


class _Open(NamedTuple):
    """An open element: whether it stands in a bad one, the main element and the mark around, and by group of _ITEMS the
    place in the stack of the open element that a new one of the group would end."""

    tag: str = ""
    bad: bool = False
    main: int = 0
    mark: int = 0
    items: dict[str, int] = {}  # never changed in place


class _Blocks:
    """Collects runs of text between block tags. Whether an element with a hint is bad is known at the end of the
    page only, so every piece of text keeps the number (mark) of the innermost one around it, 0 if none.

    Every tag costs constant time but for the elements it ends."""

    def __init__(self) -> None:
        self.runs: list[tuple[list[tuple[str, int, bool, int]], int]] = []
        self.stack: list[_Open] = [_Open()]
        self.count: Counter[str] = Counter()  # open elements by tag
        self.parts: list[tuple[str, int, bool, int]] = []
        self.in_link, self.mains = 0, 0
        self.around = [0]  # by mark the one around it
        self.comments = [False]  # by mark whether it hints at reader comments
        self.holds_main: set[int] = set()

    def text(self, s: str) -> None:
        if s:
            s = unescape(s)
            top = self.stack[-1]
            self.parts.append((s, len("".join(s.split())) if self.in_link else 0, top.bad, top.mark))

    def end_block(self) -> None:
        if self.parts:
            self.runs.append((self.parts, self.stack[-1].main))
            self.parts = []

    def _cut(self, at: int) -> None:
        self.count.subtract(x.tag for x in self.stack[at:])
        del self.stack[at:]

    def open(self, tag: str, attributes: str) -> None:
        if tag in _BLOCKS:
            self.end_block()
            if self.stack[-1].items:
                for group in ("p", _ITEMS.get(tag, "p"), *(("td",) if tag == "tr" else ())):
                    if (at := self.stack[-1].items.get(group)) is not None:
                        self._cut(at)
        elif tag == "br":
            self.text(" ")
        top = self.stack[-1]
        main, mark = top.main, top.mark
        if tag == "a":
            self.in_link += 1
        hint = _hint(attributes) if attributes and tag not in ("html", "body", "main") else frozenset()
        if tag == "article" and hint.isdisjoint(_COMMENTS):  # an article is none of the other parts, but may be a comment
            hint = frozenset()
        hinted = tag == "form" or bool(hint)
        if tag in _MAIN:
            self.mains += 1
            main = self.mains
        if tag == "main":
            self.holds_main.add(mark)
        plain = tag not in _BLOCKS or tag in _ITEMS or tag in ("hr", "html", "body")
        if (hinted or not plain) and tag not in _VOID and not attributes.rstrip().endswith("/"):
            if hinted:
                self.around.append(mark)
                self.comments.append(not hint.isdisjoint(_COMMENTS))
                mark = len(self.around) - 1
            items = top.items
            if tag in _SCOPES:
                items = {k: v for k, v in items.items() if k not in _SCOPES[tag]}
            if tag in _ITEMS:
                items = {**items, _ITEMS[tag]: len(self.stack)}
            self.stack.append(_Open(tag, top.bad or tag in _BAD or tag == "header" and not main, main, mark, items))
            self.count[tag] += 1

    def close(self, tag: str) -> None:
        if tag in _BLOCKS:
            self.end_block()
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        if self.count[tag] > 0:
            at = len(self.stack) - 1
            while self.stack[at].tag != tag:
                at -= 1
            self._cut(at)

    def bad_marks(self) -> list[bool]:
        """By mark whether it or one around it is bad. Not bad are elements around a main element, and those that hold
        all but at most WRAPPED of the long text with many stop words (half of it if an article in them holds some, and
        they hint at no reader comments), unless an article or main element outside them holds some."""
        n = len(self.around)
        out = [False] * n
        if n == 1:
            return out
        held, held_main, found = [0] * n, [0] * n, []
        for parts, main in self.runs:
            for mark, group in groupby((x for x in parts if not x[2]), key=lambda x: x[3]):
                pieces = list(group)
                found.append((" ".join("".join(x[0] for x in pieces).split()), sum(x[1] for x in pieces), mark, main))
        known = any(_first_pass(text, link, False, 0) is True for text, link, _, _ in found) or _known(x[0] for x in found)
        for text, link, mark, main in found:
            if _first_pass(text, link, False, 0, known) is True:
                held[mark] += len(text)
                held_main[mark] += len(text) if main else 0
        for mark in range(n - 1, 0, -1):  # from the inside out
            held[self.around[mark]] += held[mark]
            held_main[self.around[mark]] += held_main[mark]
            if mark in self.holds_main:
                self.holds_main.add(self.around[mark])
        for mark in range(1, n):
            share = 0.5 if held_main[0] and not self.comments[mark] else 1 - WRAPPED
            wrapper = mark in self.holds_main or held[mark] > 0 and held[mark] >= share * held[0] and held_main[mark] == held_main[0]
            out[mark] = not wrapper or out[self.around[mark]]
        return out

    def blocks(self) -> list[tuple[str, int, bool, int]]:
        """[text, link characters, bad, main]; main numbers the article or main element around, 0 if none."""
        out, bad_marks = [], self.bad_marks()
        for parts, main in self.runs:
            for bad in (False, True):  # what is bad inside a line is left out of its block, and a block only if nothing else is there
                pieces = [x for x in parts if (x[2] or bad_marks[x[3]]) == bad]
                text = " ".join("".join(x[0] for x in pieces).split())
                if text:
                    out.append((text, sum(x[1] for x in pieces), bad, main))
                    break
        return out


def blocks(html: str | None) -> list[tuple[str, int, bool, int]]:
    """The blocks of a page in order: text, characters in links, whether in a part outside the article, main element."""
    html = html or ""
    page, at, n = _Blocks(), 0, len(html)
    endless: set[str] = set()
    while at < n:
        m = _TAG.search(html, at)
        if m is None or m.start() == n:
            page.text(html[at:])
            break
        page.text(html[at : m.start()])
        at = m.end()
        tag, attributes = (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
        if not tag:
            continue
        if m[1] or m[4]:
            page.close(tag)
        elif tag in _SKIP and not attributes.rstrip().endswith("/"):
            end = None if tag in endless else re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            if end is None:
                endless.add(tag)
            at = end.end() if end else (n if tag != "head" else at)
            page.text(" ")
        else:
            page.open(tag, attributes)
    page.end_block()
    return page.blocks()


def _first_pass(text: str, link: int, bad: bool, main: int, known: bool = True) -> bool | str | None:
    """Good or bad, "links" or "poor" (what stands around decides if it is bad), or None: undecided."""
    chars = len(text.replace(" ", ""))
    if bad:
        return False
    if link > LINK_SHARE * chars:
        return "links"
    if len(text) < LONG_CHARS:
        return None
    if not known:
        return True
    found = _WORD.findall(text.lower())
    if found and sum(w in STOP_WORDS for w in found) >= STOP_SHARE * len(found):
        return True
    return None if main else "poor"


def _settled(first: list[bool | str | None]) -> list[bool | None]:
    """first with "links" and "poor" decided: good if the nearest decided blocks before and after are good, else bad."""
    sides: list[list[bool | None]] = []
    for order in (range(len(first)), range(len(first) - 1, -1, -1)):
        near: list[bool | None] = [None] * len(first)
        seen = None
        for i in order:
            near[i] = seen
            if isinstance(first[i], bool):
                seen = first[i]
        sides.append(near)
    return [bool(before and after) if isinstance(label, str) else label for label, before, after in zip(first, *sides, strict=True)]


def _known(texts: Iterable[str]) -> bool:
    """Whether the words of texts are of a language of STOP_WORDS: at least KNOWN_SHARE of them are stop words."""
    found = stops = 0
    for text in texts:
        for w in _WORD.findall(text.lower()):
            found += 1
            stops += w in STOP_WORDS
    return stops >= KNOWN_SHARE * found


def main_text(html: str | None) -> str:
    """The good blocks of a page, joined by an empty line."""
    cut = blocks(html)
    first = [_first_pass(*b) for b in cut]
    if True not in first and not _known(b[0] for b in cut if not b[2]):
        first = [_first_pass(*b, known=False) for b in cut]
    none_good = True not in first
    first = _settled(first)

    def nearest(keep) -> list[tuple[int, bool] | None]:
        """Distance and badness of the nearest decided block with the same keep, good first at equal distance."""
        best: list[tuple[int, bool] | None] = [None] * len(cut)
        for order in (range(len(cut)), range(len(cut) - 1, -1, -1)):
            last: dict[int, tuple[int, bool]] = {}
            for i in order:
                key = keep(cut[i])
                if first[i] is not None:
                    last[key] = (i, first[i])
                elif key in last:
                    d = (abs(i - last[key][0]), not last[key][1])
                    best[i] = min(best[i], d) if best[i] else d
        return best

    inside, anywhere = nearest(lambda b: -1 if b[2] else b[3]), nearest(lambda b: 0)
    out = []
    for i, block in enumerate(cut):
        label = first[i]
        if label is None:
            found = inside[i] or (None if block[3] else anywhere[i])
            # where nothing else is good, what stands in no part outside the article is all that there is
            label = not found[1] if found and not none_good else bool(block[3]) or none_good
        if label:
            out.append(block[0])
    return "\n\n".join(out)


@F.pandas_udf(StringType())
def _extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pages.map(main_text, na_action=None)


def extract(html: Column) -> Column:
    """The main text (string, empty if none) of an html column."""
    return _extract(F.coalesce(html, F.lit("")))
