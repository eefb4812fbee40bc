"""Main text of web pages: streamed parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams a page once. A line is what stands between two block-level tags. Its ratio is
the number of its characters outside of links, by the number of its tags. Ratios are smoothed along the page with a
Gaussian; lines whose smoothed ratio reaches the ratios' standard deviation are content, and carry their region: the
article that they stand in, outside of articles what their main element holds outside of articles, and else all lines
of their parent element. An article or main element is carried only by a content line whose own ratio reaches that
deviation too, so that a teaser isn't carried by its neighbours, and a line that is all link carries nothing. Lines in
elements that say that they are something else (navigation, forms, scripts, adverts, notices, reader comments and so on) take no part. Where only a class, id or
role says so, an element that holds the page's article or most of its text takes part all the same, and a paragraph
inside an article or main element goes by its own ratio.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that hold no main text.
OTHER = frozenset(
    "head script style noscript template nav footer aside form select option button textarea dialog menu svg math "
    "iframe object canvas audio video map datalist".split()
)
#: Words in an element's class, id or role that say the same.
OTHER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login sidebar "
    "menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comment comments "
    "comentarios commentaires kommentare disqus respond share sharing social related recommended recommendations widget "
    "complementary contentinfo search skip hidden".split()
)
BLOCK = frozenset(
    "html head body title p div section article main header footer nav aside ul ol li dl dt dd table thead tbody tfoot "
    "tr td th caption h1 h2 h3 h4 h5 h6 blockquote pre form fieldset legend figure figcaption address hr br center "
    "details summary dialog menu select option textarea button noscript template hgroup".split()
)
#: Elements whose end HTML takes as read where such a start tag comes, and those that it doesn't reach out of.
_CELLS, _GROUPS = frozenset({"td", "th"}), frozenset({"thead", "tbody", "tfoot"})
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})), "td": (_CELLS, frozenset({"table", "tr"})), "th": (_CELLS, frozenset({"table", "tr"})),
    "tr": (_CELLS | {"tr"}, frozenset({"table"})), **{g: (_CELLS | _GROUPS | {"tr"}, frozenset({"table"})) for g in _GROUPS},
}
#: Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
_P_SCOPE = frozenset("button caption table td th template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Width of the Gaussian, in lines.
SIGMA = 1.0
_NAME = re.compile(r"[a-z]+")
#: What follows in a name is about something that is not here, or not this element.
_ABOUT = re.compile(r"(?:^|(?<=[^a-z]))(?:has|no|with|without)[-_].*")
#: Readers may write more than the page says, so the amount of their text says nothing.
COMMENT_NAMES = frozenset("comment comments comentarios commentaires kommentare disqus respond".split())


class _Named:
    """An element whose name says that it is something else: what it holds, and what it stands in."""

    def __init__(self, up: _Named | None, about: int, in_article: bool, comments: bool, itself: bool):
        self.up, self.about, self.in_article, self.comments, self.itself = up, about, in_article, comments, int(itself)
        #: Articles and main elements (itself too) in no other such element inside, and characters outside of links;
        #: then those of all inside, those of the elements that it stands in, and whether it takes part.
        self.direct, self.plain, self.all, self.over, self.spared = self.itself, 0, 0, 0, True


def _settle(named: list[_Named]) -> None:
    """Decides which elements (in the page's order, the page first) take part: those that stand in none that doesn't,
    with no article or main beside them, that hold one (and stand in none) or most of the page's text."""
    for x in reversed(named):
        x.all += x.direct
        if x.up:
            x.up.all += x.all
            x.up.plain += x.plain
    for x in named[1:]:
        x.over = x.up.over + x.up.direct
        much = 2 * x.plain > named[0].plain and not x.comments
        x.spared = x.up.spared and x.over == x.about and (much or x.all > x.itself and not x.in_article)


class _Lines(HTMLParser):
    """Collects a page's lines: text, characters outside of links, tags, parent, innermost article and main, innermost
    named element (see _Named), and whether in a paragraph that is named so inside an article or main element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.named = [_Named(None, 0, False, False, False)]
        #: Open elements: tag, number, whether something else, number of the innermost article and main, number of
        #: articles and mains, innermost named element, whether a named paragraph, number of the innermost block that is a region.
        self.open: list[tuple[str, int, bool, int, int, int, _Named, bool, int]] = [("", 0, False, 0, 0, 0, self.named[0], False, 0)]
        #: Places of the open elements of each tag, ascending, so that none is looked for by going through all.
        self.places: dict[str, list[int]] = {}
        self.lines: list[tuple[str, int, int, int, int, int, _Named, bool]] = []
        self.parts: list[str] = []
        self.tags = self.elements = self.links = self.plain = 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._break()
        self.tags += 1
        if tag in ENDS_P:
            self._end(frozenset({"p"}), _P_SCOPE)
        if tag in IMPLIED:
            self._end(*IMPLIED[tag])
        if tag in VOID:
            return
        _, _, other, article, main, about, named, soft, region = self.open[-1]
        self.elements += 1
        given = [w for k, v in attrs if k in ("class", "id", "role") and v for w in v.lower().split()]
        names = {w for v in given for w in _NAME.findall(_ABOUT.sub("", v))}
        gone = any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        other = other or gone or tag in OTHER or tag == "header" and not article
        first = not main and (tag == "main" or "main" in names and tag == "div")
        anchor = not other and (tag == "article" or first)
        if not other and names & OTHER_NAMES and tag not in ("html", "body"):
            if tag == "p" and (article or main):
                soft = True
            else:
                named = _Named(named, about, article > 0, bool(names & COMMENT_NAMES), anchor)
                self.named.append(named)
        elif anchor:
            named.direct += 1
        about += anchor
        if tag == "article":
            article = self.elements
        if first:
            main = self.elements
        self.links += tag == "a"
        if tag in BLOCK and tag not in ("p", "li", "td", "tr"):
            region = self.elements
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, self.elements, other, article, main, about, named, soft, region))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("svg", "math"):
            return  # HTML knows no other self-closing elements
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        places = self.places.get(tag)
        if tag in BLOCK:
            self._break()
        if places:
            self._leave(places[-1])

    def _end(self, ended, bounds):
        """Leaves open elements of these tags, the outermost too, that no bound stands around."""
        of = [self.places[t] for t in ended if self.places.get(t)]
        if not of:
            return
        bound = max((self.places[t][-1] for t in bounds if self.places.get(t)), default=0)
        inside = [x[i] for x in of if (i := bisect_right(x, bound)) < len(x)]
        if inside:
            self._leave(min(inside))

    def _leave(self, at):
        for tag, *_ in reversed(self.open[at:]):
            self.places[tag].pop()
            self.links -= tag == "a"
        del self.open[at:]

    def handle_data(self, data):
        self.parts.append(data)
        if not self.links:
            self.plain += len(data)

    def parse_html_declaration(self, i):
        if self.rawdata.startswith("<![", i):  # no such sections in HTML: a comment up to the next >
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    def _break(self):
        text = " ".join("".join(self.parts).split())
        _, _, other, article, main, _, named, soft, number = self.open[-1]
        if text and not other:
            plain = min(self.plain, len(text))
            self.lines.append((text, plain, max(1, self.tags), number, article, main, named, soft))
            named.plain += plain
        if text:
            self.tags = 0
        self.parts, self.plain = [], 0

    def close(self):
        super().close()
        self._break()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Ratios averaged with their neighbours' by a Gaussian that is cut off at three sigma."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach:-reach]
    return np.convolve(ratios, kernel)[reach:-reach] / weight


def main_text(html: str | None) -> str:
    """The main text of a page: its blocks in order, white space inside each made one space, joined by one space. No
    page or no text: empty."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    _settle(parser.named)
    lines = [x for x in parser.lines if x[6].spared]
    if not lines:
        return ""
    own = np.array([x[1] / x[2] for x in lines])
    ratio = smoothed(own)
    content, clear = ratio >= ratio.std(), own >= ratio.std()
    regions = [(4, x[4]) if x[4] else (5, x[5]) if x[5] else (3, x[3]) for x in lines]
    chosen = {r for r, c, o, x in zip(regions, content, clear, own, strict=True) if c and (o or r[0] == 3 and x > 0)}
    chosen = chosen or {r for r, c in zip(regions, content, strict=True) if c}
    return " ".join(x[0] for x, r, o in zip(lines, regions, clear, strict=True) if r in chosen and (o or not x[7]))


def main_text_column(html: str = "html") -> Column:
    """A string column with the main text of a column of pages; never null."""

    @F.pandas_udf("string")
    def extracted(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    return extracted.asNondeterministic()(F.col(html))
