"""Main text of HTML pages: standard-library parser events, text-to-tag ratio per line, smoothing and clustering.

The parser's events cut a page into lines, one for each block element, and count the tags that each line took. The
ratio of a line's characters to its tags is smoothed by a Gaussian along the page; lines whose smoothed ratio lies
above the page's standard deviation form clusters. Elements that never hold the article (menus, headers, footers,
sidebars, forms, scripts, and containers whose class, id or role says notice, advert, comments and the like) are left
out before; a form only if it holds neither an article nor most of the page's text. If the page marks articles, an article that holds a cluster is kept whole, short lines too; else the
lines from each cluster's first to its last are kept, and lines between clusters that belong to the same container.

Character references are decoded, white space inside a line becomes one space, empty lines go, lines are joined by a
newline. Null and empty pages give an empty text, text without any tag is a page of plain lines. Repeated rows repeat
the result; extra columns are ignored. A page's work is linear in its length, and no page meets another.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_rows, column

#: Fixed values of HTML: elements that begin a new line, that have no end tag, and that hold no article text.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT = frozenset("script style noscript template nav footer aside header head title menu iframe object svg canvas math select textarea button dialog audio video search datalist noembed noframes map applet".split())
#: Words of a container's class, id or role that say it holds no article text.
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot banner banners sponsor sponsored sponsors promo promos promotion promoted "
    "nav navbar navigation menu menus breadcrumb breadcrumbs toolbar topbar header masthead footer foot sidebar sidebars side aside complementary contentinfo "
    "notice notices cookie cookies consent gdpr popup modal overlay alert newsletter subscribe subscription signup login signin register search form "
    "comment comments commentlist discussion disqus respond replies reply reactions share sharing social related recommended recommendations widget widgets "
    "pagination pager copyright disclaimer paywall hidden".split()
)
#: Those of them that are believed of a heading, a paragraph or a piece of a line too, and those not believed within an article,
#: where a research article has a discussion and documentation has alerts.
NARROW_WORDS = OUT_WORDS & frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion notice notices cookie cookies consent newsletter "
    "breadcrumb breadcrumbs comment comments disqus respond share sharing copyright disclaimer".split()
)
OF_ARTICLE = frozenset("header masthead discussion alert foot side form search register reply reactions complementary overlay".split())
#: Believed within an article only where no word stands beside them but these.
BOXES = frozenset("related recommended social replies respond".split())
_BOX_PARTS = BOXES | frozenset("box block container wrapper list links posts articles stories news items section content area you may also like more read".split())
#: Elements that are judged by the words; the article, and what else it consists of, are not.
CONTAINERS = frozenset("div section ul ol dl table figure details center fieldset aside".split())
NARROW = frozenset("p span li blockquote h2 h3 h4 h5 h6 a td tr small".split())
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_PART = re.compile(r"[^A-Za-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _left_out(tag: str, attrs, within_article: bool) -> bool:
    if tag in OUT:
        return not (tag == "header" and within_article)
    if not attrs:
        return False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and _HIDDEN.search(value):
            return True
        if name in ("class", "id", "role") and value and (tag in CONTAINERS or tag in NARROW):
            known = OUT_WORDS if tag in CONTAINERS else NARROW_WORDS
            words = {w.lower() for w in _PART.split(_CAMEL.sub("-", value))}
            if within_article:
                known = known - OF_ARTICLE - (frozenset() if words - {""} <= _BOX_PARTS else BOXES)
            if words & known:
                return True
    return False


class Lines(HTMLParser):
    """Lines of a page in order: text, tags taken, number of the article it lies in (0: none), number of its container, whether it is mostly links, number of its form (0: none)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []
        self.out = 0
        self.form = self.forms = 0
        self.holding: set[int] = set()  # forms that an article begins in
        self.article = self.articles = 0
        self.container, self.containers = 0, 0
        self.buffer: list[str] = []
        self.tags = self.links = self.linked = 0
        self.found: list[tuple[str, int, int, int, bool, int]] = []

    def flush(self) -> None:
        if self.buffer:
            text = _SPACE.sub(" ", "".join(self.buffer)).strip()
            self.buffer = []
            if text:
                self.found.append((text, self.tags, self.article, self.container, 2 * self.linked > len(text), self.form))
                self.tags = self.linked = 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        begins = tag == "article" or tag == "main" or ("role", "main") in attrs
        if begins and self.out and not any(t in ("script", "style", "template", "noscript", "dialog") for t, o, _ in self.open if o):
            if all(t in ("nav", "header", "div", "section", "ul", "li") for t, o, _ in self.open if o) and self.open[-1][0] not in ("div", "section"):
                self.out = 0  # the menu before it was never ended
                self.open = [(t, False, a) for t, o, a in self.open]
        if tag in EMPTY:
            return
        if tag == "p" and self.open and self.open[-1][0] == "p":
            self._end(len(self.open) - 1)  # a paragraph ends where the next one begins
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option") and self.open and self.open[-1][0] == tag:
            self._end(len(self.open) - 1)
        self.links += tag == "a"
        if tag == "form" and not self.form:
            self.forms += 1
            self.form = self.forms
        leaves = _left_out(tag, attrs, bool(self.article))
        self.open.append((tag, leaves, self.article))
        self.out += leaves
        if begins and not self.out and not self.article:
            self.articles += 1
            self.article = self.articles
            self.holding.add(self.form)
        if tag in ("div", "section", "article", "main", "body", "td"):
            self.containers += 1
            self.container = self.containers

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1

    def _end(self, at: int) -> None:
        for tag, leaves, article in reversed(self.open[at:]):
            self.links -= tag == "a"
            self.form *= tag != "form"
            self.out -= leaves
            self.article = article
        del self.open[at:]

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._end(at)
                if tag in ("div", "section", "article", "main", "td"):
                    self.containers += 1
                    self.container = self.containers
                return
            if self.open[at][0] in ("article", "main", "body", "td", "table") and tag not in ("article", "main", "body", "html", "div", "section", "table", "tr"):
                return  # an end tag without its start

    def handle_data(self, data):
        if not self.out:
            self.buffer.append(data)
            if self.links:
                self.linked += len(data.strip())


def lines(html: str) -> list[tuple[str, int, int, int]]:
    """Text, tags, article and container of the lines that are in no form; a form that holds an article or most of the text is none."""
    parser = Lines()
    try:
        parser.feed(html)
        parser.close()
    except (AssertionError, ValueError):  # a marked section that the parser refuses: what is left is taken without its tags
        parser.handle_data(unescape(re.sub(r"<[^>]*>?", " ", parser.rawdata)))
    parser.flush()
    size: dict[int, int] = {}
    for text, _, _, _, linked, form in parser.found:
        size[form] = size.get(form, 0) + len(text) * (not linked)
    holds = parser.holding | {form for form, n in size.items() if 2 * n > sum(size.values())}
    out, more = [], 0
    for text, tags, article, container, linked, form in parser.found:
        if form and form not in holds:
            more += tags
        else:  # a line that is mostly links has as many tags as characters
            out.append((text, len(text) if linked else max(1, tags + more), article, container))
            more = 0
    return out


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """Values under a Gaussian of that deviation, its weights made whole at the ends."""
    radius = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel)[radius:-radius]
    return np.convolve(values, kernel)[radius:-radius] / weight


def main_text(html: str | None, sigma: float = 1.0) -> str:
    found = lines(html or "")
    if not found:
        return ""
    ratio = np.array([len(text) / tags for text, tags, _, _ in found])
    level = smooth(ratio, sigma)
    dense = level >= min(float(level.std()), float(level.max()))
    marked = {f[2] for f, d in zip(found, dense) if d and f[2]}
    linked = np.array([tags == len(text) for text, tags, _, _ in found])
    if marked:
        keep = [f[2] in marked for f in found]
    else:
        if not linked.all():
            dense &= ~linked
        at = np.flatnonzero(dense if dense.any() else ~linked | linked.all())
        keep = np.isin(np.arange(len(found)), at).tolist()
        for i, j in zip(at, at[1:]):
            if found[i][3] == found[j][3]:
                keep[i:j] = [True] * (j - i)
        first, last = at[0], at[-1]
        for step, edge in ((-1, first), (1, last)):  # short lines of the same container before the first cluster and after the last
            k = edge + step
            while 0 <= k < len(found) and found[k][3] == found[edge][3] and not linked[k]:
                keep[k] = True
                k += step
    return "\n".join(f[0] for f, k in zip(found, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    arrow_rows(pages.sparkSession, 1000)

    def of(batches):
        for batch in batches:
            texts = [main_text(h) for h in column(batch, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return pages.select("page_id", "url", "html").mapInArrow(of, "page_id long, url string, text string, n_chars long")
