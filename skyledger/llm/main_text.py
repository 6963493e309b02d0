"""The main text of web pages by text-to-tag ratios.

The standard library's parser reads a page in portions and its events fill lines: a line ends wherever a block starts
or ends, and at a line break. A line keeps its text, how many of its characters stand in links, how many tags came with it, and the
open containers. Lines in what can be no article by its element (navigation, forms, scripts and so on), its role or the words of
its class or id are set aside. The ratio of a line is its characters outside links by its tags; ratios are
smoothed along the page with a Gaussian, and two clusters of their logarithms give the threshold.

The lines over the threshold choose the content region: the ``article`` (or else ``main``) that holds most text, or
else the smallest container with nearly all of it. Every line of the region stays, short ones too, but for lists
of links under the threshold, and, where no element marks the article, lines under it before the first and after the last.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import map_arrow, portions

#: Standard deviation of the smoothing, in lines.
SIGMA = 1.0
#: Clusters whose centres are closer than this factor are one: all lines are content.
APART = 3.0
#: The share of the content that a container without a mark must hold, and the share of links in a list of links.
MOSTLY, LINKED = 0.8, 0.8
#: Characters that the parser takes at once.
PORTION = 65_536

# HTML elements by what they are.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINERS = frozenset("article aside blockquote body center dd details dialog div dl fieldset figure footer form header html li main menu nav ol section table tbody td tfoot th thead tr ul".split())
_BLOCKS = _CONTAINERS | frozenset("address br caption dt figcaption h1 h2 h3 h4 h5 h6 hr legend option p pre summary title".split())
_NEVER = frozenset("aside dialog footer form header menu nav".split())
_MUTE = frozenset("applet audio button canvas frameset head iframe map noframes noscript object optgroup option progress script select style svg template textarea title video".split())
_HEAD = frozenset("base link meta noscript script style template title head html".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_LISTS = frozenset("div dl ol section table ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Words of a class or id that say that a container is not the article.
_WORDS = frozenset(
    """ad ads adbox adslot adsense adsbygoogle advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion banner outbrain taboola
    cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login paywall
    sidebar sidebars rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs topbar toolbar toc
    header masthead footer copyright legal disclaimer
    comment comments commentlist disqus discussion replies reply respond responses
    related recommended recommendations teaser teasers share sharing social pagination pager""".split()
)
_OF_ARTICLE = frozenset("ad ads advert advertisement sponsored promo promoted comment reply related teaser".split())
_NEGATED = frozenset("no not has have with without".split())
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_COMMENT_END = re.compile(r"--\s*>")


def _hinted(value: str, words: frozenset) -> bool:
    """Whether a class or id has one of the words, and no negation before it."""
    for name in value.split():
        before = ""
        for word in map(str.lower, _PARTS.findall(name)):
            if word in words and before not in _NEGATED:
                return True
            before = word
        if name.lower().replace("-", "").replace("_", "") in words:
            return True
    return False


class Lines(HTMLParser):
    """Fills ``lines`` from parser events: (text, link characters, tags, containers, set aside by, heading)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, tuple, int, bool]] = []
        self.stack: list[tuple[str, int]] = []  # element, its number if it is a container
        self.count: Counter = Counter()
        self.path: tuple = (0, None)  # numbers of open containers, inner first, as a linked list
        self.parent, self.kind, self.aside = {0: -1}, {0: "page"}, {}
        self.cancelled: set[int] = set()
        self.off: list[int] = []  # containers that set aside, outermost first
        self.text: list[str] = []
        self.linked = self.tags = self.mute = 0

    def _end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            inner = self.path[0]
            heading = any(tag in _HEADINGS for tag, _ in self.stack[-6:])
            self.lines.append((text, self.linked, self.tags, inner, tuple(self.off), heading))
            self.tags = 0
        self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.count["title"] and not self.count["svg"]:
            self._close("title")
        if self.count["head"] and tag not in _HEAD:
            self._close("head")
        if tag in _BLOCKS:
            self._end_line()
            if self.count["p"] and tag not in ("br",):
                self._close("p", stop=_CONTAINERS)
            if tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
                self._close(tag, stop=_CONTAINERS - {tag})
        self.tags += 1
        if tag in _VOID:
            return
        number = 0
        values = {k: v or "" for k, v in attrs} if attrs else {}
        if tag in _CONTAINERS or tag == "p":
            number = len(self.parent)
            self.parent[number], self.kind[number] = self.path[0], tag
            self.path = (number, self.path)
            if tag in ("article", "main") and not self._of_reader(values):
                self.cancelled.update(self.off)
            if self._set_aside(tag, values):
                self.off.append(number)
        self.stack.append((tag, number))
        self.count[tag] += 1
        self.mute += tag in _MUTE

    def _of_reader(self, values: dict) -> bool:
        return _hinted(values.get("class", ""), _OF_ARTICLE) or _hinted(values.get("id", ""), _OF_ARTICLE)

    def _set_aside(self, tag: str, values: dict) -> bool:
        if tag in ("html", "body"):
            return False
        if tag in ("article", "main"):
            return self._of_reader(values)
        if tag in _NEVER:
            return True
        if not values:
            return False
        style = values.get("style", "").replace(" ", "").lower()
        if "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in style or values.get("role", "").lower() in _ROLES:
            return True
        return _hinted(values.get("class", ""), _WORDS) or _hinted(values.get("id", ""), _WORDS)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCKS:
            self._end_line()
        self.tags += 1
        if tag == "p" or tag in _CONTAINERS or tag in _MUTE:
            self._close(tag)
        elif self.count[tag]:
            self._close(tag, stop=_CONTAINERS)

    def _close(self, tag: str, stop: frozenset = frozenset()) -> None:
        """Closes the innermost ``tag`` and all in it, unless an element of ``stop`` lies between."""
        if not self.count[tag]:
            return
        at = len(self.stack) - 1
        while self.stack[at][0] != tag:
            if self.stack[at][0] in stop:
                return
            at -= 1
        self._end_line() if tag in _BLOCKS else None
        for name, number in reversed(self.stack[at:]):
            self.count[name] -= 1
            self.mute -= name in _MUTE
            if number:
                self.path = self.path[1]
                if self.off and self.off[-1] == number:
                    self.off.pop()
        del self.stack[at:]

    def handle_data(self, data: str) -> None:
        if self.mute:
            return
        self.text.append(data)
        if self.count["a"]:
            self.linked += len(data) - data.count(" ")

    def finish(self) -> list[tuple]:
        self.close()
        self._end_line()
        return self.lines


def parsed(page: str) -> Lines:
    """The lines of a page. What no later tag or comment can end is cut off first, as browsers read it."""
    page = page.replace("<![", "<!x[")  # sections are comments in HTML
    last = 0
    for m in _COMMENT_END.finditer(page):
        last = m.end()
    open_ = page.find("<!--", last)
    if open_ >= 0:
        page = page[:open_]
    tail = page.find("<", page.rfind(">") + 1)
    if tail >= 0 and re.match(r"</?[A-Za-z!?]", page[tail : tail + 3]):
        page = page[:tail]
    lines = Lines()
    for at in range(0, len(page), PORTION):
        lines.feed(page[at : at + PORTION])
    lines.finish()
    return lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Each ratio as the mean of its neighbours under a Gaussian; at the ends the weights that there are count."""
    reach = int(3 * sigma)
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(np.ones(len(ratios)), weight)[reach : reach + len(ratios)]
    return np.convolve(ratios, weight)[reach : reach + len(ratios)] / total


def threshold(values: np.ndarray) -> float:
    """Half way between the centres of two clusters of the logarithms; 0 where these are not apart."""
    x = np.log1p(values)
    low, high = x.min(), x.max()
    for _ in range(50):
        near = np.abs(x - low) <= np.abs(x - high)
        if near.all():
            break
        next_ = x[near].mean(), x[~near].mean()
        if next_ == (low, high):
            break
        low, high = next_
    return float(np.expm1((low + high) / 2)) if high - low > np.log(APART) else 0.0


def main_text(page: str | None) -> str:
    """The article of a page; empty if there is none. See the head of the module."""
    if not page:
        return ""
    found = parsed(page)
    lines, parent, kind = found.lines, found.parent, found.kind
    held = Counter()
    for text, _, _, _, off, _ in lines:
        for number in off:
            held[number] += len(text)
    every = sum(len(line[0]) for line in lines)
    cancelled = found.cancelled | {n for n, size in held.items() if kind[n] == "form" and 2 * size > every}  # a form around the whole page
    aside = np.array([_aside(line, kind, cancelled, parent) for line in lines], bool)
    if aside.all():
        return ""
    size = np.array([len(line[0]) for line in lines], np.float64)
    linked = np.minimum(size, [line[1] for line in lines])
    ratio = (size - linked) / np.maximum(1, [line[2] for line in lines])
    smooth = smoothed(np.where(aside, 0.0, ratio))
    limit = threshold(smooth[~aside])
    over = ~aside & (smooth >= limit)
    mass, text, links = Counter(), Counter(), Counter()
    for i in np.flatnonzero(~aside).tolist():
        inner = lines[i][3]
        mass[inner] += size[i] * over[i]
        text[inner] += size[i]
        links[inner] += linked[i]
    for number in range(len(parent) - 1, 0, -1):  # a container's number is greater than its parent's
        for of in (mass, text, links):
            if number in of:
                of[parent[number]] += of[number]
    marked = [n for n, name in kind.items() if name == "article" and text[n]] or [n for n, name in kind.items() if name == "main" and text[n]]
    if marked:
        region = max(marked, key=lambda n: (text[n], -n))
    else:
        region = 0
        for number in range(1, len(parent)):
            if mass[number] >= MOSTLY * mass[0] and kind[number] in _CONTAINERS:
                region = max(region, number)  # of two such containers one lies in the other
    inside, dull = {region}, set()
    rich = {lines[i][3] for i in np.flatnonzero(~aside & (ratio >= limit))}  # containers with a line over the threshold by itself
    for number in range(len(parent) - 1, 0, -1):
        if number in rich:
            rich.add(parent[number])
    for number in range(region + 1, len(parent)):
        if parent[number] in inside:
            inside.add(number)
            if parent[number] in dull or (kind[number] in _LISTS and number not in rich and 0 < LINKED * text[number] <= links[number]):
                dull.add(number)
    stays = [i for i in np.flatnonzero(~aside).tolist() if lines[i][3] in inside and lines[i][3] not in dull]
    if not marked and (good := [i for i in stays if over[i]]):
        first, last = good[0], good[-1]
        while (before := [i for i in stays if i < first][-1:]) and lines[before[0]][5]:
            first = before[0]  # headings that lead to the content
        stays = [i for i in stays if first <= i <= last]
    return " ".join(lines[i][0] for i in stays)


def _aside(line: tuple, kind: dict, cancelled: set, parent: dict) -> bool:
    """Whether a line stands in something that is no article; headings in the header of an article are part of it."""
    for number in line[4]:
        if number in cancelled:
            continue
        if kind[number] == "header" and line[5]:
            up = parent[number]
            while up > 0 and kind[up] not in ("article", "main"):
                up = parent[up]
            if up > 0:
                continue
        return True
    return False


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row of ``pages``: the main text and its code points.

    Null and empty pages, and pages without an article, have an empty text; a page may be of any length and is
    parsed as a whole by one task. Repeated rows are each answered, null ids and urls stay null, an empty table
    gives no rows, other columns may have any names.
    """
    picked = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for part in portions(b, 500, 4_000_000):
                texts = [main_text(x) for x in part.column("text").to_pylist()]
                yield {"id": part.column("id"), "url": part.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_arrow(picked, {"id": "long", "url": "string", "text": "string", "n_chars": "long"}, rows)
