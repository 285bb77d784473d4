"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing and threshold clustering.

The standard library's parser streams events. Block-level tags cut the page into lines (a line is a block's text).
Each line has the ratio of its characters to the tags since the line before. The ratios are smoothed with a
Gaussian, and lines at or over the threshold (the standard deviation of the smoothed ratios, at most their peak) form clusters:
runs of neighbouring such lines. A cluster's mass is its characters, which count ``WEIGHT`` times within an article or main
element; clusters with ``SHARE`` of the greatest mass are selected. Short paragraphs of an article have low ratios, so clusters
select regions: a line's region is its article (or main) element, or else the nearest sectioning block around it. Of selected
articles the siblings belong to the content too. Of other selected regions the content is the innermost element around all of them
(a lone region's parent, from that region on; a lone region directly in the body ends the content itself), and what lies between
the page's first-level heading and it, if that comes before.
All lines of the content are kept but those of boilerplate: elements,
roles and class or id words of menus, headers, footers, sidebars, notices, adverts, forms and comments, whatever is hidden,
script or style, and, outside articles, lines of links alone (but for a single one between lines of the content). Class and id words don't count on inline elements and headings. Inside
an article they count if they are the whole of a class (or of an id, but for a section's) or if most of the element's text is links.

Pages are independent: one pass without a shuffle.
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

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that hold no article text.
DROPPED = frozenset(
    "head title nav footer aside form script style noscript template button select textarea option label iframe svg canvas object audio video dialog menu".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: Words of a class or id that mark boilerplate, and beginnings of such words.
WORDS = frozenset(
    "ad ads adsense adslot adbox advert promo promos promotion banner consent gdpr notice notices alert alerts popup modal overlay signup side widget widgets "
    "menu menus nav navigation topnav footer foot copyright respond reply replies disqus discussion share sharing social related recommended "
    "recommendations trending popular pagination pager search login toolbar skip masthead topbar header".split()
)
STARTS = ("advert", "comment", "cookie", "sidebar", "newsletter", "breadcrumb", "navbar", "subscri", "sponsor", "footer")
#: Words that may stand beside those where a whole class or id marks boilerplate.
NEUTRAL = frozenset(
    "area article articles bar block blog body box btn button buttons container content count entry footer form group icons inner item items link links list main "
    "outer page panel post posts primary secondary section site story text thread title top bottom wp wrap wrapper".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag ends without an end tag.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WHOLE = frozenset({"article", "main"})
SECTIONS = frozenset("article main section div td body html center".split())
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
OPENING = re.compile(r"<[A-Za-z/!?]")
SPACE = re.compile(r"\s+")


#: What a cluster's characters within an article or main element count, and the share of the greatest mass that selects a cluster.
WEIGHT, SHARE = 8, 0.15

#: What an element's tag and attributes say of it; of a doubtful one its links decide.
TEXT, DOUBTFUL, BOILERPLATE = range(3)


def _marked(word: str, inside: bool) -> bool:
    return (word in WORDS or word.startswith(STARTS)) and not (inside and word == "header")


def sign(tag: str, attrs: dict[str, str | None], inside: bool) -> int:
    """inside: within an article or main element."""
    if tag in DROPPED or tag == "header" and not inside:
        return BOILERPLATE
    if tag in ("html", "body", "article", "main"):
        return TEXT
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or (attrs.get("role") or "").lower() in ROLES:
        return BOILERPLATE
    if "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
        return BOILERPLATE
    if tag in INLINE or tag in HEADINGS:
        return TEXT
    found = TEXT
    classes = (attrs.get("class") or "").split()
    for name in [*classes, attrs.get("id") or ""]:
        words = [w.lower() for w in TOKEN.findall(name)]
        if any(_marked(w, inside) for w in words):
            if not inside:
                return BOILERPLATE
            if all(_marked(w, inside) or w in NEUTRAL for w in words) and (tag != "section" or name in classes):
                return BOILERPLATE
            found = DOUBTFUL
    return found


class Lines(HTMLParser):
    """Collects the lines of a page: their text, tags and region, or region 0 for boilerplate."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: tag, dropped, region, inside, number of the element, number of the doubtful element around
        self.open: list[tuple[str, bool, int, bool, int, int]] = [("", False, 1, False, 0, 0)]
        self.parents, self.names, self.last = [0], [""], [0]  # by element: its parent, tag, last element in it (0 while it is open)
        self.of_region = {1: 0}  # the element of a region
        self.blocks: list[int] = []  # places in the stack of the elements that aren't inline
        self.count: Counter[str] = Counter()  # of the open elements by tag
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.regions: list[int] = []
        self.elements: list[int] = []  # the element that a line ends in
        self.doubtful: list[int] = []
        self.linked: list[bool] = []  # whether a line is links alone
        self.titles: list[int] = []  # lines of first-level headings
        self.whole: set[int] = set()  # regions of article and main elements
        self.parts: list[str] = []
        self.outside = False  # whether the line has text outside links
        self.seen, self.made = 0, 1

    def cut(self) -> None:
        """End the line."""
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            self.parts = []
            if text:
                _, dropped, region, _, element, doubtful = self.open[-1]
                self.elements.append(element)
                self.doubtful.append(doubtful)
                self.texts.append(text)
                self.tags.append(self.seen)
                self.linked.append(not self.outside)
                if self.count["h1"]:
                    self.titles.append(len(self.texts) - 1)
                self.regions.append(0 if dropped else region)
                self.seen = 0
            self.outside = False

    def push(self, tag: str, dropped: bool, region: int, inside: bool, doubtful: int) -> None:
        number = len(self.parents)
        if tag not in INLINE:
            self.blocks.append(len(self.open))
        self.parents.append(self.open[-1][4])
        self.names.append(tag)
        self.last.append(0)
        self.open.append((tag, dropped, region, inside, number, number if doubtful < 0 else doubtful))
        self.count[tag] += 1

    def pop(self, depth: int) -> None:
        """Close the elements from ``depth`` on."""
        while len(self.open) > depth:
            gone = self.open.pop()
            self.count[gone[0]] -= 1
            self.last[gone[4]] = len(self.parents) - 1
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()

    def handle_starttag(self, tag, attrs):
        self.seen += 1
        if tag == "br":
            self.parts.append(" ")
        named = dict(attrs)
        _, dropped, region, inside, _, doubtful = self.open[-1]
        if tag in INLINE:
            if tag not in VOID:
                self.push(tag, dropped or sign(tag, named, inside) == BOILERPLATE, region, inside, doubtful)
            return
        self.cut()
        if tag in VOID:
            return
        if self.blocks and ((last := self.open[self.blocks[-1]][0]) == "p" or last in ENDS.get(tag, ())):
            self.pop(self.blocks[-1])
        _, dropped, region, inside, _, doubtful = self.open[-1]
        what = sign(tag, named, inside)
        if what == DOUBTFUL and not doubtful:
            doubtful = -1  # this one
        if tag in SECTIONS and not inside:
            self.made += 1
            region = self.made
            self.of_region[region] = len(self.parents)
            if tag in WHOLE:
                self.whole.add(region)
        self.push(tag, dropped or what == BOILERPLATE, region, inside or tag in WHOLE, doubtful)

    def handle_endtag(self, tag):
        self.seen += 1
        if tag not in INLINE:
            self.cut()
        if self.count[tag]:
            depth = len(self.open) - 1
            while self.open[depth][0] != tag:
                depth -= 1
            self.pop(depth)

    def holds(self, element: int, other: int) -> bool:
        """Whether ``element`` is ``other`` or around it. Elements are numbered in the page's order."""
        return element <= other and (not self.last[element] or other <= self.last[element])

    def around(self, first: int, last: int) -> int:
        """The innermost element around these regions; around a lone region, its parent, or itself if that is the body."""
        a, b = self.of_region[first], self.of_region[last]
        up = self.parents[a]
        if first == last and self.names[up] in ("", "html", "body"):
            return a
        while not self.holds(up, b):
            up = self.parents[up]
        return up

    def handle_data(self, data):
        if self.open[-1][1] and self.open[-1][0] in INLINE and not self.open[-2][1]:
            return  # a hidden word inside a line
        self.parts.append(data)
        if not self.outside and not data.isspace():
            self.outside = not self.count["a"]


def smoothed(ratios: np.ndarray, radius: int = 2, sigma: float = 1.0) -> np.ndarray:
    """The ratios after a Gaussian of the given radius; beyond the ends there is nothing."""
    x = np.arange(-radius, radius + 1)
    kernel = np.exp(-(x**2) / (2 * sigma**2))
    return np.convolve(ratios, kernel / kernel.sum(), mode="full")[radius : radius + len(ratios)]


def clusters(smooth: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The number of each line's cluster from 1 on, 0 for lines under the threshold. A cluster's lines are of one kind."""
    over = (smooth > 0) & (smooth >= min(smooth.std(), smooth.max()))
    begins = over.copy()
    begins[1:] &= ~over[:-1] | (kind[1:] != kind[:-1])
    return np.where(over, np.cumsum(begins), 0)


def selected(smooth: np.ndarray, sizes: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Whether each line is of a cluster that is selected by its mass."""
    cluster = clusters(smooth, whole)
    mass = np.bincount(cluster, sizes * np.where(whole, WEIGHT, 1.0))
    mass[0] = 0.0
    return (cluster > 0) & (mass[cluster] >= SHARE * mass.max())


def main_text(html: str | None) -> str:
    """The article of a page; empty if there is none."""
    html = html or ""
    ended = html.rfind(">") + 1
    broken = OPENING.search(html, ended)  # a tag that the page's end cuts off is no text
    parser = Lines()
    parser.feed(html[: broken.start()] if broken else html)
    parser.close()
    parser.cut()
    if not parser.texts:
        return ""
    regions, linked = np.array(parser.regions), np.array(parser.linked)
    sizes, doubtful = np.array([len(t) for t in parser.texts]), np.array(parser.doubtful)
    if doubtful.any():
        inverse = np.unique(doubtful, return_inverse=True)[1]
        links = np.bincount(inverse, sizes * linked) > np.bincount(inverse, sizes) / 2
        regions[links[inverse] & (doubtful > 0)] = 0
    whole = np.isin(regions, list(parser.whole))
    open_to = (regions > 0) & (whole | ~linked)
    ratios = sizes / np.maximum(1, parser.tags)
    smooth = smoothed(np.where(open_to, ratios, 0.0))
    smooth[~open_to] = 0.0
    if not smooth.max() > 0:
        return ""
    seeds = selected(smooth, sizes, whole)
    kept = np.zeros(len(regions), dtype=bool)
    if (seeds & whole).any():
        parent = {r: parser.parents[parser.of_region[r]] for r in parser.whole}
        seeded = {parent[r] for r in regions[seeds & whole]}
        kept |= whole & np.isin(regions, [r for r in parser.whole if parent[r] in seeded])
    if (seeds & ~whole).any():
        # A single line of links between lines of its region is no menu.
        single = (regions > 0) & linked & ~whole
        single[1:] &= ~linked[:-1] & (regions[1:] == regions[:-1])
        single[:-1] &= ~linked[1:] & (regions[:-1] == regions[1:])
        single[[0, -1]] = False
        chosen = np.flatnonzero(np.isin(regions, regions[seeds & ~whole]) & open_to)
        first = next((i for i in parser.titles if i < chosen[0] and open_to[i]), chosen[0])
        low, high = int(regions[chosen].min()), int(regions[chosen].max())
        around = parser.around(low, high)
        within = np.array([parser.holds(around, e) for e in parser.elements])
        at = np.arange(len(regions))
        kept |= (open_to | single) & (((at >= first) & (at <= chosen[-1])) | (within & ((at >= first) | (low < high))))
    return "\n".join(t for t, k in zip(parser.texts, kept, strict=True) if k)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points of text).

    A null or empty html and a page without an article give an empty text. Repeated rows and null ids or urls
    keep their rows; other columns are not read; an empty table gives an empty result.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), lengths], schema=schema)

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
