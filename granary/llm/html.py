"""Main-text extraction: streaming parser events, text-to-tag ratios, Gaussian smoothing, threshold clusters.

Parser events become lines, one for each block of the page; each line has the number of characters
and of tags since the line before. The ratio of the two is smoothed along the page. Lines above the
threshold, a share of the ratio at which the page's characters stand on average, form clusters, and the
clusters select regions: an element with most of its text in clusters, none of whose parts lies mostly
outside them, is main text as a whole, short lines included; in other elements the lines of clusters are,
with those between them. Names enter as evidence: a line inside navigation, headers, footers,
sidebars, forms, notices, adverts or comments has the ratio 0, and an article with clustered text
is not divided.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import kernels

#: Elements that begin and end a block of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose text is never content.
UNSEEN = frozenset("script style head title noscript template iframe object svg math button select textarea canvas audio video datalist".split())
#: Elements whose text has the ratio 0.
ASIDE = frozenset("nav aside form footer menu dialog search".split())
#: Elements too small to be a part of a page; their lines belong to the element around them.
INLINE = frozenset("p b i span em strong a u font small sub sup code cite q ul ol li dl dt dd table tbody thead tfoot tr th pre blockquote figure figcaption".split())
#: Elements without content, and those whose end a new block of the same kind implies.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SAME = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "p": "p"}
#: Words of a class or id that mark an element as no content, if the name has no other words than these and those of PLAIN.
MARKS = frozenset("ad ads advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices notification popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget footer header masthead topbar comment comments commentlist disqus replies reply respond related recommended share sharing social subscribe newsletter signup login paywall toolbar pagination pager skip hidden".split())
#: Those that hold for an article element too: remarks of readers and teasers.
REMARKS = frozenset("ad ads advert advertisement comment comments reply replies respond related promo sponsored teaser".split())
#: Words that say nothing of what an element holds.
PLAIN = frozenset("area articles bar block box buttons col column container content form group inner item items left right top bottom link links list main media outer page panel post posts primary reader readers row secondary section site slot stories thread unit user users wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end the reach of an implied end tag.
BARRIERS = BLOCKS - frozenset("p li dt dd td th tr option".split())
ROOTS = frozenset(["", "html", "body"])
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar note".split())
#: An article's own heading may stand in a header.
INNER_HEADER = frozenset(["header", "hgroup"])
_SPACE = re.compile(r"\s+")
_SECTION = re.compile(r"<!\[(?!if|else|endif)[^>]*>?", re.I)
_PART = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Lines(HTMLParser):
    """Collects (element, text, tags before it, aside) of every block that is seen; an element's number is over its parent's.

    A page is fed whole, so markup without an end reaches to the end of the page, as a browser has it; each kind is looked for once.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, bool, bool]] = []  # name, number of the element, unseen, aside, in an article or main
        self.at: defaultdict[str, list[int]] = defaultdict(list)  # places in ``open`` by name
        self.barriers: list[int] = []
        self.lines: list[tuple[int, str, int, bool]] = []
        self.names: list[str] = [""]
        self.parents: list[int] = [0]
        self.text: list[str] = []
        self.tags = 0
        self.last: dict[str, tuple[str, int]] = {}

    def cut(self) -> None:
        line = _SPACE.sub(" ", "".join(self.text)).strip()
        self.text = []
        if line:
            self.lines.append((self.open[-1][1] if self.open else 0, line, self.tags, bool(self.open and self.open[-1][3])))
            self.tags = 0

    def leave(self, upto: int) -> None:
        while len(self.open) > upto:
            name = self.open.pop()[0]
            self.at[name].pop()
            if name in BARRIERS:
                self.barriers.pop()

    def handle_starttag(self, tag: str, attrs) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        ended = [self.at[e][-1] for e in (*SAME.get(tag, "").split(), *["p"] * (tag in CLOSES_P)) if self.at[e]]
        if ended and max(ended) > (self.barriers[-1] if self.barriers else -1):
            self.leave(max(ended))
        _, above, unseen, aside, within = self.open[-1] if self.open else ("", 0, False, False, False)
        said = dict(attrs)
        here = tag in ASIDE or (tag in INNER_HEADER and not within) or (tag not in ("html", "body") and marked(said, tag, within))
        # a word or a link of a line is left out, a block has its own lines
        unseen = unseen or tag in UNSEEN or hidden(said) or (here and tag not in BLOCKS)
        self.names.append(tag)
        self.parents.append(above)
        self.at[tag].append(len(self.open))
        if tag in BARRIERS:
            self.barriers.append(len(self.open))
        self.open.append((tag, len(self.names) - 1, unseen, aside or here, within or tag in ("article", "main")))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
        if self.at[tag]:
            self.leave(self.at[tag][-1])

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][2]):
            self.text.append(data)

    def ends(self, end: str, i: int) -> bool:
        """Whether ``end`` stands at or after ``i``."""
        if self.last.get(end, (None, 0))[0] is not self.rawdata:
            self.last[end] = self.rawdata, self.rawdata.rfind(end)
        return self.last[end][1] >= i

    def parse_comment(self, i: int, report: bool = True) -> int:
        return super().parse_comment(i, report) if self.ends("-->", i) or self.ends("--!>", i) else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        return super().parse_html_declaration(i) if self.ends(">", i) else len(self.rawdata)

    def parse_pi(self, i: int) -> int:
        return super().parse_pi(i) if self.ends(">", i) else len(self.rawdata)

    def parse_starttag(self, i: int) -> int:
        return super().parse_starttag(i) if self.ends(">", i) else len(self.rawdata)

    def parse_endtag(self, i: int) -> int:
        return super().parse_endtag(i) if self.ends(">", i) else len(self.rawdata)


def hidden(said: dict) -> bool:
    """Whether an element's attributes say that it is not shown."""
    return "hidden" in said or said.get("aria-hidden") == "true" or _HIDDEN.search(said.get("style") or "") is not None


def marked(said: dict, tag: str, within: bool) -> bool:
    """Whether an element's attributes say that it is no content."""
    if (said.get("role") or "").lower() in ROLES:
        return True
    if tag in HEADINGS:  # ids of headings are anchors
        return False
    for name in f"{said.get('class') or ''} {said.get('id') or ''}".lower().split():
        parts = {part for part in _PART.findall(name) if len(part) > 1}
        found = parts & (REMARKS if tag in ("article", "main") else MARKS)
        # a header within an article holds its heading
        if found - ({"header"} if within else set()) and parts <= MARKS | REMARKS | PLAIN:
            return True
    return False


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing along the lines; the kernel is cut at three sigma and at the ends of the page."""
    radius = int(3 * sigma)
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    n = len(ratios)
    part = np.convolve(ratios, weights)[radius : radius + n]
    return part / np.convolve(np.ones(n), weights)[radius : radius + n]


def _parsed(html: str) -> _Lines:
    for page in (html, _SECTION.sub("", html)):
        parser = _Lines()
        try:
            parser.feed(page)
            parser.close()
        except AssertionError:  # a marked section that the parser does not know
            continue
        break
    parser.cut()
    return parser


def main_text(html: str | None, sigma: float = 1.0, threshold: float = 0.5) -> str:
    """The main text of a page: its blocks in page order, one a line; empty if it has none.

    The threshold is a share of the mean of the smoothed ratios, each line weighed by its characters; at 0 every line of the
    page is in one cluster. Articles with clustered text (where there are none, such main elements, then articles without) are not
    divided; beside one, in the main element or in the article's parent, lines of clusters are main text too.
    """
    if not html:
        return ""
    parser = _parsed(html)
    names, parents = parser.names, parser.parents
    aside = np.array([line[3] for line in parser.lines], bool)
    if not len(aside) or (threshold > 0 and aside.all()):
        return ""
    size = np.array([len(line[1]) for line in parser.lines], float)
    of = np.array([line[0] for line in parser.lines])
    own = np.where(aside, 0, size / np.maximum([line[2] for line in parser.lines], 1))
    content = _clusters(own, np.where(aside, 0, smoothed(own, sigma)), size, threshold)
    chosen = _regions(of, size, content, aside & ~content, names, parents)
    return "\n".join(line[1] for line, taken in zip(parser.lines, chosen, strict=True) if taken)


def _clusters(own: np.ndarray, ratios: np.ndarray, size: np.ndarray, threshold: float) -> np.ndarray:
    """Which lines are in clusters: runs of smoothed ratios above the threshold, from a line that is above it by itself to another."""
    level = threshold * np.average(ratios, weights=size)
    above, firm = ratios >= level, own >= level
    if above[ratios > 0].all():  # the page is one run
        return above & ((ratios > 0) | (threshold <= 0))
    run = np.cumsum(np.diff(above, prepend=~above[:1]))
    to = np.flatnonzero(above & firm)
    content = np.zeros(len(own), bool)
    if len(to):
        _, first = np.unique(run[to], return_index=True)
        for low, high in zip(to[first], to[np.append(first[1:], len(to)) - 1], strict=True):
            content[low : high + 1] = True
    return content & (ratios > 0) if threshold > 0 else content


def _regions(of: np.ndarray, size: np.ndarray, content: np.ndarray, aside: np.ndarray, names: list[str], parents: list[int]) -> np.ndarray:
    """Which lines the clusters and their regions hold."""
    total, clustered = np.zeros(len(names)), np.zeros(len(names))
    np.add.at(total, of, np.where(aside, 0, size))
    np.add.at(clustered, of, np.where(content, size, 0))
    for element in range(len(names) - 1, 0, -1):
        total[parents[element]] += total[element]
        clustered[parents[element]] += clustered[element]
    good = (2 * clustered >= total) & (clustered > 0)
    part = [0]  # the smallest part of the page that holds an element
    mixed = np.zeros(len(names), bool)  # parts that hold a part mostly outside the clusters
    for element in range(1, len(names)):
        small = names[element] in INLINE or names[element] in HEADINGS
        part.append(part[parents[element]] if small else element)
    for element in range(len(names) - 1, 0, -1):
        if total[element]:
            mixed[part[parents[element]]] |= mixed[element] or (part[element] == element and not good[element])
    named = {e for e in range(1, len(names)) if clustered[e] and names[e] == "article"}
    mains = {e for e in range(1, len(names)) if clustered[e] and names[e] == "main"}
    named = named or mains or {e for e in range(1, len(names)) if total[e] and clustered[0] and names[e] == "article"}
    around = mains | {parents[e] for e in named}
    inside, beside = [0 in named], [not named or 0 in around]
    for element in range(1, len(names)):
        whole = good[element] and not mixed[element] and part[element] == element and names[element] not in ROOTS and not named
        inside.append(element in named or whole or inside[parents[element]])
        beside.append(element in around or beside[parents[element]])
    chosen = ~aside & (np.array(inside)[of] | (content & np.array(beside)[of]))
    return chosen if named else chosen | (~aside & _between(np.array(part)[of], chosen, [names[e] in HEADINGS for e in of]))


def _between(part: np.ndarray, chosen: np.ndarray, heading: list[bool]) -> np.ndarray:
    """Lines between chosen ones of their own part, and headings that lead to its first."""
    at = np.arange(len(part))
    first, last = np.full(part.max() + 1, len(part)), np.full(part.max() + 1, -1)
    np.minimum.at(first, part[chosen], at[chosen])
    np.maximum.at(last, part[chosen], at[chosen])
    leads = dict.fromkeys(np.flatnonzero(last >= 0).tolist(), True)  # whether all lines of the part from here to its first chosen one are headings
    for i in range(len(part) - 1, -1, -1):
        one = int(part[i])
        if i < first[one] and leads.get(one):
            leads[one] = heading[i]
            first[one] -= (first[one] - i) * heading[i]
    return (at >= first[part]) & (at <= last[part])


def extract(pages: DataFrame, **parameters) -> DataFrame:
    """page_id, url, text, n_chars (code points), a row for each row of pages.

    The whole html is read; null and empty html and pages without main text give an empty text.
    Nulls in page_id and url are passed on, repeated rows extracted each, extra columns ignored.
    """

    def run(batches):
        for batch in batches:
            for low, high, data, offsets in kernels.chunks(batch.column(2), 8 << 20):
                texts = [main_text(data[a:b].tobytes().decode("utf-8", "replace"), **parameters) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                n = high - low
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, n), batch.column(1).slice(low, n), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
