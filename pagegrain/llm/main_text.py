"""Main text of a page by scoring its element tree.

One pass over the markup keeps the tree of block elements and cuts the text into blocks. Each paragraph
passes points for its length and commas, less the share of its text that is links, to its parent and,
fewer with each level, to the next ancestors. The element with the most points, discounted by its link
density, is the container; an enclosing article or main element is taken in its place, so that titles
and later sections stay. Its siblings are kept if they hold a fair share of its points or are
paragraphs of plain text. Menus, footers, asides and forms go by their element or role. Headers, and
sidebars, notices, adverts and comments by the words of their class and id, are only suspected: they go
once the page is read, unless they hold its article or most of its text, or a header its heading.

Defined results: a null or empty page, or one without such text, has an empty text; text without any
paragraph scores where it stands; an unfinished tag at the end is dropped; unclosed and crossing
elements are closed by their ancestors; <br> is white space inside a block; repeated rows are read each;
null ids and urls stay null; an empty table gives an empty result. Work is linear in the page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import record

LEVELS = 5  # ancestors that get points
SIBLING_SHARE = 0.2
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)

# Elements by their part in a page.
MATH = "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics"
INLINE = frozenset(f"a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr {MATH}".split())
SPACES = frozenset(["br", "mtd", "mtr"])
UNSEEN = frozenset(["annotation", "annotation-xml"])  # a formula's source beside the formula
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg noframes object".split())
JUNK = frozenset("nav footer aside button select menu".split()) | RAW
WRAPPERS = frozenset("form fieldset dialog".split())  # site builders put whole pages into them
PARAGRAPHS = frozenset("p pre blockquote li dd td th figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENCLOSING = frozenset(["article", "main"])
SAME_CLOSES = {"li": "li", "dd": "dt dd", "dt": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
JUNK_WORDS = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed)?|promo(?:tion)?|banner|nav|navbar|navigation|menu|breadcrumbs?|"
    r"header|masthead|footer|sidebar|aside|rail|widgets?|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|"
    r"subscribe|subscription|signup|login|comments?|commentlist|disqus|respond|replies|share|sharing|social|related|recommended|recirc|"
    r"pagination|pager|toolbar|skip|search|copyright|legal)(?:$|[-_\s])",
    re.IGNORECASE,
)
HEADER_WORDS = re.compile(r"(?:^|[-_\s])(?:header|masthead|banner)(?:$|[-_\s])", re.IGNORECASE)
THREAD_WORDS = re.compile(r"(?:^|[-_\s])(?:comments?|commentlist|disqus|respond|replies)(?:$|[-_\s])", re.IGNORECASE)
# Names that say what an element has, not what it is, and sections of papers.
MODIFIERS = re.compile(r"(?<!\S)(?:(?:has|no|with|without|not)[-_]\S+|\S+[-_](?:open|opened|closed|enabled|disabled)|related[-_](?:works?|literature|research|studies))(?!\S)", re.IGNORECASE)
PLAIN, HEADER, THREAD = 1, 2, 3  # kinds of suspicion; articles inside a thread are its comments
LEAST = 200  # characters of paragraph text that count as a page's text
LITTLE = 0.2  # share of the page's paragraph text under which an article inside suspected elements is a teaser
GOOD_WORDS = re.compile(r"(?:^|[-_\s])(?:article|body|content|entry|main|post|story|text|blog)(?:$|[-_\s])", re.IGNORECASE)


class Page:
    """The block elements of a page in document order, and its text blocks."""

    def __init__(self, markup: str):
        self.tags, self.parents, self.junk, self.good, self.weak = ["#page"], [-1], [False], [0], [0]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._pieces: list[str] = []
        self._links = self._linked = 0
        # Open elements: number, tag, junk, place of the open paragraph in scope.
        self._open: list[tuple[int, str, bool, int]] = [(0, "#page", False, -1)]
        self._count: dict[str, int] = {}
        at, end = 0, len(markup)
        for found in TAG.finditer(markup):
            if found.start() < at:
                continue
            if found.start() > at:
                self._text(markup[at : found.start()])
            at = found.end()
            closing, tag, rest = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not tag:
                continue
            tag = tag.lower()
            if tag in UNSEEN:
                if not closing and not rest.endswith("/"):
                    stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?|</math\b", re.IGNORECASE).search(markup, at)
                    at = (stop.start() if stop[0][:6].lower() == "</math" else stop.end()) if stop else end
            elif closing:
                self._close(tag)
            else:
                self._start(tag, rest)
                if tag in RAW and not rest.endswith("/"):
                    stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE).search(markup, at)
                    at = stop.end() if stop else end
                    self._close(tag)
        if at < end:
            self._text(markup[at:])
        self._flush()

    def _text(self, text: str) -> None:
        if not self._open[-1][2]:
            self._pieces.append(text)
            if self._links:
                self._linked += len(text)

    def _flush(self) -> None:
        if self._pieces:
            text = " ".join(html.unescape("".join(self._pieces)).split())
            if text:
                self.blocks.append((self._open[-1][0], text, min(self._linked, len(text))))
            self._pieces, self._linked = [], 0

    def _pop_to(self, place: int) -> None:
        for _, tag, _, _ in self._open[place:]:
            self._count[tag] -= 1
        del self._open[place:]

    def _start(self, tag: str, rest: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self._links += 1
            elif tag in SPACES:
                self._pieces.append(" ")
            return
        self._flush()
        self._links = 0
        if self._open[-1][3] >= 0:  # a block element closes the open paragraph
            self._pop_to(self._open[-1][3])
        if tag in SAME_CLOSES and self._open[-1][1] in SAME_CLOSES[tag].split():
            self._pop_to(len(self._open) - 1)
            if tag == "tr" and self._open[-1][1] == "tr":
                self._pop_to(len(self._open) - 1)
        if tag in VOID:
            return
        number, (_, _, junk, _) = len(self.tags), self._open[-1]
        good, own, weak = 0, tag in JUNK, 0
        if tag in WRAPPERS:
            weak = PLAIN
        if tag == "header" and not (self._count.get("article") or self._count.get("main")):
            weak = HEADER
        if not own and rest and tag not in ("html", "body"):
            for name, value in ATTRIBUTE.findall(rest):
                value = value.strip("\"'")
                if name.lower() == "role":
                    own = own or (value.lower() in ROLES and tag not in ENCLOSING)
                    weak = max(weak, PLAIN if value.lower() == "form" and tag not in ENCLOSING else 0)
                else:
                    names = MODIFIERS.sub(" ", value)
                    if tag not in ENCLOSING and JUNK_WORDS.search(names):
                        rest_of = HEADER_WORDS.sub(" ", names)
                        weak = max(weak, THREAD if THREAD_WORDS.search(names) else PLAIN if JUNK_WORDS.search(rest_of) else HEADER)
                    good = good or bool(GOOD_WORDS.search(value))
        self.tags.append(tag)
        self.parents.append(self._open[-1][0])
        self.junk.append(junk or own)
        self.good.append(int(good))
        self.weak.append(weak)
        self._open.append((number, tag, junk or own, len(self._open) if tag == "p" else -1))
        self._count[tag] = self._count.get(tag, 0) + 1

    def _close(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self._links = max(0, self._links - 1)
            return
        self._flush()
        if self._count.get(tag):
            place = len(self._open) - 1
            while self._open[place][1] != tag:
                place -= 1
            self._pop_to(place)

    def _settle(self) -> None:
        """Drop the suspected elements that don't hold the page's text; outer ones first, those of a depth alike."""
        n, parents, weak = len(self.tags), self.parents, self.weak
        own, holder, depth, place, named = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        for at, text, links in self.blocks:
            if self.tags[at] not in HEADINGS:
                own[at] += len(text) - links
        inside, encloses, titles = own[:], [int(t in ENCLOSING) for t in self.tags], [int(t == "h1") for t in self.tags]
        levels: list[list[int]] = [[0]]
        for at in range(1, n):
            up = parents[at]
            holder[at] = at if weak[at] else holder[up]  # the nearest suspect around
            depth[at] = depth[up] + (weak[at] > 0)
            place[at] = at if self.tags[at] in ENCLOSING else place[up]  # the nearest article or main
            named[at] = at if self.good[at] or self.tags[at] in ENCLOSING else named[up]
            if depth[at] == len(levels):
                levels.append([])
            levels[depth[at]].append(at)
        for at in range(n - 1, 0, -1):
            up = parents[at]
            inside[up], encloses[up], titles[up] = inside[up] + inside[at], encloses[up] + encloses[at], titles[up] + titles[at]
        # What stands outside of all suspects, or in those that stay.
        clear, clear_titles, in_places, in_named = 0, 0, {}, {}
        dropped = [False] * n

        def elsewhere(held: dict[int, int], nearest: list[int], at: int) -> int:
            around, up = 0, nearest[at]
            for _ in range(LEVELS):
                if not up:
                    break
                around, up = around + held.get(up, 0), nearest[parents[up]]
            return sum_of[id(held)] - around

        for members in levels:
            sum_of = {id(held): sum(held.values()) for held in (in_places, in_named)}
            for at in members:
                if holder[at] != at or not weak[at]:
                    continue
                most = inside[at] >= LEAST and 2 * inside[at] > inside[0]
                stays = most and (clear < LEAST if weak[at] == THREAD else elsewhere(in_named, named, at) < LEAST)
                if weak[at] != THREAD and encloses[at] and inside[at] > LITTLE * inside[0]:
                    stays = stays or not elsewhere(in_places, place, at)
                if weak[at] == HEADER and titles[at]:
                    stays = stays or not clear_titles or bool(named[at])
                dropped[at] = dropped[parents[at]] or not stays
            for at in members:
                dropped[at] = dropped[at] or dropped[holder[at]]
                if not dropped[at]:
                    clear, clear_titles = clear + own[at], clear_titles + (self.tags[at] == "h1")
                    for held, nearest in ((in_places, place), (in_named, named)):
                        if nearest[at] and own[at]:
                            held[nearest[at]] = held.get(nearest[at], 0) + own[at]
        self.junk = [j or d for j, d in zip(self.junk, dropped)]
        self.blocks = [b for b in self.blocks if not dropped[b[0]]]

    def main_text(self) -> str:
        if any(self.weak):
            self._settle()
        n = len(self.tags)
        points, length, linked = [0.0] * n, [0] * n, [0] * n
        for at, text, links in self.blocks:
            length[at] += len(text)
            linked[at] += links
            if self.tags[at] in HEADINGS:
                continue
            worth = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - links / len(text))
            to = self.parents[at] if self.tags[at] in PARAGRAPHS else at
            for level in range(LEVELS):
                if to < 0:
                    break
                points[to] += worth / (1, 2, 6, 9, 12)[level]
                to = self.parents[to]
        last = list(range(n))  # the last element inside each
        for at in range(n - 1, 0, -1):
            up = self.parents[at]
            length[up] += length[at]
            linked[up] += linked[at]
            last[up] = max(last[up], last[at])
        worth = [p * (1 - linked[i] / length[i]) * (1.25 if self.good[i] or self.tags[i] in ENCLOSING else 1) if p else 0.0 for i, p in enumerate(points)]
        best = max(range(n), key=worth.__getitem__)
        if worth[best] <= 0:
            return "\n".join(text for _, text, _ in self.blocks)
        up = best
        while up > 0 and self.tags[up] not in ENCLOSING:
            up = self.parents[up]
        top = up if up > 0 else best
        kept = [(top, last[top])]
        if self.parents[top] >= 0:
            for at in range(n):
                if self.parents[at] == self.parents[top] and at != top and not self.junk[at] and not self.weak[at] and length[at]:
                    plain = self.tags[at] in PARAGRAPHS and (linked[at] / length[at] < 0.25 if length[at] > 80 else not linked[at])
                    if plain or worth[at] >= SIBLING_SHARE * worth[best]:
                        kept.append((at, last[at]))
        kept.sort()
        out = []
        starts = [a for a, _ in kept]
        for at, text, _ in self.blocks:
            place = bisect_right(starts, at) - 1
            if place >= 0 and at <= kept[place][1]:
                out.append(text)
        return "\n".join(out)


def main_text(markup: str | None) -> str:
    return Page(markup).main_text() if markup else ""


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """``page_id, url, text`` of every row; no shuffle."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                yield record(schema, rows.column(0), rows.column(1).cast(pa.string()), [main_text(m) for m in rows.column(2).to_pylist()])

    narrow = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(markup).cast("string").alias("html"))
    return narrow.mapInArrow(run, "page_id long, url string, text string")
