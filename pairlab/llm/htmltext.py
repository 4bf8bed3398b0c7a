"""Main text of HTML pages by tag-path ratios.

A page is cut into text nodes, each with its root-to-leaf path of tags. Text length and
punctuation are summed over all nodes of a path and divided by their number; the two ratios are
smoothed along the page with a short binomial window and fused by product, and nodes above a fraction
of the fused values' standard deviation are content nodes.

The content nodes choose the article and what belongs to it:

* Elements that a tag, role or class names as no article (menus, comments, adverts and the like) don't
  count, unless they hold nearly all content: a class name never outweighs the ratios.
* The article is the deepest element that holds most content; around it, its ``article`` or else ``main``
  element, or the deepest element that holds all content.
* Of the article, content nodes are returned with the other nodes of their blocks. A block without
  content is returned if it lies between content, is a heading before it, or, in an ``article`` or ``main``
  element, lies anywhere; but not if most of its element's text is links and the ratios found nothing there,
  and not if it is one of _ITEMS or more short neighbours of one path, without punctuation, before or after all content.

Inside ``article`` and ``main``, the id or class of a heading, that of a paragraph (but for adverts and comments), and an id
made of words that aren't parts of a page are anchors and exclude nothing.

Defined cases: a null or empty page, or one without text, gives the empty string; tags left open,
cut-off markup and unknown tags are allowed, at any depth; a null page id or url is kept; repeated rows
get equal results; ties go to the element first opened; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import forget, text_slices

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>][^\s>]*)))?|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)""")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?¿¡…。、，！？]")
_PARTS = re.compile(r"[-_]+")

#: HTML's void, raw-text and block elements.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math object xmp".split())
_TEXT = frozenset("script style textarea title iframe xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body br_ caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a new one of the same group closes, up to the given ancestors.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements outside any article by tag; by role; by a class or id, whole or as the first or last part of a compound one.
_NEVER = frozenset("head script style noscript template iframe svg math object nav aside footer button select textarea input menu dialog xmp".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer form"
    " gdpr masthead menu modal nav navbar navigation newsletter notice notification popup promo promoted promotion related respond"
    " share sharing sidebar social sponsor sponsored subscribe toolbar widget login signup".split()
)
#: First parts of a compound that says what an element has or lacks, not what it is; and those that make a header a site's.
_SAYS = frozenset("no has have with without not non is hide show".split())
_SITE = frozenset("site page top main global".split())
_COMMENTS = frozenset("comment comments disqus respond".split())
#: Words of adverts and the like, which name a paragraph too; and what the rest of a compound id says of an element's part in the page.
#: An id with other words in it, inside an article, is an anchor that says what the text is about.
_ADVERTS = frozenset("ad ads advert adverts advertisement advertising banner cookie cookies consent gdpr newsletter popup promo promoted promotion sponsor sponsored subscribe".split())
_PARTS_OF_PAGE = frozenset(
    "area articles bar block body bottom box btn button container content count div element group header holder inner item items left link links list"
    " main outer page panel post posts reply right row section sections site slot stories thread title top unit wrap wrapper zone".split()
)
_INLINE = frozenset("p b i em strong span a".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Characters of content that an excluded element must hold to be the article after all.
_PROSE = 120
#: Neighbouring short nodes of one path, none with punctuation, that are a menu where they stand before or after an article's content, and their characters at most on average.
_ITEMS, _ITEM = 8, 40
#: Elements whose short texts are lists or tables of an article.
_LISTED = frozenset("li dt dd td th pre caption figcaption summary address".split())


def _named(value: str, header: bool) -> int:
    """0, or 1 if a class or id names no article, 3 if it names readers' comments; ``header``: a header is the site's here."""
    for token in value.split():
        parts = [x for x in _PARTS.split(token) if x]
        if not parts or len(parts) > 1 and parts[0] in _SAYS:
            continue
        if parts[0] in _WORDS or parts[-1] in _WORDS and "header" not in parts:
            return 3 if {parts[0], parts[-1]} & _COMMENTS else 1
        if header and parts[-1] == "header" and (len(parts) == 1 or parts[0] in _SITE):
            return 1
    return 0


class _Page:
    """Text nodes of one page with their paths, blocks and elements.

    A path is a number that stands for its parent's path and a tag, so that deep pages take linear space.
    """

    def __init__(self, html: str):
        self.nodes: list[tuple[int, int, str]] = []  # (element, block, text)
        self.parent, self.depth, self.tag, self.path_of = [-1], [0], [""], [0]
        self.hold = [False]  # inside an article or main element
        self.nearest = [0]  # the element itself or above it that is a block
        self.bars: list[int] = [0]  # 2: never part of an article, 1: by a name only, 3: comments by name
        self.paths: dict[tuple[int, str], int] = {}
        self.is_open: dict[str, int] = defaultdict(int)
        self.block = 0
        self._read(html)

    def _open(self, at: int, tag: str, attributes: str) -> int:
        e = len(self.parent)
        self.parent.append(at)
        self.depth.append(self.depth[at] + 1)
        self.path_of.append(self.paths.setdefault((self.path_of[at], tag), len(self.paths) + 1))
        self.tag.append(tag)
        self.hold.append(self.hold[at] or tag in ("article", "main"))
        self.nearest.append(e if tag in _BLOCK else self.nearest[at])
        self.bars.append(self._bar(at, tag, attributes))
        self.is_open[tag] += 1
        return e

    def _bar(self, at: int, tag: str, attributes: str) -> int:
        inside = self.hold[at]  # an article's own header holds its title
        if tag in _NEVER or tag == "header" and not inside:
            return 2
        found = int(tag == "form")
        if tag in ("html", "body", "article", "main") or not attributes:
            return found
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = (m[1] or "").lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return 2
            if name == "role" and value in _ROLES:
                found = found or 1
            elif name in ("class", "id") and not (inside and self._anchor(tag, name, value)):
                found = max(found, _named(value, not inside))
        return found

    @staticmethod
    def _anchor(tag: str, name: str, value: str) -> bool:
        """Whether a class or id, inside an article, only tells of the text: a heading's, a paragraph's but for adverts, or an id of some words."""
        if tag in _HEADINGS:
            return True
        parts = [x for x in _PARTS.split(value) if x]
        if tag == "p":
            return not set(re.split(r"[-_\s]+", value)) & (_ADVERTS | _COMMENTS)
        return name == "id" and " " not in value and len(parts) > 1 and not all(x in _WORDS or x in _PARTS_OF_PAGE or x.isdigit() or len(x) == 1 for x in parts)

    def _text(self, at: int, raw: str) -> None:
        if raw:
            self.nodes.append((at, self.block, raw))

    def _up_to(self, at: int, e: int) -> int:
        """The parent of e, with everything from at up to e closed."""
        x = at
        while True:
            self.is_open[self.tag[x]] -= 1
            if x == e:
                return self.parent[e]
            x = self.parent[x]

    def _close(self, at: int, tag: str) -> int:
        if not self.is_open[tag]:
            return at
        x = at
        while self.tag[x] != tag:
            x = self.parent[x]
        return self._up_to(at, x)

    def _implied(self, at: int, tag: str) -> int:
        if tag in _CLOSES:
            own, stop = _CLOSES[tag]
            if not any(self.is_open[t] for t in own):
                return at
            x, found = at, -1
            while x > 0 and self.tag[x] not in stop:
                if self.tag[x] in own:
                    found = x
                x = self.parent[x]
            return self._up_to(at, found) if found > 0 else at
        if tag in _BLOCK:  # a block ends an open paragraph, with the inline elements in it
            x = self.nearest[at]
            if x > 0 and self.tag[x] == "p":
                return self._up_to(at, x)
        return at

    def _read(self, html: str) -> None:
        at, pos, endless = 0, 0, set()
        while m := _TOKEN.search(html, pos):
            self._text(at, html[pos : m.start()])
            pos = m.end()
            if not (tag := m[2]):
                continue
            tag = tag.lower()
            if tag in _BLOCK:
                self.block += 1
            if m[1]:
                at = self._close(at, tag)
                continue
            at = self._implied(at, tag)
            if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK:
                if tag == "br":
                    self._text(at, " ")
                continue
            if tag in _RAW:
                end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, pos)
                if not end:
                    endless.add(tag)
                if end or tag in _TEXT:  # others that never end are passed over, not what follows
                    pos = end.end() if end else len(html)
                continue
            at = self._open(at, tag, m[3])
        self._text(at, html[pos:])


def _smooth(x: np.ndarray) -> np.ndarray:
    padded = np.pad(x, 1, mode="edge")
    return (padded[:-2] + 2 * padded[1:-1] + padded[2:]) / 4


def _totals(values: np.ndarray, parent: list[int]) -> list:
    """For each element, the sum of the values of itself and all below; a parent is opened before its children."""
    out = values.tolist()
    for e in range(len(out) - 1, 0, -1):
        out[parent[e]] += out[e]
    return out


def _below(seed: list[bool], parent: list[int]) -> list[bool]:
    """For each element, whether it or one above it is marked."""
    out = list(seed)
    for e in range(1, len(out)):
        out[e] = out[e] or out[parent[e]]
    return out


def _content(page: _Page, texts: list[str], among: list[int], strictness: float) -> list[int]:
    """The nodes, of those given, whose fused tag-path ratios pass the threshold."""
    length, marks, number = defaultdict(int), defaultdict(int), defaultdict(int)
    paths = [page.path_of[page.nodes[i][0]] for i in among]
    for i, path in zip(among, paths):
        length[path] += len(texts[i].strip())
        marks[path] += len(_PUNCTUATION.findall(texts[i]))
        number[path] += 1
    ratio, mark_ratio = (np.array([v[p] / number[p] for p in paths]) for v in (length, marks))
    fused = _smooth(ratio) * (1.0 + _smooth(mark_ratio))
    least = strictness * fused.std()
    return [i for i, v in zip(among, fused.tolist()) if v >= least]


def _edge_items(page: _Page, texts: list[str], among: list[int], first: int, last: int) -> set[int]:
    """Blocks, before the first or after the last with content, of at least _ITEMS neighbouring nodes of one path whose ratios are those of a menu."""
    out: set[int] = set()
    run: list[int] = []
    path = -1

    def end() -> None:
        lengths = [len(texts[i].strip()) for i in run]
        if len(run) >= _ITEMS and sum(lengths) <= _ITEM * len(run) and not any(_PUNCTUATION.search(texts[i]) for i in run):
            out.update(page.nodes[i][1] for i in run)

    for i in among:
        e, block, _ = page.nodes[i]
        own = page.path_of[e] if not first <= block <= last and page.tag[page.nearest[e]] not in _LISTED | _HEADINGS else -1
        if own != path or own < 0:
            end()
            run, path = [], own
        if own >= 0:
            run.append(i)
    end()
    return out


def main_text(html: str | None, *, strictness: float = 0.5, share: float = 0.8) -> str:
    """The article's text: blocks in page order, joined by an empty line."""
    if not html:
        return ""
    page = _Page(html)
    texts = [_SPACE.sub(" ", unescape(t)) for *_, t in page.nodes]
    never = _below([b == 2 for b in page.bars], page.parent)
    filled = [i for i, (e, _, _) in enumerate(page.nodes) if not never[e] and texts[i].strip()]
    if not filled:
        return ""
    n = len(page.parent)

    def held(nodes: list[int]) -> list[int]:
        own = np.zeros(n, np.int64)
        for i in nodes:
            own[page.nodes[i][0]] += len(texts[i].strip())
        return _totals(own, page.parent)

    # What names exclude stays out as long as there is content without it; else the largest such element comes in.
    named = [b in (1, 3) for b in page.bars]
    mass = held(_content(page, texts, filled, strictness))
    while True:
        outside = _below([a or b for a, b in zip(named, never)], page.parent)
        kept = [i for i in filled if not outside[page.nodes[i][0]]]
        chosen = _content(page, texts, kept, strictness) if kept else []
        found = held(chosen)
        if found[0] >= (1 - share) * mass[0] or found[0] >= _PROSE and any(page.hold[page.nodes[i][0]] for i in chosen):
            break
        above = _below(named, page.parent)
        some = [e for e in range(1, n) if named[e] and not above[page.parent[e]] and mass[e] >= (1 if page.tag[e] == "form" else _PROSE)]
        # Comments are no article unless there is nothing else.
        some = [e for e in some if page.bars[e] == 1] or [e for e in some if not found[0]]
        if not some:
            break
        named[max(some, key=lambda e: (mass[e], -e))] = False
    if not chosen:
        return ""

    article = max((e for e in range(n) if found[e] >= share * found[0] and page.tag[e] not in _INLINE), key=lambda e: (page.depth[e], -e))
    while page.tag[article] not in _BLOCK and page.parent[article] > 0:
        article = page.parent[article]
    # What surrounds a long section belongs to the article: up to its article or main element, or to all content.
    above, x = [], article
    while x > 0:
        above.append(x)
        x = page.parent[x]
    hints = [e for tag in ("article", "main") for e in above if page.tag[e] == tag]
    article = hints[0] if hints else next((e for e in above if found[e] == found[0]), 0)
    inside = _below([e == article for e in range(n)], page.parent)

    linked, all_text = (held([i for i in filled if of is None or of[page.nodes[i][0]]]) for of in (_below([t == "a" for t in page.tag], page.parent), None))
    # A list of links without content in it; a paragraph or heading that is a link is none.
    menu = _below([not found[e] and page.tag[e] in _BLOCK - _HEADINGS - {"p", "li"} and 2 * linked[e] > all_text[e] for e in range(n)], page.parent)
    content = {page.nodes[i][1] for i in chosen if inside[page.nodes[i][0]]}
    first, last = min(content, default=0), max(content, default=-1)
    items = _edge_items(page, texts, [i for i in kept if inside[page.nodes[i][0]]], first, last)
    blocks: dict[int, list[str]] = defaultdict(list)
    heads: set[int] = set()
    for i, (e, block, _) in enumerate(page.nodes):
        if inside[e] and not outside[e] and block not in items and (not menu[e] or block in content):
            blocks[block].append(texts[i])
            if page.tag[page.nearest[e]] in _HEADINGS:
                heads.add(block)
    joined = {b: text for b, t in sorted(blocks.items()) if (text := _SPACE.sub(" ", "".join(t)).strip())}
    lead = first
    for b in reversed([b for b in joined if b < first]):  # headings that stand right before the content
        if b not in heads:
            break
        lead = b
    return "\n\n".join(text for b, text in joined.items() if hints or lead <= b <= last)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches):
        forget()
        for b in text_slices(batches, 2):
            text = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
