"""Main text of web pages by line-block distribution.

Markup is stripped first: scripts, styles and elements that say by their name,
class or id that they hold no article text go with their contents, unless they
hold the article or most of the page's text, and each block element gives one
line of text.  A class or id says so as a whole: all words of `cookie-notice` do,
those of `has-sidebar` don't.  Then the lengths of the lines that are
not links are summed over sliding windows of lines.  The text surges where the
sum first rises above the threshold and dives where it last falls below it; all
lines between the first surge and the last dive are kept, and the headings right
above them.  Lines count CLIP characters at most for the threshold, so a long one
cannot raise it.  Lines that are no links and touch kept text are kept too, those
of the windows at the edges and those of the same containers.

Article marks (article, main, role=main, articleBody) only settle the edges.  A
marked element that holds at least half of the stretch the sums chose is kept
whole, and lines outside it count FOREIGN of their length.  If no element holds
so much, but lines outside all marks do, small marked ones (teasers) count FOREIGN.

Null and empty pages give the empty text.  Pages are treated one by one:
repeated or null ids, ties and other columns have no effect.  Unclosed elements
end with the page; an unclosed element that would hide the article ends where
the article begins.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaspark.llm.common import read, text_of

#: Lines in a window, the part of the largest window sum that counts as text, and a line's length in it at most.
WINDOW = 3
THRESHOLD = 0.2
CLIP = 100
#: What a line counts on the other side of an article's edge.
FOREIGN = 0.25
#: Part of the stretch below which a marked element beside unmarked text is no part of the article.
TEASER = 0.1

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(?P<raw>script|style|noscript|template|svg|math|textarea|select|iframe|object|title|canvas|audio|video)\b[^>]*+(?:>.*?</(?P=raw)\b[^>]*+>|>.*|$)"
    r"|<[!?][^>]*+>?"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)[^>]*+>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HIDDEN = frozenset("nav footer aside form button menu dialog noframes header fieldset".split())
ARTICLE = frozenset("article main".split())
CONTAINERS = frozenset("body div section article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_TEXT = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promoted "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer masthead sidebar sidebars rail widget widgets "
    "cookie cookies consent gdpr notice notices alert disclaimer newsletter subscribe subscription signup login paywall popup modal overlay "
    "comment comments commentlist disqus replies respond share sharing social related recommended recommendations outbrain taboola tags toolbar skip".split()
)
#: Words that may stand beside those above in one class or id.
BESIDE = frozenset("area bar block box button buttons container inner item items left link links list bottom outer right section top unit wrap wrapper".split())
#: Elements that never hold the article because they hold most of the text.
ASIDE = frozenset("nav footer aside button menu dialog noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Line(NamedTuple):
    text: str
    linked: int
    heading: bool
    mark: int  # the innermost marked element around it, 0: none
    container: int  # the innermost container's number
    hide: int  # the innermost element around it that says it holds no article text, 0: none


class Hide(NamedTuple):
    """An element that says it holds no article text, and what is restored when it ends."""

    name: str
    number: int
    opened: list[tuple[str, int, int]]
    count: Counter[str]
    base: tuple[str, int, int]
    link: int


class Page(NamedTuple):
    """Lines, and of each marked element (0: the page) the one around it and whether it is an article."""

    lines: list[Line]
    around: list[int]
    article: list[bool]


def _attributes(text: str) -> tuple[dict[str, str], set[str]]:
    """Attributes by name, the first of each, and the words among classes and id that speak for the whole class."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text) if text else ():
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    words: set[str] = set()
    for token in (found.get("class", "") + " " + found.get("id", "")).split():
        parts = {w.lower() for w in WORD.findall(token) if not w.isdigit()}
        if all(w in NOT_TEXT or w in BESIDE or w == "header" for w in parts):
            words |= parts - BESIDE
    return found, words


def _hides(name: str, found: dict[str, str], words: set[str], in_article: bool) -> bool:
    if name in VOID or name in ("html", "body") or name in ARTICLE:
        return False
    if name in HIDDEN:
        return not (name == "header" and in_article)
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return True
    return found.get("role", "").lower() in ROLES or bool(words & NOT_TEXT) or ("header" in words and not in_article)


def lines_of(page: str) -> list[Line]:
    """The lines of a page: its blocks' texts, white space folded, empty ones left out."""
    return parsed(page).lines


def parsed(page: str) -> Page:
    lines: list[Line] = []
    parts: dict[int, list[str]] = {}  # by hiding element
    linked: Counter[int] = Counter()
    around, is_article, mark_hide = [0], [False], [0]
    hide_around, hide_name = [0], [""]
    hides: list[Hide] = []
    depth: list[int] = []  # of each in hides, elements of its name that are open
    hiding: Counter[str] = Counter()
    last_close: dict[str, int] = {}
    opened: list[tuple[str, int, int]] = []  # containers: name, number, the marked element inside it
    count: Counter[str] = Counter()
    base = ("", 0, 0)
    mark = link = container = numbers = hide = 0
    heading = False
    at = 0

    def text(piece: str) -> None:
        if piece:
            parts.setdefault(hide, []).append(piece)
            if link:
                linked[hide] += len(piece.strip())

    def end() -> None:
        for k, pieces in parts.items():
            line = SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if line:
                lines.append(Line(line, linked[k], heading, mark, container, k))
        if parts:
            parts.clear()
            linked.clear()

    def begin_hide(name: str) -> None:
        nonlocal opened, count, base, container, numbers, link, hide
        hide_around.append(hide)
        hide_name.append(name)
        hides.append(Hide(name, hide, opened, count, base, link))
        depth.append(1)
        hiding[name] += 1
        hide = len(hide_around) - 1
        container = numbers = numbers + 1
        opened, count, base = [], Counter(), ("", container, mark)

    def end_hide() -> None:
        nonlocal opened, count, base, container, mark, link, hide
        name, hide, opened, count, base, link = hides.pop()
        depth.pop()
        hiding[name] -= 1
        _, container, mark = opened[-1] if opened else base

    for m in TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:  # a comment, a declaration or an element whose contents are no text
            continue
        closes = bool(m["close"] or m["close2"])
        if hides:
            if hiding[name]:
                k = max(k for k, x in enumerate(hides) if x.name == name) if hides[-1].name != name else len(hides) - 1
                depth[k] += -1 if closes else 1
                if depth[k] == 0:
                    if name not in INLINE:
                        end()
                    while len(hides) > k:
                        end_hide()
                    continue
            elif name in ARTICLE and not closes:
                while hides:  # never closed: it must not hide the article
                    hidden = hides[-1].name
                    if hidden not in last_close:
                        last_close[hidden] = max((x.start() for x in re.finditer(rf"</{re.escape(hidden)}\b", page, re.I)), default=-1)
                    if last_close[hidden] >= at:
                        break
                    end()
                    end_hide()
        if name in INLINE:
            if name == "a":
                link = 0 if closes else 1
            elif name == "br":
                text(" ")
            found, words = _attributes("" if closes else m["attributes"] or "")
            if words and not closes and _hides(name, found, words, mark > 0):
                begin_hide(name)
            continue
        end()
        heading = name in HEADINGS and not closes
        if closes:
            if count[name]:  # with the unclosed ones inside it
                inner = ""
                while inner != name:
                    inner = opened.pop()[0]
                    count[inner] -= 1
                _, container, mark = opened[-1] if opened else base
            continue
        found, words = _attributes(m["attributes"] or "")
        body = found.get("itemprop", "").lower() == "articlebody"
        marks = name in ARTICLE or found.get("role", "").lower() == "main" or body
        if not marks and _hides(name, found, words, mark > 0) and not (m["attributes"] or "").endswith("/"):
            begin_hide(name)
            link = 0
            continue
        if marks and not (body and is_article[mark]):
            around.append(mark)
            is_article.append(name == "article" or body or is_article[mark])
            mark_hide.append(hide)
            mark = len(around) - 1
        if name in CONTAINERS or marks:
            container = numbers = numbers + 1
            opened.append((name, container, mark))
            count[name] += 1
    text(page[at:])
    end()
    if len(hide_around) > 1:
        hidden_now = _hidden(lines, around, mark_hide, hide_around, hide_name)
        lines = [x for x in lines if not hidden_now[x.hide]]
    return Page(lines, around, is_article)


def _hidden(lines: list[Line], around: list[int], mark_hide: list[int], hide_around: list[int], hide_name: list[str]) -> list[bool]:
    """Of each element that says it holds no article text, whether it is hidden; none that holds the article or most of the text is."""
    marked, held, visible = [0] * len(around), [0] * len(hide_around), 0
    for x in lines:
        weight = max(0, len(x.text) - x.linked)
        marked[x.mark] += weight
        held[x.hide] += weight
        visible += weight * (x.hide == 0 and x.mark > 0)
    outside, article = held[0], 0
    for k in range(len(around) - 1, 0, -1):
        if around[k]:
            marked[around[k]] += marked[k]
        if marked[k] > (marked[article] if article else 0):
            article = k
    for k in range(len(hide_around) - 1, 0, -1):
        held[hide_around[k]] += held[k]
    shown = set()
    if article and marked[article] >= outside:
        k = mark_hide[article]
        while k:
            shown.add(k)
            k = hide_around[k]
    hidden = [False] * len(hide_around)
    for k in range(1, len(hide_around)):
        most = hide_name[k] not in ASIDE and 2 * held[k] > held[0] and held[k] > 4 * visible
        hidden[k] = hidden[hide_around[k]] or not (k in shown or most)
    return hidden


def _stretch(lines: list[Line], weights: list[float], threshold: float, inside: list[bool]) -> tuple[int, int]:
    """First line and the one after the last, between the first surge and the last dive of windows with lines inside."""
    core: list[int] = []
    begin = None
    for i in range(len(weights) + 1):
        surges = sum(weights[i : i + WINDOW]) > threshold
        if surges and begin is None:
            begin = i
        elif not surges and begin is not None:  # a window that surges has a line of more than a WINDOWth
            part = [k for k in range(begin, min(len(lines), i + WINDOW - 1)) if weights[k] * WINDOW > threshold]
            if any(inside[k] for k in part):
                core += part
            begin = None
    if not core:
        return 0, 0
    kept = {lines[k].container for k in core}

    def touches(k: int, edge: int) -> bool:
        return inside[k] and 2 * lines[k].linked < len(lines[k].text) and (abs(k - edge) < WINDOW or lines[k].container in kept)

    first, last = core[0], core[-1]
    while first > 0 and touches(first - 1, core[0]):
        first -= 1
    while last + 1 < len(lines) and touches(last + 1, core[-1]):
        last += 1
    return first, last + 1


def _inside(page: Page, weights: list[float]) -> tuple[list[bool], bool]:
    """The lines on the article's side of its edge, and whether a marked element is the article."""
    own = [0.0] * len(page.around)
    for x, w in zip(page.lines, weights):
        own[x.mark] += w
    whole, children = list(own), [[] for _ in own]
    for k in range(len(own) - 1, 0, -1):
        whole[page.around[k]] += whole[k]
        children[page.around[k]].append(k)
    at, half = 0, whole[0] / 2
    while not page.article[at]:
        inner = max(children[at], key=whole.__getitem__, default=0)
        if not inner or whole[inner] < half:
            break
        at = inner
    cards = not page.article[at] and 2 * own[at] >= whole[at]
    within = [at == 0] + [False] * (len(own) - 1)
    for k in range(1, len(own)):
        within[k] = k == at or within[page.around[k]] and not (cards and page.around[k] == at and whole[k] < TEASER * whole[0])
    return [within[x.mark] for x in page.lines], at > 0


def main_stretch(page: Page) -> tuple[int, int]:
    """First line and the one after the last of the main text."""
    lines = page.lines
    weights: list[float] = [max(0, len(x.text) - x.linked) for x in lines]
    if not any(weights):  # links only: those that are marked
        weights = [len(x.text) * (x.mark > 0) for x in lines]
    clipped = [min(CLIP, w) for w in weights]
    threshold = THRESHOLD * max((sum(clipped[i : i + WINDOW]) for i in range(len(clipped))), default=0)
    first, after = _stretch(lines, weights, threshold, [True] * len(lines))
    if len(page.around) > 1 and first < after:
        inside, is_marked = _inside(page, [w * (first <= i < after) for i, w in enumerate(weights)])
        begin, end = _stretch(lines, [w if x else FOREIGN * w for w, x in zip(weights, inside)], threshold, inside)
        if is_marked:
            places = [i for i, x in enumerate(inside) if x]
            first, after = (min(begin, places[0]), max(end, places[-1] + 1)) if end else (places[0], places[-1] + 1)
        elif end:
            first, after = begin, end
    while first > 0 and lines[first - 1].heading:
        first -= 1
    return first, after


def main_text(page: str | None) -> str:
    found = parsed(page or "")
    first, after = main_stretch(found)
    return "\n".join(x.text for x in found.lines[first:after])


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))


#: For pages like the given ones: one article element, which holds blocks, b and br only, and few kinds of references.
OP5_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(regexp_replace(coalesce(html, ''), '\s+', ' ', 'g'), '<article>(.*)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<br>', ' ', 'g'), '<[^>]*>', chr(10), 'g'), chr(10)) AS l FROM a),
c AS (SELECT page_id, url, list_transform(l, lambda y: trim(regexp_replace(replace(replace(replace(replace(y, '&quot;', '"'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&'), '\s+', ' ', 'g'))) AS l FROM b)
SELECT page_id, url, array_to_string(list_filter(l, lambda y: y <> ''), chr(10)) AS text, length(array_to_string(list_filter(l, lambda y: y <> ''), chr(10)))::BIGINT AS n_chars FROM c
"""
