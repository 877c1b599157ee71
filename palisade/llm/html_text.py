"""Main text of web pages by the distribution of text over line blocks.

Mark-up is stripped to one line per block element, parts that are never article text
(scripts, styles, navigation, forms, adverts, notices, reader comments and the like) are left
out, and containers leave blank lines between them. Over the line lengths, text in links not
counted, a sliding window of lines is summed; text runs from a surge of that sum to the dive
after it. Where a page marks its article, surge and dive are sought inside it, so that lists of
links at its ends or between its parts fall out; else over the body, where a surge has to stand
out from the rest of the page. Pages are read in one pass, in time linear in their length.
"""
from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import map_batches

# Lines summed together.
WINDOW = 3
# Window sum at which text surges on a page without a marked article.
SURGE = 80
# Window sum under which text has ended, at a blank line.
DIVE = 20
# A container named like noise is kept if it has more than this share of the unlinked text.
MOST = 0.5

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(
    r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_ARTICLE = re.compile(r"<(?:article|main)\b", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_BLANK = re.compile(r"\s+")

# Element and token names with a fixed meaning (fixed values).
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
DROPPED = frozenset("""head nav footer aside form button select option menu dialog svg math canvas
  object embed audio video map fieldset datalist dir applet""".split()) | RAW
VOID = frozenset("""area base br col embed hr img input link meta param source track wbr
  basefont frame keygen""".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label
  mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img""".split())
CONTAINERS = frozenset("""article aside body div footer header html main nav section table tbody
  ul ol dl form hgroup figure details center""".split())
PARAGRAPH_ENDERS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 pre blockquote address hr fieldset".split())
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = frozenset("""navigation banner contentinfo complementary search form menu menubar alert
  alertdialog dialog toolbar""".split())
NOISE = frozenset("""ad ads adv advert adverts advertisement advertising adsense adslot sponsor
  sponsored promo promotion banner nav navbar navigation menu menus submenu breadcrumb breadcrumbs
  sidebar footer masthead topbar toolbar cookie cookies consent gdpr notice notices notification
  alert popup modal overlay newsletter subscribe subscription signup login comment comments
  disqus reply replies respond responses share sharing social related recommended recommendations
  pagination pager paging widget widgets disclaimer copyright skip""".split())
# Words that name no content: what stands before them in a class or id is its subject.
NEUTRAL = frozenset("""area bar block body bottom box button buttons container content footer group
  header holder inner item items left links list main outer page panel right section site top
  slot unit zone panel thread feed form row col column region module component widgets
  wrap wrapper""".split())
# Words before a noise word that speak of something else than what the element is.
DENYING = frozenset("has with without no not is hide hides".split())
# Names of adverts and the like, which hold for any element but headings.
ADVERTS = frozenset("""ad ads adv advert adverts advertisement advertising adsense adslot sponsored
  promo newsletter cookie cookies consent gdpr""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMED = CONTAINERS - {"body", "html", "article", "main", "header", "hgroup"}
ARTICLE_TOKENS = frozenset("articlebody".split())


@dataclass
class Line:
    """Text of one block, how much of it is in links, and whether an article holds it."""
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    inside: bool = False
    heading: bool = False
    # Whether it goes on in the line before it.
    joined: bool = False
    # Innermost open element that is named like noise, from 1.
    noise: int = 0

    def text(self) -> str:
        return _BLANK.sub(" ", "".join(self.pieces)).strip()


def _attributes(text: str) -> dict[str, str]:
    return {m[0].lower(): html.unescape(m[1] or m[2] or m[3])
            for m in _ATTRIBUTE.findall(text)} if text.strip() else {}


def _subject(token: str) -> str:
    """The noise word that a class or id names, if it does: its last word but for neutral ones,
    as in ``fb-comments-box``; not one that is denied (``has-sidebar``) or that describes
    something else (``social-impact``)."""
    words = _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower())
    while words and words[-1] in NEUTRAL and words[-1] not in NOISE:
        words.pop()
    if words and words[-1] in NOISE and DENYING.isdisjoint(words):
        return words[-1]
    return ""


def _role(name: str, text: str, in_article: bool, by_words: bool) -> str:
    """``drop``, ``noise``, ``article`` or nothing, for an element that opens. ``by_words``: a
    container whose class or id names noise is noise, as is any element named an advert."""
    if name in DROPPED or (name == "header" and not in_article):
        return "drop"
    found = _attributes(text)
    if found:
        if "hidden" in found or found.get("aria-hidden") == "true" or re.search(
                r"display\s*:\s*none", found.get("style", "")):
            return "drop"
        if found.get("role", "").lower() in ROLES:
            return "drop"
        if by_words and (name in NAMED or name not in CONTAINERS | HEADINGS):
            subjects = {_subject(t) for key in ("class", "id") for t in found.get(key, "").split()}
            if name not in NAMED:
                subjects &= ADVERTS
            if any(subjects):
                return "noise"
        if found.get("role", "").lower() in ("main", "article") or found.get(
                "itemprop", "").lower() in ARTICLE_TOKENS:
            return "article"
    return "article" if name in ("article", "main") else ""


class _Scanner:
    """Finds the mark-up of a page. What a search has shown is remembered, so that tags that
    never end cost no second search."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.stop = (0, 0)
        self.last_end = page.rfind(">")
        self.dead: set[int] = set()

    def _next_stop(self, at: int) -> int:
        """Place of the next quote or ``>``, or the page's length."""
        start, place = self.stop
        if not start <= at <= place or start == place:
            found = _STOP.search(self.page, at)
            place = found.start() if found else len(self.page)
            self.stop = (at, place)
        return place

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag, outside of quotes; -1 if it has none."""
        page, path = self.page, []
        while at <= self.last_end:
            place = self._next_stop(at)
            if place == len(page) or place in self.dead:
                break
            if page[place] == ">":
                return place
            path.append(place)
            at = page.find(page[place], place + 1) + 1
            if not at:
                break
        self.dead.update(path)
        return -1

    def next(self, at: int) -> tuple[int, int, str, str, str]:
        """``(start, end, kind, name, inner text)`` of the next mark-up from ``at`` on."""
        page, size = self.page, len(self.page)
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, size if end < 0 else end + 3, "skip", "", ""
            if page.startswith("<![CDATA[", start):
                end = page.find("]]>", start + 9)
                return (start, size if end < 0 else end + 3, "cdata", "",
                        page[start + 9:size if end < 0 else end])
            if page.startswith(("<!", "<?"), start):
                if start + 2 <= self.last_end:
                    return start, page.find(">", start + 2) + 1, "skip", "", ""
            elif found := _TAG.match(page, start):
                end = self.tag_end(found.end())
                if end >= 0:
                    return (start, end + 1, "close" if found[1] else "open", found[2].lower(),
                            page[found.end():end])
        return size, size, "", "", ""


def lines_of(page: str, by_words: bool = True) -> list[Line]:
    """One line per block. Unclosed elements end with the parent that closes; a close tag that
    nothing opened is ignored."""
    lines = [Line()]
    # Name, role, and whether a paragraph is open with nothing but inline elements in it.
    stack: list[tuple[str, str, bool]] = []
    opened: dict[str, int] = {}
    dropping = articles = headings = 0
    # Elements named like noise: the one around each, and those open.
    around = [0]
    noisy = [0]
    scanner = _Scanner(page)
    at, size = 0, len(page)

    def end_line(blank: bool) -> None:
        if lines[-1].pieces:
            lines.append(Line())
        if blank and (len(lines) < 2 or lines[-2].pieces):
            lines.append(Line())

    def leave() -> None:
        nonlocal dropping, articles, headings
        name, role, _ = stack.pop()
        opened[name] -= 1
        dropping -= role == "drop"
        if role == "noise":
            noisy.pop()
        articles -= role == "article"
        headings -= name in HEADINGS

    def add(text: str) -> None:
        if not text or dropping:
            return
        text = html.unescape(text)
        line = lines[-1]
        # An advert inside a line is a line of its own, so that it alone falls out.
        if line.pieces and line.noise != noisy[-1]:
            line = Line(joined=True)
            lines.append(line)
        if not line.pieces:
            if text.isspace() and not line.joined:
                return
            line.inside = articles > 0
            line.noise = noisy[-1]
            line.heading = headings > 0
        line.pieces.append(text)
        if opened.get("a"):
            line.linked += len(_BLANK.sub(" ", text).strip())

    while at < size:
        start, end, kind, name, inner = scanner.next(at)
        add(page[at:start])
        at = end
        if kind == "cdata":
            add(inner.replace("&", "&amp;"))
        if not name:
            continue
        block = name not in INLINE
        if kind == "close":
            if opened.get(name):
                while stack[-1][0] != name:
                    leave()
                leave()
            if block:
                end_line(name in CONTAINERS)
            continue
        if block:
            end_line(name in CONTAINERS)
            while stack and stack[-1][0] in CLOSED_BY.get(name, ()):
                leave()
            if name in PARAGRAPH_ENDERS and stack and stack[-1][2]:
                # A block element ends an open paragraph, with the inline elements in it.
                while stack[-1][0] != "p":
                    leave()
                leave()
        if name in VOID or inner.endswith("/") and name in ("svg", "path", "use"):
            continue
        role = _role(name, inner, articles > 0, by_words)
        if name == "body":
            while opened.get("head"):
                leave()
        stack.append((name, role, name == "p" or (
            name in INLINE and bool(stack) and stack[-1][2])))
        opened[name] = opened.get(name, 0) + 1
        dropping += role == "drop"
        if role == "noise":
            around.append(noisy[-1])
            noisy.append(len(around) - 1)
        articles += role == "article"
        headings += name in HEADINGS
        if name in RAW:
            close = _RAW_CLOSE[name].search(page, at)
            at = page.find(">", close.end()) + 1 if close else 0
            at = at or size
            leave()
    return _joined(_without_noise(lines, around))


_RAW_CLOSE = {name: re.compile(f"</{name}", re.IGNORECASE) for name in RAW}


def _without_noise(lines: list[Line], around: list[int]) -> list[Line]:
    """Empties lines in elements named like noise. One that holds most of the text is kept,
    unless an article is marked that holds text enough outside of them."""
    if len(around) == 1:
        return lines
    held = [0] * len(around)
    total = marked = 0
    for line in lines:
        size = max(0, len(line.text()) - line.linked)
        total += size
        held[line.noise] += size
        if line.inside and not line.noise:
            marked += size
    for n in range(len(around) - 1, 0, -1):
        held[around[n]] += held[n]
    gone = [False] * len(around)
    for n in range(1, len(around)):
        gone[n] = gone[around[n]] or marked >= SURGE or held[n] <= MOST * total
    return [Line(joined=line.joined) if gone[line.noise] else line for line in lines]


def _joined(lines: list[Line]) -> list[Line]:
    """Parts of lines put together again."""
    result: list[Line] = []
    for line in lines:
        if line.joined and result:
            last = result[-1]
            if not last.pieces:
                last.inside, last.heading = line.inside, line.heading
            last.pieces += line.pieces
            last.linked += line.linked
        else:
            result.append(line)
    return result


def surges(
    lengths: list[int], window: int, surge: int, dive: int = DIVE,
    blank: list[bool] | None = None,
) -> list[tuple[int, int]]:
    """``[start, end)`` from each surge, where the sum over ``window`` lines reaches ``surge``,
    to its dive, a blank line (one of no length, if not given) from which on that sum is under
    ``dive``."""
    blank = [not n for n in lengths] if blank is None else blank
    sums = [sum(lengths[i:i + window]) for i in range(len(lengths))]
    found, start = [], None
    for i, total in enumerate(sums):
        if start is None and total >= surge and lengths[i]:
            start = i
        elif start is not None and blank[i] and total < min(dive, surge):
            found.append((start, i))
            start = None
    if start is not None:
        found.append((start, len(lengths)))
    return found


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article of a page; empty for null, an empty page, or one without text."""
    if not page:
        return ""
    lines = lines_of(page)
    texts = [line.text() for line in lines]
    if not any(line.inside for line in lines) and (not any(texts) or _ARTICLE.search(page)):
        # A wrapper that is only named after a part of it ("with-sidebar") took the article along.
        lines = lines_of(page, by_words=False)
        texts = [line.text() for line in lines]
    if any(line.inside and text for line, text in zip(lines, texts)):
        # Inside what the page marks as article any text is a surge, but not lines mostly of links.
        lengths = [0 if not line.inside else len(t) if line.heading else max(
            0, len(t) - 2 * line.linked) for line, t in zip(lines, texts)]
        found = surges(lengths, window, 1, blank=[not t for t in texts]) or [(0, len(lines))]
        kept = []
        for a, b in found:
            # A line of links with text in the same container is part of that text.
            while a > 0 and texts[a - 1] and lines[a - 1].inside:
                a -= 1
            kept.append((a, b))
        return " ".join(
            t for a, b in kept for t, line in zip(texts[a:b], lines[a:b]) if t and line.inside)
    lengths = [max(0, len(t) - 2 * line.linked) for line, t in zip(lines, texts)]
    found = surges(lengths, window, surge) or surges(lengths, window, 1)
    if not found:
        return ""
    kept = []
    for a, b in found:
        # A heading right before its text belongs to it.
        while a > 0 and (lines[a - 1].heading or not texts[a - 1]) and any(
                line.heading and t for line, t in zip(lines[max(0, a - 2):a], texts[max(0, a - 2):a])):
            a -= 1
        kept.append((a, b))
    return " ".join(t for a, b in kept for t in texts[a:b] if t)


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row, repeated rows included; null html gives an
    empty text. Other columns are ignored."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p) for p in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])

    narrow = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.col(html_col))
    return map_batches(narrow, run, "page_id bigint, url string, text string, n_chars bigint")
