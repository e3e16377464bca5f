"""Main text of web pages by the distribution of text over line blocks.

A page is stripped to lines: one line per block of text, without markup, and without the parts that are no article by
their element (navigation, forms, scripts) or by the words of their class, id or role (adverts, notices, comments).
Where a page marks its article, lines elsewhere go as well. A line weighs its characters outside links. Sums over a
sliding window of lines surge where the text begins and dive to nothing where it ends; a line break between sections is
as wide as the window, so short lines of other sections do not join the text. What lies between surge and dive is kept,
short lines included.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines a window spans.
WINDOW = 3

# Elements of HTML by what they mean for the text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_DROPPED = frozenset("""head script style title noscript template iframe object embed svg math canvas audio video nav aside
    footer form select button textarea datalist dialog menu xmp noembed noframes map""".split())
_BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol
    optgroup option p pre search section summary table tbody tfoot thead title tr ul""".split())
_SECTIONS = frozenset("article aside body div fieldset footer form header main nav section table td th".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ENDS_PARAGRAPH = _BLOCKS - frozenset("body caption head html legend optgroup option summary tbody tfoot thead title tr".split())
# Words of class, id and role names whose element is not part of an article.
_AVERTS = frozenset("""ad ads adbox adslot advert adverts advertisement advertising adsense banner banners promo promos promotion
    sponsor sponsored sponsors sponsorship""".split())
_NOTICES = frozenset("""alert alerts alertdialog consent cookie cookies cookiebar disclaimer gdpr lightbox modal newsletter notice
    notices notification notifications overlay paywall popup popups signup subscribe subscription toast""".split())
_COMMENTS = frozenset("""comment commentlist comments commentary disqus discussion replies reply respond responses
    feedback""".split())
_FRAME = frozenset("""breadcrumb breadcrumbs contentinfo copyright foot footer footers footnav masthead menu menus menubar nav
    navbar navigation navlinks pager pagination related recommended recommendations search share sharing sharebar shares
    sidebar sidebars sidenav siderail skip sitemap social socials tags topbar toolbar widget widgets""".split())
_HEADER = frozenset("header sitehead siteheader pageheader topnav".split())
_LEAVE_OUT = _AVERTS | _NOTICES | _COMMENTS | _FRAME
# Names by which pages mark the element that holds the article.
_BODY_NAMES = frozenset("""articlebody articlecontent articletext bodytext entrycontent entrytext maincontent maintext postbody
    postcontent posttext storybody storycontent storytext""".split())

_ATTRIBUTES = r"""(?:[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+|(?=>)))?+)*+"""
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*+)({_ATTRIBUTES})[\s/]*+(>|\Z)|<(?:[!?]|/(?![A-Za-z]))[^>]*+(?:>|\Z)",
    re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]*)))?""")
_OPENING = re.compile(r"<(?:[A-Za-z/!?]|\Z)")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_WORD = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Element:
    """An open or closed element that matters for the choice of text."""

    __slots__ = ("name", "parent", "no_text", "hinted", "kind", "link")

    def __init__(self, name: str, parent: Element | None):
        self.name, self.parent = name, parent
        self.no_text = False  # holds no article text, whatever is inside
        self.hinted = False   # looks like a part besides the article
        self.kind = ""        # how strongly it is marked as the article
        self.link = name == "a" or (parent is not None and parent.link)


class Line(NamedTuple):
    text: str
    linked: int
    element: Element | None


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), html.unescape(next(filter(None, values), "")))
    return found


def _names(value: str) -> tuple[set[str], set[str]]:
    """Words of a class or id value, and its names with all separators left out."""
    parts = _CAMEL.sub("-", value).lower().split()
    return {w for p in parts for w in _WORD.findall(p)}, {"".join(_WORD.findall(p)) for p in parts}


def _marked(element: Element, raw: str, inside_article: bool) -> None:
    """Sets what the element's name and attributes say."""
    name = element.name
    if name in _DROPPED:
        element.no_text = name not in ("form", "aside", "nav", "footer")
        element.hinted = True
    if name == "header":
        element.hinted = True
    if name == "article":
        element.kind = "article"
    elif name == "main":
        element.kind = "main"
    if not raw or "=" not in raw and "hidden" not in raw.lower():
        return
    attributes = _attributes(raw)
    role = attributes.get("role", "").lower()
    words, whole = _names(f"{attributes.get('class', '')} {attributes.get('id', '')} {role}")
    if ("hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
            or _HIDDEN.search(attributes.get("style", ""))):
        element.no_text = True
    if name in ("html", "body", "main"):
        return
    if (words & _LEAVE_OUT or whole & _LEAVE_OUT) and name not in _HEADINGS:
        element.hinted = True
    if (words & _HEADER or whole & _HEADER) and not inside_article and name not in _HEADINGS:
        element.hinted = True
    if role == "complementary" or role == "search" or (role == "banner" and not inside_article):
        element.hinted = True
    if name == "article" and element.hinted:
        element.kind = ""
    elif attributes.get("itemprop", "").lower() == "articlebody" or whole & _BODY_NAMES:
        element.kind = element.kind or "body"
    elif role in ("article", "main"):
        element.kind = element.kind or role


def _chain(element: Element | None):
    while element is not None:
        yield element
        element = element.parent


def lines_of(page: str) -> list[Line]:
    """The blocks of text of a page in order, each with its characters in links and the element that holds it."""
    lines: list[Line] = []
    parts: list[str] = []
    linked = 0
    top: Element | None = None
    held: Element | None = None  # where the text of the open line began
    articles = 0

    def close_line():
        nonlocal linked, held
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                lines.append(Line(text, linked, held))
            parts.clear()
        linked, held = 0, None

    def take(raw: str):
        nonlocal linked, held
        if not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if held is None and text.strip():
            held = top
        parts.append(text)
        if top is not None and top.link:
            linked += len("".join(text.split()))

    def pop_to(wanted: Element):
        nonlocal top, articles
        while top is not None:
            gone, top = top, top.parent
            articles -= gone.name in ("article", "main")
            if gone is wanted:
                return

    at, size = 0, len(page)
    while at < size:
        match = _TOKEN.search(page, at)
        if match is None:
            # a tag that never closes is no text
            stop = _OPENING.search(page, at)
            take(page[at:stop.start()] if stop else page[at:])
            break
        take(page[at:match.start()])
        at = match.end()
        closing, name, raw, end = match.groups()
        if name is None:
            continue
        name = name.lower()
        if not end and at >= size:
            break
        if name == "br":
            take(" ")
            continue
        if name in _BLOCKS or name == "hr":
            close_line()
        elif name in ("td", "th"):
            take(" ")
        if closing:
            for element in _chain(top):
                if element.name == name:
                    pop_to(element)
                    break
                # an end tag reaches out of inline elements and paragraphs, but not out of its section
                if name not in _BLOCKS and element.name in _SECTIONS:
                    break
            continue
        if name in _RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if stop is None:
                break
            closed = page.find(">", stop.end())
            at = size if closed < 0 else closed + 1
            continue
        if name in _VOID:
            continue
        if name in _ENDS_PARAGRAPH:
            for element in _chain(top):
                if element.name == "p":
                    pop_to(element)
                    break
                if element.name in _SECTIONS or element.name == "li":
                    break
        if name == "body":
            for element in _chain(top):
                if element.name == "head":
                    pop_to(element)
                    break
        if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            for element in _chain(top):
                if element.name == name:
                    pop_to(element)
                    break
                if element.name in ("ul", "ol", "dl", "table", "select", "div", "section"):
                    break
        element = Element(name, top)
        _marked(element, raw, articles > 0)
        if raw.endswith("/") and name in ("svg", "math"):
            continue
        articles += name in ("article", "main")
        top = element
    close_line()
    return lines


def windows(weights: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Sums over `width` lines from each line on."""
    total = np.concatenate(([0], np.cumsum(np.concatenate((weights, np.zeros(width - 1, dtype=weights.dtype))))))
    return total[width:] - total[:-width]


def spans(weights: np.ndarray, width: int = WINDOW) -> list[tuple[int, int]]:
    """(surge, dive) of every stretch: from its first line with text to behind its last, where a window sums to nothing."""
    found, at = [], 0
    sums = windows(weights, width)
    while at < len(weights):
        if not weights[at]:
            at += 1
            continue
        dive = at
        while dive < len(weights) and sums[dive]:
            dive += 1
        end = dive
        while not weights[end - 1]:
            end -= 1
        found.append((at, end))
        at = dive
    return found


def _left_out(line: Line, freed: set[int]) -> bool:
    inside = any(e.name in ("article", "main") or e.kind == "body" for e in _chain(line.element))
    heading = any(e.name in _HEADINGS for e in _chain(line.element))
    for e in _chain(line.element):
        if e.no_text:
            return True
        # the heading of an article may stand in a header of its own
        if e.hinted and id(e) not in freed and not (e.name == "header" and inside and heading):
            return True
    return False


def _weight(lines: list[Line]) -> int:
    return sum(max(0, len(x.text) - x.linked) for x in lines)


def _around(lines: list[Line]) -> set[int]:
    """Elements that hold the article itself, so that a hint in their names says nothing: a form around the page, say."""
    freed: set[int] = set()
    all_text = sum(len(x.text) for x in lines)
    mass: dict[int, int] = {}
    elements: dict[int, Element] = {}
    for line in lines:
        chain = list(_chain(line.element))
        if any(e.no_text for e in chain):
            continue
        for i, e in enumerate(chain):
            elements[id(e)] = e
            mass[id(e)] = mass.get(id(e), 0) + len(line.text) - line.linked
            if e.kind in ("article", "main") and not e.hinted:
                freed.update(id(o) for o in chain[i + 1:] if o.name in ("form", "div", "section", "table", "td", "tr", "tbody"))
            if e.name == "h1" and i + 1 < len(chain):
                freed.update(id(o) for o in chain[i + 1:] if o.name == "form")
    freed.update(i for i, e in elements.items() if e.name in ("form", "div") and e.hinted and 10 * mass[i] > 9 * all_text
                 and e.parent is not None and e.parent.name in ("body", "html"))
    return freed


def _article(lines: list[Line]) -> tuple[list[Line], bool]:
    """The lines of the element that is marked as the article most plainly and holds most text, if any is."""
    for kind in ("article", "body", "main"):
        held: dict[int, list[Line]] = {}
        for line in lines:
            outermost = None
            for e in _chain(line.element):
                if e.kind == kind:
                    outermost = e
            if outermost is not None:
                held.setdefault(id(outermost), []).append(line)
        if held:
            best = max(held.values(), key=_weight)
            if any(x.text for x in best):
                return best, True
    return lines, False


def _section(line: Line) -> int:
    return next((id(e) for e in _chain(line.element) if e.name in _SECTIONS), 0)


def _densest(lines: list[Line]) -> tuple[list[Line], bool]:
    """The innermost section that holds most of the text of the section around it."""
    chains = [[e for e in _chain(x.element) if e.name in _SECTIONS][::-1] for x in lines]
    weights = [max(0, len(x.text) - x.linked) if 2 * x.linked < len(x.text) else 0 for x in lines]
    depth, chosen, inner = 0, list(range(len(lines))), False
    while True:
        mass: dict[int, int] = {}
        for i in chosen:
            if len(chains[i]) > depth:
                e = chains[i][depth]
                mass[id(e)] = mass.get(id(e), 0) + weights[i]
        total = sum(weights[i] for i in chosen)
        if not mass or not total:
            break
        best = max(mass, key=mass.get)
        if 4 * mass[best] < 3 * total:
            break
        chosen = [i for i in chosen if len(chains[i]) > depth and id(chains[i][depth]) == best]
        inner = inner or chains[chosen[0]][depth].name not in ("body",)
        depth += 1
    return [lines[i] for i in chosen], inner


def main_text(page: str | None) -> str:
    """The main text of a page: its blocks in order, joined by an empty line; empty if there is none."""
    lines = lines_of(page or "")
    freed = _around(lines)
    lines = [x for x in lines if not _left_out(x, freed)]
    if not lines:
        return ""
    lines, marked = _article(lines)
    if not marked:
        lines, marked = _densest(lines)
    # the distribution: lines in order, with a gap where an unmarked page goes from one section to another
    place, weights, before = [], [], None
    for x in lines:
        section = _section(x)
        if not marked and before is not None and section != before:
            weights += [0] * WINDOW
        before = section
        place.append(len(weights))
        weights.append(len(x.text) if marked else max(0, len(x.text) - x.linked) if 2 * x.linked < len(x.text) else 0)
    found = spans(np.array(weights, dtype=np.int64))
    if not found:
        return ""
    if marked:
        kept = found
    else:
        sums = [sum(weights[a:b]) for a, b in found]
        kept = [s for s, n in zip(found, sums) if 4 * n >= max(sums)]
    return "\n\n".join(x.text for x, at in zip(lines, place) if any(a <= at < b for a, b in kept))


def page_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per row: key, url, text (the main text, empty if none) and n_chars (its code points).

    A null page counts as empty. Repeated rows and null keys stay; broken markup is read as far as it goes, and a tag that
    is cut off at the end is no text; an empty table gives an empty result; other columns are not read.
    """
    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (key, url))
    return pages.select(key, url, page).mapInArrow(work, f"{kinds}, text string, n_chars long")
