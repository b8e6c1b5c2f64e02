"""Operator 3: main text of HTML pages by scoring the element tree.

Every paragraph passes points for its length and commas to its ancestors, to each half of what the one below it gets. An element's
score is discounted by the share of its text that is in links. The element with the best score is the article's
container, or the article or main element around it. Else what reads like text is kept beside it, and beside each element around
it, up to the body. Elements that are no part of an article (menus, headers, footers, sidebars, notices, adverts, forms, comments,
scripts) neither score nor show; a class name alone makes an element one of them only if most of the page is elsewhere.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlark.llm.common import arrow_rows

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead "
    "title tr ul".split()
)
#: what opening one of these closes, if it is the innermost of its kind
CLOSES = {
    "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("thead", "tbody", "tfoot"), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody", "tfoot"), "body": ("head",),
}
#: these keep what they hold from being closed by a later element outside of them
SCOPES = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
NO_ARTICLE = frozenset(
    "head nav footer aside form script style noscript template iframe object embed applet canvas svg math button select option textarea input "
    "dialog menu title xmp noembed noframes audio video datalist".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: parts of class names and ids
NAMES = (
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices notification popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside widget footer header masthead topbar toolbar comment comments reply replies respond disqus discussion share sharing social "
    "related recommended recommendations pagination pager skip hidden copyright disclaimer alert"
).split()
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>?""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_NAME = re.compile(rf"(?:^|[-_]|(?<=[a-z0-9])(?=[A-Z]))(?:{'|'.join(NAMES)})(?:$|[-_\d]|(?=[A-Z]))", re.I)
_NOT = re.compile(r"(?:^|[-_])(?:no|has|with|without|is)[-_]", re.I)
_GOOD = re.compile(r"article|content|main|post|entry|story|text|body", re.I)
_COMMAS = re.compile(r"[,،、，]")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names of readers' remarks, which may be longer than the article; of boxes of links, which prose may be named like; of headers.
_REMARKS = re.compile(r"comment|repl(?:y|ies)|respond|disqus", re.I)
_LINKED = re.compile(r"related|recommended|recommendations", re.I)
_HEADER = re.compile(r"header|masthead", re.I)
#: Elements that are text whatever their length.
_TEXT = _HEADINGS | frozenset("p blockquote pre ul ol dl table figure".split())
#: Headings over lists of links to other articles, and lines that are no text of an article.
_ELSEWHERE = re.compile(r"related|recommended|more |read next|popular|trending|latest|also like|see all", re.I)
_LEGAL = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved)", re.I)


@dataclass
class Page:
    """Elements in page order and blocks of text: (innermost element, pieces, characters of them in links)."""

    tag: list[str] = field(default_factory=lambda: ["#root"])
    parent: list[int] = field(default_factory=lambda: [-1])
    attributes: list[dict[str, str]] = field(default_factory=lambda: [{}])
    blocks: list[tuple[int, list[str], int]] = field(default_factory=list)


def parse(html: str) -> Page:
    """A forgiving reading of HTML: end tags left out are supplied, those without a start are passed over."""
    page, stack = Page(), [0]
    tag, parent = page.tag, page.parent
    pieces: list[str] = []
    in_link, linked, owner = 0, 0, 0
    owners = [0]  # the innermost block of each element on the stack
    opened: defaultdict[str, list[int]] = defaultdict(list)  # places on the stack by kind

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            page.blocks.append((owner, pieces, linked))
        pieces, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked, owner
        if text:
            if not pieces:
                owner = owners[-1]
            pieces.append(text)
            if in_link:
                linked += len(text.strip())

    def close(upto: int) -> None:
        """Ends the elements of the stack from place ``upto`` on."""
        nonlocal in_link
        for e in stack[upto:]:
            in_link -= tag[e] == "a"
            if tag[e] in BLOCK:
                flush()
        for e in stack[upto:]:
            opened[tag[e]].pop()
        del stack[upto:], owners[upto:]

    def innermost(names: tuple[str, ...], scope: tuple[str, ...] = ()) -> int:
        """Place of the innermost of ``names``; 0 if there is none, or one of ``scope`` further in."""
        place = max((opened[name][-1] for name in names if opened[name]), default=0)
        return place if place and all(not opened[name] or opened[name][-1] < place for name in scope) else 0

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            add(unescape(html[at:]))
            break
        add(unescape(html[at : m.start()]))
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if place := innermost((name,)):
                close(place)
            elif name == "br":
                add(" ")
            continue
        if name == "br":
            add(" ")
            continue
        if name in BLOCK:
            flush()
            if name not in ("td", "th", "tr", "caption") and (place := innermost(("p",), ("td", "th", "table", "button"))):
                close(place)
            if name in _HEADINGS and tag[stack[-1]] in _HEADINGS:
                close(len(stack) - 1)
        if name in CLOSES and (place := innermost(CLOSES[name], SCOPES.get(name, ()))):
            close(place)
        if name == "a" and (place := innermost(("a",))) and owners[place] == owners[-1]:
            close(place)
        given = m[3]
        attributes = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(given)} if given.strip(" /\n") else {}
        tag.append(name)
        parent.append(stack[-1])
        page.attributes.append(attributes)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
            at = n if end is None else html.find(">", end.start()) + 1 or n
            continue
        opened[name].append(len(stack))
        stack.append(len(tag) - 1)
        owners.append(len(tag) - 1 if name in BLOCK else owners[-1])
        in_link += name == "a"
    close(1)
    flush()
    return page


def _outside(page: Page) -> list[bool]:
    """Of each element whether it is (in) something that is no part of an article."""
    n = len(page.tag)
    hard, holds, size, links = [False] * n, [False] * n, [0] * n, [0] * n
    for e in range(1, n):
        a, tag = page.attributes[e], page.tag[e]
        hard[e] = hard[page.parent[e]] or tag in NO_ARTICLE or a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true"
        hard[e] = hard[e] or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I))
    for e, pieces, linked in page.blocks:
        if not hard[e]:
            size[e] += sum(map(len, pieces))
            links[e] += linked
    for e in range(n - 1, 0, -1):  # an element stands after its parent
        up = page.parent[e]
        holds[up] |= holds[e] or page.tag[e] in ("article", "main")
        size[up] += size[e]
        links[up] += links[e]
    headline = [page.tag[e] == "h1" for e in range(n)]
    for e in range(n - 1, 0, -1):
        headline[page.parent[e]] |= headline[e]
    out, header, in_article = [False] * n, [False] * n, [False] * n
    wrong: list[tuple[frozenset[str], int]] = [(frozenset(), size[0])] * n  # names that said nothing further out, and the text there
    for e in range(1, n):
        tag, a, up = page.tag[e], page.attributes[e], page.parent[e]
        in_article[e] = in_article[up] or tag in ("article", "main")
        wrong[e] = wrong[up]
        if out[up]:
            # a header inside the article may hold its headline
            header[e] = header[up] and not hard[e]
            out[e] = not (header[e] and tag in ("h1", "h2") and in_article[e])
            continue
        out[e] = hard[e] or tag == "header"
        header[e] = tag == "header" and not hard[e]
        if out[e] or tag in ("html", "body", "article", "main") or holds[e]:
            continue
        names = [x for x in f"{a.get('class', '')} {a.get('id', '')}".split() if _NAME.search(x) and not _NOT.search(x)]
        remarks = [x for x in names if _REMARKS.search(x)]
        if remarks and not headline[e]:
            out[e] = True
        elif names and (
            (holds[0] and not in_article[e])  # the article is elsewhere
            or (not headline[e] and any(x.lower() in NAMES for x in names))  # a plain name, no part of a longer one
            or 2 * size[e] < (wrong[up][1] if wrong[up][0].issuperset(names) else size[0])
        ):
            # a box of links is one by its links; the same name may stand over prose
            out[e] = not all(_LINKED.search(x) for x in names) or 4 * links[e] >= size[e]
            header[e] = out[e] and all(_HEADER.search(x) for x in names)
        elif names:
            wrong[e] = frozenset(names), size[e]
    return out


def points(page: Page, blocks: list[tuple[int, str, int]]) -> list[float]:
    """What each element gets: a block's points go to its parent (to an article or body itself), half of them to the next
    ancestor, and so on up to the root."""
    out = [0.0] * len(page.tag)
    for e, text, _ in blocks:
        if page.tag[e] not in _HEADINGS:
            out[e if page.tag[e] in ("body", "#root", "article", "main") else page.parent[e]] += 1 + len(_COMMAS.findall(text)) + min(len(text) // 100, 3)
    for e in range(len(out) - 1, 0, -1):
        out[page.parent[e]] += out[e] / 2
    return out


def extract(html: str | None) -> str:
    """Main text of a page: its blocks joined by one line feed, white space inside a block as one space."""
    if not html:
        return ""
    page = parse(html)
    outside = _outside(page)
    n = len(page.tag)
    blocks = [(e, text, min(linked, len(text))) for e, pieces, linked in page.blocks if not outside[e] and (text := " ".join("".join(pieces).split()))]
    if not blocks:
        return ""
    heard, size, links = points(page, blocks), [0] * n, [0] * n
    for e, text, linked in blocks:
        size[e] += len(text)
        links[e] += linked
    for e in range(n - 1, 0, -1):
        size[page.parent[e]] += size[e]
        links[page.parent[e]] += links[e]
    score = [0.0] * n
    for e in range(n):
        if size[e] and not outside[e]:
            bonus = 0.0
            if page.tag[e] in ("article", "main") or page.attributes[e].get("role") == "main":
                bonus = 25.0
            elif _GOOD.search(f"{page.attributes[e].get('class', '')} {page.attributes[e].get('id', '')}"):
                bonus = 5.0
            score[e] = (heard[e] + bonus * bool(heard[e] or page.tag[e] in ("article", "main"))) * (1 - links[e] / size[e])
    best = max(range(n), key=lambda e: (score[e], e))
    if not score[best]:  # headings only, or links only
        best = next((e for e in range(n) if page.tag[e] == "body"), 0)
    # an article is taken whole: its headline and its other parts are beside the best one
    up = best
    while up > 0:
        if page.tag[up] in ("article", "main") and not outside[up]:
            best = up
        up = page.parent[up]
    # beside it, and beside what is around it, text is kept; far out it must be a text element or longer than a line
    chosen, around, place = {best}, {}, page.parent[best]
    whole = page.tag[best] in ("article", "main")
    while place >= 0 and page.tag[best] not in ("body", "#root"):
        around[place] = len(around)
        if whole or page.tag[place] in ("body", "#root"):
            break
        place = page.parent[place]
    first: dict[int, str] = {}
    for e, text, _ in blocks:
        first.setdefault(e, text)
    path = {best, *around}
    for e in range(1, n):
        if e in path or page.parent[e] not in around or not size[e] or outside[e] or (e in first and _LEGAL.match(first[e])):
            continue
        density, level = links[e] / size[e], around[page.parent[e]]
        reads = density < 0.25 if size[e] > 80 or (level and page.tag[e] in _TEXT) else density == 0 and not level
        if reads or (not level and score[e] >= max(10.0, 0.2 * score[best])):
            chosen.add(e)
    inside = [False] * n
    for e in range(n):
        inside[e] = e in chosen or (e > 0 and inside[page.parent[e]])
    loose = {e for e in around if not whole}  # text right in an element around the container
    # lists and boxes that are little but links are menus; but a list between the text of the article, or under a heading, is part of it
    menu, count = [0] * n, [0] * n
    for e in range(n - 1, 0, -1):
        count[e] += page.tag[e] == "a"
        count[page.parent[e]] += count[e]
    for e in range(1, n):
        own = page.tag[e] in ("ul", "ol", "div", "table", "section") and count[e] >= 3 and size[e] > 0 and links[e] > 0.7 * size[e] and links[e] < 40 * count[e] and e not in chosen
        menu[e] = menu[page.parent[e]] or (e if own else 0)
    shown = [(e, text, linked) for e, text, linked in blocks if inside[e] or (e in loose and 4 * linked < len(text) and len(text) > 80)]
    last = max((i for i, (e, _, _) in enumerate(shown) if not menu[e] and page.tag[e] not in _HEADINGS), default=-1)
    out, kept, before = [], {}, None
    for i, (e, text, _) in enumerate(shown):
        if (m := menu[e]) and m not in kept:
            under = before is not None and page.tag[before[0]] in _HEADINGS and not _ELSEWHERE.search(before[1])
            kept[m] = page.tag[m] in ("ul", "ol") and bool(out) and (i < last or under)
        if not m or kept[m]:
            out.append(text)
            before = (e, text)
    return "\n".join(out)


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points of text), one row for each row of ``df``.

    A null or empty html, or one without an article, gives an empty text. Pages are read whole, however long. Repeated
    rows and null ids and urls stay as they are, extra columns are ignored; an empty table gives an empty table.
    """

    def work(batches):
        for b in arrow_rows(batches):
            texts = [extract(h.as_py()) for h in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    plain = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return plain.mapInArrow(work, "page_id long, url string, text string, n_chars long")
