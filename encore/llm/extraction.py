"""The main text of web pages by scoring the element tree.

1. The page becomes a tree; elements that are no reading matter by name, role or class go: menus, page headers and
   footers, sidebars, notices, adverts, forms, scripts, styles, reader comments, hidden parts. One that goes by class,
   role or as a form stays if it holds the article, or on a page without one most of the points of 2.
2. Each element with text of its own is a paragraph worth 1 point, 1 for each comma and up to 3 for its length. Its
   points pass to its ancestors: all to the parent, half to the next, a third to the one after, and so on. An
   ancestor's points are then cut by the share of its text that lies in links; `article` and `main` start with a bonus.
3. The element with most points, or the article or main it lies in, is the container. Its siblings are kept as well
   if they are headings, have few links, whatever their size, or have a fifth of its points.

Blocks come in page order, joined by one \\n, white space inside a block as one space. Defined cases: a null, empty or
broken page gives what text it has, or an empty text; repeated rows are treated alike; null ids and addresses stay;
extra columns are ignored. Nothing is cut, and no function recurses, so depth and length of a page have no limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split())
NO_TEXT = frozenset(
    "head title script style noscript template nav footer aside form button input select textarea option iframe "
    "object embed applet svg canvas audio video map menu dialog datalist".split())
NO_TEXT_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist "
    "status".split())
NO_TEXT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie "
    "cookies consent gdpr notice notices notification alert popup pop-up modal overlay newsletter subscribe "
    "subscription signup sign-up login sidebar side-bar aside rail widget widgets menu nav navbar navigation topbar "
    "breadcrumb breadcrumbs header site-header page-header masthead footer site-footer page-footer copyright comment "
    "comments commentlist comment-list discussion disqus respond replies reply share sharing social related "
    "recommended recommendations pagination pager search toolbar skip-link tags outbrain taboola".split())
NO_TEXT_STARTS = (
    "ad-", "ad_", "ads-", "ads_", "advert", "sponsor", "promo-", "cookie", "consent", "gdpr", "sidebar", "comment-",
    "comment_", "comments-", "comments_", "disqus", "newsletter", "share-", "social-", "related-", "nav-", "navbar",
    "menu-", "footer-", "breadcrumb", "popup-", "modal-")
NO_TEXT_ENDS = ("-ad", "-ads", "_ad", "_ads", "-advert", "-sidebar", "-comments", "-menu", "-nav", "-navigation",
                "-footer", "-banner", "-notice", "-popup", "-modal", "-newsletter", "-share")
#: A name that begins so speaks of the page around it.
STATES = ("has-", "with-", "without-", "no-", "is-", "js-")
COMMENT_PARTS = ("comment", "disqus", "respond", "repl", "discussion")
CONTAINERS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
KEPT_WHOLE = frozenset(("html", "body", "article", "main"))
CLOSES_PARAGRAPH = BLOCKS - {"html", "body", "option", "optgroup", "legend", "caption", "thead", "tbody", "tfoot", "tr",
                             "td", "th"}
#: A start tag ends open elements of these names, as far up as the nearest element of the second kind.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, {"html"}),
}
BONUS, SIBLING_PART, SIBLING_LINKS = 25.0, 0.2, 0.25


class Element:
    __slots__ = ("name", "attributes", "parent", "parts", "points", "length", "linked")

    def __init__(self, name: str, attributes: dict[str, str], parent: Element | None):
        self.name, self.attributes, self.parent = name, attributes, parent
        self.parts: list[Element | str] = []
        self.points, self.length, self.linked = 0.0, 0, 0


class TreeBuilder(HTMLParser):
    """Reads a page into elements; forgets nothing but comments and declarations."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("html", {}, None)
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag in CLOSES_PARAGRAPH:
            self._end({"p"}, {"table", "td", "th", "button", "object"})
        if tag in ENDS:
            self._end(*ENDS[tag])
        element = Element(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].parts.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        # as in browsers, the slash closes nothing that is not void
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in ("html", "body") and tag not in VOID:
            self._end({tag}, CONTAINERS if tag not in BLOCKS else frozenset())

    def handle_data(self, data):
        self.open[-1].parts.append(data)

    def _end(self, names, within):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name in names:
                del self.open[i:]
                return
            if self.open[i].name in within:
                return


def tree(html: str) -> Element:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


def walk(top: Element) -> Iterator[tuple[Element | str, bool]]:
    """(part, False) when a part begins and (element, True) when an element ends, in page order."""
    stack: list[tuple[Element | str, bool]] = [(top, False)]
    while stack:
        part, ends = stack.pop()
        yield part, ends
        if not ends and isinstance(part, Element):
            stack.append((part, True))
            stack.extend((x, False) for x in reversed(part.parts))


def no_reading(element: Element, in_article: bool) -> bool:
    """Whether the element is something else than reading matter."""
    if element.name in KEPT_WHOLE and not in_article:
        return False
    given = element.attributes
    if element.name in NO_TEXT or (element.name == "header" and not in_article):
        return True
    if given.get("role", "").lower() in NO_TEXT_ROLES or _unseen(element):
        return True
    names = f"{given.get('class', '')} {given.get('id', '')}".lower().split()
    names = [x for x in names if not x.startswith(STATES)]
    if in_article:
        names = [x for x in names if x not in ("header", "page-header")]
    return any(x in NO_TEXT_NAMES or x.startswith(NO_TEXT_STARTS) or x.endswith(NO_TEXT_ENDS) for x in names)


def _holds_article(element: Element) -> bool:
    named = " ".join((element.attributes.get("class", ""), element.attributes.get("id", ""))).lower()
    if any(x in named for x in COMMENT_PARTS) or element.name in ("aside", "footer", "nav"):
        return False
    return any(isinstance(x, Element) and x.name in CONTAINERS for x, ends in walk(element) if not ends)


def _unseen(element: Element) -> bool:
    given = element.attributes
    return ("hidden" in given or given.get("aria-hidden") == "true"
            or "display:none" in given.get("style", "").replace(" ", "").lower())


def _outside(element: Element) -> bool:
    """Whether no share of the page's text makes the element reading matter: by its name, hidden, or comments."""
    named = " ".join((element.attributes.get("class", ""), element.attributes.get("id", ""))).lower()
    return ((element.name in NO_TEXT and element.name != "form") or element.name == "header" or _unseen(element)
            or (element.name not in KEPT_WHOLE and any(x in named for x in COMMENT_PARTS)))


def shares(top: Element) -> tuple[dict[int, float], bool]:
    """The part of the page's paragraph points in each element by its id(), links left out, and whether it has an article."""
    points: dict[int, float] = {}
    article, outside = False, 0
    for part, ends in walk(top):
        if not isinstance(part, Element):
            continue
        if not ends:
            outside += _outside(part)
            article |= part.name in CONTAINERS and not outside
            continue
        if not outside:
            own = " ".join("".join(_inline(part, ("a",))).split()) if part.name in BLOCKS else ""
            here = points.get(id(part), 0.0) + (_worth(own) if own else 0.0)
            points[id(part)] = here
            if part.parent is not None:
                points[id(part.parent)] = points.get(id(part.parent), 0.0) + here
        outside -= _outside(part)
    whole = points.get(id(top), 0.0)
    return {k: v / whole for k, v in points.items()} if whole else {}, article


def prune(top: Element) -> None:
    """Take out all elements without reading matter; what holds most of the page's text is a wrapper of it."""
    share, article = shares(top)

    def wraps(x: Element, inside: bool) -> bool:
        if not inside and (x.name not in NO_TEXT or x.name == "form") and _holds_article(x):
            return True
        return (inside or not article) and not _outside(x) and share.get(id(x), 0.0) > 0.5

    stack = [(top, False)]
    while stack:
        element, in_article = stack.pop()
        inside = in_article or element.name in CONTAINERS
        element.parts = [
            x for x in element.parts if isinstance(x, str) or not no_reading(x, inside) or wraps(x, inside)]
        stack.extend((x, inside) for x in element.parts if isinstance(x, Element))


def measure(top: Element) -> None:
    """Give every element its points and the lengths of its text, all of it and that in links."""
    for part, ends in walk(top):
        if not isinstance(part, Element):
            continue
        if not ends:
            part.points += BONUS * (part.name in CONTAINERS)
            continue
        own = " ".join("".join(_inline(part)).split())
        if part.name in BLOCKS and own:
            points, up, share = _worth(own), part.parent, 1
            while up is not None:
                up.points += points / share
                up, share = up.parent, share + 1
        here = sum(len(x.strip()) for x in part.parts if isinstance(x, str))
        part.length += here
        part.linked = part.length if part.name == "a" else part.linked
        if part.parent is not None:
            part.parent.length += part.length
            part.parent.linked += part.linked


def _worth(own: str) -> float:
    """The points of a paragraph."""
    return 1 + own.count(",") + min(len(own) / 100, 3)


def _inline(element: Element, but: tuple[str, ...] = ()) -> Iterator[str]:
    """The text of an element outside the blocks in it, and outside elements of the names in `but`."""
    stack: list[Element | str] = list(reversed(element.parts))
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            yield part
        elif part.name == "br":
            yield " "
        elif part.name not in BLOCKS and part.name not in but:
            stack.extend(reversed(part.parts))


def links(element: Element) -> float:
    return element.linked / element.length if element.length else 0.0


def score(element: Element) -> float:
    return element.points * (1 - links(element))


def kept(top: Element) -> list[Element | str]:
    """The container and the siblings that belong to it, in page order."""
    best, points = top, 0.0
    for part, ends in walk(top):
        if ends and part.name in BLOCKS and part.length and score(part) > points:
            best, points = part, score(part)
    container, up = best, best
    while up is not None:
        container = up if up.name in CONTAINERS else container
        up = up.parent
    if container.parent is None:
        return [container]
    least = SIBLING_PART * score(container)
    out: list[Element | str] = []
    for is_block, run in groupby(container.parent.parts, lambda x: isinstance(x, Element) and x.name in BLOCKS):
        run = list(run)
        if is_block:
            out += [x for x in run if x is container or (x.length and (
                x.name in HEADINGS or links(x) < SIBLING_LINKS or score(x) >= max(least, 1)))]
        else:
            # text and what lies in it between two blocks is a paragraph without a tag
            length = sum(x.length if isinstance(x, Element) else len(x.strip()) for x in run)
            linked = sum(x.linked for x in run if isinstance(x, Element))
            out += run if container in run or linked < SIBLING_LINKS * length else []
    return out


def blocks(elements: list[Element | str]) -> Iterator[str]:
    held: list[str] = []
    for element in elements:
        for part, _ in walk(element):
            if isinstance(part, str):
                held.append(part)
            elif part.name == "br":
                held.append(" ")
            elif part.name in BLOCKS:
                if text := " ".join("".join(held).split()):
                    yield text
                held = []
    if text := " ".join("".join(held).split()):
        yield text


def main_text(html: str | None) -> str:
    if not html:
        return ""
    top = tree(html)
    prune(top)
    measure(top)
    return "\n".join(blocks(kept(top)))


def main_texts(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                         F.col(html_col).cast("string").alias("html"))
    return plain.mapInArrow(of, "page_id long, url string, text string, n_chars long")
