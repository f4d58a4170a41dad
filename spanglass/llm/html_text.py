"""Main text of HTML pages by line-block distribution.

Markup is stripped first: scripts, styles and the like go with their content, and so do
regions that are boilerplate by their tag, role or name (menus, headers outside the article, footers,
sidebars, notices, adverts, forms, reader comments).  Names that say what a box holds (comments, ads, cookies ...) count in any class or id, others
with words of place only (site-footer), or where the container is mostly links; none counts beside words such as has or no
(has-sidebar).  A container so named stays if it holds the page's article or most of its text.  Block tags and <br> end a
line, so a page becomes lines, each with the length of its text.  The lengths are then
summed over sliding windows of ``WINDOW`` lines.  Where the sums rise from nothing and where
they dive back bound a region; every region that surges, with a window of at least
``SURGE`` characters, is kept with all the lines between, so only short lines need neighbours.  On a page where none
surges, all regions are kept.

Lines that are mostly link text weigh nothing.  A character inside an <article> or <main> weighs
``SURGE`` ones, so that it surges by itself; but several articles that hold less
text than the rest of the page are taken for cards beside the main text, and weigh as the rest does.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 3
SURGE = 80

#: Fixed sets of tag names, from the HTML standard.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "select", "canvas", "audio", "video")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
DROPPED = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "search", "button", "fieldset", "header"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "alertdialog"}
#: Words in class or id names that mark boilerplate.
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "consent", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "paywall", "popup", "promo", "promoted", "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
#: Of these, words that say what a box holds, whatever stands beside them.
STRONG = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "gdpr", "newsletter", "paywall", "popup", "promoted", "sponsor", "sponsored"}
#: Words that make a name one of something else.
OTHERWISE = {"disabled", "enabled", "has", "hide", "hides", "is", "no", "not", "show", "shows", "with", "without"}
#: Words that may stand beside them in one name, and say only where or what kind of box it is.
PLACES = {"area", "bar", "bottom", "box", "block", "blog", "button", "buttons", "col", "column", "container", "entry", "global", "group", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "post", "posts", "primary", "right", "secondary", "section", "site", "story", "thread", "top", "widgets", "wrap", "wrapper"}
#: Of these, the text of others: it may outweigh a short article.
OTHERS = {"comment", "comments", "disqus", "related"}
#: Containers whose names are looked at; an article, or a paragraph in one, isn't dropped for its class.
NAMED = {"div", "section", "ul", "ol", "p", "span", "table", "details", "dl"}

#: A quote that is never closed ends with its tag, and so do those after some hundred.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*'){0,400}+|[^>]*)>|<[!?][^>]*>", re.DOTALL)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z0-9]+")
_RAW_END = {t: re.compile(rf"</{t}\b", re.IGNORECASE) for t in RAW}
_HIDDEN = re.compile(r"\shidden(?:[\s=>]|$)|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)


def is_boilerplate(tag: str, attrs: str, in_article: bool) -> bool:
    """By its tag, role or being hidden."""
    if tag in DROPPED:
        return not (tag == "header" and in_article)
    if not attrs or tag not in NAMED:
        return False
    if _HIDDEN.search(attrs):
        return True
    return any(name.lower() == "role" and (a or b or c).lower().strip() in ROLES for name, a, b, c in _ATTR.findall(attrs))


def boilerplate_name(tag: str, attrs: str) -> tuple[set[str], str]:
    """The words of NAMES in a class or the id of the container, and how much they say.

    "all" if a name has no other words than those of place, "kind" if one of its words says what it holds, "links" if it is only boilerplate where it is mostly links.
    """
    found: dict[str, set[str]] = {"all": set(), "kind": set(), "links": set()}
    if attrs and tag in NAMED:
        for name, a, b, c in _ATTR.findall(attrs):
            if name.lower() != "role":
                for token in (a or b or c).lower().split():
                    words = {w for w in _SPLIT.split(token) if w and not w.isdigit()}
                    if words & NAMES and not words & OTHERWISE:
                        found["all" if words <= NAMES | PLACES else "kind" if words & STRONG else "links"] |= words & NAMES
    return next(((w, how) for how, w in found.items() if w), (set(), ""))


def kept_lines(lines: list[tuple[list[tuple[str, int, int]], int]], named: list[tuple[set[str], str, bool, int]]) -> list[tuple[str, int, int]]:
    """The lines without the parts in dropped containers; ``named`` has the words of each and what they say, whether it holds an article, and its own container."""
    held, linked_in, article_in = [0] * len(named), [0] * len(named), [holds for _, _, holds, _ in named]
    total = free = free_article = 0
    for parts, article in lines if named else ():
        for raw, linked, within in parts:
            n = 0 if linked else len(raw.strip())
            total += n
            if within >= 0:
                held[within] += n
                linked_in[within] += linked
            else:
                free += n
                free_article += n if article else 0
    gone: set[int] = set()
    for k in range(len(named) - 1, -1, -1):  # from the inside out
        if (up := named[k][3]) >= 0:
            held[up] += held[k]
            linked_in[up] += linked_in[k]
            article_in[up] |= article_in[k]
    for k, (names, how, _, up) in enumerate(named):
        whole = 2 * held[k] > total or (article_in[k] and held[k] and held[k] >= free_article)
        others = names & OTHERS and how != "links" and (free if how == "all" else free_article) >= SURGE
        if up in gone or others or (not whole and (how != "links" or linked_in[k] > held[k])):
            gone.add(k)
    kept = []
    for parts, article in lines:
        parts = [p for p in parts if p[2] not in gone] if gone else parts
        if text := " ".join(html.unescape("".join(p[0] for p in parts)).split()):
            kept.append((text, sum(p[1] for p in parts), article))
    return kept


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """(text, characters of it in links, number of its outermost article or 0) of each non-empty line."""
    lines: list[tuple[list[tuple[str, int, int]], int]] = []  # of parts, and the article's number
    parts: list[tuple[str, int, int]] = []  # text, characters of it in links, the named container around it or -1
    stack: list[str] = []
    held: Counter[str] = Counter()  # open tags by name, so that an end tag that closes nothing costs nothing
    at = articles = outermost = 0
    drop_at = -1  # the depth at which a dropped region began
    links = 0
    named: list[tuple[set[str], str, bool, int]] = []  # containers with a boilerplate name: its words and what they say, whether it holds an article, its own container
    depths: list[int] = []  # of the open ones
    within = -1  # the innermost one's number

    def text_to(end: int) -> None:
        if drop_at < 0 and end > at:
            parts.append((page[at:end], len(page[at:end].strip()) if links else 0, within))

    def flush() -> None:
        if parts:
            lines.append((parts.copy(), outermost if articles else 0))
            parts.clear()

    def leave(depth: int) -> None:
        nonlocal within
        while depths and depth <= depths[-1]:
            depths.pop()
            within = named[within][3]

    size, last = len(page), page.rfind(">") + 1  # nothing beyond the last bracket can be a tag, so no tag is looked for in vain
    while at < size:
        m = _TOKEN.search(page, at, last) if at < last else None
        if m is None:
            comment = page.find("<!--", at)
            text_to(size if comment < 0 else comment)
            break
        text_to(m.start())
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):  # never closed
            break
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS and drop_at < 0:
            flush()
        if m[1]:  # an end tag closes the innermost open one of its name; one that is not open is ignored
            if held[tag]:
                while True:
                    shut = stack.pop()
                    held[shut] -= 1
                    articles -= shut in ("article", "main")
                    links -= shut == "a"
                    if len(stack) <= drop_at:
                        drop_at = -1
                    leave(len(stack))
                    if shut == tag:
                        break
            continue
        if tag in RAW and not (tag == "noscript" and articles):
            if not m[3].endswith("/") or tag in ("script", "style"):
                end = _RAW_END[tag].search(page, at)
                at = page.find(">", end.end()) + 1 if end else 0
                at = at or size
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag == "body" and held["head"]:  # the head's end tag may be left out
            at_head = stack.index("head")
            held.subtract(stack[at_head:])
            del stack[at_head:]
            drop_at = -1
            leave(len(stack))
        if tag in ("p", "li", "option", "dt", "dd", "tr", "td", "th") and stack and stack[-1] == tag:
            held[stack.pop()] -= 1
            if len(stack) <= drop_at:
                drop_at = -1
            leave(len(stack))
        if drop_at < 0 and is_boilerplate(tag, m[3], articles > 0):
            drop_at = len(stack)
        if drop_at < 0 and not (tag == "p" and articles) and (found := boilerplate_name(tag, m[3]))[0]:
            depths.append(len(stack))
            named.append((*found, False, within))
            within = len(named) - 1
        if tag in ("article", "main"):
            outermost += not articles
            articles += 1
            if within >= 0 and drop_at < 0:
                named[within] = (*named[within][:2], True, named[within][3])
        links += tag == "a"
        stack.append(tag)
        held[tag] += 1
    flush()
    return kept_lines(lines, named)


def regions(weights: list[int], surge: int = SURGE, window: int = WINDOW) -> list[tuple[int, int]]:
    """[rise, dive) of each region in which a window sum reaches ``surge``."""
    n = len(weights)
    sums = [sum(weights[i : i + window]) for i in range(n)]
    found, i = [], 0
    while i < n:
        if not weights[i]:
            i += 1
            continue
        end = i  # the dive: the window from here on holds nothing
        while end < n and sums[end]:
            end += 1
        if max(sums[i:end]) >= surge:
            found.append((i, end))
        i = end + 1
    return found


def weights_of(lines: list[tuple[str, int, int]]) -> list[int]:
    plain = [0 if 2 * linked > len(t) else len(t) for t, linked, _ in lines]
    inside = sum(w for w, (_, _, k) in zip(plain, lines, strict=True) if k)
    if len({k for _, _, k in lines if k}) > 1 and 2 * inside < sum(plain):
        return plain
    return [SURGE * len(t) if k else w for w, (t, _, k) in zip(plain, lines, strict=True)]


def main_text(page: str | None) -> str:
    """The main text: its blocks joined by an empty line."""
    lines = lines_of(page or "")
    weights = weights_of(lines)
    kept = []
    for start, end in regions(weights) or regions(weights, 1):
        while not weights[end - 1]:  # the last window reaches beyond the last line that weighs something
            end -= 1
        kept += [t for t, _, _ in lines[start:end]]
    return "\n\n".join(kept)


@F.arrow_udf(T.StringType())
def _extract(pages: pa.Array) -> pa.Array:
    return pa.array((main_text(p.as_py()) for p in pages), pa.string())


def extracted(html_col: str | Column) -> Column:
    """Main text of a column of pages.

    Null, empty and textless pages give an empty string.  Repeated rows each give theirs;
    pages cut off anywhere are read as far as they go.
    """
    return _extract(F.col(html_col) if isinstance(html_col, str) else html_col)
