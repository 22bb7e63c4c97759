"""Text lines of an HTML page, with the containers they stand in."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from dataclasses import dataclass

#: A comment, a declaration, or a tag with its attributes; quotes may hold ">".
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

# Element names of HTML by what they do to text, and words that name page furniture in class, id and role.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre td th tr blockquote figcaption caption summary address".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
SKIPPED = frozenset("head script style noscript template iframe object embed applet canvas svg math audio video map nav footer aside form button select option optgroup textarea input dialog menu search noembed noframes datalist title".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices notification alert alerts sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer foot masthead topbar comment comments disqus respond reply replies discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay widget widgets toolbar pagination pager paginator skip copyright outbrain taboola teaser teasers dfp".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alert alertdialog form".split())
ARTICLE_FURNITURE = frozenset("comment comments reply replies ad ads advert advertisement promo sponsored related teaser teasers".split())
MAIN_WORDS = frozenset("article articlebody content main post story entry".split())
PAGE_HEADERS = frozenset(("header", "site header", "page header", "main header", "global header", "top header", "header top", "header wrapper"))


@dataclass
class Line:
    """A text block: how surely its place is the article (2 by element, 1 by name, 0 not), and the containers in that place."""

    text: str
    rank: int
    inside: tuple[int, ...]


@dataclass
class _Open:
    name: str
    skips: bool
    rank: int
    box: int
    endless: bool


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text else {}


def _words(value: str) -> list[str]:
    return [w.lower() for w in WORD.findall(value)]


def _is_furniture(name: str, at: dict[str, str], in_article: bool) -> bool:
    if name in SKIPPED:
        return True
    if name == "header":
        return not in_article
    if "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in at.get("style", "").replace(" ", "").lower():
        return name not in ("html", "body")
    if not at or name in ("html", "body"):
        return False
    labels = [_words(at.get(k, "")) for k in ("class", "id")]
    if name in ("article", "main"):
        return any(ARTICLE_FURNITURE.intersection(w) for w in labels)
    if at.get("role") in ROLES:
        return True
    return any(FURNITURE.intersection(w) or " ".join(w) in PAGE_HEADERS for w in labels)


def _rank(name: str, at: dict[str, str]) -> int:
    if name in ("article", "main") or at.get("role") in ("main", "article") or at.get("itemprop", "").lower() == "articlebody":
        return 2
    if name in ("div", "section", "td") and at and any(w and (set(w) <= MAIN_WORDS | {"body", "text", "page"}) and MAIN_WORDS.intersection(w) for w in (_words(at.get(k, "")) for k in ("class", "id"))):
        return 1
    return 0


def _tokens(page: str) -> list[tuple]:
    """(kind, name, attributes, text before); kind is +1 for a start tag, -1 for an end tag, 0 for none."""
    out, at = [], 0
    while True:
        m = TOKEN.search(page, at)
        if m is None:
            out.append((0, "", "", page[at:]))
            return out
        before, at = page[at : m.start()], m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            out.append((0, "", "", before))
            continue
        end = bool(m[1] or m[4])
        out.append((-1 if end else 1, name, "" if end else m[3] or m[6] or "", before))
        if not end and name in RAW:
            # The content of these elements is no markup; it ends with their own end tag or the page.
            close = END[name].search(page, at)
            at = close.start() if close else len(page)


def _ends(tokens: list[tuple]) -> dict[int, int]:
    """For each start tag that has an end tag of its own, the number of that."""
    found: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = {}
    for i, (kind, name, _, _) in enumerate(tokens):
        if kind > 0 and name not in VOID:
            places.setdefault(name, []).append(len(stack))
            stack.append((name, i))
        elif kind < 0 and places.get(name):
            depth = places[name].pop()
            found[stack[depth][1]] = i
            for other, _ in stack[depth + 1 :]:
                places[other].pop()
            del stack[depth:]
    return found


def lines(page: str | None) -> list[Line]:
    """The page's text blocks in order, without those in page furniture.

    Character references are decoded, white space (``br`` too) becomes one space.  A name alone
    makes no furniture of what holds an article, and furniture that is never closed ends where
    the article or a first heading begins.
    """
    if not page:
        return []
    tokens = _tokens(page)
    ends = _ends(tokens)
    tags = [(i, name, _attributes(text)) for i, (kind, name, text, _) in enumerate(tokens) if kind > 0 and name in ("article", "main")]
    articles = [i for i, name, at in tags if not _is_furniture(name, at, False)]
    out: list[Line] = []
    held: list[str] = []
    stack: list[_Open] = []
    skipping = ranked = boxes = 0
    depth: dict[str, int] = {}

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                rank = max((o.rank for o in stack), default=0)
                top = next((k for k, o in enumerate(stack) if o.rank == rank), -1) if rank else -1
                out.append(Line(text, rank, tuple(o.box for o in stack[top + 1 :] if o.box >= 0)))

    def pop() -> None:
        nonlocal skipping, ranked
        gone = stack.pop()
        depth[gone.name] -= 1
        skipping -= gone.skips
        ranked -= gone.rank > 0

    for i, (kind, name, attributes, before) in enumerate(tokens):
        if before and not skipping:
            held.append(before)
        if not kind:
            continue
        block = name in BLOCK
        if block:
            flush()
        elif name == "br" and not skipping:
            held.append(" ")
        if kind > 0 and name not in VOID:
            at = _attributes(attributes)
            if block:
                while stack and not stack[-1].skips and stack[-1].name not in BLOCK:
                    pop()
                if stack and not stack[-1].skips and (stack[-1].name == "p" or stack[-1].name in CLOSES.get(name, ())):
                    pop()
            rank = _rank(name, at)
            if skipping and (rank or name == "h1"):
                lost = next((k for k, o in enumerate(stack) if o.skips and o.endless), None)
                while lost is not None and len(stack) > lost:
                    pop()
            nested = name == "article" and any(o.name == "article" for o in stack)
            named = _is_furniture(name, at, ranked > 0)
            if named and name not in SKIPPED and name != "header" and i in ends:
                first = bisect_right(articles, i)
                named = first == len(articles) or articles[first] > ends[i]
            skips = nested or named
            box = -1
            if block and name not in PARAGRAPH:
                box, boxes = boxes, boxes + 1
            stack.append(_Open(name, skips, 0 if skipping or skips else rank, box, i not in ends))
            depth[name] = depth.get(name, 0) + 1
            skipping += skips
            ranked += stack[-1].rank > 0
        elif kind < 0 and depth.get(name):
            while stack[-1].name != name:
                pop()
            pop()
    flush()
    return out
