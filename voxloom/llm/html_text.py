"""Lines of an HTML page with the part of the page they stand in; a small tag scanner, no document tree."""

from __future__ import annotations

import re
from html import unescape

# Element names of the HTML standard, and words that page builders use in class and id names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option "
    "p pre search section select summary svg table tbody td template textarea tfoot th thead title tr ul video audio canvas".split())
ITEMS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",),
         "option": ("select", "optgroup")}
CHROME_TAGS = frozenset(
    "head title nav aside footer form button select textarea fieldset template noscript iframe object svg dialog menu canvas audio video".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs cookie cookies consent gdpr comment "
    "comments commentlist disqus respond footer masthead menu menubar nav navbar navigation newsletter notice notices notification pager "
    "pagination popup modal overlay promo promoted promotion related recommended share sharing sidebar sidenav sidebox social sponsor sponsored "
    "sponsors subscribe subscription toolbar topbar widget widgets signup login skip alert aside".split())
HEAD_WORDS = frozenset("header head topheader pageheader siteheader".split())
HARMLESS = frozenset("has with no without not".split())
FILLERS = frozenset(
    "list box block section area wrapper wrap container inner outer item items bar button buttons link links post posts article articles form thread "
    "text body content slot unit label title top bottom left right inline main page site small large first last".split())

BODY, LOOSE, CHROME, WRAPPED, ENCLOSED = 0, 1, 2, 3, 4
#: How sure it is that an element is chrome: not, by a name or a form that may as well stand around a whole page, or by what it is.
NOT, MAYBE, SURE = 0, 1, 2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S | re.I)
_NAMED = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PARTS = re.compile(r"[^a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _traits(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMED.finditer(rest)} if rest else {}


def _chrome(tag: str, traits: dict[str, str], in_article: bool) -> int:
    if tag == "form" and not in_article:
        return MAYBE
    if tag in CHROME_TAGS or tag == "header" and not in_article:
        return SURE
    if not traits or tag in ("html", "body", "article", "main"):
        return NOT
    if traits.get("role", "").lower() in CHROME_ROLES or "hidden" in traits or traits.get("aria-hidden", "").lower() == "true":
        return SURE
    if re.search(r"display\s*:\s*none", traits.get("style", ""), re.I):
        return SURE
    for name in ("class", "id"):
        for value in traits.get(name, "").split():
            words = {w for w in _PARTS.split(_HUMP.sub("-", value).lower()) if w}
            if in_article:  # a name with a word of its own, as in related-work, is no mark
                if words & CHROME_WORDS and words <= CHROME_WORDS | FILLERS:
                    return SURE
            elif not words & HARMLESS and words & (CHROME_WORDS | HEAD_WORDS):
                return MAYBE
    return NOT


def lines(html: str) -> list[tuple[str, int]]:
    """Text and kind of every non-empty block in page order: BODY inside an article, CHROME inside menus, headers, footers, sidebars,
    notices, adverts, forms, comments and such, LOOSE elsewhere. Where a page has no article, lists of links are CHROME too.

    A class name or a form may also stand around a whole page: an article inside such an element counts where the page has none outside,
    and what a form holds is LOOSE where the page has nothing else."""
    out: list[list] = []
    stack: list[tuple[str, int, bool, bool, bool]] = []  # element, how surely it is or is in chrome, in an article, in a link, in no chrome but forms
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(pieces)).split())
        if text:
            chrome, article, _, only_forms = stack[-1][1:] if stack else (NOT, False, False, False)
            kind = CHROME if chrome == SURE else WRAPPED if chrome and article else ENCLOSED if chrome and only_forms else CHROME if chrome else BODY if article else LOOSE
            out.append([text, kind, linked > 0.6 * len(text)])
        pieces.clear()
        linked = 0

    def close(name: str, stop: tuple[str, ...] = ()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            text = html[at:m.start()]
            pieces.append(text)
            if stack and stack[-1][3]:
                linked += len(text)
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1]:
                flush()
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        if m[2]:
            close(tag, ("article", "main", "body") if tag not in ("article", "main", "body", "html") else ())
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:
            close("p", ("div", "section", "article", "main", "td", "th", "li", "dd", "blockquote", "body", "form", "aside", "nav", "footer", "header"))
        if tag in ITEMS:
            close(tag, ITEMS[tag])
        chrome, article, link, only_forms = stack[-1][1:] if stack else (NOT, False, False, True)
        traits = _traits(m[4])
        article = article or tag in ("article", "main") or traits.get("role", "").lower() in ("main", "article") or traits.get("itemprop") == "articleBody"
        own = _chrome(tag, traits, article)
        stack.append((tag, max(chrome, own), article, link or tag == "a", only_forms and (not own or tag == "form")))
    pieces.append(html[at:])
    flush()
    kinds = {kind for _, kind, _ in out}
    if kinds & {BODY, WRAPPED}:
        body = BODY if BODY in kinds else WRAPPED
        return [(text, BODY if kind == body else CHROME if kind in (WRAPPED, ENCLOSED) else kind) for text, kind, _ in out]
    loose = LOOSE if any(kind == LOOSE and not links for _, kind, links in out) else ENCLOSED
    return [(text, CHROME if links or kind in (WRAPPED, ENCLOSED) and kind != loose else LOOSE if kind == loose else kind) for text, kind, links in out]


def common(one: list[int], two: list[int]) -> set[int]:
    """Places in `one` of a longest common subsequence with `two`."""
    shared = set(one) & set(two)
    a = [i for i, x in enumerate(one) if x in shared]
    b = [x for x in two if x in shared]
    # Rows of the dynamic program as bit sets over `a`: a bit is cleared where the length grows.
    where: dict[int, int] = {}
    for i, at in enumerate(a):
        where[one[at]] = where.get(one[at], 0) | 1 << i
    full = (1 << len(a)) - 1
    row, rows = full, [full]
    for x in b:
        met = row & where[x]
        row = ((row + met) | (row - met)) & full
        rows.append(row)
    out = set()
    i, j = len(a), len(b)
    while i and j:
        if not rows[j] >> (i - 1) & 1 and rows[j - 1] >> (i - 1) & 1 and one[a[i - 1]] == b[j - 1]:
            out.add(a[i - 1])
            i, j = i - 1, j - 1
        elif not rows[j] >> (i - 1) & 1 and not rows[j - 1] >> (i - 1) & 1:
            j -= 1
        elif rows[j] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
    return out
