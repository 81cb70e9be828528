"""Main text of HTML pages by the distribution of text over lines.

Markup is stripped into lines, one for each block of the page. A line weighs as many characters as it
has outside links. Markup only changes weights: lines in menus, notices, forms and the like, and lines that
are mostly links, weigh nothing; where the page marks its article, lines in it weigh more and lines outside it
nothing. Weights are summed over sliding windows of lines. Text starts where the sum surges above a
threshold, back to the first line of the window that weighs anything, and ends where it dives to zero; the
text between is kept.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines in a window, the characters that a window must exceed, and what a line in a marked article weighs besides its characters: its author's mark is worth a window of text.
WINDOW, SURGE, MARKED = 3, 86, 86

# Element names of HTML, and words that name parts of a page in class, id and role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset("br body caption head html legend link option tbody td tfoot th thead title tr".split())
_OUT = frozenset("nav footer aside form head menu dialog button select fieldset canvas object audio video datalist search header".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "header footer masthead topbar toolbar comment comments commentlist disqus respond replies notice notices cookie cookies consent gdpr alert newsletter subscribe signup "
    "login popup modal overlay share sharing social related recommended widget pagination pager form search skip disclaimer".split()
)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_ATTR = re.compile(r"(?:^|[\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", characters, ""), ("start", name, attributes) and ("end", name, "") in page order; comments and raw texts are left out."""
    at, n, plain = 0, len(page), 0
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            break
        nxt = page[lt + 1 : lt + 2]
        if nxt in ("!", "?") or (nxt == "/" and not page[lt + 2 : lt + 3].isalpha()):
            if lt > plain:
                yield "text", page[plain:lt], ""
            if page.startswith("<!--", lt):
                short = page[lt + 4 : lt + 6]
                end = page.find("-->", lt + 4)
                odd = page.find("--!>", lt + 4, end if end >= 0 else n)
                at = lt + 5 if short[:1] == ">" else lt + 6 if short == "->" else odd + 4 if odd >= 0 else end + 3 if end >= 0 else n
            else:
                gt = page.find(">", lt)
                at = n if gt < 0 else gt + 1
            plain = at
            continue
        if not (nxt == "/" or (nxt.isascii() and nxt.isalpha())):
            at = lt + 1
            continue
        if lt > plain:
            yield "text", page[plain:lt], ""
        m = _TAG.match(page, lt)
        if not m:  # the page ends within a tag
            return
        at = plain = m.end()
        name = m[2].lower()
        if m[1]:
            yield "end", name, ""
            continue
        yield "start", name, m[3]
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = plain = end.start() if end else n
        elif name == "plaintext":
            at = plain = n
    if plain < n:
        yield "text", page[plain:], ""


def _boilerplate(name: str, attrs: str, words: bool, inside: bool) -> bool:
    """inside: within an article, whose own header holds its title and so counts as text."""
    if name in _OUT:
        return not (inside and name == "header")
    if not attrs or name in ("html", "body", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            if value.strip().lower() in _OUT_ROLES:
                return True
        elif words and any(w in _OUT_WORDS and not (inside and w == "header") for w in map(str.lower, _WORD.findall(value))):
            return True
    return False


def _is_main(name: str, attrs: str) -> bool:
    return name in ("article", "main") or (bool(attrs) and any(m[1].lower() == "role" and (m[2] or m[3] or m[4] or "").strip().lower() in ("main", "article") for m in _ATTR.finditer(attrs)))


def lines_of(page: str, words: bool = True) -> tuple[list[tuple[str, int, bool]], bool]:
    """Lines (text, characters outside links and boilerplate, in a marked article) and whether the page marks an article.

    words: classes and ids that name boilerplate count too, not only elements and roles. Lines in boilerplate
    are without text. The time is in proportion to the page, however deep its elements nest or stay open.
    """
    lines: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, boilerplate, marked article
    places: dict[str, list[int]] = {}  # places in the stack by name
    bad_at: list[int] = []
    main = free = 0
    text: list[str] = []
    marked = hidden = False

    def flush() -> None:
        nonlocal free, text, hidden
        line = " ".join("".join(text).split()) if text else ""
        if line or hidden:
            lines.append((line, free if line else 0, main > 0))
        text, free, hidden = [], 0, False

    def pop_to(i: int) -> None:
        nonlocal main
        while len(stack) > i:
            name, bad, good = stack.pop()
            places[name].pop()
            main -= good
            if bad:
                bad_at.pop()

    def innermost(name: str, barriers: tuple[str, ...] = ()) -> int:
        last = lambda x: (places.get(x) or (-1,))[-1]
        i = last(name)
        return i if i > max(map(last, barriers), default=-1) else -1

    for kind, what, attrs in _tokens(page):
        if kind == "text":
            if bad_at:
                hidden = hidden or not what.isspace()
            elif what:
                piece = _html.unescape(what) if "&" in what else what
                text.append(piece)
                if not places.get("a"):
                    free += len(piece.strip())
            continue
        if what in _BLOCK:
            flush()
        if kind == "end":
            if (i := innermost(what)) >= 0:
                pop_to(i)
            continue
        if what in _CLOSES_P and (i := innermost("p", ("table", "button", "td", "th"))) >= 0:
            pop_to(i)
        if what == "li" and (i := innermost("li", ("ul", "ol", "menu"))) >= 0:
            pop_to(i)
        if what in ("td", "th", "tr") and (i := innermost(what, ("table",))) >= 0:
            pop_to(i)
        good = _is_main(what, attrs)
        bad = _boilerplate(what, attrs, words, main > 0)
        if good and not bad and bad_at and not main:  # an article that stands in unclosed or wrongly named boilerplate
            for i in bad_at:
                stack[i] = (stack[i][0], False, stack[i][2])
            bad_at.clear()
        good = good and not bad and not bad_at
        marked |= good
        if what in _VOID:
            continue
        if bad:
            bad_at.append(len(stack))
        places.setdefault(what, []).append(len(stack))
        stack.append((what, bad, good))
        main += good
    flush()
    return lines, marked


def line_weights(lines: list[tuple[str, int, bool]], marked: bool) -> list[int]:
    """What each line weighs; `marked` says whether the page marks an article."""
    if marked:
        return [len(t) + MARKED if inside and t else 0 for t, _, inside in lines]
    return [w if 2 * w >= len(t) else 0 for t, w, _ in lines]


def stretches(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """[start, end) of each stretch of lines that is text.

    The sum at a line is that of the `window` lines that end there. A stretch begins with the first line that
    weighs anything after the sum was zero, ends where the sum dives to zero, and is text if the sum surges
    above the threshold in between. Where no window of the page does so, half its largest sum is the threshold.
    """
    sums, total = [], 0
    for i, w in enumerate(weights):
        total += w - (weights[i - window] if i >= window else 0)
        sums.append(total)
    most = max(sums, default=0)
    limit = surge if most > surge else most // 2
    found, at, peak = [], -1, 0
    for i, s in enumerate([*sums, 0]):
        if s and at < 0:
            at, peak = i, 0
        peak = max(peak, s)
        if not s and at >= 0:
            end = i
            while not weights[end - 1]:
                end -= 1
            if peak > limit:
                found.append((at, end))
            at = -1
    return found


def extract_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article's text: blocks in page order joined by one space; empty for null, empty and text-free pages."""
    if not page:
        return ""
    for words in (True, False):  # a page all of whose text is in wrongly named parts is read by elements alone
        lines, marked = lines_of(page, words)
        weights = line_weights(lines, marked)
        keep = [lines[i][0] for a, b in stretches(weights, window, surge) for i in range(a, b) if lines[i][0] and (lines[i][2] or not marked)]
        if keep:
            return " ".join(keep)
    return ""


def main_text(page: Column, window: int = WINDOW, surge: int = SURGE) -> Column:
    """extract_text() of an HTML column, over whole pages in Arrow batches."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: extract_text(p, window, surge), na_action=None)

    return run(page)


def extract_pages(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """pages with the main text of each page in `name`, which replaces a column of that name.

    Null and empty pages have the text "". Whole pages are read, in time proportional to their length. Rows
    otherwise stay as they are: repeated rows give repeated results, an empty table an empty one.
    """
    return pages.withColumn(name, main_text(F.col(html)))
