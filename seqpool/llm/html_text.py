"""Main text of HTML pages by line-block distribution.

The page is cut into lines, one per block element, with the markup stripped.  A line's weight is its
text length; lines inside menus, headers, footers, sidebars, notices, adverts, forms and comments
give none, and lines that are mostly links weigh nothing.  Sums of the weights over sliding windows of lines
surge where the main text begins and dive where it ends; the lines between are the text.  Where the
page marks its article, only lines inside it have weight, and a window holds text as soon as its sum is not zero;
elsewhere a surge needs ``SURGE_CHARS``, and if no window has as many, all lines with weight are the text.

Defined results: null and empty html, or a page without main text, give an empty text; unclosed
elements end with their parent or the page, a head without its end also at the body or at the first thing that is no head
content, an unclosed dropped element also at an article; repeated rows each get their row.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW_LINES = 3
SURGE_CHARS = 80
LINK_SHARE = 0.5

# Element kinds of HTML.
RAW = "script style title textarea xmp iframe noembed noframes template svg math canvas object".split()
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select
summary table tbody td tfoot th thead tr ul""".split())
DROPPED = set("nav footer aside form menu dialog button select head noscript audio video datalist".split())
UNCLOSED = {"nav", "header", "form"}
HEAD_CONTENT = set("base basefont bgsound link meta noframes noscript script style template title head html".split())
ENDS_PARAGRAPH = BLOCK - {"body", "html", "option", "caption", "tbody", "thead", "tfoot", "tr", "td", "th"}
DROPPED_WORDS = set("""ad ads advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo
promotion cookie cookies consent gdpr notice notices notification alert sidebar sidebars menu menus nav navbar navigation
breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments disqus respond replies reply discussion related
recommended share sharing social subscribe subscription newsletter signup login popup modal overlay widget widgets
pagination pager skip copyright""".split())
COMMENT_WORDS = {"comment", "comments", "reply", "replies"}
PART_WORDS = set("""a area articles avatar bar block bottom box btn button buttons card cards column container content count div form group
header icon icons id inline inner item items label left link links list main meta more news outer page panel post posts right row section slot
small stories text thread title toggle top unit user wrap wrapper zone""".split())  # may stand beside a dropped word
QUOTING = {"pre", "code"}
LAYOUT_WORDS = {"with", "has", "no", "without"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu",
                 "menubar", "form"}
MAIN = {"article", "main"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*+(?:/>|>.*?(?:</(?P=raw)\s*+>|\Z))"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE)
_NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")


def _unwanted(tag: str, attrs: str, in_main: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_main):
        return True
    if not attrs or tag in ("html", "body"):
        return False
    for m in _NAMES.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            for one in value.split():
                words = set(_WORD.findall(one))
                if in_main and tag not in MAIN and (tag in QUOTING or words - DROPPED_WORDS - PART_WORDS):
                    continue  # "related-work": inside the article a name with any other word says nothing
                if words & LAYOUT_WORDS or (in_main and words & {"header", "copyright"}):
                    continue  # "with-sidebar", or the heading part of the article itself
                if words & (COMMENT_WORDS if tag in MAIN else DROPPED_WORDS):
                    return True
        elif name == "role" and value.strip() in DROPPED_ROLES:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        elif name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def unclosed_elements(page: str) -> set[int]:
    """Where the start tags without an end tag of their own stand."""
    opened: dict[str, list[int]] = {}
    for m in _TOKEN.finditer(page):
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag or tag in VOID:
            continue
        if not (m["end"] or m["end2"]):
            opened.setdefault(tag, []).append(m.start())
        elif opened.get(tag):
            opened[tag].pop()
    return {at for places in opened.values() for at in places}


def page_lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters in links, inside a marked article) of the page's lines outside dropped elements."""
    lines: list[tuple[str, int, bool]] = []
    stack: list[str] = []
    opened: Counter = Counter()  # of the stack, so that an end tag without a start costs nothing
    marks = {"drop": 0, "main": 0, "link": 0}  # depth at which the outermost such element stands; 0: none
    text: list[str] = []
    linked, dropped_at, bodies = 0, 0, 0
    unclosed: set[int] | None = None

    def flush() -> None:
        nonlocal linked
        joined = " ".join(_html.unescape("".join(text)).split())
        if joined:
            lines.append((joined, linked, marks["main"] > 0))
        text.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        opened.subtract(stack[depth:])
        del stack[depth:]
        for k in marks:
            if marks[k] > depth:
                marks[k] = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if stack and stack[-1] == "head" and m.start() > at and page[at: m.start()].strip():
            pop_to(len(stack) - 1)  # text ends an open head
        if m.start() > at and not marks["drop"]:
            piece = page[at: m.start()]
            text.append(piece)
            if marks["link"]:
                linked += len(piece)
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag, end, attrs = tag.lower(), m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if stack and stack[-1] == "head" and not end and tag not in HEAD_CONTENT:
            pop_to(len(stack) - 1)  # so does the first element that is no head content
        if tag == "body" and not end:
            bodies += 1
            if bodies == 1 and marks["drop"] and ("head" in stack or stack[marks["drop"] - 1] == "noscript"):
                pop_to(stack.index("head") if "head" in stack else marks["drop"] - 1)
        if tag == "br" and not marks["drop"]:
            text.append(" ")
        if tag in BLOCK and not marks["drop"]:
            flush()
        if end and not opened[tag]:
            continue
        if end:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth] == tag:
                    pop_to(depth)
                    break
            continue
        if tag in VOID:
            continue
        if marks["drop"] and tag == "article" and stack[marks["drop"] - 1] not in UNCLOSED and unclosed is None:
            unclosed = unclosed_elements(page)
        if marks["drop"] and (tag == "main" or (tag == "article" and (
                stack[marks["drop"] - 1] in UNCLOSED or dropped_at in unclosed))):
            pop_to(marks["drop"] - 1)  # a menu or header that was never closed ends where the article begins
        if tag in ENDS_PARAGRAPH and opened["p"]:
            for depth in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                if stack[depth] == "p":
                    pop_to(depth)
                    break
                if stack[depth] in BLOCK:
                    break
        if tag in ("li", "dt", "dd", "option") and stack and stack[-1] == tag:
            pop_to(len(stack) - 1)
        if attrs.rstrip().endswith("/") and tag not in BLOCK:
            continue
        stack.append(tag)
        opened[tag] += 1
        if not marks["drop"] and _unwanted(tag, attrs, marks["main"] > 0):
            marks["drop"], dropped_at = len(stack), m.start()
        if not marks["main"] and not marks["drop"] and (tag in MAIN or 'role="main"' in attrs):
            marks["main"] = len(stack)
        if not marks["link"] and tag == "a":
            marks["link"] = len(stack)
    if stack and stack[-1] == "head" and page[at:].strip():
        pop_to(len(stack) - 1)
    if not marks["drop"]:
        text.append(page[at:])
        flush()
    return lines


def main_text(page: str | None, window: int = WINDOW_LINES, surge: int = SURGE_CHARS) -> str:
    """The lines between the surge and dive points of the window sums, joined by newlines."""
    lines = page_lines(page or "")
    marked = any(x[2] for x in lines)
    if marked:
        weight, surge = [len(t) if inside else 0 for t, _, inside in lines], 1
    else:
        weight = [0 if linked > LINK_SHARE * len(t) else len(t) for t, linked, _ in lines]
    keep: list[str] = []
    i, n = 0, len(lines)
    while i < n:
        if weight[i] == 0 or sum(weight[i: i + window]) < surge:
            i += 1
            continue
        while i < n and sum(weight[i: i + window]) > 0:  # up to the dive point
            if weight[i] > 0:
                keep.append(lines[i][0])
            i += 1
    if not keep:  # no surge: a short text is the text between its first and last line
        keep = [line[0] for line, w in zip(lines, weight, strict=True) if w]
    return "\n".join(keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text for every row of ``pages`` (page_id, url, html)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(x.as_py()) for x in b.column("html")], b.schema.field("html").type)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), texts], ["page_id", "url", "text"])

    x = pages.select("page_id", "url", "html")
    return x.mapInArrow(run, x.select("page_id", "url", x["html"].alias("text")).schema)
