"""A forgiving HTML reader that yields text blocks with their place in the document tree.

One pass over the tags, linear in the length of the page: comments, scripts
and styles are skipped whole, unclosed paragraphs, list items and cells are
closed by what follows them, stray end tags are ignored, and a document that
breaks off is read to its end.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*)([^>]*)>)")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")

# Kinds of elements.
RAW = frozenset("script style noscript template title textarea iframe svg math object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A start tag of the first kind closes an open element of the second, up to the barrier.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
          "option": ({"option"}, {"select"})}


@dataclass
class Frame:
    """An open block element."""
    tag: str
    path: str
    names: frozenset
    children: list = field(default_factory=list)


@dataclass
class Block:
    """Text of one block: path of its element, open elements around it (outermost first)."""
    path: str
    frames: tuple
    text: str


def _names(attrs: str) -> tuple[str, frozenset]:
    """Class, id and role of a tag: as a path part, and as a set of lower-case words."""
    if "=" not in attrs:
        return "", frozenset()
    words = []
    for _, a, b, c in _ATTR.findall(attrs):
        words += _NAME.findall((a or b or c).lower())
    return ("." + ".".join(words) if words else ""), frozenset(words)


def read(page: str | None) -> tuple[list[Block], list[tuple[str, str]]]:
    """Text blocks in page order, and (path, child sequence) of every block element."""
    page = page or ""
    blocks: list[Block] = []
    styles: list[tuple[str, str]] = []
    stack = [Frame("", "", frozenset())]
    pieces: list[str] = []

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                blocks.append(Block(stack[-1].path, tuple(stack[1:]), text))

    def close(depth: int) -> None:
        while len(stack) > depth:
            f = stack.pop()
            styles.append((f.path, ">".join(f.children)))

    at, last = 0, page.rfind(">") + 1  # no tag can end after the last ">"
    while True:
        m = _TAG.search(page, at, last)
        if m is None:
            break
        if m.start() > at:
            pieces.append(page[at:m.start()])
        at = m.end()
        if m[1]:
            end = page.find("-->", at)
            at = end + 3 if end >= 0 else len(page)
            continue
        if m[2]:
            at = page.find(">", at) + 1 or len(page)
            continue
        tag, attrs = m[4].lower(), m[5]
        for quote in "\"'":  # a ">" inside a quoted value does not end the tag
            if attrs.count(quote) % 2 and (q := page.find(quote, at, last)) >= 0 and (g := page.find(">", q, last)) >= 0:
                attrs, at = page[m.start(5):g], g + 1
                break
        if m[3]:
            if tag in BLOCK:
                flush()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
            continue
        if tag in RAW:
            if not attrs.endswith("/"):
                end = re.compile(f"</{re.escape(tag)}\\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                pieces.append(" ")
            continue
        if tag not in BLOCK:
            continue
        flush()
        for i in range(len(stack) - 1, 0, -1):  # an open paragraph ends where a block starts
            if stack[i].tag == "p":
                close(i)
                break
            if stack[i].tag in ("td", "th", "li", "div", "article", "section", "body"):
                break
        if tag in CLOSES:
            shut, barrier = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in shut:
                    close(i)
                    break
                if stack[i].tag in barrier:
                    break
        part, names = _names(attrs)
        top = stack[-1]
        sig = tag + part
        if not top.children or top.children[-1] != sig:
            top.children.append(sig)
        stack.append(Frame(tag, f"{top.path}/{sig}", names))
    if at < len(page):
        pieces.append(page[at:])
    flush()
    close(1)
    return blocks, styles
