"""A small HTML reader: markup to a tree of elements and texts.

It follows the rules of HTML that decide where text belongs: raw text of
scripts, comments, quoted attributes, void elements, end tags that are implied
(paragraphs, list items, table cells) or never come. It never fails.
"""

from __future__ import annotations

import html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements nested deeper than this are taken as siblings, as browsers do.
MOST_DEPTH = 512
#: A start tag of the key closes an open element of the value, up to a border.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: An end tag does not reach beyond these, nor a block start beyond them to a paragraph.
_BORDER = frozenset("html table td th caption template object marquee applet button article main".split())

_TAG = re.compile(
    r"""<(?:(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*+)"""
    r"""(?P<rest>(?:[\s/=]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+)?+)?+)*+)>"""
    r"""|(?P<comment>!--)|(?P<bogus>[!?/]))"""
)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))?)?""")
_OPEN = re.compile("</?[A-Za-z]")
_COMMENT_END = re.compile(r"--!?>")


class Element:
    """An element; ``children`` holds elements and strings in page order."""

    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def attributes_of(rest: str) -> dict[str, str]:
    """Attribute values, character references decoded; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        out.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
    return out


def parse(page: str) -> Element:
    """The tree of a page. What is never closed ends with the page."""
    root = Element("#root", {})
    stack = [root]
    flat: dict[str, int] = {}  # open elements that were too deep for the stack
    at, n, lower = 0, len(page), None

    def text(s: str):
        if s:
            stack[-1].children.append(html.unescape(s) if "&" in s else s)

    def close_to(tags, border) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in border:
                return

    while at < n:
        less = page.find("<", at)
        if less < 0:
            text(page[at:])
            break
        m = _TAG.match(page, less)
        if m is None:
            if _OPEN.match(page, less):
                text(page[at:less])
                break  # a tag that the page ends in is no text
            text(page[at : less + 1])
            at = less + 1
            continue
        text(page[at:less])
        at = m.end()
        if m["comment"]:
            if page.startswith((">", "->"), at):
                at = page.index(">", at) + 1
                continue
            ended = _COMMENT_END.search(page, at)
            at = ended.end() if ended else n
        elif m["bogus"]:
            stop = page.find(">", at)
            at = stop + 1 if stop >= 0 else n
        elif m["end"]:
            tag = m["name"].lower()
            if flat.get(tag):
                flat[tag] -= 1
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in _BORDER and tag not in _BORDER and tag not in ("body", "html"):
                    break
                if tag not in BLOCK and tag not in _BORDER and stack[i].tag in BLOCK:
                    break  # an inline end tag does not close blocks
        else:
            tag = m["name"].lower()
            rest = m["rest"]
            element = Element(tag, attributes_of(rest) if "=" in rest or rest.strip(" /\t\n\r\f") else {})
            if tag in BLOCK:
                close_to({"p"}, _BORDER)
                if tag in HEADINGS and stack[-1].tag in HEADINGS:
                    stack.pop()
            if tag in _CLOSES:
                close_to(*_CLOSES[tag])
            stack[-1].children.append(element)
            if tag in RAW:
                if lower is None:
                    lower = page.lower() if len(page.lower()) == n else page
                stop = lower.find(f"</{tag}", at)
                stop = n if stop < 0 else stop
                element.children.append(html.unescape(page[at:stop]) if tag in ("textarea", "title") else page[at:stop])
                after = page.find(">", stop)
                at = after + 1 if stop < n and after >= 0 else n
            elif tag not in VOID:
                if len(stack) < MOST_DEPTH:
                    stack.append(element)
                else:
                    flat[tag] = flat.get(tag, 0) + 1
    return root
