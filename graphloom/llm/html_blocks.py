"""HTML to leaf blocks: the text between block boundaries, in page order, with the path of open elements."""

from __future__ import annotations

import html
import re
from bisect import bisect
from typing import NamedTuple

#: Elements by how HTML treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe svg canvas audio video object title noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
#: Start tags that end an open paragraph, and those that end an open element of their own kind.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt".split())
ENDS_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S
)
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|[a-z]+")


class Element:
    """An open element: its tag and the words of its names, and what it stands in. Blocks share their elements, so a
    page's blocks take memory in proportion to its size however deep they are."""

    __slots__ = ("depth", "label", "parent")

    def __init__(self, label: str, parent: Element | None):
        self.label, self.parent, self.depth = label, parent, parent.depth + 1 if parent else 1


class Block(NamedTuple):
    element: Element | None  # the innermost open one
    text: str
    linked: int  # characters inside links

    @property
    def depth(self) -> int:
        return self.element.depth if self.element else 0

    @property
    def path(self) -> tuple[str, ...]:
        """Each open element from the outermost, as "tag" or "tag name name"."""
        out, e = [], self.element
        while e:
            out.append(e.label)
            e = e.parent
        return tuple(reversed(out))


def element(tag: str, attributes: str) -> str:
    """The tag and the words of its class, id and role."""
    if "=" not in attributes:
        return tag
    found = [p.lower() for m in NAMES.finditer(attributes) for p in PART.findall(m[1] or m[2] or m[3] or "")]
    return " ".join([tag, *dict.fromkeys(found)]) if found else tag


def blocks(page: str) -> list[Block]:
    """All blocks with text. Comments, declarations and silent elements leave none; an unclosed one runs to the end."""
    out: list[Block] = []
    tags: list[str] = []
    open_: list[Element] = []
    held: list[str] = []
    places: dict[str, list[int]] = {}  # of each tag's open elements, from the outermost
    solid: list[int] = []  # places of those that aren't inline
    linked, links, at, n = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if held:
            text = "".join(held)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            held.clear()
            if text:
                out.append(Block(open_[-1] if open_ else None, text, min(linked, len(text))))
        linked = 0

    def close(k: int) -> None:
        nonlocal links
        for tag in tags[k:]:
            places[tag].pop()
            if tag not in INLINE:
                solid.pop()
            links -= tag == "a"
        del tags[k:], open_[k:]

    def last(tag: str) -> int:
        found = places.get(tag)
        return found[-1] if found else -1

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            held.append(page[at:])
            linked += (n - at) * (links > 0)
            break
        if m.start() > at:
            held.append(page[at : m.start()])
            linked += (m.start() - at) * (links > 0)
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if page.startswith("<![CDATA[", m.start()):
                held.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        elif tag in ("br", "img"):
            held.append(" ")
        if m[1] or m[4]:
            # An end tag closes its element and all in it; without one it does nothing.
            k = last(tag)
            if k >= 0 and not (tag in INLINE and solid and solid[-1] > k):
                close(k)
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in VOID or attributes.endswith("/") and tag in SILENT:
            continue
        if tag in SILENT:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "body" and places.get("head"):
            close(places["head"][0])
        if tag in ENDS_P and places.get("p") and solid[-1] == last("p"):
            close(solid[-1])
        if tag in ENDS_OWN:
            # The outermost element of its own kind inside the nearest one that holds such.
            holder = max(last(t) for t in HOLDS[tag])
            own = [found[k] for t in ENDS_OWN[tag] if (found := places.get(t)) and (k := bisect(found, holder)) < len(found)]
            if own:
                close(min(own))
        places.setdefault(tag, []).append(len(tags))
        if tag not in INLINE:
            solid.append(len(tags))
        tags.append(tag)
        open_.append(Element(element(tag, attributes), open_[-1] if open_ else None))
        links += tag == "a"
    flush()
    return out
