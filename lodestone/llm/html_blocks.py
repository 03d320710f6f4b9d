"""HTML as a sequence of leaf blocks: the text between block boundaries, each with its tag path.

A tolerant reader: end tags may be missing (p, li, td and the like close as the standard says), a page may break off
anywhere, and what looks like a tag but isn't is text. In a tag, a quote opens a value only after the equals sign of an attribute. Comments, declarations, scripts, styles and templates have no text.
Character references are decoded, white space (br included) becomes one space.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

# Element names by their role in the standard (fixed values).
NAMING = frozenset("class id role".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style template noscript iframe svg textarea select".split())
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "body": "head"}
CLOSES = {k: frozenset(v.split()) for k, v in CLOSES.items()}
SCOPE = frozenset("ul ol dl table body html article section div main aside".split())

# An attribute's value: in quotes, unless the quote is never closed; else up to a blank or the tag's end.
_VALUE = r"""=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|["'](?=[^>]*+>))?+"""
_TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|{_VALUE})*+)(>|\Z)""", re.S)
_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}
_ATTR = re.compile(r"""(?:^|[\s/"'])([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_SPACE = re.compile(r"[\s\xa0]+")


class Block(NamedTuple):
    path: tuple  # of names as (tag, class and id words), outermost first
    text: str
    linked: int  # characters within links


def _name(tag: str, attrs: str) -> str:
    if not attrs or "=" not in attrs:
        return tag
    words = " ".join(a or b or c for name, a, b, c in _ATTR.findall(attrs) if name.lower() in NAMING)
    return f"{tag} {words.lower()}" if words else tag


def blocks(page: str) -> list[Block]:
    """The blocks with text, in page order."""
    out: list[Block] = []
    tags: list[str] = []
    names: list[str] = []
    parts: list[str] = []
    linked, at, anchors = 0, 0, 0

    def close_block():
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                # inline elements say nothing about the block that they stand in
                out.append(Block(tuple(n for t, n in zip(tags, names) if t not in INLINE), text, min(linked, len(text))))
            parts, linked = [], 0

    def pop(to: int):
        nonlocal anchors
        if any(t not in INLINE for t in tags[to:]):
            close_block()
        anchors -= tags[to:].count("a")
        del tags[to:], names[to:]

    while m := _TAG.search(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if anchors:
                linked += len(piece)
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in tags:
                pop(len(tags) - 1 - tags[::-1].index(tag))
            elif tag == "p":
                close_block()
            continue
        if not m[4]:
            break  # the page ends within a tag
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag not in VOID and not m[3].endswith("/"):
                tags.append(tag)
                names.append(tag)
                anchors += tag == "a"
            continue
        close_block()
        while tags and tags[-1] in INLINE and tag not in INLINE and "p" in tags:  # left open in a paragraph that ends here
            anchors -= tags[-1] == "a"
            tags.pop()
            names.pop()
        if tags and tags[-1] == "p":
            pop(len(tags) - 1)
        if tag in CLOSES:
            for i in range(len(tags) - 1, -1, -1):
                if tags[i] in CLOSES[tag]:
                    pop(i)
                    if tag not in ("tr", "td", "th"):
                        break
                elif tags[i] in SCOPE:
                    break
        if tag in RAW:
            if not m[3].endswith("/"):  # what stands within is no markup: go to its end tag
                end = _END[tag].search(page, at)
                at = end.end() if end else len(page)
        elif tag not in VOID:
            tags.append(tag)
            names.append(_name(tag, m[3]))
    else:
        parts += [page[at:]] * (at < len(page))
    close_block()
    return out
