"""Leaf blocks of web pages: the runs of text between block-level tags, each with the elements it stands in."""

from __future__ import annotations

import functools
import html
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
INLINE |= frozenset("math mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
#: Elements whose content a page never shows beside its own text: code, and what stands in for scripts and frames that did not run.
RAW = frozenset("script style template noscript iframe".split())
#: Elements that a new one of the same kind ends.
SIBLINGS = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
#: Block-level elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

#: How many of the innermost elements a block names in ``path``; what it stands in, at any depth, is in ``inside``.
NAMED = 64
#: Features of the elements that a block stands in are bits of a number with as many places.
PLACES = 1 << 13

_MARK = re.compile(r"['\">]")
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_WORD = re.compile(r"[a-z]+")
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclass
class Block:
    path: tuple[str, ...]  # the innermost open elements as "tag" or "tag class-and-id words"
    text: str
    linked: int  # characters that stand in links
    inside: int = 0  # the features of all elements that it stands in, as bits
    above: int = 0  # equal for blocks whose elements but the last are the same


def place(name: str) -> int:
    """A feature's number."""
    return zlib.crc32(name.encode()) % PLACES


@functools.lru_cache(20_000)
def _element(element: str) -> int:
    tag, _, words = element.partition(" ")
    return functools.reduce(lambda bits, name: bits | 1 << place(name), [f"in {tag}", *(f"word {w}" for w in _WORD.findall(words))], 0)


class _Ends:
    """Where tags end: the first ``>`` outside quotes. Each quote is looked at once, so a page costs linear time
    however its quotes and brackets are broken."""

    def __init__(self, page: str):
        self.page = page
        self.marks = [m.start() for m in _MARK.finditer(page)]
        self.known: dict[int, int] = {}  # an opening quote -> the end of a tag in which it opens

    def after(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose attributes begin at ``at``; -1 without."""
        chain, end = [], -1
        while (i := bisect_left(self.marks, at)) < len(self.marks):
            mark = self.marks[i]
            if self.page[mark] == ">":
                end = mark
                break
            if mark in self.known:
                end = self.known[mark]
                break
            chain.append(mark)
            at = self.page.find(self.page[mark], mark + 1) + 1
            if not at:
                break
        self.known.update(dict.fromkeys(chain, end))
        return end


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, tag, closes, attributes) of everything that is markup; comments and declarations have no tag.

    A ``<`` that no tag, comment or declaration begins with, or whose tag never ends, is text; the last such tag is dropped."""
    ends, at = _Ends(page), page.find("<")
    while at >= 0:
        head = page[at + 1 : at + 2]
        end, tag, closes, attributes = -1, "", False, ""
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4) + 3
            end = end if end > 2 else len(page)
        elif head and head in "!?":
            end = page.find(">", at + 2) + 1 or len(page)
        elif name := _NAME.match(page, at + 1):
            close = ends.after(name.end())
            if close >= 0:
                end, tag, closes, attributes = close + 1, name[2].lower(), bool(name[1]), page[name.end() : close]
            elif page.find("<", at + 1) < 0:
                end = len(page)
        if end < 0:
            at = page.find("<", at + 1)
            continue
        if tag in RAW and not closes and not attributes.rstrip().endswith("/"):
            over = re.compile(rf"</{tag}\s*>", re.I).search(page, end)
            end = over.end() if over else len(page)
        yield at, end, tag, closes, attributes
        at = page.find("<", end)


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order; scripts, styles, comments and markup are no text, white space is one blank."""
    out: list[Block] = []
    stack: list[list] = []  # block-level elements: tag, tag with its words, links open inside, features so far, and a number for all so far
    count: Counter[str] = Counter()  # open elements of each tag
    parts: list[str] = []
    linked = links = outside = 0  # characters in links; links open, and those open outside of all elements

    def flush() -> None:
        nonlocal linked
        if parts:
            # references do not go over the borders of tags
            text = " ".join("".join(map(html.unescape, parts)).split())
            if text:
                inside, above = (stack[-1][3], stack[-2][4] if len(stack) > 1 else 0) if stack else (0, 0)
                out.append(Block(tuple(x[1] for x in stack[-NAMED:]), text, min(linked, len(text)), inside, above))
            parts.clear()
        linked = 0

    def pop() -> None:
        nonlocal links
        tag, _, own, _, _ = stack.pop()
        count[tag] -= 1
        links -= own

    at = 0
    for begin, end, tag, closes, attributes in _tags(page):
        if begin > at:
            parts.append(page[at:begin])
            linked += (begin - at) if links else 0
        at = end
        if not tag or tag in RAW:
            continue
        if tag == "br":
            parts.append(" ")
        elif tag in VOID:
            if tag not in ("wbr", "img", "input"):
                flush()
        elif tag in INLINE:
            if tag == "a":
                open_here = stack[-1][2] if stack else outside
                step = 1 if not closes else -1 if open_here else 0
                links += step
                if stack:
                    stack[-1][2] += step
                else:
                    outside += step
        else:
            flush()
            if closes:
                if count[tag]:
                    while stack[-1][0] != tag:
                        pop()
                    pop()
            else:
                ends = SIBLINGS.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
                while stack and stack[-1][0] in ends:
                    pop()
                if not attributes.rstrip().endswith("/"):
                    words = " ".join(a or b or c for a, b, c in _ATTR.findall(attributes)) if "=" in attributes else ""
                    element = f"{tag} {words}".strip().lower()
                    inside, chain = (stack[-1][3], stack[-1][4]) if stack else (0, 0)
                    # carried down, so that depth costs nothing
                    stack.append([tag, element, 0, inside | _element(element), (chain * 1_000_003 + zlib.crc32(element.encode()) + 1) % ((1 << 61) - 1)])
                    count[tag] += 1
    if at < len(page):
        parts.append(page[at:])
        linked += (len(page) - at) if links else 0
    flush()
    return out
