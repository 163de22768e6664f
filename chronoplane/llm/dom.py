"""Leaf blocks of an HTML page with what their ancestors and texts say about them."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape
from itertools import islice

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript iframe object svg math canvas head title select datalist audio video map".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section table ul".split()
)
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table tbody thead tfoot menu select".split())
ZONES = "article main nav header footer aside form section table ul ol dl figure blockquote button label fieldset address details menu".split()

#: Words in class, id and role, by what they name.
NAMES = {
    "main": "article articlebody content entry post story text main maintext body page-content prose blog",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs toolbar pager pagination toc skip",
    "head": "header head masthead topbar logo branding hero site-title",
    "foot": "footer foot bottom copyright legal colophon imprint credits",
    "side": "sidebar side aside widget related recommended trending popular more sidecol rail teaser teasers",
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay warning disclaimer message toast",
    "advert": "ad ads advert advertisement adsense banner sponsor sponsored promo promotion promoted",
    "form": "form search login signup subscribe newsletter register contact input",
    "comments": "comment comments reply replies discussion disqus respond reader responses thread",
    "share": "share sharing social meta byline author date tags tagged categories follow",
}
NAMED = {word: group for group, words in NAMES.items() for word in words.split()}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'"><])*+)>|([^<]+|<)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|data-main|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|\Z)""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(slots=True)
class Node:
    """An open element: its name, a number, and the marks that it and its ancestors give to the blocks below."""

    tag: str
    number: int
    marks: frozenset
    hidden: bool
    link: bool
    main: bool


@dataclass(slots=True)
class Block:
    """A leaf block: text, ancestors' marks, number of the element around its own, name of its own, share in links, given label."""

    text: str
    marks: frozenset
    parent: int
    tag: str
    linked: float
    main: bool


def _marks(tag: str, attributes: str) -> tuple[set, bool, bool]:
    marks, hidden, main = ({f"in:{tag}"} if tag in ZONES else set()), tag in HIDDEN, False
    if attributes and not attributes.isspace():
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next(filter(None, values), "")
            if name == "data-main":
                main = True
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                hidden = True
            elif name in ("class", "id", "role"):
                for word in PART.findall(value):
                    if group := NAMED.get(word.lower()):
                        marks.add(f"named:{group}")
    return marks, hidden, main


def blocks(html: str | None) -> list[Block]:
    """The leaf blocks of a page, in its order: runs of text that no block-level tag interrupts.

    References are decoded, white space becomes single spaces. Broken markup is read as browsers do in the main: missing
    end tags are implied, stray ones ignored, and what is open at the end is closed there.
    """
    out: list[Block] = []
    root = Node("", 0, frozenset(), False, False, False)
    stack, text, linked, count, opened = [root], [], 0, 0, Counter()
    holder, around = root, 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                size = sum(map(len, text))
                out.append(Block(joined, holder.marks, around, holder.tag, linked / max(1, size), holder.main))
            text.clear()
            linked = 0

    def block_node() -> tuple[Node, int]:
        own = list(islice((n for n in reversed(stack) if n.tag not in INLINE), 2))
        return own[0], own[-1].number

    def close(at: int) -> None:
        for n in stack[at:]:
            opened[n.tag] -= 1
        del stack[at:]

    html, at_char = html or "", 0
    while at_char < len(html):
        found = TOKEN.match(html, at_char)
        at_char = found.end()
        closing, tag, attributes, data = found.groups()
        if data is not None:
            if not stack[-1].hidden:
                if not text:
                    holder, around = block_node()
                text.append(data)
                if stack[-1].link:
                    linked += len(data)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE and tag not in RAW:
            flush()
        if closing:
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0) if opened[tag] else 0
            if at:
                if tag in INLINE and any(n.tag not in INLINE for n in stack[at + 1 :]):
                    continue  # a stray inline end tag doesn't close blocks
                close(at)
            continue
        if tag in VOID:
            if tag == "br" and text:
                text.append(" ")
            continue
        if tag in CLOSES_P and opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                if i >= len(stack) or stack[i].tag in CLOSES_P:
                    break
        elif tag in IMPLIED and any(opened[t] for t in IMPLIED[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SCOPES:
                    break
                if stack[i].tag in IMPLIED[tag]:
                    close(i)
                    break
        if tag in RAW:  # its content is no markup
            end = RAW_END[tag].search(html, at_char)
            at_char = end.end() if end else len(html)
            continue
        count += 1
        marks, hidden, main = _marks(tag, attributes)
        above = stack[-1]
        opened[tag] += 1
        stack.append(Node(tag, count, above.marks | marks if marks else above.marks, hidden or above.hidden, above.link or tag == "a", main or above.main))
    flush()
    return out
