"""HTML to leaf blocks: runs of text between block-level tags, each with its open elements and its share of link text."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math)\b[^>]*/>"
    r"|<(?P<raw>script|style|title|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<drawn>svg)\b[^>]*>.*?</(?P=drawn)\s*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^<>]*>"
    r"|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)

# Fixed values of HTML: elements without content, elements inside a line, and which start tags end an open element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark math q s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
_SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"),
               "td": ("td", "th"), "th": ("td", "th")}
_SCOPES = frozenset("ul ol dl table select body html article aside section nav div form td".split())


@dataclass
class Block:
    path: tuple[tuple[str, str], ...]  # open elements: tag, and its class, id and role
    text: str
    link_chars: int


def _names(attrs: str) -> str:
    return " ".join(" ".join(filter(None, found)) for found in _ATTR.findall(attrs)) if "=" in attrs else ""


def _end(stack: list[tuple[str, str]], tags: tuple[str, ...]) -> None:
    """Close the nearest of the tags, if no other scope lies between."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in tags:
            del stack[i:]
            return
        if stack[i][0] in _SCOPES:
            return


def blocks_of(page: str) -> list[Block]:
    """The blocks that hold text, in page order."""
    blocks: list[Block] = []
    stack: list[tuple[str, str]] = []
    texts: list[str] = []
    state = {"links": 0, "in_link": 0}

    def take(text: str) -> None:
        if text:
            text = html.unescape(text) if "&" in text else text
            texts.append(text)
            if state["in_link"]:
                state["links"] += len(text.strip())

    def flush() -> None:
        if texts:
            joined = " ".join("".join(texts).split())
            if joined:
                # Elements inside a line are no ancestors of the block.
                path = tuple(x for x in stack if x[0] not in INLINE)
                blocks.append(Block(path, joined, state["links"]))
            texts.clear()
            state["links"] = 0

    at = 0
    for token in _TOKEN.finditer(page):
        take(page[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if tag is None:
            if token["raw"] or token["drawn"]:
                take(" ")
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                take(" ")
            elif tag == "a":
                state["in_link"] = 0 if token["close"] else 1
            continue
        flush()
        if token["close"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            state["in_link"] = 0
        elif tag not in VOID:
            if tag in _ENDS_P:
                _end(stack, ("p",))
            if tag in _SAME_LEVEL:
                _end(stack, _SAME_LEVEL[tag])
            if not token["attrs"].endswith("/"):
                stack.append((tag, _names(token["attrs"])))
    take(page[at:])
    flush()
    return blocks
