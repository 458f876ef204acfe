"""Leaf blocks of an HTML page: runs of text between block-level tags, with the open elements above them."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\s+[^\s=>]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']*))?|[^>])*?)>"
    r"|<[!?/][^>]*>"
    r"|[^<]+|<",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']*)))?")
MAY_HIDE = re.compile(r"hidden|display", re.I)  # most attributes need no closer look
NONE = re.compile(r"display\s*:\s*none", re.I)
NAME = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
HUMP = re.compile(r"([a-z])([A-Z])")
APART = re.compile(r"[^a-z\s]+")

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())  # hold no tags: all up to the end tag is theirs
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
DROPPED = frozenset("svg select button object noscript template annotation annotation-xml".split())  # their text is no page text
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPTIONAL = frozenset("p li dt dd option optgroup tr td th thead tbody tfoot".split())  # often without end tags
#: An opening tag ends these open elements, up to a container.
ENDS = {
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


class Block(NamedTuple):
    text: str
    path: tuple[tuple[str, str], ...]  # (tag, words of class, id and role) from the outermost element
    linked: int  # characters of the text inside links


def _clean(runs: list[str]) -> str:
    return " ".join("".join(runs).split())


def _hides(attrs: str) -> bool:
    """Whether an element has the attribute hidden or the style display: none."""
    if not MAY_HIDE.search(attrs):
        return False
    found = [(name.lower(), a or b or c) for name, a, b, c in ATTRIBUTE.findall(attrs)]
    return any(name == "hidden" or name == "style" and NONE.search(value) for name, value in found)


def _inside(page: str, tag: str, at: int) -> int:
    """Where the end tag begins of an element that began before ``at``; -1 if it has none before the next such element or the end of what holds it."""
    open_blocks = {False: 0, True: 0}  # those whose end tag is optional apart
    for m in NAME.finditer(page, at):
        name = (m[2] or "").lower()
        if name == tag:
            return m.start() if m[1] else -1
        if name in BLOCKS:
            open_blocks[name in OPTIONAL] += -1 if m[1] else 1
            if min(open_blocks.values()) < 0:
                return -1
    return -1


def blocks(page: str) -> list[Block]:
    """Non-empty leaf blocks in page order. Broken markup never fails: what can't be read as a tag is text."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    runs: list[str] = []
    linked: list[str] = []
    links = hidden = dropped = at = 0

    def flush() -> None:
        if runs:
            if (text := _clean(runs)) and not hidden:
                out.append(Block(text, tuple(x for x in stack if x[0] in BLOCKS), len(_clean(linked))))
            runs.clear()
            linked.clear()

    def pop(depth: int) -> None:
        nonlocal links, hidden, dropped
        for tag, names in stack[depth:]:
            links -= tag == "a"
            dropped -= tag in DROPPED
            hidden -= names.endswith("\0")
        del stack[depth:]

    while m := TOKEN.match(page, at):
        at = m.end()
        tag = m["tag"]
        if tag is None:
            piece = m[0]
            if (piece[0] != "<" or piece == "<") and not dropped:
                runs.append(decoded := html.unescape(piece) if "&" in piece else piece)
                if links:
                    linked.append(decoded)
            continue
        tag = tag.lower()
        if tag in RAW and not m["close"] and not (dropped and m["attrs"].endswith("/")):
            if tag == "title":
                flush()
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in DROPPED and not m["close"] and not m["attrs"].endswith("/") and (end := _inside(page, tag, at)) >= 0:
            at = page.find(">", end) + 1 or len(page)
            continue
        if tag == "br":
            runs.append(" ")
            continue
        block = tag in BLOCKS
        if block:
            flush()
            if dropped and tag not in {"option", "optgroup"}:  # one without end tag reaches up to the next block
                pop(next(depth for depth, x in enumerate(stack) if x[0] in DROPPED))
        if m["close"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    pop(depth)
                    break
                if not block and stack[depth][0] in BLOCKS:
                    break  # an inline end tag closes nothing outside its block
            continue
        ended, within = ENDS.get(tag, ({"p"}, set()) if block else (set(), set()))
        if ended:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in within or (not within and stack[depth][0] in BLOCKS and stack[depth][0] != "p"):
                    break
                if stack[depth][0] in ended:
                    pop(depth)
                    if not within:
                        break
        if tag in VOID or m["attrs"].endswith("/") and not block:
            continue
        attrs = m["attrs"]
        names = ""
        if attrs:
            found = " ".join(a or b or c for a, b, c in NAMED.findall(attrs))
            names = " ".join(APART.sub("-", HUMP.sub(r"\1-\2", found).lower()).split()) if found else ""
            if _hides(attrs):
                names += "\0"
                hidden += 1
        stack.append((tag, names))
        links += tag == "a"
        dropped += tag in DROPPED
    flush()
    return out
