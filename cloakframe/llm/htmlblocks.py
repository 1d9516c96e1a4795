"""HTML into leaf blocks: their tag path, their text and what of it is in links."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<close2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""",
    re.DOTALL,
)
ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
#: A slash that ends a tag; after an unquoted value it belongs to the value.
SLASH = re.compile(r"""(?:^|[\s"']|^[^=]*|\s[^=\s]*)/\Z""")
NAMES = re.compile(r"[a-z]+")

#: Elements that begin and end a block, by the HTML standard's list of block elements and table parts.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
#: Elements without text of their own.
RAW = frozenset("script style noscript template svg annotation annotation-xml iframe object textarea canvas noembed noframes xmp".split())
#: Elements of XML content, which a slash closes; in others it closes nothing, as in browsers.
FOREIGN = frozenset("svg math annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the key ends an open element of the value, up to the nearest container.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head", "title")}
CONTAINERS = frozenset("ul ol menu dl table tbody thead tfoot select html".split())


#: Steps of its path that a block keeps: the work a block costs doesn't grow with the nesting around it.
STEPS = 16


class Block(NamedTuple):
    #: The last steps of the path, and how many there are in all.
    path: tuple[str, ...]
    depth: int
    text: str
    link_chars: int


def signature(name: str, attrs: str) -> str:
    """A path step: the tag, and the letters of its class, id and role."""
    if "=" not in attrs:
        return name
    words = [w for m in ATTR.finditer(attrs) for w in NAMES.findall((m[1] or m[2] or m[3] or "").lower())]
    return " ".join([name, *words])


def blocks(html: str | None) -> list[Block]:
    """The page's blocks of text, in order. White space is collapsed, character references are decoded once.

    Comments, scripts, styles and other raw elements are left out. Any input
    gives a result: unclosed and stray tags are taken as browsers mostly do. The
    time is in proportion to the page, however deep it nests.
    """
    html = html or ""
    found: list[Block] = []
    stack: list[tuple[str, str]] = []
    count: Counter[str] = Counter()  # of the open elements, by name
    pieces: list[str] = []
    links = link_depth = 0
    at = 0

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(pieces).split())
        if text:
            found.append(Block(tuple(s for _, s in stack[-STEPS:]), len(stack), text, links))
        pieces.clear()
        links = 0

    def say(raw: str) -> None:
        nonlocal links
        text = unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if link_depth:
            links += len(text.strip())

    def close_to(index: int) -> None:
        nonlocal link_depth
        for name, _ in stack[index:]:
            link_depth -= name == "a"
            count[name] -= 1
        del stack[index:]

    while m := MARKUP.search(html, at):
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["close"] or m["close2"]:
            if name in BLOCKS:
                flush()
            if count[name]:
                close_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if name in FOREIGN and SLASH.search(attrs):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name == "br":
            pieces.append(" ")
        if name in BLOCKS:
            flush()
            wanted = (*ENDS.get(name, ()), "p")
            if any(count[w] for w in wanted):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in CONTAINERS and name not in ("tr", "body"):
                        break
                    if stack[i][0] in wanted:
                        close_to(i)
                        if not any(count[w] for w in wanted):
                            break
        if name not in VOID and not (name not in BLOCKS and SLASH.search(attrs) and count["math"]):
            stack.append((name, signature(name, attrs)))
            count[name] += 1
            link_depth += name == "a"
    say(html[at:])
    flush()
    return found
