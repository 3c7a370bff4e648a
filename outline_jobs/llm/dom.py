"""Tag soup -> blocks. A small reader of HTML that gives each block element its place in the tree, its own text and its attributes."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

# Element names of the HTML standard by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template iframe object svg canvas audio video head title select textarea button datalist".split())
RAW = frozenset("script style noscript template iframe svg title textarea".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag of the first kind ends an open element of the second, but not beyond one of the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
SCOPE = frozenset("html body table td th caption button".split())
#: End tags go no further up than an open element of WALLS, but for those of THROUGH.
WALLS, THROUGH = ("td", "th", "table"), frozenset("table tr tbody thead tfoot body html div article section main".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


@dataclass
class Block:
    tag: str
    parent: int
    depth: int
    attrs: dict[str, str]
    chars: int = 0
    linked: int = 0
    text: list[str] = field(default_factory=list)
    runs: int = 0
    inputs: int = 0
    children: int = 0


def read(page: str | None) -> tuple[list[Block], list[tuple[int, str]]]:
    """(blocks, runs): runs are (block, text) in page order, character references decoded and white space joined."""
    page = (page or "").replace("\x00", "")
    blocks = [Block("html", -1, 0, {})]
    runs: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements, each with its block
    places: dict[str, list[int]] = defaultdict(list)  # of each tag, where it is open in the stack, so that no depth is searched through
    parts: list[str] = []
    skip, links, at = 0, 0, 0

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def text(raw: str) -> None:
        if skip or not raw:
            return
        raw = html.unescape(raw)
        parts.append(raw)
        if links:
            blocks[stack[-1][1]].linked += len(raw.split()) and len(raw.strip())

    def flush() -> None:
        joined = " ".join("".join(parts).split())
        parts.clear()
        if joined:
            b = stack[-1][1]
            blocks[b].chars += len(joined)
            blocks[b].text.append(joined)
            blocks[b].runs += 1
            runs.append((b, joined))

    def close(k: int) -> None:
        """Ends the open elements from place k on."""
        nonlocal skip, links
        if any(t in BLOCKS for t, _ in stack[k:]):
            flush()
        for t, _ in stack[k:]:
            places[t].pop()
            skip -= t in SKIPPED
            links -= t == "a"
        del stack[k:]

    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        end, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if not m[0].endswith(">"):
            break  # the page ends within a tag
        if end:
            k = last((tag,))
            if k and (tag in THROUGH or k >= last(WALLS)):
                close(k)
            continue
        if tag in ("html", "body") and places[tag]:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = page.find(">", stop.start()) + 1 or len(page) if stop else len(page)
            continue
        if tag in BLOCKS or tag == "body":
            if places["head"] and (tag == "body" or stack[-1][0] == "head"):
                close(places["head"][0])
            ended, wall = ENDS.get(tag, ((), SCOPE))
            while (k := last(("p", *ended))) > last(wall):
                more = stack[k][0] == "p" and tag in ENDS
                close(k)
                if not more:
                    break
            flush()
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "input":
                blocks[stack[-1][1]].inputs += 1
            continue
        own = stack[-1][1]
        if tag in BLOCKS and tag != "html":
            found = {a.lower(): html.unescape(b or c or d or "") for a, b, c, d in _ATTR.findall(attrs)}
            blocks[own].children += 1
            blocks.append(Block(tag, own, blocks[own].depth + 1, found))
            own = len(blocks) - 1
        if attrs.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        if tag in ("button", "select"):
            blocks[own].inputs += 1
        places[tag].append(len(stack))
        stack.append((tag, own))
        skip += tag in SKIPPED
        links += tag == "a"
    else:
        text(page[at:])
    flush()
    return blocks, runs
