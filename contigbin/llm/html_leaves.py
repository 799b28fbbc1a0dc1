"""A web page as its sequence of leaf blocks, each with the path of elements around it.

A block is a run of text that no block-level element begins or ends in; inline
elements and line breaks stay inside. Tags may be unclosed, misnested or cut off: as in browsers a paragraph ends where
the next block begins, list items and table cells where the next one begins, and
stray end tags are passed over. Scripts, styles, controls, embedded objects and comments hold no text of the page.
"""

from __future__ import annotations

import functools
import re
import zlib
from html.parser import HTMLParser
from typing import NamedTuple

# Element names of HTML
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_PARAGRAPH = BLOCKS - frozenset("body caption dd dt frameset head html legend li optgroup option tbody td tfoot th thead tr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("audio button canvas iframe map math noframes noscript object script select style svg template textarea title video".split())
CELLS = frozenset("td th caption table".split())
#: An element of the first kind ends an open one of the second, unless one of the third lies between.
SIBLINGS = {
    "li": ("li", "ul ol menu dir table"), "dt": ("dt dd", "dl table"), "dd": ("dt dd", "dl table"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "thead": ("tbody thead tfoot", "table"), "tbody": ("tbody thead tfoot", "table"), "tfoot": ("tbody thead tfoot", "table"),
}
SIBLINGS = {tag: (frozenset(ends.split()), frozenset(fences.split())) for tag, (ends, fences) in SIBLINGS.items()}

PATH = 1536
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CUT = re.compile(r"<[a-zA-Z/!?]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block(NamedTuple):
    text: str
    path: frozenset[int]
    link_chars: int
    depth: int
    mark: str | None


def slots(token: str) -> tuple[int, int]:
    """Two places, so that tokens that share one still differ."""
    return zlib.crc32(token.encode()) % PATH, zlib.crc32(token[::-1].encode() + b"#") % PATH


@functools.lru_cache(maxsize=1 << 14)
def tokens(tag: str, names: str, hidden: bool) -> tuple[int, ...]:
    """Places of an element in the path vector: its tag, the words of its class, id and role, and the ends of longer words."""
    found = {f"<{tag}"}
    for word in map(str.lower, _PIECE.findall(names)):
        if len(word) > 1:
            found.add(f".{word}")
        if len(word) > 5:
            found |= {f"^{word[:4]}", f"${word[-4:]}"}
    if hidden:
        found.add("hidden")
    return tuple(sorted({k for token in found for k in slots(token)}))


class _Parser(HTMLParser):
    def __init__(self, mark: str | None):
        super().__init__(convert_charrefs=True)
        self.mark, self.stack, self.blocks = mark, [], []
        self.text, self.inline, self.links, self.link_chars = [], set(), 0, 0
        self.skipped = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            path = set(self.inline)
            for _, own, _, _ in self.stack:
                path.update(own)
            blocks = [e for e in self.stack if e[0] in BLOCKS]
            for k, e in enumerate(reversed(blocks[-2:])):
                path.update(slots(f"leaf {k} {e[0]}"))
            mark = next((m for *_, m in reversed(self.stack) if m is not None), None)
            self.blocks.append(Block(text, frozenset(path), self.link_chars, len(blocks), mark))
        self.text, self.inline, self.link_chars = [], set(), 0

    def pop_to(self, at: int) -> None:
        self.links -= sum(e[0] == "a" for e in self.stack[at:])
        del self.stack[at:]

    def last(self, ends: frozenset | set, fences: frozenset) -> int | None:
        for at in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[at][0]
            if tag in ends:
                return at
            if tag in fences:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if self.skipped:
            if tag not in VOID:
                self.skipped.append(tag)
            return
        if tag in SKIPPED:
            self.skipped.append(tag)
            return
        if tag in BLOCKS:
            self.flush()
            if tag in ENDS_PARAGRAPH and (at := self.last({"p"}, CELLS)) is not None:
                self.pop_to(at)
            if tag in SIBLINGS and (at := self.last(*SIBLINGS[tag])) is not None:
                self.pop_to(at)
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        given = dict(attrs)
        names = " ".join(given.get(k) or "" for k in ("class", "id", "role"))
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or bool(_HIDDEN.search(given.get("style") or ""))
        own = tokens(tag, names, hidden)
        self.stack.append((tag, own, hidden, given.get(self.mark) if self.mark else None))
        if tag not in BLOCKS:
            self.inline.update(own)
            self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        if tag in SKIPPED:
            return
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.skipped:
            if tag in self.skipped:
                del self.skipped[len(self.skipped) - 1 - self.skipped[::-1].index(tag) :]
                return
            if tag not in BLOCKS or not any(e[0] == tag for e in self.stack):
                return
            self.skipped = []  # the control was never closed
        if tag in BLOCKS:
            self.flush()
            if (at := self.last({tag}, CELLS - {tag} if tag not in ("table", "body", "html") else frozenset())) is not None:
                self.pop_to(at)
        else:
            if (at := self.last({tag}, BLOCKS)) is not None:
                self.links -= tag == "a"
                del self.stack[at]

    def handle_data(self, data):
        if not self.skipped:
            self.text.append(data)
            if self.links > 0:
                self.link_chars += len(data)


def leaves(html: str | None, mark: str | None = None) -> list[Block]:
    """The blocks of a page in order. ``mark``: an attribute whose nearest value each block reports (for labelled pages)."""
    parser = _Parser(mark)
    parser.feed(html or "")
    if _CUT.match(parser.rawdata):  # the page ends inside a tag or comment
        parser.rawdata = ""
    parser.close()
    parser.flush()
    return parser.blocks
