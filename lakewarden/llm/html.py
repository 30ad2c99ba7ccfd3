"""Tokens of HTML pages, in time that grows with the page whatever is broken in it.

A tag ends at the first > that stands in no quoted attribute value. Where a comment, a tag or a skipped element is never closed, its
opening alone is dropped or taken as text, and the search for an end that is not there is not repeated.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
VALUE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
BLOCKS = frozenset("address article aside blockquote body br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th title tr ul".split())
Token = tuple[str, str, str]


def attributes(inside: str) -> dict[str, str]:
    """Of what a start tag holds: names, in lower case, to values; the first of a name counts."""
    out: dict[str, str] = {}
    for found in VALUE.finditer(inside):
        out.setdefault(found[1].lower(), html.unescape(found[2] or found[3] or found[4] or ""))
    return out


class _Page:
    """A page, and what it is known to have no more of."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.none: set[str] = set()

    def find(self, what: str, at: int) -> int:
        """Where a string comes next, or -1; once it has not been found it is not looked for again."""
        place = -1 if what in self.none else self.text.find(what, at)
        if place < 0:
            self.none.add(what)
        return place

    def end_of_tag(self, at: int) -> int:
        """The > of a tag whose name ends at a place, or -1."""
        low = at
        while "quoted" not in self.none and (stop := STOP.search(self.text, low)):
            place = stop.start()
            if stop[0] == ">":
                return place
            low = place + 1
            if self.text[at:place].rstrip()[-1:] == "=" if place - at < 64 else self.text[place - 64 : place].rstrip()[-1:] == "=":
                close = self.find(stop[0], low)
                if close < 0:
                    break
                low = close + 1
        self.none.add("quoted")  # from here on quotes do not count
        return self.find(">", at)

    def close(self, tag: str, at: int) -> re.Match | None:
        """The end tag of an element."""
        found = None if f"</{tag}" in self.none else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(self.text, at)
        if not found:
            self.none.add(f"</{tag}")
        return found


def tokens(text: str, skip: tuple[str, ...] = ("script", "style")) -> Iterator[Token]:
    """(text, its characters, ''), (start, tag, what else the tag holds) and (end, tag, ''), in order. What is inside elements to skip is left out."""
    page, at, said = _Page(text), 0, 0

    def between(low: int, high: int) -> Iterator[Token]:
        if low < high:
            yield "text", html.unescape(text[low:high]), ""

    while (open_ := page.find("<", at)) >= 0:
        after = text[open_ + 1 : open_ + 2]
        if text.startswith("<!--", open_):
            end = page.find("-->", open_ + 4)
            close = end + 3 if end >= 0 else open_ + 4
            yield from between(said, open_)
        elif after in ("!", "?"):
            end = page.find(">", open_)
            close = end + 1
            if end < 0:
                at = open_ + 1
                continue
            yield from between(said, open_)
        elif (name := NAME.match(text, open_ + 1)) is None or (end := page.end_of_tag(name.end())) < 0:
            at = open_ + 1
            continue
        else:
            yield from between(said, open_)
            tag, close = name[2].lower(), end + 1
            if name[1]:
                yield "end", tag, ""
            else:
                yield "start", tag, text[name.end() : end]
                if tag in skip and (found := page.close(tag, close)):
                    yield "end", tag, ""
                    close = found.end()
        at = said = close
    yield from between(said, len(text))
