"""HTML as a list of events, for the extraction of main text.

``events`` reads a page in one pass and builds the elements' tree as browsers do in the cases that
pages hold: void elements, ends that may be left out (p, li, table parts), ends of inline elements
across blocks, raw text of scripts. Positions of open elements are kept by name, so each tag costs
the same whatever its depth.
"""

from __future__ import annotations

import re
from collections import defaultdict

# Names that HTML gives a meaning.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACED = frozenset("br td th".split())
#: An opening tag ends an open element of the first names unless one of the second is open within it.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "body": (("head",), ()),
}
P_KEEPS = ("td", "th", "button", "object", "caption")

TEXT, OPEN, CLOSE = 0, 1, 2
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Page:
    """Elements as parallel lists (name, attributes as text, parent's number) and events (kind,
    element, text of a TEXT event)."""

    def __init__(self, html: str):
        self.names, self.attributes, self.parents = ["#page"], [""], [-1]
        self.events: list[tuple[int, int, str]] = []
        self._stack = [0]
        self._open: dict[str, list[int]] = defaultdict(list)
        self._blocks = [0]
        self._read(html)
        while len(self._stack) > 1:
            self._pop()

    def attribute(self, element: int, *names: str) -> dict[str, str]:
        found = {}
        if self.attributes[element]:
            for m in _ATTRIBUTE.finditer(self.attributes[element]):
                name = m[1].lower()
                if name in names and name not in found:
                    found[name] = m[2] or m[3] or m[4] or ""
        return found

    def _pop(self) -> None:
        element = self._stack.pop()
        at, name = len(self._stack), self.names[element]
        self._open[name].pop()
        if self._blocks[-1] == at:
            self._blocks.pop()
        self.events.append((CLOSE, element, ""))

    def _pop_to(self, position: int) -> None:
        while len(self._stack) > position:
            self._pop()

    def _last(self, *names: str) -> int:
        return max((self._open[n][-1] for n in names if self._open[n]), default=-1)

    def _start(self, name: str, attributes: str) -> None:
        if name in ENDS:
            own, within = ENDS[name]
            at = self._last(*own)
            if at > self._last(*within):
                self._pop_to(at)
        if name in BLOCK and self._open["p"] and self._open["p"][-1] > self._last(*P_KEEPS):
            self._pop_to(self._open["p"][-1])
        element = len(self.names)
        self.names.append(name)
        self.attributes.append(attributes)
        self.parents.append(self._stack[-1])
        self.events.append((OPEN, element, ""))
        if name in VOID:
            self.events.append((CLOSE, element, ""))
            return
        self._open[name].append(len(self._stack))
        if name in BLOCK:
            self._blocks.append(len(self._stack))
        self._stack.append(element)

    def _end(self, name: str) -> None:
        at = self._open[name][-1] if self._open[name] else -1
        if at > 0 and (name in BLOCK or name in P_KEEPS or at > self._blocks[-1]):
            self._pop_to(at)

    def _text(self, text: str) -> None:
        if text:
            self.events.append((TEXT, self._stack[-1], text))

    def _read(self, html: str) -> None:
        at, end, loose = 0, len(html), False
        while at < end:
            tag = html.find("<", at)
            if tag < 0:
                self._text(html[at:])
                return
            mark = html[tag + 1 : tag + 2]
            if mark in ("!", "?"):
                self._text(html[at:tag])
                comment = html.startswith("<!--", tag)
                close = html.find("-->" if comment else ">", tag + 2)
                at = end if close < 0 else close + (3 if comment else 1)
                continue
            m = _NAME.match(html, tag + 1)
            if not m:
                self._text(html[at : tag + 1])
                at = tag + 1
                continue
            self._text(html[at:tag])
            rest = None if loose else _REST.match(html, m.end())
            if rest:
                close = rest.end()
            else:  # a quote that is never closed: from here on tags end at the next >
                loose, close = True, html.find(">", m.end()) + 1
                if not close:
                    return
            name, at = m[1].lower(), close
            if html[tag + 1] == "/":
                self._end(name)
                continue
            self._start(name, html[m.end() : close - 1])
            if name in RAW:
                found = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(html, at)
                if not found:
                    return
                at = found.start()
