"""Perl source as code: a fold over characters that knows quotes, regular expressions, here
documents, comments and POD, so that braces and calls count only where they are code.

``code_lines`` gives each line twice: as written without comments (``kept``), and with every
literal as ``''`` (``bare``). Quote-like operators take any delimiter, brackets nest, ``s``, ``tr`` and
``y`` have two parts; literals, here documents and POD go on over lines.
"""

from __future__ import annotations

import re
from functools import cache
from typing import NamedTuple


class Line(NamedTuple):
    kept: str
    bare: str


_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}
_QUOTE = re.compile(r"(?<![\w$@%&>\-{])(q[qwxr]?|m|s|tr|y)\b(?!\s*(?:=>|,|;|\)))(\s*)([^\w\s]|(?<=\s)\w)")
_HEREDOC = re.compile(r"<<(~?)(?:([A-Za-z_]\w*)|\"([^\"]*)\"|'([^']*)')")
#: Words after which a slash begins a pattern.
_BEFORE_PATTERN = frozenset("and or not xor if unless while until return split grep map join x lt gt le ge eq ne cmp push unshift when".split())


#: What is code without a look at it: words that begin no quote, and all but marks.
_PLAIN = re.compile(r"(?:[^\w#'\"`/<]|[^\Wqmsty]\w*)+")
_WORD = re.compile(r"\w+")


@cache
def _inside(close: str, open_: str) -> re.Pattern:
    """A run inside a literal that neither ends nor nests it, without a backslash."""
    return re.compile(f"[^\\\\{re.escape(close)}{re.escape(open_)}]+")


def _pattern_may_begin(code: str) -> bool:
    """Whether a slash after this code begins a pattern; else it divides."""
    code = code.rstrip()
    if not code or code[-1] in "=(,{[!~&|;:?+-*<>.":
        return True
    word = re.search(r"(?<![$@%&>\w])(\w+)$", code)
    return bool(word) and word[1] in _BEFORE_PATTERN


def code_lines(content: str) -> list[Line]:
    out: list[Line] = []
    docs: list[tuple[str, bool]] = []  # here documents to come: their end and whether it may be indented
    close, open_, depth, parts, pod = "", "", 0, 0, False
    for raw in content.replace("\r", "").split("\n"):
        if docs:
            end, indented = docs[0]
            if (raw.strip() if indented else raw) == end:
                docs.pop(0)
            out.append(Line("", ""))
            continue
        if not close and (pod or re.match(r"=[A-Za-z]", raw)):
            pod = not raw.startswith("=cut")
            out.append(Line("", ""))
            continue
        if not close and re.match(r"__(END|DATA)__\s*$", raw):
            break
        kept, bare, i = [], [], 0
        while i < len(raw):
            if run := (_inside(close, open_) if close else _PLAIN).match(raw, i):
                kept.append(run[0])
                if not close:
                    bare.append(run[0])
                i = run.end()
                continue
            c = raw[i]
            if close:
                kept.append(c)
                if c == "\\" and i + 1 < len(raw):
                    kept.append(raw[i + 1])
                    i += 2
                    continue
                if open_ and c == open_:
                    depth += 1
                elif c == close:
                    if open_ and depth:
                        depth -= 1
                    elif parts:
                        parts -= 1
                        if open_:  # the second part has delimiters of its own
                            j = i + 1
                            while j < len(raw) and raw[j].isspace():
                                j += 1
                            if j < len(raw):
                                kept.append(raw[i + 1 : j + 1])
                                open_ = raw[j] if raw[j] in _PAIRS else ""
                                close, i = _PAIRS.get(raw[j], raw[j]), j
                    else:
                        close = open_ = ""
                i += 1
                continue
            quoted = _QUOTE.match(raw, i) if c in "qmsty" else None
            if c in "qmsty" and not quoted:
                word = _WORD.match(raw, i)
                kept.append(word[0])
                bare.append(word[0])
                i = word.end()
                continue
            code = "".join(bare)
            if c == "#" and (not code or code[-1] not in "$@{"):
                break
            if quoted and (quoted[3] != "#" or not quoted[2]) and not re.search(r"(->|sub\s+)$", code):
                kept.append(quoted[0])
                bare.append("''")
                open_ = quoted[3] if quoted[3] in _PAIRS else ""
                close, depth, parts = _PAIRS.get(quoted[3], quoted[3]), 0, int(quoted[1] in ("s", "tr", "y"))
                i = quoted.end()
                continue
            if c in "'\"`" and not (c == "'" and re.search(r"\w$", code) and re.match(r"'\w", raw[i:])):
                kept.append(c)
                bare.append("''")
                open_, close, depth, parts = "", c, 0, 0
            elif c == "/" and _pattern_may_begin(code):
                kept.append(c)
                bare.append("''")
                open_, close, depth, parts = "", "/", 0, 0
            elif c == "<" and (m := _HEREDOC.match(raw, i)) and not re.search(r"[\w)\]}$]\s*$", code):
                docs.append((next(x for x in (m[2], m[3], m[4], "") if x is not None), bool(m[1])))
                kept.append(m[0])
                bare.append("''")
                i = m.end()
                continue
            else:
                kept.append(c)
                bare.append(c)
            i += 1
        out.append(Line("".join(kept), "".join(bare)))
    return out
