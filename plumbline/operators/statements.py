"""COBOL statements: a fold over characters that knows columns, literals and periods.

A file's characters run through one small state (is a literal open, and with which quote); what
comes out are statements (line, area A, text): sentences, which end at a period before a blank or
the end of a line, wherever their words are. Of fixed lines only columns 8 to 72 count: numbers
in 1 to 6 and 73 to 80 never do. A literal that a fixed line leaves open goes on after the quote
of the next line marked ``-``; a word goes on at the first character after the mark's blanks.

The data and procedure parsers read statements, and these into clauses by verbs (``verbs``), so
that an item over two lines, two items on one line, a paragraph with a statement on its line and
an OPEN of several files are what they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple


class Statement(NamedTuple):
    line: int  # from 0, of the first word
    area_a: bool  # whether that stands in columns 8 to 11 (of free lines: within 4 columns)
    text: str  # words with one blank between; literals as written


def is_fixed(lines: list[str]) -> bool:
    """Whether at least half of the lines that are not blank have a fixed format's column 7: a
    comment or continuation mark, or a blank before more text."""
    seen = [x for x in lines if x.strip()]
    marked = sum(x[6:7] in ("*", "/", "-") and x[6:7] != "" or (x[6:7] == " " and len(x) > 7) for x in seen)
    return bool(seen) and 2 * marked >= len(seen)


def _areas(content: str) -> Iterator[tuple[int, bool, str]]:
    """(number, whether it continues the line before, text) of lines with text."""
    raw = content.replace("\r", "").replace("\t", "    ").split("\n")
    fixed = is_fixed(raw)
    for i, x in enumerate(raw):
        if not fixed:
            yield i, False, x.rstrip()
        elif x[6:7] not in ("*", "/", "D", "d"):
            text = x[7:72].rstrip()
            if text.strip() or x[6:7] == "-":
                yield i, x[6:7] == "-", text


def _cut_comment(text: str, quote: str) -> str:
    """A line up to ``*>`` outside of literals; ``quote`` is the literal that is open before it."""
    if "*>" not in text:
        return text
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "*" and text[i + 1 : i + 2] == ">":
            return text[:i]
    return text


#: Characters that a statement takes as they are.
_RUN = re.compile(r"[^'\" \t,;.]+")
_ODD = re.compile(r"['\"\t,;]|\. ")


def statements(content: str) -> list[Statement]:
    out: list[Statement] = []
    words: list[str] = []
    first: tuple[int, bool] | None = None
    quote, glued = "", False

    def close() -> None:
        nonlocal first, words
        text = "".join(words).strip()
        if text and first is not None:
            out.append(Statement(first[0], first[1], text))
        first, words = None, []

    for number, more, text in _areas(content):
        text = _cut_comment(text, "" if more else quote)
        if more:
            text = text.lstrip()
            if quote and text[:1] == quote:
                text = text[1:]
            glued = True
        else:
            quote = ""  # a literal without an end closes with its line
        if words and not glued:
            words.append(" ")
        glued = False
        if not quote and not _ODD.search(text):  # words, and at most a period at the end
            body = text[:-1] if text[-1:] == "." else text
            lead = len(body) - len(body.lstrip(" "))
            if lead and words and words[-1][-1] != " ":
                words.append(" ")
            if said := " ".join([w for w in body.split(" ") if w]):
                first = first or (number, lead <= 3)
                words.append(said + " " if body[-1] == " " else said)
            if body is not text and first is not None:
                close()
            continue
        i = 0
        while i < len(text):
            if quote:
                end = text.find(quote, i) + 1 or len(text)
                words.append(text[i:end])
                quote = "" if text[end - 1] == quote else quote
                i = end
                continue
            if run := _RUN.match(text, i):
                if first is None:
                    first = (number, i <= 3)
                words.append(run[0])
                i = run.end()
                continue
            c, last = text[i], text[i + 1 : i + 2] in ("", " ")
            i += 1
            if c in " \t,;" and (c not in ",;" or last):
                if words and words[-1][-1] != " ":
                    words.append(" ")
            elif c == "." and last:
                if first is not None:
                    close()
            else:
                if c in "'\"":
                    quote = c
                if first is None:
                    first = (number, i <= 4)
                words.append(c)
    close()
    return out


#: Words that begin a statement of the procedure division.
VERBS = frozenset(
    """ACCEPT ADD ALTER CALL CANCEL CLOSE COMPUTE CONTINUE COPY DELETE DISPLAY DIVIDE ELSE ENTRY EVALUATE EXEC EXIT GO GOBACK IF INITIALIZE INSPECT INVOKE MERGE MOVE MULTIPLY OPEN PERFORM READ
    RELEASE RETURN REWRITE SEARCH SET SORT START STOP STRING SUBTRACT UNSTRING WHEN WRITE""".split()
)
_WORD = re.compile(r"'[^']*'?|\"[^\"]*\"?|[^\s]+")


def words(text: str) -> list[str]:
    """The words of a statement; a literal is one, with its quotes."""
    return _WORD.findall(text)


def verbs(text: str) -> Iterator[tuple[str, list[str]]]:
    """(verb, its words after it) of a sentence's statements in order. An EXEC block is one, up to
    its END-EXEC; GO needs a TO or a name after it."""
    verb, held, block = "", [], False
    for w in words(text):
        upper = w.upper()
        if block:
            if upper == "END-EXEC":
                yield verb, held
                verb, held, block = "", [], False
            else:
                held.append(w)
        elif upper in VERBS:
            if verb:
                yield verb, held
            verb, held, block = upper, [], upper == "EXEC"
        elif upper.startswith("END-") and upper[4:] in VERBS:
            if verb:
                yield verb, held
            verb, held = "", []
        elif verb:
            held.append(w)
    if verb:
        yield verb, held
