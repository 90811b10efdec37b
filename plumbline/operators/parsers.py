"""Source text to records: COBOL, Perl and Fortran.

A file is one row (path, content); its lines are folded in ``mapInArrow``, because levels, braces
and nesting are stacks. Each parser is a generator of (record, name, parent, detail) rows; what
needs other files (copybook types, imported variables, parameter types) is a join on the records.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .perl_code import Line, code_lines
from .statements import VERBS, Statement, is_fixed, statements, verbs  # noqa: F401
from .storage import kept, scratch

Row = tuple[str, str, str, str]
#: Words that are no paragraph names, Perl's own functions and modules.
KEYWORDS = set("IF ELSE END-IF PERFORM MOVE ADD SUBTRACT MULTIPLY DIVIDE COMPUTE DISPLAY ACCEPT READ WRITE OPEN CLOSE EVALUATE END-EVALUATE WHEN SEARCH SET GO STOP EXIT INITIALIZE STRING UNSTRING INSPECT CALL EXEC END-EXEC COPY REPLACING WORKING-STORAGE FILE LINKAGE LOCAL-STORAGE".split())
BUILTINS = set("print printf say warn die open close read write seek chomp chop split join substr length defined exists delete push pop shift unshift keys values each grep map sort reverse sprintf localtime gmtime time sleep eval require use package if unless while until for foreach do return next last redo goto sub my our local new bless ref isa".split())
CORE_MODULES = set("strict warnings vars Carp Exporter base parent constant lib utf8 Data::Dumper Storable Scalar::Util List::Util File::Spec File::Path IO::File IO::Handle".split())
FRAMEWORKS = ("Moose::Role", "Moo::Role", "Moose", "Moo", "Mouse")


def picture(pic: str) -> tuple[str, int, int]:
    """(kind, size, scale) of a PIC clause."""
    flat = re.sub(r"([SV9AX])\((\d+)\)", lambda m: m[1] * int(m[2]), pic.upper().rstrip("."))
    if "X" in flat or "A" in flat:
        return "string", flat.count("X") + flat.count("A"), 0
    whole, _, part = flat.partition("V")
    n, scale = whole.count("9"), part.count("9")
    return ("decimal", n + scale, scale) if "V" in flat else ("integer", n, 0)


# ---- COBOL ----------------------------------------------------------------------------


def _exec_block(said: list[str]) -> Iterator[tuple[str, str]]:
    """(name, kind:direction) of the words of an EXEC block."""
    block = [w.upper() for w in said]
    if block[:1] == ["SQL"]:
        yield (block[1] if len(block) > 1 else ""), "sql:" + ("write" if {"INSERT", "UPDATE", "DELETE"} & set(block) else "read")
    elif block[:1] == ["CICS"]:
        verb = re.split(r"\(", block[1])[0] if len(block) > 1 else ""
        yield verb, "cics:" + {"SEND": "write", "RECEIVE": "read"}.get(verb, "readwrite")


def _level(text: str, stack: list) -> Row | None:
    """The data item of a statement, under the items that are open."""
    m = re.match(r"(\d{1,2})(?:\s+([\w-]+))?(.*)", re.sub(r"'[^']*'?|\"[^\"]*\"?", "''", text))
    if not m:
        return None
    level, name, rest = int(m[1]), m[2] or "FILLER", m[3]
    if name.upper() in _CLAUSES:
        name, rest = "FILLER", f" {name}{rest}"
    if level in (1, 77, 66):
        stack.clear()
    while stack and stack[-1][0] >= level:
        stack.pop()
    pic = re.search(r"(?i)\bPIC(?:TURE)?\s+(?:IS\s+)?([SV9AX0-9()\-.]+)", rest)
    if pic:
        kind, size, scale = picture(pic[1])
    else:
        binary = re.search(r"(?i)\b(COMP(-[1-5])?|BINARY)\b", rest)
        kind, size, scale = ({88: "boolean", 66: "unknown"}.get(level) or ("integer" if binary else "struct")), 0, 0
    if (o := re.search(r"(?i)\bOCCURS\s+(\d+)", rest)) and kind != "struct":
        kind = f"array<{kind}>x{o[1]}"
    made = ("data_type", name, stack[-1][1] if stack else "", f"{kind}({size},{scale})")
    if level not in (66, 88):
        stack.append((level, name))
    return made


#: Clauses that may stand in a name's place; what opens files in which way, and words beside them.
_CLAUSES = frozenset("PIC PICTURE REDEFINES OCCURS VALUE USAGE COMP BINARY".split())
_MODES = {"INPUT": "read", "OUTPUT": "write", "EXTEND": "write", "I-O": "readwrite"}
_BESIDE = frozenset("WITH NO REWIND LOCK REVERSED FOR REMOVAL REEL UNIT SHARING ALL OTHER".split())
_INLINE = frozenset("UNTIL VARYING WITH TEST FOREVER".split())


def _acts(verb: str, said: list[str]) -> Iterator[tuple[str, str, str]]:
    """(record, name, detail) of a statement."""
    bare = [w.strip("'\"").rstrip(",") for w in said]
    upper = [w.upper() for w in bare]
    if verb == "PERFORM" and bare and upper[0] not in _INLINE and not bare[0].isdigit() and upper[1:2] != ["TIMES"]:
        yield "call", bare[0], "perform"
    elif verb == "CALL" and bare:
        yield "call", bare[0], "call"
    elif verb == "GO":
        names = bare[1:] if upper[:1] == ["TO"] else bare
        for i, name in enumerate(names):
            if name.upper() in ("DEPENDING", "ON"):
                break
            if i == 0 or "DEPENDING" in upper:
                yield "call", name, "goto"
    elif verb == "DISPLAY":
        yield "io", "", "display:write"
    elif verb in ("READ", "WRITE") and bare:
        yield "io", bare[0], f"{verb.lower()}:{verb.lower()}"
    elif verb == "OPEN":
        way = "read"
        for name in bare:
            if name.upper() in _MODES:
                way = _MODES[name.upper()]
            elif name.upper() not in _BESIDE:
                yield "io", name, f"open:{way}"
    elif verb == "CLOSE":
        for name in bare:
            if name.upper() not in _BESIDE:
                yield "io", name, "close:readwrite"
    elif verb == "EXEC":
        for name, detail in _exec_block(said):
            yield "io", name, detail


def _header(s: Statement) -> tuple[str, str] | None:
    """(name, paragraph or section) of a statement that is a header: one word in area A."""
    said = s.text.split()
    kind = "section" if len(said) in (2, 3) and said[1].upper() == "SECTION" else "paragraph" if len(said) == 1 else ""
    name = said[0].upper() if said else ""
    known = name in KEYWORDS or name in VERBS or name.startswith("END-") or name == "DECLARATIVES"
    return (said[0], kind) if kind and s.area_a and not known and re.fullmatch(r"[\w-]+", name) else None


def cobol(path: str, content: str) -> Iterator[Row]:
    """A program, or a copybook: a file without a division is data from its first line."""
    found = statements(content)
    base = path.rsplit("/", 1)[-1].split(".")[0]
    program, divided = base, False
    for i, s in enumerate(found):
        if m := re.match(r"(?i)PROGRAM-ID\b\s*([\w-]+)?", s.text):
            program = m[1] or (found[i + 1].text.split()[0].strip("'\"") if i + 1 < len(found) else base)
            break
    divided = any(re.match(r"(?i)[\w-]+\s+DIVISION\b", s.text) for s in found)
    yield "module", program, "", "cobol" if divided or not path.lower().endswith(".cpy") else "copybook"
    part, fn, stack = ("" if divided else "DATA"), "", []
    for s in found:
        if m := re.match(r"(?i)([\w-]+)\s+DIVISION\b", s.text):
            part = m[1].upper()
        elif part == "DATA":
            if (m := re.search(r"(?i)\bCOPY\s+['\"]?([\w-]+)", s.text)) and not s.text[:1].isdigit():
                yield "dependency", m[1].upper(), program, "copy"
            elif row := _level(s.text, stack):
                yield row
        elif part == "PROCEDURE":
            if header := _header(s):
                fn = header[0]
                yield "function", fn, program, header[1]
                continue
            for verb, said in verbs(s.text):
                for record, name, detail in _acts(verb, said):
                    yield record, name, fn, detail


def constructs(path: str, content: str) -> Iterator[Row]:
    """COBOL constructs that tell how involved a paragraph is."""
    fn = ""
    for s in statements(content):
        if header := _header(s):
            fn = header[0]
            continue
        for verb, said in verbs(s.text) if fn else ():
            first = said[0].upper() if said else ""
            kind = f"exec_{first.lower()}" if verb == "EXEC" else {"EVALUATE": "evaluate", "GO": "goto", "WHEN": "when" if first != "OTHER" else ""}.get(verb, "")
            if kind in ("exec_cics", "exec_sql", "evaluate", "when", "goto"):
                yield "construct", kind, fn, ""


# ---- Perl -----------------------------------------------------------------------------


def perl_parameters(signature: str | None, body: list[str]) -> Iterator[tuple[str, str]]:
    """(name, kind) of a sub's parameters: those of its signature; else of the first list taken
    from @_; else an array that is all of @_; else of its first run of shifts."""
    named = lambda s: [(p.strip().lstrip("$@%"), "unknown") for p in s.split(",") if re.search(r"\w", p)]
    if signature and re.search(r"\w", signature):
        yield from named(signature.strip("()"))
        return
    text = "\n".join(body)
    if m := re.search(r"my\s*\(([^)]+)\)\s*=\s*@_", text):
        yield from named(m[1])
    elif m := re.search(r"my\s+@(\w+)\s*=\s*@_", text):
        yield m[1], "array"
    else:
        taken = [re.match(r"\s*my\s+\$(\w+)\s*=\s*shift(?:\s+@_|\(@_\))?\s*;", x) for x in body if x.strip()]
        first = next((i for i, m in enumerate(taken) if m), len(taken))
        for m in taken[first:]:
            if not m:
                break
            yield m[1], "unknown"


_PERL_CODE = re.compile(r"\bsub\s+([A-Za-z_]\w*)\s*(\([^)]*\))?|\bmy\s+\$(\w+)\s*=\s*sub\b|->(\w+)\s*\(|(?<![$@%\w>:&])([A-Za-z_][\w:]*)\s*\(|([{}])|(;)")

_PERL_LOADS = re.compile(r"\s*(?:use|require|no)\b")
_PERL_USE = re.compile(r"\s*(?:use|require)\s+([\w:]+)")
_PERL_BASE = re.compile(r"\s*(with|extends)\s+['\"]?([\w:]+)")
_PERL_HAS = re.compile(r"\s*has\s+(?:['\"](\w+)['\"]|(\w+)\s*=>)")
_PERL_VARIABLE = re.compile(r"\b(my|our|local)\s+([$@%])(\w+)")
_PERL_OPEN = re.compile(r"\bopen\s*\(\s*(?:my\s+)?(\$?\w+)\s*(?:,\s*['\"]?([<>+|]+))?")
_PERL_CLOSE = re.compile(r"\bclose\s*\(\s*(\$?\w+)")
_PERL_DBI = re.compile(r"(?:DBI->|->)(connect|prepare|do|selectall_arrayref|selectrow_array|execute|fetchrow|fetch)\b")


def _perl_walk(lines: list[Line]) -> Iterator[tuple[int, str, str, str]]:
    """(line, what, name, function) of subs, closures, calls and ends of subs in the order of the code (a
    sub is told at its first brace, with the line of its name); a sub lasts from its first brace, on whatever line, to the one that closes it."""
    depth, open_, waits = 0, [], None
    for i, x in enumerate(lines):
        loads = _PERL_LOADS.match(x.bare) if "(" in x.bare else None
        for m in _PERL_CODE.finditer(x.bare):
            fn = open_[-1][0] if open_ else ""
            if m[1]:
                waits = (i, m[1], m[2] or "")
            elif m[3]:
                yield i, "closure", m[3], fn
            elif m[6] == "{":
                if waits:
                    yield waits[0], "sub", waits[1], waits[2]
                    open_.append((waits[1], depth))
                    waits = None
                depth += 1
            elif m[6] == "}":
                depth -= 1
                if open_ and depth <= open_[-1][1]:
                    open_.pop()
                    yield i, "end", fn, ""
            elif m[7]:
                waits = None  # a declaration ahead of its body
            elif (m[4] or (m[5] and m[5] not in BUILTINS)) and not loads:
                yield i, "call", m[4] or m[5], fn


def perl(path: str, content: str) -> Iterator[Row]:
    lines = code_lines(content)
    package = next((m[1] for x in lines if (m := re.match(r"\s*package\s+([\w:]+)", x.bare))), path.rsplit("/", 1)[-1].split(".")[0])
    yield "module", package, "", "perl"
    walked: dict[int, list[tuple[str, str, str]]] = {}
    bodies: dict[tuple[str, int], list[str]] = {}
    running: list[tuple[str, int]] = []
    ends: dict[int, list[str]] = {}
    for i, what, name, more in _perl_walk(lines):
        walked.setdefault(i, []).append((what, name, more))
        if what == "end":
            ends.setdefault(i, []).append(name)
    for i, x in enumerate(lines):
        for what, name, _ in walked.get(i, []):
            if what == "sub":
                running.append((name, i))
        for key in running:
            bodies.setdefault(key, []).append(re.sub(r"^.*?\bsub\s+\w+\s*(?:\([^)]*\))?\s*\{", "", x.kept) if key[1] == i else x.kept)
        for name in ends.get(i, []):
            running = [k for k in running if k[0] != name]
    fn, outer = "", []
    for i, x in enumerate(lines):
        if not x.kept:
            continue
        if (m := _PERL_USE.match(x.kept)) and m[1] not in CORE_MODULES and not re.match(r"v?\d", m[1]):
            yield "dependency", m[1], package, "oop" if m[1] in FRAMEWORKS else "use"
        if m := _PERL_BASE.match(x.kept):
            yield "dependency", m[2], package, m[1]
        if m := _PERL_HAS.match(x.kept):
            yield "data_type", m[1] or m[2], package, "attribute"
        calls = []
        for what, name, more in walked.get(i, []):
            if what == "sub":
                outer.append(fn)
                fn = name
                yield "function", fn, package, "sub"
                for p, kind in perl_parameters(more, bodies[name, i]):
                    yield "parameter", p, fn, kind
            elif what == "closure":
                yield "function", name, more, "closure"
            elif what == "call":
                method = re.search(rf"->{re.escape(name)}\s*\(", x.bare)
                calls.append(("call", name, more, "method" if method else "function"))
        owner = next((n for w, n, _ in walked.get(i, []) if w == "sub"), fn)
        for m in _PERL_VARIABLE.finditer(x.bare):
            yield "variable", m[3], owner, {"$": "string", "@": "array", "%": "struct"}[m[2]]
        yield from calls
        if "open" in x.kept and (m := _PERL_OPEN.search(x.kept)):
            way = "read" if m[2] in (None, "<") else "readwrite" if "+" in m[2] else "write"
            yield "io", m[1], owner, f"open:{way}"
        if "close" in x.bare and (m := _PERL_CLOSE.search(x.bare)):
            yield "io", m[1], owner, "close:readwrite"
        if "->" in x.bare and (m := _PERL_DBI.search(x.bare)):
            yield "io", m[1], owner, "dbi:" + ("read" if m[1].startswith(("fetch", "select")) else "readwrite")
        for _ in ends.get(i, []):
            fn = outer.pop() if outer else ""


# ---- Fortran --------------------------------------------------------------------------

_TYPE = r"(integer|real|double\s+precision|complex|logical|character|(?:type|class)\s*\(\s*\w+\s*\))"
_UNIT = re.compile(r"(?i)^\s*(?:(?:pure|elemental|recursive|impure|" + _TYPE[1:-1] + r")(?:\s*\*\s*\d+|\s*\((?:[^()]*)\))?\s+)*(program|module|subroutine|function)\s+(?!procedure\b)(\w+)(?:\s*\((.*?)\))?")
_ENDS = re.compile(r"(?i)^\s*end")
_END = re.compile(r"(?i)^\s*end\s*(?:(?:program|module|subroutine|function)\b.*)?$")
_DECLARED = re.compile(r"(?i)^\s*" + _TYPE + r"(?![a-z0-9_])(\s*\*\s*(?:\d+|\(\s*\*\s*\))|\s*\([^)]*\))?\s*((?:,\s*\w+(?:\s*\([^)]*\))?\s*)*)(::)?\s*([a-z]\w*.*)$")
_FORTRAN_IO = re.compile(r"(?i)^\s*(?:if\s*\(.*?\)\s*)?(open|close|inquire|rewind|backspace|read|write)\s*\(|^\s*(print)\s+")


_DERIVED = re.compile(r"(?i)^\s*type\s*(?:((?:,\s*\w+\s*(?:\([^)]*\))?\s*)*)::\s*|\s)(\w+)\s*$")
_USE = re.compile(r"(?i)^\s*use\b\s*(?:,\s*\w+\s*::\s*|::\s*)?\s*(\w+)\s*(?:,\s*(only\s*:)?(.*))?$")
_ACCESS = re.compile(r"(?i)^\s*(private|public)\s*(?:::\s*|\s)?\s*([\w\s,]*)$")


_MARK = re.compile("['\"!]")


def _without_comment(x: str, quote: str = "") -> tuple[str, str]:
    """A line up to its ``!`` outside of literals, and the quote of one that it leaves open."""
    if not quote and "!" not in x and "'" not in x and '"' not in x:
        return x, ""
    for m in _MARK.finditer(x):
        c = m[0]
        if quote:
            quote = "" if c == quote else quote
        elif c == "!":
            return x[: m.start()], ""
        else:
            quote = c
    return x, quote


def _at_semicolons(x: str) -> list[str]:
    if ";" not in x:
        return [x] if x.strip() else []
    out, quote = [""], ""
    for c in x:
        quote = ("" if c == quote else quote) if quote else c if c in "'\"" else ""
        if c == ";" and not quote:
            out.append("")
        else:
            out[-1] += c
    return [s for s in out if s.strip()]


_FIXED_NAME = re.compile(r"(?i)\.(f|for|f77)$")
_LETTER = re.compile("[A-Za-z]")
_CONTINUED = re.compile(" {5}[^ 0]")


def fortran_lines(path: str, content: str) -> list[str]:
    """Statements without comments, continuations joined: after a trailing & in free form, at a
    mark in column 6 in fixed form (files named .f, .for or .f77); a semicolon ends one, too."""
    fixed, out, more, quote = bool(_FIXED_NAME.search(path)), [], False, ""
    for x in content.split("\n"):
        if not quote and (x.lstrip()[:1] == "!" or x[:1] in ("C", "c", "*") and (fixed or not _LETTER.match(x, 1))):
            continue
        x, quote = _without_comment(x, quote if more else "")
        x = x.rstrip()
        if fixed and out and _CONTINUED.match(x):
            out[-1] += " " + x[6:].strip()
        elif more and out:
            out[-1] = out[-1] + " " + x.strip().lstrip("&")
        elif x.strip():
            out.append(x)
        more = not fixed and bool(out) and out[-1].endswith("&")
        if more:
            out[-1] = out[-1][:-1].rstrip()
    return [s for x in out for s in _at_semicolons(x)]


_LISTED = re.compile(r"\s*(\w+)\s*(\()?")


def _split_names(text: str) -> list[tuple[str, bool]]:
    """(name, whether it has dimensions of its own) of a declaration's list."""
    if "(" not in text and ")" not in text:
        return [(m[1], False) for m in map(_LISTED.match, text.split(",")) if m]
    out, depth, start = [], 0, 0
    for i, c in enumerate(text + ","):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            if m := _LISTED.match(text[start:i]):
                out.append((m[1], bool(m[2])))
            start = i + 1
    return out


_USED_NAME = re.compile(r"(\w+)(?:\s*=>\s*(\w+))?")


def _uses(m: re.Match, unit: str) -> Iterator[Row]:
    """A USE: the module, and the names that come from it under names of their own."""
    yield "dependency", m[1], unit, "use only" if m[2] else "use"
    for part in filter(None, (p.strip() for p in (m[3] or "").split(","))):
        if named := _USED_NAME.fullmatch(part):
            yield "import", named[1], unit, f"{m[1]}:{named[2] or named[1]}"


_END_TYPE = re.compile(r"(?i)^\s*end\s*type\b")
_CALL = re.compile(r"(?i)^\s*(?:if\s*\(.*\)\s*)?call\s+(\w+)")
_ASSIGNED = re.compile(r"\s*\w+\s*=")
_DIMENSION = re.compile(r"(?i)\bdimension\s*\(")
_INTENT = re.compile(r"(?i)\bintent\s*\(\s*(in\s*out|in|out)\s*\)")
_LIST_GAP = re.compile(r"[\s,]+")
_WORD = re.compile(r"\w+")


def fortran(path: str, content: str) -> Iterator[Row]:
    """Records of a file; a derived type's components are of record ``field`` under their type.

    A pattern is tried on statements that begin with a letter that it may begin with: ``h`` is this
    letter in lower case, and empty, which lies in any text, beside letters that ``(?i)`` folds to ASCII."""
    stack: list[tuple[str, str]] = []
    top = lambda: stack[-1][1] if stack else ""
    derived = ""
    for x in fortran_lines(path, content):
        low = x.lower()
        h = low.lstrip()[0] if x.isascii() else ""
        if derived and h in "e" and _END_TYPE.match(x):
            derived = ""
        elif h in "e" and _END.match(x):
            if stack:
                stack.pop()
        elif not derived and h in "t" and (m := _DERIVED.match(x)):
            derived = m[2]
            yield "data_type", derived, top(), "type"
        elif not derived and h in "cdefilmprst" and (not h or "function" in low or "module" in low or "subroutine" in low or "program" in low) and (m := _UNIT.match(x)) and not _ENDS.match(x):
            kind, name = m[1].lower(), m[2]
            yield ("module" if kind in ("program", "module") else "function"), name, top(), kind
            for p in filter(None, _LIST_GAP.split(m[3] or "")):
                yield "parameter", p, name, "unknown"
            stack.append((kind, name))
        elif h in "u" and (m := _USE.match(x)):
            yield from _uses(m, top())
        elif not derived and h in "p" and (m := _ACCESS.match(x)):
            for name in _WORD.findall(m[2]) or [""]:
                yield "access", name, top(), m[1].lower()
        elif h in "ci" and (m := _CALL.match(x)):
            yield "call", m[1], top(), "call"
        elif h in "bcioprw" and (m := _FORTRAN_IO.match(x)):
            verb = (m[1] or m[2]).lower()
            yield "io", verb, top(), "io"
        elif h in "cdilrt" and (m := _DECLARED.match(x)) and (m[4] or not _ASSIGNED.match(m[5]) and not m[3].strip()):
            wide, intent = (_DIMENSION.search(m[3]), _INTENT.search(m[3])) if m[3] else (None, None)
            kind = " ".join(m[1].lower().split())
            for name, own in _split_names(m[5]):
                shape = "array" if wide or own else "scalar"
                detail = " ".join(filter(None, [kind, shape, intent and intent[1].lower().replace(" ", "")]))
                yield ("field", name, derived, detail) if derived else ("variable", name, top(), detail)


PARSERS: dict[str, Callable[[str, str], Iterator[Row]]] = {"cobol": cobol, "perl": perl, "fortran": fortran, "cobol_constructs": constructs}


#: Records that a task holds before it gives them out, about.
BATCH_ROWS = 20_000


def parse(files: DataFrame, language: str) -> DataFrame:
    """(path, ord, record, name, parent, detail) of files (path, content)."""
    parser = PARSERS.get(language)
    if parser is None:
        raise KeyError(f"no parser for {language}; there are {', '.join(PARSERS)}")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "ord" else pa.string()) for n, c in zip(columns, zip(*rows))], names=columns)

        for b in batches:
            rows = []
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += [(p, i, *r) for i, r in enumerate(parser(p, c or ""))]
                if len(rows) >= BATCH_ROWS:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    columns = ["path", "ord", "record", "name", "parent", "detail"]
    return files.select("path", F.col("content").cast("string").alias("content")).mapInArrow(run, "path string, ord long, record string, name string, parent string, detail string")


# ---- joins on records -----------------------------------------------------------------


def construct_counts(parsed: DataFrame) -> DataFrame:
    """(path, function, a count of each construct) from records of ``cobol_constructs``."""
    n = lambda k: F.count_if(F.col("name") == k).alias(k)
    return parsed.filter("record = 'construct'").groupBy("path", F.col("parent").alias("function")).agg(n("exec_cics"), n("exec_sql"), n("evaluate"), n("when"), n("goto"))


def imported(parsed: DataFrame) -> DataFrame:
    """(path, unit, module, name): the variables that a Fortran unit gets from the modules it
    uses, names compared in any case."""
    parsed = kept(parsed.filter("record in ('dependency', 'variable')").select("path", "record", "name", "parent"))  # files are parsed once
    uses = parsed.filter("record = 'dependency'").select("path", F.col("parent").alias("unit"), F.upper("name").alias("_m"))
    own = parsed.filter("record = 'variable'").select(F.upper("parent").alias("_m"), F.col("parent").alias("module"), "name").distinct()
    return uses.distinct().join(own, "_m").select("path", "unit", "module", "name")


def scopes(parsed: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(unit, name, module, original, kind): the names that each Fortran unit gets by USE, in upper
    case, with the module that declares them and their name there, over any chain of modules that
    hand on what they use. An ONLY list lets in the names that it has, a renaming takes the place of
    the name; private names are not handed on. Kinds are variable, data_type and function.

    A fixpoint: each round joins the names that modules handed on for the first time with the USE
    statements of these modules, in which all that a unit says about them lies. A name comes to a unit
    in two rounds only where one of its ways there passes a unit that uses several modules, or its own
    module again; names that came such a way (``again``) are compared with those already known, so
    cycles of modules end, and others are not, so that a round's cost is that of its names."""
    p = kept(parsed.filter("record in ('module', 'access', 'dependency', 'import', 'variable', 'data_type', 'function')").select("record", F.upper("name").alias("name"), F.upper("parent").alias("parent"), "detail"))
    spark, key, unit = p.sparkSession, ["unit", "name", "module", "original", "kind"], F.col("parent").alias("unit")
    said = p.filter("record = 'access'").groupBy(unit).agg(F.max((F.col("name") == "") & (F.col("detail") == "private")).alias("_shut"), F.collect_set(F.when(F.col("name") != "", F.struct("name", "detail"))).alias("_told"))
    modules = p.filter("record = 'module' and detail = 'module'").select(F.col("name").alias("unit")).distinct().join(said, "unit", "left").withColumn("_module", F.lit(True))

    def handed_on(name: str) -> Column:
        """Whether the unit is a module that lets others use the name: public wins over private."""
        told = lambda x: x["name"] == F.col(name)
        public, named = F.exists("_told", lambda x: told(x) & (x["detail"] == "public")), F.exists("_told", told)
        return F.col("_module").isNotNull() & (F.col("_told").isNull() | public | ~(F.col("_shut") | named))

    part = F.split("detail", ":")
    of = F.when(F.col("record") == "import", F.upper(part[0])).otherwise(F.col("name")).alias("by")
    there = F.when(F.col("record") == "import", F.struct(F.upper(part[1]).alias("there"), F.col("name").alias("local")))
    uses = p.filter("record = 'import' or record = 'dependency' and detail like 'use%'").groupBy(unit, of)
    uses = uses.agg(F.min(F.when(F.col("record") == "dependency", F.col("detail") == "use only")).alias("_only"), F.collect_set(there).alias("_named")).filter("_only is not null")
    uses = kept(uses.withColumn("_several", F.count("*").over(W.partitionBy("unit")) > 1).join(modules, "unit", "left"))

    own = p.filter("record in ('variable', 'data_type', 'function')").select(unit, "name", F.col("record").alias("kind")).join(modules, "unit").filter(handed_on("name"))
    front = own.select("unit", "name", F.col("unit").alias("module"), F.col("name").alias("original"), "kind").distinct().withColumns({"on": F.lit(True), "again": F.lit(False)})
    folder, schema, known = scratch(spark), front.schema, []

    def written(df: DataFrame, place: str) -> DataFrame:
        df.write.parquet(f"{folder}/{place}")
        return spark.read.schema(schema).parquet(f"{folder}/{place}")

    front = written(front, "own")
    for i in range(max_rounds):
        offered = front.filter("on").select(F.col("unit").alias("by"), F.col("name").alias("there"), "module", "original", "kind", "again")
        j = uses.join(offered, "by").withColumn("_local", F.transform(F.filter("_named", lambda x: x["there"] == F.col("there")), lambda x: x["local"]))
        names = F.when(F.size("_local") > 0, F.col("_local")).when(~F.col("_only"), F.array("there")).otherwise(F.array().cast("array<string>"))
        j = j.withColumn("name", F.explode(names)).withColumns({"on": handed_on("name"), "again": F.col("again") | F.col("_several") | (F.col("unit") == F.col("module"))})
        front = written(j.groupBy(*key, "on").agg(F.max("again").alias("again")), f"seen{i}")
        if known and not front.filter("again").isEmpty():
            before = spark.read.schema(schema).parquet(*known)
            front = written(front.filter("not again").unionByName(front.filter("again").join(before, key, "left_anti")), f"new{i}")
            known.append(f"{folder}/new{i}")
        else:
            known.append(f"{folder}/seen{i}")
        if front.isEmpty():
            return spark.read.schema(schema).parquet(*known).select(*key)
    raise RuntimeError("scopes did not settle")


def typed_parameters(parsed: DataFrame) -> DataFrame:
    """(path, function, ord, name, type): parameters with the type of the first declaration of
    their name in their function, in any case; unknown without one."""
    of = W.partitionBy("path", "parent", F.upper("name"))  # both kinds meet in one pass over the parse
    declared = F.when(F.col("record") == "variable", F.col("ord"))
    p = parsed.filter("record in ('parameter', 'variable')").withColumn("_type", F.min_by("detail", declared).over(of)).filter("record = 'parameter'")
    return p.select("path", F.col("parent").alias("function"), "ord", "name", F.coalesce("_type", F.lit("unknown")).alias("type"))


def resolved_types(parsed: DataFrame, books: DataFrame) -> DataFrame:
    """Records of which data items of unknown kind take the detail of the copybook item of their
    name (the first by path and place), in any case."""
    known = books.filter("record = 'data_type'").groupBy(F.upper("name").alias("_n")).agg(F.min_by("detail", F.struct("path", "ord")).alias("_d"))
    unknown = (F.col("record") == "data_type") & F.col("detail").startswith("unknown")
    j = parsed.withColumn("_n", F.when(unknown, F.upper("name"))).join(known, "_n", "left")
    return j.select("path", "ord", "record", "name", "parent", F.coalesce("_d", "detail").alias("detail"))


def book_dependencies(parsed: DataFrame) -> DataFrame:
    """(path, book): the copybooks that each file names, once each."""
    return parsed.filter("record = 'dependency' and detail = 'copy'").select("path", F.concat("name", F.lit(".cpy")).alias("book")).distinct()


def function_snippets(code: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """Adds ``snippet``: the definition of the function ``name`` in a text, from the comment lines
    right above it (six at most) to its closing brace (within 100 lines); without a definition
    the first 2,000 characters, marked as cut where there are more."""
    split, found = F.split(text, "\n", -1), F.col(name)
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    starts = lambda x: trim(x).startswith(F.concat(found, F.lit("("))) | trim(x).startswith(F.concat(F.lit("async "), found, F.lit("(")))
    at = F.array_position(F.transform("_ls", starts), F.lit(True)).cast("int")
    df = code.withColumn("_ls", split).withColumn("_at", at)
    above = F.reverse(F.slice("_ls", F.greatest(F.col("_at") - 6, F.lit(1)), F.least(F.col("_at") - 1, F.lit(6))))
    comment = lambda x: (trim(x) == "") | trim(x).startswith("*") | trim(x).startswith("/**")
    run = F.array_position(F.transform(above, lambda x: ~comment(x)), F.lit(True)).cast("int")
    n_above = F.when(F.col("_at") <= 1, 0).when(run > 0, run - 1).otherwise(F.size(above))
    body = F.slice("_ls", F.col("_at"), F.lit(100))
    braces = lambda x: F.length(x) - F.length(F.replace(x, F.lit("{"))) - F.length(x) + F.length(F.replace(x, F.lit("}")))
    depth = F.aggregate(body, F.struct(F.lit(0).alias("d"), F.lit(0).alias("i"), F.lit(0).alias("end")), lambda a, x: F.struct((a["d"] + braces(x)).alias("d"), (a["i"] + 1).alias("i"), F.when((a["end"] == 0) & (a["i"] > 0) & (a["d"] + braces(x) <= 0), a["i"] + 1).otherwise(a["end"]).alias("end")), lambda a: F.greatest(a["end"], F.lit(1)))
    cut = F.array_join(F.slice("_ls", F.col("_at") - n_above, n_above + depth), "\n")
    rest = F.when(F.length(text) > 2000, F.concat(F.left(F.col(text), F.lit(2000)), F.lit("\n...(truncated)..."))).otherwise(F.col(text))
    return df.withColumn("snippet", F.when(F.col("_at") > 0, cut).otherwise(rest)).drop("_ls", "_at")


def rule_functions(rules: DataFrame, functions: DataFrame) -> DataFrame:
    """(module, function, rule): rules whose reference is ``module.function``."""
    f = functions.select("module", "function", F.concat_ws(".", "module", "function").alias("ref"))
    return rules.select("rule", "ref").join(f, "ref").select("module", "function", "rule")


def rule_modules(rules: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, rule): rules whose reference is the module or begins with it and a dot. A
    reference's prefixes are made first, so that an equi join finds them."""
    parts = F.split("ref", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    return rules.select("rule", F.explode(F.array_distinct(prefixes)).alias("module")).join(modules.select("module").distinct(), "module").select("module", "rule")


def paragraphs(lines: DataFrame, key: str, order: str, header, stretch) -> DataFrame:
    """Adds ``head``: the last header line (``header`` gives its text, null for others) at or
    before each line of a file. Lines are dealt to stretches, so a long file is not one task's."""
    at = lines.withColumns({"_s": stretch, "_h": header})
    ends = at.groupBy(key, "_s").agg(F.max_by(F.col("_h"), F.when(F.col("_h").isNotNull(), F.col(order))).alias("_e"))
    past = W.partitionBy(key).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(F.col(key).alias("_k"), F.col("_s").alias("_t"), F.last("_e", ignorenulls=True).over(past).alias("_carry"))
    inside = W.partitionBy(key, "_s").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    near = at.withColumn("_n", F.last("_h", ignorenulls=True).over(inside))
    j = near.join(carry, near[key].eqNullSafe(carry["_k"]) & (near["_s"] == carry["_t"]), "left")
    return j.select(*lines.columns, F.coalesce("_n", "_carry").alias("head"))
