"""COPY expansion: copybooks joined into sources, round by round.

A source is split into segments, each a COPY statement or the lines between two, ordered by a path of
positions. A round joins the statements of all files with the library on the book's name;
the books found are split in turn. Names are compared in upper case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, functions as F

from .statements import is_fixed
from .storage import kept

#: Books that come with the system and are no errors when absent.
SYSTEM = ("DFHAID", "DFHBMSCA", "DFHATTR", "DFHEIBLK", "DFHCOMMAREA")
MAX_DEPTH = 10

_STATEMENT = re.compile(r"(?i)(?<![\w-])COPY\s+(['\"]?)([\w-]+)\1")
_PAIR = re.compile(r"(?is)(?:\b(LEADING|TRAILING)\s*)?==(.*?)==\s*BY\s*==(.*?)==")
_SEGMENTS = "path string, ord array<int>, book string, pairs array<array<string>>, text string"


def replace_words(line: str, pairs: list[list[str]]) -> str:
    """Applies (mode, old, new) in turn: LEADING and TRAILING to the ends of words in any
    case, others to the text as it stands. Spaces stay as they are."""
    for mode, old, new in pairs:
        if not old:
            continue
        if mode == "LEADING":
            line = re.sub(rf"(?i)(?<!\S){re.escape(old)}", lambda _: new, line)
        elif mode == "TRAILING":
            line = re.sub(rf"(?i){re.escape(old)}(?=\.?(?!\S))", lambda _: new, line)
        else:
            line = line.replace(old, new)
    return line


def segments(content: str, pairs: list[list[str]]) -> Iterator[tuple[str | None, list[list[str]], str]]:
    """(book or None, replacements, text): one row a line, or a COPY statement up to its
    period. Comment lines (* or / in column 7) are lines; of fixed lines columns 8 to 72 are read."""
    lines = content.split("\n")
    fixed = is_fixed(lines)
    held: list[str] = []
    said: list[str] = []
    for raw in lines:
        line = replace_words(raw, pairs)
        text = line[7:72] if fixed else line
        if not held and (line[6:7] in ("*", "/") or not _STATEMENT.search(text)):
            yield None, [], line
            continue
        held.append(line)
        said.append(text.strip())
        if text.rstrip().endswith("."):
            yield _statement(held, said)
            held, said = [], []
    if held:
        yield _statement(held, said)


def joined(parts: Iterator[tuple[str | None, list[list[str]], str]]) -> Iterator[tuple[str | None, list[list[str]], str]]:
    """Segments of which the lines between two COPY statements are one."""
    for book, run in groupby(parts, lambda p: p[0]):
        if book is None:
            yield None, [], "\n".join(text for _, _, text in run)
        else:
            yield from run


def _statement(lines: list[str], said: list[str]) -> tuple[str, list[list[str]], str]:
    whole = " ".join(said)
    found = _STATEMENT.search(whole)
    clause = re.split(r"(?i)\bREPLACING\b", whole[found.end() :], maxsplit=1)[1:]
    pairs = [[(m[1] or "").upper(), m[2].strip(), m[3].strip()] for m in _PAIR.finditer(clause[0])] if clause else []
    return found[2].upper(), pairs, "\n".join(lines)


def _split(df: DataFrame, statements: bool) -> DataFrame:
    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            rows = []
            for path, at, pairs, content in zip(f["path"], f["ord"], f["pairs"], f["content"]):
                pairs = [list(p) for p in pairs]
                if not statements:
                    rows.append((path, list(at), None, [], "\n".join(replace_words(x, pairs) for x in (content or "").split("\n"))))
                    continue
                for i, (book, p, text) in enumerate(joined(segments(content or "", pairs))):
                    rows.append((path, [*at, i], book, p, text))
            yield pd.DataFrame(rows, columns=["path", "ord", "book", "pairs", "text"])

    return df.select("path", "ord", "pairs", "content").mapInPandas(run, _SEGMENTS)


def library(files: DataFrame) -> DataFrame:
    """(book, content) of the .cpy files; of equal names the last path counts."""
    name = F.upper(F.regexp_extract("path", r"(?i)([^/]*)\.cpy$", 1))
    return files.filter(F.lower("path").endswith(".cpy")).groupBy(name.alias("book")).agg(F.max_by(F.col("content").cast("string"), "path").alias("content"))


def expand(files: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path, content) with their COPY statements replaced by the books named, and the
    warnings (path, book, warning). A book that is not there leaves its statement as a
    comment; below ``MAX_DEPTH`` statements stay as they are. Null content is empty."""
    none = F.array().cast("array<array<string>>")
    todo = files.select("path", F.array().cast("array<int>").alias("ord"), none.alias("pairs"), F.col("content").cast("string").alias("content"))
    done, warnings = [], []
    for _ in range(MAX_DEPTH + 1):
        parts = kept(_split(todo, True))
        done.append(parts.filter("book is null").select("path", "ord", "text"))
        copies = parts.filter("book is not null").join(books.select("book", F.coalesce("content", F.lit("")).alias("content")), "book", "left")
        absent = copies.filter("content is null")
        comment = F.transform(F.split("text", "\n", -1), lambda x: F.concat(F.rpad(F.left(x, F.lit(6)), 6, " "), F.lit("*"), F.substr(x, F.lit(8))))
        done.append(absent.select("path", "ord", F.array_join(comment, "\n").alias("text")))
        why = F.when(F.col("book").isin(*SYSTEM), "system copybook is not available").otherwise("copybook is not found")
        warnings.append(absent.select("path", "book", why.alias("warning")))
        todo = copies.filter("content is not null")
        if todo.isEmpty():
            break
    else:
        done.append(_split(todo, False).select("path", "ord", "text"))
        warnings.append(todo.select("path", "book", F.lit("copybooks are nested too deep").alias("warning")))
    every, told = done[0], warnings[0]
    for d in done[1:]:
        every = every.unionByName(d)
    for w in warnings[1:]:
        told = told.unionByName(w)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    return every.groupBy("path").agg(F.array_join(lines, "\n").alias("content")), told
