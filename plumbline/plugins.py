"""What a user may plug in: parsers, generators, gates, providers and stages, by name.

A provider answers prompts and embeds texts. ``Stub`` does both deterministically and without a
network; real ones are the user's. Answers come through Arrow batches, so a provider sees many
prompts at a time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators import codegen, gates, parsers


class Provider(Protocol):
    name: str

    def complete(self, prompts: list[str]) -> list[str]: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Stub:
    """Answers from a table of (part of a prompt, answer), else with ``other``; an embedding is
    made from a hash."""

    name = "stub"

    def __init__(self, answers: list[tuple[str, str]] = (), other: str = "[]", width: int = 8):
        self.answers, self.other, self.width = list(answers), other, width

    def complete(self, prompts: list[str]) -> list[str]:
        return [next((a for part, a in self.answers if part in p), self.other) for p in prompts]

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[b / 255 for b in hashlib.sha256(t.encode()).digest()[: self.width]] for t in texts]


class Registry:
    """Named plug-ins of one kind; an unknown name tells which there are."""

    def __init__(self, kind: str, known: dict | None = None):
        self.kind, self._known = kind, dict(known or {})

    def register(self, name: str, plugin) -> None:
        if name in self._known:
            raise KeyError(f"{self.kind} {name} is registered already")
        self._known[name] = plugin

    def get(self, name: str):
        if name not in self._known:
            raise KeyError(f"no {self.kind} {name}; there are {', '.join(sorted(self._known)) or 'none'}")
        return self._known[name]

    def names(self) -> list[str]:
        return sorted(self._known)


SOURCES = Registry("source", parsers.PARSERS)
TARGETS = Registry("target", {n: (lambda f, n=n: codegen.generate(f, n)) for n in codegen.LANGUAGES})
GATES = Registry("gate", {"score": gates.score_gate, "compilation": gates.compilation_gate, "fixtures": gates.fixture_gate, "coverage": gates.coverage_gate, "token_budget": gates.token_gate, "errors": gates.error_gate})
PROVIDERS = Registry("provider", {"stub": Stub})


def provider(name: str | None, **options) -> Provider | None:
    """A provider by name; none for ``none`` or no name."""
    return None if name in (None, "", "none") else PROVIDERS.get(name)(**options)


def _batched(df: DataFrame, column: str, out: str, kind: str, work: Callable[[list], list]) -> DataFrame:
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != out], f"`{out}` {kind}"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            asked = [x or "" for x in b.column(b.schema.get_field_index(column)).to_pylist()]
            told = work(asked)
            if len(told) != len(asked):
                raise ValueError(f"{len(told)} answers to {len(asked)} questions")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(told, pa.list_(pa.float32()) if kind.startswith("array") else pa.string())], names=[*b.schema.names, out])

    return df.drop(out).mapInArrow(run, schema)


def completed(df: DataFrame, prompt: str, out: str, by: Provider) -> DataFrame:
    """Adds the provider's answer to each prompt."""
    return _batched(df, prompt, out, "string", by.complete)


def embedded(df: DataFrame, text: str, out: str, by: Provider) -> DataFrame:
    """Adds each text's embedding; a wrong number of answers fails."""
    return _batched(df, text, out, "array<float>", by.embed)


def thought(answer: Column) -> Column:
    from plumbline.functions.scalars import strip_thinking

    return strip_thinking(answer)


RULES = "array<struct<id:string,description:string,confidence:double,tags:array<string>>>"


def extracted_rules(functions: DataFrame, by: Provider) -> DataFrame:
    """(id, description, ref, confidence, tags) of functions (module, function, body): the rules
    of each JSON answer; any other answer is one rule of confidence 0.5."""
    prompt = F.concat(F.lit("Module: "), "module", F.lit("\nFunction: "), "function", F.lit("\nBody:\n"), F.coalesce("body", F.lit("")))
    rows = completed(functions.select("module", "function", prompt.alias("_p")), "_p", "_a", by)
    ref = F.concat_ws(".", "module", "function")
    text = thought(F.col("_a"))
    made = F.when(F.try_parse_json(text).isNotNull() & F.trim(text).startswith("["), F.from_json(text, RULES))
    one = F.array(F.struct(F.concat(ref, F.lit(".rule1")).alias("id"), text.alias("description"), F.lit(0.5).alias("confidence"), F.array().cast("array<string>").alias("tags")))
    return rows.select(ref.alias("ref"), F.explode(F.coalesce(made, one)).alias("r")).select("r.id", "r.description", "ref", "r.confidence", "r.tags")


def verdicts(pairs: DataFrame, by: Provider) -> DataFrame:
    """(module, function, equivalent, reason) of pairs (module, function, body, snippet)."""
    from plumbline.operators.review import verdict

    prompt = F.concat(F.lit("Function: "), "function", F.lit("\nSource:\n"), F.coalesce("body", F.lit("")), F.lit("\nTarget:\n"), F.coalesce("snippet", F.lit("")))
    rows = completed(pairs.select("module", "function", prompt.alias("_p")), "_p", "_a", by)
    return verdict(rows, "_a").select("module", "function", "equivalent", "reason")


def health(checks: dict[str, Callable[[], str]]) -> list[tuple[str, str, str]]:
    """(name, status, message) of each check, in order; one that raises is unhealthy."""
    out = []
    for name, check in checks.items():
        try:
            out.append((name, check() or "healthy", ""))
        except Exception as e:  # a check may fail in any way; that is its answer
            out.append((name, "unhealthy", str(e)))
    return out


def pipeline(df: DataFrame, *stages: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for s in stages:
        df = df.transform(s)
    return df


def manifest(text: str) -> dict:
    """A target's manifest from JSON: version, language, compile commands and the fixture command
    (``run_fixture.cmd``), without which it fails."""
    try:
        found = json.loads(text)
    except ValueError as e:
        raise ValueError(f"manifest is no JSON: {e}") from e
    if not (found.get("run_fixture") or {}).get("cmd"):
        raise ValueError("manifest lacks run_fixture.cmd")
    return {"version": found.get("version", ""), "language": found.get("language", ""), "compile": found.get("compile") or [], "run_fixture": found["run_fixture"]}
