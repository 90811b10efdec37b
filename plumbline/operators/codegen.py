"""Code and test skeletons from module tables: string projections, a file for each module.

A language is a row of text pieces (``LANGUAGES``, ``TESTS``); generation fills these with names in
the language's style. Functions come as (module, ord, function), types as (module, type, ord,
field, kind, size).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.scalars import camel_case, kebab_case, pascal_case, snake_case

#: What each kind is called in each language; integers of over nine digits are wide.
TYPES = {
    "java": {"string": "String", "integer": "int", "wide": "long", "decimal": "java.math.BigDecimal", "boolean": "boolean", "array": "java.util.List<%s>", "unknown": "Object"},
    "go": {"string": "string", "integer": "int", "wide": "int64", "decimal": "decimal.Decimal", "boolean": "bool", "array": "[]%s", "unknown": "any"},
    "python": {"string": "str", "integer": "int", "wide": "int", "decimal": "Decimal", "boolean": "bool", "array": "list[%s]", "unknown": "Any"},
    "typescript": {"string": "string", "integer": "number", "wide": "number", "decimal": "number", "boolean": "boolean", "array": "Array<%s>", "unknown": "unknown"},
}


#: Words that are no names in one of the languages.
RESERVED = frozenset(
    """abstract any as assert async await boolean break byte case catch chan char class const continue debugger def default defer del delete do double elif else enum except export extends fallthrough
    false final finally float for from func function global go goto if implements import in instanceof int interface is lambda let long map module native new nil none nonlocal not null number object or
    package pass private protected public raise range return select self short static string struct super switch synchronized this throw throws transient true try type typeof var void volatile while with yield""".split()
)


def _safe(c: Column, made: Column, other: str) -> Column:
    """A name that is an identifier in every language: not empty, no digit first, no reserved word."""
    named = F.when(made == "", other).when(made.rlike("^[0-9]"), F.concat(F.lit(other[0]), made)).otherwise(made)
    return F.when(F.lower(named).isin(*RESERVED) & (F.lower(named) == named), F.concat(named, F.lit("_"))).otherwise(named)


def _letters(c: Column) -> Column:
    """The name with what no identifier may hold as a separator."""
    return F.regexp_replace(c, r"[^A-Za-z0-9_.\s-]+", "_")


STYLES = {
    "Pascal": lambda c: _safe(c, pascal_case(_letters(c)), "Generated"),
    "camel": lambda c: _safe(c, camel_case(_letters(c)), "unnamed"),
    "kebab": lambda c: _safe(c, kebab_case(_letters(F.replace(c, F.lit("::"), F.lit("-")))), "generated"),
    "snake": lambda c: _safe(c, snake_case(_letters(F.replace(c, F.lit("::"), F.lit("_")))), "generated"),
    "raw": lambda c: F.regexp_replace(c, r'["\\\r\n*]', "_"),
}


@dataclass(frozen=True)
class Skeleton:
    """Lines in which {Pascal}, {camel}, {kebab}, {snake} and {raw} stand for the module's name
    (``path``, ``head``, ``tail``) or the function's (``each``), {Module} for the module's there."""

    path: str
    head: str
    each: str
    tail: str


LANGUAGES = {
    "java": Skeleton("src/main/java/generated/{Pascal}Service.java", "package generated;\n\npublic class {Pascal}Service {\n", "    /** From {raw}. */\n    public void {camel}() {\n        throw new UnsupportedOperationException(\"{raw}\");\n    }\n", "}\n"),
    "go": Skeleton("generated/{snake}.go", "package generated\n\ntype {Pascal}Service struct{}\n\n", "// {Pascal} comes from {raw}.\nfunc (s *{Module}Service) {Pascal}() error {\n\treturn ErrUnsupported\n}\n\n", ""),
    "python": Skeleton("generated/{snake}.py", "class {Pascal}Service:\n", "    def {snake}(self):\n        \"\"\"From {raw}.\"\"\"\n        raise NotImplementedError(\"{raw}\")\n\n", "    pass\n"),
    "typescript": Skeleton("src/generated/{kebab}.ts", "export class {Pascal}Service {\n", "  /** From {raw}. */\n  {camel}(): void {\n    throw new Error(\"{raw}\");\n  }\n", "}\n"),
}
#: The skeletons' functions say that they are not done yet, and the tests hold them to that.
TESTS = {
    "java": Skeleton("src/test/java/generated/{Pascal}ServiceTest.java", "package generated;\n\nimport static org.junit.jupiter.api.Assertions.assertThrows;\n\nclass {Pascal}ServiceTest {\n", "    @org.junit.jupiter.api.Test\n    void {camel}() {\n        assertThrows(UnsupportedOperationException.class, () -> new {Module}Service().{camel}());\n    }\n", "}\n"),
    "go": Skeleton("generated/{snake}_test.go", "package generated\n\nimport \"testing\"\n\n", "func Test{Module}{Pascal}(t *testing.T) {\n\tif err := (&{Module}Service{}).{Pascal}(); err != ErrUnsupported {\n\t\tt.Fatal(err)\n\t}\n}\n\n", ""),
    "python": Skeleton("tests/test_{snake}.py", "import pytest\n\nfrom generated.{snake} import {Pascal}Service\n\n\n", "def test_{snake}():\n    with pytest.raises(NotImplementedError):\n        {Module}Service().{snake}()\n\n\n", ""),
    "typescript": Skeleton("src/tests/{kebab}.test.ts", "import {{ {Pascal}Service }} from \"../generated/{kebab}\";\n\ndescribe(\"{Pascal}Service\", () => {{\n", "  it(\"{camel}\", () => {{\n    expect(() => new {Module}Service().{camel}()).toThrow();\n  }});\n", "}});\n"),
}
#: Files that a language needs once, beside those of the modules.
SCAFFOLDS = {
    "java": [],
    "go": [("go.mod", "module generated\n\ngo 1.21\n"), ("generated/errors.go", "package generated\n\nimport \"errors\"\n\n// ErrUnsupported is what functions return that are not done yet.\nvar ErrUnsupported = errors.New(\"unsupported\")\n")],
    "python": [("generated/__init__.py", ""), ("tests/__init__.py", "")],
    "typescript": [],
}


@dataclass(frozen=True)
class Model:
    """A type's lines: ``head`` and ``tail`` around its fields; {Pascal} is the type's name, {name} and
    {type} a field's."""

    path: str
    style: str
    head: str
    each: str
    tail: str


MODELS = {
    "java": Model("src/main/java/generated/{Pascal}.java", "camel", "package generated;\n\npublic class {Pascal} {\n", "    public {type} {name};\n", "}\n"),
    "python": Model("generated/models/{snake}.py", "snake", "from __future__ import annotations\n\nfrom dataclasses import dataclass\nfrom decimal import Decimal  # noqa: F401\nfrom typing import Any  # noqa: F401\n\n\n@dataclass\nclass {Pascal}:\n    \"\"\"From {raw}.\"\"\"\n\n", "    {name}: {type}\n", ""),
    "typescript": Model("src/generated/models/{kebab}.ts", "camel", "export interface {Pascal} {\n", "  {name}: {type};\n", "}\n"),
}


def _filled(pattern: str, name: Column) -> Column:
    """``pattern`` with the styles of ``name`` in place of their braces."""
    out = F.lit(pattern.replace("{{", "{").replace("}}", "}"))
    for style, made in STYLES.items():
        if "{" + style + "}" in pattern:
            out = F.replace(out, F.lit("{" + style + "}"), made(name))
    return out


def type_name(kind: Column, size: Column, name: Column, language: str) -> Column:
    """What a type is called; ``kind`` may be array<kind> (of any depth two); structs are called
    by their name, unknown kinds by the language's own word."""
    words = TYPES[language]

    def plain(k: Column) -> Column:
        out = F.when(k == "integer", F.when(size > 9, words["wide"]).otherwise(words["integer"])).when(k == "struct", STYLES["Pascal"](name))
        for w in ("string", "decimal", "boolean"):
            out = out.when(k == w, words[w])
        return out.otherwise(words["unknown"])

    before, after = words["array"].split("%s")
    wrap = lambda c: F.concat(F.lit(before), c, F.lit(after))
    inner = F.regexp_extract(kind, r"^array<(.*)>", 1)
    deeper = F.regexp_extract(inner, r"^array<(.*)>", 1)
    return F.when(deeper != "", wrap(wrap(plain(deeper)))).when(inner != "", wrap(plain(inner))).when(kind.startswith("array"), wrap(F.lit(words["unknown"]))).otherwise(plain(kind))


def _once(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """Of names that come out equal in a group the first one's row; those without a name stay."""
    first = rows.filter(F.col(name).isNotNull()).groupBy(*key, STYLES["camel"](F.col(name)).alias("_s")).agg(F.min(F.struct("ord", name)).alias("_f")).select(*key, F.col("_f.ord").alias("ord"), F.col(f"_f.{name}").alias(name))
    return first.unionByName(rows.filter(F.col(name).isNull()).select(*key, "ord", name).distinct())


def _files(functions: DataFrame, s: Skeleton) -> DataFrame:
    named = F.replace(_filled(s.each, F.col("function")), F.lit("{Module}"), STYLES["Pascal"](F.col("module")))
    rows = _once(functions, ["module"], "function").select("module", "ord", F.when(F.col("function").isNotNull(), named).alias("body"))
    by = rows.groupBy("module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("body").isNotNull(), F.struct("ord", "body")))), lambda x: x["body"]), "").alias("body"))
    content = F.concat(_filled(s.head, F.col("module")), "body", _filled(s.tail, F.col("module")))
    return by.select("module", _filled(s.path, F.col("module")).alias("path"), content.alias("content"))


def generate(functions: DataFrame, language: str) -> DataFrame:
    """(module, path, content): a class skeleton of each module; a row without a function stands
    for a module that has none."""
    return _files(functions, LANGUAGES[language])


def generate_tests(functions: DataFrame, language: str) -> DataFrame:
    """(module, path, content): a test skeleton of each module."""
    return _files(functions, TESTS[language])


def type_models(fields: DataFrame, language: str) -> DataFrame:
    """(type, fields): the fields of each type in order, as ``name: type`` lines, by type."""
    line = F.concat(STYLES["camel"](F.col("field")), F.lit(": "), type_name(F.col("kind"), F.col("size"), F.col("field"), language))
    by = fields.groupBy("type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("fields"))
    return by.select(STYLES["Pascal"](F.col("type")).alias("type"), "fields").orderBy("type")


def scaffold(spark, language: str) -> DataFrame:
    """(path, content): the files that a language needs once."""
    return spark.createDataFrame(SCAFFOLDS[language], "path string, content string")


def generate_models(fields: DataFrame, language: str) -> DataFrame:
    """(type, path, content): a class for each type with its fields in order; of fields whose names
    come out equal the first."""
    m = MODELS[language]
    rows = fields.join(_once(fields.select("type", "ord", "field"), ["type"], "field"), ["type", "ord", "field"], "left_semi")
    line = F.replace(F.replace(F.lit(m.each), F.lit("{name}"), STYLES[m.style](F.col("field"))), F.lit("{type}"), type_name(F.col("kind"), F.col("size"), F.col("field"), language))
    by = rows.groupBy("type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "").alias("_lines"))
    return by.select("type", _filled(m.path, F.col("type")).alias("path"), F.concat(_filled(m.head, F.col("type")), "_lines", F.lit(m.tail)).alias("content"))


def all_files(*parts: DataFrame) -> DataFrame:
    """Scaffold and generated files together (path, content)."""
    out = parts[0].select("path", "content")
    for p in parts[1:]:
        out = out.unionByName(p.select("path", "content"))
    return out
