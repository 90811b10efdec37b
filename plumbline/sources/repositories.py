"""Stores of graphs and vectors behind the few operations that users need: each is a folder of
versioned tables, and each method a DataFrame operation on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators import graph, vectors

from . import versions


class GraphStore:
    """Modules (name, path, language), functions (module, function) and calls (caller, callee);
    storing a graph replaces rows of equal keys and keeps all others."""

    TABLES = {"modules": ("name string, path string, language string", ["name"]), "functions": ("module string, function string", ["module", "function"]), "calls": ("caller string, callee string", ["caller", "callee"])}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return versions.latest(self.spark, f"{self.root}/{name}", self.TABLES[name][0])

    def store(self, **tables: DataFrame) -> None:
        for name, new in tables.items():
            schema, keys = self.TABLES[name]
            old = self.table(name)
            versions.write(graph.upsert(old, new.select(*old.columns), keys), f"{self.root}/{name}")

    def load(self) -> DataFrame:
        """(name, path, language, functions) of every module."""
        return graph.load_modules(self.table("modules"), self.table("functions"))

    def callees(self, function: str) -> DataFrame:
        """The functions that one calls, by name."""
        return self.table("calls").filter(F.col("caller") == function).select("callee").orderBy("callee")


class VectorStore:
    """Documents (id, text, vector, metadata); a stored id replaces the row it had."""

    SCHEMA = "id string, text string, vector array<float>, metadata map<string,string>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def documents(self) -> DataFrame:
        return versions.latest(self.spark, self.path, self.SCHEMA)

    def upsert(self, new: DataFrame) -> None:
        old = self.documents()
        versions.write(vectors.upsert(old, new.select(*old.columns).dropDuplicates(["id"]), "id"), self.path)

    def search(self, queries: DataFrame, query: str, k: int) -> DataFrame:
        """(query, id, score, text, metadata) of the k nearest documents of each query vector."""
        found = vectors.search(self.documents(), queries.select(query, "vector"), query, "id", "vector", k)
        return found.join(self.documents().select("id", "text", "metadata"), "id").select(query, "id", "score", "text", "metadata")
