"""The queries by name over a store, for programs and the command line; results are DataFrames or JSON text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from .operators import graph, hybrid
from .operators.vector import hashing_embedder
from .schema import EDGE_KINDS, SYMBOL_KINDS, parse
from .sources import indexer, tree
from .sources.store import Store

HINT = "The index is empty: run index first."
#: Tool name -> its required parameters.
TOOLS = {"index": (), "outline": ("file",), "refs": ("name",), "callees": ("name",), "impact": ("name",), "hierarchy": ("name",), "deps": ("file",), "search": ("query",), "stats": (), "rag_index": (), "rag_search": ("query",)}


class CodeGraph:
    def __init__(self, spark: SparkSession, root: str, store: str | None = None):
        self.spark, self.root = spark, root
        self.store = Store(spark, store or f"{root}/.weftgraph")

    def _t(self, name: str) -> DataFrame:
        return self.store.read(name)

    def index(self, force: bool = False) -> dict[str, int]:
        return indexer.index(self.spark, self.root, self.store, force)

    def outline(self, file: str) -> DataFrame:
        return graph.outline(self._t("symbols"), file)

    def refs(self, name: str, kind: str | None = None) -> DataFrame:
        return graph.refs(self._t("edges"), self._t("symbols"), name, parse(kind, EDGE_KINDS) if kind else None)

    def callees(self, name: str) -> DataFrame:
        return graph.callees(self._t("edges"), self._t("symbols"), name)

    def impact(self, name: str, depth: int = 3) -> DataFrame:
        return graph.impact(self._t("edges"), self._t("symbols"), [name], depth)

    def hierarchy(self, name: str) -> DataFrame:
        return graph.hierarchy(self._t("edges"), self._t("symbols"), name)

    def deps(self, file: str) -> DataFrame:
        return graph.file_deps(self._t("edges"), file)

    def search(self, query: str, kind: str | None = None, file: str | None = None, limit: int = 30) -> DataFrame:
        return graph.search(self._t("symbols"), query, kind, file, limit)

    def stats(self) -> DataFrame:
        return graph.stats(self._t("symbols"), self._t("edges"), self._t("files"))

    def rag_index(self, force: bool = False) -> dict[str, int]:
        return indexer.index_embeddings(self.store, force)

    def rag_search(self, query: str, kind: str | None = None, limit: int = 10, scorer=None) -> DataFrame:
        if not query.strip():
            raise ValueError("the query is empty")
        if kind:
            parse(kind, SYMBOL_KINDS)
        queries = self.spark.createDataFrame([(0, query)], "query_id int, text string")
        load = None if self._t("embeddings").isEmpty() else hashing_embedder
        index = indexer.text_index(self.store)
        return hybrid.hybrid_search(self._t("symbols"), self._t("symbol_content"), self._t("embeddings"), queries, min(limit, graph.MAX_RESULTS), kind, load, scorer, index)

    def found(self, tool: str, **options) -> DataFrame | dict[str, int]:
        """A tool's result; paths are confined to the root."""
        if tool not in TOOLS:
            raise ValueError(f"no tool {tool!r}; there are {', '.join(TOOLS)}")
        if missing := [p for p in TOOLS[tool] if not options.get(p)]:
            raise ValueError(f"{tool} needs {', '.join(missing)}")
        if options.get("file"):
            tree.confined(options["file"], self.root)
        return getattr(self, tool)(**options)

    def call(self, tool: str, **options) -> str:
        """A tool's result as JSON; an empty index is said to be."""
        found = self.found(tool, **options)
        if isinstance(found, dict):
            return json.dumps(found)
        rows = [json.loads(x) for x in found.toJSON().collect()]
        out: dict = {"results": rows}
        if not rows and self.store.version() == 0:
            out["hint"] = HINT
        return json.dumps(out, ensure_ascii=False)
