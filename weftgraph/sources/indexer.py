"""A source tree to the tables: extraction in workers, resolution and incremental refresh as joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import hybrid, incremental, resolve, text, vector
from . import extract, tree
from .store import Store

_SYMBOL = "struct<id:string,name:string,kind:string,file_path:string,start_line:int,end_line:int,start_byte:int,end_byte:int,parent_id:string,signature:string,visibility:string,is_async:boolean,docstring:string>"
_EDGE = "struct<source_id:string,target_name:string,target_id:string,kind:string,file_path:string,line:int>"
_CONTENT = "struct<symbol_id:string,content:string,header:string>"
EXTRACTED = f"path string, symbols array<{_SYMBOL}>, edges array<{_EDGE}>, contents array<{_CONTENT}>"


def extracted(files: DataFrame) -> DataFrame:
    """files(path, language, content) -> a row each with arrays of symbols, edges and contents; a file whose extractor
    fails has empty ones."""

    extractors = dict(extract.EXTRACTORS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, language, content in zip(batch.path, batch.language, batch.content, strict=True):
                try:
                    b = extractors[language](content or "", path)
                    contents = [{k: c[k] for k in ("symbol_id", "content", "header")} for c in b.contents(lambda n: n)]
                    rows.append((path, b.symbols, b.edges, contents))
                except Exception:
                    rows.append((path, [], [], []))
            yield pd.DataFrame(rows, columns=["path", "symbols", "edges", "contents"])

    return files.select("path", "language", "content").mapInPandas(run, EXTRACTED)


def tables_of(files: DataFrame) -> dict[str, DataFrame]:
    """files(path, language, content, hash, last_modified) -> symbols, edges (unresolved), symbol_content and files."""
    found = extracted(files)
    symbols = found.select(F.posexplode("symbols").alias("n", "s")).select("n", "s.*")
    symbols = incremental.last_write_wins(symbols, "id", "n").drop("n")
    edges = incremental.with_edge_ids(found.select(F.explode("edges").alias("e")).select("e.*"))
    contents = found.select(F.posexplode("contents").alias("n", "c")).select("n", "c.*")
    contents = incremental.last_write_wins(contents, "symbol_id", "n").drop("n")
    names = symbols.select(F.col("id").alias("symbol_id"), S.normalize_symbol_name(F.col("name")).alias("normalized_name"))
    counts = found.select("path", F.size("symbols").alias("num_symbols"))
    return {
        "symbols": symbols,
        "edges": edges.withColumn("target_id", F.col("target_id").cast("string")),
        "symbol_content": contents.join(names, "symbol_id"),
        "files": files.select("path", "last_modified", "hash", "language").join(counts, "path"),
    }


def candidates(spark: SparkSession, root: str, store: Store) -> list[str] | None:
    """Paths that an incremental run has to read: those that version control names since the last run's commit, and those
    that aren't stored. None where version control can't tell: then all are read and told apart by their hashes."""
    named = tree.git_changed(root, store.metadata("last_commit"))
    if named is None:
        return None
    listed = spark.createDataFrame([(p,) for p in tree.walk(root)], "path string")
    lists = [spark.createDataFrame([(p,) for p in named], "path string")]
    return [r["path"] for r in incremental.candidate_files(listed, store.read("files"), lists).collect()]  # changed files


def index(spark: SparkSession, root: str, store: Store, force: bool = False) -> dict[str, int]:
    """One incremental pass, or with force a full one. Returns counts of files indexed, skipped and removed, and of
    symbols and edges now in the store and edges resolved."""
    only = None if force or not store.version() else candidates(spark, root, store)
    current = tree.read_tree(spark, root, only).cache()
    try:
        stored = store.read("files")
        old_symbols = store.read("symbols")
        changed = current if force else incremental.changed_files(current, stored)
        if only is None:
            removed, n_current = incremental.removed_files(current, stored), current.count()
        else:
            paths = list(tree.walk(root))
            removed, n_current = incremental.removed_files(spark.createDataFrame([(p,) for p in paths], "path string"), stored), len(paths)
        n_changed, n_removed = changed.count(), removed.count()
        head = tree.git_head(root)
        if not n_changed and not n_removed and store.version():
            if head and head != store.metadata("last_commit"):
                store.set_metadata("last_commit", head)
        else:
            new = tables_of(changed)
            touched = changed.select("path").unionByName(removed)
            keep = lambda name: incremental.clear_files(store.read(name), touched)
            symbols = keep("symbols").unionByName(new["symbols"])
            kept_edges = resolve.invalidated(keep("edges"), old_symbols, symbols, touched)
            edges = resolve.resolve_edges(kept_edges.unionByName(new["edges"].select(*kept_edges.columns)), symbols).drop("tier")
            gone = old_symbols.join(touched.select(F.col("path").alias("file_path")), "file_path", "left_semi").select(F.col("id").alias("symbol_id"))
            content = store.read("symbol_content").join(gone, "symbol_id", "left_anti").unionByName(new["symbol_content"])
            embeddings = store.read("embeddings").join(gone, "symbol_id", "left_anti")
            files = incremental.clear_files(stored, touched, "path").unionByName(new["files"])
            metadata = spark.createDataFrame([("last_commit", head)] if head else [], "key string, value string")
            tables = {"symbols": symbols, "edges": edges, "symbol_content": content, "files": files, "metadata": metadata}
            store.commit(tables if store.read("embeddings").isEmpty() else tables | {"embeddings": embeddings})
        edges = store.read("edges").agg(F.count(F.lit(1)).alias("n"), F.count("target_id").alias("linked")).first()
        return {"indexed": n_changed, "skipped": n_current - n_changed, "removed": n_removed, "symbols": store.read("symbols").count(), "edges": edges["n"], "resolved": edges["linked"]}
    finally:
        current.unpersist()


def _text_path(store: Store) -> str | None:
    """Named after the tables that the index is made from, so it can't be out of date."""
    tables = store.manifest(store.version()) if isinstance(store, Store) else {}
    if "symbol_content" not in tables:
        return None
    return f"{store.root}/fulltext/{tables['symbol_content'].replace('/', '-')}"


def build_text_index(store: Store) -> text.Index | None:
    path = _text_path(store)
    if path is None:
        return None
    names = store.read("symbols").select(F.col("id").alias("symbol_id"), F.col("name").alias("symbol_name"))
    return text.Index.build(store.read("symbol_content").join(names, "symbol_id"), hybrid.COLUMNS, path)


def text_index(store: Store) -> text.Index | None:
    """The stored full-text index of the current version; None where none was built."""
    path = _text_path(store)
    return text.Index.open(store.spark, path) if path and store.exists(path.removeprefix(store.root + "/") + "/corpus") else None


def index_embeddings(store: Store, force: bool = False, load=vector.hashing_embedder) -> dict[str, int]:
    """Embeds what has no vector yet, and builds the full-text index where the version has none."""
    content, symbols, old = store.read("symbol_content"), store.read("symbols"), store.read("embeddings")
    need = vector.needing_embeddings(content, symbols, old.limit(0) if force else old).count()
    if need:
        store.commit({"embeddings": vector.index_embeddings(content, symbols, old, force, load)})
    if text_index(store) is None:
        build_text_index(store)
    return {"embedded": need, "total": store.read("embeddings").count()}
