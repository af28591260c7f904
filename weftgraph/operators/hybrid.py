"""Rank fusion of full-text and vector results, hydration and re-ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import text as text_search
from . import vector

RRF_K, RERANKED = 60, 50
COLUMNS = ["symbol_name", "normalized_name", "content"]


def rrf_merge(ranked: DataFrame, k: int = RRF_K, key: str = "symbol_id") -> DataFrame:
    """ranked(query_id, source, key, rank from 1) -> (query_id, key, rrf_score, sources, rrf_rank)."""
    merged = ranked.groupBy("query_id", key).agg(F.sum(S.rrf_term(F.col("rank") - 1, k)).alias("rrf_score"), F.array_sort(F.collect_set("source")).alias("sources"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", 12)), key)
    return merged.withColumn("rrf_rank", F.row_number().over(order))


def rerank(hits: DataFrame, score: Column | None, key: str = "symbol_id") -> DataFrame:
    """hits with rerank_score and position: of the first RERANKED, scored ones by score, then the others as they were."""
    head = F.col("rrf_rank") <= RERANKED
    value = F.when(head, score) if score is not None else F.lit(None).cast("double")
    scored = hits.withColumn("rerank_score", value.cast("double"))
    order = Window.partitionBy("query_id").orderBy(F.when(head, 0).otherwise(1), F.desc_nulls_last("rerank_score"), "rrf_rank", key)
    return scored.withColumn("position", F.row_number().over(order))


def hybrid_search(
    symbols: DataFrame, content: DataFrame, embeddings: DataFrame, queries: DataFrame, limit: int = 10, kind: str | None = None, load: Callable | None = vector.hashing_embedder, scorer: Callable[[Column, Column], Column] | None = None,
    index: text_search.Index | None = None,
) -> DataFrame:
    """queries(query_id, text) -> (query_id, position, symbol, content, rrf_score, rerank_score, sources, fts_count,
    vector_count, merged_count).

    Both lists hold max(3 * limit, 20) hits; the counts tell how many each gave and how many symbols they make. The kind is
    filtered after retrieval, so fewer than `limit` may come back. Where queries have a column `query`, it is their vector.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    each = max(3 * limit, 20)
    named = content.join(symbols.select(F.col("id").alias("symbol_id"), F.col("name").alias("symbol_name")), "symbol_id")
    found = text_search.search(named, queries.select("query_id", "text"), COLUMNS, each, index=index).select("query_id", F.lit("fts").alias("source"), "symbol_id", "rank")
    if load is not None:
        asked = queries.select("query_id", F.col("query") if "query" in queries.columns else vector.embed(F.col("text"), load).alias("query"))
        near = vector.knn(embeddings, asked, each).select("query_id", F.lit("vector").alias("source"), "symbol_id", "rank")
        found = found.unionByName(near)
    merged = rrf_merge(found)
    of_query = Window.partitionBy("query_id")
    counts = {"fts_count": F.count_if(F.array_contains("sources", "fts")), "vector_count": F.count_if(F.array_contains("sources", "vector")), "merged_count": F.count(F.lit(1))}
    merged = merged.withColumns({name: count.over(of_query) for name, count in counts.items()})
    hydrated = merged.join(symbols.select(F.col("id").alias("symbol_id"), F.struct(*symbols.columns).alias("symbol")), "symbol_id").join(content.select("symbol_id", "content"), "symbol_id", "left")
    hydrated = hydrated.join(queries.select("query_id", "text"), "query_id")
    score = None if scorer is None else F.when(F.col("content").isNotNull(), scorer(F.col("text"), F.col("content")))
    ordered = rerank(hydrated, score)
    if kind is not None:
        ordered = ordered.where(F.col("symbol.kind") == kind)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("position"))
    return ordered.withColumn("position", place).where(F.col("position") <= limit).select("query_id", "position", "symbol", "content", "rrf_score", "rerank_score", "sources", *counts)
