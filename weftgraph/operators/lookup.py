"""Rows by key: points, lists of ids in the order asked for, existence, and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_ids(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """ids(position, <key>) -> the table's rows with `position`; ids that the table hasn't give none, repeated ones a row each."""
    return table.join(ids.select("position", key), key).select("position", *table.columns)


def of_list(table: DataFrame, ids: list[str], key: str = "id") -> DataFrame:
    """by_ids() of a driver's list, in its order; a filter on the key reaches the scan."""
    asked = table.sparkSession.createDataFrame(list(enumerate(ids)), f"position int, {key} string")
    found = table.where(F.col(key).isin(ids)) if len(ids) <= 1000 else table
    return by_ids(found, F.broadcast(asked) if len(ids) <= 1000 else asked, key).orderBy("position")


def point(table: DataFrame, key: str, value: str) -> DataFrame:
    return table.where(F.col(key) == value).limit(1)


def exists(table: DataFrame, key: str, value: str) -> bool:
    """Reads until the first match."""
    return not table.where(F.col(key) == value).isEmpty()


def known(asked: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """asked(key) with `known`: whether the table has it."""
    has = table.select(key).distinct().withColumn("__known", F.lit(True))
    return asked.join(has, key, "left").select(*asked.columns, F.coalesce("__known", F.lit(False)).alias("known"))


def files_by_path(files: DataFrame) -> DataFrame:
    return files.orderBy("path")


def content_ids(content: DataFrame) -> DataFrame:
    return content.select("symbol_id").orderBy("symbol_id")


def names_of(symbols: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """ids(<column>, ...) with `name`, the symbol's; null where no symbol has the id."""
    return ids.join(symbols.select(F.col("id").alias(column), "name"), column, "left")


def content_of_hits(content: DataFrame, hits: DataFrame) -> DataFrame:
    """hits(query_id, symbol_id, rank) with the content they point to."""
    return hits.join(content.select("symbol_id", "header", "content"), "symbol_id").select("query_id", "rank", "symbol_id", "header", "content")


def coverage(content: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(contents, embedded, missing), one row."""
    has = embeddings.select("symbol_id").distinct().withColumn("__has", F.lit(1))
    joined = content.select("symbol_id").join(has, "symbol_id", "left")
    return joined.agg(F.count(F.lit(1)).alias("contents"), F.count("__has").alias("embedded"), F.count_if(F.col("__has").isNull()).alias("missing"))

