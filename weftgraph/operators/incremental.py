"""What an incremental run keeps, adds and deletes. Tables are immutable; each function returns the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changed_files(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of current(path, hash) that stored(path, hash) has not."""
    return current.join(stored.select("path", "hash"), ["path", "hash"], "left_anti")


def candidate_files(current: DataFrame, stored: DataFrame, named: list[DataFrame]) -> DataFrame:
    """current(path) that a version control's lists of changed paths name, or that aren't stored yet."""
    union = named[0].select("path")
    for df in named[1:]:
        union = union.union(df.select("path"))
    return current.join(union.distinct(), "path", "left_semi").unionByName(current.join(union.distinct(), "path", "left_anti").join(stored.select("path"), "path", "left_anti"))


def removed_files(current: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.select("path").join(current.select("path"), "path", "left_anti")


def clear_files(table: DataFrame, files: DataFrame, column: str = "file_path") -> DataFrame:
    """table without the rows of files(path)."""
    return table.join(files.select(F.col("path").alias(column)).distinct(), column, "left_anti").select(*table.columns)


def last_write_wins(table: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, that of the highest order."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return table.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new's rows in place of those of equal key."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def with_edge_ids(edges: DataFrame) -> DataFrame:
    """edge_id from the edge's content and its number among equal ones, so it stays the same between runs."""
    content = ["source_id", "target_name", "kind", "file_path", "line"]
    number = F.row_number().over(Window.partitionBy(*content).orderBy(F.lit(0)))
    return edges.withColumn("edge_id", F.xxhash64(*content, number))
