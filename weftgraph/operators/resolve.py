"""Links references to definitions: same file, else same directory, else a name that is unique anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def targets(need: DataFrame, symbols: DataFrame) -> DataFrame:
    """need(simple, file_path), distinct -> with target_id and tier (1, 2, 3; null: none).

    Each tier is a join to symbols aggregated to one row a key - the first by start_line and id - so a name that a million
    symbols share costs one row a side, whatever the number of references to it. The directory tier joins on the exact
    (name, directory) after each symbol is listed under all directories above it: no prefix join is needed.
    """
    first = F.min(F.struct("start_line", "id"))
    in_file = symbols.groupBy(F.col("name").alias("simple"), "file_path").agg(first.alias("x")).select("simple", "file_path", F.col("x.id").alias("id1"))
    listed = symbols.select(F.col("name").alias("simple"), "start_line", "id", F.explode(S.ancestors(F.col("file_path"))).alias("dir"))
    in_dir = listed.groupBy("simple", "dir").agg(first.alias("x")).select("simple", "dir", F.col("x.id").alias("id2"))
    unique = symbols.groupBy(F.col("name").alias("simple")).agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id3")).where("c = 1").drop("c")
    found = need.withColumn("dir", S.dirname(F.col("file_path"))).join(in_file, ["simple", "file_path"], "left").join(in_dir, ["simple", "dir"], "left").join(unique, "simple", "left")
    tier = F.when(F.col("id1").isNotNull(), 1).when(F.col("id2").isNotNull(), 2).when(F.col("id3").isNotNull(), 3)
    return found.select("simple", "file_path", F.coalesce("id1", "id2", "id3").alias("target_id"), tier.alias("tier"))


def resolve_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """edges with target_id filled where it was null and a tier finds one; `tier` is null for edges that came resolved."""
    open_edges = edges.where("target_id IS NULL").withColumn("simple", S.simple_name(F.col("target_name")))
    found = targets(open_edges.select("simple", "file_path").distinct(), symbols).withColumnRenamed("target_id", "__found")
    joined = open_edges.join(found, ["simple", "file_path"], "left")
    told = joined.select(*(F.col("__found").alias("target_id") if c == "target_id" else F.col(c) for c in edges.columns), "tier")
    return told.unionByName(edges.where("target_id IS NOT NULL").withColumn("tier", F.lit(None).cast("int")))


def invalidated(edges: DataFrame, old_symbols: DataFrame, new_symbols: DataFrame, changed_files: DataFrame) -> DataFrame:
    """edges with target_id set to null where an incremental run must look again: the target is gone, or its simple name
    is a name of an old or new symbol in changed_files(path)."""
    changed = changed_files.select(F.col("path").alias("file_path")).distinct()
    names = old_symbols.join(changed, "file_path", "left_semi").select("name").unionByName(new_symbols.join(changed, "file_path", "left_semi").select("name")).distinct()
    named = edges.withColumn("__simple", S.simple_name(F.col("target_name")))
    marked = named.join(names.select(F.col("name").alias("__simple"), F.lit(True).alias("__touched")), "__simple", "left")
    alive = new_symbols.select(F.col("id").alias("target_id"), F.lit(True).alias("__alive"))
    linked = marked.where("target_id IS NOT NULL").join(alive, "target_id", "left")  # nulls would all meet in one task
    keep = F.col("__alive").isNotNull() & F.col("__touched").isNull()
    told = linked.select(*(F.when(keep, F.col(c)).alias(c) if c == "target_id" else F.col(c) for c in edges.columns))
    return told.unionByName(marked.where("target_id IS NULL").select(*edges.columns))
