"""Queries of the code graph. Every one has a batch form that takes a table of names and answers all in one job."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import SYMBOL_KINDS, parse

MAX_RESULTS, MAX_DEPTH, MAX_QUERIES = 100, 10, 4096


def _names(df: DataFrame, names: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(n,) for n in names], "name string")


def search_batch(symbols: DataFrame, queries: DataFrame, limit: int = MAX_RESULTS, kind: str | None = None, file: str | None = None) -> DataFrame:
    """queries(query) -> (query, rank, symbol...): at most `limit` symbols for each, best first.

    Definitions come before variables and imports, and equal names before prefixes before other matches. Containment has
    no key to join on: queries meet all symbols in blocks of at most MAX_QUERIES, which bounds what is broadcast; symbols
    stay where they are, and each task keeps its own best of a query before the shuffle.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if kind is not None:
        symbols = symbols.where(F.col("kind") == parse(kind, SYMBOL_KINDS))
    if file is not None:
        symbols = symbols.where(F.col("file_path") == file)
    queries = queries.select("query").distinct()
    blocks = max(1, math.ceil(queries.count() / MAX_QUERIES))
    met = None
    for block in range(blocks):
        own = F.broadcast(queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block))
        found = symbols.join(own, F.contains(F.lower(F.col("name")), F.lower(F.col("query"))))
        met = found if met is None else met.unionByName(found)
    score = S.match_tier(F.col("name"), F.col("query")) + S.kind_penalty(F.col("kind"))
    order = Window.partitionBy("query").orderBy("score", S.kind_order(F.col("kind")), "file_path", "start_line", "id")
    ranked = met.withColumn("score", score).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= min(limit, MAX_RESULTS))


def search(symbols: DataFrame, query: str, kind: str | None = None, file: str | None = None, limit: int = MAX_RESULTS) -> DataFrame:
    """One query: a filter and a top-k, without a join."""
    if not query:
        raise ValueError("the query is empty")
    if limit < 1:
        raise ValueError("limit must be at least 1")
    found = symbols.where(F.contains(F.lower(F.col("name")), F.lower(F.lit(query))))
    if kind is not None:
        found = found.where(F.col("kind") == parse(kind, SYMBOL_KINDS))
    if file is not None:
        found = found.where(F.col("file_path") == file)
    score = S.match_tier(F.col("name"), F.lit(query)) + S.kind_penalty(F.col("kind"))
    return found.orderBy(score, S.kind_order(F.col("kind")), "file_path", "start_line", "id").limit(min(limit, MAX_RESULTS))


def outline(symbols: DataFrame, file: str) -> DataFrame:
    return symbols.where(F.col("file_path") == file).orderBy("start_line", "start_byte", "id")


def outline_batch(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """files(file_path) -> their symbols with `place`, the order within the file."""
    found = symbols.join(files.select("file_path").distinct(), "file_path", "left_semi")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("file_path").orderBy("start_line", "start_byte", "id")))


def outline_lines(symbols: DataFrame, file: str) -> DataFrame:
    """(start_line, line): the outline as text."""
    indent = F.when(F.col("parent_id").isNotNull(), "  ").otherwise("")
    head = F.when(F.col("is_async"), "async ").otherwise("")
    shown = F.when(F.col("kind") == "import", F.coalesce("signature", "name")).otherwise(F.concat(F.col("kind"), F.lit(" "), F.col("name"), F.coalesce("signature", F.lit(""))))
    text = F.concat(indent, head, shown, F.lit("  L"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    return outline(symbols, file).select("start_line", text.alias("line"))


def refs_batch(edges: DataFrame, symbols: DataFrame, names: DataFrame, kind: str | None = None) -> DataFrame:
    """names(name) -> (name, edge..., source_name, source_kind, source_file, target_symbol): edges to a name, by their
    text or by the resolved symbol's name.

    "By either" has no single key, so it is a union of two joins on keys, each edge and name once.
    """
    if kind is not None:
        edges = edges.where(F.col("kind") == kind)
    names = names.select("name").distinct()
    target = symbols.select(F.col("id").alias("target_id"), F.col("name").alias("target_symbol"))
    source = symbols.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("kind").alias("source_kind"), F.col("file_path").alias("source_file"))
    by_text = edges.join(names.withColumnRenamed("name", "target_name"), "target_name", "left_semi").join(target, "target_id", "left").withColumn("name", F.col("target_name"))
    meant = target.join(names.withColumnRenamed("name", "target_symbol"), "target_symbol", "left_semi")
    by_symbol = edges.where("target_id IS NOT NULL").join(meant, "target_id").where("target_symbol != target_name").withColumn("name", F.col("target_symbol"))
    return by_text.unionByName(by_symbol.select(*by_text.columns)).join(source, "source_id", "left")


def refs(edges: DataFrame, symbols: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    return refs_batch(edges, symbols, _names(edges, [name]), kind)


def callees_batch(edges: DataFrame, symbols: DataFrame, names: DataFrame) -> DataFrame:
    """names(name) -> (name, edge...): calls from symbols of the name."""
    source = symbols.join(names.select("name").distinct(), "name", "left_semi").select(F.col("id").alias("source_id"), "name")
    return edges.where("kind = 'calls'").join(source, "source_id")


def callees(edges: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    return callees_batch(edges, symbols, _names(edges, [name]))


def call_chain(edges: DataFrame, symbols: DataFrame, names: list[str], depth: int) -> DataFrame:
    """(step, caller, callee): callees of the names, of their callees, and so on; every caller is asked once."""
    asked = frontier = _names(edges, names)
    out = None
    for step in range(1, depth + 1):
        found = callees_batch(edges, symbols, frontier).select(F.lit(step).alias("step"), F.col("name").alias("caller"), F.col("target_name").alias("callee")).distinct()
        out = found if out is None else out.unionByName(found)
        frontier = found.select(S.simple_name(F.col("callee")).alias("name")).distinct().join(asked, "name", "left_anti")
        asked = asked.unionByName(frontier)
    return out


def hierarchy_batch(edges: DataFrame, symbols: DataFrame, names: DataFrame) -> DataFrame:
    """names(name) -> (name, child, parent) of one hop in either direction; the parent is the text of the reference."""
    names = names.select("name").distinct()
    source = symbols.select(F.col("id").alias("source_id"), F.col("name").alias("child"))
    found = edges.where("kind = 'inherits'").join(source, "source_id").select("child", F.col("target_name").alias("parent"))
    up = found.join(names.withColumn("child", F.col("name")), "child")
    down = found.where("NOT (child <=> parent)").join(names.withColumn("parent", F.col("name")), "parent")
    return up.select("name", "child", "parent").unionByName(down.select("name", "child", "parent"))


def hierarchy(edges: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    return hierarchy_batch(edges, symbols, _names(edges, [name])).select("child", "parent")


def file_deps_batch(edges: DataFrame, files: DataFrame) -> DataFrame:
    """files(file_path) -> the import edges of these files."""
    return edges.where(F.col("kind") == "imports").join(files.select("file_path").distinct(), "file_path", "left_semi")


def file_deps(edges: DataFrame, file: str) -> DataFrame:
    return edges.where((F.col("kind") == "imports") & (F.col("file_path") == file))


def impact(edges: DataFrame, symbols: DataFrame, names: list[str], depth: int = 3, keys: tuple[str, ...] = ("edge_id",)) -> DataFrame:
    """What refers to the names, what refers to that, and so on: (start, edge..., source_name, depth), each edge once for a
    start, at its smallest depth. Breadth first, a job a level; only the frontier meets the edges.

    Names, not symbols, are visited, so symbols of one name are one. Where spark.checkpoint.dir is set, each level's
    frontier is checkpointed there, which ends its lineage.
    """
    spark = edges.sparkSession
    depth = min(depth, MAX_DEPTH)
    shared = spark.conf.get("spark.checkpoint.dir", None)
    frontier = spark.createDataFrame([(n, n) for n in dict.fromkeys(names)], "start string, name string")
    visited, out = frontier, None
    for level in range(1, depth + 1):
        found = refs_batch(edges, symbols, frontier).join(frontier, "name").withColumn("depth", F.lit(level))
        out = found if out is None else out.unionByName(found)
        following = found.where("source_name IS NOT NULL").select("start", F.col("source_name").alias("name")).distinct().join(visited, ["start", "name"], "left_anti")
        if level < depth:
            if shared:
                path = f"{shared.rstrip('/')}/weftgraph/impact-{uuid.uuid4().hex}"
                following.write.parquet(path)
                following = spark.read.schema(following.schema).parquet(path)
                if following.isEmpty():
                    break
            visited, frontier = visited.unionByName(following), following
    least = out.groupBy("start", *keys).agg(F.min_by(F.struct(*(c for c in out.columns if c not in ("start", "name", *keys))), "depth").alias("x"))
    return least.select("start", *keys, "x.*")


def stats(symbols: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """Long form (metric, key, value): each table is read once and leaves a row for each kind or language."""

    def told(df: DataFrame, total: str, each: str, column: str) -> DataFrame:
        counts = df.groupBy(F.coalesce(column, F.lit("")).alias("key")).agg(F.count(F.lit(1)).alias("value"))
        both = counts.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("n"), F.collect_list(F.struct(F.lit(each).alias("metric"), "key", "value")).alias("own"))  # closed vocabularies
        return both.select(F.inline(F.concat(F.array(F.struct(F.lit(total).alias("metric"), F.lit("").alias("key"), F.col("n").alias("value"))), "own")))

    n = edges.agg(F.count(F.lit(1)).alias("all"), F.count("target_id").alias("linked"))
    of_edges = n.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit("").alias("key"), F.col(c).alias("value")) for m, c in (("edges", "all"), ("edges_resolved", "linked"))))))
    return told(files, "files", "language", "language").unionByName(told(symbols, "symbols", "symbol_kind", "kind")).unionByName(of_edges)
