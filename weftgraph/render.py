"""Results as lines of text, built as Columns, so that a result of any size is rendered where it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _place(file: str = "file_path", line: str = "line") -> Column:
    return F.concat(F.col(file), F.lit(":"), F.col(line).cast("string"))


def _gap(*parts: Column) -> Column:
    return F.concat_ws("  ", *parts)


#: Tool -> its line, and the order of lines.
LINES = {
    "refs": lambda: _gap(F.col("kind"), F.coalesce("source_name", "source_id"), _place()),
    "callees": lambda: _gap(F.col("target_name"), _place()),
    "impact": lambda: F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), _gap(F.col("kind"), F.col("source_id"), _place())),
    "hierarchy": lambda: F.concat("child", F.lit(" -> "), "parent"),
    "deps": lambda: _gap(F.col("target_name"), F.concat(F.lit("L"), F.col("line").cast("string"))),
    "search": lambda: _gap(F.col("kind"), F.col("name"), _place("file_path", "start_line")),
    "stats": lambda: F.when(F.col("key") == "", F.concat(F.rpad(F.concat(F.initcap(F.replace("metric", F.lit("_"), F.lit(" "))), F.lit(":")), 16, " "), F.col("value").cast("string"))).otherwise(
        F.concat(F.lit("  "), F.col("metric"), F.lit(" "), F.col("key"), F.lit(": "), F.col("value").cast("string"))
    ),
    "rag_search": lambda: F.concat(F.col("position").cast("string"), F.lit(". "), _gap(F.col("symbol.kind"), F.col("symbol.name"), F.concat("symbol.file_path", F.lit(":"), F.col("symbol.start_line").cast("string")), F.concat(F.lit("score="), F.format_number("rrf_score", 4), F.when(F.col("rerank_score").isNotNull(), F.concat(F.lit(" rerank="), F.format_number("rerank_score", 2))).otherwise(F.lit(""))))),
}
EMPTY = {"refs": "No references", "callees": "No callees", "impact": "No impact", "hierarchy": "No hierarchy", "deps": "No dependencies", "search": "No symbols", "rag_search": "No results"}


def lines(tool: str, found: DataFrame) -> DataFrame:
    """found with `text`, its line."""
    return found.withColumn("text", LINES[tool]())
