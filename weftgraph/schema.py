"""Row types of the code graph, and the closed vocabularies in its columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


SYMBOLS = _struct(
    ("id", _S, False), ("name", _S, False), ("kind", _S, False), ("file_path", _S, False), ("start_line", _I, True), ("end_line", _I, True), ("start_byte", _I, True),
    ("end_byte", _I, True), ("parent_id", _S, True), ("signature", _S, True), ("visibility", _S, True), ("is_async", _B, True), ("docstring", _S, True),
)
EDGES = _struct(("edge_id", _L, False), ("source_id", _S, False), ("target_name", _S, False), ("target_id", _S, True), ("kind", _S, False), ("file_path", _S, False), ("line", _I, True))
FILES = _struct(("path", _S, False), ("last_modified", _D, True), ("hash", _S, True), ("language", _S, True), ("num_symbols", _I, True))
SYMBOL_CONTENT = _struct(("symbol_id", _S, False), ("content", _S, False), ("header", _S, False), ("normalized_name", _S, False))
EMBEDDINGS = _struct(("symbol_id", _S, False), ("embedding", T.ArrayType(T.FloatType(), False), False))
METADATA = _struct(("key", _S, False), ("value", _S, True))
TABLES = {"symbols": SYMBOLS, "edges": EDGES, "files": FILES, "symbol_content": SYMBOL_CONTENT, "embeddings": EMBEDDINGS, "metadata": METADATA}

#: The kinds and visibilities that tables may hold, and what an unknown one is read as.
SYMBOL_KINDS = ("function", "class", "method", "variable", "import")
EDGE_KINDS = ("calls", "imports", "inherits", "references", "raises")
VISIBILITIES = ("public", "private", "protected")
DEFAULTS = {SYMBOL_KINDS: "variable", EDGE_KINDS: "references", VISIBILITIES: "public"}


def parse(value: str, vocabulary: tuple[str, ...]) -> str:
    """Strict: an unknown value is an error."""
    if value not in vocabulary:
        raise ValueError(f"{value!r} is none of {', '.join(vocabulary)}")
    return value


def lossy(value: Column, vocabulary: tuple[str, ...]) -> Column:
    """An unknown or null value becomes the vocabulary's default."""
    return F.when(value.isin(*vocabulary), value).otherwise(F.lit(DEFAULTS[vocabulary]))
