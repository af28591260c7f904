"""The scalar functions for SQL: temporary functions of a session, of plain SQL, so they are inlined and optimised."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .scalars import LANGUAGES

#: Name -> parameters, result type and body.
FUNCTIONS = {
    "weft_simple_name": ("target STRING", "STRING", "substring_index(target, '.', -1)"),
    "weft_dirname": ("path STRING", "STRING", "regexp_extract(path, '^(.*)/[^/]*$', 1)"),
    "weft_last_segment": ("path STRING, separator STRING", "STRING", "substring_index(path, separator, -1)"),
    "weft_symbol_id": ("path STRING, name STRING, line INT", "STRING", "concat_ws(':', path, name, CAST(line AS STRING))"),
    "weft_match_tier": ("name STRING, query STRING", "INT", "CASE WHEN lower(name) = lower(query) THEN 0 WHEN startswith(lower(name), lower(query)) THEN 1 ELSE 2 END"),
    "weft_kind_penalty": ("kind STRING", "INT", "CASE WHEN kind IN ('function', 'method', 'class') THEN 0 WHEN kind = 'import' THEN 6 ELSE 3 END"),
    "weft_token_estimate": ("content STRING", "BIGINT", "CAST(floor((octet_length(content) + 3) / 4) AS BIGINT)"),
    "weft_language": ("path STRING", "STRING", "element_at(map(" + ", ".join(f"'{k}', '{v}'" for k, v in LANGUAGES.items()) + "), regexp_extract(path, '[^/][.]([^./]+)$', 1))"),
    "weft_rrf_term": ("rank INT", "DOUBLE", "1.0D / (60 + rank + 1)"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL; returns their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
