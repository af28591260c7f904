"""The driver's tables as a code graph. Symbols are one SQL text that Spark and the oracle both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SYMBOLS = """
SELECT 'geo/region:' || r_name || ':' || CAST(r_regionkey + 1 AS STRING) AS id, r_name AS name, 'class' AS kind, 'geo/region' AS file_path, CAST(r_regionkey + 1 AS INT) AS start_line,
       CAST(NULL AS STRING) AS parent_id, CAST(NULL AS STRING) AS signature
FROM {region}
UNION ALL
SELECT 'geo/nation:' || n_name || ':' || CAST(n_nationkey + 1 AS STRING), n_name, 'class', 'geo/nation', CAST(n_nationkey + 1 AS INT), 'geo/region:' || r_name || ':' || CAST(r_regionkey + 1 AS STRING), CAST(NULL AS STRING)
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL
SELECT 'party/supplier:' || s_name || ':' || CAST(s_suppkey + 1 AS STRING), s_name, 'method', 'party/supplier', CAST(s_suppkey + 1 AS INT), CAST(NULL AS STRING), '(nation ' || CAST(s_nationkey AS STRING) || ')'
FROM {supplier}
UNION ALL
SELECT 'party/customer/' || c_mktsegment || ':' || c_name || ':' || CAST(c_custkey + 1 AS STRING), c_name, 'function', 'party/customer/' || c_mktsegment, CAST(c_custkey + 1 AS INT), CAST(NULL AS STRING), CAST(NULL AS STRING)
FROM {customer}
UNION ALL
SELECT 'catalog/' || p_brand || '/' || p_type || ':' || p_name || ':' || CAST(p_partkey + 1 AS STRING), p_name, 'variable', 'catalog/' || p_brand || '/' || p_type, CAST(p_partkey + 1 AS INT), CAST(NULL AS STRING), CAST(NULL AS STRING)
FROM {part}
"""

EDGES = """
SELECT 'party/supplier:' || s_name || ':' || CAST(s_suppkey + 1 AS STRING) AS source_id, p_brand || '.' || p_name AS target_name, 'calls' AS kind,
       CASE l_linenumber % 3 WHEN 0 THEN 'catalog/' || p_brand || '/' || p_type WHEN 1 THEN 'catalog/' || p_brand || '/sibling' ELSE 'sales/' || l_returnflag END AS file_path,
       CAST(l_linenumber AS INT) AS line
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey
UNION ALL
SELECT 'geo/nation:' || n_name || ':' || CAST(n_nationkey + 1 AS STRING), r_name, 'inherits', 'geo/nation', CAST(n_nationkey + 1 AS INT)
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL
SELECT 'party/supplier:' || s_name || ':' || CAST(s_suppkey + 1 AS STRING), 'cust.' || c_name, 'references', 'sales/orders', 1
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
JOIN (SELECT l_orderkey, MIN(l_suppkey) AS first_supp FROM {lineitem} GROUP BY l_orderkey) f ON o_orderkey = l_orderkey
JOIN {supplier} ON first_supp = s_suppkey
"""

TABLES = ("region", "nation", "supplier", "customer", "part", "lineitem", "orders")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.sql(SYMBOLS, **{t: _read(spark, sf_dir, t) for t in ("region", "nation", "supplier", "customer", "part")})
    return raw.selectExpr(
        "id", "name", "kind", "file_path", "start_line", "start_line + 5 AS end_line", "start_line * 100 AS start_byte", "start_line * 100 + 100 AS end_byte", "parent_id", "signature", "'public' AS visibility", "false AS is_async", "CAST(NULL AS STRING) AS docstring"
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without edge_id and target_id: equal edges are told apart by nothing."""
    return spark.sql(EDGES, **{t: _read(spark, sf_dir, t) for t in TABLES})


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").selectExpr("lang || '/' || source || '/' || CAST(doc_id AS STRING) AS path", "sha2(text, 256) AS hash", "lang AS language", "CAST(n_chars AS INT) AS num_symbols")


#: The same for the oracle, as common table expressions.
def _plain(sql: str) -> str:
    return sql.format(**{t: t for t in TABLES})


SYMBOLS_CTE = f"symbols AS ({_plain(SYMBOLS)})"
EDGES_CTE = f"edges AS ({_plain(EDGES)})"
FILES_CTE = "files AS (SELECT lang || '/' || source || '/' || CAST(doc_id AS STRING) AS path, sha256(text) AS hash, lang AS language, CAST(n_chars AS INT) AS num_symbols FROM documents)"
