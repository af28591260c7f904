from pyspark.sql import functions as F

from weftgraph.functions import scalars as S
from weftgraph.functions import sql


def test_sql_functions_equal_the_columns(spark):
    assert len(sql.register(spark)) == len(sql.FUNCTIONS)
    df = spark.createDataFrame([("a/b/c.py",), ("c.rs",), ("x/.git",), ("noext",), ("é/é.tsx",), (None,)], "path string")
    got = df.selectExpr("path", "weft_dirname(path) d", "weft_language(path) l", "weft_simple_name(path) s", "weft_token_estimate(path) t", "weft_match_tier(path, 'A/B') m", "weft_rrf_term(3) r", "weft_last_segment(path, '/') z")
    p = F.col("path")
    want = df.select("path", S.dirname(p), S.detect_language(p), S.simple_name(p), S.token_estimate(p), S.match_tier(p, F.lit("A/B")), S.rrf_term(F.lit(3)), S.last_segment(p))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
