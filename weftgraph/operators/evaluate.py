"""Measures of ranked results against what was expected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def relevance(results: DataFrame, expected: DataFrame, k: int, asked: DataFrame | None = None) -> DataFrame:
    """results(query_id, item, rank from 1), expected(query_id, item, ideal_rank from 1) -> (query_id, precision, recall,
    ndcg) at k. Gain falls from the number of expected items by one a place in the ideal order. With asked(query_id, want),
    expected(want, item, ideal_rank) has each want once, however many queries share it."""
    of = "query_id" if asked is None else "want"
    size = expected.groupBy(of).agg(F.count(F.lit(1)).alias("n"))
    gain = F.col("n") - F.col("ideal_rank") + 1
    found = results.where(F.col("rank") <= k)
    hit = (found if asked is None else found.join(asked, "query_id")).join(expected, [of, "item"]).join(size, of)
    got = hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.sum(gain * S.dcg_discount(F.col("rank") - 1)).alias("dcg"))
    ideal = expected.where(F.col("ideal_rank") <= k).join(size, of).groupBy(of).agg(F.sum(gain * S.dcg_discount(F.col("ideal_rank") - 1)).alias("idcg"))
    wanted = size.join(ideal, of, "left")
    joined = (wanted if asked is None else asked.join(wanted, of)).join(got, "query_id", "left")
    hits = F.coalesce("hits", F.lit(0))
    return joined.select("query_id", (hits / k).alias("precision"), (hits / F.col("n")).alias("recall"), F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)).alias("ndcg"))


def means(measures: DataFrame) -> DataFrame:
    return measures.agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "ndcg")))


def recall(found: DataFrame, expected: DataFrame) -> DataFrame:
    """found(case_id, item), expected(case_id, item) -> (case_id, n_expected, n_found, recall)."""
    hit = expected.join(found.select("case_id", "item").distinct().withColumn("hit", F.lit(1)), ["case_id", "item"], "left")
    out = hit.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_expected"), F.count("hit").alias("n_found"))
    return out.withColumn("recall", F.col("n_found") / F.col("n_expected"))
