"""From raw documents to packed training batches: five stages, each written as Parquet and read again by the next one.

Defined cases, of every stage: null and empty texts have no words, so `quality` drops them; where they reach a later stage
they stay, without lines, links or secrets, and `packing` gives them a row of length 0. Texts of any length are read whole.
Ties go to the smaller doc_id, then to the smaller digest of the text. Repeated rows are judged alike and are one document
from `near_dedup` on; rows of one doc_id with different texts are documents of their own; a null doc_id sorts first and is
never a copy. An empty table gives an empty result. All columns but text and n_chars are carried along as they are,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import op1_packing, op4_near, op8_secrets, op9_lines, op10_quality, store

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep."""
    return op10_quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of a line, within the edits that its length allows, go from text; n_chars is counted anew."""
    return op9_lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (five-word shingles, similarity 0.8) stays."""
    return op4_near.first_of_each(docs, k=5)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in text are masked; every document stays."""
    return op8_secrets.redact(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in length buckets and token-budget batches; a row for documents without a token, too."""
    return op1_packing.pack(op1_packing.token_lengths(docs), empty=True)


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", packing)]

#: The stages' models and near-duplicate components can't be put in SQL; tests/llm/test_pipeline.py holds run(), stage by
#: stage, against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark, docs = store.mark(), store.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = store.written(stage(spark, docs, sf_dir), f"stage-{name}")
    store.sweep(mark, docs)
    return docs
