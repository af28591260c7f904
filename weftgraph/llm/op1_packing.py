"""Packing into optimal length buckets.

A dynamic program over the global histogram of lengths chooses bucket boundaries that minimise padding; inside a bucket,
batches of equal row counts are formed so that rows times the padded length stays within the token budget. Texts longer
than max_len are cut into pieces of max_len first, so the histogram has at most max_len rows, whatever the corpus.

Lengths are counts of tokens by the ranks of byte_bpe_50k. Defined cases: null and empty texts have length 0 and no place
in a batch: op1_packing() gives them one row of length 0 with a null bucket, pack() none unless asked; texts of any length
are counted whole; of equal paddings the smaller boundary is taken; a null doc_id is packed like others; repeated rows are
packed each; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op2_bpe, store

MAX_LEN, BUCKETS, TOKEN_BUDGET = 2048, 12, 65_536


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper lengths of at most `buckets` buckets with the least padding in all; ties go to the smaller boundary."""
    lengths = sorted(histogram)
    if len(lengths) <= buckets:
        return lengths
    at = np.array([0, *lengths], dtype=np.float64)
    count = np.concatenate([[0], np.cumsum([histogram[x] for x in lengths])]).astype(np.float64)
    total = np.concatenate([[0], np.cumsum([x * histogram[x] for x in lengths])]).astype(np.float64)
    n = len(lengths)
    best = np.full(n + 1, np.inf)
    best[0] = 0
    chosen = []
    for _ in range(buckets):
        new, frm = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        new[0] = 0
        for j in range(1, n + 1):
            cost = best[:j] + at[j] * (count[j] - count[:j]) - (total[j] - total[:j])
            frm[j] = int(np.argmin(cost))
            new[j] = cost[frm[j]]
        best = new
        chosen.append(frm)
    found, j = [], n
    for frm in reversed(chosen):
        if j == 0:
            break
        found.append(int(at[j]))
        j = int(frm[j])
    return found[::-1]


def pieces(docs: DataFrame, length: str, max_len: int) -> DataFrame:
    """(doc_id, piece, start, length) of each run of max_len tokens of a document; the last may be shorter."""
    n = F.col(length)
    count = F.ceil(n / max_len).cast("int")
    return (
        docs.where(n > 0)
        .select("doc_id", n.alias("__n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
        .select("doc_id", "piece", (F.col("piece") * max_len).cast("long").alias("start"), F.least(F.lit(max_len).cast("long"), F.col("__n") - F.col("piece").cast("long") * max_len).alias("length"))
    )


def pack(lengths: DataFrame, length: str = "n_tokens", max_len: int = MAX_LEN, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, empty: bool = False) -> DataFrame:
    """lengths(doc_id, <length>) -> (doc_id, piece, start, length, bucket, padded_length, batch, row).

    `batch` counts from 0 in each bucket and holds token_budget // padded_length rows at most; `row` is the place in it.
    With `empty`, documents of length 0 get a row of piece 0 without a bucket, batch and row.
    """
    if empty:
        lengths = store.written(lengths.select("doc_id", length), "pack-lengths")
    cut = store.written(pieces(lengths, length, max_len), "pack-pieces")
    histogram = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}  # max_len rows at most
    upper = boundaries(histogram, buckets)
    if not upper:
        upper = [max_len]
    bucket = F.lit(len(upper) - 1)
    padded = F.lit(upper[-1])
    for i in range(len(upper) - 2, -1, -1):
        bucket = F.when(F.col("length") <= upper[i], i).otherwise(bucket)
        padded = F.when(F.col("length") <= upper[i], upper[i]).otherwise(padded)
    named = cut.withColumns({"bucket": bucket.cast("int"), "padded_length": padded.cast("long")})
    numbered = store.gapless(named, ["bucket", "padded_length"], ["doc_id", "piece", "length"], "__at", sum(histogram.values()))
    rows = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.col("padded_length")).cast("long"))
    placed = numbered.select(
        "doc_id", "piece", "start", "length", "bucket", "padded_length", F.floor(F.col("__at") / rows).cast("long").alias("batch"), F.pmod(F.col("__at"), rows).cast("long").alias("row")
    )
    if not empty:
        return placed
    zero = {"piece": F.lit(0), "start": F.lit(0), "length": F.lit(0)}
    none = lengths.where(F.col(length) == 0).select("doc_id", *(zero.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in placed.schema.fields[1:]))
    return placed.unionByName(none)


def token_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): tokens of byte_bpe_50k."""
    import public_tokenizers

    return op2_bpe.counted(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in pieces of at most 2048 tokens, packed into 12 optimal length buckets and batches of 65,536 tokens."""
    return pack(token_lengths(store.documents(spark, sf_dir)), empty=True)
