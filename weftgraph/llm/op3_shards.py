"""Sharding by Karmarkar-Karp differencing over indivisible groups of equal texts.

Partial partitions with the largest spread are combined again and again, oppositely ordered. The differencing is a tree:
a task combines the groups of one bucket to 2k parts; the buckets' parts are items that are combined in the same way,
those of `fan_in` buckets at a time, until one task can deal them to k shards. But for that last task, which also has the
groups of one bucket a level, no task sees more than about per_bucket groups or the parts of fan_in buckets.

Defined cases: a null text counts as no bytes and shares the group of the empty text; a text of any length is one
indivisible group, whatever the others weigh; of equal weights the smaller digest is placed first; a null doc_id is a row
like others; repeated rows stay together; an empty table gives an empty result; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store


def differencing(items: list[tuple[list[int], int]], k: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """items: (sums of the item's parts, item's number). Returns k of (sum, [(item, part), ...]), largest sum first."""
    heap = []
    for number, (sums, item) in enumerate(items):
        parts = sorted(((s, [(item, p)]) for p, s in enumerate(sums)), key=lambda x: -x[0])
        parts += [(0, []) for _ in range(k - len(parts))]
        heap.append((parts[-1][0] - parts[0][0], number, parts))
    heapq.heapify(heap)
    number = len(items)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = []
        for (s, x), (t, y) in zip(a, reversed(b), strict=True):
            if len(x) < len(y):
                x, y = y, x
            x.extend(y)
            merged.append((s + t, x))
        merged.sort(key=lambda part: -part[0])
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], number, merged))
        number += 1
    return heap[0][2] if heap else [(0, []) for _ in range(k)]


def _parts(rows: pd.DataFrame, k: int) -> list[int]:
    """Sorts rows in place; the part of each."""
    rows.sort_values(["weight", "text_key"], ascending=[False, True], kind="stable", inplace=True, ignore_index=True)
    part_of = [0] * len(rows)
    for part, (_, members) in enumerate(differencing([([w], i) for i, w in enumerate(rows.weight.tolist())], k)):
        for item, _ in members:
            part_of[item] = part
    return part_of


def _combine(k: int):
    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[["text_key", "weight"]].copy()
        part, least = _parts(rows, k), {}
        for p, key in zip(part, rows.text_key, strict=True):
            least[p] = min(key, least.get(p, key))
        return rows.assign(up_key=[least[p] for p in part])

    return combine


def _place(k: int):
    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[["text_key", "weight"]].copy()
        part = _parts(rows, k)
        return pd.DataFrame({"text_key": rows.text_key, "shard": pd.Series(part, dtype="int32")})

    return place


def balanced(groups: DataFrame, shards: int, per_bucket: int = 1_000, fan_in: int = 1_000) -> DataFrame:
    """groups(text_key, weight) -> (text_key, shard): sums of weight near equal over shards. `groups` is read twice.

    A bucket's parts go up as items of their own, each under its smallest key: a group that outweighs its bucket stays alone
    in a part, and what the other buckets hold makes up for it. One bucket a level goes up uncombined, so that the last
    step has fine items to level what coarse ones leave.
    """
    parts = 2 * shards
    items = groups.select("text_key", "weight", F.lit(False).alias("kept"))
    size, levels = max(per_bucket, 4 * parts), []
    while (nodes := math.ceil(items.where("NOT kept").count() / size)) > 1:
        node = F.when(F.col("kept"), 0).otherwise(F.pmod(F.xxhash64("text_key", F.lit(len(levels))), F.lit(nodes)))
        dealt = items.withColumn("node", node)
        met = dealt.where("node != 0").groupBy("node").applyInPandas(_combine(parts), "text_key binary, weight long, up_key binary")
        fine = dealt.where("node = 0").select("text_key", "weight", F.col("text_key").alias("up_key"), F.lit(True).alias("kept"))
        step = store.written(met.withColumn("kept", F.lit(False)).unionByName(fine), "kk-parts")
        items = store.written(step.groupBy(F.col("up_key").alias("text_key"), "kept").agg(F.sum("weight").alias("weight")), "kk-sums")
        levels.append(step.select("text_key", "up_key"))
        size = max(2, fan_in) * parts
    placed = items.withColumn("node", F.lit(0)).groupBy("node").applyInPandas(_place(shards), "text_key binary, shard int")
    for level in reversed(levels):
        placed = level.join(store.written(placed, "kk-placed").withColumnRenamed("text_key", "up_key"), "up_key").select("text_key", "shard")
    return placed


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Rows of docs(doc_id, text) with size, text_crc32, text_key, shard and a gapless slot in the shard; equal texts share a shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("text_key"),
    )
    rows = store.written(rows, "shard-rows")
    groups = store.written(rows.groupBy("text_key").agg(F.sum("size").alias("weight")), "shard-groups")
    placed = store.written(rows.join(balanced(groups, shards), "text_key"), "shard-placed")
    return store.gapless(placed, ["shard"], ["doc_id", "text_key"], "slot", rows.count())


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law `bytes`: Karmarkar-Karp over groups of equal texts."""
    return shard_documents(store.documents(spark, sf_dir), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
