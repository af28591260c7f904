"""Vectors: exact nearest neighbours, a codec, and embedding with a pluggable model."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

DIM, BATCH, MAX_QUERIES, BLOCK, TILE, MEASURED = 384, 512, 4096, 1024, 512, 4096


def knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "symbol_id") -> DataFrame:
    """vectors(key, embedding), queries(query_id, query) -> (query_id, key, distance, rank), by L2 distance, exactly.

    Queries meet every vector in blocks of about MAX_QUERIES, which bounds what is sent to tasks. A matrix product of TILE
    queries and BLOCK vectors tells which may be among a query's k best; these are measured exactly, and each task gives
    its own k best of a query. Vectors and queries that are null, or of different lengths, have no distance.
    """
    asked = queries.where(F.col("query").isNotNull())
    blocks = max(1, math.ceil(asked.count() / MAX_QUERIES))
    out = None
    for block in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        rows = own.select("query_id", "query").collect()  # a block
        names = vectors.sparkSession.createDataFrame([(n, r["query_id"]) for n, r in enumerate(rows)], T.StructType([T.StructField("__query", T.IntegerType()), queries.schema["query_id"]]))
        found = _block_knn(vectors.select(key, "embedding"), [r["query"] for r in rows], k, key)
        order = Window.partitionBy("__query").orderBy("distance", key)
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked = ranked.join(F.broadcast(names), "__query").select("query_id", key, "distance", "rank")
        out = ranked if out is None else out.unionByName(ranked)
    return out


def _block_knn(vectors: DataFrame, asked: list[list[float]], k: int, key: str) -> DataFrame:
    """vectors(key, embedding) -> (__query, key, distance): each task's k best of every query in the list."""
    lengths = [len(q) for q in asked]
    groups = {d: np.flatnonzero(np.array(lengths) == d) for d in set(lengths)}
    matrices = {d: np.array([asked[n] for n in numbers], np.float64) for d, numbers in groups.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = [(d, at, _Best(matrices[d][at : at + TILE], k)) for d in matrices if d for at in range(0, len(matrices[d]), TILE)]
        for batch in batches:
            lists, keys = batch.column("embedding"), batch.column(key)
            length = lists.value_lengths().to_numpy(zero_copy_only=False)
            for d in matrices:
                own = np.flatnonzero(length == d) if d else ()
                for at in range(0, len(own), BLOCK):
                    part = pa.array(own[at : at + BLOCK])
                    v = lists.take(part).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                    names = keys.take(part).to_pandas().to_numpy()
                    for of, _, best in tiles:
                        if of == d:
                            best.meet(names, v)
        for d, at, best in tiles:
            if len(best.row):
                yield pa.RecordBatch.from_arrays([pa.array(groups[d][at + best.row], pa.int32()), pa.array(best.keys.tolist(), kind), pa.array(best.distance)], ["__query", key, "distance"])

    kind = pa.string() if isinstance(vectors.schema[key].dataType, T.StringType) else pa.int32() if isinstance(vectors.schema[key].dataType, T.IntegerType) else pa.int64()
    schema = T.StructType([T.StructField("__query", T.IntegerType()), vectors.schema[key], T.StructField("distance", T.DoubleType())])
    return vectors.where(F.col("embedding").isNotNull() & F.col(key).isNotNull()).mapInArrow(run, schema)


class _Best:
    """The k best vectors of each query of a tile, as it meets one block of vectors after another."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.squares = np.square(queries).sum(axis=1)
        self.row, self.distance, self.keys = np.zeros(0, np.int64), np.zeros(0), None
        self.bound = np.full(len(queries), np.inf)  # the k-th best distance, squared

    def meet(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        """A matrix product tells which pairs may matter, with room for its error and for ties; these are measured exactly."""
        squares = np.square(vectors).sum(axis=1)
        rough = self.queries @ vectors.T
        rough *= -2
        rough += self.squares[:, None]
        rough += squares
        rough[~np.isfinite(rough)] = np.inf
        bound = self.bound.copy()
        fresh = np.flatnonzero(np.isinf(bound))
        if len(fresh) and len(keys) >= self.k:
            bound[fresh] = np.partition(rough[fresh], self.k - 1, axis=1)[:, self.k - 1]
        room = 1e-6 * (1 + sum(x[np.isfinite(x)].max(initial=0) for x in (self.squares, squares)))
        row, col = np.nonzero(rough <= (bound + room)[:, None])
        if not len(row):
            return
        exact = np.concatenate([np.sqrt(np.square(self.queries[row[i : i + MEASURED]] - vectors[col[i : i + MEASURED]]).sum(axis=1)) for i in range(0, len(row), MEASURED)])
        row, distance = np.concatenate([self.row, row]), np.concatenate([self.distance, exact])
        keys = keys[col] if self.keys is None else np.concatenate([self.keys, keys[col]])
        order = np.lexsort((keys, distance, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        order, row, place = order[place < self.k], row[place < self.k], place[place < self.k]
        self.row, self.distance, self.keys = row, distance[order], keys[order]
        last = place == self.k - 1
        self.bound[row[last]] = np.nan_to_num(np.square(self.distance[last]), nan=np.inf)


class _Nearest:
    """The k nearest other vectors of a block, as it meets one block after another."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray, k: int):
        self.keys, self.vectors, self.k = keys, vectors, k
        self.squares = np.square(vectors).sum(axis=1)
        self.distance = np.full((len(keys), k), np.inf)
        self.other = np.full((len(keys), k), -1)

    def meet(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        """A matrix product tells which pairs may matter, with room for its error and for ties; these are measured exactly."""
        squares = np.square(vectors).sum(axis=1)
        rough = self.squares[:, None] + squares - 2 * (self.vectors @ vectors.T)
        rough[self.keys[:, None] == keys] = np.inf
        bound = np.square(self.distance[:, -1])
        if np.isinf(bound).any():
            at = min(self.k, len(keys)) - 1
            bound = np.minimum(bound, np.partition(rough, at, axis=1)[:, at]) if at == self.k - 1 else bound
        room = 1e-6 * (1 + self.squares.max() + squares.max())
        row, col = np.nonzero((rough <= (bound + room)[:, None]) & (rough < np.inf))
        exact = np.round(np.sqrt(np.square(self.vectors[row] - vectors[col]).sum(axis=1)), 9)
        n = np.arange(len(self.keys))
        row, distance, other = np.concatenate([np.repeat(n, self.k), row]), np.concatenate([self.distance.ravel(), exact]), np.concatenate([self.other.ravel(), keys[col]])
        order = np.lexsort((other, distance, row))
        best = order[np.searchsorted(row[order], n)[:, None] + np.arange(self.k)]
        self.distance, self.other = distance[best], other[best]

    def found(self) -> pa.RecordBatch:
        own = np.isfinite(self.distance)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.keys, self.k)[own.ravel()]), pa.array(self.other[own]), pa.array(self.distance[own])], ["key", "other", "distance"])


def nearest_others(vectors: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """vectors(key long, embedding) -> (key, other, rank): the k nearest other vectors of each, by L2 distance to nine digits, then key.

    Vectors are dealt by the hash of their key into blocks of about BLOCK; every block meets every block. A block keeps its
    k best over all that it meets in a task, and only these are shuffled. Nulls have no neighbours.
    """
    own = vectors.where(F.col("embedding").isNotNull()).select(F.col(key).cast("long").alias("key"), "embedding")
    blocks = max(1, math.ceil(own.count() / BLOCK))
    asked = own
    for copy in (("embedding", F.pmod("key", F.lit(64))), ("embedding",)):  # no other copy of a vector can be among the k best
        own = own.withColumn("copy", F.row_number().over(Window.partitionBy(*copy).orderBy("key"))).where(F.col("copy") <= k + 1).drop("copy")
    packed = lambda df: df.groupBy(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("key", "embedding")).alias("rows"))
    side = lambda df, name: packed(df).select(F.col("block").alias(f"{name}_block"), F.col("rows.key").alias(f"{name}_keys"), F.col("rows.embedding").alias(f"{name}_vectors"))
    met = side(asked, "a").crossJoin(side(own, "b")).select("a_block", "a_keys", "a_vectors", "b_keys", "b_vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(batch: pa.RecordBatch, name: str, row: int) -> tuple[np.ndarray, np.ndarray]:
            keys = batch.column(f"{name}_keys")[row].values.to_numpy()
            return keys, batch.column(f"{name}_vectors")[row].values.flatten().to_numpy().reshape(len(keys), -1).astype(np.float64)

        block, state = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                now = batch.column("a_block")[row].as_py()
                if state is None or now != block:
                    if state is not None:
                        yield state.found()
                    block, state = now, _Nearest(*read(batch, "a", row), k)
                state.meet(*read(batch, "b", row))
        if state is not None:
            yield state.found()

    best = met.mapInArrow(run, "key long, other long, distance double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("distance", "other")))
    return ranked.where(F.col("rank") <= k).select(F.col("key").alias(key), "other", "rank")


@F.pandas_udf(T.BinaryType())
def to_bytes(vector: pd.Series) -> pd.Series:
    """float32, little-endian."""
    return vector.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_bytes(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else np.frombuffer(b, "<f4").tolist())


def hashing_embedder(dim: int = DIM) -> Callable[[list[str]], np.ndarray]:
    """Signed feature hashing of words and their 3-grams, normalised. Deterministic, and needs no files."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in enumerate(texts):
            for word in "".join(c.lower() if c.isalnum() else " " for c in text).split():
                for part in [word, *(word[i : i + 3] for i in range(len(word) - 2))]:
                    h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")
                    out[row, h % dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return embed


_MODELS: dict[tuple[str, str], Callable[[list[str]], np.ndarray]] = {}


def loaded(load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[list[str]], np.ndarray]:
    """load(), called once a process for a function that a module names; others may differ under one name."""
    name = (load.__module__, load.__qualname__)
    if "<" in name[1] or name[0] == "__main__":
        return load()
    if name not in _MODELS:
        _MODELS[name] = load()
    return _MODELS[name]


def embed(text: Column, load: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_embedder) -> Column:
    """array<float> of each text; `load` returns the model, and a worker process that is used again keeps it. A failing
    batch is retried text by text, and what fails alone is null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(load)
        for batch in batches:
            out: list = []
            for at in range(0, len(batch), BATCH):
                texts = batch.iloc[at : at + BATCH].fillna("").tolist()
                try:
                    out += [list(map(float, v)) for v in model(texts)]
                except Exception:
                    for t in texts:
                        try:
                            out.append(list(map(float, model([t])[0])))
                        except Exception:
                            out.append(None)
            yield pd.Series(out)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")(text)


def upserted(embeddings: DataFrame, new: DataFrame) -> DataFrame:
    """embeddings with new's vectors in place of those of the same symbol; of several new ones of a symbol, the greatest."""
    one = new.groupBy("symbol_id").agg(F.max("embedding").alias("embedding"))
    return embeddings.join(one.select("symbol_id"), "symbol_id", "left_anti").select("symbol_id", "embedding").unionByName(one)


def cleared(embeddings: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """embeddings without those of ids(symbol_id); without any, none is left."""
    return embeddings.limit(0) if ids is None else embeddings.join(ids.select("symbol_id").distinct(), "symbol_id", "left_anti")


def needing_embeddings(content: DataFrame, symbols: DataFrame, embeddings: DataFrame) -> DataFrame:
    """symbol_id of content without a vector; variables are not embedded."""
    wanted = symbols.where("kind != 'variable'").select(F.col("id").alias("symbol_id"))
    return content.select("symbol_id").join(wanted, "symbol_id", "left_semi").join(embeddings.select("symbol_id"), "symbol_id", "left_anti")


def index_embeddings(content: DataFrame, symbols: DataFrame, embeddings: DataFrame, force: bool = False, load=hashing_embedder) -> DataFrame:
    """embeddings with those that were missing (force: all) computed from the compact text; failures are left out."""
    old = embeddings.limit(0) if force else embeddings
    need = needing_embeddings(content, symbols, old)
    text = S.compact_text(F.col("header"), F.col("content"))
    new = content.join(need, "symbol_id", "left_semi").select("symbol_id", embed(text, load).alias("embedding")).where("embedding IS NOT NULL")
    return old.unionByName(new)
