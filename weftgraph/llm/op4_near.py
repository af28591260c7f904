"""MinHash near-duplicates with tensored banding.

Each document gets two collections of COLLECTION small hashes, each of ROWS min-hashes; a table's key pairs one hash of
the first collection with one of the second, so COLLECTION ** 2 tables need 2 * COLLECTION * ROWS min-hashes only. Small
hashes that no other document shares can't be in a shared key and are dropped before pairing. Candidates that meet in a
table are confirmed on their full shingle sets, and links make components.

A set of shingles is one node, whichever rows have it. Verification is linear in the members of a table's buckets:

1. A node is tested against one member of all its buckets, that which shares most small hashes with others.
2. In each bucket that still holds several components, one member of each is tested against one of the largest component
   there; at most TURNS times.
3. Nodes of buckets that still hold several components are joined exactly: two sets that are similar enough share one of
   their rarest shingles, at places that leave room for the common part that their sizes ask for (prefix, length and
   position filters). Under such a shingle only pairs across components are formed, so a component of any size costs a
   pair for each member outside it and no more.

So every pair that meets in a table is linked if its sets are similar enough; no candidate is dropped and none is capped.

Defined cases: null and empty texts and texts without words have an empty set and are linked with nothing; texts with
fewer words than a shingle have one shingle, the whole sequence; texts of any length are read whole, batches are bounded
in bytes; rows of one doc_id are linked by their sets, each by its own; repeated rows share everything; a null doc_id has
a null component and is kept; ties in choosing members go to the smaller node, and first_of_each() keeps the row of lowest
(doc_id, md5 of text) of a component; an empty table gives an empty result; extra columns are ignored by
near_duplicates() and kept by first_of_each(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .graph import components
from .shingles import by_bytes, mix, shingle_sets

COLLECTION, ROWS, PERCENT, TURNS = 12, 3, 80, 2
BAND = 1.04  # sizes of one band of the exact join differ by this factor at most
NODE_BITS = 54  # nodes are numbers of a table's rows: 2 ** 21 partitions of 2 ** 33 rows
_SEED = np.random.default_rng(7)
_A = _SEED.integers(1, 2**63, 2 * COLLECTION * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _SEED.integers(1, 2**63, 2 * COLLECTION * ROWS, dtype=np.uint64)


def small_hashes(own: np.ndarray) -> np.ndarray:
    """The 2 * COLLECTION small hashes of a set."""
    low = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 2048):
        low = np.minimum(low, (own[at : at + 2048, None] * _A + _B).min(axis=0))
    low = low.reshape(2 * COLLECTION, ROWS)
    out = low[:, 0]
    for r in range(1, ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + low[:, r])
    return out


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, text_key, n_shingles, set_key binary, sketch array<long>); set_key and sketch are
    null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                n, keys, found = [], [], []
                for own in shingle_sets([t.as_py() or "" for t in part.column("text")], k):
                    n.append(len(own))
                    if len(own):
                        again = mix(own ^ np.uint64(0xA5A5A5A5DEADBEEF))
                        keys.append(np.array([own.sum(), again.sum(), len(own)], np.uint64).tobytes())
                        found.append(small_hashes(own).view(np.int64).tolist())
                    else:
                        keys.append(None)
                        found.append(None)
                columns = [part.column("doc_id"), part.column("text_key"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_shingles", "set_key", "sketch"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    return own.mapInArrow(run, "doc_id long, text_key binary, n_shingles long, set_key binary, sketch array<long>")


def classes_of(found: DataFrame) -> DataFrame:
    """(node, n, doc_id, text_key, set_key, sketch), a row for each set; doc_id and text_key are those of its first row."""
    one = found.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()).groupBy("set_key")
    own = one.agg(F.min(F.struct("doc_id", "text_key")).alias("x"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    # written at once: the numbers of a table's rows are unique, whatever is run again
    return store.written(own.select(F.monotonically_increasing_id().alias("node"), "n", "x.doc_id", "x.text_key", "set_key", "sketch"), "near-classes")


def table_keys(nodes: DataFrame) -> DataFrame:
    """nodes(node, sketch) -> (key, rank): the tables' keys made of small hashes that at least two nodes have.

    rank orders nodes by how many nodes share their small hashes, in steps of an eighth of a doubling; its low bits are
    the node."""
    small = nodes.select("node", F.posexplode("sketch").alias("slot", "value"))
    shared = small.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    of = lambda low: F.collect_list(F.when((F.col("slot") < COLLECTION) == F.lit(low), F.struct("slot", "value")))  # noqa: E731  COLLECTION at most
    own = small.join(shared, ["slot", "value"]).groupBy("node").agg(of(True).alias("first"), of(False).alias("second"), F.sum("c").alias("degree"))
    ranked = own.withColumn("rank", F.shiftleft(F.floor(F.log2("degree") * 8).cast("long"), NODE_BITS) + F.col("node"))
    paired = ranked.select("rank", F.explode("first").alias("x"), "second").select("rank", "x", F.explode("second").alias("y"))
    return store.written(paired.select(F.xxhash64("x.slot", "x.value", "y.slot", "y.value").alias("key"), "rank"), "near-keys")


def _node(rank: str) -> Column:
    return F.col(rank).bitwiseAND(F.lit((1 << NODE_BITS) - 1).cast("long"))


def sets_of(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, n, own binary) of nodes(node, doc_id, text_key): the sorted hashes of their shingles as 8-byte integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                own = shingle_sets([t.as_py() or "" for t in part.column("text")], k)
                columns = [part.column("node"), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "n", "own"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    one = texts.join(nodes, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])  # rows may be repeated
    return store.written(one.select("node", "text").mapInArrow(run, "node long, n long, own binary"), "near-sets")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) of nodes whose sets(node, own) are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("own_a"), batch.column("own_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True)) if _fit(len(x), len(y)) else 0
                keep.append(bool(both) and 100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda side: sets.select(F.col("node").alias(side), F.col("own").alias(f"own_{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "own_a", "own_b").mapInArrow(run, "a long, b long")


def _fit(a, b):
    return 100 * min(a, b) >= PERCENT * max(a, b)


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _rare(sets: DataFrame) -> DataFrame:
    """sets(node, n, own) -> (node, n, shared array<struct<c, x>>): shingles that other sets have, too, the rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "own"):
                own = [np.frombuffer(v.as_buffer(), np.int64) for v in part.column("own")]
                sizes = [len(x) for x in own]
                columns = [pa.array(np.repeat(part.column(c).to_numpy(), sizes)) for c in ("node", "n")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(own) if own else np.zeros(0, np.int64))], ["node", "n", "x"])

    each = sets.select("node", "n", "own").mapInArrow(run, "node long, n long, x long")
    counts = each.groupBy("x").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return each.join(counts, "x").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "x"))).alias("shared"))  # as many as the set has


def _least_common(a: int | np.ndarray, b: int | np.ndarray) -> int | np.ndarray:
    """How many shingles sets of these sizes have in common at least, if they are similar enough."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_keys(sets: DataFrame) -> DataFrame:
    """sets(node, component, n, own) -> (x, band, probe, node, component, n, rest): under which sets meet.

    Shingles are ordered by how many sets have them. With a first common shingle that has rest - 1 after it in a set, the
    common part has `rest` shingles at most. A set is filed under the band of its own size where `rest` is enough for a
    set of the same size (which asks for least), and probes the bands of smaller sizes for which `rest` is enough.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in by_bytes(batch, "shared")):
            out: list[list[np.ndarray]] = [[] for _ in range(7)]
            for node, component, n, shared in zip(*(part.column(c).to_pylist() for c in ("node", "component", "n")), part.column("shared"), strict=True):
                x = shared.values.field("x").to_numpy()
                rest = np.arange(len(x), 0, -1)
                filed = x[rest >= _least_common(n, n)]
                least = -(-PERCENT * n // 100)
                most = np.minimum(n, rest * (100 + PERCENT) // PERCENT - n)  # the largest smaller set that `rest` is enough for
                probing = np.flatnonzero(most >= least)
                low, high = _band(np.full(len(probing), least)), _band(most[probing])
                count = high - low + 1
                at = np.repeat(probing, count)
                band = np.repeat(low + count - np.cumsum(count), count) + np.arange(len(at))
                for column, mine, theirs in (
                    (0, filed, x[at]),
                    (1, np.full(len(filed), _band(np.array([n]))[0]), band),
                    (2, np.zeros(len(filed), bool), np.ones(len(at), bool)),
                    (3, np.full(len(filed), node), np.full(len(at), node)),
                    (4, np.full(len(filed), component), np.full(len(at), component)),
                    (5, np.full(len(filed), n), np.full(len(at), n)),
                    (6, rest[: len(filed)], rest[at]),
                ):
                    out[column] += [mine, theirs]
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(np.concatenate(c), t) for c, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["x", "band", "probe", "node", "component", "n", "rest"])

    rare = _rare(sets).join(sets.select("node", "component"), "node").select("node", "component", "n", "shared")
    return rare.mapInArrow(run, "x long, band long, probe boolean, node long, component long, n long, rest long")


def _band(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / np.log(BAND)).astype(np.int64)


def across(sets: DataFrame) -> DataFrame:
    """sets(node, component, n, own) -> pairs (a, b) across components that may be similar enough: an exact filter."""
    keys = store.written(prefix_keys(sets), "near-prefixes")
    own = keys.groupBy("x", "band", "component").agg(F.count(F.lit(1)).alias("c"))
    largest = own.groupBy("x", "band").agg(F.max_by("component", F.struct("c", "component")).alias("largest"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").drop("kinds")
    keys = store.written(keys.join(largest, ["x", "band"]), "near-prefixes")
    filed, probes = keys.where("NOT probe"), keys.where("probe").select("x", "band", *(F.col(c).alias(f"{c}_") for c in ("node", "component", "n", "rest", "largest")))
    room = F.least("rest", "rest_") * (100 + PERCENT) >= (F.col("n") + F.col("n_")) * PERCENT
    met = (F.col("component") != F.col("component_")) & (F.col("n") <= F.col("n_")) & room
    outside = filed.where("component != largest").join(probes, ["x", "band"]).where(met)
    inside = filed.where("component = largest").join(probes.where("component_ != largest_"), ["x", "band"]).where(met)
    return outside.select(*_ordered("node", "node_")).unionByName(inside.select(*_ordered("node", "node_"))).distinct()


def near_duplicates(docs: DataFrame, k: int = 2) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, text_key, n_shingles, set_key, component, component_id): sets at least PERCENT %
    similar are linked; component_id is the smallest doc_id of the component. Rows without doc_id or set have no component."""
    mark = store.mark()
    found = store.written(sketches(docs, k), "near-sketches")
    classes = classes_of(found)
    every = table_keys(classes)
    pivots = every.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max("rank").alias("top")).where("c > 1").select("key", "top")
    keys = store.written(every.join(pivots, "key").select("key", "top", "rank", _node("rank").alias("node")), "near-buckets")
    store.dropped(every)
    sets = sets_of(docs, classes.select("node", "doc_id", "text_key").join(keys.select("node").distinct(), "node", "left_semi"), k)
    best = keys.where("rank != top").groupBy("node").agg(F.max("top").alias("top")).select("node", _node("top").alias("pivot"))
    pairs = store.written(best.select(*_ordered("node", "pivot")).distinct(), "near-pairs")
    tested, links = pairs, store.written(confirm(pairs, sets), "near-links")
    state = store.written(components(links), "near-components")

    def named() -> DataFrame:
        return keys.select("key", "rank", "node").join(state, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def linked(new: DataFrame) -> DataFrame:
        return store.written(components(new.unionByName(state.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b")))), "near-components")

    for _ in range(TURNS):
        kinds = named().groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.max("rank").alias("rank"))
        several = kinds.groupBy("key").agg(F.max(F.struct("c", "rank")).alias("first"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
        met = kinds.join(several.select("key", F.col("first.rank").alias("top")), "key").where("rank != top").select(_node("rank").alias("node"), _node("top").alias("pivot"))
        pairs = store.written(met.select(*_ordered("node", "pivot")).distinct().join(tested, ["a", "b"], "left_anti"), "near-pairs")
        new = store.written(confirm(pairs, sets), "near-links")
        tested = tested.unionByName(pairs)
        if new.isEmpty():
            break
        state = linked(new)
    split = named().groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    still = named().join(split, "key", "left_semi").select("node", "component").distinct()
    pairs = across(store.written(sets.join(still, "node"), "near-open"))
    new = store.written(confirm(store.written(pairs.join(tested, ["a", "b"], "left_anti"), "near-pairs"), sets), "near-links")
    if not new.isEmpty():
        state = linked(new)
    store.sweep(mark, found, classes, state)
    placed = classes.select("node", "set_key", "doc_id").join(state, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = placed.select("set_key", "component", "doc_id")
    lowest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    joined = found.drop("sketch").join(placed.drop("doc_id").join(lowest, "component"), "set_key", "left")
    known = F.col("doc_id").isNotNull()
    return joined.select("doc_id", "text_key", "n_shingles", "set_key", F.when(known, F.col("component")).alias("component"), F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"))


def first_of_each(docs: DataFrame, k: int = 5) -> DataFrame:
    """The rows of docs that are the first of their component; rows without doc_id or words stay, equal ones (doc_id and
    text) once."""
    found = near_duplicates(docs, k).where("component IS NOT NULL").select("component", F.struct("doc_id", "text_key").alias("at"))
    found = store.written(found, "near-rows")
    firsts = found.groupBy("component").agg(F.min("at").alias("first"))
    gone = found.join(firsts, "component").where("at != first").select("at").distinct()
    own = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key")).alias("at"), F.struct("*").alias("row"))
    kept = own.join(gone, "at", "left_anti")
    known = kept.where("at.doc_id IS NOT NULL").dropDuplicates(["at"])
    return kept.where("at.doc_id IS NULL").unionByName(known).select("row.*")


def op4_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on two-word shingles."""
    found = near_duplicates(store.documents(spark, sf_dir), 2)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
