"""Removal of repeated passages by bucket-pointer refinement.

A byte goes if a LENGTH-byte string that covers it also starts earlier. Suffixes aren't sorted whole: only places that
can repeat are. Each LENGTH-byte window owns an anchor, the leftmost Q-gram of the lowest hash in it, so equal windows
own equal Q-grams at equal offsets. Anchors whose Q-gram stands once are dropped; the others' Q-grams are buckets.

Within a bucket, every offset of the bytes around its members begins in the bucket of its first 8 bytes. Buckets of more
than one are then refined by sorting on the bucket identifiers of later offsets, which the step before has refined in the
same way: 8 bytes become 16, 32, 64 and LENGTH. Windows that end in one bucket are equal; all but the first go.

Equal texts are one text, kept by the smallest doc_id: in the others every byte goes. Members with equal surroundings (by
128 bits) are one member, so a passage copied a million times is refined once. A bucket with over LARGE different
surroundings is too large for a task: a shuffle groups its windows by their bytes instead. No string of the corpus is
compared with all others, and none is skipped.

Matches never cross documents. Order is by doc_id, then start; a null doc_id comes first. Rows equal in doc_id and text
are one document, in which neither precedes the other; of different texts under one doc_id, one precedes by its digest.
Null and empty texts, and texts under LENGTH bytes, keep all bytes; long texts are read whole, in batches bounded by
bytes; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .shingles import _powers, by_bytes, mix

LENGTH, Q, LARGE = 100, 32, 10_000
SIDE = LENGTH - Q  # bytes on each side of an anchor that its windows reach
WIDE = SIDE + LENGTH
REMEMBERED = 1 << 20  # members whose bytes a task has given
_TABLES = np.random.default_rng(11).integers(1, 2**63, (2, 256), dtype=np.uint64) | np.uint64(1)
_BYTE = _TABLES[0]


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the Q-grams that the windows of data own."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, inverse = _powers(n + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[np.frombuffer(data, np.uint8)] * power[:n])])
    grams = mix((sums[Q:] - sums[:-Q]) * inverse[: n - Q + 1])
    low, size = grams, 1  # the lowest of `size` grams from each place, by doubling
    span = SIDE + 1
    while size < span:
        step = min(size, span - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    # runs of windows with one lowest hash: the leftmost place of it in the first window serves until it slides out
    windows = len(low)
    starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    lengths = np.diff(np.concatenate([starts, [windows]]))
    views = np.lib.stride_tricks.sliding_window_view(grams, span)
    at = np.concatenate([starts[k : k + 4096] + views[starts[k : k + 4096]].argmin(axis=1) for k in range(0, len(starts), 4096)])
    more = [at]
    for k in np.flatnonzero(starts + lengths - 1 > at).tolist():  # then an equal one to its right does
        s, last = int(starts[k]), int(starts[k] + lengths[k] - 1)
        equal = np.flatnonzero(grams[s : last + span] == low[s]) + s
        before = np.concatenate([[s - 1], equal[:-1]])
        more.append(equal[np.maximum(before + 1, s) <= np.minimum(equal, last)])
    at = np.unique(np.concatenate(more))
    return grams[at], at


def anchor_rows(texts: DataFrame) -> DataFrame:
    """texts(doc, text) -> (gram, doc, pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in by_bytes(batch, "text", 512)):
            grams, docs, places = [], [], []
            for doc, text in zip(part.column("doc").to_pylist(), part.column("text"), strict=True):
                own, at = anchors(text.as_py().encode())
                grams.append(own)
                places.append(at)
                docs.append(np.full(len(at), doc, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(docs)), pa.array(np.concatenate(places).astype(np.int32))], ["gram", "doc", "pos"])

    return texts.select("doc", "text").mapInArrow(run, "gram long, doc long, pos int")


def surroundings(texts: DataFrame, places: DataFrame) -> DataFrame:
    """A row for each repeated anchor: (gram, doc, pos, at, size, m1, m2, around). m1 and m2 are 128 bits of the bytes
    around it, `size` of them, in which it stands at `at`; a task gives the bytes with the first row of each member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for part in (p for batch in batches for p in by_bytes(batch, "text")):
            columns: list[list] = [[] for _ in range(7)]
            slices: list[bytes | None] = []
            for doc, text, own in zip(part.column("doc").to_pylist(), part.column("text"), part.column("own"), strict=True):
                data = text.as_py().encode()
                gram, pos = (own.values.field(c).to_numpy() for c in ("gram", "pos"))
                low, high = np.maximum(pos - SIDE, 0), np.minimum(pos + LENGTH, len(data))
                power, inverse = _powers(len(data) + 1)
                codes = np.frombuffer(data, np.uint8)
                names = []
                for table in _TABLES:
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(table[codes] * power[: len(data)])])
                    names.append(mix((sums[high] - sums[low]) * inverse[low] + (high - low).astype(np.uint64) * np.uint64(256) + (pos - low).astype(np.uint64)).view(np.int64))
                for column, value in zip(columns, (gram, np.full(len(pos), doc), pos, pos - low, high - low, *names), strict=True):
                    column.append(value)
                if len(given) > REMEMBERED:
                    given.clear()
                for name, a, b in zip(names[0].tolist(), low.tolist(), high.tolist(), strict=True):
                    if name in given:
                        slices.append(None)
                    else:
                        given.add(name)
                        slices.append(data[a:b])
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            arrays = [pa.array(np.concatenate(c).astype(t.to_pandas_dtype()), t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(slices, pa.binary())], ["gram", "doc", "pos", "at", "size", "m1", "m2", "around"])

    own = places.groupBy("doc").agg(F.collect_list(F.struct("gram", "pos")).alias("own"))  # as many as the text has
    return texts.join(own, "doc").select("doc", "text", "own").mapInArrow(run, "gram long, doc long, pos int, at int, size int, m1 long, m2 long, around binary")


def refine(bucket: np.ndarray, around: list[bytes], at: np.ndarray) -> np.ndarray:
    """Rows of buckets, earliest first in each -> (row, offset): whether the window that begins at that offset of the
    surroundings stands in an earlier row of the bucket. Windows that surroundings cut short are False."""
    m = len(around)
    cells = np.zeros((m, WIDE + 8), np.uint8)
    for i, (x, a) in enumerate(zip(around, at.tolist(), strict=True)):
        cells[i, SIDE - a : SIDE - a + len(x)] = np.frombuffer(x, np.uint8)
    size = np.array([len(x) for x in around])
    offsets = np.arange(SIDE + 1)
    whole = (offsets >= SIDE - at[:, None]) & (offsets + LENGTH <= SIDE - at[:, None] + size[:, None])
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(cells, 8, axis=1)[:, : WIDE - 7]).view(np.uint64)[..., 0]
    # initial buckets: an offset of a Q-gram's members, and 8 bytes there
    _, ids = np.unique(eight, return_inverse=True)
    place = bucket[:, None].astype(np.int64) * WIDE + np.arange(WIDE - 7)
    _, ids, counts = np.unique((place * (ids.max(initial=0) + 1) + ids.reshape(m, -1)).ravel(), return_inverse=True, return_counts=True)
    open_at = np.flatnonzero(counts[ids] > 1)  # a bucket of one stays as it is
    length, width, fresh = 8, WIDE - 7, len(counts)
    while length < LENGTH and len(open_at):
        step = min(length, LENGTH - length)
        open_at = open_at[open_at % width + step + length <= WIDE]
        _, own, counts = np.unique(ids[open_at] * fresh + ids[open_at + step], return_inverse=True, return_counts=True)
        ids[open_at] = own + fresh
        open_at, fresh, length = open_at[counts[own] > 1], fresh + len(counts), length + step
    out = np.zeros((m, SIDE + 1), bool)
    row, offset = np.divmod(open_at, width)
    keep = offset <= SIDE
    row, offset = row[keep], offset[keep]
    keep = whole[row, offset]
    row, offset = row[keep], offset[keep]
    last = ids[row * width + offset]
    order = np.argsort(last, kind="stable")  # rows ascend, so the earliest of a bucket comes first
    again = order[1:][last[order][1:] == last[order][:-1]]
    out[row[again], offset[again]] = True
    return out


def _runs(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"lo": int(a), "hi": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]


RUNS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def refined(members: DataFrame) -> DataFrame:
    """members(gram, m1, m2, around, at, doc, pos), different surroundings of buckets -> (gram, m1, m2, runs)."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        grams = rows.column("gram").to_numpy()
        bucket = np.concatenate([[0], np.cumsum(grams[1:] != grams[:-1])])
        found = refine(bucket, rows.column("around").to_pylist(), rows.column("at").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(grams), *(pa.array(rows.column(c).to_numpy()) for c in ("m1", "m2")), pa.array([_runs(x) for x in found], RUNS)], ["gram", "m1", "m2", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 4096:
                table = pa.Table.from_batches(held)
                grams = table.column("gram").to_numpy()
                whole = int(np.flatnonzero(grams != grams[-1])[-1]) + 1 if grams[0] != grams[-1] else 0
                if whole:
                    yield solve(table.slice(0, whole))
                held, rows = table.slice(whole).to_batches(), len(table) - whole
        if rows:
            yield solve(pa.Table.from_batches(held))

    ordered = members.select("gram", "m1", "m2", "around", "at", "doc", "pos").repartition("gram").sortWithinPartitions("gram", "doc", "pos")
    return ordered.mapInArrow(run, "gram long, m1 long, m2 long, runs array<struct<lo:int,hi:int>>")


def by_shuffle(members: DataFrame) -> DataFrame:
    """What refined() gives, for buckets of any size: windows are grouped by their bytes with a map-side minimum."""
    place = F.struct("doc", "pos")
    low, high = F.lit(SIDE) - F.col("at"), F.lit(SIDE - LENGTH) - F.col("at") + F.length("around")
    rows = members.where(high >= low).select("gram", "m1", "m2", place.alias("place"), "around", low.alias("low"), F.explode(F.sequence(low, high)).alias("offset"))
    rows = rows.select("gram", "m1", "m2", "place", "offset", F.substring(F.col("around"), F.col("offset") - F.col("low") + 1, F.lit(LENGTH)).alias("window"))
    firsts = store.written(rows.groupBy("gram", "offset", "window").agg(F.min("place").alias("first")), "repeat-windows")
    again = rows.join(firsts, ["gram", "offset", "window"]).where("place != first")
    return again.groupBy("gram", "m1", "m2").agg(F.transform(F.sort_array(F.collect_list("offset")), lambda o: F.struct(o.cast("int").alias("lo"), o.cast("int").alias("hi"))).alias("runs"))


def texts_of(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text_key, text) -> (doc, doc_id, text_key, text), a row for each text of LENGTH bytes or more, with its
    smallest doc_id; `doc` numbers them in order of doc_id."""
    known = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")
    one = docs.where(F.octet_length("text") >= LENGTH).groupBy("text_key").agg(F.min(known).alias("first"), F.first("text").alias("text"))
    ordered = one.orderBy("first", "text_key")  # so partitions and their rows are in order, and so are the numbers
    return store.written(ordered.select(F.monotonically_increasing_id().alias("doc"), F.col("first.doc_id").alias("doc_id"), "text_key", "text"), "repeat-texts")


def removed(texts: DataFrame) -> DataFrame:
    """texts(doc, text), a written table -> (doc, spans array<struct<s, e>>): unmerged byte ranges to remove, sorted."""
    found = anchor_rows(texts)
    shared = store.written(found.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram"), "repeat-grams")
    places = store.written(found.join(shared, "gram"), "repeat-places")
    rows = store.written(surroundings(texts, places), "repeat-rows")
    store.dropped(shared, places)
    member = ["gram", "m1", "m2"]
    firsts = store.written(rows.groupBy(*member).agg(F.min(F.struct("doc", "pos")).alias("first")), "repeat-members")
    sizes = firsts.groupBy("gram").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    given = rows.where("around IS NOT NULL").dropDuplicates(member).select(*member, "at", "around")
    sized = store.written(firsts.join(sizes, "gram").join(given, member).select(*member, "first.doc", "first.pos", "at", "around", "size"), "repeat-sized")
    large = sized.where(F.col("size") > LARGE)
    runs = refined(sized.where(F.col("size") <= LARGE))
    if not large.isEmpty():
        runs = runs.unionByName(by_shuffle(large))
    told = store.written(firsts.join(runs, member, "left"), "repeat-runs")
    store.dropped(sized, firsts)
    start = F.col("pos") - SIDE
    whole = F.struct((F.col("pos") - F.col("at")).alias("s"), (F.col("pos") - F.col("at") + F.col("size")).alias("e"))
    own = F.transform(F.col("runs"), lambda r: F.struct((start + r["lo"]).alias("s"), (start + r["hi"] + LENGTH).alias("e")))
    first = F.col("first") == F.struct("doc", "pos")
    spans = rows.where(F.col("size") >= LENGTH).select(*member, "doc", "pos", "at", "size").join(told, member).select("doc", F.explode(F.when(first, own).otherwise(F.array(whole))).alias("x"))
    out = store.written(spans.groupBy("doc").agg(F.sort_array(F.collect_set("x")).alias("spans")), "repeat-spans")
    store.dropped(rows, told)
    return out


SPANS = "doc_id long, n_bytes long, spans array<struct<s:int,e:int>>, kept binary"


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> SPANS: maximal removed byte ranges and the bytes that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in by_bytes(batch, "text")):
            n, spans, kept = [], [], []
            for text, own, again in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), part.column("again").to_pylist(), strict=True):
                data = (text or "").encode()
                merged: list[dict] = [{"s": 0, "e": len(data)}] if again else []
                for x in () if again else own or ():
                    if merged and x["s"] <= merged[-1]["e"]:
                        merged[-1]["e"] = max(merged[-1]["e"], x["e"])
                    else:
                        merged.append(dict(x))
                edges = [0, *(v for x in merged for v in (x["s"], x["e"])), len(data)]
                n.append(len(data))
                spans.append(merged)
                kept.append(b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
            types = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(spans, types), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key(F.col("text")).alias("text_key"), "text")
    mark = store.mark()
    texts = texts_of(keyed)
    told = texts.select("doc", "text_key", F.col("doc_id").alias("first_id"), F.lit(True).alias("found")).join(removed(texts), "doc", "left")
    told = store.written(told.select("text_key", "first_id", "found", "spans"), "repeat-told")
    store.sweep(mark, told)
    again = F.coalesce("found", F.lit(False)) & ~F.col("doc_id").eqNullSafe(F.col("first_id"))
    return keyed.join(told, "text_key", "left").select("doc_id", "text", "spans", again.alias("again")).mapInArrow(run, SPANS)


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 100-byte strings that start earlier, too."""
    found = without_repeats(store.documents(spark, sf_dir))
    cut = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
    return found.select("doc_id", "n_bytes", cut.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
