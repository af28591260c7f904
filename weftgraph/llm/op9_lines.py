"""Line dedup by a segment-partition edit join.

Lines are linked if their edit distance is at most RULE.allowed(characters of the shorter one): one edit from `chars`
characters on, and one for each `each` characters however long the line is, so a changed word of a long line is linked.
Any numbers can be asked for.

With at most e edits, one of e + 1 segments of the shorter line, number i, stands unchanged in the longer, with exactly i
edits before it and e - i after it at most; so it is moved by i places at most from the start, or by e - i from the end:
segments of the first half are placed from the start, others from the end. Lines are filed under the segments that bands
of lengths prescribe; they probe, by substrings at the places that a longer line may have them, the bands of their own
and shorter lengths. Where a segment may move by many places, s pieces of it, a place apart each, are filed, and every
s-th place is probed. Candidates are verified along the diagonals that few edits reach. Linked lines make classes; the
first line of a class, by document and place, stays.

Equal lines are one node, so a line that stands in a third of all documents is compared once. Where a segment is shared by
over RULE.hot lines and DEEPEST edits are allowed at most, what stands after it is partitioned again under that key, with
the edits that are left for it, and then what stood before it, and so on until what is left is no longer than the edits
allowed: so lines that share a template form pairs in proportion to their links, and none is lost. A task that meets a hot
key itself deals out its rows evenly. With more edits the ways to spend them are too many for that (two make thousands of rows
a line): lines that a chain of such hot keys holds together are a group. All lines of a group are compared in blocks of
BLOCK, each pair once, whatever number of keys it shares: by their lengths, by how often they have which characters, and
along diagonals. Links within a group are counted where they are found, and a block gives a row a line, not a row a link.
Keys are hashes that only choose candidates; lines are told apart by 128 bits.

Defined cases: a null or empty text has no lines to remove; a null doc_id sorts first; rows equal in doc_id and text are
one document and keep the same lines; lines without a word are never removed; lines of any length are read whole; of
equal places the smaller document key is first; an empty table gives an empty result; extra columns are ignored by
line_classes() and kept by dedup_lines(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import pairwise
from math import isqrt, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .graph import components
from .shingles import _powers, by_bytes, mix

INDEX, PROBE, LEAF, SPREAD = 1, 2, 4, 8  # bits of a role
WORD = r"[^\x20\x09-\x0D]"
DEEPEST = 1  # edits up to which a hot key is partitioned further
TALLY, GRAMS = 64, 256  # kinds of characters, and of three in a row, that are counted before lines are compared
CUTS = (480, 768, 1152, 2304)  # lengths at which a pass over the lines ends, so that the keys of a part of them are shuffled at once
BLOCK = 512  # lines of a group that are compared with as many at once


@dataclass(frozen=True)
class Rule:
    chars: int = 24
    edits: int = 1
    hot: int = 40  # members of a key beyond which it is partitioned further, or compared in blocks
    each: int = 48

    def allowed(self, n: int) -> int:
        """An edit for each `chars` characters up to `edits` of them, and one for each `each` characters without an end."""
        return max(min(self.edits, n // self.chars), n // self.each)


RULE = Rule()


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most `most`: common ends are cut off, then diagonals are followed."""
    if abs(len(a) - len(b)) > most:
        return False
    if a == b:
        return True
    n = min(len(a), len(b))
    lo, hi = 0, n  # longest common prefix, by halving
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    a, b = a[lo:], b[lo:]
    n = min(len(a), len(b))
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[len(a) - mid : len(a) - lo] == b[len(b) - mid : len(b) - lo]:
            lo = mid
        else:
            hi = mid - 1
    if lo:
        a, b = a[:-lo], b[:-lo]
    if not a or not b:
        return max(len(a), len(b)) <= most
    if len(a) < len(b):
        a, b = b, a
    return diagonals(a, b, most)


def _same(a: str, i: int, b: str, j: int) -> int:
    """Length of the longest common prefix of a[i:] and b[j:]."""
    n, at, step = min(len(a) - i, len(b) - j), 0, 8
    while at < n and a[i + at : i + at + step] == b[j + at : j + at + step]:
        at, step = at + step, 2 * step
    if at >= n:
        return n
    high = min(step, n - at)  # it ends within so many characters
    low = 0
    while low < high:
        mid = (low + high + 1) // 2
        if a[i + at : i + at + mid] == b[j + at : j + at + mid]:
            low = mid
        else:
            high = mid - 1
    return at + low


def diagonals(a: str, b: str, most: int) -> bool:
    """len(a) >= len(b). With d edits, far[k] is the furthest place of a that is reached on the diagonal place in a - place
    in b = k (Landau and Vishkin); only diagonals that can still come back to the last one are followed."""
    m, n = len(a), len(b)
    goal = m - n
    far: dict[int, int] = {}
    for d in range(most + 1):
        now: dict[int, int] = {}
        for k in range(max(-d, goal - most + d), min(d, goal + most - d) + 1):
            if d:
                i = max(far.get(k, -2) + 1, far.get(k - 1, -2) + 1, far.get(k + 1, -2))
                if i < max(0, k):
                    continue
                i = min(i, m, n + k)
            else:
                i = 0
            if i < m and i - k < n and a[i] == b[i - k]:
                i += _same(a, i, b, i - k)
            now[k] = i
        if now.get(goal, -1) >= m:
            return True
        far = now
    return False


def document_key() -> Column:
    """128 bits of doc_id and text."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.coalesce("text", F.lit(""))).cast("binary")))


def line_key(line: str | Column = "line") -> Column:
    """128 bits."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, line_no, line) of lines with a word; lines are split at \\n."""
    keyed = docs.select(document_key().alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "text")  # once a document, not a line
    cut = keyed.select("doc", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))
    return cut.where(F.col("line").rlike(WORD))


def bands(most: int, allowed: Callable[[int], int], least: int, grow: float = 1.5) -> list[int]:
    """Lower bounds of bands of lengths from `least` to `most`, each with one number of edits, or from 16 edits on with
    numbers that differ by a sixteenth at most; lengths of a band differ by `grow` at most."""
    found = [least]
    while found[-1] <= most:
        low = found[-1]
        high = max(low + 1, int(low * grow))
        same = allowed(low) + allowed(low) // 16
        if allowed(high - 1) > same:
            a, b = low, high - 1  # the first length of more edits, by halving
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if allowed(mid) <= same else (a, mid)
            high = b
        found.append(high)
    return found


@lru_cache(4096)
def _plan(low: int, edits: int) -> np.ndarray:
    """Rows of segment, whether placed from the end, place, size, whether filed, whether probed."""
    size, rows = low // (edits + 1), []
    for i in range(edits + 1):
        moves = min(i, edits - i)
        s = max(1, min(isqrt(2 * moves), size // 4))
        end = i > edits - i
        place = (i - edits - 1) * size if end else i * size
        for off in sorted({*range(s), *range(-(moves // s) * s, -(-moves // s) * s + 1, s)}):
            rows.append((i, end, place + off, size - s + 1, 0 <= off < s, off % s == 0))
    return np.array(rows, np.int64).T


def first_keys(lines: list[str], rule: Rule, least: int = 0, end: int | None = None) -> list[np.ndarray]:
    """Number in `lines`, key, role, at, size, left, total: the segments and probes of whole lines. `left` of the `total`
    edits of a band are left for what follows the segment at at..at + size. Bands are those that begin in least..end - 1."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.array([len(x) for x in lines], np.int64)
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    power, inverse = _powers(len(codes) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * power[: len(codes)])])

    bounds = np.array(bands(int(n.max(initial=0)), rule.allowed, rule.chars))
    total = np.array([rule.allowed(b - 1) for b in bounds[1:].tolist()] + [0])  # the most in a band
    own = np.searchsorted(bounds, n, "right") - 1
    lowest = np.searchsorted(bounds, n - total[np.maximum(own, 0)], "right") - 1
    out: list[list[np.ndarray]] = [[] for _ in range(7)]
    for band in np.unique(own[own >= 0]).tolist():
        for b in range(max(0, int(lowest[own == band].min())), band + 1):
            if bounds[b] < least or end is not None and bounds[b] >= end:
                continue
            rows = np.flatnonzero((own == band) & (lowest <= b))
            edits = int(total[b])
            segment, behind, place, size, filed, probed = _plan(int(bounds[b]), edits)
            role = filed * INDEX * (b == band) + probed * PROBE
            at = behind * n[rows][:, None] + place
            r, c = np.nonzero((at >= 0) & (at + size <= n[rows][:, None]) & (role > 0))
            who, at, size = rows[r], at[r, c], size[c]
            low = start[who] + at
            key = mix((sums[low + size] - sums[low]) * inverse[low] + size.astype(np.uint64)) ^ mix(((int(bounds[b]) << 24) + segment[c]).astype(np.uint64))
            for column, value in zip(out, (who, key.view(np.int64), role[c], at, size, edits - segment[c], np.full(len(who), edits)), strict=True):
                column.append(value)
    return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]


def _key(*parts: object) -> int:
    value = xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def further_keys(key: int, role: int, rest: str, saved: str, left: int, total: int) -> Iterator[tuple]:
    """(key, role, rest, saved, at, size, left, total): segments and probes of `rest`, which has `left` of `total` edits at
    most; `saved` is what stood before segments and has the others.

    A row that is filed takes one branch; one that probes takes all that a filed one could have taken, for what is left of
    two lines differs in length by their edits at most. A leaf has nothing left that could tell lines apart.
    """
    if not left:  # the rest is the same in all lines of the key
        rest, saved, left = saved, "", total
    n, spent = len(rest), total - left
    bounds = bands(n + left, lambda _: left, left + 1)
    for low, high in pairwise(bounds):
        index = role & INDEX and low <= n < high
        if not index and not (role & PROBE and low <= n + left and high > n - left):
            continue
        size = low // (left + 1)
        for i in range(left + 1):
            for move in range(-i, i + 1):
                at = i * size + move
                if at < 0 or at + size > n:
                    continue
                mine = (INDEX if index and not move else 0) | role & PROBE
                if mine:
                    part, after = rest[at : at + size], rest[at + size :] if i == left else ""
                    yield _key(key, "s", low, i, part, after), mine, rest, saved, at, size, left - i, total
    short_index, short_probe = role & INDEX and n <= left, role & PROBE and n - left <= left
    if short_index or short_probe:
        more_index = short_index and spent and len(saved) > spent
        more_probe = short_probe and spent and len(saved) > 0
        if more_index or more_probe:
            yield from further_keys(_key(key, "v"), (INDEX if more_index else 0) | (PROBE if more_probe else 0), saved, "", spent, spent)
        leaf = (INDEX if short_index and not more_index else 0) | (PROBE if short_probe and (not spent or len(saved) <= 2 * spent) else 0)
        if leaf:
            yield _key(key, "l"), leaf | LEAF, rest, saved, 0, 0, left, total


#: place: at << 32 | size, or of many edits a line of the same hot key; state: total << 34 | left << 4 | role. Few and plain columns, for there are many rows.
LEVEL = "node long, key long, place long, state long"
DEEP = f"{LEVEL}, rest string, saved string"


def _packed(hot: int, node: np.ndarray, key: np.ndarray, role: np.ndarray, at: np.ndarray, size: np.ndarray, left: np.ndarray, total: np.ndarray) -> list[np.ndarray]:
    """LEVEL's columns. Rows beyond the first hot + 1 of a key that is hot in these rows alone, and under which some line
    is filed, get SPREAD; those of many edits name the first of them in `place`, and only one of equal ones stays."""
    order = np.lexsort(((role & INDEX) == 0, key))
    ordered = key[order]
    start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([start, [len(order)]]))
    spread = (np.arange(len(order)) - np.repeat(start, count) > hot) & np.repeat(role[order[start]] & INDEX > 0, count)
    role = role.astype(np.int64)
    role[order[spread & (role[order] & LEAF == 0)]] |= SPREAD
    place = np.where(total > DEEPEST, 0, at.astype(np.int64) << 32 | size)  # of keys that are partitioned further
    grouped = order[spread & (total[order] > DEEPEST)]
    place[grouped] = node[np.repeat(order[start], count)[spread & (total[order] > DEEPEST)]]
    keep = np.ones(len(key), bool)
    keep[grouped] = False
    keep[grouped[np.unique(np.stack([node[grouped], place[grouped]]), axis=1, return_index=True)[1]]] = True
    return [c[keep] for c in (node, key, place, total.astype(np.int64) << 34 | left.astype(np.int64) << 4 | role)]


def _first_level(nodes: DataFrame, rule: Rule, least: int = 0, end: int | None = None) -> DataFrame:
    """LEVEL of nodes(node, line), of the bands that begin in least..end - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in by_bytes(batch, "line", 4096, 1 << 20)):
            who, *columns = first_keys(part.column("line").to_pylist(), rule, least, end)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _packed(rule.hot, part.column("node").to_numpy()[who], *columns)], ["node", "key", "place", "state"])

    n = F.length("line")
    lines = nodes.where(n >= max(rule.chars, least))
    if end is not None:  # a band that begins below `end` ends below twice that
        lines = lines.where(n < 2 * end + rule.allowed(2 * end))
    return lines.select("node", "line").mapInArrow(run, LEVEL)


def _next_level(rows: DataFrame, rule: Rule) -> DataFrame:
    """DEEP of hot keys -> DEEP, partitioned further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in by_bytes(batch, "rest", 256, 1 << 18)):
            out = []
            for r in part.to_pylist():
                at, size, state = r["place"] >> 32, r["place"] & 0xFFFFFFFF, r["state"]
                before, after = r["saved"] + r["rest"][:at], r["rest"][at + size :]
                out += [(r["node"], *row) for row in further_keys(r["key"], state & (INDEX | PROBE), after, before, state >> 4 & 0x3FFFFFFF, state >> 34)]
            node, key, role, rest, saved, *ints = (list(c) for c in zip(*out, strict=True)) if out else [[]] * 9
            columns = _packed(rule.hot, *(np.array(c, np.int64) for c in (node, key, role, *ints)))
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(rest, pa.string()), pa.array(saved, pa.string())], ["node", "key", "place", "state", "rest", "saved"])

    return rows.mapInArrow(run, DEEP)


def _crossed(node: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """node and role of (groups, members) -> pairs of a filed and a probing member."""
    x, y = np.triu_indices(node.shape[1], 1)
    a, b, ra, rb = node[:, x], node[:, y], role[:, x], role[:, y]
    meet = ((ra & INDEX > 0) & (rb & PROBE > 0) | (rb & INDEX > 0) & (ra & PROBE > 0)) & (a != b)
    return a[meet], b[meet]


def _headed(rows: pa.Table, head: np.ndarray) -> pa.Table:
    """rows with `head` for place, where many edits are allowed."""
    place = np.where(rows.column("state").to_numpy() >> 34 > DEEPEST, head, rows.column("place").to_numpy())
    return rows.set_column(rows.schema.get_field_index("place"), rows.schema.field("place"), pa.chunked_array([pa.array(place, pa.int64())]))


class _Runs:
    """Rows in order of keys, filed ones first, a batch at a time -> pairs of cool keys and leaves, and rows of hot ones."""

    def __init__(self, hot: int) -> None:
        self.most = hot
        self.held: pa.Table | None = None  # the last rows, of one key that isn't hot as yet
        self.over: int | None = None  # the last key, if its other rows are hot, or are dropped
        self.head = 0  # its first line
        self.drop = False

    def meet(self, rows: pa.Table, last: bool) -> tuple[list[tuple[np.ndarray, np.ndarray]], pa.Table]:
        spread = rows.column("state").to_numpy() & SPREAD > 0
        over = rows.column("key").to_numpy() == self.over if self.over is not None else np.zeros(len(rows), bool)
        passed = _headed(rows, np.where(over & ~spread, self.head, rows.column("place").to_numpy())).filter(pa.array(spread | over & (not self.drop)))
        rest = rows.filter(pa.array(~spread & ~over))
        if self.held is not None:
            rest, self.held = pa.concat_tables([self.held, rest]), None
        key, node, role = (rest.column(c).to_numpy() for c in ("key", "node", "state"))
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate([start, [len(key)]]))
        filed, leaf = role[start] & INDEX > 0, role[start] & LEAF > 0
        hot, done = (count > self.most) & filed & ~leaf, np.ones(len(start), bool)
        if len(start) and not last:
            self.over, self.drop = (int(key[-1]), not filed[-1]) if hot[-1] or not filed[-1] else (None, False)
            self.head = int(node[start[-1]])
            if self.over is None:
                done[-1], self.held = False, rest.slice(int(start[-1]))
        pairs, cool = [], done & filed & ~hot & (count > 1)
        for c in np.unique(count[cool]).tolist():
            at, step = start[cool & (count == c)][:, None] + np.arange(c), max(1, (1 << 20) // (c * c))
            pairs += [_crossed(node[at[k : k + step]], role[at[k : k + step]]) for k in range(0, len(at), step)]
        return pairs, pa.concat_tables([passed, _headed(rest, np.repeat(node[start], count)).filter(pa.array(np.repeat(hot & done, count)))])


def _met(level: DataFrame, rule: Rule) -> DataFrame:
    """level's columns and a, b: pairs (a, b) that share a cool key or a leaf, and rows (a and b null) of hot keys."""
    names = level.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, schema = _Runs(rule.hot), None

        def found(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            pairs, hot = runs.meet(rows, last)
            if pairs:
                a, b = (np.concatenate(c) for c in zip(*pairs, strict=True))
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(both.shape[1], f.type) for f in schema), pa.array(both[0]), pa.array(both[1])], [*names, "a", "b"])
            for part in hot.to_batches():
                none = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, none, none], [*names, "a", "b"])

        for batch in batches:
            schema = batch.schema
            yield from found(pa.Table.from_batches([batch]), False)
        if schema is not None:
            yield from found(schema.empty_table(), True)

    dealt = level.withColumn("salt", F.when(F.col("state").bitwiseAND(F.lit(SPREAD).cast("long")) > 0, F.col("node")))
    ordered = dealt.repartition("key", "salt").sortWithinPartitions("key", F.col("state").bitwiseAND(F.lit(INDEX).cast("long")).desc(), "node")
    return ordered.select(*names).mapInArrow(run, f"{DEEP if 'rest' in names else LEVEL}, a long, b long")


def _groups(hot: DataFrame) -> DataFrame:
    """LEVEL of hot keys -> group, node: lines are of one group if a chain of hot keys leads from one to the other.

    Each line of a hot key names one of it, mostly the one of the lowest number: a line of many hot keys names few."""
    heads = hot.groupBy("node").agg(F.array_sort(F.collect_set("place")).alias("heads"))  # as many as the line has hot keys
    to_first = F.transform("heads", lambda h, i: F.struct(F.when(i == 0, F.col("node")).otherwise(h).alias("a"), F.col("heads")[0].alias("b")))
    chains = components(heads.select(F.explode(to_first).alias("x")).select("x.*").distinct(), "line-stars")
    return store.written(chains.select(F.col("component").alias("group"), "node"), "line-groups")


def _blocks(groups: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """group, low, high, i, j, node, line, mine: each line once for every two blocks that it is compared in. Blocks are of
    a group's lines of similar length; lines of one length are linked to such of it or the next one only."""
    step = log1p(1 / min(rule.chars, rule.each)) * (1 + 1e-9)  # allowed(n) <= n / min(chars, each); more than rounding adds
    of = groups.join(nodes.select("node", "line"), "node").withColumn("at", F.floor(F.log(F.length("line").cast("double")) / step))
    of = store.written(of, "line-grouped")
    size = of.groupBy("group", "at").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    near = size.select("group", F.explode(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1)).alias("at"), F.struct(F.col("at").alias("of"), "blocks").alias("with"))
    near = near.groupBy("group", "at").agg(F.collect_list("with").alias("with"))  # three at most
    own = F.filter("with", lambda w: w["of"] == F.col("at"))[0]["blocks"]
    of = of.join(near, ["group", "at"]).withColumn("mine", F.pmod(F.xxhash64("node"), own)).select("group", "at", "node", "line", "mine", F.explode("with").alias("w"))
    of = of.select("group", "at", "node", "line", "mine", F.col("w.of").alias("of"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("w.blocks") - 1)).alias("other"))
    first = (F.col("at") < F.col("of")) | (F.col("at") == F.col("of")) & (F.col("mine") <= F.col("other"))
    i, j = F.when(first, F.col("mine")).otherwise(F.col("other")), F.when(first, F.col("other")).otherwise(F.col("mine"))
    return of.select("group", F.least("at", "of").alias("low"), F.greatest("at", "of").alias("high"), i.alias("i"), j.alias("j"), "node", "line", ((F.col("at") == F.least("at", "of")) & (F.col("mine") == i)).alias("left"))


def _packed_lines(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Start and length of each line, and from each place on as many characters as go into 64 bits, of so many bits each."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    known, codes = np.unique(codes, return_inverse=True)
    bits = max(1, int(len(known)).bit_length())
    codes = np.concatenate([codes.astype(np.uint64) + np.uint64(1), np.zeros(64, np.uint64)])
    words = np.zeros(len(codes) - 64 + 1, np.uint64)
    for t in range(64 // bits):
        words |= codes[t : t + len(words)] << np.uint64(t * bits)
    n = np.array([len(x) for x in lines], np.int64)
    return np.cumsum(n) - n, n, words, bits


def _run(words: np.ndarray, bits: int, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Lengths, `most` at most, of the longest common prefixes of what begins at a and at b."""
    per, out, rows = 64 // bits, most.copy(), np.flatnonzero(most > 0)
    place = (np.arange(66) - 1) // bits
    a, b, at = a[rows], b[rows], 0
    while len(rows):
        other = words[a + at] ^ words[b + at]
        differ = other != 0
        low = other[differ]
        ends = place[np.frexp((low & (~low + np.uint64(1))).astype(np.float64))[1]] + at
        out[rows[differ]] = np.minimum(out[rows[differ]], ends)
        at += per
        more = ~differ & (out[rows] > at)
        rows, a, b = rows[more], a[more], b[more]
    return out


def all_within(start: np.ndarray, n: np.ndarray, words: np.ndarray, bits: int, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """within() of many pairs a, b of lines at once: each step of diagonals() is one of all pairs that are still open."""
    told = np.zeros(len(a), bool)
    swap = n[a] < n[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    rows = np.flatnonzero(n[a] - n[b] <= most)
    a, b, most = a[rows], b[rows], most[rows]
    far, wide = np.full((1, len(rows)), -2, np.int64), 0
    for d in range(int(most.max(initial=-1)) + 1):
        m, k_goal = n[a], n[a] - n[b]
        now = np.full((2 * d + 3, len(rows)), -2, np.int64)  # diagonals -d - 1 to d + 1
        for k in range(-d, d + 1):
            own = np.flatnonzero((k >= k_goal - most + d) & (k <= k_goal + most - d))
            if d:
                before = [far[k + x + wide, own] if -wide <= k + x <= wide else np.full(len(own), -2) for x in (0, -1, 1)]
                i = np.maximum(np.maximum(before[0] + 1, before[1] + 1), before[2])
                some = i >= max(0, k)
                own, i = own[some], i[some]
                i = np.minimum(np.minimum(i, m[own]), n[b[own]] + k)
            else:
                i = np.zeros(len(own), np.int64)
            x, y = a[own], b[own]
            now[k + d + 1, own] = i + _run(words, bits, start[x] + i, start[y] + i - k, np.minimum(n[x] - i, n[y] - i + k))
        goal = now[np.clip(k_goal + d + 1, 0, 2 * d + 2), np.arange(len(rows))]
        done = (k_goal <= d) & (goal >= m)
        told[rows[done]] = True
        keep = ~done & (most > d)
        rows, a, b, most, far, wide = rows[keep], a[keep], b[keep], most[keep], now[:, keep], d + 1
    return told


def _linked_among(lines: list[str], left: np.ndarray, right: np.ndarray | None, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in `lines` of the linked pairs of a line of `left` and one of `right`, or of two of `left`."""
    start, n, words, bits = _packed_lines(lines)
    most = np.array([rule.allowed(x) for x in n.tolist()], np.int64)
    codes, of = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), np.repeat(np.arange(len(lines)), n)
    tally = np.bincount(of * TALLY + (codes % np.uint64(TALLY)).astype(np.int64), minlength=len(lines) * TALLY)
    tally = np.ascontiguousarray(tally.reshape(-1, TALLY).T.astype(np.int32))
    three = mix(codes[:-2] + (codes[1:-1] << np.uint64(21)) + (codes[2:] << np.uint64(42))) % np.uint64(GRAMS)
    whole = of[:-2] == of[2:]
    grams = np.bincount(of[:-2][whole] * GRAMS + three[whole].astype(np.int64), minlength=len(lines) * GRAMS).reshape(-1, GRAMS).astype(np.int32)
    columns, found = left if right is None else right, []
    for k in range(0, len(left), 64):
        x = left[k : k + 64, None]
        allowed = np.minimum(most[x], most[columns])  # it never falls with the length
        open_ = (np.abs(n[x] - n[columns]) <= allowed) & (x != columns)
        if right is None:
            open_ &= np.arange(k, k + len(x))[:, None] < np.arange(len(columns))
        if open_.any():
            apart = np.zeros(open_.shape, np.int32)  # an edit changes two counts by one at most
            for one in tally:
                apart += np.abs(one[x] - one[columns])
            a, b = np.nonzero(open_ & (apart <= 2 * allowed))
            a, b, limit = x[a, 0], columns[b], allowed[a, b]
            near = np.abs(grams[a] - grams[b]).sum(axis=1) <= 6 * limit  # it takes away three and adds three
            found.append((a[near], b[near], limit[near]))
    a, b, limit = (np.concatenate(c) for c in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
    step = max(1, (1 << 22) // (2 * int(limit.max(initial=0)) + 3))  # so that diagonals stay small
    same = np.concatenate([all_within(start, n, words, bits, a[k : k + step], b[k : k + step], limit[k : k + step]) for k in range(0, len(a) or 1, step)])
    return a[same], b[same]


def _compared(groups: DataFrame, nodes: DataFrame, rule: Rule, pairs: bool) -> DataFrame:
    """Links (a, b) of lines of one group; or, not `pairs`, for each line and two blocks a row (node, head, n): its n links
    there, and the smallest node that these lead to, so that rows are in proportion to the lines of a block, not to links."""
    names, types = (["a", "b"], "a long, b long") if pairs else (["node", "head", "n"], "node long, head long, n long")

    def told(rows: list[tuple]) -> pa.RecordBatch:
        node, lines = np.array([r[5] for r in rows], np.int64), [r[6] for r in rows]
        mine = np.array([r[7] for r in rows], bool)
        a, b = _linked_among(lines, np.flatnonzero(mine), None if mine.all() else np.flatnonzero(~mine), rule)
        if pairs:
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], names)
        head = node.copy()
        while True:  # a step takes each line to the smallest that its links lead to, and on to where that one leads
            least = head.copy()
            np.minimum.at(least, a, head[b])
            np.minimum.at(least, b, head[a])
            if (least == head).all():
                break
            head = least
        some = np.flatnonzero(n := np.bincount(np.concatenate([a, b]), minlength=len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(head[some]), pa.array(n[some].astype(np.int64))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for part in (p for batch in batches for p in by_bytes(batch, "line", 1024, 1 << 20)):
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if held and held[0][:5] != row[:5]:
                    yield told(held)
                    held = []
                held.append(row)
        if held:
            yield told(held)

    place = ["group", "low", "high", "i", "j"]
    return _blocks(groups, nodes, rule).repartition(*place).sortWithinPartitions(*place).mapInArrow(run, types)


def _found(nodes: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame | None]:
    """Pairs of lines with a common key, and the groups of lines that hot keys of many edits hold together, if there are
    any; all lines of a group are still to be compared, and no pair is of two lines of one."""
    longest = nodes.agg(F.max(F.length("line"))).first()[0] or 0
    cuts = [0, *(c for c in CUTS if c <= longest), None]
    passes = [store.written(_met(_first_level(nodes, rule, low, high), rule), "line-met") for low, high in pairwise(cuts)]
    met, groups, first = reduce(DataFrame.unionByName, passes), None, True
    found = met.where("a IS NOT NULL").select("a", "b")
    many = F.shiftright("state", 34) > DEEPEST
    if not met.where("a IS NULL").where(many).isEmpty():
        groups = _groups(met.where("a IS NULL").where(many))
    met = met.where(F.col("a").isNotNull() | ~many)
    while True:
        hot = met.where("a IS NULL").drop("a", "b")
        if hot.isEmpty():
            break
        if first:
            hot = hot.join(nodes.select("node", F.col("line").alias("rest")), "node").withColumn("saved", F.lit(""))
            first = False
        met = store.written(_met(_next_level(hot.select("node", "key", "place", "state", "rest", "saved"), rule), rule), "line-met")
        found = found.unionByName(met.where("a IS NOT NULL").select("a", "b"))
    found = found.distinct()
    if groups is not None:
        for side in ("a", "b"):
            found = found.join(groups.select(F.col("node").alias(side), F.col("group").alias(f"group_{side}")), side, "left")
        found = found.where(F.col("group_a").isNull() | F.col("group_b").isNull() | (F.col("group_a") != F.col("group_b"))).select("a", "b")
    return found, groups


def candidates(nodes: DataFrame, rule: Rule = RULE) -> DataFrame:
    """nodes(node, line), a written table -> (a, b), every pair of lines that may be linked."""
    pairs, groups = _found(nodes, rule)
    return pairs if groups is None else pairs.unionByName(_compared(groups, nodes, rule, True))


def verify(pairs: DataFrame, rule: Rule) -> DataFrame:
    """pairs(a, b, line_a, line_b) -> those that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [within(x, y, rule.allowed(min(len(x), len(y)))) for x, y in zip(batch.column("line_a").to_pylist(), batch.column("line_b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    of = lambda side: nodes.select(F.col("node").alias(side), F.col("line").alias(f"line_{side}"))
    return verify(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "line_a", "line_b"), rule)


def links_of(nodes: DataFrame, rule: Rule) -> DataFrame:
    """nodes(node, line), a written table of distinct lines -> links (a, b)."""
    pairs, groups = _found(nodes, rule)
    told = _verified(pairs, nodes, rule)
    return store.written(told if groups is None else told.unionByName(_compared(groups, nodes, rule, True)), "line-links")


def linked_nodes(nodes: DataFrame, rule: Rule) -> DataFrame:
    """nodes(node, line), a written table of distinct lines -> (node, component, n_links) of those that have links; links
    within a group are counted where they are found, not listed."""
    pairs, groups = _found(nodes, rule)
    links = store.written(_verified(pairs, nodes, rule), "line-links")
    ends, counts = links, links.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("long").alias("n"))
    if groups is not None:
        own = store.written(_compared(groups, nodes, rule, False), "line-counts")
        ends = ends.unionByName(own.select(F.col("node").alias("a"), F.col("head").alias("b")))
        counts = counts.unionByName(own.select("node", "n"))
    return components(ends).join(counts.groupBy("node").agg(F.sum("n").alias("n_links")), "node")


def line_classes(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """docs(doc_id, text) -> (doc, doc_id, line_no, class, n_links, first boolean), a row for each line with a word.

    class is the 128-bit key (h1, h2) of the smallest line of the class; n_links counts the links of the line's text to
    different texts.
    """
    mark, own = store.mark(), lines_of(docs)
    place = F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "doc", "line_no")
    texts = own.select(line_key().alias("key"), "line").distinct()
    # written at once: the numbers of a table's rows are unique, whatever is run again
    texts = store.written(texts.select(F.monotonically_increasing_id().alias("node"), "key", "line"), "line-texts")
    linked = linked_nodes(texts, rule or RULE).join(texts.select("node", "key"), "node")
    heads = linked.groupBy("component").agg(F.min("key").alias("class"))
    linked = store.written(linked.join(heads, "component").select("key", "class", "n_links"), "line-linked")
    rows = own.select("doc", "doc_id", "line_no", line_key().alias("key")).join(linked, "key", "left")
    rows = store.written(rows.select("doc", "doc_id", "line_no", F.coalesce("class", "key").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "line-rows")
    # written, so that the join's exchange is its own and a class with a third of all lines is split
    firsts = store.written(rows.groupBy("class").agg(F.min(place).alias("first_at"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "line-firsts")
    store.sweep(mark, rows, firsts)
    told = rows.join(firsts, "class", "left")
    return told.select("doc", "doc_id", "line_no", "class", "n_links", (F.col("first_at").isNull() | (F.col("first_at") == place)).alias("first"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc, gone array<int>): the lines of each document that are not the first of their class."""
    return line_classes(docs).where("NOT first").groupBy("doc").agg(F.sort_array(F.collect_set("line_no")).alias("gone"))


def _kept(text: Column, gone: Column) -> Column:
    """text without the lines whose numbers `gone` has."""
    lines = F.split(text, "\n", -1)
    return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i)), "\n")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with later lines of a class taken out of text; a document of which no line with a word is left goes.

    n_chars, if there is one, is counted anew where lines went."""
    whole = docs.select(document_key().alias("doc"), "text", F.struct("*").alias("row"))
    joined = whole.join(removed_lines(docs.select("doc_id", "text")), "doc", "left")
    cut = joined.select("row", "gone", F.when(F.col("gone").isNull(), F.col("text")).otherwise(_kept(F.col("text"), F.col("gone"))).alias("text"))
    cut = cut.where(F.col("gone").isNull() | F.col("text").rlike(WORD))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("gone").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return cut.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its lines' classes and links, the lines removed, and a digest of the text left."""
    docs = store.documents(spark, sf_dir).select("doc_id", "text")
    line = F.struct("line_no", F.col("class.h1").alias("class_id"), "n_links", "first")
    lines = line_classes(docs).groupBy("doc").agg(F.sort_array(F.collect_set(line)).alias("lines"))
    told = docs.withColumn("doc", document_key()).join(lines, "doc", "left")
    own = F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType))
    text = F.coalesce("text", F.lit(""))
    gone = F.filter(own, lambda x: ~x["first"])["line_no"]
    kept = F.when(F.size(gone) == 0, text).otherwise(_kept(text, gone))
    return told.select(
        "doc_id",
        F.size(own).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
        F.aggregate(own["n_links"], F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("n_links"),
        own["class_id"].alias("class_ids"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )
