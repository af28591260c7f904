"""Word shingles of a batch of texts, hashed with numpy: no Python step for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def by_bytes(batch: pa.RecordBatch, column: str, rows: int = 256, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows and about `most` bytes of `column`; a larger value is alone in its slice."""
    values = batch.column(column)
    if pa.types.is_list(values.type):
        own = pc.multiply(pc.list_value_length(values), 16)
    else:
        own = pc.binary_length(values)
    ends = np.cumsum(pc.fill_null(own, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, "right"))))
        yield batch.slice(at, to - at)
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS


def word_hashes(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words `[^\\x20\\x09-\\x0D]+` in order, and offsets: text i has words offsets[i] to offsets[i + 1]."""
    data = [t.encode() for t in texts]
    buf = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    inside = ~_WHITE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if lower:
        buf = _LOWER[buf]
    power, inverse = _powers(len(buf) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[buf] * power[: len(buf)])])
    hashes = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    first = np.concatenate([[0], np.cumsum([len(d) + 1 for d in data])])
    return hashes, np.searchsorted(start, first)


def shingle_sets(texts: list[str], k: int, lower: bool = True) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles; with 1 to k - 1 words, of the whole sequence as one."""
    hashes, offsets = word_hashes(texts, lower)
    n = len(hashes)
    rolled = hashes
    for j in range(1, k):
        following = np.zeros(n, np.uint64)
        following[: max(0, n - j)] = hashes[j:]
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + following)
    out = []
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if e - s >= k:
            out.append(np.unique(rolled[s : e - k + 1]))
        elif e > s:
            whole = hashes[s : s + 1]
            for j in range(s + 1, e):
                whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + 1])
            out.append(mix(whole + np.uint64(e - s)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
