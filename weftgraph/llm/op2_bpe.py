"""Byte-level BPE encoding and decoding.

Texts are cut into words by the tokenizer's pattern, and the ranked merges are folded over the byte array of each
distinct word: the pair of lowest rank first, the leftmost of equals, ranks looked up in a literal map. Decoding looks
every id up in a table of byte pieces and concatenates them. There are two styles of the same method:

- "arrow" (default): a map over Arrow batches; each Python worker keeps the folded words it met last (CACHED at most).
- "functions": Spark higher-order functions. A block of whole documents becomes one row, its distinct words as arrays of
  byte tokens and each document as an array of word numbers; aggregate() folds, and documents are put together by array
  access. The rank map is a literal array laid out by a perfect hash of (left id, right id), for Spark's own map literals
  are searched from end to end. Its interpreted lambdas need many times the processor time (README), so it isn't default.

Neither style shuffles. Words over FOLD bytes would make the fold quadratic; they get the same merges with a heap.

Defined cases: null and empty texts have no ids; a null doc_id stays null; a very long text is one row and is encoded
whole; an empty table gives an empty result; repeated rows are encoded each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .op8_secrets import load_ranks
from .shingles import by_bytes

BLOCK_CHARS, FOLD = 12_000_000, 48
NONE = 1 << 30
CACHED = 300_000  # words that a worker keeps
#: The characters of Unicode's White_Space, which the pattern's \\s stands for.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
APART = re.compile(f"[ \n][{WHITE}]|[{WHITE}][ \n]")  # a space or line end next to other white space
CHUNK = re.compile(f"[{WHITE}]+(?![^{WHITE}])| ?[^{WHITE}]+|[{WHITE}]")
LONG_RUN = re.compile(r"\s{1000}")
BITS = 19  # of the rank map's slots
FACTORS, PRIME = (1_640_531_527, 1_013_904_223), 4_294_967_291  # keys are under 2 ** 32, so products fit in a long


def merges(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Every pair of ids whose bytes make a token, and its id."""
    return {(ranks[t[:k]], ranks[t[k:]]): i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}


def _hashes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return keys * FACTORS[0] % PRIME, keys * FACTORS[1] % PRIME


@lru_cache(4)
def rank_map(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The perfect hash: shifts of 2 ** (BITS - 2) buckets, and slots holding key * 65536 + id (or -1)."""
    pairs = merges(load_ranks(path))
    keys = np.array([a * 65536 + b for a, b in pairs], np.int64)
    ids = np.array(list(pairs.values()), np.int64)
    first, second = _hashes(keys)
    buckets, mask = first & ((1 << (BITS - 2)) - 1), (1 << BITS) - 1
    order = np.argsort(buckets, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(buckets[order])) + 1)
    shifts, slots = np.zeros(1 << (BITS - 2), np.int64), np.full(1 << BITS, -1, np.int64)
    for own in sorted(parts, key=len, reverse=True):
        for shift in range(1 << BITS):
            at = (second[own] + shift) & mask
            if (slots[at] < 0).all() and len(set(at.tolist())) == len(at):
                slots[at] = keys[own] * 65536 + ids[own]
                shifts[buckets[own[0]]] = shift
                break
        else:
            raise ValueError("no perfect hash of this size")
    return shifts, slots


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def encode_words(words: Column, path: str) -> Column:
    """array<array<int>> of byte tokens -> array<array<int>> of ids: the fold of ranked merges."""
    shift_text, slot_text = (",".join(map(str, x.tolist())) for x in rank_map(path))
    tables = F.struct(F.split(F.lit(shift_text), ",").cast("array<int>").alias("shifts"), F.split(F.lit(slot_text), ",").cast("array<bigint>").alias("slots"))

    def with_tables(t: Column) -> Column:
        def rank(a: Column, b: Column) -> Column:
            def probe(key: Column) -> Column:
                shift = F.get(t["shifts"], (key * FACTORS[0] % PRIME).bitwiseAND(F.lit((1 << (BITS - 2)) - 1).cast("bigint")).cast("int"))
                found = F.get(t["slots"], (key * FACTORS[1] % PRIME + shift).bitwiseAND(F.lit((1 << BITS) - 1).cast("bigint")).cast("int"))
                return _let(found, lambda x: F.when(F.shiftright(x, 16) == key, x.bitwiseAND(F.lit(65535).cast("bigint")).cast("int")).otherwise(F.lit(NONE)))

            return _let(a.cast("bigint") * 65536 + b, probe)

        def step(s: Column, _: Column) -> Column:
            def merged(x: Column) -> Column:
                ids, own, low, at = x["s"]["ids"], x["s"]["ranks"], x["low"], x["at"]
                n = F.size(ids)
                left = F.when(at > 1, F.concat(F.slice(own, 1, at - 2), F.array(rank(F.get(ids, at - 2), low)))).otherwise(F.array().cast("array<int>"))
                right = F.when(at + 1 < n, F.concat(F.array(rank(low, F.get(ids, at + 1))), F.slice(own, at + 2, n))).otherwise(F.array().cast("array<int>"))
                return F.struct(F.concat(F.slice(ids, 1, at - 1), F.array(low), F.slice(ids, at + 2, n)).alias("ids"), F.concat(left, right).alias("ranks"))

            low = F.array_min(s["ranks"])
            none = F.coalesce(low, F.lit(NONE)) == NONE
            return F.when(none, s).otherwise(_let(F.struct(s.alias("s"), low.alias("low"), F.array_position(s["ranks"], low).cast("int").alias("at")), merged))

        def word(w: Column) -> Column:
            n = F.size(w)
            start = F.struct(w.alias("ids"), F.zip_with(F.slice(w, 1, n - 1), F.slice(w, 2, n - 1), rank).alias("ranks"))
            folded = F.aggregate(F.sequence(F.lit(1), n - 1), start, step, lambda s: s["ids"])
            return F.when((n > 1) & (n <= FOLD), folded).otherwise(w)

        return F.transform(words, word)

    return _let(tables, with_tables)


def heap_merge(ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The same merges on one long word, in n log n: lowest rank first, leftmost of equals."""
    n = len(ids)
    ids = list(ids)
    before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], after[i] = r, False, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := pairs.get((ids[i], ids[after[i]]))) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[after[i]]))
        if before[i] >= 0 and (r := pairs.get((ids[before[i]], ids[i]))) is not None:
            heapq.heappush(heap, (r, before[i], ids[before[i]], ids[i]))
    return [ids[i] for i in range(n) if alive[i]]


def _lists(values: np.ndarray, lengths: list[int], outer: pa.DataType = pa.int32()) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values, outer))


def blocks(docs: DataFrame, ranks_path: str, pattern: str, block_chars: int) -> DataFrame:
    """docs(doc_id, text) -> (words array<array<int>>, docs array<struct<doc_id, codes array<int>>>), a row for each block."""

    def row(ids: list, found: list[list[str]], ranks: dict[bytes, int], pairs_of) -> pa.RecordBatch:
        number: dict[str, int] = {}
        codes, lengths = [], []
        for words in found:
            codes.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
            lengths.append(len(words))
        byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        values, sizes = [], []
        for w in number:
            data = w.encode()
            if (whole := ranks.get(data)) is not None:
                own = np.array([whole], np.int32)
            else:
                own = byte_id[np.frombuffer(data, np.uint8)]
                if len(data) > FOLD:
                    own = np.array(heap_merge(own.tolist(), pairs_of()), np.int32)
            values.append(own)
            sizes.append(len(own))
        words = _lists(np.concatenate(values) if values else np.array([], np.int32), sizes)
        inner = _lists(np.concatenate(codes) if codes else np.array([], np.int32), lengths)
        docs = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), inner], ["doc_id", "codes"])
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        return pa.RecordBatch.from_arrays([one(words), one(docs)], ["words", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(pattern).findall
        ranks, held = load_ranks(ranks_path), []

        def pairs_of() -> dict[tuple[int, int], int]:
            if not held:
                held.append(merges(ranks))
            return held[0]

        ids, found, chars = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                text = text.as_py() or ""
                if ids and chars + len(text) > block_chars:
                    yield row(ids, found, ranks, pairs_of)
                    ids, found, chars = [], [], 0
                ids.append(doc_id.as_py())
                found.append(split(text))
                chars += len(text)
        if ids:
            yield row(ids, found, ranks, pairs_of)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "words array<array<int>>, docs array<struct<doc_id:bigint,codes:array<int>>>")


class Ranks:
    """The rank map for arrays of pairs, and the merges folded over many words at once."""

    def __init__(self, ranks: dict[bytes, int], shifts: np.ndarray, slots: np.ndarray):
        self.ranks, self.shifts, self.slots, self.pairs = ranks, shifts, slots, None
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that each pair merges to, NONE where there is none; ids under 0 merge with nothing."""
        key = (a.astype(np.int64) << 16) + b
        first, second = _hashes(np.maximum(key, 0))
        found = self.slots[(second + self.shifts[first & ((1 << (BITS - 2)) - 1)]) & ((1 << BITS) - 1)]
        return np.where((found >> 16 == key) & (a >= 0) & (b >= 0), found & 65535, NONE).astype(np.int32)

    def fold(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of at most FOLD bytes, as little-endian bytes. Shorter words first, so few cells are idle."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for at in range(0, len(order), 4096):
            own = order[at : at + 4096]
            width = len(words[own[-1]])
            cells = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in own), np.uint8).reshape(len(own), width)
            size = np.array([len(words[i]) for i in own])
            ids = np.where(np.arange(width) < size[:, None], self.byte_id[cells], -1)
            ids = np.hstack([ids, np.full((len(own), 1), -1)]).astype(np.int32)
            rank = self.of(ids[:, :-1], ids[:, 1:])
            at_column = np.arange(width + 1)
            live = np.arange(len(own))
            while len(live):
                part, ranks = ids[live], rank[live]
                low = ranks.argmin(axis=1)
                row = np.arange(len(live))
                merged = ranks[row, low]
                going = merged < NONE
                if not going.all():
                    live, part, ranks, low, merged = live[going], part[going], ranks[going], low[going], merged[going]
                    row = np.arange(len(live))
                    if not len(live):
                        break
                shift = np.minimum(at_column + (at_column > low[:, None]), width)
                part = np.take_along_axis(part, shift, axis=1)
                part[:, -1] = -1
                part[row, low] = merged
                ranks = np.take_along_axis(ranks, np.minimum(shift[:, :-1], width - 1), axis=1)
                ranks[:, -1] = NONE
                ranks[row, low] = self.of(merged, part[row, low + 1])
                before = low > 0
                ranks[row[before], low[before] - 1] = self.of(part[row[before], low[before] - 1], merged[before])
                ids[live], rank[live] = part, ranks
            counts = (ids >= 0).sum(axis=1)
            for i, line, n in zip(own, ids, counts.tolist(), strict=True):
                out[i] = line[:n].tobytes()
        return out


class Words(dict):
    """word -> ids as little-endian bytes."""

    def __init__(self, ranks: Ranks):
        self.ranks = ranks

    def fill(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHED:
            self.clear()
            new = list(words)
        short = []
        for w in new:
            data = w.encode()
            if (whole := self.ranks.ranks.get(data)) is not None:
                self[w] = whole.to_bytes(4, "little")
            elif len(data) <= FOLD:
                short.append((w, data))
            else:
                self.ranks.pairs = self.ranks.pairs or merges(self.ranks.ranks)
                self[w] = np.array(heap_merge(self.ranks.byte_id[np.frombuffer(data, np.uint8)].tolist(), self.ranks.pairs), "<i4").tobytes()
        self.update(zip((w for w, _ in short), self.ranks.fold([data for _, data in short]), strict=True))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


class Encoder:
    """Texts -> ids as little-endian 32-bit integers, a batch at a time so that its new words are folded together.

    With single spaces and line ends only, words never cross what stands between two of them, whatever stands around it;
    other texts are cut into chunks of a kind with which that holds too.
    """

    def __init__(self, ranks_path: str, pattern: str, shifts: np.ndarray, slots: np.ndarray):
        import regex

        self.split = regex.compile(pattern).findall
        self.words = Words(Ranks(load_ranks(ranks_path), shifts, slots))
        self.chunks: dict[str, bytes] = {}  # a chunk with its leading space, if it has one -> ids
        self.sizes: dict[str, int] = {}  # and how many

    def cut(self, text: str) -> list[str]:
        if text and text[0] not in " \n" and text[-1] not in " \n" and "\0" not in text and not APART.search(text):
            return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return CHUNK.findall(text)

    def filled(self, texts: list[str]) -> list[list[str]]:
        """The texts' chunks, all of them known from now on."""
        cut = [self.cut(text) for text in texts]
        need = set().union(*cut)
        new = [c for c in need if c not in self.chunks]
        if len(self.chunks) + len(new) > CACHED:
            self.chunks.clear()
            self.sizes.clear()
            new = list(need)
        words = [self.split(c) for c in new]
        self.words.fill(set().union(*words))
        get = self.words.__getitem__
        for c, own in zip(new, words, strict=True):
            self.chunks[c] = ids = b"".join(map(get, own)) if len(own) > 1 else get(own[0])
            self.sizes[c] = len(ids) // 4
        return cut

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = self.filled(texts)
        return [b"".join(map(self.chunks.__getitem__, own)) for own in cut]

    def count(self, texts: list[str]) -> list[int]:
        cut = self.filled(texts)
        return [sum(map(self.sizes.__getitem__, own)) for own in cut]


def _encoder(ranks_path: str, pattern: str, shifts: np.ndarray, slots: np.ndarray) -> Encoder:
    key = (ranks_path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(ranks_path, pattern, shifts, slots)
    return _ENCODERS[key]


def _encode_arrow(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    shifts, slots = rank_map(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, pattern, shifts, slots)
        for part in (p for batch in batches for p in by_bytes(batch, "text", 512)):
            found = encoder.encode([text.as_py() or "" for text in part.column("text")])
            ids = _lists(np.frombuffer(b"".join(found), "<i4"), [len(x) // 4 for x in found])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def counted(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_tokens): the numbers of ids that encode() gives, without the ids.

    The tokenizer library counts, for it needs less processor time than encode(); its pattern matcher runs out of stack on
    very long runs of white space, so texts with LONG_RUN of it are encoded by encode()'s own encoder.
    """
    shifts, slots = rank_map(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={})
        for part in (p for batch in batches for p in by_bytes(batch, "text", 512)):
            n = []
            for text in part.column("text"):
                text = text.as_py() or ""
                n.append(_encoder(ranks_path, pattern, shifts, slots).count([text])[0] if LONG_RUN.search(text) else len(library.encode_ordinary(text)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def encode(docs: DataFrame, ranks_path: str, pattern: str, style: str = "arrow", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ids array<int>), without special tokens."""
    if style == "arrow":
        return _encode_arrow(docs, ranks_path, pattern)
    put = lambda words: F.transform("docs", lambda d: F.struct(d["doc_id"].alias("doc_id"), F.flatten(F.transform(d["codes"], lambda c: F.get(words, c))).alias("ids")))
    found = blocks(docs, ranks_path, pattern, block_chars)
    return found.select(F.explode(_let(encode_words(F.col("words"), ranks_path), put)).alias("d")).select("d.doc_id", "d.ids")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, n_tokens, ids_sha256, decoded binary, decoded_sha256): the ids' byte pieces, concatenated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(ranks_path)
        pieces = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            pieces[i] = token
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, hashes, texts, text_hashes = [], [], [], []
                for ids in part.column("ids"):
                    own = ids.values.to_numpy().astype("<i4", copy=False)
                    text = b"".join(map(pieces.__getitem__, own.tolist()))
                    n.append(len(own))
                    hashes.append(hashlib.sha256(own.tobytes()).hexdigest())
                    texts.append(text)
                    text_hashes.append(hashlib.sha256(text).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.binary()), pa.array(text_hashes, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"],
                )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded binary, decoded_sha256 string")


def decode_column(ids: Column, ranks_path: str) -> Column:
    """array<int> -> binary, in the style "functions"."""
    ranks = load_ranks(ranks_path)
    pieces = [""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        pieces[i] = token.hex()
    table = F.split(F.lit(",".join(pieces)), ",")
    return F.unhex(_let(table, lambda t: F.array_join(F.transform(ids, lambda i: F.get(t, i)), "")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents encoded by byte_bpe_50k's ranks, and decoded again."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = encode(store.documents(spark, sf_dir), path, public_tokenizers.PATTERN)
    return decode(found, path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
