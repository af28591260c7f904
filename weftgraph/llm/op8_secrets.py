"""Secret scan: three base patterns, and a token-efficiency test for random strings.

A string that a tokenizer's vocabulary covers badly, with few characters for each token, is probably random. Candidates
are runs of key characters; known digests (hex of 32, 40, 56, 64, 96 or 128 digits) and identifiers (UUIDs, numbers, words
in camel case or joined with numbers) are excluded first. Runs with one or none of lower case, upper case and digits, which
may be plain words, and runs under LONG characters have to stay under a stricter ratio.

Defined cases: a null text counts as empty and has no span; texts of any length are read whole; of spans that start together
the base kinds come first, in their order; a null doc_id stays null; an empty table gives an empty result; repeated rows
are scanned each; extra columns are ignored by scan() and kept by redact(), whatever their names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

KINDS = ("assign", "access", "hex", "random")


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: Letters in either case, ASCII only, so spelled as classes.
ASSIGN = re.compile("(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
NAMES = ("passw", "secret", "token", "api")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")  # maximal runs, so the same as [0-9a-f]+ with shorter ones dropped
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGEST = re.compile(r"[0-9A-Fa-f]+")
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
IDENTIFIER = re.compile(r"(?>[-_/=+]*+(?>[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[0-9]++(?![A-Za-z])))++[-_/=+]*+")  # possessive: no backtracking
MAX_CHARS_PER_TOKEN = 2.2
STRICT, LONG = 1.9 / 2.2, 20  # the stricter ratio, as a share of the other


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_ENCODINGS: dict[str, object] = {}


def _encoding(path: str):
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    return _ENCODINGS[path]


def _share(s: str) -> float:
    """Of the ratio, what holds for s; 0 for known digests and identifiers."""
    digit, lower, upper = any(c.isdigit() for c in s), any(c.islower() for c in s), any(c.isupper() for c in s)
    if DIGEST.fullmatch(s) and len(s) in DIGEST_LENGTHS or UUID.fullmatch(s):
        return 0
    if (digit or lower and upper) and IDENTIFIER.fullmatch(s):
        return 0
    return STRICT if digit + lower + upper < 2 or len(s) < LONG else 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the three base kinds, in code points."""
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, encoding, max_ratio: float) -> list[tuple[int, int, int]]:
    found = []
    for m in CANDIDATE.finditer(text):
        s = m.group()
        if (share := _share(s)) and len(s) <= share * max_ratio * len(encoding.encode_ordinary(s)):
            found.append((m.start(), 3, m.end()))
    return found


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, ranks_path: str, max_ratio: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, base, spans): base and all spans, each 'kind:start:end' joined by commas."""
    fields = pa.schema([("doc_id", pa.int64()), ("base", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks_path)
        for batch in batches:
            base, spans = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                own = base_spans(text)
                base.append(render(own))
                spans.append(render(sorted(own + random_spans(text, encoding, max_ratio))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, pa.string()), pa.array(spans, pa.string())], schema=fields)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, base string, spans string")


def redact(docs: DataFrame, ranks_path: str, max_ratio: float = MAX_CHARS_PER_TOKEN, mask: str = "[secret]") -> DataFrame:
    """docs with every secret's span in `text` replaced by `mask`; other columns and rows stay. Overlapping spans make one."""
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks_path)
        for batch in batches:
            out = []
            for text in batch.column(at):
                text = text.as_py()
                if text:
                    parts, done = [], 0
                    for start, _, end in sorted(base_spans(text) + random_spans(text, encoding, max_ratio)):
                        if start >= done:
                            parts += [text[done:start], mask]
                        done = max(done, end)
                    if parts:
                        text = "".join([*parts, text[done:]])
                out.append(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, schema)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: counts of the base kinds, a digest of base spans, and all spans."""
    import public_tokenizers

    found = scan(store.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    count = lambda kind: F.size(F.filter(F.split("base", ","), lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2("base", 256).alias("base_sha256"), "spans")


