"""Media columns: audio features of stored 8-bit sound.

Sound is stored as WAV (mono, 8-bit unsigned PCM) in a written table. What is read back from it is resampled by a
polyphase filter, turned into overlapped log-mel filterbank frames, cut into fixed-shape patches that become an Arrow
fixed_shape_tensor array with their time spans, and segmented by energy with hysteresis: a segment opens with the first
frame above the high threshold and ends before the first that isn't above the low one. Spark's columns have no extension
types, so a row's tensors are an Arrow stream in a binary column.

Every row is computed alone, in blocks of frames, so memory doesn't depend on a sound's length beyond its own bytes and
equal payloads give equal features whatever the batch. Defined cases: a null text counts as empty; an empty payload is
padded to 64 zero bytes; very long texts are one sound each, in batches bounded by bytes; a null doc_id stays null; an
empty table gives an empty result; repeated rows and ties are computed each; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .shingles import by_bytes

RATE, UP, DOWN, TAPS = 16_000, 3, 4, 12
FRAME, HOP, MELS, PATCH = 256, 128, 24, 16
HIGH_DB, LOW_DB = 3.0, 1.0
BLOCK = 2048  # frames at once


def padded(data: bytes) -> bytes:
    """data with bytes 0 appended up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % 64 or (0 if data else 64))


def write_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono 8-bit WAV file; a byte is a sample. `samples` has even length."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples


def read_wav(data: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(data)) as w:
        return w.readframes(w.getnframes()), w.getframerate()


@lru_cache
def _phases() -> np.ndarray:
    """Row r: the filter taps of output phase r, a windowed sinc cut at the lower of both rates."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.kaiser(n, 6.0)
    h *= UP / h.sum()
    return np.stack([h[r::UP][::-1] for r in range(UP)]).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """x at UP / DOWN times its rate: output j is the dot product of TAPS inputs and the taps of phase (j * DOWN) % UP."""
    n_out = -(-len(x) * UP // DOWN)
    half = TAPS // 2
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, (half, half + DOWN)), TAPS)
    out = np.empty(n_out, np.float32)
    for r in range(UP):
        first = r * DOWN
        own = windows[first // UP :: DOWN][: len(range(r, n_out, UP))]
        taps = _phases()[first % UP]
        for at in range(0, len(own), 16 * BLOCK):
            out[r + at * UP : r + (at + 16 * BLOCK) * UP : UP][: len(own) - at] = np.ascontiguousarray(own[at : at + 16 * BLOCK]) @ taps
    return out


@lru_cache
def _mel() -> tuple[np.ndarray, np.ndarray]:
    """The Hann window, and triangular filters spaced evenly in mel, (FRAME // 2 + 1, MELS)."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60.0), mel(rate / 2), MELS + 2) / 2595) - 1)
    freq = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    rise, fall = (freq - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - freq) / (edges[2:] - edges[1:-1])
    return np.hanning(FRAME).astype(np.float32), np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(y: np.ndarray) -> np.ndarray:
    """(frames, MELS) of 10 log10 of mel energies; at least one frame, the last padded with silence."""
    n = 1 + max(0, -(-(len(y) - FRAME) // HOP))
    y = np.pad(y, (0, (n - 1) * HOP + FRAME - len(y)))
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    window, bank = _mel()
    out = np.empty((n, MELS), np.float32)
    for at in range(0, n, BLOCK):
        power = np.abs(np.fft.rfft(frames[at : at + BLOCK] * window, axis=1)).astype(np.float32) ** 2
        out[at : at + BLOCK] = 10 * np.log10(power @ bank + 1e-6)
    return out


def segments(energy: np.ndarray, high: float, low: float) -> list[tuple[int, int]]:
    """Runs of frames [start, end) that start above `high` and end before the first frame not above `low`."""
    above = np.concatenate([[0], (energy > low).astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(above))
    found = []
    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        loud = np.flatnonzero(energy[s:e] > high)
        if len(loud):
            found.append((s + int(loud[0]), e))
    return found


def features(samples: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x))
    energy = mel.mean(axis=1)
    middle = float(np.median(energy))
    return mel, segments(energy, middle + HIGH_DB, middle + LOW_DB)


def tensor_bytes(mel: np.ndarray) -> bytes:
    """An Arrow stream with one fixed_shape_tensor column of (PATCH, MELS) patches and each patch's span in seconds."""
    n = -(-len(mel) // PATCH)
    full = np.zeros((n, PATCH, MELS), np.float32)
    full.reshape(-1, MELS)[: len(mel)] = mel
    step = HOP / (RATE * UP / DOWN)
    start = np.arange(n) * PATCH * step
    end = np.minimum((np.arange(n) + 1) * PATCH, len(mel)) * step
    batch = pa.record_batch({"patch": pa.FixedShapeTensorArray.from_numpy_ndarray(full), "start_s": pa.array(start), "end_s": pa.array(end)})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def summary(mel: np.ndarray, spans: list[tuple[int, int]]) -> str:
    """Frames, segments, frames in segments, and the CRC-32 of the filterbank rounded to half decibels."""
    rounded = np.round(mel * 2).astype("<i2")
    return f"frames={len(mel)};mels={MELS};segments={len(spans)};active={sum(e - s for s, e in spans)};logmel={zlib.crc32(rounded.tobytes()):08x}"


MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = f"{MEDIA}, tensors binary, segments array<struct<start_s:double,end_s:double>>"


def store_audio(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> MEDIA: the WAV file of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in by_bytes(batch, "text")):
            data = [(text.as_py() or "").encode() for text in part.column("text")]
            columns = [part.column("doc_id"), pa.array([len(x) for x in data], pa.int64()), pa.array([write_wav(padded(x)) for x in data], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MEDIA)


def analysed(stored: DataFrame) -> DataFrame:
    """MEDIA -> FEATURES: the Arrow tensors and the segments' spans in seconds, from the stored files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = HOP / (RATE * UP / DOWN)
        kind = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
        for part in (p for batch in batches for p in by_bytes(batch, "media", 64)):
            tensors, spans = [], []
            for wav in part.column("media"):
                mel, own = features(read_wav(wav.as_py())[0])
                tensors.append(tensor_bytes(mel))
                spans.append([{"start_s": s * step, "end_s": e * step} for s, e in own])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tensors, pa.binary()), pa.array(spans, kind)], names=[*part.schema.names, "tensors", "segments"])

    return stored.mapInArrow(run, FEATURES)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tensors_sha256 string"


def digest(stored: DataFrame) -> DataFrame:
    """FEATURES -> DIGEST: every value is computed from the stored file and from the tensors, read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = HOP / (RATE * UP / DOWN)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for wav, tensors, spans, n in zip(batch.column("media"), batch.column("tensors"), batch.column("segments"), batch.column("n_bytes"), strict=True):
                wav, tensors = wav.as_py(), tensors.as_py()
                payload = read_wav(wav)[0]
                table = pa.ipc.open_stream(tensors).read_all()
                patches = table.column("patch").combine_chunks().to_numpy_ndarray()
                frames = round(table.column("end_s")[-1].as_py() / step)
                mel = patches.reshape(-1, MELS)[:frames]
                own = [(round(x["start_s"] / step), round(x["end_s"] / step)) for x in spans.as_py()]
                row = (n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(wav), hashlib.sha256(wav).hexdigest(), summary(mel, own), hashlib.sha256(tensors).hexdigest())
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=[x.split()[0] for x in DIGEST.split(", ")])

    return stored.mapInArrow(run, DIGEST)


def op5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents as 8-bit sound: stored, read back, and its features."""
    return digest(analysed(store.written(store_audio(store.documents(spark, sf_dir)), "audio-media")))
