"""Media columns: documents as 8-bit mono audio, and features of that audio.

``encode_media`` stores a payload (UTF-8 text, padded with zero bytes to a positive multiple of 64) losslessly as
the unsigned 8-bit samples of a WAV file. ``audio_features`` reads the stored bytes back and computes

* a polyphase resampling by 3/4 (windowed-sinc low-pass, one filter for each of the three phases),
* log-mel energies of overlapped Hann frames (256 samples, hop 128),
* a hysteresis segmentation of the frame energies (on above the upper, off below the lower threshold),

and packs the frames in tensors of the fixed shape ``TENSOR_SHAPE`` with the span of seconds each one covers.
``tensor_rows`` gives a row for each tensor, and ``tensor_table`` turns an Arrow batch of them into one whose column has
Arrow's ``fixed_shape_tensor`` type.

Defined cases: null and empty text give 64 zero bytes, one silent frame and no segment; equal texts give equal
values whatever the partitioning (each document is computed by itself); repeated rows give repeated rows; an empty
table gives none; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import hashlib
import io
import json
import wave
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmill.llm.common import text_of

BLOCK = 64
RATE = 8000
UP, DOWN, TAPS = 3, 4, 8
FRAME, HOP, MELS = 256, 128, 16
TENSOR_FRAMES = 32
TENSOR_SHAPE = (TENSOR_FRAMES, MELS)
OUT_RATE = RATE * UP // DOWN

MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
FEATURE_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, n_frames long, tensors array<array<float>>, spans array<struct<start:double,end:double>>, "
    "segments array<struct<start:double,end:double>>, feature string"
)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for raw in batch.column(1):
                data = raw.as_py()
                sizes.append(len(data))
                media.append(to_wav(data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b"\0")))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text")).mapInArrow(encode, MEDIA_SCHEMA)


@cache
def _phases() -> np.ndarray:
    """The low-pass filter split in ``UP`` phases of ``TAPS`` taps each, reversed for use on windows."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    h *= UP / h.sum()
    return np.stack([h[p::UP][::-1] for p in range(UP)])


def resample(x: np.ndarray) -> np.ndarray:
    """``x`` at UP/DOWN of its rate: output m is phase (m DOWN mod UP) on the window that ends at m DOWN / UP."""
    n = len(x) * UP // DOWN
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(TAPS - 1), x]), TAPS)
    y = np.empty(n)
    for r in range(UP):
        m = np.arange(r, n, UP)
        if len(m):
            first = r * DOWN // UP
            y[r::UP] = windows[first :: DOWN][: len(m)] @ _phases()[r * DOWN % UP]
    return y


@cache
def _mel() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    hz = 700 * (10 ** (np.linspace(mel(40.0), mel(OUT_RATE / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, OUT_RATE / 2, FRAME // 2 + 1)
    up = (f[:, None] - hz[:-2]) / (hz[1:-1] - hz[:-2])
    down = (hz[2:] - f[:, None]) / (hz[2:] - hz[1:-1])
    return np.maximum(0, np.minimum(up, down))


def log_mel(y: np.ndarray) -> np.ndarray:
    """(frames, MELS) in dB above a floor of -80; at least one frame."""
    n = 1 + max(0, -(-(len(y) - FRAME) // HOP))
    y = np.concatenate([y, np.zeros(FRAME + (n - 1) * HOP - len(y))])
    out = np.empty((n, MELS), np.float32)
    frames, window = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP], np.hanning(FRAME)
    for k in range(0, n, 512):  # bounded memory on very long texts
        power = np.abs(np.fft.rfft(frames[k : k + 512] * window)) ** 2 / FRAME
        out[k : k + 512] = 10 * np.log10(power @ _mel() + 1e-8)
    return out


def hysteresis(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames [start, end) that begin above mean + sd/2 and last until the energy is below mean - sd/2."""
    mid, half = energy.mean(), energy.std() / 2
    if half < 1e-9:
        return []
    mark = np.where(energy > mid + half, 1, np.where(energy < mid - half, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[last], -1) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def features_of(payload: bytes) -> dict:
    x = (np.frombuffer(payload, np.uint8).astype(np.float64) - 128) / 128
    mel = log_mel(resample(x - x.mean()))
    segments = hysteresis(mel.mean(axis=1, dtype=np.float64))
    n, at = len(mel), lambda k: k * HOP / OUT_RATE
    padded = np.zeros((-(-n // TENSOR_FRAMES) * TENSOR_FRAMES, MELS), np.float32)
    padded[:n] = mel
    starts = range(0, n, TENSOR_FRAMES)
    bands = ",".join(f"{v:.1f}" for v in mel.mean(axis=0, dtype=np.float64))
    return {
        "n_frames": n,
        "tensors": padded.reshape(-1, TENSOR_FRAMES * MELS),
        "spans": [(at(k), at(min(n, k + TENSOR_FRAMES) - 1) + FRAME / OUT_RATE) for k in starts],
        "segments": [(at(a), at(b - 1) + FRAME / OUT_RATE) for a, b in segments],
        "feature": f"frames={n};segments={len(segments)};voiced={sum(b - a for a, b in segments)};bands={bands}",
    }


#: Arrow's own name and parameters of the tensor type; a reader that knows them may wrap the stored lists as they are.
TENSOR_META = {"ARROW:extension:name": "arrow.fixed_shape_tensor", "ARROW:extension:metadata": json.dumps({"shape": list(TENSOR_SHAPE), "dim_names": ["frame", "mel"]})}


def _feature_type() -> T.StructType:
    kind = T.StructType.fromDDL(FEATURE_SCHEMA)
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable, TENSOR_META if f.name == "tensors" else None) for f in kind])


def audio_features(media: DataFrame) -> DataFrame:
    """A row for each row of ``media`` (``doc_id, n_bytes, media``), read from the stored bytes. Every tensor is a list of
    ``TENSOR_FRAMES * MELS`` values; the column says by ``TENSOR_META`` how Arrow's tensor type reads it."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                rows = []
                for n, raw in zip(batch.column(1).to_pylist(), batch.column(2)):
                    stored = raw.as_py()
                    payload = from_wav(stored)
                    f = features_of(payload)
                    rows.append(
                        f
                        | {
                            "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-BLOCK:]),
                            "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(),
                        }
                    )
                col = lambda name, kind: pa.array([r[name] for r in rows], kind)
                named = lambda name: pa.array([[{"start": a, "end": b} for a, b in r[name]] for r in rows], span)
                values = np.concatenate([r["tensors"] for r in rows]) if rows else np.zeros((0, TENSOR_FRAMES * MELS), np.float32)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * (TENSOR_FRAMES * MELS)), pa.array(values.ravel()))
                tensors = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(r["tensors"]) for r in rows]]).astype(np.int32)), cells)
                yield pa.record_batch(
                    [
                        batch.column(0), batch.column(1), col("payload_bytes", pa.int64()), col("payload_sha256", pa.string()), col("tail_crc32", pa.int64()),
                        col("media_bytes", pa.int64()), col("media_sha256", pa.string()), col("n_frames", pa.int64()), tensors, named("spans"), named("segments"), col("feature", pa.string()),
                    ],
                    [f.split()[0] for f in FEATURE_SCHEMA.replace("struct<start:double,end:double>", "x").split(", ")],
                )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(compute, _feature_type())


def tensor_rows(features: DataFrame) -> DataFrame:
    """A row for each tensor: ``doc_id, start, end, tensor``, the last with the metadata of Arrow's tensor type."""
    rows = features.select("doc_id", F.explode(F.arrays_zip("spans", "tensors")).alias("t"))
    return rows.select("doc_id", "t.spans.start", "t.spans.end", F.col("t.tensors").alias("tensor", metadata=TENSOR_META))


def tensor_table(rows: pa.Table) -> pa.Table:
    """An Arrow batch of ``tensor_rows`` with the column as Arrow's fixed-shape tensor type; no value is copied."""
    kind = pa.fixed_shape_tensor(pa.float32(), TENSOR_SHAPE, dim_names=["frame", "mel"])
    flat = pa.FixedSizeListArray.from_arrays(rows["tensor"].combine_chunks().flatten(), TENSOR_FRAMES * MELS)
    return rows.set_column(rows.schema.get_field_index("tensor"), "tensor", pa.ExtensionArray.from_storage(kind, flat))
