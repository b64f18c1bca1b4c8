"""Media columns: payloads as 8-bit mono WAV, short-time Fourier transforms, spectral-peak pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices

RATE, FRAME, HOP = 8000, 576, 288
#: Peaks kept per frame (local maxima of the spectrum above `FLOOR` times the frame's mean), frames a pair may span.
PEAKS, FLOOR, SPAN = 3, 2.0, 4
FRAMES_AT_ONCE = 2048
_WINDOW = np.hanning(FRAME).astype(np.float32)


def pad(data: bytes, block: int = FRAME) -> bytes:
    """The bytes, filled up with 255 to a positive multiple of `block`."""
    return data + b"\xff" * (-len(data) % block if data else block)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A WAV file of 8-bit mono samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(data: bytes) -> bytes:
    """The samples of an 8-bit mono WAV file."""
    with wave.open(io.BytesIO(data)) as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return w.readframes(w.getnframes())


def spectrum(samples: np.ndarray, frame: int = FRAME, hop: int = HOP):
    """Blocks (first frame, magnitudes: frames x bins) of the short-time Fourier transform, a bounded number of frames at a time."""
    x = samples.astype(np.float32) / 128 - 1
    count = max(1, (len(x) - frame) // hop + 1)
    window = _WINDOW if frame == FRAME else np.hanning(frame).astype(np.float32)
    for a in range(0, count, FRAMES_AT_ONCE):
        b = min(count, a + FRAMES_AT_ONCE)
        at = np.lib.stride_tricks.sliding_window_view(x[a * hop : (b - 1) * hop + frame], frame)[::hop]
        yield a, np.abs(np.fft.rfft(at * window, axis=1))[:, 1:]


def peaks(mags: np.ndarray) -> np.ndarray:
    """Bins of the strongest local maxima of every frame, -1 where there are fewer; equal heights prefer the lower bin."""
    mid = mags[:, 1:-1]
    top = (mid > mags[:, :-2]) & (mid >= mags[:, 2:]) & (mid > FLOOR * mags.mean(axis=1, keepdims=True))
    height = np.where(top, np.round(mid, 3), -1)
    best = np.argsort(-height, axis=1, kind="stable")[:, :PEAKS]
    return np.where(np.take_along_axis(height, best, axis=1) > 0, best + 1, -1)


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded fingerprints: frame numbers, and codes of a peak pair (first bin, second bin, frames between)."""
    found = np.concatenate([peaks(m) for _, m in spectrum(samples)])
    times, codes = [], []
    for gap in range(1, SPAN + 1):
        a, b = found[:-gap], found[gap:]
        t, i, j = np.nonzero((a >= 0)[:, :, None] & (b >= 0)[:, None, :])
        times.append(t)
        codes.append((a[t, i] << 20) | (b[t, j] << 8) | gap)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order], c[order]


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows `doc_id, n_bytes, media`: the padded UTF-8 of a text (null: empty) as a WAV file.

    One row for each row of `docs`; an empty text is 576 samples of 255, an empty table gives no rows.
    """

    def run(batches):
        for b in slices(batches):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            cols = [b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([to_wav(pad(t)) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "media"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, peak_times array<bigint>, peak_codes array<bigint>"


def media_features(media: DataFrame) -> DataFrame:
    """Of stored media rows: sizes and digests of the file and of the samples read from it, and `peak_times, peak_codes`."""

    def run(batches):
        for batch in batches:
            for b in slices(iter([batch]), "media"):
                rows = []
                for doc, n, data in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media").to_pylist(), strict=True):
                    got = from_wav(data)
                    t, c = fingerprint(np.frombuffer(got, np.uint8))
                    rows.append((doc, n, len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-32:]), len(data), hashlib.sha256(data).hexdigest(), t, c))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _FEATURES.split(", ")])

    return media.mapInArrow(run, _FEATURES)


def feature_digest() -> Column:
    """A short text of the fingerprint arrays: how many pairs, and a hash of times and codes."""
    return F.concat(F.size("peak_codes").cast("string"), F.lit(":"), F.hex(F.xxhash64("peak_times", "peak_codes")))
