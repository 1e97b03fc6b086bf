"""Media columns: texts as WAV samples, their spectra, and fingerprints of pairs of spectral peaks.

A null text counts as empty; an empty one becomes one block of zero samples. Other columns are left out.
Each row's media stand alone, so ties, repeated rows and empty tables need no rule.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumengrid.llm.common import lean, texts

#: Samples to a second, payload blocks, STFT frames and hops, frames in one transform, frames a pair may span.
RATE, BLOCK, FRAME, HOP, AT_ONCE, REACH = 8000, 64, 256, 128, 4096, 3
#: Frequency bins are searched for one peak in each of these bands.
BANDS = ((1, 32), (32, 64), (64, 96), (96, 129))
_WINDOW = np.hanning(FRAME)


def to_wav(payload: bytes) -> bytes:
    """A mono WAV file with the payload as its 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The first channel's samples of an 8-bit WAV file."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if w.getsampwidth() != 1:
            raise ValueError("8-bit samples are expected")
        return w.readframes(w.getnframes())[:: w.getnchannels()]


def stft(samples: np.ndarray) -> Iterator[np.ndarray]:
    """Magnitudes by frame and frequency, at most AT_ONCE frames at a time.

    Frames are centred on every HOP-th sample, with silence around, so that no sample is left to window ends alone; there
    are at least as many as a pair may span.
    """
    count = max(REACH + 1, -(-len(samples) // HOP) + 1)
    samples = np.pad(samples, (FRAME // 2, 0), constant_values=128)
    for lo in range(0, count, AT_ONCE):
        n = min(AT_ONCE, count - lo)
        part = samples[lo * HOP : (lo + n - 1) * HOP + FRAME].astype(np.float64) - 128
        part = np.pad(part, (0, (n - 1) * HOP + FRAME - len(part)))
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        yield np.abs(np.fft.rfft(frames * _WINDOW, axis=1))


def peaks(samples: np.ndarray) -> np.ndarray:
    """The frequency bin of each frame's and band's highest peak, the lowest of equal ones."""
    return np.concatenate([np.stack([lo + np.round(m[:, lo:hi], 3).argmax(axis=1) for lo, hi in BANDS], axis=1) for m in stft(samples)])


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Pairs of a peak and one in the same band up to REACH frames later: frame << 32 | band << 24 | bin << 12 | later bin << 2 | distance."""
    found = peaks(samples).astype(np.int64)
    codes = []
    for band in range(len(BANDS)):
        for d in range(1, REACH + 1):
            a, b = found[:-d, band], found[d:, band]
            codes.append(np.arange(len(a), dtype=np.int64) << 32 | band << 24 | a << 12 | b << 2 | d)
    return np.sort(np.concatenate(codes))


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the text's bytes, filled with zeros to whole blocks, as a WAV file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = [x.encode() for x in batch.column(1).to_pylist()]
            media = [to_wav(x.ljust(max(BLOCK, -(-len(x) // BLOCK) * BLOCK), b"\0")) for x in plain]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, plain), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return texts(docs).mapInArrow(lean(run), "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Digests of doc_id's media and of the payload read back from it, and the fingerprint as a time-coded array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stored in batch.column(2):
                stored = stored.as_py()
                payload = from_wav(stored)
                codes = fingerprint(np.frombuffer(payload, np.uint8))
                feature = f"{len(codes)}:{hashlib.sha256(codes.astype('<i8').tobytes()).hexdigest()[:32]}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, codes))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()))
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "fingerprint"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fingerprint array<long>"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(lean(run), schema)
