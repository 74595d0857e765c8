"""Media columns: texts as WAV samples, short-time Fourier transforms and spectral-peak pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import map_arrow, text_chunks

RATE = 8000
#: Texts handled at once.
ROWS = 500
#: Samples of a frame, of the step between frames, frames transformed at once.
FRAME, HOP, SLAB = 256, 128, 4096
#: Frequency bins where bands begin; each band offers a frame's strongest bin as peak.
BANDS = (2, 8, 20, 44, 84, 129)
#: A peak pairs with peaks at so many following frames.
REACH = 3
#: A Hann window between its zeros: every sample has weight.
_HANN = (0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(FRAME) + 0.5) / FRAME)).astype(np.float32)


def padded(raw: bytes, unit: int = 64) -> bytes:
    """raw with bytes 0 up to a positive multiple of unit."""
    return raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw))


def wav_bytes(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def wav_samples(media: bytes) -> bytes:
    """The samples of a WAV file, as stored."""
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def spectral_peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bins, keep), frames by bands: the strongest bin of each band, kept if above the frame's mean power.

    Long media go through in slabs of SLAB frames, so memory doesn't grow with them.
    """
    x = np.frombuffer(samples, np.uint8)
    frames = max(1, -(-len(x) // HOP))
    bins, keep = [], []
    for lo in range(0, frames, SLAB):
        hi = min(frames, lo + SLAB)
        part = x[lo * HOP : (hi - 1) * HOP + FRAME].astype(np.float32) - 128
        if len(part) < (hi - lo - 1) * HOP + FRAME:
            part = np.concatenate((part, np.zeros((hi - lo - 1) * HOP + FRAME - len(part), np.float32)))
        f = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * _HANN, axis=1)
        power = f.real**2 + f.imag**2
        mean = power[:, BANDS[0] :].mean(axis=1)
        b = np.stack([power[:, p:q].argmax(axis=1) + p for p, q in zip(BANDS, BANDS[1:])], 1)
        bins.append(b)
        keep.append(np.take_along_axis(power, b, 1) > mean[:, None])
    return np.concatenate(bins), np.concatenate(keep)


def fingerprints(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes): for each pair of peaks up to REACH frames apart, the anchor's frame and
    bin1 << 16 | bin2 << 8 | frames between; ordered by time and code."""
    bins, keep = spectral_peaks(samples)
    times, codes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for lo in range(0, len(bins), SLAB):
        for gap in range(1, REACH + 1):
            first, then = slice(lo, min(lo + SLAB, len(bins) - gap)), slice(lo + gap, lo + SLAB + gap)
            if first.stop <= lo:
                break
            t, p, q = np.nonzero(keep[first, :, None] & keep[then, None, :])
            times.append((t + lo).astype(np.int32))
            codes.append((bins[first][t, p] << 16 | bins[then][t, q] << 8 | gap).astype(np.int32))
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.argsort(t.astype(np.int64) << 32 | c)
    return t[order], c[order]


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Each row's whole text stored as WAV, read back, and fingerprinted.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature
    (SHA-256 of the time-coded fingerprint arrays), times and codes (these arrays, of int) and, with keep, media
    (binary). A null text counts as empty: 64 bytes 0. Rows come out as often as they went in; other columns
    are ignored.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema += ", times array<int>, codes array<int>" + (", media binary" if keep else "")

    def one(batch):
        rows, times, codes = [], [], []
        texts = ((raw[a:b], b - a) for _, raw, o in text_chunks(batch.column("text"), 1 << 20) for a, b in zip(o.tolist(), o[1:].tolist()))
        for text, size in texts:
            media = wav_bytes(padded(text))
            back = wav_samples(media)
            t, c = fingerprints(back)
            feature = hashlib.sha256(t.astype("<i4").tobytes() + c.astype("<i4").tobytes()).hexdigest()
            rows.append((size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, media if keep else None))
            times.append(t)
            codes.append(c)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        cols = [pa.array(list(x), k) for x, k in zip(list(zip(*rows)) if rows else [[] for _ in kinds], kinds)]
        ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in times]))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else np.zeros(0, np.int32))) for x in (times, codes)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols[:7], *lists, *(cols[7:] if keep else [])], [x.split()[0] for x in schema.split(", ")])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), one, schema, rows=ROWS)
