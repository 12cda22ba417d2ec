"""Media columns: WAV samples, short-time spectra and fingerprints of spectral-peak pairs."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from attesta.llm.common import slices

FRAME = 192
RATE = 8000
#: Frequency bands (bounds of bins of the real spectrum); each frame gives its strongest bin per band.
BANDS = (1, 6, 12, 24, 48, 97)
#: How many frames after an anchor a partner peak may lie.
REACH = 3
WINDOW = np.hanning(FRAME).astype(np.float32)
MEDIA_TYPE = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, peak_times array<int>, peak_codes array<int>, feature string"
)


def wav_bytes(samples: bytes, rate: int = RATE) -> bytes:
    """One channel of unsigned 8-bit samples as a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def read_wav(stored: bytes) -> bytes:
    """The samples of a WAV file, all of them."""
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """Frame by band: the strongest bin of each band of each frame's spectrum; 0 where the band is silent."""
    x = np.frombuffer(samples, np.uint8).reshape(-1, FRAME).astype(np.float32) - 128
    power = np.abs(np.fft.rfft((x - x.mean(1, keepdims=True)) * WINDOW, axis=1))
    found = np.empty((len(x), len(BANDS) - 1), np.int32)
    for k, (lo, hi) in enumerate(zip(BANDS, BANDS[1:], strict=False)):
        best = power[:, lo:hi].argmax(1)
        loud = power[np.arange(len(x)), lo + best] > 1e-3
        found[:, k] = np.where(loud, lo + best, 0)
    return found


def pair_codes(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded fingerprints: (anchor bin, partner bin, distance in frames) packed into one int, with the anchor's frame."""
    times, codes = [], []
    for gap in range(1, REACH + 1):
        if len(found) > gap:
            a, b = found[:-gap], np.roll(found, -1, axis=1)[gap:]
            keep = (a > 0) & (b > 0)
            frames = np.broadcast_to(np.arange(len(a))[:, None], a.shape)
            times.append(frames[keep])
            codes.append((a[keep] << 10) | (b[keep] << 2) | gap)
    if not times:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def media_row(text: bytes) -> tuple:
    payload = text + b" " * (-len(text) % FRAME or (0 if text else FRAME))
    stored = wav_bytes(payload)
    back = read_wav(stored)
    times, codes = pair_codes(peaks(back))
    digest = hashlib.sha256(times.tobytes() + codes.tobytes()).hexdigest()
    return (
        len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored),
        hashlib.sha256(stored).hexdigest(), times, codes, f"{len(codes)}:{digest}",
    )


def media_columns(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Store each whole text's UTF-8 bytes as a WAV of 8-bit samples, read it back and fingerprint its spectrum.

    A text is padded with spaces to a positive multiple of 192 bytes, so null and empty texts give one frame.
    Equal texts give equal rows; other columns are dropped, so clashing names don't matter. One row per input row.
    A row needs memory in proportion to its own text only. The fingerprint is peak_codes, time-coded by peak_times: the code of
    each pair of peaks and its anchor's frame; feature is their number and digest.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("peak_times", pa.list_(pa.int32())), ("peak_codes", pa.list_(pa.int32())), ("feature", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t"):
                texts = batch.column("t").cast(pa.binary()).to_pylist()
                rows = [media_row(t or b"") for t in texts]
                columns = [batch.column("k"), *map(list, zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if i else c for i, (c, f) in enumerate(zip(columns, schema, strict=True))], schema=schema)

    return docs.selectExpr(f"cast({key} as long) k", f"{text} t").mapInArrow(run, MEDIA_TYPE)
