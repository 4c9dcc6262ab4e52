"""Media columns: WAV files, short-time Fourier transforms and spectral-peak fingerprints.

A payload of bytes is stored as the 8-bit mono samples of a WAV file and read back, both by the
wave module. Features come from what was read: frames of FRAME samples, HOP apart, under a Hann
window; the magnitude of each frame's Fourier transform; peaks, which are the bins above the
frame's mean that exceed their neighbours in frequency and aren't below those in time; and pairs
of a peak with the next FAN_OUT peaks at most REACH frames later. Each pair is one number, the
two bins and the frames between, stored beside the frame of its first peak: an array in order
of time. Equal payloads give equal files, arrays and digests.

A null text counts as empty. A payload is never empty: it is filled up with bytes 32 to a positive
multiple of UNIT. Rows are worked on one by one and whole.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 192
FRAME, HOP, RATE = 192, 96, 8000
FAN_OUT, REACH = 3, 16
#: Frames that are transformed at once.
BLOCK = 4096
_HANN = np.hanning(FRAME).astype(np.float32)


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def to_wav(data: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(RATE)
        file.writeframes(data)
    return out.getvalue()


def from_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as file:
        return file.readframes(file.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the spectral peaks, in order of time, then frequency."""
    signal = np.frombuffer(samples, np.uint8)
    if len(signal) < FRAME:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    times, bins = [], []
    for at in range(0, len(frames), BLOCK):
        begin, end = max(0, at - 1), min(len(frames), at + BLOCK + 1)  # neighbours in time, too
        size = np.abs(np.fft.rfft((frames[begin:end].astype(np.float32) - 128) * _HANN, axis=1))[:, 1:]
        inner = size[:, 1:-1]
        found = (inner > size[:, :-2]) & (inner > size[:, 2:]) & (inner > size.mean(axis=1, keepdims=True))
        found[1:] &= inner[1:] >= inner[:-1]
        found[:-1] &= inner[:-1] >= inner[1:]
        t, b = np.nonzero(found[at - begin : at - begin + min(BLOCK, len(frames) - at)])
        times.append(t + at)
        bins.append(b + 2)
    return np.concatenate(times), np.concatenate(bins)


def pairs(times: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, code) of the peak pairs in order of time; code: first bin, second bin, frames between."""
    at, code = [], []
    for k in range(1, FAN_OUT + 1):
        gap = times[k:] - times[:-k]
        near = gap <= REACH
        at.append(times[:-k][near])
        code.append((bins[:-k][near] << 16) | (bins[k:][near] << 8) | gap[near])
    at, code = np.concatenate(at), np.concatenate(code)
    order = np.lexsort((code, at))
    return at[order].astype("<i4"), code[order].astype("<i4")


MEDIA = "n_bytes long, media binary, samples binary, peak_times array<int>, pair_times array<int>, pair_codes array<int>"
#: Rows that leave a worker at once.
ROWS = 256


def describe(text: str | None) -> tuple[int, bytes, bytes, np.ndarray, np.ndarray, np.ndarray]:
    """MEDIA of one text."""
    file = to_wav(payload(text))
    samples = from_wav(file)
    times, bins = peaks(samples)
    at, code = pairs(times, bins)
    return len((text or "").encode("utf-8", "surrogatepass")), file, samples, times.astype("<i4"), at, code


def media_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, MEDIA), one row for each row of docs: the text's length in bytes, the WAV file, the
    samples read back from it, the frames of its peaks, and the frames and codes of its peak pairs."""
    kinds = [pa.int64(), pa.binary(), pa.binary(), *[pa.list_(pa.int32())] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                some = whole.slice(at, ROWS)
                columns = zip(*(describe(t) for t in some.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], schema=pa.schema([("doc_id", some.column(0).type), *zip(NAMES, kinds, strict=True)]))

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {MEDIA}")


NAMES = [x.split()[0] for x in MEDIA.split(", ")]
