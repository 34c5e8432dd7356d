"""Media columns: texts as WAV audio, short-time Fourier transforms and spectral-peak pair fingerprints.

The UTF-8 bytes of a text, padded with blanks to a positive multiple of 192, are the 8-bit samples of a mono WAV made by
the wave module. The samples are read back from the stored bytes; frames of ``FRAME`` samples, ``HOP`` apart (half a
frame, so what the Hann window fades at the edge of one frame is in the middle of the next) give spectra; the strongest
bin of each band that is over twice its frame's mean is a peak; each peak, in order of time and bin, is paired with the
next ``FAN`` peaks that are fewer than 256 frames away. A pair is one 64-bit code ``bin << 40 | bin' << 24 | frames
between << 16``, stored beside the time (in frames) of its first peak; ``feature`` sums both arrays up.

A null text is the empty text: 192 blanks. Equal texts give equal values. Work goes text by text in blocks of frames, so
memory is bounded by the longest text and not by a batch. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import text_column

RATE, FRAME, HOP, FAN = 8000, 256, 128, 3
#: Frequency bands of the 129 bins, from the first bin to the one after the last.
BANDS = ((4, 20), (20, 52), (52, 129))
BLOCK_FRAMES = 4096
_WINDOW = np.hanning(FRAME).astype(np.float32)


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


def peak_pairs(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(time in frames, code) of every pair of neighbouring spectral peaks."""
    x = np.frombuffer(samples, dtype=np.uint8)
    frames = max(1, -(-max(len(x) - FRAME, 0) // HOP) + 1)
    x = np.concatenate([x, np.full(max(0, (frames - 1) * HOP + FRAME - len(x)), 128, dtype=np.uint8)])
    times, bins = [], []
    for lo in range(0, frames, BLOCK_FRAMES):
        hi = min(frames, lo + BLOCK_FRAMES)
        block = np.lib.stride_tricks.sliding_window_view(x[lo * HOP : (hi - 1) * HOP + FRAME], FRAME)[::HOP].astype(np.float32)
        power = np.abs(np.fft.rfft((block - 128) * _WINDOW, axis=1)).astype(np.float32)
        level = power.mean(axis=1)
        for a, b in BANDS:
            best = power[:, a:b].argmax(axis=1)
            loud = np.flatnonzero(power[np.arange(hi - lo), a + best] > 2 * level)
            times.append(lo + loud)
            bins.append(a + best[loud])
    t, f = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((f, t))
    t, f = t[order].astype(np.int64), f[order].astype(np.int64)
    at, code = [], []
    for step in range(1, FAN + 1):
        gap = t[step:] - t[:-step]
        near = np.flatnonzero(gap < 256)
        at.append(t[:-step][near])
        code.append(f[:-step][near] << 40 | f[step:][near] << 24 | gap[near] << 16)
    at, code = np.concatenate(at), np.concatenate(code)
    order = np.lexsort((code, at))
    return at[order], code[order]


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, media_bytes long, media_sha256 string, times array<int>, codes array<long>, feature string"


def feature_of(times: np.ndarray, codes: np.ndarray) -> str:
    """Geometry, pairs, a checksum of both arrays and the first code."""
    mark = zlib.crc32(codes.astype("<i8").tobytes(), zlib.crc32(times.astype("<i8").tobytes()))
    return f"stft{FRAME}/{HOP}:{len(codes)}:{mark:08x}:{codes[0] if len(codes) else 0:x}"


KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string()]


def _row(raw: bytes, keep_media: bool) -> tuple:
    payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
    media = to_wav(payload)
    back = from_wav(media)
    t, c = peak_pairs(back)
    return (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), media if keep_media else None, len(media), hashlib.sha256(media).hexdigest(), t, c, feature_of(t, c))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Id, digests, the fingerprint arrays and, with ``keep_media``, the WAV itself. ``id_col`` must be an integer."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), text_column(batch, text_col)
            for lo in range(0, len(batch), 256):
                some = texts.slice(lo, 256)
                rows = [_row(t.as_buffer().to_pybytes(), keep_media) for t in some]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, len(rows)).cast(pa.int64()), *cols], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias(text_col)).mapInArrow(encode, SCHEMA)


def op9_wav_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The media itself stays out of the result; it is rebuilt from the text at will."""
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_media=False).drop("media")
