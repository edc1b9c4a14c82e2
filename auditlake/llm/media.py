"""Media columns: texts as WAV bytes, read back by the wave module, and their spectral fingerprints.

A text's UTF-8, with bytes 0 up to a positive multiple of ``UNIT``, is the sound: one channel of 8-bit samples, which
WAV stores as they are. ``encoded`` adds that column; ``described`` takes any such column, reads it back in chunks and
computes digests of what it read, and the fingerprint.

The fingerprint: windows of ``FRAME`` samples every ``HOP``, without their mean, under a Hann window, are transformed
(the last one is filled up with silence, so the whole sound is covered). In each of ``BANDS`` bands of frequencies the
strongest is a peak where its band is louder than in the window before and not quieter than in the one after. Each peak
is paired with the next ``FAN`` peaks that come after it within ``REACH`` windows; a pair's code holds both frequencies
and the windows between them, and is stored with the first one's window: ``times`` and ``codes``, in order. Magnitudes
are compared as whole numbers, the lowest frequency of equals counts.

Defined results: null and empty texts give ``UNIT`` zeros and an empty fingerprint; the whole text is stored, whatever its
length; equal texts give equal values; rows that repeat are described as often. Each row is by itself: no exchange, and
no more in memory than the sound, a chunk of its windows and its peaks. Columns that are named like new ones are replaced.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import small_batches

UNIT, RATE = 64, 8000
FRAME, HOP, BANDS, FAN, REACH = 256, 128, 4, 3, 63
#: Windows that are transformed at a time.
CHUNK = 4096
#: Magnitudes are rounded to this part of a sample's step.
STEP = 16
DESCRIBED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, times array<int>, codes array<int>"


def payload(raw: bytes | None) -> bytes:
    raw = raw or b""
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def as_wav(samples: bytes) -> bytes:
    with io.BytesIO() as file:
        with wave.open(file, "wb") as out:
            out.setparams((1, 1, RATE, len(samples), "NONE", ""))
            out.writeframes(samples)
        return file.getvalue()


def samples_of(media: bytes, many: int = CHUNK * HOP):  # noqa: ANN201
    """The stored samples, in chunks."""
    with wave.open(io.BytesIO(media), "rb") as sound:
        if (sound.getnchannels(), sound.getsampwidth()) != (1, 1):
            raise ValueError("only one channel of 8-bit samples is read")
        while some := sound.readframes(many):
            yield some


def loudest(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strongest frequency in each band of each frame, and its magnitude; the lowest frequency of equals."""
    x = frames.astype(np.float64)
    spectrum = np.fft.rfft((x - x.mean(1, keepdims=True)) * np.hanning(FRAME), axis=1)[:, 1:]
    size = np.rint(np.abs(spectrum) * STEP).astype(np.int64).reshape(len(x), BANDS, -1)
    best = size.argmax(2)
    return best + np.arange(BANDS) * size.shape[2] + 1, np.take_along_axis(size, best[:, :, None], 2)[:, :, 0]


def peaks(chunks) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Windows and frequencies of the peaks of a sound, by window, then frequency."""
    kept, bins, sizes = np.zeros(0, np.uint8), [], []
    for chunk in chunks:
        kept = np.concatenate((kept, np.frombuffer(chunk, np.uint8)))
        many = (len(kept) - FRAME) // HOP + 1 if len(kept) >= FRAME else 0
        for part in range(0, many, CHUNK):
            frames = np.lib.stride_tricks.sliding_window_view(kept[part * HOP :], FRAME)[:: HOP][: min(CHUNK, many - part)]
            found = loudest(frames)
            bins.append(found[0])
            sizes.append(found[1])
        kept = kept[many * HOP :]
    if not bins or len(kept) > FRAME - HOP:  # what no window has covered yet
        found = loudest(np.pad(kept, (0, FRAME - len(kept)), constant_values=128)[None])
        bins.append(found[0])
        sizes.append(found[1])
    size, where = np.concatenate(sizes), np.concatenate(bins)
    around = np.pad(size, ((1, 1), (0, 0)))
    at, band = np.nonzero((size > around[:-2]) & (size >= around[2:]))
    return at, where[at, band]


def pairs(at: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of the pairs of each peak with the next ones after it, by first and second peak."""
    later = np.searchsorted(at, at, side="right")
    second = later[:, None] + np.arange(FAN)
    there = second < len(at)
    second = np.minimum(second, max(0, len(at) - 1))
    gap = at[second] - at[:, None] if len(at) else np.zeros((0, FAN), np.int64)
    there &= gap <= REACH
    code = (frequency[:, None] * (FRAME // 2 + 1) + (frequency[second] if len(at) else 0)) * (REACH + 1) + gap
    first = np.broadcast_to(at[:, None], there.shape)
    return first[there].astype(np.int32), code[there].astype(np.int32)


def describe(media: bytes) -> tuple:
    """The values of ``DESCRIBED`` for one sound."""
    digest, size, tail = hashlib.sha256(), 0, b""

    def read():  # noqa: ANN202
        nonlocal size, tail
        for chunk in samples_of(media):
            digest.update(chunk)
            size += len(chunk)
            tail = (tail + chunk)[-UNIT:]
            yield chunk

    times, codes = pairs(*peaks(read()))
    feature = hashlib.sha256(times.astype("<i4").tobytes() + codes.astype("<i4").tobytes()).hexdigest()
    return size, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), f"{len(codes)}:{feature}", times, codes


def _wav(text: Column) -> Column:
    @F.pandas_udf("binary")
    def encode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda r: as_wav(payload(r)), na_action=None)

    return encode(F.coalesce(text, F.lit("")).cast("binary"))


def encoded(docs: DataFrame, text: str = "text", name: str = "media") -> DataFrame:
    """``docs`` with the bytes of the text's payload as WAV."""
    small_batches(docs.sparkSession)
    return docs.withColumn(name, _wav(F.col(text)))


def described(rows: DataFrame, media: str = "media", name: str = "sound") -> DataFrame:
    """``rows`` with a struct of what the stored bytes hold: sizes, digests, and the fingerprint with its feature string."""
    small_batches(rows.sparkSession)
    names = [field.split()[0] for field in DESCRIBED.split(", ")]

    @F.pandas_udf(DESCRIBED)
    def look(stored: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([describe(m) for m in stored], columns=names)

    return rows.withColumn(name, look(F.col(media)))
