"""Media columns: texts stored as WAV sound, read back by the ``wave`` module, and fingerprinted.

A payload becomes the samples of a mono 8-bit WAV file, byte for byte. From the samples that are read back a
short-time Fourier transform is taken; in each frame the strongest bin of each frequency band is a peak if it stands
out; pairs of a peak and the peaks that follow soon in the neighbouring bands are the fingerprint: an array of codes
(first bin, second bin, distance in frames) with an array of the times at which they start.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows


@dataclass(frozen=True)
class Spectrum:
    """``frame`` samples every ``hop``; bands start at the bins ``edges``; a peak is ``factor`` times its frame's mean
    or more; a pair spans at most ``reach`` frames. ``block``: frames transformed at once, which bounds the memory."""

    rate: int = 8000
    frame: int = 256
    hop: int = 128
    edges: tuple[int, ...] = (1, 9, 17, 33, 65, 97)
    factor: float = 2.0
    reach: int = 3
    block: int = 2048


def payload(text: bytes | None, multiple: int = 64) -> bytes:
    """The bytes with zeros up to a positive multiple of ``multiple``."""
    text = text or b""
    return text + bytes(-len(text) % multiple if text else multiple)


def to_wav(samples: bytes, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes()), w.getframerate()


def fingerprint(samples: bytes, s: Spectrum = Spectrum()) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes) of all peak pairs, by time and then by code. Samples are unsigned with 128 as silence; the last
    frame is filled up with silence."""
    x = np.frombuffer(samples, np.uint8)
    frames = max(1, -(-(len(x) - s.frame) // s.hop) + 1) if len(x) else 0
    if not frames:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = np.r_[x, np.full((frames - 1) * s.hop + s.frame - len(x), 128, np.uint8)]
    window = np.hanning(s.frame + 1)[:-1].astype(np.float32)
    bands = len(s.edges)
    bins = np.zeros((frames, bands), np.int64)  # 0: no peak
    views = np.lib.stride_tricks.sliding_window_view(x, s.frame)[:: s.hop]
    for start in range(0, frames, s.block):
        part = views[start : start + s.block].astype(np.float32) - np.float32(128)
        power = np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * window, axis=1))
        level = power[:, 1:].mean(axis=1) * s.factor
        for k, low in enumerate(s.edges):
            high = s.edges[k + 1] if k + 1 < bands else power.shape[1]
            best = power[:, low:high].argmax(axis=1)
            strong = power[np.arange(len(power)), low + best] >= np.maximum(level, 1e-6)
            bins[start : start + s.block, k] = np.where(strong, low + best, 0)
    times, codes = [], []
    for apart in range(1, min(s.reach, frames - 1) + 1):
        first, second = bins[:-apart], bins[apart:]
        for near in (-1, 0, 1):
            a, b = first[:, max(0, -near) : bands - max(0, near)], second[:, max(0, near) : bands - max(0, -near)]
            at, where = np.nonzero((a > 0) & (b > 0))
            times.append(at)
            codes.append((a[at, where] << 20) | (b[at, where] << 8) | apart)
    t, c = (np.concatenate(y) if y else np.zeros(0, np.int64) for y in (times, codes))
    by = np.lexsort((c, t))
    return t[by], c[by]


def feature(times: np.ndarray, codes: np.ndarray) -> str:
    """The fingerprint as one value: the number of pairs and a hash of the time-coded array."""
    return f"{len(codes)}:{hashlib.sha256(np.stack([times, codes]).astype('<i8').tobytes()).hexdigest()}"


def media_columns(df: DataFrame, key: str = "doc_id", text: str = "text", spectrum: Spectrum = Spectrum(), outputs: bool = True) -> DataFrame:
    """Rows (``key``, digests of payload and file, feature, n_pairs; with ``outputs`` also the file in ``media`` and
    the fingerprint in ``times`` and ``codes``), of every whole text.

    A null or empty text is 64 zero bytes. Equal texts have equal values; null and repeated keys stay; other columns
    are not read. Hashes of the payload are those of the samples that were read back from the stored file.
    """

    def run(keys: list, texts: list) -> list[list]:
        out: list[list] = [[] for _ in range(11)]
        for t in texts:
            stored = to_wav(payload(t), spectrum.rate)
            back, _ = from_wav(stored)
            times, codes = fingerprint(back, spectrum)
            row = (
                len(t or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored),
                hashlib.sha256(stored).hexdigest(), feature(times, codes), len(codes), stored, times, codes,
            )
            for x, y in zip(out, row):
                x.append(y)
        return [keys, *(out if outputs else out[:8])]

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pairs long"
    return map_rows(df, [F.col(key), F.col(text).cast("binary")], run, schema + (", media binary, times array<int>, codes array<int>" if outputs else ""), rows=64)
