"""Media columns: payloads kept as WAV bytes, read back with the wave module, and fingerprinted by spectral peaks.

A fingerprint is that of a landmark search: a short-time Fourier transform, the strongest peaks of each span of frames,
and pairs of a peak with the next few ones, as (anchor frame, hash of both bins and their distance in frames).
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_lists

#: Samples a frame, and from one frame to the next; frames in a span, peaks kept of each, later peaks paired with each.
FRAME, HOP, SPAN, PEAKS, FAN = 192, 96, 8, 5, 3
RATE = 8000
#: Frames that are transformed at once, a multiple of SPAN: of a very long text, no more than these frames' spectra are held.
AT_ONCE = 4096
WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """payload as the samples of a mono WAV file of 8 bits."""
    with io.BytesIO() as out:
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(rate)
            w.writeframes(payload)
        return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file."""
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def spectrum(samples: np.ndarray, first: int = 0, frames: int | None = None) -> np.ndarray:
    """Magnitudes (frames, bins) of windowed frames of 8-bit samples, `frames` of them from the first on; fewer samples than a frame are padded."""
    if frames is None:
        frames = count_frames(samples)
    x = samples[first * HOP : (first + frames - 1) * HOP + FRAME].astype(np.float32) - 128.0
    if len(x) < FRAME:
        x = np.pad(x, (0, FRAME - len(x)))
    return np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * WINDOW, axis=1)).astype(np.float32)


def count_frames(samples: np.ndarray) -> int:
    """How many frames fit, one at least."""
    return max(0, len(samples) - FRAME) // HOP + 1


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the PEAKS strongest peaks of each span. Ties go to the earlier frame, then the lower bin."""
    total, at, which = count_frames(samples), [], []
    for first in range(0, total, AT_ONCE):
        s = np.round(spectrum(samples, first, min(AT_ONCE, total - first))[:, 1:], 3)
        frames, bins = s.shape
        spans = -(-frames // SPAN)
        s = np.pad(s, ((0, spans * SPAN - frames), (0, 0)), constant_values=-1).reshape(spans, SPAN * bins)
        top = np.argsort(-s, axis=1, kind="stable")[:, :PEAKS]
        strong = np.take_along_axis(s, top, axis=1) > 0
        at.append(first + (np.arange(spans)[:, None] * SPAN + top // bins)[strong])
        which.append((top % bins + 1)[strong])
    return np.concatenate(at), np.concatenate(which)


def landmarks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time codes and hashes of a signal's peak pairs, in order of time."""
    at, which = peaks(samples)
    order = np.lexsort((which, at))
    at, which = at[order], which[order]
    times, hashes = [], []
    for step in range(1, FAN + 1):
        a, b = slice(None, -step), slice(step, None)
        gap = np.minimum(at[b] - at[a], 63)
        times.append(at[a])
        hashes.append(which[a].astype(np.int64) << 16 | which[b].astype(np.int64) << 8 | gap)
    times, hashes = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((hashes, times))
    return times[order].astype(np.int32), hashes[order].astype(np.int32)


def media_column(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = 192) -> DataFrame:
    """Each text as a WAV file and its fingerprint: (key, n_bytes, payload, media, codes array<struct<t, hash>>).

    The payload is the text in UTF-8, filled up with spaces to a positive multiple of block; it is what the stored file
    gives back, not what went in. A null text counts as empty: one block of spaces. Equal texts give equal values, a null key
    stays null; other columns are ignored; rows are independent, without a shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(keys, texts):
        sizes, payloads, files, codes = [], [], [], []
        for t in texts:
            raw = (t or "").encode("utf-8", "replace")
            media = to_wav(raw + b" " * (-len(raw) % block if raw else block))
            back = from_wav(media)
            times, hashes = landmarks(np.frombuffer(back, dtype=np.uint8))
            sizes.append(len(raw))
            payloads.append(back)
            files.append(media)
            codes.append((times, hashes))
        ends = np.cumsum([0] + [len(c[0]) for c in codes])
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([c[k] for c in codes]), pa.int32()) for k in (0, 1)], ["t", "hash"])
        return keys, sizes, payloads, files, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)

    schema = f"`{key}` {kind}, n_bytes long, payload binary, media binary, codes array<struct<t:int,hash:int>>"
    return map_lists(docs.select(F.col(key), F.col(text)), run, schema)
