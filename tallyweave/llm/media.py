"""Media columns: texts' bytes kept as WAV files in a binary column, read back by the wave module and fingerprinted.

A fingerprint is an array of time-coded hashes: the stored samples go through a short-time Fourier transform whose frames
overlap, so that every sample is in FRAME / HOP of them and a passage shifted by any number of bytes meets like frames. Each frame
keeps its strongest bins that are local maxima, and each peak is paired with the peaks of the frames that follow without overlap. A pair
(bin, later bin, frames between) and the frame it begins at make one integer: frame << 32 | bin << 20 | later << 8 | gap.

Null texts count as empty. Every payload is padded with zero bytes to a positive multiple of 64. Silence before and after gives even the shortest
payload pairs. Texts of any length are one file each (a WAV file holds 4 GB). Repeated texts give equal files and fingerprints; null ids pass by. Ties of strength go to the
lower bin. An empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame

from tallyweave.llm.common import map_texts

RATE = 8000
#: Samples of a frame and between frames' beginnings, peaks kept of a frame, and following frames (those that don't overlap) that a peak is paired with.
FRAME, HOP, PEAKS, FAN = 256, 32, 3, 2
#: Frames transformed at a time.
FRAMES_AT_ONCE = 16_384


def to_wav(payload: bytes) -> bytes:
    """`payload` as a mono WAV file of unsigned 8-bit samples; lossless."""
    with io.BytesIO() as out:
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(RATE)
            w.writeframes(payload)
        return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    """The samples of a WAV file of 8-bit mono."""
    with wave.open(io.BytesIO(stored), "rb") as w:
        if w.getnchannels() != 1 or w.getsampwidth() != 1:
            raise ValueError("8-bit mono is expected")
        return w.readframes(w.getnframes())


def padded(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 bytes padded to a positive multiple of 64, and their number before that."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0)), len(raw)


def peaks_of(frames: np.ndarray) -> np.ndarray:
    """Per frame of samples: its PEAKS strongest local maxima of the spectrum, strongest first, ties to the lower bin; 0 for none."""
    window = np.hanning(FRAME).astype(np.float32)
    power = np.abs(np.fft.rfft((frames.astype(np.float32) - np.float32(128)) * window, axis=1))[:, 1:]
    power = np.rint(power * 16)  # whole steps, so that ties don't hang on rounding
    inner = power[:, 1:-1]
    inner = np.where((inner >= power[:, :-2]) & (inner > power[:, 2:]), inner, 0)
    out = np.zeros((len(frames), PEAKS), dtype=np.int64)
    rows = np.arange(len(frames))
    for k in range(PEAKS):
        best = inner.argmax(axis=1)
        out[:, k] = np.where(inner[rows, best] > 0, best + 2, 0)
        inner[rows, best] = 0
    return out


def fingerprints(payloads: list[bytes]) -> list[np.ndarray]:
    """Per payload its sorted time-coded pair hashes. Payloads are framed one by one, with silence (128) before and after."""
    lead = FRAME - HOP
    n_frames = [-(-(len(p) + lead) // HOP) for p in payloads]
    samples = np.full(sum(n_frames) * HOP + lead, 128, dtype=np.uint8)
    at = lead
    for p, n in zip(payloads, n_frames, strict=True):
        samples[at : at + len(p)] = np.frombuffer(p, dtype=np.uint8)
        at += n * HOP  # the silence after this payload is that before the next
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    peaks = np.concatenate([peaks_of(frames[i : i + FRAMES_AT_ONCE]) for i in range(0, len(frames), FRAMES_AT_ONCE)])
    ends = np.cumsum(n_frames)
    owner = np.repeat(np.arange(len(payloads)), n_frames)
    time = np.arange(len(frames)) - np.repeat(ends - n_frames, n_frames)
    codes, owners = [], []
    for gap in range(FRAME // HOP, FAN * FRAME // HOP + 1, FRAME // HOP):
        same = owner[gap:] == owner[:-gap]
        for a in range(PEAKS):
            for b in range(PEAKS):
                left, right = peaks[:-gap, a], peaks[gap:, b]
                ok = same & (left > 0) & (right > 0)
                codes.append((time[:-gap] << 32 | left << 20 | right << 8 | gap)[ok])
                owners.append(owner[:-gap][ok])
    codes, owners = np.concatenate(codes), np.concatenate(owners)
    order = np.lexsort((codes, owners))
    return np.split(codes[order], np.searchsorted(owners[order], np.arange(1, len(payloads))))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, payload_bytes, media binary, payload_sha256, tail_crc32, media_sha256, fingerprint array<long>) of every row.

    payload_sha256, tail_crc32 and the fingerprint come from the samples read back from `media`.
    """

    def work():
        def columns(texts):
            pads = [padded(t) for t in texts]
            media = [to_wav(p) for p, _ in pads]
            back = [from_wav(m) for m in media]
            return {
                "n_bytes": [n for _, n in pads],
                "payload_bytes": [len(p) for p in back],
                "media": media,
                "payload_sha256": [hashlib.sha256(p).hexdigest() for p in back],
                "tail_crc32": [zlib.crc32(p[-64:]) for p in back],
                "media_sha256": [hashlib.sha256(m).hexdigest() for m in media],
                "fingerprint": fingerprints(back),
            }

        return columns

    return map_texts(docs, work, "n_bytes long, payload_bytes long, media binary, payload_sha256 string, tail_crc32 long, media_sha256 string, fingerprint array<bigint>", id_col, text_col, 4_000_000)


def query_feature(media: DataFrame) -> DataFrame:
    """`media_columns` with the file's size, and its fingerprint as text, in the files' places."""
    return media.selectExpr(
        "*",
        "octet_length(media) AS media_bytes",
        "concat(size(fingerprint), ':', sha2(array_join(fingerprint, ' '), 256)) AS feature",
    ).drop("media", "fingerprint")
