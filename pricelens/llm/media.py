"""Sound columns: WAV files, short-time Fourier transforms, spectral-peak fingerprints.

A payload is kept losslessly as the 8-bit samples of a WAV file in a binary column. Reading it
back gives the samples; frames of them are transformed, the strongest local peaks of each
frame are kept, and pairs of near peaks make fingerprints: an array of codes that hold the
time of the first peak, both frequencies and the time between them.
"""

from __future__ import annotations

import io
import wave
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import mapped

BLOCK = 192  # payloads are padded to a multiple of this
RATE = 8000
HOP = BLOCK // 2
PEAKS = 2  # most peaks of a frame
REACH = 3  # frames between the two peaks of a pair, at most
STRETCH = 4096  # frames transformed at once: a long sound needs no more memory than a short one

_WINDOW = np.hanning(BLOCK).astype(np.float32)


def padded(text: bytes) -> bytes:
    """``text`` with blanks behind, up to a positive multiple of BLOCK bytes."""
    return text + b" " * (-len(text) % BLOCK if text else BLOCK)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    file = io.BytesIO()
    with wave.open(file, "wb") as out:
        out.setnchannels(1)
        out.setsampwidth(1)
        out.setframerate(rate)
        out.writeframes(payload)
    return file.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as file:
        if (file.getnchannels(), file.getsampwidth()) != (1, 1):
            raise ValueError("not one channel of 8-bit samples")
        return file.readframes(file.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time and frequency of the strongest local peaks, at most PEAKS a frame, in order.

    The transform's numbers are compared after rounding, so that ties are ties everywhere.
    """
    count = max((len(samples) - BLOCK) // HOP + 1, 0)
    times, tones = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first in range(0, count, STRETCH):
        frames = np.lib.stride_tricks.sliding_window_view(samples, BLOCK)[first * HOP :: HOP][
            : min(STRETCH, count - first)
        ]
        centred = frames.astype(np.float32)
        centred = (centred - centred.mean(axis=1, keepdims=True)) * _WINDOW
        power = np.rint(np.abs(np.fft.rfft(centred, axis=1)))
        inner = power[:, 1:-1]
        local = (inner > power[:, :-2]) & (inner >= power[:, 2:]) & (inner > 0)
        # Strongest first, lower tones first among equals.
        strength = np.where(local, inner * 128 + (127 - np.arange(inner.shape[1])), 0)
        best = np.argpartition(-strength, PEAKS - 1, axis=1)[:, :PEAKS]
        best.sort(axis=1)
        kept = np.take_along_axis(strength, best, axis=1) > 0
        frame, rank = np.nonzero(kept)
        times.append(frame + first)
        tones.append(best[frame, rank] + 1)
    return np.concatenate(times), np.concatenate(tones)


def fingerprints(samples: np.ndarray) -> np.ndarray:
    """Time-coded pairs of peaks: time << 16 | first tone << 9 | second tone << 2 | gap."""
    time, tone = peaks(samples)
    codes = []
    for step in range(1, PEAKS * (REACH + 1)):
        gap = time[step:] - time[:-step]
        near = (gap > 0) & (gap <= REACH)
        codes.append((time[:-step] << 16 | tone[:-step] << 9 | tone[step:] << 2 | gap)[near])
    return np.sort(np.concatenate(codes))


def stored(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text as a WAV file; a null text counts as empty."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            column = batch.column(1).cast(pa.binary())
            # A few MB at once, whatever the length of the rows.
            low, total, rows = 0, 0, []
            for k in range(len(column)):
                text = column[k].as_py() or b""
                rows.append((len(text), to_wav(padded(text))))
                total += len(text)
                if total > 4_000_000 or k + 1 == len(column):
                    yield {
                        "doc_id": batch.column(0).slice(low, len(rows)),
                        "n_bytes": pa.array([n for n, _ in rows], pa.int64()),
                        "media": pa.array([m for _, m in rows], pa.binary()),
                    }
                    low, total, rows = k + 1, 0, []

        return work

    return mapped(docs.select("doc_id", "text"), make, "doc_id bigint, n_bytes bigint, media binary")


def described(media: DataFrame) -> DataFrame:
    """``media`` read back: ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, fingerprint`` (array of time-coded pairs)."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            sizes, shas, tails, prints, lengths, media_shas = [], [], [], [], [], []
            for value in batch.column(2):
                file = value.as_py()
                payload = from_wav(file)
                sizes.append(len(payload))
                shas.append(sha256(payload).hexdigest())
                tails.append(zlib.crc32(payload[-16:]))
                lengths.append(len(file))
                media_shas.append(sha256(file).hexdigest())
                prints.append(fingerprints(np.frombuffer(payload, np.uint8)))
            ends = np.cumsum([0, *map(len, prints)]).astype(np.int32)
            codes = np.concatenate([np.zeros(0, np.int64), *prints])
            yield {
                "doc_id": batch.column(0), "n_bytes": batch.column(1),
                "payload_bytes": pa.array(sizes, pa.int64()),
                "payload_sha256": pa.array(shas, pa.string()),
                "tail_crc32": pa.array(tails, pa.int64()),
                "media_bytes": pa.array(lengths, pa.int64()),
                "media_sha256": pa.array(media_shas, pa.string()),
                "fingerprint": pa.ListArray.from_arrays(pa.array(ends), pa.array(codes)),
            }

        return work

    return mapped(
        media.select("doc_id", "n_bytes", "media"), make,
        "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, "
        "tail_crc32 bigint, media_bytes bigint, media_sha256 string, fingerprint array<bigint>",
    )


def media_report(docs: DataFrame) -> DataFrame:
    """The columns of ``described``, and ``feature``: number of fingerprint pairs and their digest.

    Equal texts have equal values; repeated rows give repeated results, a null text counts as
    empty, a null doc_id stays null, extra columns are ignored.
    """
    found = described(stored(docs))
    digest = F.sha2(F.array_join(F.col("fingerprint").cast("array<string>"), ","), 256)
    feature = F.concat_ws(":", F.size("fingerprint").cast("string"), digest)
    return found.withColumn("feature", feature)
