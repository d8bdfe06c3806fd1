"""Audio columns: texts kept as 8-bit WAV samples, with log-mel features and energy segments.

Each recording is stored as RIFF/WAVE, read back from the stored bytes, resampled by a polyphase
filter, cut into overlapped frames, and turned into log-mel energies; frames are gathered into
tensors of a fixed shape in an Arrow IPC stream (type arrow.fixed_shape_tensor) with the time
span of each. Hysteresis on the frame energy marks segments.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.scratch import bounded_batches

HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


@dataclass(frozen=True)
class AudioSpec:
    rate: int = 16_000
    up: int = 1
    down: int = 2
    frame: int = 200
    hop: int = 80
    fft: int = 256
    mels: int = 40
    tensor_frames: int = 32
    taps: int = 24
    high: float = 0.5
    low: float = -0.5


def encode_wav(payload: bytes, rate: int) -> bytes:
    """Mono unsigned 8-bit PCM. A payload of odd length would need a pad byte; ours are even."""
    size = len(payload)
    return HEADER.pack(b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", size) + payload


def decode_wav(media: bytes) -> tuple[int, bytes]:
    """(rate, samples) of what ``encode_wav`` writes."""
    riff, _, wave, fmt, _, pcm, channels, rate, _, _, bits, data, size = HEADER.unpack_from(media)
    if (riff, wave, fmt, data, pcm, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8):
        raise ValueError("not mono 8-bit PCM")
    return rate, media[HEADER.size : HEADER.size + size]


@lru_cache
def _lowpass(up: int, down: int, taps: int) -> np.ndarray:
    """Windowed sinc below both Nyquist rates, with a gain of ``up``."""
    half = taps * max(up, down) // 2
    t = np.arange(-half, half + 1)
    cut = 1 / max(up, down)
    return (up * cut * np.sinc(cut * t) * np.hamming(len(t))).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int, taps: int) -> np.ndarray:
    """Polyphase: every phase of the filter meets only the samples that it is multiplied with."""
    h = _lowpass(up, down, taps)
    half = len(h) // 2
    n = -(-len(x) * up // down)
    out = np.zeros(n, np.float32)
    padded = np.concatenate((np.zeros(half, np.float32), x, np.zeros(half + down, np.float32)))
    for phase in range(up):  # output k = phase, phase + up, ... shares one set of taps
        ks = np.arange(phase, n, up)
        centre = ks * down
        lead = (half - phase * down) % up
        own = np.ascontiguousarray(h[::-1][lead::up])
        first = (centre - half + lead) // up + half
        windows = np.lib.stride_tricks.sliding_window_view(padded, len(own))
        for at in range(0, len(ks), 1 << 14):  # bounded memory for very long recordings
            out[ks[at : at + (1 << 14)]] = windows[first[at : at + (1 << 14)]] @ own
    return out


@lru_cache
def _mel_bank(fft: int, mels: int, rate: float) -> np.ndarray:
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), mels + 2)
    edge = 700 * (10 ** (mel / 2595) - 1) / (rate / 2) * (fft // 2)
    k = np.arange(fft // 2 + 1)[:, None]
    rise, fall = (k - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - k) / (edge[2:] - edge[1:-1])
    return np.clip(np.minimum(rise, fall), 0, None).astype(np.float32)


def log_mel(x: np.ndarray, spec: AudioSpec) -> np.ndarray:
    """(frames, mels) log energies of overlapped frames; the last frame is padded with silence."""
    n = max(1, 1 + -(-(len(x) - spec.frame) // spec.hop))
    x = np.concatenate((x, np.zeros(max(0, (n - 1) * spec.hop + spec.frame - len(x)), np.float32)))
    frames = np.lib.stride_tricks.sliding_window_view(x, spec.frame)[:: spec.hop][:n]
    bank = _mel_bank(spec.fft, spec.mels, spec.rate * spec.up / spec.down)
    out = np.empty((n, spec.mels), np.float32)
    for at in range(0, n, 4096):  # bounded memory for very long recordings
        power = np.abs(np.fft.rfft(frames[at : at + 4096] * np.hanning(spec.frame).astype(np.float32), spec.fft)) ** 2
        out[at : at + 4096] = np.log(power.astype(np.float32) @ bank + 1e-6)
    return np.round(out, 3)


def segments(energy: np.ndarray, high: float, low: float) -> list[tuple[int, int]]:
    """[first, past the last) frames from a rise over ``high`` until a fall under ``low``, in deviations."""
    z = (energy - energy.mean()) / (energy.std() + 1e-6)
    said = np.where(z > high, 2, np.where(z < low, 1, 0))
    last = np.maximum.accumulate(np.where(said > 0, np.arange(len(z)), -1))
    on = (last >= 0) & (said[last] == 2)
    edge = np.diff(on.astype(np.int8), prepend=0, append=0)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def tensors(mel: np.ndarray, spec: AudioSpec) -> bytes:
    """Frames as fixed-shape tensors with their time spans (ms), as an Arrow IPC stream."""
    n = -(-len(mel) // spec.tensor_frames)
    padded = np.zeros((n, spec.tensor_frames, spec.mels), np.float32)
    padded.reshape(-1, spec.mels)[: len(mel)] = mel
    ms = 1000 * spec.hop * spec.down / (spec.rate * spec.up)
    begin = np.arange(n) * spec.tensor_frames
    batch = pa.record_batch(
        [
            pa.FixedShapeTensorArray.from_numpy_ndarray(padded),
            pa.array((begin * ms).astype(np.int32)),
            pa.array((np.minimum(begin + spec.tensor_frames, len(mel)) * ms).astype(np.int32)),
        ],
        names=["log_mel", "start_ms", "end_ms"],
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


SCHEMA = (
    "n_bytes long, media binary, payload binary, frames int, tensors binary, "
    "segments array<struct<start_ms: int, end_ms: int>>"
)


def _recorder(spec: AudioSpec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ms = 1000 * spec.hop * spec.down / (spec.rate * spec.up)
        span = pa.struct([("start_ms", pa.int32()), ("end_ms", pa.int32())])

        def made(rows: list[tuple]) -> pa.RecordBatch:
            own = list(zip(*rows))
            kinds = [batch.schema.field(0).type, pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.list_(span)]
            names = ["id", "n_bytes", "media", "payload", "frames", "tensors", "segments"]
            return pa.record_batch([pa.array(c, k) for c, k in zip(own, kinds)], names=names)

        for batch in batches:
            rows, size = [], 0
            for key, text in zip(batch.column(0), batch.column(1)):
                raw = text.as_py().encode() if text.is_valid else b""
                padded = raw + b" " * (-len(raw) % 192 if raw else 192)
                media = encode_wav(padded, spec.rate)
                _, payload = decode_wav(media)
                x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
                mel = log_mel(resample(x, spec.up, spec.down, spec.taps), spec)
                found = segments(mel.mean(axis=1), spec.high, spec.low)
                spans = [{"start_ms": int(a * ms), "end_ms": int(b * ms)} for a, b in found]
                rows.append((key.as_py(), len(raw), media, payload, len(mel), tensors(mel, spec), spans))
                size += len(media)
                if size > 4 << 20:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    return run


def audio_features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", spec: AudioSpec = AudioSpec()) -> DataFrame:
    """One row per row of ``docs``: stored media, the payload read back, tensors and segments.

    The payload is the text's UTF-8 bytes (a null text has none), filled with blanks to a positive
    multiple of 192. Rows are independent: equal texts get equal values, ids may repeat or be null,
    other columns are ignored and an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_recorder(spec), f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)
