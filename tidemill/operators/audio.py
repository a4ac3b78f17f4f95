"""Audio: WAV bytes to mono frames of a fixed number."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def kind(payload: Column) -> Column:
    """wav or flac by the first bytes, else null."""
    start = lambda a, n: F.substring(payload, a, n)
    return F.when((start(1, 4) == F.lit(b"RIFF")) & (start(9, 4) == F.lit(b"WAVE")), "wav").when(start(1, 4) == F.lit(b"fLaC"), "flac")


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """int16 (or float32) samples, (frames,) or (frames, channels), as a WAV file."""
    channels = 1 if samples.ndim == 1 else samples.shape[1]
    width, code = samples.dtype.itemsize, FLOAT if samples.dtype == np.float32 else PCM
    data = np.ascontiguousarray(samples).tobytes()
    head = struct.pack("<HHIIHH", code, channels, rate, rate * channels * width, channels * width, 8 * width)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(data)) + data


def pcm_floats(whole: np.ndarray, bits: int) -> np.ndarray:
    """Integers of 1 to 32 bits as floats between -1 and 1."""
    if not 1 <= bits <= 32:
        raise ValueError(f"samples of {bits} bits")
    return np.clip(whole.astype(np.float32) / np.float32(2.0 ** (bits - 1)), -1, 1)


def downmixed(interleaved: np.ndarray, channels: int) -> np.ndarray:
    """The mean over channels; a length that doesn't divide is an error."""
    if channels <= 0 or len(interleaved) % channels:
        raise ValueError(f"{len(interleaved)} samples are no frames of {channels} channels")
    return interleaved if channels == 1 else np.clip(interleaved.reshape(-1, channels).mean(1, dtype=np.float32), -1, 1)


def wav_mono(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, mono float32 frames) of a WAV file of integers up to 32 bits or float32."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        chunk = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            form = chunk
        elif name == b"data":
            body = chunk
        at += 8 + size + size % 2
    if form is None or body is None or len(form) < 16:
        raise ValueError("a WAV file without format or data")
    code, channels, rate, _, align, bits = struct.unpack("<HHIIHH", form[:16])
    if code == EXTENSIBLE and len(form) >= 26:
        code = struct.unpack("<H", form[24:26])[0]
    width = align // max(channels, 1)
    body = body[: len(body) // max(align, 1) * max(align, 1)]
    if code == FLOAT and bits == 32:
        return rate, downmixed(np.frombuffer(body, "<f4").astype(np.float32), channels)
    if code != PCM or width not in (1, 2, 3, 4):
        raise ValueError(f"WAV of format {code} with {bits} bits")
    if width == 1:
        whole = np.frombuffer(body, np.uint8).astype(np.int32) - 128
    elif width == 3:
        three = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        whole = (three[:, 0] | three[:, 1] << 8 | three[:, 2] << 16) << 8 >> 8
    else:
        whole = np.frombuffer(body, f"<i{width}").astype(np.int64)
    return rate, downmixed(pcm_floats(whole, bits), channels)


def fixed_frames(x: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([x[:n], np.zeros(max(0, n - len(x)), np.float32)]).astype(np.float32)


def frames(rows: DataFrame, n: int, rate: int | None = None, policy: str = "error", channels: int = 1, payload: str = "payload") -> DataFrame:
    """rows with samples (array of n floats) in place of their payload. What can't be decoded, or has another rate than is asked for, is an error or left out, by the policy."""
    if n <= 0 or (rate is not None and rate <= 0):
        raise ValueError("samples and rate are over 0")
    if channels != 1:
        raise ValueError("only one channel is given out")
    if policy not in ("error", "skip"):
        raise ValueError(f"a policy is error or skip, not {policy!r}")
    others = [c for c in rows.columns if c != payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, out = [], []
            for k, data in enumerate(b.column(len(others)).to_pylist()):
                try:
                    has, x = wav_mono(data or b"")
                    if rate is not None and has != rate:
                        raise ValueError(f"a rate of {has}, not {rate}")
                except ValueError:
                    if policy == "error":
                        raise
                    continue
                keep.append(k)
                out.append(fixed_frames(x, n))
            rest = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns[:-1], pa.array(out, pa.list_(pa.float32()))], names=[*others, "samples"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*others).schema)
    return rows.select(*others, payload).mapInArrow(run, f"{fields}samples array<float>")
