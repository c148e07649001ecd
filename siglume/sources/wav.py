"""WAV files as packed PCM tables, and back.

Packed form: ``signal_id, sample_rate, channels, chunk_id, start_frame, samples array<float>`` (interleaved). Files
come through Spark's ``binaryFile`` source, so any store that Spark reads will do.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siglume.sources.flac import decode_flac
from siglume.sources.limits import MAX_SAMPLES, AudioError

CHUNK_FRAMES = 1 << 16
PACKED = "signal_id string, sample_rate int, channels int, chunk_id long, start_frame long, samples array<float>"


def sniff(content: Column) -> Column:
    """Container by its first bytes: wav, flac, ogg, mp3 or null."""
    head = F.hex(F.substring(content, 1, 4))
    sync = F.conv(F.substring(head, 1, 4), 16, 10).cast("int")
    return (
        F.when(head == "52494646", "wav").when(head == "664C6143", "flac").when(head == "4F676753", "ogg")
        .when((F.substring(head, 1, 6) == "494433") | (sync.bitwiseAND(0xFFE0) == 0xFFE0), "mp3")
    )


def decode_wav(raw: bytes, max_samples: int = MAX_SAMPLES):
    """``(rate, channels, float32 samples)``; integers of b bits are divided by 2 ** (b - 1). The length limit is
    checked on the header before anything is decoded; exactly the limit passes."""
    import numpy as np

    if len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise AudioError("not a RIFF/WAVE file")
    at, fmt, data = 12, None, None
    while at + 8 <= len(raw):
        kind, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if kind == b"fmt ":
            fmt = raw[at + 8 : at + 8 + size]
        elif kind == b"data":
            data = memoryview(raw)[at + 8 : min(at + 8 + size, len(raw))]
            break
        at += 8 + size + (size & 1)
    if fmt is None or data is None:
        raise AudioError("no format or no data")
    tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", fmt)
    if tag == 0xFFFE and len(fmt) >= 26:
        tag = struct.unpack_from("<H", fmt, 24)[0]
    if not channels or not rate:
        raise AudioError("no channel or no sample rate")
    width = bits // 8
    if tag not in (1, 3) or (tag == 3 and bits != 32) or (tag == 1 and bits not in (8, 16, 24, 32)):
        raise AudioError(f"unsupported sample format {tag}/{bits}")
    n = len(data) // width
    if n > max_samples:
        raise AudioError(f"{n} samples are more than {max_samples}")
    if n % channels:
        raise AudioError("the last frame is cut off")
    if tag == 3:
        x = np.frombuffer(data[: n * 4], dtype="<f4").copy()
    elif bits == 8:
        x = (np.frombuffer(data[:n], dtype=np.uint8).astype(np.float32) - 128) / 128
    elif bits == 24:
        b = np.frombuffer(data[: n * 3], dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        x = (np.where(v >= 1 << 23, v - (1 << 24), v) / np.float32(1 << 23)).astype(np.float32)
    else:
        x = (np.frombuffer(data[: n * width], dtype=f"<i{width}") / np.float64(1 << (bits - 1))).astype(np.float32)
    if not np.isfinite(x).all():
        raise AudioError("a sample is not finite")
    return rate, channels, x


def encode_wav(samples, rate: int, channels: int, depth: str = "float") -> bytes:
    """WAV bytes as 32-bit float (``float``, ``32``), ``24`` or ``16`` bit integers (clamped, halves away from zero)."""
    import numpy as np

    x = np.asarray(samples, dtype=np.float32)
    if depth in ("float", "32"):
        tag, bits, body = 3, 32, x.astype("<f4").tobytes()
    elif depth in ("16", "24"):
        tag, bits = 1, int(depth)
        full = float(1 << (bits - 1))
        v = np.clip(x.astype(np.float64), -1, 1) * full
        q = np.clip(np.sign(v) * np.floor(np.abs(v) + 0.5), -full, full - 1).astype("<i4")
        body = q.astype("<i2").tobytes() if bits == 16 else q.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    else:
        raise AudioError(f"unknown bit depth {depth!r}")
    block = channels * bits // 8
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, tag, channels, rate, rate * block, block, bits, b"data", len(body))
    return head + body + b"\0" * (len(body) & 1)


def decode(raw: bytes, max_samples: int = MAX_SAMPLES):
    """By the first bytes: WAV or FLAC; lossy containers raise, since no decoder for them is at hand."""
    if raw[:4] == b"fLaC":
        return decode_flac(raw, max_samples)
    if raw[:4] == b"OggS" or raw[:3] == b"ID3" or (len(raw) > 1 and raw[0] == 0xFF and raw[1] & 0xE0 == 0xE0):
        raise AudioError("ogg and mp3 aren't supported")
    return decode_wav(raw, max_samples)


def read_audio(spark: SparkSession, path: str, max_samples: int = MAX_SAMPLES) -> DataFrame:
    """Packed PCM of every WAV or FLAC file under ``path``, one file at a time in a task."""

    def kernel(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            for name, raw in zip(f["path"], f["content"]):
                rate, channels, x = decode(bytes(raw), max_samples)
                step = CHUNK_FRAMES * channels
                parts = [x[k : k + step] for k in range(0, max(len(x), 1), step)]
                yield pd.DataFrame({
                    "signal_id": name, "sample_rate": np.int32(rate), "channels": np.int32(channels),
                    "chunk_id": np.arange(len(parts)), "start_frame": np.arange(len(parts)) * CHUNK_FRAMES, "samples": parts,
                })

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{[wW][aA][vV],[fF][lL][aA][cC]}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(kernel, PACKED)


def pack(sig: DataFrame, key: str, rate: int, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """A mono ``(key, i, x)`` signal in packed form."""
    g = sig.groupBy(F.col(key).cast("string").alias("signal_id"), F.floor(F.col("i") / chunk).alias("chunk_id"))
    out = g.agg(F.sort_array(F.collect_list(F.struct("i", F.col("x").cast("float").alias("x")))).alias("s"))
    return out.select("signal_id", F.lit(rate).alias("sample_rate"), F.lit(1).alias("channels"), "chunk_id", (F.col("chunk_id") * chunk).alias("start_frame"), F.transform("s", lambda v: v["x"]).alias("samples"))


def wav_files(packed: DataFrame, depth: str = "float") -> DataFrame:
    """``signal_id, wav``: one file's bytes for each signal."""

    def kernel(f):
        import numpy as np
        import pandas as pd

        f = f.sort_values("chunk_id")
        x = np.concatenate([np.asarray(s, dtype=np.float32) for s in f["samples"]])
        return pd.DataFrame({"signal_id": [f["signal_id"].iloc[0]], "wav": [encode_wav(x, int(f["sample_rate"].iloc[0]), int(f["channels"].iloc[0]), depth)]})

    return packed.groupBy("signal_id").applyInPandas(kernel, "signal_id string, wav binary")


def unwav(files: DataFrame) -> DataFrame:
    """``signal_id, i, x`` of mono ``wav`` bytes."""

    def kernel(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            for name, raw in zip(f["signal_id"], f["wav"]):
                _, _, x = decode_wav(bytes(raw))
                yield pd.DataFrame({"signal_id": name, "i": np.arange(len(x)), "x": x.astype(float)})

    return files.select("signal_id", "wav").mapInPandas(kernel, "signal_id string, i long, x double")
