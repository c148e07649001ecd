"""Mel spectrograms as PNG bytes, and image comparison."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame


def mel_db(x: np.ndarray, rate: int, fft: int = 2048, hop: int = 512, bands: int = 128, floor: float = -80.0) -> np.ndarray:
    """``bands x frames`` of dB below the maximum: periodic Hann, magnitudes, filters on floored bins, zero-padded tail."""
    frames = max(1, -(-len(x) // hop)) + -(-fft // hop)
    pad = np.zeros(frames * hop + fft)
    pad[: len(x)] = x
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(fft) / fft)
    mag = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(pad, fft)[::hop][:frames] * w, axis=1))
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = np.floor((fft + 1) * 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), bands + 2) / 2595) - 1) / rate).astype(int)
    bank = np.zeros((bands, mag.shape[1]))
    for b in range(bands):
        lo, mid, hi = edges[b : b + 3]
        for k in range(lo, min(hi + 1, mag.shape[1])):
            bank[b, k] = 1.0 if k == mid else (k - lo) / (mid - lo) if k < mid else (hi - k) / (hi - mid)
    m = mag @ bank.T
    return np.maximum(20 * np.log10(np.maximum(m, 1e-12) / max(m.max(), 1e-12)), floor).T


def colours(t: np.ndarray) -> np.ndarray:
    """A dark-to-bright ramp by polynomial, 256 levels."""
    i = np.floor(np.clip(t, 0, 1) * 255 + 0.5) / 255
    rgb = [0.27 - 0.4 * i + 0.6 * i**2 + 0.52 * i**3, 0.0 + 1.35 * i - 0.45 * i**2, 0.33 + 1.2 * i - 2.6 * i**2 + 1.2 * i**3]
    return (np.clip(np.stack(rgb, axis=-1), 0, 1) * 255).astype(np.uint8)


def png(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, -1)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def spectrogram(x: np.ndarray, rate: int, marks: list[int] = (), floor: float = -80.0) -> np.ndarray:
    rgb = colours((mel_db(x, rate, floor=floor)[::-1] - floor) / -floor)
    for m in marks:
        rgb[:, min(rgb.shape[1] - 1, int(m / 512 + 0.5))] = (255, 64, 64)
    return rgb


def difference(a: np.ndarray, b: np.ndarray, span: float = 24.0) -> np.ndarray:
    """Signed dB difference of two mel tables: red where ``b`` is louder, blue where it is quieter; the shorter one's width."""
    if a.shape[0] != b.shape[0]:
        raise ValueError("the band axes differ")
    n = min(a.shape[1], b.shape[1])
    d = np.clip((b[:, :n] - a[:, :n])[::-1] / span, -1, 1)
    v = (np.abs(d) * 255).astype(np.uint8)
    zero = np.zeros_like(v)
    return np.stack([np.where(d > 0, v, zero), zero, np.where(d < 0, v, zero)], axis=-1)


def differing(a: np.ndarray, b: np.ndarray, tolerance: int = 8) -> float:
    """Share of pixels in which any channel differs by more than the tolerance; 1 if the sizes differ."""
    if a.shape != b.shape:
        return 1.0
    return float((np.abs(a.astype(int) - b.astype(int)) > tolerance).any(axis=-1).mean())


def spectrogram_files(packed: DataFrame) -> DataFrame:
    """``signal_id, png`` for each signal of a packed table."""

    def kernel(f):
        import pandas as pd

        f = f.sort_values("chunk_id")
        x = np.concatenate([np.asarray(s, dtype=float) for s in f["samples"]]).reshape(-1, int(f["channels"].iloc[0])).mean(axis=1)
        return pd.DataFrame({"signal_id": [f["signal_id"].iloc[0]], "png": [png(spectrogram(x, int(f["sample_rate"].iloc[0])))]})

    return packed.groupBy("signal_id").applyInPandas(kernel, "signal_id string, png binary")
