"""Vectorised tokenising of Arrow string columns: words, lines and 64-bit hashes of both, in bounded blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that one block holds at most, unless a single text is longer.
BLOCK = 1 << 20
_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15)
INVERSE = _U(pow(int(BASE), -1, 1 << 64))
SHINGLE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=_U)


def _white_table() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


WHITE, LOWER = _white_table(), _lower_table()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(raw: np.ndarray, offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of runs of whole texts."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Powers:
    """Powers of the hash base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=_U)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, BLOCK + 1)
            for name, base in (("up", BASE), ("down", INVERSE)):
                p = np.full(n, base, dtype=_U)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))


def prefix(raw: np.ndarray, powers: Powers) -> np.ndarray:
    powers.upto(len(raw) + 1)
    out = np.zeros(len(raw) + 1, dtype=_U)
    np.cumsum((raw.astype(_U) + _U(1)) * powers.up[: len(raw)], out=out[1:])
    return out


def span_hash(cum: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of each byte span, the same for equal bytes wherever they stand."""
    return mix((cum[ends] - cum[starts]) * powers.down[starts] + (ends - starts).astype(_U) * SHINGLE[5])


def runs(flag: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text index of the maximal runs of ``flag``, none of which crosses texts."""
    n = len(flag)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = flag[:-1]
    starts = np.flatnonzero(flag & (~before | edge[:-1]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = flag[1:]
    ends = np.flatnonzero(flag & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def window_hash(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words in one text, and the index of its first word."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
    h = np.zeros(m, dtype=_U)
    for k in range(n):
        h += words[k : k + m] * SHINGLE[k]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mix(h[at]), at


def per_text(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flag) + 1, dtype=np.int64)
    np.cumsum(flag, out=c[1:])
    return c[offsets[1:]] - c[offsets[:-1]]
