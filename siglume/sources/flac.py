"""FLAC decoding in pure Python and numpy: bit-exact integers, divided by 2 ** (bits - 1)."""

from __future__ import annotations

import numpy as np

from siglume.sources.limits import MAX_SAMPLES, AudioError


class _Bits:
    """Big-endian bit reader over whole bytes."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at, self.held, self.n = data, at, 0, 0

    def take(self, k: int) -> int:
        while self.n < k:
            if self.at >= len(self.data):
                raise AudioError("the FLAC stream ends early")
            self.held = self.held << 8 | self.data[self.at]
            self.at += 1
            self.n += 8
        self.n -= k
        v = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return v

    def signed(self, k: int) -> int:
        v = self.take(k)
        return v - (1 << k) if k and v >> (k - 1) else v

    def unary(self) -> int:
        zeros = 0
        while self.held == 0:
            zeros += self.n
            self.n = 0
            if self.at >= len(self.data):
                raise AudioError("the FLAC stream ends early")
            self.held, self.n = self.data[self.at], 8
            self.at += 1
        lead = self.n - self.held.bit_length()
        self.n -= lead + 1
        self.held &= (1 << self.n) - 1
        return zeros + lead

    def align(self) -> None:
        self.held = self.n = 0


def _residual(b: _Bits, block: int, order: int) -> list[int]:
    width = (4, 5)[b.take(2)]
    parts = 1 << b.take(4)
    out: list[int] = []
    for p in range(parts):
        k = b.take(width)
        count = block // parts - (order if p == 0 else 0)
        if k == (1 << width) - 1:
            raw = b.take(5)
            out += [b.signed(raw) for _ in range(count)]
        else:
            for _ in range(count):
                v = b.unary() << k | b.take(k)
                out.append(v >> 1 ^ -(v & 1))
    return out


#: Coefficients of the fixed predictors of order 0 to 4.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _subframe(b: _Bits, block: int, bits: int) -> list[int]:
    if b.take(1):
        raise AudioError("a FLAC subframe isn't valid")
    kind = b.take(6)
    spare = b.unary() + 1 if b.take(1) else 0
    bits -= spare
    if kind == 0:
        out = [b.signed(bits)] * block
    elif kind == 1:
        out = [b.signed(bits) for _ in range(block)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [b.signed(bits) for _ in range(order)]
        shift, coefs = 0, FIXED[order] if kind < 32 else ()
        if kind >= 32:
            precision = b.take(4) + 1
            shift = b.signed(5)
            coefs = tuple(b.signed(precision) for _ in range(order))
        for r in _residual(b, block, order):
            out.append(r + (sum(c * out[-1 - j] for j, c in enumerate(coefs)) >> shift))
    else:
        raise AudioError("a FLAC subframe of a reserved kind")
    return [v << spare for v in out] if spare else out


def decode_flac(raw: bytes, max_samples: int = MAX_SAMPLES):
    """``(rate, channels, float32 samples)``; the length limit is checked on the header and again while decoding."""
    if raw[:4] != b"fLaC":
        raise AudioError("not a FLAC file")
    at, info = 4, None
    while True:
        kind, size = raw[at], int.from_bytes(raw[at + 1 : at + 4], "big")
        if kind & 0x7F == 0:
            info = raw[at + 4 : at + 4 + size]
        at += 4 + size
        if kind & 0x80 or at >= len(raw):
            break
    if info is None or len(info) < 18:
        raise AudioError("no stream information")
    packed = int.from_bytes(info[10:18], "big")
    rate, channels, depth, total = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
    if not rate or total * channels > max_samples:
        raise AudioError("no sample rate, or more samples than the limit")
    parts, done = [], 0
    while at < len(raw) and (not total or done < total):
        b = _Bits(raw, at)
        if b.take(14) != 0x3FFE:
            raise AudioError("no frame where one is due")
        b.take(2)
        size_code, rate_code, layout, depth_code, _ = b.take(4), b.take(4), b.take(4), b.take(3), b.take(1)
        first = b.take(8)
        for _ in range(max(0, 8 - (~first & 0xFF).bit_length() - 1)):
            b.take(8)
        if size_code == 1:
            block = 192
        elif 2 <= size_code <= 5:
            block = 576 << (size_code - 2)
        elif size_code in (6, 7):
            block = b.take(8 * (size_code - 5)) + 1
        else:
            block = 256 << (size_code - 8)
        b.take({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
        b.take(8)
        bits = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}.get(depth_code, depth)
        n = layout + 1 if layout < 8 else 2
        side = {8: 1, 9: 0, 10: 1}.get(layout, -1)  # the difference channel has one bit more
        sub = [np.array(_subframe(b, block, bits + (c == side)), dtype=np.int64) for c in range(n)]
        if layout == 8:
            sub[1] = sub[0] - sub[1]
        elif layout == 9:
            sub[0] = sub[0] + sub[1]
        elif layout == 10:
            mid = sub[0] << 1 | sub[1] & 1
            sub = [mid + sub[1] >> 1, mid - sub[1] >> 1]
        b.align()
        at = b.at + 2
        parts.append(np.stack(sub, axis=1))
        done += block
        if done * n > max_samples:
            raise AudioError(f"more than {max_samples} samples")
    x = np.concatenate(parts)[: total or None] if parts else np.zeros((0, channels), np.int64)
    return rate, channels, (x.ravel() / float(1 << (depth - 1))).astype(np.float32)
