import random

import numpy as np
import pytest

from siglume.operators import kernels
from siglume.operators.assertions import Assert, compare
from siglume.sources import flac, ron
from siglume.sources.wav import AudioError, decode, encode_wav

SR = 48_000


def sine(f, a, s):
    return (a * np.sin(2 * np.pi * f * np.arange(round(s * SR)) / SR)).astype(np.float32)


class Bits:
    def __init__(self):
        self.s = []

    def put(self, v, k):
        self.s += [v >> (k - 1 - i) & 1 for i in range(k)]

    def done(self):
        self.s += [0] * (-len(self.s) % 8)
        return bytes(int("".join(map(str, self.s[i : i + 8])), 2) for i in range(0, len(self.s), 8))


def encode_flac(x, bits, layout):
    """One frame of ``x`` (frames x channels): verbatim, fixed order 2 with Rice codes, or LPC; checksums are zero."""
    n, ch = x.shape
    head = Bits()
    for v, k in ((n, 16), (n, 16), (0, 24), (0, 24), (SR, 20), (ch - 1, 3), (bits - 1, 5), (n, 36)):
        head.put(v, k)
    b = Bits()
    for v, k in ((0x3FFE, 14), (0, 2), (7, 4), (0, 4), (layout, 4), (0, 3), (0, 1), (0, 8), (n - 1, 16), (0, 8)):
        b.put(v, k)
    left, right = x[:, 0], x[:, -1]
    chans = {8: (left, left - right), 9: (left - right, right), 10: ((left + right) >> 1, left - right)}.get(layout, tuple(x.T))
    for c, v in enumerate(chans):
        w = bits + (layout == 8 and c == 1 or layout == 9 and c == 0 or layout == 10 and c == 1)
        lpc = c == 1
        b.put(0, 1)
        b.put(33 if lpc else 10, 6)
        b.put(0, 1)
        for k in range(2):
            b.put(int(v[k]) & (1 << w) - 1, w)
        if lpc:
            for q, k in ((7, 4), (3, 5), (15, 8), (-7 & 255, 8)):
                b.put(q, k)
        b.put(0, 2)
        b.put(0, 4)
        b.put(4, 4)
        for k in range(2, n):
            p = (15 * int(v[k - 1]) - 7 * int(v[k - 2])) >> 3 if lpc else 2 * int(v[k - 1]) - int(v[k - 2])
            r = int(v[k]) - p
            u = r << 1 if r >= 0 else (-r << 1) - 1
            b.s += [0] * (u >> 4) + [1]
            b.put(u & 15, 4)
    return b"fLaC\x80\0\0\x22" + (head.done() + bytes(16))[:34] + b.done() + b"\0\0"


@pytest.mark.parametrize("layout", [0, 1, 8, 9, 10])
def test_flac(layout):
    r = random.Random(layout)
    x = np.cumsum([[r.randint(-9, 9) for _ in range(1 if layout == 0 else 2)] for _ in range(300)], axis=0)
    rate, ch, y = decode(encode_flac(x, 16, layout))
    assert (rate, ch) == (SR, x.shape[1])
    assert (np.round(y.reshape(x.shape) * 32768).astype(int) == x).all()
    with pytest.raises(AudioError):
        flac.decode_flac(encode_flac(x, 16, layout), 10)


def test_containers():
    for raw in (b"OggS....", b"ID3.....", b"\xff\xfb..", b"nothing"):
        with pytest.raises(AudioError):
            decode(raw)
    assert len(decode(encode_wav(np.zeros(4), SR, 2))[2]) == 4


def test_ron():
    text = '// a score\n(version: 1, name: "a\\"b", notes: [(at: (1, 2), dur: "1/8."), Rest(3)], gain: Some(-1.5), limiter: None, ease: Linear, on: true, m: {"k": 1_000})'
    got = ron.loads(text)
    assert got == {"version": 1, "name": 'a"b', "notes": [{"at": [1, 2], "dur": "1/8."}, {"$": "Rest", "values": [3]}], "gain": -1.5, "limiter": None, "ease": "Linear", "on": True, "m": {"k": 1000}}
    plain = {"a": [1, 2.5, None, "x\ny"], "b": {"$": "Name", "c": False}}
    assert ron.loads(ron.dumps(plain)) == plain
    for bad in ("(a: 1", "(a: 1, a: 2)", "[1 2]", "1 2", "(a 1)", "@"):
        with pytest.raises(ron.RonError):
            ron.loads(bad)


def test_compare_and_assert():
    a = kernels.probe(sine(440, 0.5, 2), SR, 1)
    louder, sharper = kernels.probe(sine(440, 0.6, 2), SR, 1), kernels.probe(sine(440 * 2 ** (20 / 1200), 0.5, 2), SR, 1)
    assert compare(a, a, True)["verdict"]["kind"] == "identical" and compare(a, a)["verdict"]["kind"] == "tier2"
    assert compare(a, louder)["verdict"]["dimensions"] == ["loudness"]
    got = compare(a, sharper)
    assert "pitch" in got["verdict"]["dimensions"] and got["deltas"]["cents"] == pytest.approx(20, abs=1)
    Assert(a).duration_between(1.9, 2.1).no_clipping().true_peak_below(0).section_count(1).matches(a)
    chord = sum(sine(f, 1, 3) for f in (261.63, 329.63, 392.0)) * 0.8 / 3
    Assert(kernels.probe(chord, SR, 1)).key_is("C", "major").has_chord("C").progression("C")
    for bad in (lambda: Assert(a).tempo_is(120), lambda: Assert(a).matches(louder), lambda: Assert(a).has_chord("Zm"), lambda: Assert(a).lufs_within(0, 1)):
        with pytest.raises(AssertionError):
            bad()
