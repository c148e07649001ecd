"""The whole-signal report on synthesised signals with known readings."""

import numpy as np
import pytest

from siglume.operators import kernels as K
from siglume.operators.probe import digest
from siglume.sources.wav import AudioError, decode_wav, encode_wav

SR = 48_000


def sine(f, a, s):
    return (a * np.sin(2 * np.pi * f * np.arange(round(s * SR)) / SR)).astype(np.float32)


def clicks(times, total):
    x = np.zeros(round(total * SR), np.float32)
    n = np.arange(round(0.03 * SR))
    w = 0.9 * np.sin(2 * np.pi * 1000 * n / SR) * np.where(n < 0.01 * SR, 1, np.exp(-(n / SR - 0.01) / 0.005))
    for t in times:
        k = round(t * SR)
        m = min(len(w), len(x) - k)
        x[k : k + m] = w[:m]
    return x


def test_pitch_and_loudness():
    r = K.probe(sine(440, 0.5, 2), SR, 1)
    assert abs(1200 * np.log2(r["pitch"]["median_f0_hz"] / 440)) < 1
    assert K.probe(sine(997, 10 ** (-18 / 20), 5), SR, 1)["loudness"]["integrated"] == pytest.approx(-21, abs=0.1)


def test_clicks_tempo_rhythm():
    r = K.probe(clicks(np.arange(0.5, 4.5, 0.5), 4.5), SR, 1)
    assert r["onsets"]["count"] == 8
    assert all(abs(a - b) <= 6 for a, b in zip(r["onsets"]["times_ms"], np.arange(500, 4500, 500)))
    r = K.probe(clicks(np.arange(0.5, 12, 0.5), 12), SR, 1)
    assert r["tempo"]["bpm"] == pytest.approx(120, abs=1) and r["rhythm"]["clear_rhythm"]
    r = K.probe(clicks(np.arange(2 / 3, 12, 2 / 3), 12), SR, 1)
    assert r["tempo"]["bpm"] == pytest.approx(90, abs=1)


def test_key_silence_clipping_stereo():
    chord = sum(sine(f, 1, 3) for f in (261.63, 329.63, 392.0)) * 0.8 / 3
    r = K.probe(chord, SR, 1)
    assert (r["key"]["tonic"], r["key"]["mode"]) == ("C", "major") and r["harmony"]["chords"][0]["quality"] == "maj"
    r = K.probe(np.concatenate([sine(440, 0.5, 1), np.zeros(SR, np.float32)]), SR, 1)
    assert r["silence"]["trailing_ms"] == pytest.approx(1000, abs=60)
    r = K.probe(np.sign(sine(220, 1, 1)), SR, 1)
    assert r["clipping"]["clipped_samples"] > 0 and r["clipping"]["true_peak_over_0dbtp"]
    s = sine(440, 0.5, 2)
    assert K.stereo(np.stack([s, s]))["width"] == 0 and K.stereo(np.stack([s, -s]))["width"] == 1


def test_structure_and_timbre():
    ab = np.concatenate([sine(440, 0.5, 8), sine(3000, 0.5, 8)])
    assert [abs(b - 8000) <= 1500 for b in K.structure(ab, SR)["boundaries_ms"]] == [True]
    assert K.structure(sine(440, 0.5, 24), SR)["section_count"] == 1
    assert K.structure(np.zeros(0), SR)["section_count"] == 0
    a, b = (np.array(K.timbre(x.astype(float), SR)["mfcc_mean"]) for x in (sine(440, 0.5, 2), np.float32(2 * ((440 * np.arange(2 * SR) / SR) % 1) - 1) * 0.5))
    assert np.linalg.norm((a - b)[1:]) > 1


@pytest.mark.parametrize("x", [np.zeros(0), np.zeros(10), np.zeros(2 * SR)])
def test_degenerate(x):
    r = K.probe(x, SR, 1)
    assert r["loudness"]["integrated"] is None and r["onsets"]["count"] == 0 and r["tempo"]["bpm"] is None
    assert "loudness I=-inf" in digest(r)


def test_melody():
    x = np.concatenate([sine(f, 0.5, 0.5) for f in (440, 523.251, 659.255)])
    assert [n["name"] for n in K.probe(x, SR, 1)["pitch"]["melody"]] == ["A4", "C5", "E5"]


@pytest.mark.parametrize(("depth", "tol"), [("float", 0), ("24", 2**-23), ("16", 2**-15)])
def test_wav_round_trip(depth, tol):
    x = sine(440, 0.9, 0.1)
    rate, ch, y = decode_wav(encode_wav(x, SR, 1, depth))
    assert (rate, ch) == (SR, 1) and np.abs(x - y).max() <= tol


def test_wav_limits():
    raw = encode_wav(np.zeros(10, np.float32), SR, 1)
    assert len(decode_wav(raw, 10)[2]) == 10
    for bad in (lambda: decode_wav(raw, 9), lambda: decode_wav(b"RIFF"), lambda: decode_wav(encode_wav([np.nan], SR, 1)), lambda: encode_wav([0], SR, 1, "12")):
        with pytest.raises(AudioError):
            bad()
