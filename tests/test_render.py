"""Stems, voice stealing, held automation, panning and the master bus."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siglume.functions import scalars as S
from siglume.operators import synth


def test_generator_vectors():
    """Fixed values of the generator: a change would change all rendered noise."""
    got = [int(synth.counter_bits(s, np.array([i]))[0]) for s, i in ((0, 0), (0, 1), (1, 0), (0xDEADBEEF, 12345))]
    assert got == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 0x910A2DEC89025CC1, 0x3EB3070E35BA25B3]


def test_generator_in_columns(spark):
    rows = spark.range(50).select("id", F.hex(S.counter_bits(F.lit(7), F.col("id"))).alias("h"), S.note_seed(F.lit(3), F.col("id")).alias("n")).collect()
    assert all(int(r.h, 16) == int(synth.counter_bits(7, np.array([r.id]))[0]) and r.n % 2**64 == synth.note_seed(3, r.id) for r in rows)


def test_voice_stealing():
    notes = [(0.0, 9.0), (1.0, 9.0), (2.0, 9.0), (9.5, 10.0)]
    assert synth.voices_until(notes, 2) == [2.0, 9.0, 9.0, 10.0]
    assert synth.voices_until(notes, 0) == [1.0, 2.0, 9.0, 10.0]
    assert synth.voices_until([], 4) == []


def test_held_blocks_and_pan():
    g = synth.held([(0.0, 0.0), (1.0, 1.0)], 1.0, 1000, 1000)
    assert (g[:64] == 0).all() and (g[64:128] == 0.064).all() and len(g) == 1000
    notes = [(0.0, 0.1, 69, 127)]
    flat = synth.stem(notes, "sine", 8_000, 2_000)
    left = synth.stem(notes, "sine", 8_000, 2_000, pan=[(0.0, -1.0)])
    assert np.allclose(flat[:, 0], flat[:, 1]) and np.allclose(left[:, 1], 0) and np.allclose(left[:, 0], flat[:, 0] * np.sqrt(2))
    assert np.allclose(synth.stem(notes, "sine", 8_000, 2_000, gain=[(0.0, 0.5)]), flat / 2)


@pytest.mark.parametrize("preset", sorted(synth.PRESETS))
def test_presets_sound(preset):
    x = synth.stem([(0.0, 0.1, 60, 100)], preset, 8_000, 8_000, wet=0.3)
    assert np.isfinite(x).all() and 0 < np.abs(x).max() < 4


def test_stems_and_mix(spark):
    notes = spark.createDataFrame([("s", "a", 0.0, 0.2, 60, 127), ("s", "b", 0.1, 0.2, 67, 127), ("s", "b", 0.1, 0.2, 72, 90), ("t", "a", 0.0, 0.1, 60, 1), ("t", "gone", 0.0, 0.1, 60, 1)], "score_id string, track string, start_s double, seconds double, midi int, vel int")
    keys = "array<struct<at:double,value:double>>"
    tracks = spark.createDataFrame([("s", "a", "sine", [(0.0, 4.0)], None, 0.0), ("s", "b", "organ", None, [(0.0, 1.0)], 0.0), ("t", "a", "noise_hat", None, None, 0.0)], f"score_id string, track string, preset string, gain {keys}, pan {keys}, wet double")
    parts = synth.stems(notes, tracks, 8_000)
    got = {r.signal_id: np.array(r.samples).reshape(-1, 2) for r in parts.collect()}
    assert set(got) == {"s/a", "s/b", "t/a"} and len(got["s/a"]) == len(got["s/b"]) and np.abs(got["s/b"][:, 0]).max() < 1e-6
    dry = {r.signal_id: np.array(r.samples).reshape(-1, 2) for r in synth.mix(parts, ceiling_db=None).collect()}
    assert np.allclose(dry["s"], got["s/a"] + got["s/b"], atol=1e-6) and np.allclose(dry["t"], got["t/a"])
    wet = {r.signal_id: np.array(r.samples) for r in synth.mix(parts, 12.0).collect()}
    assert np.abs(dry["s"]).max() * 10**0.6 > 1 and np.abs(wet["s"]).max() <= 10 ** (-1 / 20) + 1e-6
