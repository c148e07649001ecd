"""Scores, MIDI files, synthesis, images and streaming windows."""

import numpy as np
import pytest

from siglume.operators import image, kernels, score, synth
from siglume.sources import midi


def demo():
    s = score.Score(48_000).time_signature(3, 4).tempo(0, 120).tempo(960, 150).tempo(960, 140).track("lead", "sine").track("bass", "square_bass")
    return s.note("lead", 0, 480, 69).note("lead", 480, 480, 72).note("bass", 0, 600, 40).note("bass", 480, 240, 43).automate("bass", "cutoff_hz", [(0, 30.0, "linear"), (960, 900.0, "hold")])


def test_builder_and_json():
    s = demo()
    assert s.tempos[-1] == (960, 428_571_429) and s.end_tick() == 960 and s.position(2, 3, 7) == 1440 + 960 + 7
    assert score.Score.from_json(s.to_json()) == s
    assert (score.fraction(360, 480), score.fraction(480, 480)) == ("3/16", "1/4")
    for bad in (
        lambda: score.Score(1), lambda: s.track("lead", "x"), lambda: s.note("lead", 0, 0, 60), lambda: s.note("none", 0, 1, 60), lambda: s.tempo(0, 0), lambda: s.master(99),
        lambda: s.time_signature(4, 3), lambda: s.position(1, 4), lambda: s.automate("lead", "gain", [(0, 1, "hold"), (0, 2, "hold")]), lambda: score.Score.from_json('{"version": 2}'),
        lambda: score.Score.from_json(s.to_json().replace('"ppq"', '"odd"')),
    ):
        with pytest.raises(score.ScoreError):
            bad()


def test_lint_and_automation(spark):
    t = demo().track("odd", "nothing").tables(spark, "s")
    presets = spark.createDataFrame([("sine", 16), ("square_bass", 0)], "preset string, polyphony int")
    params = spark.createDataFrame([("square_bass", "cutoff_hz", 40.0, 18000.0)], "preset string, param string, min double, max double")
    assert sorted(r.code for r in score.lint(t, presets, params).collect()) == ["mono_overlap", "param_range", "unknown_preset"]
    at = spark.createDataFrame([(1, "cutoff_hz", k) for k in (0, 480, 2000)], "track_idx int, param string, tick long")
    assert [r.value for r in score.value_at(t["automation"], at).orderBy("tick").collect()] == [30.0, 465.0, 900.0]


def test_midi_round_trip_and_errors():
    tracks = [{"name": "lead", "preset": "saw_lead", "notes": [(0, 480, 60, 90), (480, 1, 64, 1)]}, {"name": "drums", "preset": "kick", "notes": [(0, 120, 33, 100)]}]
    raw = midi.write(480, [(0, 120.0), (960, 150.0)], (3, 4), tracks)
    got = midi.parse(raw)
    assert (got["ppq"], got["tempos"], got["signature"]) == (480, [(0, 500_000), (960, 400_000)], (3, 4))
    assert got["tracks"][0]["notes"] == [(0, 480, 60, 90), (480, 1, 64, 1)]
    assert [r[1:] for r in midi.note_rows("f", raw)] == [("lead", "saw_lead", 0, 480, 60, 90), ("lead", "saw_lead", 480, 1, 64, 1), ("drums", "kick", 0, 120, 33, 100)]
    for k in range(len(raw) - 1):
        try:
            midi.parse(raw[:k])
        except midi.MidiError:
            pass
    for k in range(len(raw)):
        try:
            midi.parse(raw[:k] + bytes([raw[k] ^ 0x55]) + raw[k + 1 :])
        except midi.MidiError:
            pass


@pytest.mark.parametrize("preset", sorted(synth.PRESETS))
def test_voices(preset):
    v = synth.voice(preset, 57, 100, 0.4, 24_000)
    assert np.isfinite(v).all() and 0 < np.abs(v).max() < 2 and np.abs(v[-10:]).max() < 0.05


def test_render_and_limit(spark):
    x = synth.render_notes([("sine", 0.0, 1.0, 69, 127)], 48_000)
    assert kernels.pitch(kernels.f0_track(x, 48_000))["median_f0_hz"] == pytest.approx(440, rel=1e-3)
    assert np.abs(synth.limit(x * 10, 48_000)).max() <= 10 ** (-1 / 20) + 1e-9
    assert len(synth.reverb(x, 48_000)) == len(x) + 120_000
    notes = spark.createDataFrame([("s", "marimba", 0.0, 0.3, 60, 90)], "score_id string, preset string, start_s double, seconds double, midi int, vel int")
    assert synth.render(notes, 8_000).count() == 1


def test_images():
    x = np.sin(2 * np.pi * 1000 * np.arange(24_000) / 48_000)
    rgb = image.spectrogram(x, 48_000, marks=[4800])
    raw = image.png(rgb)
    assert raw[:8] == b"\x89PNG\r\n\x1a\n" and rgb.shape[0] == 128
    assert image.differing(rgb, rgb) == 0 and image.differing(rgb, 255 - rgb) > 0.5 and image.differing(rgb, rgb[:, :3]) == 1
    m = image.mel_db(x, 48_000)
    assert not image.difference(m, m).any()
    with pytest.raises(ValueError):
        image.difference(m, m[:5])


def test_streams(spark, sf_dir, tmp_path):
    from siglume.streaming import windows

    src = spark.read.parquet(f"{sf_dir}/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    for name, df in (("seg", windows.segment_stream(stream, "user_id", "value", "1 day")), ("ses", windows.session_stream(stream, "user_id", "6 hours"))):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        got = spark.table(name)
        assert 0 < got.agg({"n": "sum"}).first()[0] <= src.count()
