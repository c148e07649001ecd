"""The text form of scores: round trips, refusals, eases."""

import pytest

from siglume.operators.score import Score, ScoreError, curve_points, value_at
from siglume.sources import score_text

TEXT = """
// a small score
Score(version: 1, sample_rate: 48_000, ppq: 480, time_signature: (3, 4),
  tempo: [(tick: 0, bpm: 110.5), Tempo(tick: 960, bpm: 90)],
  tracks: [
    Track(name: "lead", instrument: Preset("sine"), inserts: [Preset("reverb")],
      notes: [Note(at: (1, 1), dur: "1/4.", pitch: "Bb3", vel: 100), (at: (2, 3), off: "1/8t", dur: 77, pitch: "c#4", vel: 1)],
      automation: [Auto(param: "gain", keys: [Key(at: (1, 1), value: 0.5), (at: (2, 1), value: 1.0, ease: EaseIn), (at: (3, 1), off: 5, value: 0.0, ease: Bezier(0.1, 0.2, 0.3, 1.4))])]),
    Track(name: "own", instrument: Custom("mine")),
  ],
  master: Some(Master(gain_db: -3.0, limiter: Some((ceiling_db: -1.0)))),
  verify: [IntegratedLufs(target: -16.0, tol: 1.0), OnsetAt(track: "lead", at: (1, 2), tol_ms: 5.0), Monotone(track: "lead", param: "gain", from: (1, 1), to: (2, 1), direction: Rising), TempoIs(bpm: 110.5, tol_bpm: 1.0)],
)
"""


def test_round_trip():
    s = score_text.loads(TEXT)
    assert s.signature == (3, 4) and s.tracks == (("lead", "sine"), ("own", "custom:mine")) and s.inserts == ((0, "reverb"),)
    assert s.notes == ((0, 0, 720, 58, 100), (0, 1440 + 960 + 160, 77, 61, 1)) and s.limiter == (-1.0, 5.0, 50.0)
    assert [a[4] for a in s.automation] == ["linear", "ease_in", "bezier(0.1,0.2,0.3,1.4)"] and s.automation[2][2] == 2885
    assert [k for k, _ in s.specs] == ["IntegratedLufs", "OnsetAt", "Monotone", "TempoIs"]
    text = score_text.dumps(s)
    assert score_text.loads(text) == s and score_text.dumps(score_text.loads(text)) == text
    assert 'dur: "3/8"' in text and 'off: "1/12"' in text and "direction: Rising" in text
    assert Score.from_json(s.to_json()) == s


@pytest.mark.parametrize("old, new", [
    ("version: 1,", "version: 2,"), ("ppq: 480", "ppq: 480, colour: 3"), ("vel: 100", "vel: 100, loud: true"), ("vel: 100", "vel: 0"), ('"Bb3"', '"H3"'), ('"1/4."', '"1/0"'), ('"1/4."', '"1/7"'), ("(2, 3)", "(2, 4)"),
    ('Preset("sine")', '"sine"'), ("EaseIn", "Spring"), ("Bezier(0.1", "Bezier(1.1"), ("TempoIs", "TempoWas"), ("bpm: 90", "bpm: 0"), ('name: "own"', 'name: "lead"'), ("tol: 1.0", "tolerance: 1.0"), ("(3, 1), off: 5", "(2, 1)"), ("ppq: 480, ", ""), ("tracks: [", "tracks: {"),
])
def test_refusals(old, new):
    assert old in TEXT
    with pytest.raises(ScoreError):
        score_text.loads(TEXT.replace(old, new, 1))


def test_eases(spark):
    keys = spark.createDataFrame([(k, "gain", t, v, e) for k, e in enumerate(("linear", "hold", "ease_in", "ease_in_out", "bezier(0.1,0.2,0.3,1.4)")) for t, v in ((0, 1.0), (100, 3.0))], "track_idx int, param string, at long, value double, ease string")
    at = spark.createDataFrame([(k, "gain", t) for k in range(5) for t in (-5, 0, 25, 50, 100, 130)], "track_idx int, param string, tick long")
    got = {(r.track_idx, r.tick): r.value for r in value_at(keys, at).collect()}

    def plain(ease, u):
        x1, y1, x2, y2 = curve_points(ease)
        f = lambda s, a, b: 3 * (1 - s) ** 2 * s * a + 3 * (1 - s) * s * s * b + s**3
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid, x1, x2) < u else (lo, mid)
        return 1 + 2 * f(lo, y1, y2)

    assert got[0, 25] == 1.5 and got[1, 50] == 1.0 and all(got[k, -5] == 1.0 and got[k, 130] == 3.0 for k in range(5))
    for k, e in ((2, "ease_in"), (3, "ease_in_out"), (4, "bezier(0.1,0.2,0.3,1.4)")):
        for t in (25, 50):
            assert got[k, t] == pytest.approx(plain(e, t / 100), abs=1e-9)
    assert got[3, 50] == pytest.approx(2.0)
