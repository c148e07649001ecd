"""Text forms of timelines and comparisons, and a score's checks as rows."""

import pytest

from siglume.operators import assertions, probe, verify
from siglume.operators.score import Score


def _row(k, silent, rms, onsets=0, f0=None):
    return {"index": k, "start_ms": k * 1000.0, "end_ms": (k + 1) * 1000.0, "rms_db": rms, "peak_db": rms, "silent": silent, "onsets": onsets, "f0_hz": f0}


def test_timeline_text():
    rows = [_row(0, False, -10.0, 2, 440.0), *[_row(k, True, None) for k in (1, 2, 3)], _row(4, True, -70.0), _row(5, False, -9.0), _row(6, True, None), _row(7, True, None)]
    assert probe.timeline_text(rows).splitlines() == [
        "timeline rows=5", "0 rms=-10.0 peak=-10.0 onsets=2 f0=440.0", "1-4 silent (4.0 s)", "5 rms=-9.0 peak=-9.0 onsets=0 f0=-", "6 rms=- peak=- onsets=0 f0=- silent", "7 rms=- peak=- onsets=0 f0=- silent",
    ]
    merged = probe.timeline_text([_row(k, False, 0.0 - k, 1, 100.0 + k) for k in range(90)]).splitlines()
    assert len(merged) == 31 and merged[1] == "0-2 rms=0.0 peak=0.0 onsets=3 f0=101.0" and probe.timeline_text([]) == "timeline rows=0\n"


def test_compare_text():
    result = {"deltas": {"duration_ms": 2.0, "integrated": None, "cents": -3.25, "onsets": {"matched": 1, "unmatched_a": 0, "unmatched_b": 2, "max_offset_ms": 0.5}, "timbre": 1.5}, "verdict": {"kind": "differs", "dimensions": ["duration", "onsets"]}}
    assert assertions.compare_text(result).splitlines() == ["verdict differs (duration, onsets)", "duration +2.0 ms", "loudness -", "pitch -3.2 cents", "onsets matched=1 only_a=0 only_b=2 worst=0.5 ms", "timbre distance=1.50"]


def test_strict_clipping_and_melody():
    report = {"clipping": {"clipped_samples": 0, "true_peak_over_0dbtp": True}, "pitch": {"melody": [{"name": "A4", "cents": 3.0}, {"name": "C5", "cents": -60.0}]}}
    a = assertions.Assert(report)
    with pytest.raises(AssertionError):
        a.no_clipping()
    a.pitch_matches(["A4", "C5"], 60)
    for names, cents in ((["A4", "C5"], 50), (["A4"], 60), (["C5", "A4"], 60)):
        with pytest.raises(AssertionError):
            a.pitch_matches(names, cents)


def test_spec_rows():
    s = Score(48_000).tempo(0, 120).tempo(960, 60).track("lead", "sine")
    s = s.spec("IntegratedLufs", target=-16.0, tol=1.0).spec("OnsetAt", track="lead", at=(1, 4), tol_ms=5.0).spec("NoDiscontinuity", track="lead", db=20.0).spec("BrightnessRises", track="lead", **{"from": (1, 1), "to": (2, 1)}, min_ratio=1.2)
    assert verify.spec_rows(s, "m") == [
        (0, "m", "integrated_lufs", -16.0, 1.0, 0.0), (1, "m/lead", "onset_at", 2000.0, 5.0, 0.0), (2, "m/lead", "no_discontinuity", pytest.approx(0.1), 0.0, 0.0), (3, "m/lead", "brightness_rises", 0.0, 3000.0, 1.2),
    ]
