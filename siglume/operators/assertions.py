"""Comparison of two reports and chainable assertions over one."""

from __future__ import annotations

import math

#: Tolerances of the second tier: milliseconds, loudness units, onset milliseconds, match window, cents.
TOLERANCE = {"duration": 1.0, "loudness": 0.1, "onsets": 2.0, "match": 50.0, "pitch": 5.0}


def match_times(a: list[float], b: list[float], within: float) -> list[tuple[float, float]]:
    """One-to-one, nearest pairs first, then in order."""
    near = sorted((abs(x - y), i, j) for i, x in enumerate(a) for j, y in enumerate(b) if abs(x - y) <= within)
    got, used_a, used_b = [], set(), set()
    for _, i, j in near:
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            got.append((a[i], b[j]))
    return got


def compare(a: dict, b: dict, identical: bool = False) -> dict:
    """Deltas (b - a, null where either is undefined) and the verdict: identical, tier2, or the dimensions that differ."""
    minus = lambda x, y: None if x is None or y is None else y - x
    hz = [r["pitch"]["median_f0_hz"] for r in (a, b)]
    cents = 1200 * math.log2(hz[1] / hz[0]) if None not in hz else None
    on = [r["onsets"]["times_ms"] for r in (a, b)]
    pairs = match_times(*on, TOLERANCE["match"])
    worst = max((abs(y - x) for x, y in pairs), default=0.0)
    d = {"duration_ms": minus(a["source"]["duration_ms"], b["source"]["duration_ms"]), "integrated": minus(a["loudness"]["integrated"], b["loudness"]["integrated"]), "cents": cents,
         "onsets": {"matched": len(pairs), "unmatched_a": len(on[0]) - len(pairs), "unmatched_b": len(on[1]) - len(pairs), "max_offset_ms": worst}}
    if a["timbre"] and b["timbre"]:
        d["timbre"] = math.dist(a["timbre"]["mfcc_mean"][1:], b["timbre"]["mfcc_mean"][1:])
    out = []
    if abs(d["duration_ms"]) > TOLERANCE["duration"]:
        out.append("duration")
    if (a["loudness"]["integrated"] is None) != (b["loudness"]["integrated"] is None) or abs(d["integrated"] or 0) > TOLERANCE["loudness"]:
        out.append("loudness")
    if len(on[0]) + len(on[1]) - 2 * len(pairs) or worst > TOLERANCE["onsets"]:
        out.append("onsets")
    if (hz[0] is None) != (hz[1] is None) or abs(cents or 0) > TOLERANCE["pitch"]:
        out.append("pitch")
    if (a["key"]["tonic"], a["key"]["mode"]) != (b["key"]["tonic"], b["key"]["mode"]):
        out.append("key")
    kind = "identical" if identical else "differs" if out else "tier2"
    return {"schema_version": 3, "deltas": d, "verdict": {"kind": kind, "dimensions": [] if identical else out}}


class Assert:
    """``Assert(report).duration_between(1, 3).has_chord("C").matches(other)``: each raises ``AssertionError`` or goes on."""

    def __init__(self, report: dict) -> None:
        self.report = report

    def _need(self, ok: bool, what: str) -> Assert:
        if not ok:
            raise AssertionError(what)
        return self

    def duration_between(self, low: float, high: float) -> Assert:
        s = self.report["source"]["duration_ms"] / 1000
        return self._need(low <= s <= high, f"{s:.3f} s isn't within {low}..{high}")

    def lufs_within(self, target: float, tolerance: float) -> Assert:
        v = self.report["loudness"]["integrated"]
        return self._need(v is not None and abs(v - target) <= tolerance, f"{v} LUFS isn't {target} +- {tolerance}")

    def true_peak_below(self, limit: float) -> Assert:
        v = self.report["loudness"]["true_peak"]
        return self._need(v is not None and v < limit, f"true peak {v} isn't below {limit}")

    def no_clipping(self) -> Assert:
        """No sample at full scale, and no peak between samples above it either."""
        c = self.report["clipping"]
        return self._need(c["clipped_samples"] == 0 and not c["true_peak_over_0dbtp"], "samples or peaks between them are clipped")

    def pitch_matches(self, names: list[str], cents: float = 50.0) -> Assert:
        """The melody's notes are these in order, each within ``cents`` of its pitch."""
        got = self.report["pitch"]["melody"]
        ok = [n["name"] for n in got] == list(names) and all(abs(n["cents"]) <= cents for n in got)
        return self._need(ok, f"the melody is {[n['name'] for n in got]}")

    def onset_count(self, low: int, high: int) -> Assert:
        n = self.report["onsets"]["count"]
        return self._need(low <= n <= high, f"{n} onsets aren't within {low}..{high}")

    def tempo_is(self, bpm: float, tolerance: float = 1.0) -> Assert:
        v = self.report["tempo"]["bpm"]
        return self._need(v is not None and abs(v - bpm) <= tolerance, f"tempo {v} isn't {bpm}")

    def key_is(self, tonic: str, mode: str) -> Assert:
        k = self.report["key"]
        return self._need((k["tonic"], k["mode"]) == (tonic, mode), f"key {k['tonic']} {k['mode']} isn't {tonic} {mode}")

    def clear_rhythm(self, wanted: bool = True) -> Assert:
        return self._need(self.report["rhythm"]["clear_rhythm"] == wanted, "the rhythm's clearness differs")

    def section_count(self, n: int) -> Assert:
        v = self.report["structure"]["section_count"]
        return self._need(v == n, f"{v} sections aren't {n}")

    def _chords(self) -> list[str]:
        return [c["root"] + ("" if c["quality"] == "maj" else "m" if c["quality"] == "min" else c["quality"]) for c in self.report["harmony"]["chords"]]

    def has_chord(self, name: str) -> Assert:
        return self._need(name in self._chords(), f"no chord {name} in {self._chords()}")

    def progression(self, *names: str) -> Assert:
        """The chords stand in this order, others may stand between."""
        rest = iter(self._chords())
        return self._need(all(n in rest for n in names), f"{names} isn't a subsequence of {self._chords()}")

    def matches(self, other: dict, tier: str = "tier2") -> Assert:
        v = compare(self.report, other, self.report == other)["verdict"]
        return self._need(v["kind"] in ("identical", tier), f"the reports differ in {v['dimensions']}")


def compare_text(result: dict) -> str:
    """A comparison as a few lines of text; undefined differences read ``-``."""
    num = lambda v, p, unit: "-" if v is None else f"{v:+.{p}f} {unit}"
    d, v = result["deltas"], result["verdict"]
    lines = [
        "verdict " + v["kind"] + (" (" + ", ".join(v["dimensions"]) + ")" if v["dimensions"] else ""), f"duration {num(d['duration_ms'], 1, 'ms')}", f"loudness {num(d['integrated'], 2, 'LU')}", f"pitch {num(d['cents'], 1, 'cents')}",
        f"onsets matched={d['onsets']['matched']} only_a={d['onsets']['unmatched_a']} only_b={d['onsets']['unmatched_b']} worst={d['onsets']['max_offset_ms']:.1f} ms",
    ]
    if "timbre" in d:
        lines.append(f"timbre distance={d['timbre']:.2f}")
    return "\n".join(lines) + "\n"
