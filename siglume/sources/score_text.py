"""The text form of authored scores, version 1: read into the builder and written canonically from it.

Unknown fields, other versions and anything the builder refuses raise ``ScoreError``. Positions are a bar and a beat with an
optional rest, durations are ticks or fractions of a whole note; written fractions are reduced.
"""

from __future__ import annotations

import re
from fractions import Fraction

from siglume.operators.score import Score, ScoreError, fraction
from siglume.sources import ron

#: Fields of each part: those that must stand, and those that may (with what they are when absent).
FIELDS = {
    "Score": (("version", "sample_rate", "ppq", "tempo", "tracks"), {"time_signature": [4, 4], "master": None, "verify": []}),
    "Tempo": (("tick", "bpm"), {}),
    "Track": (("name", "instrument"), {"inserts": [], "notes": [], "automation": []}),
    "Note": (("at", "dur", "pitch", "vel"), {"off": None}),
    "Auto": (("param", "keys"), {}),
    "Key": (("at", "value"), {"off": None, "ease": "Linear"}),
    "Master": ((), {"gain_db": 0.0, "limiter": None}),
    "Limiter": (("ceiling_db",), {"lookahead_ms": 5.0, "release_ms": 50.0}),
    "IntegratedLufs": (("target", "tol"), {}),
    "TruePeakBelow": (("dbtp",), {}),
    "LraBelow": (("lu",), {}),
    "OnsetAt": (("track", "at", "tol_ms"), {}),
    "PitchMatchesScore": (("track", "tol_cents"), {}),
    "Monotone": (("track", "param", "from", "to", "direction"), {}),
    "NoDiscontinuity": (("track", "db"), {}),
    "SilentAfter": (("at",), {}),
    "TempoIs": (("bpm", "tol_bpm"), {"min_bpm": None, "max_bpm": None}),
    "HasClearRhythm": (("expected",), {}),
    "GridAlignmentAtLeast": (("min",), {}),
    "BrightnessRises": (("track", "from", "to", "min_ratio"), {}),
    "BrightnessFalls": (("track", "from", "to", "min_ratio"), {}),
    "StereoWidthWithin": (("min", "max"), {}),
    "SectionCount": (("min", "max"), {}),
}
CHECKS = tuple(FIELDS)[8:]
STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
EASES = {"Linear": "linear", "Hold": "hold", "EaseIn": "ease_in", "EaseOut": "ease_out", "EaseInOut": "ease_in_out"}


def _fields(doc, kind: str) -> dict:
    must, may = FIELDS[kind]
    if not isinstance(doc, dict) or doc.get("$", kind) != kind:
        raise ScoreError(f"a {kind} is due, not {doc!r}")
    got = {k: v for k, v in doc.items() if k != "$"}
    if odd := sorted(set(got) - {*must, *may}):
        raise ScoreError(f"unknown fields {odd} in {kind}")
    if gone := sorted(set(must) - set(got)):
        raise ScoreError(f"fields {gone} of {kind} are missing")
    return may | got


def ticks_of(value, ppq: int) -> int:
    """Ticks of a duration: a number of them, or ``n/d`` of a whole note, dotted or as a triplet."""
    if isinstance(value, int) and not isinstance(value, bool):
        return value
    m = re.fullmatch(r"([0-9]+)/([0-9]+)([.t]?)", str(value))
    if not m or int(m[2]) == 0:
        raise ScoreError(f"{value!r} is no duration")
    whole = Fraction(int(m[1]), int(m[2])) * {"": 1, ".": Fraction(3, 2), "t": Fraction(2, 3)}[m[3]] * ppq * 4
    if whole.denominator != 1:
        raise ScoreError(f"{value!r} isn't on the grid of {ppq} ticks")
    return int(whole)


def pitch_of(text: str) -> int:
    m = re.fullmatch(r"([A-Ga-g])([#b]?)(-?[0-9]+)", str(text))
    midi = STEPS[m[1].upper()] + {"#": 1, "b": -1, "": 0}[m[2]] + 12 * (int(m[3]) + 1) if m else -1
    if not 0 <= midi <= 127:
        raise ScoreError(f"{text!r} is no pitch")
    return midi


def _two(value) -> tuple[int, int]:
    if not isinstance(value, list) or len(value) != 2:
        raise ScoreError(f"a pair is due, not {value!r}")
    return value[0], value[1]


def _ease(value) -> str:
    if isinstance(value, dict) and value.get("$") == "Bezier" and len(value.get("values", ())) == 4:
        return "bezier({})".format(",".join(repr(float(v)) for v in value["values"]))
    if isinstance(value, str) and value in EASES:
        return EASES[value]
    raise ScoreError(f"{value!r} is no ease")


def loads(text: str) -> Score:
    try:
        doc = _fields(ron.loads(text), "Score")
    except ron.RonError as e:
        raise ScoreError(str(e)) from e
    if doc["version"] != 1:
        raise ScoreError(f"version {doc['version']!r} isn't 1")
    s = Score(doc["sample_rate"], doc["ppq"]).time_signature(*_two(doc["time_signature"]))
    at = lambda d: s.position(*_two(d["at"])) + (0 if d["off"] is None else ticks_of(d["off"], s.ppq))
    for t in doc["tempo"]:
        t = _fields(t, "Tempo")
        s = s.tempo(t["tick"], t["bpm"])
    for t in doc["tracks"]:
        t = _fields(t, "Track")
        who = t["instrument"]
        if not isinstance(who, dict) or who.get("$") not in ("Preset", "Custom"):
            raise ScoreError(f"{who!r} is no instrument")
        s = s.track(t["name"], who["values"][0] if who["$"] == "Preset" else "custom:" + who["values"][0])
        for x in t["inserts"]:
            s = s.insert(t["name"], x["values"][0])
        for n in t["notes"]:
            n = _fields(n, "Note")
            s = s.note(t["name"], at(n), ticks_of(n["dur"], s.ppq), pitch_of(n["pitch"]), n["vel"])
        for a in t["automation"]:
            a = _fields(a, "Auto")
            keys = [_fields(k, "Key") for k in a["keys"]]
            s = s.automate(t["name"], a["param"], [(at(k), k["value"], _ease(k["ease"])) for k in keys])
    if doc["master"] is not None:
        m = _fields(doc["master"], "Master")
        limit = m["limiter"] and _fields(m["limiter"], "Limiter")
        s = s.master(m["gain_db"], limit and (limit["ceiling_db"], limit["lookahead_ms"], limit["release_ms"]))
    for c in doc["verify"]:
        kind = c.get("$") if isinstance(c, dict) else None
        if kind not in CHECKS:
            raise ScoreError(f"{kind!r} is no check")
        s = s.spec(kind, **{k: tuple(v) if isinstance(v, list) else v for k, v in _fields(c, kind).items() if v is not None})
    return s


def dumps(s: Score) -> str:
    """The canonical text: ``loads`` gives the same score again."""

    def place(tick: int) -> dict:
        beats, unit = s.signature
        per_beat = s.ppq * 4 // unit
        bar, rest = divmod(tick, per_beat * beats)
        beat, off = divmod(rest, per_beat)
        return {"at": (bar + 1, beat + 1)} | ({"off": fraction(off, s.ppq)} if off else {})

    def ease(e: str) -> dict:
        if e == "linear":
            return {}
        if e.startswith("bezier("):
            return {"ease": {"$": "Bezier", "values": [float(v) for v in e[7:-1].split(",")]}}
        return {"ease": ron.Name({v: k for k, v in EASES.items()}[e])}

    tracks = []
    for k, (name, preset) in enumerate(s.tracks):
        own = preset.startswith("custom:")
        t = {"$": "Track", "name": name, "instrument": {"$": "Custom" if own else "Preset", "values": [preset[7:] if own else preset]}}
        if inserts := [{"$": "Preset", "values": [x]} for i, x in s.inserts if i == k]:
            t["inserts"] = inserts
        if notes := [n for n in s.notes if n[0] == k]:
            t["notes"] = [{"$": "Note"} | place(n[1]) | {"dur": fraction(n[2], s.ppq), "pitch": f"{NAMES[n[3] % 12]}{n[3] // 12 - 1}", "vel": n[4]} for n in notes]
        params = dict.fromkeys(a[1] for a in s.automation if a[0] == k)
        if params:
            t["automation"] = [{"$": "Auto", "param": p, "keys": [{"$": "Key"} | place(a[2]) | {"value": a[3]} | ease(a[4]) for a in s.automation if a[:2] == (k, p)]} for p in params]
        tracks.append(t)
    doc = {"$": "Score", "version": 1, "sample_rate": s.sample_rate, "ppq": s.ppq, "time_signature": tuple(s.signature), "tempo": [{"$": "Tempo", "tick": t, "bpm": 6e10 / npq} for t, npq in s.tempos], "tracks": tracks}
    if s.gain_db or s.limiter:
        doc["master"] = {"$": "Master", "gain_db": float(s.gain_db)}
        if s.limiter:
            doc["master"]["limiter"] = {"$": "Limiter"} | dict(zip(("ceiling_db", "lookahead_ms", "release_ms"), map(float, s.limiter)))
    if s.specs:
        doc["verify"] = [{"$": kind} | {k: ron.Name(v) if k == "direction" else v for k, v in fields} for kind, fields in s.specs]
    return ron.dumps(doc)
