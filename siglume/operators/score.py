"""Authored scores: an immutable builder, lint queries over its tables, and a JSON document form."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MAX_TICK = 1 << 32
UNITS = (1, 2, 4, 8, 16, 32)


class ScoreError(ValueError):
    pass


#: Control points of the named curves (fixed values).
CURVES = {"ease_in": (0.42, 0.0, 1.0, 1.0), "ease_out": (0.0, 0.0, 0.58, 1.0), "ease_in_out": (0.42, 0.0, 0.58, 1.0)}


def curve_points(ease: str) -> tuple[float, ...] | None:
    """``x1, y1, x2, y2`` of a curved ease; x stays within 0..1, so that the curve is a function."""
    if ease in CURVES:
        return CURVES[ease]
    m = re.fullmatch(r"bezier\(([^,()]+),([^,()]+),([^,()]+),([^,()]+)\)", ease)
    if not m:
        return None
    try:
        x1, y1, x2, y2 = map(float, m.groups())
    except ValueError:
        return None
    return (x1, y1, x2, y2) if 0 <= x1 <= 1 and 0 <= x2 <= 1 else None


def eased(u: Column, ease: Column) -> Column:
    """Progress 0..1 bent by a curved ease (anything else is linear): the curve's parameter is found by halving."""
    part = lambda k: F.regexp_extract(ease, r"^bezier\(([^,()]+),([^,()]+),([^,()]+),([^,()]+)\)$", k + 1).try_cast("double")
    p = []
    for k in range(4):
        c = part(k)
        for name, points in CURVES.items():
            c = F.when(ease == name, F.lit(points[k])).otherwise(c)
        p.append(c)
    at = lambda s, a, b: 3 * (1 - s) * (1 - s) * s * a + 3 * (1 - s) * s * s * b + s * s * s
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(b, _):
        mid = (b["lo"] + b["hi"]) / 2
        low = at(mid, p[0], p[2]) < u
        return F.struct(F.when(low, mid).otherwise(b["lo"]).alias("lo"), F.when(low, b["hi"]).otherwise(mid).alias("hi"))

    s = F.aggregate(F.sequence(F.lit(1), F.lit(50)), start, halve, lambda b: (b["lo"] + b["hi"]) / 2)
    return F.when(p[0].isNotNull(), at(s, p[1], p[3])).otherwise(u)


@dataclass(frozen=True)
class Score:
    """Rows only; every method returns a new score or raises ``ScoreError``."""

    sample_rate: int
    ppq: int = 480
    signature: tuple[int, int] = (4, 4)
    tempos: tuple[tuple[int, int], ...] = ((0, 500_000_000),)
    tracks: tuple[tuple[str, str], ...] = ()
    notes: tuple[tuple[int, int, int, int, int], ...] = ()
    automation: tuple[tuple[int, str, int, float, str], ...] = ()
    gain_db: float = 0.0
    limiter: tuple[float, float, float] | None = None
    checks: tuple[tuple[str, float, float], ...] = field(default=())
    inserts: tuple[tuple[int, str], ...] = ()
    specs: tuple[tuple[str, tuple[tuple[str, object], ...]], ...] = ()

    def __post_init__(self) -> None:
        if not 8_000 <= self.sample_rate <= 192_000:
            raise ScoreError("the sample rate isn't within 8000..192000")
        if not 24 <= self.ppq <= 15_360:
            raise ScoreError("the ticks per quarter aren't within 24..15360")

    def time_signature(self, beats: int, unit: int) -> Score:
        if not 1 <= beats <= 255 or unit not in UNITS or self.ppq * 4 % unit:
            raise ScoreError(f"{beats}/{unit} can't be used")
        return replace(self, signature=(beats, unit))

    def position(self, bar: int, beat: int = 1, offset: int = 0) -> int:
        """Tick of a 1-based bar and beat, under the signature in force now."""
        beats, unit = self.signature
        if bar < 1 or not 1 <= beat <= beats:
            raise ScoreError(f"bar {bar} beat {beat} is outside the signature")
        return (bar - 1) * beats * (self.ppq * 4 // unit) + (beat - 1) * (self.ppq * 4 // unit) + offset

    def tempo(self, tick: int, bpm: float) -> Score:
        """One tempo a tick: a later call wins."""
        if not 1 <= bpm <= 4000:
            raise ScoreError(f"{bpm} beats a minute")
        kept = {**dict(self.tempos), self._tick(tick): int(6e10 / bpm + 0.5)}
        return replace(self, tempos=tuple(sorted(kept.items())))

    def track(self, name: str, preset: str) -> Score:
        if not name or name in (n for n, _ in self.tracks):
            raise ScoreError(f"track {name!r} is there already")
        return replace(self, tracks=(*self.tracks, (name, preset)))

    def note(self, track: str, at: int, dur: int, pitch: int, vel: int = 100) -> Score:
        if dur < 1 or not 0 <= pitch <= 127 or not 1 <= vel <= 127:
            raise ScoreError("duration, pitch or velocity out of range")
        return replace(self, notes=(*self.notes, (self._index(track), self._tick(at), dur, pitch, vel)))

    def automate(self, track: str, param: str, keys: list[tuple[int, float, str]]) -> Score:
        """Replaces the parameter's keys; two at one tick are an error. Eases: linear, hold, ease_in, ease_out,
        ease_in_out, bezier(x1,y1,x2,y2)."""
        for _, _, e in keys:
            if e not in ("linear", "hold") and not curve_points(e):
                raise ScoreError(f"{e!r} is no ease")
        if len({k[0] for k in keys}) < len(keys):
            raise ScoreError("two keys at one tick")
        k = self._index(track)
        rest = tuple(a for a in self.automation if a[:2] != (k, param))
        return replace(self, automation=(*rest, *((k, param, self._tick(t), float(v), e) for t, v, e in sorted(keys))))

    def insert(self, track: str, name: str) -> Score:
        """An effect at the end of the track's chain."""
        if not name:
            raise ScoreError("an insert has no name")
        return replace(self, inserts=(*self.inserts, (self._index(track), name)))

    def spec(self, kind: str, **fields) -> Score:
        """A check with named fields, as the text form has it."""
        return replace(self, specs=(*self.specs, (kind, tuple(fields.items()))))

    def master(self, gain_db: float = 0.0, limiter: tuple[float, float, float] | None = None) -> Score:
        if not -40 <= gain_db <= 24:
            raise ScoreError("the gain isn't within -40..24")
        if limiter and not (-40 <= limiter[0] <= 0 and 0 <= limiter[1] <= 50 and 1 <= limiter[2] <= 1000):
            raise ScoreError("the limiter is out of range")
        return replace(self, gain_db=gain_db, limiter=limiter)

    def check(self, kind: str, target: float, tolerance: float = 0.0) -> Score:
        return replace(self, checks=(*self.checks, (kind, target, tolerance)))

    def end_tick(self) -> int:
        return max([0, *(at + dur for _, at, dur, _, _ in self.notes), *(a[2] for a in self.automation)])

    def _tick(self, tick: int) -> int:
        if not 0 <= tick <= MAX_TICK:
            raise ScoreError(f"tick {tick} is out of range")
        return tick

    def _index(self, track: str) -> int:
        names = [n for n, _ in self.tracks]
        if track not in names:
            raise ScoreError(f"no track {track!r}")
        return names.index(track)

    def to_json(self) -> str:
        return json.dumps({"version": 1} | {k: getattr(self, k) for k in self.__dataclass_fields__}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Score:
        """Version 1 only; unknown fields are refused."""
        doc = json.loads(text)
        if doc.pop("version", None) != 1:
            raise ScoreError("the version isn't 1")
        if odd := set(doc) - set(Score.__dataclass_fields__):
            raise ScoreError(f"unknown fields {sorted(odd)}")
        deep = lambda v: tuple(map(deep, v)) if isinstance(v, list) else v
        return Score(**{k: deep(v) for k, v in doc.items()})

    def tables(self, spark: SparkSession, score_id: str) -> dict[str, DataFrame]:
        make = lambda rows, schema: spark.createDataFrame([(score_id, *r) for r in rows], f"score_id string, {schema}")
        return {
            "tracks": make([(k, *t) for k, t in enumerate(self.tracks)], "track_idx int, name string, preset string"),
            "notes": make([(n[0], k, *n[1:]) for k, n in enumerate(self.notes)], "track_idx int, note_idx int, at long, dur long, pitch int, vel int"),
            "tempos": make(self.tempos, "tick long, npq long"),
            "automation": make(self.automation, "track_idx int, param string, at long, value double, ease string"),
        }


def fraction(ticks: int, ppq: int) -> str:
    """Ticks as a reduced fraction of a whole note."""
    g = gcd(ticks, ppq * 4) or 1
    return f"{ticks // g}/{ppq * 4 // g}"


def value_at(keys: DataFrame, at: DataFrame) -> DataFrame:
    """``track_idx, param, tick, value``: automation read at ticks; the key that an interval leaves gives its ease.
    Keys and queries are merged by a window instead of a range join."""
    from pyspark.sql import Window as W

    w = W.partitionBy("track_idx", "param").orderBy("t", "q")
    both = keys.select("track_idx", "param", F.col("at").alias("t"), "value", "ease", F.lit(0).alias("q")).unionByName(
        at.select("track_idx", "param", F.col("tick").alias("t"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("ease"), F.lit(1).alias("q"))
    )
    key = F.when(F.col("q") == 0, F.struct("t", "value", "ease"))
    both = both.withColumns({"a": F.last(key, True).over(w), "b": F.first(key, True).over(w.rowsBetween(1, W.unboundedFollowing))})
    u = (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    v = F.when(F.col("a").isNull(), F.col("b.value")).when(F.col("b").isNull() | (F.col("a.ease") == "hold"), F.col("a.value")).otherwise(F.col("a.value") + (F.col("b.value") - F.col("a.value")) * eased(u, F.col("a.ease")))
    return both.where("q = 1").select("track_idx", "param", F.col("t").alias("tick"), v.alias("value"))


def lint(tables: dict[str, DataFrame], presets: DataFrame, params: DataFrame) -> DataFrame:
    """``severity, code, message`` of all rules: unknown presets, unknown or out-of-range parameters, mono overlaps.

    ``presets(preset, polyphony)`` and ``params(preset, param, min, max)`` are catalog tables; ``custom`` is skipped.
    """
    t, n, a = tables["tracks"], tables["notes"], tables["automation"]
    row = lambda code, message: (F.lit("error").alias("severity"), F.lit(code).alias("code"), message.alias("message"))
    unknown = t.where("preset not like 'custom%'").join(presets, "preset", "left_anti").select(*row("unknown_preset", F.concat_ws(" ", "name", "preset")))
    used = a.join(t, ["score_id", "track_idx"]).where("preset not like 'custom%'")
    missing = used.join(params, ["preset", "param"], "left_anti").select(*row("unknown_param", F.concat_ws(" ", "name", "param"))).distinct()
    outside = used.join(params, ["preset", "param"]).where("value < min or value > max").select(*row("param_range", F.concat_ws(" ", "name", "param", F.col("value").cast("string"))))
    from siglume.operators.sequences import overlaps

    mono = n.join(t, ["score_id", "track_idx"]).join(presets.where("polyphony = 0").select("preset"), "preset")
    mono = mono.withColumns({"onset": F.col("at"), "note": F.col("note_idx"), "key": F.struct("score_id", "track_idx")})
    clash = overlaps(mono, "key").select(*row("mono_overlap", F.concat_ws(" ", "name", F.col("at").cast("string"))))
    return unknown.unionByName(missing).unionByName(outside).unionByName(clash)
