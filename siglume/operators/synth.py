"""Voices, effects and rendering of note tables to packed PCM; levels and shapes follow public definitions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from siglume.functions.scalars import GOLDEN, MIX_A, MIX_B, NOTE_STREAM
from siglume.sources.wav import PACKED

MAX_SECONDS = 3600
BLOCK = 64
#: Preset: release seconds, ADSR, gain, oscillator, polyphony (0 is mono).
PRESETS = {
    "sine": (0.15, (0.005, 0.05, 0.85, 0.15), 0.30, "sine", 16), "saw_lead": (0.25, (0.01, 0.12, 0.7, 0.25), 0.25, "saw", 8),
    "square_bass": (0.12, (0.005, 0.08, 0.8, 0.12), 0.25, "square", 0), "kick": (0.25, (0.001, 0.2, 0.0, 0.05), 0.9, "kick", 0),
    "snare": (0.3, (0.001, 0.15, 0.0, 0.1), 0.5, "snare", 4), "chord_pad": (0.8, (0.25, 0.3, 0.8, 0.8), 0.15, "pad", 16),
    "noise_hat": (0.15, (0.001, 0.06, 0.0, 0.05), 0.3, "hat", 8), "pluck": (1.2, (0.001, 0.01, 1.0, 1.2), 0.4, "pluck", 16),
    "fm_bell": (0.6, (0.002, 0.6, 0.2, 0.6), 0.25, "fm", 12), "marimba": (1.5, (0.001, 0.5, 0.0, 0.4), 0.35, "marimba", 12),
    "organ": (0.12, (0.01, 0.02, 1.0, 0.12), 0.12, "organ", 16),
}


def noise(seed: int, n: int) -> np.ndarray:
    """Counter-based white noise in -1..1: each sample depends on the seed and its index alone (see ``scalars.counter_bits``)."""
    return (counter_bits(seed, np.arange(n, dtype=np.uint64)) >> np.uint64(40)).astype(float) / (1 << 23) - 1


def counter_bits(seed: int, index: np.ndarray) -> np.ndarray:
    step = np.uint64(GOLDEN)
    with np.errstate(over="ignore"):
        z = (np.uint64(seed) ^ (index.astype(np.uint64) * step)) + step
        for shift, by in ((30, MIX_A), (27, MIX_B)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    return z ^ (z >> np.uint64(31))


def note_seed(track: int, note: int) -> int:
    """The noise stream of a note, by its track's and its own place in the schedule."""
    first = counter_bits(NOTE_STREAM ^ track, np.array([note]))[0]
    return int(counter_bits(int(first), np.array([0]))[0])


def envelope(t: np.ndarray, gate: float, adsr) -> np.ndarray:
    a, d, s, r = adsr
    held = lambda x: np.where(x < a, x / a, np.where(x < a + d, 1 - (1 - s) * (x - a) / d, s))
    return np.where(t < gate, held(t), held(np.array(gate)) * np.maximum(1 - (t - gate) / r, 0))


def one_pole(x: np.ndarray, hz: float, rate: int) -> np.ndarray:
    """Low-pass of one pole, applied through the spectrum."""
    n = 1 << max(1, (2 * len(x) - 1).bit_length())
    a = np.exp(-2 * np.pi * min(hz, rate / 2.1) / rate)
    w = np.exp(-2j * np.pi * np.fft.rfftfreq(n))
    return np.fft.irfft(np.fft.rfft(x, n) * (1 - a) / (1 - a * w), n)[: len(x)]


def voice(preset: str, midi: int, vel: int, seconds: float, rate: int, seed: int = 1) -> np.ndarray:
    release, adsr, gain, kind, _ = PRESETS[preset]
    n = int(np.ceil((seconds + release) * rate))
    t, f = np.arange(n) / rate, 440 * 2 ** ((midi - 69) / 12)
    sin = lambda h: np.sin(2 * np.pi * h * t)
    saw = lambda h: sum(np.sin(2 * np.pi * h * k * t) / k for k in range(1, max(2, int(rate / 2.5 / h)))) * 2 / np.pi if h < rate / 5 else sin(h)
    if kind == "saw":
        x = one_pole(saw(f), 2400, rate)
    elif kind == "square":
        x = one_pole(sum(np.sin(2 * np.pi * f * k * t) / k for k in range(1, max(2, int(rate / 2.5 / f)), 2)) * 4 / np.pi, 900, rate)
    elif kind == "kick":
        x = np.sin(2 * np.pi * np.cumsum(f * (1 + 2.2 / (1 + t / 0.012))) / rate)
    elif kind == "snare":
        hiss = noise(seed, n)
        x = 0.5 * (sin(f) + sin(1.6 * f)) + hiss - one_pole(hiss, 2200, rate)
    elif kind == "pad":
        x = one_pole(0.5 * (saw(f * 2 ** (4 / 1200)) + saw(f * 2 ** (-4 / 1200))), 1200, rate)
    elif kind == "hat":
        hiss = noise(seed, n)
        x = hiss - one_pole(hiss, 7000, rate)
    elif kind == "pluck":
        period = max(2, int(round(rate / f)))
        loop, x = noise(seed, period), np.empty(n)
        keep = 10 ** (-3 * period / rate / 1.1)
        for k in range(0, n, period):
            x[k : k + period] = loop[: min(period, n - k)]
            loop = keep * 0.5 * (loop + np.roll(loop, 1))
    elif kind == "fm":
        x = np.sin(2 * np.pi * f * t + 3 * np.exp(-t / 0.6) * sin(3.5 * f))
    elif kind == "marimba":
        x = sum(w * sin(f * h) * np.exp(-t * h / 0.6) for h, w in ((1, 1.0), (4, 0.3), (8, 0.1)) if f * h < rate / 2)
    elif kind == "organ":
        x = sum(sin(f * h) / h**0.5 for h in (1, 2, 3, 4, 6, 8) if f * h < rate / 2)
    else:
        x = sin(f)
    return x * envelope(t, seconds, adsr) * gain * (vel / 127) ** 2


def reverb(x: np.ndarray, rate: int, feedback: float = 0.84, wet: float = 0.3) -> np.ndarray:
    """Eight feedback combs, then four all-passes; combs run a delay line's length at a time."""
    tail = np.concatenate([x, np.zeros(int(2.5 * rate))])
    mixed = np.zeros(len(tail))
    for d in (1116, 1188, 1277, 1356, 1422, 1491, 1557, 1617):
        d = max(1, d * rate // 44_100)
        y = tail.copy()
        for k in range(d, len(y), d):
            y[k : k + d] += feedback * y[k - d : k - d + len(y[k : k + d])]
        mixed += y / 8
    for d in (556, 441, 341, 225):
        d = max(1, d * rate // 44_100)
        y = np.zeros(len(mixed))
        for k in range(0, len(y), d):
            m = len(y[k : k + d])
            past_y, past_x = (y[k - d : k - d + m], mixed[k - d : k - d + m]) if k else (np.zeros(m), np.zeros(m))
            y[k : k + d] = -0.5 * mixed[k : k + d] + past_x + 0.5 * past_y
        mixed = y
    return (1 - wet) * tail + wet * mixed * 0.2


def limit(x: np.ndarray, rate: int, ceiling_db: float = -1.0, lookahead_ms: float = 5.0, release_ms: float = 50.0) -> np.ndarray:
    """Brick-wall limiter: forward peak maximum, gain recovering exponentially."""
    ceiling, ahead = 10 ** (ceiling_db / 20), int(lookahead_ms * rate / 1000) + 1
    peak = np.abs(np.pad(x, (0, ahead - 1)))
    step = 1
    while step * 2 <= ahead:
        peak = np.maximum(peak[:-step], peak[step:])
        step *= 2
    if step < ahead:
        peak = np.maximum(peak[: len(peak) - (ahead - step)], peak[ahead - step :])
    keep, g, out = np.exp(-1 / (release_ms / 1000 * rate)), 1.0, np.empty(len(x))
    need = np.minimum(1.0, ceiling / np.maximum(peak, 1e-12)).tolist()
    for k, v in enumerate(need):
        g = min(1 - (1 - g) * keep, v)
        out[k] = g
    return x * out


def render_notes(notes: list[tuple[str, float, float, int, int]], rate: int) -> np.ndarray:
    """Sum of the voices of ``(preset, start_s, seconds, midi, vel)``; a mono preset's note ends where its next begins."""
    notes = sorted(notes, key=lambda n: n[1])
    total = max((n[1] + n[2] + PRESETS[n[0]][0] for n in notes), default=0.0)
    if total > MAX_SECONDS:
        raise ValueError(f"{total:.0f} s are more than {MAX_SECONDS}")
    out = np.zeros(int(np.ceil(total * rate)) + 1)
    for k, (preset, start, seconds, midi, vel) in enumerate(notes):
        if PRESETS[preset][4] == 0:
            later = next((n[1] for n in notes[k + 1 :] if n[0] == preset and n[1] > start), None)
            seconds = seconds if later is None else min(seconds, later - start)
        v, a = voice(preset, midi, vel, seconds, rate, seed=k + 1), int(round(start * rate))
        out[a : a + len(v)] += v[: len(out) - a]
    return out


def voices_until(notes: list[tuple[float, float]], most: int) -> list[float]:
    """Ends of the voices of ``(start, end)`` in order of start: where ``most`` sound already (0 and 1: one), a new note takes the
    voice that began first, which ends there."""
    sounding: list[int] = []
    ends = [e for _, e in notes]
    for k, (start, _) in enumerate(notes):
        sounding = [j for j in sounding if ends[j] > start]
        while len(sounding) >= max(most, 1):
            ends[sounding.pop(0)] = start
        sounding.append(k)
    return ends


def held(keys: list[tuple[float, float]], default: float, n: int, rate: int) -> np.ndarray:
    """A parameter per sample, read at the start of each block of ``BLOCK`` samples and held: straight lines between keys
    ``(seconds, value)``, the end values beyond."""
    at = np.arange(-(-n // BLOCK)) * BLOCK / rate
    v = np.interp(at, *zip(*sorted(keys))) if keys else np.full(len(at), default)
    return np.repeat(v, BLOCK)[:n]


def stem(notes: list[tuple[float, float, int, int]], preset: str, rate: int, n: int, track: int = 0, gain: list = (), pan: list = (), wet: float = 0.0) -> np.ndarray:
    """Stereo samples ``(n, 2)`` of one track's ``(start_s, seconds, midi, vel)``: voices with stealing, each with a noise stream of
    its own, an optional reverb, then gain and constant-power pan held block by block."""
    release, _, _, _, most = PRESETS[preset]
    order = sorted(range(len(notes)), key=lambda k: (notes[k][0], k))
    ends = voices_until([(notes[k][0], notes[k][0] + notes[k][1] + release) for k in order], most)
    x = np.zeros(n)
    for k, end in zip(order, ends):
        start, seconds, midi, vel = notes[k]
        a = int(round(start * rate))
        v = voice(preset, midi, vel, seconds, rate, note_seed(track, k))
        v = v[: max(0, min(int(round(end * rate)), n) - a)]
        x[a : a + len(v)] += v
    if wet > 0:
        x = reverb(x, rate, wet=wet)[:n]
    g, angle = held(list(gain), 1.0, n, rate), (held(list(pan), 0.0, n, rate) + 1) * (np.pi / 4)
    return np.stack([x * g * np.cos(angle), x * g * np.sin(angle)], axis=1)


def stems(notes: DataFrame, tracks: DataFrame, rate: int = 48_000) -> DataFrame:
    """Packed stereo PCM of every track, ``signal_id`` being ``score/track``: one track a task. ``notes`` has ``score_id, track,
    start_s, seconds, midi, vel`` and ``tracks`` ``score_id, track, preset, gain, pan`` (arrays of ``at`` seconds and ``value``, or null)
    and ``wet``; a track without notes has no stem, a note without track none either."""
    from pyspark.sql import Window as W, functions as F

    length = (F.col("start_s") + F.col("seconds")).alias("end")
    ends = notes.join(tracks.select("score_id", "track", "preset"), ["score_id", "track"])
    tail = F.element_at(F.create_map(*[x for p, v in PRESETS.items() for x in (F.lit(p), F.lit(v[0]))]), F.col("preset"))
    total = ends.groupBy("score_id").agg(F.max(length + tail).alias("total"))
    rows = notes.join(tracks, ["score_id", "track"]).join(total, "score_id")
    rows = rows.withColumn("place", F.dense_rank().over(W.partitionBy("score_id").orderBy("track")) - 1)

    def kernel(f):
        import pandas as pd

        first = f.iloc[0]
        if first["total"] > MAX_SECONDS:
            raise ValueError(f"{first['total']:.0f} s are more than {MAX_SECONDS}")
        keys = lambda c: [(k["at"], k["value"]) for k in c] if c is not None else []
        f = f.sort_values(["start_s", "midi", "seconds"])
        x = stem(list(zip(f["start_s"], f["seconds"], f["midi"], f["vel"])), first["preset"], rate, int(np.ceil(first["total"] * rate)) + 1, int(first["place"]), keys(first["gain"]), keys(first["pan"]), float(first["wet"]))
        return pd.DataFrame({"signal_id": [f"{first['score_id']}/{first['track']}"], "sample_rate": [rate], "channels": [2], "chunk_id": [0], "start_frame": [0], "samples": [x.astype(np.float32).ravel()]})

    return rows.groupBy("score_id", "track").applyInPandas(kernel, PACKED)


def mix(parts: DataFrame, gain_db: float = 0.0, ceiling_db: float | None = -1.0) -> DataFrame:
    """Packed PCM of each score: its stems added up in the order of their names, then gain, then the limiter on both channels."""
    from pyspark.sql import functions as F

    rows = parts.withColumn("score_id", F.regexp_extract("signal_id", r"^(.*)/[^/]*$", 1))

    def kernel(f):
        import pandas as pd

        f = f.sort_values("signal_id")
        rate, channels = int(f["sample_rate"].iloc[0]), int(f["channels"].iloc[0])
        x = np.zeros(max(len(s) for s in f["samples"]))
        for s in f["samples"]:
            x[: len(s)] += s
        x = (x * 10 ** (gain_db / 20)).reshape(-1, channels)
        if ceiling_db is not None:
            peak = np.abs(x).max(axis=1)
            limited = limit(peak, rate, ceiling_db)
            x = x * np.where(peak > 0, limited / np.maximum(peak, 1e-300), 1.0)[:, None]
        return pd.DataFrame({"signal_id": [f["score_id"].iloc[0]], "sample_rate": [rate], "channels": [channels], "chunk_id": [0], "start_frame": [0], "samples": [x.astype(np.float32).ravel()]})

    return rows.groupBy("score_id").applyInPandas(kernel, PACKED)


def render(notes: DataFrame, rate: int = 48_000, master: bool = True) -> DataFrame:
    """Packed PCM of each ``score_id`` from ``score_id, preset, start_s, seconds, midi, vel``; one score a task."""

    def kernel(f):
        import pandas as pd

        x = render_notes(list(zip(f["preset"], f["start_s"], f["seconds"], f["midi"], f["vel"])), rate)
        x = (limit(x, rate) if master else x).astype(np.float32)
        return pd.DataFrame({"signal_id": [str(f["score_id"].iloc[0])], "sample_rate": [rate], "channels": [1], "chunk_id": [0], "start_frame": [0], "samples": [x]})

    return notes.groupBy("score_id").applyInPandas(kernel, PACKED)
