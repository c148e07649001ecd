"""Scalar column functions: levels, pitch, time base, note values. All stay in JVM code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NOTE_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
VEL_FLOOR_DBFS = -48.0


def lin_to_db(x: Column) -> Column:
    """20 log10(x); null where x is not positive."""
    return F.when(x > 0, 20 * F.log10(x))


def lin_to_db_inf(x: Column) -> Column:
    """20 log10(x); minus infinity where x is not positive."""
    return F.when(x > 0, 20 * F.log10(x)).otherwise(F.lit(float("-inf")))


def db_to_lin(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def hz_to_mel(hz: Column) -> Column:
    return 2595 * F.log10(1 + hz / 700)


def mel_to_hz(mel: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), mel / 2595) - 1)


def midi_to_hz(midi: Column) -> Column:
    return 440 * F.pow(F.lit(2.0), (midi - 69) / 12)


def nearest_midi(hz: Column) -> Column:
    """Half-away rounding of the fractional MIDI number; null where hz is not positive."""
    return F.when(hz > 0, F.round(69 + 12 * F.log2(hz / 440)).cast("long"))


def cents_off(hz: Column, midi: Column) -> Column:
    return F.when(hz > 0, 1200 * F.log2(hz / midi_to_hz(midi)))


def note_name(midi: Column) -> Column:
    """``C4`` for 60; octaves count down below zero."""
    names = F.array(*[F.lit(n) for n in NOTE_NAMES])
    return F.concat(F.element_at(names, (F.pmod(midi, F.lit(12)) + 1).cast("int")), (F.floor(midi / 12) - 1).cast("string"))


def parse_pitch(text: Column) -> Column:
    """MIDI number of ``C#4`` or ``Bb2`` (any case of the letter, one accidental at most); null if malformed or out of 0..127."""
    letter = F.upper(F.regexp_extract(text, r"^([A-Ga-g])([#b]?)(-?[0-9]+)$", 1))
    sign = F.regexp_extract(text, r"^([A-Ga-g])([#b]?)(-?[0-9]+)$", 2)
    octave = F.regexp_extract(text, r"^([A-Ga-g])([#b]?)(-?[0-9]+)$", 3)
    step = F.element_at(F.array(*[F.lit(v) for v in (9, 11, 0, 2, 4, 5, 7)]), F.ascii(letter) - 64)
    midi = step + F.when(sign == "#", 1).when(sign == "b", -1).otherwise(0) + (octave.try_cast("int") + 1) * 12
    return F.when(letter != "", F.when((midi >= 0) & (midi <= 127), midi))


def parse_duration(text: Column, ppq: int) -> Column:
    """Ticks of ``3/16``, ``1/8.`` (dotted) or ``1/8t`` (triplet); null if malformed or off the grid."""
    num = F.regexp_extract(text, r"^([0-9]+)/([0-9]+)([.t]?)$", 1).try_cast("long")
    den = F.regexp_extract(text, r"^([0-9]+)/([0-9]+)([.t]?)$", 2).try_cast("long")
    mark = F.regexp_extract(text, r"^([0-9]+)/([0-9]+)([.t]?)$", 3)
    up = F.when(mark == ".", 3).when(mark == "t", 2).otherwise(1)
    down = F.when(mark == ".", 2).when(mark == "t", 3).otherwise(1)
    whole, by = ppq * 4 * num * up, den * down
    return F.when((by > 0) & (num > 0) & (F.try_mod(whole, by) == 0), F.floor(F.try_divide(whole, by)))


def ms_to_ticks(ms: Column, ms_per_tick: Column) -> Column:
    """Rounded half up; null for negative, non-finite or undefined times."""
    return F.when((ms >= 0) & (ms < 1e15) & (ms_per_tick > 0), F.floor(ms / ms_per_tick + 0.5).cast("long"))


def snap(t: Column, grid: int) -> Column:
    """Nearest multiple of ``grid``, halves up; ``grid`` 0 leaves ``t``."""
    if grid == 0:
        return t
    rest = F.pmod(t, F.lit(grid))
    return t - rest + F.when(rest * 2 >= grid, grid).otherwise(0)


def snap_anchored(t: Column, grid: int, anchor: Column) -> Column:
    """``snap`` of the distance from ``anchor``, the same on both sides, never below 0."""
    return F.when(t >= anchor, anchor + snap(t - anchor, grid)).otherwise(F.greatest(anchor - snap(anchor - t, grid), F.lit(0)))


def velocity_from_peak(db: Column) -> Column:
    """-48..0 dBFS to 1..127; silence (null) is 1."""
    t = F.least(F.greatest((db - VEL_FLOOR_DBFS) / -VEL_FLOOR_DBFS, F.lit(0.0)), F.lit(1.0))
    return F.coalesce(F.round(1 + t * 126).cast("long"), F.lit(1))


def velocity_amp(vel: Column) -> Column:
    return F.pow(vel / 127, F.lit(2.0))


def adsr(t: Column, gate: Column, attack: float, decay: float, sustain: float, release: float) -> Column:
    """Piecewise-linear envelope; the release ramps down from the level at note-off."""

    def held(x: Column) -> Column:
        return (
            F.when(x < attack, x / attack)
            .when(x < attack + decay, 1 - (1 - sustain) * (x - attack) / decay)
            .otherwise(F.lit(sustain))
        )

    off = held(gate) * F.greatest(1 - (t - gate) / release, F.lit(0.0))
    return F.when(t < 0, F.lit(0.0)).when(t < gate, held(t)).otherwise(off)


def tempo_prior(bpm: Column) -> Column:
    return F.exp(-0.5 * F.pow(F.log2(bpm / 120) / 1.3, F.lit(2.0)))


def lags_agree(lag: Column, other: Column) -> Column:
    """Whether two lags agree within 5 % after folding by up to two octaves."""
    folds = F.array(*[F.lit(v) for v in (0.25, 0.5, 1.0, 2.0, 4.0)])
    return F.exists(folds, lambda f: F.abs(lag * f - other) <= 0.05 * other)


def bar_beat(tick: Column, ppq: int, beats: int, unit: int) -> tuple[Column, Column, Column]:
    """1-based bar and beat, and the tick offset inside the beat."""
    per_beat = ppq * 4 // unit
    per_bar = per_beat * beats
    return F.floor(tick / per_bar) + 1, F.floor(F.pmod(tick, F.lit(per_bar)) / per_beat) + 1, F.pmod(tick, F.lit(per_beat))


def pan_gains(pan: Column) -> tuple[Column, Column]:
    """Constant-power left and right gains of a pan in -1..1."""
    angle = (pan + 1) * (3.141592653589793 / 4)
    return F.cos(angle), F.sin(angle)


def upper_median(values: Column) -> Column:
    """Element n div 2 (from 0) of the sorted array."""
    return F.element_at(F.sort_array(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def upper_mad(values: Column, centre: Column) -> Column:
    return upper_median(F.transform(values, lambda v: F.abs(v - centre)))


def position_tick(bar: Column, beat: Column, rest: Column, ppq: int, beats: int, unit: int) -> Column:
    """Tick of a 1-based bar and beat plus a rest in ticks; null outside the signature."""
    per_beat = ppq * 4 // unit
    return F.when((bar >= 1) & beat.between(1, beats) & (rest >= 0), (bar - 1) * (per_beat * beats) + (beat - 1) * per_beat + rest)


def fraction_of_whole(ticks: Column, ppq: int) -> Column:
    """Ticks as a reduced fraction of a whole note: Euclid's steps, of which a whole note of ticks needs a bounded number."""
    whole = F.lit(ppq * 4).cast("long")
    pair = F.struct(ticks.cast("long").alias("a"), whole.alias("b"))
    step = lambda p, _: F.when(p["b"] == 0, p).otherwise(F.struct(p["b"].alias("a"), F.try_mod(p["a"], p["b"]).alias("b")))
    steps = int(1.45 * (ppq * 4).bit_length()) + 3
    g = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), pair, step)["a"]
    return F.concat(F.floor(ticks / g).cast("string"), F.lit("/"), F.floor(whole / g).cast("string"))


GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
NOTE_STREAM = 0xC0C41EA000000000


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def _let(value: Column, then) -> Column:
    """``then(value)``, with ``value`` computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _wrapped(total: Column) -> Column:
    """A decimal as 64 bits: modulo 2 ** 64, then the signed long of these bits."""
    two64, half = F.lit(str(1 << 64)).cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)")
    return _let(total % two64, lambda rest: F.when(rest >= half, rest - two64).otherwise(rest).cast("decimal(20,0)").cast("long"))


def _times(a: Column, by: int) -> Column:
    """Low 64 bits of a product of 64-bit numbers, by 32-bit halves, so that no step overflows."""
    half = 0xFFFFFFFF
    lo, hi = (x.cast("decimal(10,0)") for x in (a.bitwiseAND(F.lit(half)), F.shiftrightunsigned(a, 32)))
    two32 = F.lit(1 << 32).cast("decimal(10,0)")
    cross = ((hi * F.lit(by & half).cast("decimal(10,0)")) % two32).cast("decimal(10,0)")
    return _wrapped((lo * F.lit(str(by)).cast("decimal(20,0)")).cast("decimal(31,0)") + (cross * two32).cast("decimal(31,0)"))


def _plus(a: Column, by: int) -> Column:
    return _wrapped((a.cast("decimal(21,0)") + F.lit(str(by)).cast("decimal(21,0)") + F.lit(str(1 << 64)).cast("decimal(21,0)")).cast("decimal(31,0)"))


def counter_bits(seed: Column, index: Column) -> Column:
    """64 random bits for each (seed, index), without state: the seed is xored with the index times a fixed step, then
    mixed (fixed values, so that every reader of a seed gets the same noise)."""
    z = _plus(seed.cast("long").bitwiseXOR(_let(index.cast("long"), lambda i: _times(i, GOLDEN))), GOLDEN)
    for shift, by in ((30, MIX_A), (27, MIX_B)):
        z = _let(_let(z, _folded(shift)), _multiplier(by))
    return _let(z, _folded(31))


def _folded(by: int):
    return lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, by))


def _multiplier(by: int):
    return lambda v: _times(v, by)


def counter_noise(seed: Column, index: Column) -> Column:
    """Uniform in -1..1 (1 left out): the upper 24 bits."""
    return F.shiftrightunsigned(counter_bits(seed, index), 40) / 8388608.0 - 1


def note_seed(track: Column, note: Column) -> Column:
    """Stream of a note: a hash of its track's and its own place in the schedule."""
    return counter_bits(counter_bits(F.lit(_signed(NOTE_STREAM)).bitwiseXOR(track.cast("long")), note), F.lit(0))


def frame_centre_ms(frame: Column, hop: int, size: int, rate: int) -> Column:
    return (frame * hop + size // 2) / float(rate) * 1000


def bucket_of_sample(at: Column, window: int, count: int) -> Column:
    """Window of a sample position; the last one takes what lies beyond."""
    return F.least(F.floor(at / window), F.lit(count - 1))


def bucket_of_time(ms: Column, window_ms: float, count: int) -> Column:
    return F.least(F.floor(ms / window_ms), F.lit(count - 1))


def bar_beat_at(ms: Column, first: float, beat_ms: float, beats: int) -> tuple[Column, Column]:
    """1-based bar and beat in force at a time on an even grid; null before the first downbeat."""
    k = F.floor((ms - first + 1e-6) / beat_ms)
    return F.when(k >= 0, F.floor(k / beats) + 1), F.when(k >= 0, F.pmod(k, F.lit(beats)) + 1)


def base64_line(raw: Column) -> Column:
    """Base64 on one line."""
    return F.regexp_replace(F.base64(raw), "[\\r\\n]", "")


def mel_band(hz: Column, mels: int, low: float, high: float) -> Column:
    """Mel band of a frequency on an image's axis; null outside the axis."""
    start, end = hz_to_mel(F.lit(low)), hz_to_mel(F.lit(high))
    return F.when(hz.between(low, high), F.least(F.floor((hz_to_mel(hz) - start) / (end - start) * mels), F.lit(mels - 1)))


def nearest_frame(sample: Column, hop: int, count: int) -> Column:
    """Frame nearest to a sample offset, the last one at most."""
    return F.least(F.floor((sample + hop // 2) / hop), F.lit(count - 1))


def downmix(*channels: str) -> Column:
    """Mean of the channels, added up in their order."""
    total = F.col(channels[0])
    for c in channels[1:]:
        total = total + F.col(c)
    return total / len(channels)


def unique_names(df, name: str, order: str):
    """``df`` with later bearers of a name called ``name_2``, ``name_3`` and so on, in ``order``."""
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy(name).orderBy(order))
    return df.withColumn("_k", k).withColumn(name, F.when(F.col("_k") > 1, F.concat(F.col(name), F.lit("_"), F.col("_k").cast("string"))).otherwise(F.col(name))).drop("_k")
