"""From scores to samples: upserts, event schedules in blocks, patches, mixing of voices, the master bus."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from siglume.functions.scalars import adsr, db_to_lin, midi_to_hz, velocity_amp
from siglume.operators import sequential, timebase
from siglume.operators.synth import PRESETS


def upsert(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """One row for each key: the last in ``order`` wins."""
    return rows.groupBy(*keys).agg(*[F.max_by(v, order).alias(v) for v in values])


def events(notes: DataFrame, key: str, steps, ppq: int, rate: int, block: int) -> DataFrame:
    """``key, note, midi, starts, sample, block, offs, place`` of notes ``(key, note, midi, onset, dur)`` in ticks: on and off events
    in samples by the tempo map, and their place in the track (ends before starts, then lower pitches)."""
    both = F.array(F.struct(F.col("onset").alias("tick"), F.lit(True).alias("starts")), F.struct((F.col("onset") + F.col("dur")).alias("tick"), F.lit(False).alias("starts")))
    at = notes.select(key, "note", "midi", F.inline(both))
    s = timebase.tick_to_sample(at, timebase.segment_table(notes.sparkSession, steps, ppq, rate), "tick", ppq, rate)
    place = F.row_number().over(W.partitionBy(key).orderBy("sample", "starts", "midi", "note")) - 1
    return s.select(key, "note", "midi", "starts", "sample", F.floor(F.col("sample") / block).alias("block"), F.pmod("sample", F.lit(block)).alias("offs"), place.cast("long").alias("place"))


def with_patch(tracks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Tracks with their preset's row and a status; ``custom`` brings its own patch, others must be in the catalog."""
    status = F.when(F.col("preset") == "custom", "own patch").when(F.col("polyphony").isNull(), "unknown preset").otherwise("catalog")
    return tracks.join(F.broadcast(catalog), "preset", "left").withColumn("status", status)  # eleven presets


def mix_sines(notes: DataFrame, key: str, rate: int, preset: str = "sine") -> DataFrame:
    """``key, k, y``: enveloped sines of ``(key, midi, vel, start_s, seconds)`` added up sample by sample. Every note becomes its own
    samples, so one track spreads over all tasks and the sum combines before the shuffle."""
    release, (a, d, s, r), gain = *PRESETS[preset][:2], PRESETS[preset][2]
    first, last = F.ceil(F.col("start_s") * rate), F.ceil((F.col("start_s") + F.col("seconds") + release) * rate) - 1
    k = notes.where(last >= first).select("*", F.explode(F.sequence(first, last)).alias("k"))
    t = F.col("k") / rate - F.col("start_s")
    y = F.sin(2 * math.pi * midi_to_hz(F.col("midi")) * t) * gain * velocity_amp(F.col("vel")) * adsr(t, F.col("seconds"), a, d, s, r)
    return k.select(key, "k", y.alias("y")).groupBy(key, "k").agg(F.sum("y").alias("y"))


def master(sig: DataFrame, key: str, gain_db: float, ceiling: float, lookahead: int, keep: float) -> DataFrame:
    """``key, i, y``: gain, then the brick-wall limiter."""
    loud = sig.select(key, "i", (F.col("x") * db_to_lin(F.lit(gain_db))).alias("x"))
    return loud.join(sequential.limiter(loud, key, ceiling, lookahead, keep), [key, "i"]).select(key, "i", (F.col("x") * F.col("gain")).alias("y"))
