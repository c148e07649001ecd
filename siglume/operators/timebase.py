"""Exact tick, sample and time arithmetic over a piecewise tempo map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def tempo_segments(steps: list[tuple[int, int]], ppq: int, rate: int) -> list[tuple[int, int | None, int, int]]:
    """``(start_tick, next_tick, npq, anchor_sample)`` for steps ``(tick, nanoseconds per quarter)``; anchors add up
    left to right, each rounded half up once, in whole numbers."""
    out, anchor = [], 0
    steps = sorted(steps)
    for k, (tick, npq) in enumerate(steps):
        if k:
            before, speed = steps[k - 1]
            anchor += _samples(tick - before, speed, ppq, rate)
        out.append((tick, steps[k + 1][0] if k + 1 < len(steps) else None, npq, anchor))
    return out


def _samples(ticks: int, npq: int, ppq: int, rate: int) -> int:
    num, den = ticks * npq * rate, ppq * 1_000_000_000
    return (2 * num + den) // (2 * den)


def segment_table(spark: SparkSession, steps, ppq: int, rate: int) -> DataFrame:
    """A few rows whatever the data: broadcast."""
    return F.broadcast(spark.createDataFrame(tempo_segments(steps, ppq, rate), "start_tick long, next_tick long, npq long, anchor long"))


def tick_to_sample(df: DataFrame, segs: DataFrame, tick: str, ppq: int, rate: int) -> DataFrame:
    """Adds ``sample``: the segment's anchor plus ticks in exact decimals, rounded half up."""
    on = (F.col(tick) >= F.col("start_tick")) & (F.col("next_tick").isNull() | (F.col(tick) < F.col("next_tick")))
    num = f"(cast({tick} - start_tick as decimal(20,0)) * cast(npq * {rate} as decimal(18,0)))"
    den = ppq * 1_000_000_000
    whole = f"(2 * {num} + cast({den} as decimal(18,0))) div cast({2 * den} as decimal(19,0))"
    return df.join(segs, on).withColumn("sample", F.col("anchor") + F.expr(whole)).drop("start_tick", "next_tick", "npq", "anchor")


def sample_to_tick(df: DataFrame, segs: DataFrame, sample: str, ppq: int, rate: int) -> DataFrame:
    """Adds ``tick``: floor inverse inside the last segment anchored at or before the sample, before the next one's start."""
    from pyspark.sql import Window as W

    nxt = segs.withColumn("next_anchor", F.lead("anchor").over(W.orderBy("start_tick")))  # a few rows
    on = (F.col(sample) >= F.col("anchor")) & (F.col("next_anchor").isNull() | (F.col(sample) < F.col("next_anchor")))
    t = F.expr(f"start_tick + (cast({sample} - anchor as decimal(20,0)) * cast({ppq * 1_000_000_000} as decimal(16,0))) div cast(npq * {rate} as decimal(18,0))")
    out = df.join(F.broadcast(nxt), on).withColumn("tick", F.coalesce(F.least(t, F.col("next_tick") - 1), t))
    return out.drop("start_tick", "next_tick", "npq", "anchor", "next_anchor")
