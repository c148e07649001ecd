"""Level operators over ``(key, i, x)`` signals: segments, silence, clipping, stereo image, loudness gating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siglume.functions.scalars import lin_to_db


def segments(sig: DataFrame, key: str, window: int, floor_db: float = -60.0) -> DataFrame:
    """Tumbling windows: ``key, seg, n, rms_db, peak_db, silent`` (silent: rms null or at most the floor)."""
    out = sig.groupBy(key, F.floor(F.col("i") / window).alias("seg")).agg(
        F.count("*").alias("n"), lin_to_db(F.sqrt(F.avg(F.col("x") * F.col("x")))).alias("rms_db"), lin_to_db(F.max(F.abs("x"))).alias("peak_db")
    )
    return out.withColumn("silent", F.coalesce(F.col("rms_db") <= floor_db, F.lit(True)))


def hops(sig: DataFrame, key: str, window: int, hop: int) -> DataFrame:
    """Hopping windows ``key, start, rms``; the first window that reaches the end is the last, and may be partial."""
    size = sig.groupBy(key).agg((F.max("i") + 1).alias("n"))
    lanes = F.explode(F.sequence(F.lit(0), F.lit((window - 1) // hop)))
    placed = sig.select(key, "i", "x", lanes.alias("back")).withColumn("start", (F.floor(F.col("i") / hop) - F.col("back")) * hop)
    placed = placed.where((F.col("start") >= 0) & (F.col("i") < F.col("start") + window))
    out = placed.groupBy(key, "start").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms")).join(size, key)
    return out.where((F.col("start") == 0) | (F.col("start") - hop + window < F.col("n")))


def silence(sig: DataFrame, key: str, window: int, hop: int, floor_db: float) -> DataFrame:
    """Leading and trailing silence in samples; a window is audible if its level is above the floor."""
    h = hops(sig, key, window, hop).withColumn("audible", F.coalesce(lin_to_db(F.col("rms")) > floor_db, F.lit(False)))
    out = h.groupBy(key, "n").agg(
        F.min(F.when(F.col("audible"), F.col("start"))).alias("a"), F.max(F.when(F.col("audible"), F.least(F.col("start") + window, F.col("n")))).alias("b")
    )
    return out.select(key, F.coalesce("a", "n").alias("leading"), F.coalesce(F.col("n") - F.col("b"), "n").alias("trailing"), (F.col("b") - 1).alias("last_audible"))


def clipping(sig: DataFrame, key: str, at: float = 1.0) -> DataFrame:
    return sig.groupBy(key).agg(F.count_if(F.abs("x") >= at).alias("clipped"), F.max(F.abs("x")).alias("peak"))


def stereo_image(sig: DataFrame, key: str) -> DataFrame:
    """Width, correlation and balance of ``l`` and ``r`` from one pass of sums."""
    mid, side = (F.col("l") + F.col("r")) / 2, (F.col("l") - F.col("r")) / 2
    s = sig.groupBy(key).agg(
        F.count("*").alias("n"), F.sum("l").alias("sl"), F.sum("r").alias("sr"), F.sum(F.col("l") * F.col("l")).alias("ll"), F.sum(F.col("r") * F.col("r")).alias("rr"),
        F.sum(F.col("l") * F.col("r")).alias("lr"), F.sqrt(F.avg(mid * mid)).alias("mid"), F.sqrt(F.avg(side * side)).alias("side"),
    )
    vl, vr = F.col("ll") / F.col("n") - F.pow(F.col("sl") / F.col("n"), 2), F.col("rr") / F.col("n") - F.pow(F.col("sr") / F.col("n"), 2)
    cov = F.col("lr") / F.col("n") - F.col("sl") * F.col("sr") / (F.col("n") * F.col("n"))
    clamp = lambda c: F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))
    rl, rr = F.sqrt(F.col("ll") / F.col("n")), F.sqrt(F.col("rr") / F.col("n"))
    return s.select(
        key, F.when(F.col("mid") + F.col("side") > 0, F.col("side") / (F.col("mid") + F.col("side"))).otherwise(0.0).alias("width"),
        F.when((vl > 1e-12) & (vr > 1e-12), clamp(cov / F.sqrt(F.greatest(vl, F.lit(1e-300)) * F.greatest(vr, F.lit(1e-300))))).alias("correlation"),
        F.when(rl + rr > 0, clamp((rr - rl) / (rl + rr))).alias("balance"),
    )


def rolling_power(sig: DataFrame, key: str, rows: int) -> Column:
    """Mean power of the last ``rows`` samples; null until so many are there."""
    w = W.partitionBy(key).orderBy("i").rowsBetween(-(rows - 1), 0)
    return F.when(F.col("i") >= rows - 1, F.avg(F.col("x") * F.col("x")).over(w))


def loudness(power: Column) -> Column:
    return F.when(power > 0, -0.691 + 10 * F.log10(power))


def _gated(sig: DataFrame, key: str, block: int, absolute: float, relative: float) -> DataFrame:
    """Block powers ``p`` above an absolute gate and one relative to their mean. The mean is a window's, so no block is dealt out again."""
    p = F.col("p")
    blocks = sig.where(F.col(key).isNotNull()).withColumn("p", rolling_power(sig, key, block)).where(p.isNotNull()).where(loudness(p) > absolute)
    return blocks.withColumn("gate", loudness(F.avg(p).over(W.partitionBy(key))) + relative).where(loudness(p) > F.col("gate"))


def gated_loudness(sig: DataFrame, key: str, block: int = 4, absolute: float = -70.0, relative: float = -10.0) -> DataFrame:
    """Two-pass gated mean of overlapping block powers: absolute gate, then a gate relative to the first mean."""
    return _gated(sig, key, block, absolute, relative).groupBy(key).agg(loudness(F.avg("p")).alias("lufs"), F.count("*").alias("blocks"))


def loudness_range(sig: DataFrame, key: str, block: int = 30) -> DataFrame:
    """10th to 95th percentile of short-term loudness above an absolute gate of -70 and a relative one of -20."""
    live = _gated(sig, key, block, -70.0, -20.0).withColumn("s", loudness(F.col("p")))
    return live.groupBy(key).agg(F.expr("percentile(s, 0.95) - percentile(s, 0.1)").alias("lra"))
