"""Runs, repairs and matches over ordered labels and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from siglume.operators.sequential import bridge, greedy_pairs  # noqa: F401  (bridge: used with the runs here)


def islands(df: DataFrame, key: str, label: str) -> DataFrame:
    """Maximal runs of equal labels: ``key, label, start, stop, n``; null labels break runs."""
    g = df.where(F.col(label).isNotNull())
    g = g.withColumn("_g", F.col("i") - F.row_number().over(W.partitionBy(key, label).orderBy("i")))
    return g.groupBy(key, label, "_g").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop"), F.count("*").alias("n")).drop("_g")


def repair_overlaps(notes: DataFrame, key: str) -> DataFrame:
    """Same start: the first (lowest pitch) stays; then each note ends at the next start at the latest."""
    first = notes.groupBy(key, "onset").agg(F.min(F.struct("midi", "dur", "vel")).alias("f")).select(key, "onset", "f.dur", "f.midi", "f.vel")
    nxt = F.lead("onset").over(W.partitionBy(key).orderBy("onset"))
    return first.withColumn("dur", F.least("dur", nxt - F.col("onset")))


def overlaps(notes: DataFrame, key: str) -> DataFrame:
    """Notes that begin before the one before them (by start, then index) has ended."""
    before = F.lag(F.col("onset") + F.col("dur")).over(W.partitionBy(key).orderBy("onset", "note"))
    return notes.withColumn("prev_end", before).where(F.col("onset") < F.col("prev_end"))


def match_onsets(a: DataFrame, b: DataFrame, key: str, within: float) -> DataFrame:
    """One-to-one matches of ``t`` in both, nearest pairs first (then a, then b): ``key, ta, tb``.

    Candidates come from an equi-join on time buckets, so only near pairs form; the greedy choice walks one key's candidates
    in order.
    """
    bucket = lambda c: F.floor(c / within)
    left = a.select(key, F.col("t").alias("ta"), F.explode(F.array(*[bucket(F.col("t")) + d for d in (-1, 0, 1)])).alias("k"))
    right = b.select(key, F.col("t").alias("tb"), bucket(F.col("t")).alias("k"))
    near = left.join(right, [key, "k"]).where(F.abs(F.col("ta") - F.col("tb")) <= within)
    near = near.select(key, "ta", "tb", F.abs(F.col("ta") - F.col("tb")).alias("d"))
    return greedy_pairs(near, key, "ta", "tb", "d")


def unmatched(a: DataFrame, b: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """``key, side, t`` of the times in ``a`` and ``b`` that no pair holds."""
    left = a.select(key, "t").join(pairs.select(key, F.col("ta").alias("t")), [key, "t"], "left_anti").select(key, F.lit("a").alias("side"), "t")
    right = b.select(key, "t").join(pairs.select(key, F.col("tb").alias("t")), [key, "t"], "left_anti").select(key, F.lit("b").alias("side"), "t")
    return left.unionByName(right)


def smooth_runs(runs: DataFrame, key: str, label: str, least: int) -> DataFrame:
    """Labelled runs ``key, label, start, stop`` under ``least`` frames take the label of the nearest labelled run before, else
    after (as labelled before any repair); neighbours that are alike then become one: ``key, label, start, stop``."""
    w = W.partitionBy(key).orderBy("start")
    before = F.last(label, True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first(label, True).over(w.rowsBetween(1, W.unboundedFollowing))
    short = F.col(label).isNotNull() & (F.col("stop") - F.col("start") < least)
    fixed = runs.withColumn(label, F.when(short, F.coalesce(before, after, label)).otherwise(F.col(label)))
    touches = F.lag("stop").over(w).eqNullSafe(F.col("start")) & F.lag(label).over(w).eqNullSafe(F.col(label))
    block = F.sum(F.when(touches, 0).otherwise(1)).over(w)
    joined = fixed.withColumn("_b", block).groupBy(key, "_b", label).agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return joined.where(F.col(label).isNotNull()).drop("_b")
