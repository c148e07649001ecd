"""Onset detection and the peak tools that other operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from siglume.functions.scalars import upper_mad, upper_median
from siglume.operators.sequential import suppress


def flux(sig: DataFrame, key: str) -> DataFrame:
    """Half-wave rectified difference; the first sample has none (0)."""
    before = F.lag("x").over(W.partitionBy(key).orderBy("i"))
    return sig.withColumn("f", F.greatest(F.coalesce(F.col("x") - before, F.lit(0.0)), F.lit(0.0)))


def with_threshold(df: DataFrame, key: str, value: str = "f", half: int = 10, scale: float = 8.0, least: float = 1e-6) -> DataFrame:
    """Rolling upper median plus scaled upper MAD over ``2 * half + 1`` rows, cut off at the ends."""
    near = F.collect_list(value).over(W.partitionBy(key).orderBy("i").rowsBetween(-half, half))
    df = df.withColumn("_near", near).withColumn("_med", upper_median(F.col("_near")))
    return df.withColumn("thr", F.col("_med") + scale * upper_mad(F.col("_near"), F.col("_med")) + least).drop("_near", "_med")


def peaks(df: DataFrame, key: str, value: str = "f") -> DataFrame:
    """Rows above their threshold, not below the row before and above the row after; ends never count."""
    w = W.partitionBy(key).orderBy("i")
    v = F.col(value)
    marked = df.withColumns({"_p": F.lag(v).over(w), "_n": F.lead(v).over(w)})
    return marked.where((v > F.col("thr")) & (v >= F.col("_p")) & (v > F.col("_n"))).drop("_p", "_n")


def onsets(sig: DataFrame, key: str, scale: float = 8.0, min_gap: int = 3, half: int = 10) -> DataFrame:
    """``key, i, f`` of the accepted onsets."""
    found = peaks(with_threshold(flux(sig, key), key, half=half, scale=scale), key)
    return suppress(found, key, min_gap)
