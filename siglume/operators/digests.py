"""Timelines, their display rows, window comparison, sample digests and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siglume.operators import levels


def timeline(sig: DataFrame, onsets: DataFrame, track: DataFrame, key: str, window: int, floor_db: float = -60.0) -> DataFrame:
    """``key, seg, n, rms_db, peak_db, silent, onsets, f0``: tumbling windows with their onset counts and the median of their
    voiced hops ``track(key, i, f0)``."""
    seg = F.floor(F.col("i") / window).alias("seg")
    hits = onsets.groupBy(key, seg).agg(F.count("*").alias("onsets"))
    f0 = track.where("f0 is not null").groupBy(key, seg).agg(F.median("f0").alias("f0"))
    out = levels.segments(sig, key, window, floor_db).join(hits, [key, "seg"], "left").join(f0, [key, "seg"], "left")
    return out.withColumn("onsets", F.coalesce("onsets", F.lit(0)))


def display_rows(timeline: DataFrame, key: str, most: int = 40, least: int = 3) -> DataFrame:
    """``key, first, last, rms_db, onsets, f0, silent, collapsed``: windows in equal buckets so that ``most`` rows do (loudest
    level, added onsets, silent only if all are, median pitch), then runs of ``least`` and more silent rows as one."""
    width = F.when(F.count("*").over(W.partitionBy(key)) > most, F.ceil(F.count("*").over(W.partitionBy(key)) / most)).otherwise(1)
    rows = timeline.withColumn("line", F.floor(F.col("seg") / width)).groupBy(key, "line").agg(
        F.min("seg").alias("first"), F.max("seg").alias("last"), F.max("rms_db").alias("rms_db"), F.sum("onsets").alias("onsets"), F.bool_and("silent").alias("silent"), F.median("f0").alias("f0")
    )
    rows = rows.withColumn("g", F.col("line") - F.row_number().over(W.partitionBy(key, "silent").orderBy("line")))
    rows = rows.withColumn("collapsed", F.col("silent") & (F.count("*").over(W.partitionBy(key, "silent", "g")) >= least))
    place = F.when(F.col("collapsed"), -1 - F.col("g")).otherwise(F.col("line"))
    shown = lambda c: F.when(~F.col("collapsed"), F.max(c)).alias(c)
    out = rows.groupBy(key, place.alias("place"), "collapsed").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), shown("rms_db"), F.sum("onsets").alias("onsets"), shown("f0"), F.bool_and("silent").alias("silent")
    )
    return out.drop("place")


def segment_delta(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``key, segments, worst, worst_at, mean`` of the level differences (b - a) of windows ``(key, seg, rms_db)`` that both have;
    ties take the first window."""
    both = a.select(key, "seg", F.col("rms_db").alias("x")).join(b.select(key, "seg", F.col("rms_db").alias("y")), [key, "seg"])
    d = both.withColumn("d", F.col("y") - F.col("x"))
    at = F.min(F.when(F.col("d").isNotNull(), F.struct((-F.round(F.abs("d"), 9)).alias("k"), "seg")))["seg"]
    return d.groupBy(key).agg(F.count("*").alias("segments"), F.max(F.abs("d")).alias("worst"), at.alias("worst_at"), F.avg("d").alias("mean"))


def samples_digest(x: str, scale: int) -> Column:
    """Digest of a signal's samples in order, as whole numbers of ``1 / scale``: equal only for equal samples."""
    steps = F.transform(F.sort_array(F.collect_list(F.struct("i", F.round(F.col(x) * scale).cast("long").alias("v")))), lambda s: s["v"].cast("string"))
    return F.md5(F.array_join(steps, ","))


#: Tolerances of the second tier: milliseconds, decibels, cents.
TIER = {"ms": 1.0, "db": 0.1, "cents": 5.0}


def verdicts(reports: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, identical, verdict`` of pairs of reports ``(id, ms, db, f0, hits, tonic, h)``: identical samples, else the dimensions
    that differ in fixed order, else ``tier2``. An undefined value differs from a defined one."""
    side = lambda s: reports.select(*[F.col(c).alias(f"{c}_{s}") for c in reports.columns])
    p = pairs.join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b"))
    odd = lambda c: F.col(f"{c}_a").isNull() != F.col(f"{c}_b").isNull()
    cents = 1200 * F.log2(F.col("f0_b") / F.col("f0_a"))
    why = F.concat_ws(
        ",", F.when(F.abs(F.col("ms_b") - F.col("ms_a")) > TIER["ms"], "duration"), F.when(odd("db") | (F.coalesce(F.abs(F.col("db_b") - F.col("db_a")), F.lit(0.0)) > TIER["db"]), "loudness"),
        F.when(F.col("hits_a") != F.col("hits_b"), "onsets"), F.when(odd("f0") | (F.coalesce(F.abs(cents), F.lit(0.0)) > TIER["cents"]), "pitch"), F.when(F.col("tonic_a") != F.col("tonic_b"), "key"),
    )
    same = F.col("h_a") == F.col("h_b")
    return p.select("a", "b", same.alias("identical"), F.when(same, "identical").when(why == "", "tier2").otherwise(why).alias("verdict"))


def capped_line(rows: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """``key, line``: the first ``most`` labels in order, and the number of the rest. Only those are collected."""
    k = F.row_number().over(W.partitionBy(key).orderBy("i"))
    n = rows.withColumn("_k", k).groupBy(key).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("_k") <= most, F.struct("_k", F.col(label).alias("v"))))).alias("s"))
    line = F.array_join(F.transform("s", lambda s: s["v"]), " ")
    return n.select(key, F.concat(line, F.when(F.col("n") > most, F.concat(F.lit(" +"), (F.col("n") - most).cast("string"))).otherwise("")).alias("line"))
