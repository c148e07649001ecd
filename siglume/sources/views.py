"""Signal views: ordered numeric signals over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(*order: str):
    return (F.row_number().over(W.partitionBy("user_id").orderBy(*order)) - 1).cast("long")


def sig_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mono signal for each user: ``user_id, i, x``."""
    return table(spark, sf_dir, "events").select("user_id", _place("ts", "event_id").alias("i"), (F.col("value") / 512).alias("x"))


def sig_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order revenue as an onset envelope: ``i, x`` (days without orders are absent from the index)."""
    orders = table(spark, sf_dir, "orders")
    day = orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    # about 2,500 days whatever the scale: one ordered partition is enough
    return day.select((F.row_number().over(W.orderBy("day")) - 1).cast("long").alias("i"), (F.col("v").cast("double") / 1e6).alias("x"))


def sig_stereo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("signal_id"), F.col("l_discount").alias("l"), F.col("l_tax").alias("r"))


def sig_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a frame sequence: ``frame, label, v`` (64 values)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), "label", F.col("embedding").cast("array<double>").alias("v"))


def frame_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frame, label, bin, m``: magnitudes of the frame values."""
    f = sig_frames(spark, sf_dir)
    return f.select("frame", "label", F.posexplode("v").alias("bin", "e")).select("frame", "label", F.col("bin").cast("long").alias("bin"), F.abs("e").alias("m"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``track, note, onset, dur, midi, vel`` in ticks of 480 a quarter."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", _place("ts", "event_id").alias("i"))
    return e.select(
        F.col("user_id").alias("track"), F.col("i").alias("note"), (F.col("i") * 240 + F.pmod(F.col("event_id"), F.lit(97))).alias("onset"),
        (60 + F.pmod(F.col("event_id") * 7, F.lit(360))).alias("dur"), (36 + F.pmod(F.col("user_id"), F.lit(48))).alias("midi"),
        (1 + F.pmod(F.col("event_id"), F.lit(127))).alias("vel"), (F.col("value") / 512).alias("x"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("user_id", _place("ts", "event_id").alias("i"), F.col("event_type").alias("label"))


#: The same views for DuckDB.
SQL = {
    "sig": "sig AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i, value / 512 AS x FROM events)",
    "daily": "daily AS (SELECT CAST(row_number() OVER (ORDER BY day) - 1 AS BIGINT) AS i, CAST(v AS DOUBLE) / 1e6 AS x FROM (SELECT CAST(o_orderdate AS DATE) AS day, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY 1))",
    "stereo": "stereo AS (SELECT l_suppkey AS signal_id, l_discount AS l, l_tax AS r FROM lineitem)",
    "frames": "frames AS (SELECT vec_id AS frame, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
    "bins": "bins AS (SELECT vec_id AS frame, label, CAST(b - 1 AS BIGINT) AS bin, abs(CAST(embedding[b] AS DOUBLE)) AS m FROM embeddings, range(1, 65) t(b))",
    "notes": "notes AS (SELECT user_id AS track, i AS note, i * 240 + event_id % 97 AS onset, 60 + (event_id * 7) % 360 AS dur, 36 + user_id % 48 AS midi, 1 + event_id % 127 AS vel, value / 512 AS x FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i FROM events))",
    "runs": "runs AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i, event_type AS label FROM events)",
}


def with_views(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(SQL[n] for n in names)
