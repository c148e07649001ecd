"""Distributed connected components by alternating large-star and small-star rounds (DataFrame operators only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from .common import discard, materialize


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges(u, v)`` written and read back, with their count and a hash of them, both taken during the write."""
    seen = Observation()
    out = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "cc")
    return out, (seen.get["n"], seen.get["h"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of any ordered type -> ``(node, root)``, root = smallest node of the component.

    Null ends and self loops are ignored; nodes without an edge are absent. An empty input gives an
    empty output. Stars are re-hung with grouped minima that combine before the shuffle, so a hub
    with a third of all edges is one pre-aggregated key and one splittable join key.
    """
    pair = edges.where("u is not null and v is not null and u <> v")
    cur, before = _written(pair.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        last, (cur, after) = cur, _written(small.distinct())
        discard(last)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
