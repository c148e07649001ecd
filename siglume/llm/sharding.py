"""Vector bin packing of documents into shards.

Groups (equal texts) are vectors of bytes, tokens (words between ASCII white space) and rows. Each group goes where the
dot product of its vector with the shards' residual capacity is highest, among the shards that have room for it in all
three; where none has, room for its bytes decides, since bytes are the law. Groups under ``1 / (shards * grain)`` of all
bytes are first merged by hash into ``cells`` cells, so the sequential part sees a bounded number of
vectors (``shards * (grain + WHOLE + FINE) + cells`` at most) however many documents there are; a group above an
eighth of a shard is placed in pieces of a 64th, since one group may hold nearly all rows and larger pieces would not
come out even.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import materialize

WHOLE = 8  # a group above this part of a shard is cut
FINE = 64  # into pieces of this part of a shard


def place(vectors: np.ndarray, shards: int, weights=(2.0, 1.0, 1.0)) -> np.ndarray:
    """Shard of each vector (rows of ``vectors``): largest first, highest dot product with the residual.

    Shards that can't take the vector in all its parts only count when none can: then, of those with room in its first part
    (bytes), the one that it overfills least; where there is none either, the one with most room in that part.
    """
    total = np.maximum(vectors.sum(axis=0), 1e-12)
    v = vectors / total
    residual = np.full((shards, v.shape[1]), 1.0 / shards)
    w = np.asarray(weights)
    out = np.zeros(len(v), dtype=np.int64)
    for i in np.argsort(-v.max(axis=1), kind="stable"):
        left = residual - v[i]
        fits = (left >= 0).all(axis=1)
        if fits.any():
            b = np.argmax(np.where(fits, residual @ (w * v[i]), -np.inf))
        elif (first := left[:, 0] >= 0).any():
            b = np.argmax(np.where(first, left.min(axis=1), -np.inf))
        else:
            b = np.argmax(left[:, 0])
        out[i] = b
        residual[b] = left[b]
    return out


def _piece(pieces: str):
    return F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col(pieces)).cast("int")


def pack(docs: DataFrame, shards: int = 16, cells: int = 16384, grain: int = 64) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, tokens, shard, slot``.

    ``size`` is the UTF-8 bytes of the text plus 1 (null text: 1, crc of the empty text). Slots count
    from 0 without gaps in each shard, in no meaningful order. ``tokens`` counts words. Repeated rows and null ids keep their
    rows; an empty table gives an empty result; other columns are ignored. Law: bytes.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = materialize(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
            F.xxhash64("text").alias("g"),
            F.xxhash64(F.lit(17), "text").alias("g2"),
        ),
        "pack-rows",
    )
    groups = materialize(
        rows.groupBy("g", "g2").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")), "pack-groups"
    )
    total, count = groups.agg(F.sum("b"), F.sum("r")).first()
    total, count = total or 0, count or 0
    edge = max(1.0, total / (shards * grain))
    large = groups.where(F.col("b") >= edge).orderBy("g", "g2").collect()  # at most shards * grain rows
    merged = (
        groups.where(F.col("b") < edge)
        .groupBy(F.pmod("g", F.lit(cells)).cast("int").alias("cell"))
        .agg(F.sum("b"), F.sum("t"), F.sum("r"))
        .orderBy("cell")
        .collect()
    )  # at most `cells` rows
    vectors, names = [], []
    pieces = {(g["g"], g["g2"]): min(g["r"], -(-g["b"] * FINE * shards // total)) if g["b"] * WHOLE * shards > total else 1 for g in large}
    cut = [(*k, n) for k, n in pieces.items() if n > 1]  # shards * WHOLE groups and shards * (WHOLE + FINE) pieces at most
    shares: dict = {}
    if cut:
        of_cut = F.broadcast(spark.createDataFrame(cut, "g long, g2 long, pieces long"))
        for x in rows.join(of_cut, ["g", "g2"]).groupBy("g", "g2", _piece("pieces").alias("p")).agg(F.count("*").alias("r")).collect():
            shares[x["g"], x["g2"], x["p"]] = x["r"]
    for g in large:
        for p in range(pieces[g["g"], g["g2"]]):
            share = shares.get((g["g"], g["g2"], p), 0) / g["r"] if pieces[g["g"], g["g2"]] > 1 else 1.0
            vectors.append((g["b"] * share, g["t"] * share, g["r"] * share))
            names.append((-1, g["g"], g["g2"], p, 1))
    for c in merged:
        vectors.append(tuple(map(float, c[1:])))
        names.append((c["cell"], 0, 0, 0, 1))
    shard = place(np.array(vectors, dtype=float).reshape(-1, 3), shards)
    placed = [(*n, int(s)) for n, s in zip(names, shard)]
    of_cell = spark.createDataFrame([(n[0], n[5]) for n in placed if n[0] >= 0] or [(-1, 0)], "cell int, cell_shard int")
    by_piece: dict = {}
    for _, g, g2, p, n, s in (x for x in placed if x[0] < 0):
        by_piece.setdefault((g, g2), []).append(s)
    of_group = spark.createDataFrame([(g, g2, s) for (g, g2), s in by_piece.items()] or [(0, 0, [0])], "g long, g2 long, homes array<int>")
    lot = F.xxhash64("doc_id", "size", "text_crc32")
    parts = int(min(4096, max(4, count // (shards * 20000))))
    homed = (
        rows.withColumn("cell", F.pmod("g", F.lit(cells)).cast("int"))
        .join(F.broadcast(of_group.withColumn("pieces", F.size("homes"))), ["g", "g2"], "left")
        .join(F.broadcast(of_cell), "cell", "left")
        .select(
            "doc_id", "size", "text_crc32", "tokens",
            F.coalesce(F.element_at("homes", _piece("pieces") + 1), "cell_shard").alias("shard"),
            F.pmod(lot, F.lit(parts)).cast("int").alias("part"),
        )
    )
    counts = homed.groupBy("shard", "part").count()  # shards * parts rows, at most 65,536
    starts = counts.select(
        "shard", "part", (F.sum("count").over(W.partitionBy("shard").orderBy("part")) - F.col("count")).alias("start")
    )
    rank = F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    return (
        homed.withColumn("rank", rank)
        .join(F.broadcast(starts), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", "tokens", "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"))
    )
