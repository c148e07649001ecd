"""Spectral operators over frames: transforms, bands, chroma, keys, chords, cepstra, self-similarity, novelty."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: Krumhansl-Kessler key profiles from the tonic up (fixed values).
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
#: Chord qualities in order of preference and their intervals (fixed values).
CHORDS = (
    ("maj", (0, 4, 7)), ("min", (0, 3, 7)), ("dim", (0, 3, 6)), ("aug", (0, 4, 8)),
    ("sus4", (0, 5, 7)), ("7", (0, 4, 7, 10)), ("maj7", (0, 4, 7, 11)), ("m7", (0, 3, 7, 10)),
)


def hann(n: int, periodic: bool = False) -> list[float]:
    """Hann window; the symmetric form divides by n - 1, the periodic one by n."""
    by = n if periodic else max(n - 1, 1)
    return [0.5 - 0.5 * math.cos(2 * math.pi * k / by) for k in range(n)]


def dft_magnitudes(frames: DataFrame, size: int) -> DataFrame:
    """``frame, bin, mag`` by joining each frame's values with the (fixed-size) table of windowed basis values."""
    w = hann(size)
    basis = [(j, b, w[j] * math.cos(2 * math.pi * b * j / size), -w[j] * math.sin(2 * math.pi * b * j / size)) for j in range(size) for b in range(size // 2 + 1)]
    table = F.broadcast(frames.sparkSession.createDataFrame(basis, "j int, bin int, re double, im double"))
    x = frames.select("frame", F.posexplode("v").alias("j", "x")).join(table, "j")
    s = x.groupBy("frame", "bin").agg(F.sum(F.col("x") * F.col("re")).alias("re"), F.sum(F.col("x") * F.col("im")).alias("im"))
    return s.select("frame", F.col("bin").cast("long").alias("bin"), F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("mag"))


def fft_magnitudes(frames: DataFrame) -> DataFrame:
    """The same through a vectorised transform in Arrow batches: the form to use on real signals."""

    def kernel(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            values = batch.column("v")
            if not batch.num_rows:
                continue
            x = values.values.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            mag = np.abs(np.fft.rfft(x * np.hanning(x.shape[1]), axis=1))
            n = mag.shape[1]
            yield pa.RecordBatch.from_pydict({
                "frame": pa.array(np.repeat(batch.column("frame").to_numpy(), n)), "bin": pa.array(np.tile(np.arange(n), batch.num_rows)), "mag": pa.array(mag.ravel()),
            })

    return frames.select("frame", "v").mapInArrow(kernel, "frame long, bin long, mag double")


def band_fractions(bins: DataFrame, edges: tuple[int, int], key: str = "frame") -> DataFrame:
    """Energy shares below the first edge, up to the second (inclusive) and above; all 0 without energy."""
    e = F.col("m") * F.col("m")
    s = bins.groupBy(key).agg(
        F.sum(F.when(F.col("bin") < edges[0], e).otherwise(0.0)).alias("low"), F.sum(F.when(F.col("bin").between(*edges), e).otherwise(0.0)).alias("mid"),
        F.sum(F.when(F.col("bin") > edges[1], e).otherwise(0.0)).alias("high"),
    )
    total = F.col("low") + F.col("mid") + F.col("high")
    return s.select(key, *[F.coalesce(F.try_divide(c, total), F.lit(0.0)).alias(c) for c in ("low", "mid", "high")])


def centroid(bins: DataFrame, hz: Column, floor: float = 1e-9) -> DataFrame:
    s = bins.groupBy("frame").agg(F.sum("m").alias("m"), F.sum(F.col("m") * hz).alias("w"))
    return s.select("frame", F.when(F.col("m") > floor, F.col("w") / F.col("m")).alias("centroid"))


def pitch_class(hz: Column) -> Column:
    return F.pmod(F.round(69 + 12 * F.log2(hz / 440)), F.lit(12)).cast("long")


def chroma(bins: DataFrame, hz: Column, key: str = "frame", low: float = 55.0, high: float = 5000.0) -> DataFrame:
    return bins.withColumn("hz", hz).where(F.col("hz").between(low, high)).groupBy(key, pitch_class(F.col("hz")).alias("pc")).agg(F.sum("m").alias("c"))


def vectors(pcs: DataFrame, key: str) -> DataFrame:
    """``key, chroma``: twelve sums, 0 where a class is absent."""
    return pcs.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("pc") == k, F.col("c"))), F.lit(0.0)).alias(f"c{k}") for k in range(12)]).select(
        key, F.array(*[f"c{k}" for k in range(12)]).alias("chroma")
    )


def key_templates(spark: SparkSession) -> DataFrame:
    rows = [(t, m, [p[(k - t) % 12] for k in range(12)]) for t in range(12) for m, p in ((0, MAJOR), (1, MINOR))]
    return F.broadcast(spark.createDataFrame(rows, "tonic long, mode long, profile array<double>"))


def key_estimate(chromas: DataFrame, key: str) -> DataFrame:
    """Best of 24 Pearson correlations; ties go to the lower tonic, then major. Flat chroma: C major, 0."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)

    dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))
    x, y = F.col("chroma"), F.col("profile")
    both = chromas.join(key_templates(chromas.sparkSession))
    vx, vy = dot(x, x) - total(x) * total(x) / 12, dot(y, y) - total(y) * total(y) / 12
    r = F.when((vx > 1e-12) & (vy > 1e-12), (dot(x, y) - total(x) * total(y) / 12) / F.sqrt(F.greatest(vx, F.lit(1e-300)) * vy)).otherwise(0.0)
    scored = both.withColumn("r", F.round(r, 9))
    return scored.groupBy(key).agg(F.min(F.struct((-F.col("r")).alias("n"), "tonic", "mode")).alias("b")).select(key, "b.tonic", "b.mode", (-F.col("b.n")).alias("confidence"))


def chord_templates(spark: SparkSession) -> DataFrame:
    rows = [(q, i, root, len(tones), [1.0 if (k - root) % 12 in tones else 0.0 for k in range(12)]) for i, (q, tones) in enumerate(CHORDS) for root in range(12)]
    return F.broadcast(spark.createDataFrame(rows, "quality string, q_ord long, root long, tones long, shape array<double>"))


def chord_labels(chromas: DataFrame, key: str, least: float = 0.6, presence: float = 0.4, margin: float = 0.06) -> DataFrame:
    """Template match: every tone present at ``presence`` of the largest class and cosine at least ``least``; of those
    within ``margin`` of the best the one of fewest tones, then largest cosine, then quality and root order. Frames
    without a match have no row."""
    t = chromas.join(chord_templates(chromas.sparkSession))
    top = F.array_max("chroma")
    dot = F.aggregate(F.zip_with("chroma", "shape", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(F.aggregate("chroma", F.lit(0.0), lambda s, v: s + v * v))
    cos = F.round(dot / (norm * F.sqrt(F.col("tones"))), 9)
    there = F.forall(F.zip_with("chroma", "shape", lambda c, s: F.struct(c.alias("c"), s.alias("s"))), lambda z: (z["s"] == 0) | (z["c"] >= presence * top))
    good = t.where((top > 0) & there).withColumn("cosine", cos).where(F.col("cosine") >= least)
    best = F.max("cosine").over(W.partitionBy(key))
    near = good.withColumn("best", best).where(F.col("cosine") >= F.col("best") - margin)
    pick = F.min(F.struct("tones", (-F.col("cosine")).alias("n"), "q_ord", "root", "quality", "cosine"))
    return near.groupBy(key).agg(pick.alias("p")).select(key, "p.root", "p.quality", "p.cosine")


def mel_table(bands: int, bins: int, rate: float) -> list[tuple[int, int, float]]:
    """Triangular filters over continuous frequency, HTK mel spacing: ``(band, bin, weight)``."""
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    low, high = mel(20.0), mel(min(16000.0, rate / 2))
    edges = [hz(low + (high - low) * k / (bands + 1)) for k in range(bands + 2)]
    out = []
    for b in range(bands):
        for j in range(bins):
            f = j * rate / (2 * (bins - 1))
            w = min((f - edges[b]) / (edges[b + 1] - edges[b]), (edges[b + 2] - f) / (edges[b + 2] - edges[b + 1]))
            if w > 0:
                out.append((b, j, w))
    return out


def dct_table(bands: int, count: int) -> list[tuple[int, int, float]]:
    """Orthonormal DCT-II: ``(coefficient, band, weight)``."""
    return [(c, b, math.sqrt((1 if c == 0 else 2) / bands) * math.cos(math.pi * c * (b + 0.5) / bands)) for c in range(count) for b in range(bands)]


def cepstra(bins: DataFrame, rate: float = 48000.0, bands: int = 26, count: int = 13, size: int = 64) -> DataFrame:
    """``frame, c, v``: DCT of log mel power, floored at 1e-8 of the frame's largest band and 1e-10."""
    spark = bins.sparkSession
    mel = F.broadcast(spark.createDataFrame(mel_table(bands, size, rate), "band int, bin long, w double"))
    dct = F.broadcast(spark.createDataFrame(dct_table(bands, count), "c int, band int, k double"))
    all_bands = F.broadcast(spark.range(bands).select(F.col("id").cast("int").alias("band")))
    power = bins.join(mel, "bin").groupBy("frame", "band").agg(F.sum(F.col("w") * F.col("m") * F.col("m")).alias("p"))
    grid = bins.select("frame").distinct().join(all_bands).join(power, ["frame", "band"], "left").fillna({"p": 0.0})
    floor = F.greatest(F.max("p").over(W.partitionBy("frame")) * 1e-8, F.lit(1e-10))
    logs = grid.withColumn("l", F.log(F.greatest(F.col("p"), floor)))
    return logs.join(dct, "band").groupBy("frame", "c").agg(F.sum(F.col("k") * F.col("l")).alias("v"))


def self_similarity(frames: DataFrame, band: int) -> DataFrame:
    """``i, j, sim`` for 0 <= j - i <= band: cosine clamped to 0..1, 0 for zero frames. Frames meet by block of
    ``band + 1``, so the band join is an equi-join."""
    size = band + 1
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    f = frames.select("frame", "v", norm.alias("n"))
    a = f.select(F.col("frame").alias("i"), F.col("v").alias("vi"), F.col("n").alias("ni"), F.explode(F.array(F.floor(F.col("frame") / size), F.floor(F.col("frame") / size) + 1)).alias("blk"))
    b = f.select(F.col("frame").alias("j"), F.col("v").alias("vj"), F.col("n").alias("nj"), F.floor(F.col("frame") / size).alias("blk"))
    dot = F.aggregate(F.zip_with("vi", "vj", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    sim = F.when((F.col("ni") > 0) & (F.col("nj") > 0), F.least(F.greatest(dot / (F.col("ni") * F.col("nj")), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return a.join(b, "blk").where((F.col("j") >= F.col("i")) & (F.col("j") - F.col("i") <= band)).select("i", "j", sim.alias("sim"))


def checkerboard(half: int, sigma: float) -> list[tuple[int, int, float]]:
    out = []
    for u in range(-half, half):
        for v in range(-half, half):
            x, y = u + 0.5, v + 0.5
            out.append((u, v, (1 if (u < 0) == (v < 0) else -1) * math.exp(-(x * x + y * y) / (2 * sigma * sigma))))
    return out


def novelty(sim: DataFrame, n: int, half: int = 8, sigma: float = 4.0) -> DataFrame:
    """``t, nov``: the checkerboard kernel slid along the diagonal; places nearer than ``half`` to an end have none."""
    kernel = F.broadcast(sim.sparkSession.createDataFrame([k for k in checkerboard(half, sigma) if k[1] >= k[0]], "u int, v int, w double"))
    k = kernel.withColumn("gap", F.col("v") - F.col("u")).withColumn("w", F.when(F.col("gap") == 0, F.col("w")).otherwise(2 * F.col("w")))
    s = sim.withColumn("gap", (F.col("j") - F.col("i")).cast("int")).join(k, "gap").withColumn("t", F.col("i") - F.col("u"))
    return s.where((F.col("t") >= half) & (F.col("t") <= n - half)).groupBy("t").agg(F.sum(F.col("w") * F.col("sim")).alias("nov"))
