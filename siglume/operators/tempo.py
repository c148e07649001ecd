"""Tempo: autocorrelation, candidates, stability, beat grid, downbeats, rhythm grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from siglume.functions.scalars import lags_agree, tempo_prior


def autocorrelation(env: DataFrame, key: str, low: int, high: int, rate: float) -> DataFrame:
    """``key, lag, clarity, weighted``: mean-removed, length-unbiased, normalised by the variance, clamped to 0..1,
    and weighted by the tempo prior. Signals without variance or shorter than the longest lag plus 2 have no rows."""
    whole, d = W.partitionBy(key), F.col("d")
    c = env.where(F.col(key).isNotNull()).withColumns({"mean": F.avg("x").over(whole), "n": F.count("*").over(whole)}).where(F.col("n") > high + 1)
    c = c.select(key, "i", "n", (F.col("x") - F.col("mean")).alias("d")).withColumn("ac0", F.sum(d * d).over(whole)).where("ac0 > 2.220446049250313e-16")
    # later samples come from a window of the signal, not from a join on the place: that would deal out each sample once for every lag
    later = F.collect_list(F.struct("i", "d")).over(whole.orderBy("i").rangeBetween(low, high))
    pairs = c.withColumn("later", later).select(key, "n", "ac0", "i", "d", F.explode("later").alias("b"))
    out = pairs.groupBy(key, (F.col("b.i") - F.col("i")).alias("lag"), "n", "ac0").agg(F.sum(d * F.col("b.d")).alias("s"))
    clarity = F.least(F.greatest(F.col("s") * F.col("n") / (F.col("ac0") * (F.col("n") - F.col("lag"))), F.lit(0.0)), F.lit(1.0))
    out = out.withColumn("clarity", clarity)
    return out.select(key, F.col("lag").cast("long").alias("lag"), "clarity", (F.col("clarity") * tempo_prior(rate * 60.0 / F.col("lag"))).alias("weighted"))


def candidates(ac: DataFrame, key: str, most: int = 3, apart: float = 0.10) -> DataFrame:
    """Winner (largest weighted value, lowest lag of equals), then weighted local maxima in falling order that are more
    than ``apart`` of every accepted lag away: ``key, rank, lag, clarity``."""
    w = W.partitionBy(key).orderBy("lag")
    m = ac.withColumns({"p": F.lag("weighted").over(w), "n": F.lead("weighted").over(w)})
    peak = (F.col("weighted") > 0) & (F.col("p").isNull() | (F.col("weighted") >= F.col("p"))) & (F.col("n").isNull() | (F.col("weighted") > F.col("n")))
    item = F.struct((-F.col("weighted")).alias("w"), "lag", "clarity")
    per = m.groupBy(key).agg(F.min(item).alias("best"), F.sort_array(F.collect_list(F.when(peak, item))).alias("maxima")).where("best.w < 0")

    def step(acc, c):
        far = F.forall(acc, lambda a: F.abs(c["lag"] - a["lag"]) / a["lag"] > apart)
        return F.when((F.size(acc) < most) & far, F.concat(acc, F.array(c))).otherwise(acc)

    picked = F.aggregate("maxima", F.array("best"), step)
    return per.select(key, F.posexplode(picked).alias("rank", "c")).select(key, F.col("rank").cast("long").alias("rank"), "c.lag", "c.clarity")


def best_lag(ac: DataFrame, key: str) -> DataFrame:
    return ac.groupBy(key).agg(F.min(F.struct((-F.col("weighted")).alias("w"), "lag")).alias("b")).where("b.w < 0").select(key, F.col("b.lag").alias("lag"))


def stability(env: DataFrame, n: int, low: int, high: int, rate: float, most: int = 4) -> DataFrame:
    """Share of equal chunks whose best lag agrees with the whole signal's, octaves folded; null below two chunks."""
    chunks = min(most, n // (high + 2))
    whole = best_lag(autocorrelation(env.withColumn("k", F.lit(0)), "k", low, high, rate), "k").select(F.col("lag").alias("whole"))
    if chunks < 2:
        return whole.select(F.lit(None).cast("double").alias("stability"))
    size = n // chunks
    parts = env.where(F.col("i") < chunks * size).withColumns({"k": F.floor(F.col("i") / size), "i": F.pmod("i", F.lit(size))})
    each = best_lag(autocorrelation(parts, "k", low, high, rate), "k")
    return each.crossJoin(F.broadcast(whole)).agg((F.count_if(lags_agree(F.col("lag"), F.col("whole"))) / F.lit(float(chunks))).alias("stability"))


def beat_grid(env: DataFrame, key: str, period: int, penalty: float = 400.0) -> DataFrame:
    """``key, beat, i`` by dynamic programming over the envelope in unit deviations; one signal at a time."""

    def kernel(f):
        import numpy as np
        import pandas as pd

        f = f.sort_values("i")
        x = f["x"].to_numpy(dtype=float)
        n, sd = len(x), x.std()
        if n == 0 or sd * sd <= np.finfo(float).eps:
            return pd.DataFrame({key: [], "beat": [], "i": []})
        x = x / sd
        score, back = np.zeros(n), np.full(n, -1)
        half = max(1, int(period / 2 + 0.5))
        for t in range(n):
            lo, hi = max(0, t - 2 * period), t - half
            gain = 0.0
            if hi >= lo:
                tau = np.arange(lo, hi + 1)
                cand = score[lo : hi + 1] - penalty * np.log((t - tau) / period) ** 2
                k = int(np.argmax(cand))
                if cand[k] > 0:
                    gain, back[t] = cand[k], tau[k]
            score[t] = x[t] + gain
        at, beats = int(np.argmax(score)), []
        while at >= 0:
            beats.append(at)
            at = int(back[at])
        beats.reverse()
        return pd.DataFrame({key: f[key].iloc[0], "beat": np.arange(len(beats)), "i": f["i"].to_numpy()[beats]})

    kind = env.schema[key].dataType.simpleString()
    return env.select(key, "i", "x").groupBy(key).applyInPandas(kernel, f"{key} {kind}, beat long, i long")


def grid_points(onsets: DataFrame, beats: DataFrame, key: str, width: float = 1000.0) -> DataFrame:
    """Each onset time against grids of 4 and 3 points a beat: ``key, t, subdivisions, aligned, offbeat``.

    Beats become intervals, with one more of the neighbour's length at either end; the last end is inclusive.
    Onsets meet only intervals that reach into their own bucket of ``width`` of their own signal: an equi-join.
    """
    w = W.partitionBy(key).orderBy("t")
    b = beats.withColumns({"nx": F.lead("t").over(w), "pv": F.lag("t").over(w)})
    t, nx, pv = F.col("t"), F.col("nx"), F.col("pv")
    span = lambda there, a, b, last: F.when(there, F.struct(a.alias("a"), b.alias("b"), F.lit(last).alias("last")))
    mid, tail = span(nx.isNotNull(), t, nx, False), span(nx.isNull() & pv.isNotNull(), t, 2 * t - pv, True)
    head = span(pv.isNull() & nx.isNotNull(), 2 * t - nx, t, False)
    spans = b.select(key, F.explode(F.array_compact(F.array(mid, tail, head))).alias("s")).select(key, "s.*").where("b > a")
    bucket = lambda c: F.floor(c / width)
    spans = spans.withColumn("_k", F.explode(F.sequence(bucket(F.col("a")), bucket(F.col("b")))))
    hit = onsets.withColumn("_k", bucket(F.col("t"))).join(spans, [key, "_k"]).where((F.col("t") >= F.col("a")) & ((F.col("t") < F.col("b")) | (F.col("last") & (F.col("t") == F.col("b")))))
    hit = hit.withColumn("subdivisions", F.explode(F.array(F.lit(4), F.lit(3))))
    sub = (F.col("b") - F.col("a")) / F.col("subdivisions")
    pos = (F.col("t") - F.col("a")) / sub
    near = F.round(pos)
    ok = F.abs(pos - near) * sub <= F.greatest(0.15 * sub, F.lit(10.0))
    return hit.select(key, "t", "subdivisions", ok.alias("aligned"), (ok & (F.pmod(near, F.col("subdivisions")) != 0)).alias("offbeat"))


def grid_choice(points: DataFrame, key: str) -> DataFrame:
    """``key, four, three, grid``: aligned onsets on both grids; triplets win only where they fit more."""
    hit = points.groupBy(key).agg(
        F.count_if((F.col("subdivisions") == 4) & F.col("aligned")).alias("four"), F.count_if((F.col("subdivisions") == 3) & F.col("aligned")).alias("three")
    )
    return hit.withColumn("grid", F.when(F.col("three") > F.col("four"), "triplet").otherwise("straight"))
