"""Quality rules: base limits, then robust multivariate outliers per language and source.

Each text becomes a few counts; rows that pass the base limits become transformed statistic vectors. For
each (language, source) group a minimum-covariance-determinant estimate (concentration steps from two
deterministic starts, the smaller determinant wins, then one reweighting step) gives location and scatter,
and rows are rejected by Mahalanobis distance. All estimates are grouped sums that combine before the
shuffle, over all rows; the half-sample of a step is cut at a bin of the log-distance histogram.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from . import tokens as K
from .common import materialize

#: Names of the statistic vector's parts.
DIMS = ("length", "word", "symbols", "lines", "repeats")
#: Spread below which a part counts as constant: a deviation of this size is never odd by itself.
FLOORS = (0.5, 0.08, 0.045, 0.10, 0.10)
#: Chance, under normality, of a squared Mahalanobis distance beyond which a row is rejected (about 49 in five parts).
TAIL = 1e-8
#: Groups of fewer rows share their language's estimate, small languages the overall one.
LEAST = 100
SUPPORT = 0.75
STEPS = 3
BINS = 16  # of the histogram, per doubling of the squared distance


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of whole texts.

    Words are runs other than ASCII white space. Null and empty texts count nothing. One text is in memory
    at a time beyond blocks of 1 MB.
    """

    def kernel(batches):
        import pyarrow as pa

        powers = K.Powers()
        symbol = np.zeros(256, dtype=bool)
        symbol[list(b"#*$%&|<>")] = True
        for batch in batches:
            raw, offsets = K.buffers(batch.column("text"))
            n = batch.num_rows
            out = {k: np.zeros(n, dtype=np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
            for lo, hi, buf, off in K.blocks(raw, offsets):
                inside = ~K.WHITE[buf]
                starts, ends, doc = K.runs(inside, off)
                cum = K.prefix(buf, powers)
                words = K.span_hash(cum, starts, ends, powers)
                out["n_words"][lo:hi] = np.bincount(doc, minlength=hi - lo)
                out["word_chars"][lo:hi] = K.per_text(inside & ((buf & 0xC0) != 0x80), off)
                out["n_symbols"][lo:hi] = K.per_text(symbol[buf], off)
                l_starts, l_ends, l_doc = K.runs(buf != 10, off)
                seen = np.zeros(len(buf) + 1, dtype=np.int64)
                np.cumsum(inside, out=seen[1:])
                full = seen[l_ends] > seen[l_starts]
                lines = K.mix(K.span_hash(cum, l_starts[full], l_ends[full], powers) + l_doc[full].astype(np.uint64) * K.SHINGLE[4])
                order = np.argsort(lines, kind="stable")
                again = np.zeros(len(lines), dtype=bool)
                again[order[1:]] = lines[order[1:]] == lines[order[:-1]]
                out["n_dup_lines"][lo:hi] = np.bincount(l_doc[full][again], minlength=hi - lo)
                triples, at = K.window_hash(words, doc, 3)
                triples = K.mix(triples + doc[at].astype(np.uint64) * K.SHINGLE[4])
                order = np.argsort(triples)
                equal = triples[order[1:]] == triples[order[:-1]]
                twice = np.zeros(len(triples), dtype=bool)
                twice[order[1:][equal]] = True
                twice[order[:-1][equal]] = True
                hit = np.zeros(len(words), dtype=bool)
                for k in range(3):
                    hit[at[twice] + k] = True
                out["n_repeat_words"][lo:hi] = np.bincount(doc[hit], minlength=hi - lo)
            names = ("doc_id", "lang", "source")
            yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in names} | {k: pa.array(v) for k, v in out.items()})

    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in ("doc_id", "lang", "source"))
    schema = f"{kinds}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    return docs.select("doc_id", "lang", "source", "text").mapInArrow(kernel, schema)


def _vector() -> Column:
    """Counts transformed so that clean text is roughly normal: logs of sizes, square roots of shares."""
    n = F.col("n_words").cast("double")
    return F.array(
        F.log(n), F.log(F.col("word_chars") / n), F.sqrt(F.col("n_symbols") / F.col("word_chars")),
        F.sqrt(F.least(F.col("n_dup_lines") / n * 10, F.lit(1.0))), F.sqrt(F.col("n_repeat_words") / n),
    )


def _solve(floors):
    """Arrow function: sums of a group -> location, inverse scatter, log determinant."""

    def kernel(frames):
        import pandas as pd

        d = len(floors)
        upper = [(i, j) for i in range(d) for j in range(i, d)]
        for f in frames:
            rows = []
            for n, s1, s2 in zip(f["n"], f["s1"], f["s2"]):
                mean = np.asarray(s1) / n
                cov = np.zeros((d, d))
                for (i, j), v in zip(upper, s2):
                    cov[i, j] = cov[j, i] = v / n - mean[i] * mean[j]
                cov[np.diag_indices(d)] = np.maximum(np.diag(cov), 0) + np.square(floors)
                rows.append((mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
            keys = f.drop(columns=["n", "s1", "s2"])
            yield pd.concat([keys.reset_index(drop=True), pd.DataFrame(rows, columns=["mean", "prec", "logdet"])], axis=1)

    return kernel


def _estimates(rows: DataFrame, keys: list[str], floors) -> DataFrame:
    d = len(DIMS)
    sums = rows.groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"),
        F.array(*[F.sum(F.col("x")[i]) for i in range(d)]).alias("s1"),
        F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(d) for j in range(i, d)]).alias("s2"),
    )
    kept = [f for f in sums.schema if f.name in keys]
    more = [T.StructField(k, T.ArrayType(T.DoubleType())) for k in ("mean", "prec")] + [T.StructField("logdet", T.DoubleType())]
    return sums.mapInPandas(_solve(floors), T.StructType(kept + more))


def _distance() -> Column:
    d = len(DIMS)
    dev = [F.col("x")[i] - F.col("mean")[i] for i in range(d)]
    return reduce(lambda a, b: a + b, [dev[i] * dev[j] * F.col("prec")[i * d + j] for i in range(d) for j in range(d)])


def _chi2(p: float, d: int) -> float:
    """Chi-square quantile (Wilson-Hilferty)."""
    from statistics import NormalDist

    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(p) * np.sqrt(2 / (9 * d))) ** 3


def _bin(c: Column) -> Column:
    return F.floor(F.log2(c + 1e-6) * BINS).cast("int")


def _cut(rows: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The histogram bin of the squared distance in which each group's ``share`` quantile lies."""
    count = rows.groupBy(*keys, _bin(F.col("d2")).alias("bin")).count()
    upto = F.sum("count").over(W.partitionBy(*keys).orderBy("bin"))
    whole = F.sum("count").over(W.partitionBy(*keys))
    return count.select(*keys, "bin", upto.alias("upto"), whole.alias("whole")).where(F.col("upto") >= share * F.col("whole")).groupBy(*keys).agg(F.min("bin").alias("cut"))


#: Group tables of up to this many rows (about 400 bytes each, two starts) are broadcast to the rows, larger ones joined by shuffle.
GROUPS = 8_000


def robust_estimates(rows: DataFrame, keys: list[str], floors=FLOORS, steps: int = STEPS, support: float = SUPPORT, groups: int = GROUPS + 1) -> DataFrame:
    """``keys, mean, prec`` by minimum covariance determinant over ``rows(keys, x)`` with ``groups`` keys."""
    hint = F.broadcast if groups <= GROUPS else (lambda x: x)
    d = len(DIMS)
    middle = rows.groupBy(*keys).agg(*[F.percentile_approx(F.col("x")[i], [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i in range(d)])
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(floors[i])) for i in range(d)]
    by_quartile = middle.select(
        *keys, F.lit(0).alias("start"), F.array(*[F.col(f"q{i}")[1] for i in range(d)]).alias("mean"),
        F.array(*[1 / spread[i] ** 2 if i == j else F.lit(0.0) for i in range(d) for j in range(d)]).alias("prec"), F.lit(0.0).alias("logdet"),
    )
    by_moment = _estimates(rows, keys, floors).select(*keys, F.lit(1).alias("start"), "mean", "prec", "logdet")
    fit = materialize(by_quartile.unionByName(by_moment), "mcd")
    k2 = [*keys, "start"]
    for _ in range(steps):
        far = rows.join(hint(fit), keys).withColumn("d2", _distance())
        half = far.join(hint(_cut(far, k2, support)), k2).where(_bin(F.col("d2")) <= F.col("cut"))
        fit = materialize(_estimates(half, k2, floors), "mcd")
    best = fit.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy("logdet", "start"))).where("r = 1").drop("r", "start")
    # consistency: scale so that the median distance is the chi-square median, then reweight once
    far = rows.join(hint(best), keys).withColumn("d2", _distance())
    scale = _cut(far, keys, 0.5).select(*keys, F.greatest(F.pow(F.lit(2.0), (F.col("cut") + 0.5) / BINS) / _chi2(0.5, d), F.lit(1.0)).alias("scale"))
    near = far.join(hint(scale), keys).where(F.col("d2") <= F.col("scale") * _chi2(0.99, d))
    return materialize(_estimates(near, keys, floors).drop("logdet"), "mcd")


def rate(docs: DataFrame, tail: float = TAIL, least: int = LEAST) -> DataFrame:
    """One row per input row: the statistics, ``base_failed``, ``distance`` (null where the base failed) and ``kept``.

    Base: fewer than 50 words, or more than half of the words in three-word windows that occur twice or more.
    Null languages and sources are groups of their own; tables too small for any estimate reject nothing by
    distance. Repeated rows keep their rows; extra columns are ignored.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = statistics(docs).withColumn("base_failed", failed)
    rows = materialize(rows.withColumn("x", F.when(~F.col("base_failed"), _vector())), "rules")
    rows = rows.withColumns({"g_lang": F.coalesce("lang", F.lit("\0")), "g_source": F.coalesce("source", F.lit("\0"))})
    good = rows.where("not base_failed").select("g_lang", "g_source", "x")
    # a group with too few rows is estimated with its language, a small language with all
    sizes = good.groupBy("g_lang", "g_source").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("of_lang", F.sum("n").over(W.partitionBy("g_lang")))
    level = F.when(F.col("n") >= least, F.struct(F.col("g_lang").alias("a"), F.col("g_source").alias("b"))).when(
        F.col("of_lang") >= least, F.struct(F.col("g_lang").alias("a"), F.lit("\0\0").alias("b"))
    ).otherwise(F.struct(F.lit("\0\0").alias("a"), F.lit("\0\0").alias("b")))
    sizes = materialize(sizes.withColumn("k", level).select("g_lang", "g_source", F.col("k.a").alias("a"), F.col("k.b").alias("b")), "rules-groups")
    # such a level is estimated from all rows of the language or of the table, not from its small groups alone
    needed = sizes.select("a", "b").distinct()
    levels = sizes.select("g_lang", "g_source").withColumn("at", F.explode(F.array(
        F.struct(F.col("g_lang").alias("a"), F.col("g_source").alias("b")), F.struct(F.col("g_lang").alias("a"), F.lit("\0\0").alias("b")), F.struct(F.lit("\0\0").alias("a"), F.lit("\0\0").alias("b")),
    ))).select("g_lang", "g_source", "at.a", "at.b")
    levels = materialize(levels.join(needed, ["a", "b"], "left_semi"), "rules-levels")
    groups = levels.count()
    hint = F.broadcast if groups <= GROUPS else (lambda x: x)
    good = good.join(hint(levels), ["g_lang", "g_source"]).select("a", "b", "x")
    fit = robust_estimates(good, ["a", "b"], groups=groups)
    fit = sizes.join(fit, ["a", "b"]).select("g_lang", "g_source", "mean", "prec")
    out = rows.join(hint(fit), ["g_lang", "g_source"], "left").withColumn("distance", F.when(~F.col("base_failed") & F.col("mean").isNotNull(), _distance()))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= _chi2(1 - tail, len(DIMS)))).alias("kept"), "distance", "lang", "source",
    )
