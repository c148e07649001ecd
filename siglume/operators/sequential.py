"""Operators with a true sequential dependency, as Arrow kernels that carry only the state from row to row.

Rows are dealt by signal and sorted inside the partitions; a kernel walks the batches of its partition, starts anew at each
signal and never holds a whole one, so a signal of any length takes linear time and constant memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window as W, functions as F


def carried(df: DataFrame, key: str, order: list[str], columns: list[str], start: Callable, out: str) -> DataFrame:
    """Walks each key's rows in ``order``. ``start()`` gives ``(feed, flush)``: ``feed(*columns)`` and ``flush()`` return lists of
    rows of ``out`` (a schema without the key); ``flush`` is called after the key's last row."""
    kind = df.schema[key].dataType.simpleString()
    names = [key, *[c.split()[0] for c in out.split(", ")]]
    rows = df.select(*dict.fromkeys([key, *order, *columns])).repartition(key).sortWithinPartitions(key, *order)
    schema = f"{key} {kind}, {out}"
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)

    def kernel(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(target)
        at, feed, flush, begun = None, None, None, False
        for batch in batches:
            keys = batch.column(key).to_pylist()
            values = list(zip(*(batch.column(c).to_pylist() for c in columns)))
            got: list[tuple] = []
            for k, v in zip(keys, values):
                if not begun or k != at:
                    if begun:
                        got += [(at, *r) for r in flush()]
                    at, begun = k, True
                    feed, flush = start()
                got += [(k, *r) for r in feed(*v)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*got), shape)], names=names)
        if begun and (got := [(at, *r) for r in flush()]):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*got), shape)], names=names)

    return rows.mapInArrow(kernel, schema)


def limiter(sig: DataFrame, key: str, ceiling: float, lookahead: int, keep: float) -> DataFrame:
    """``key, i, gain``: the gain recovers toward 1 (the gap shrinks by ``keep``) but never exceeds what the peak within
    the lookahead allows."""
    ahead = F.max(F.abs("x")).over(W.partitionBy(key).orderBy("i").rowsBetween(0, lookahead))
    need = sig.withColumn("pk", ahead).select(key, "i", F.when(F.col("pk") > ceiling, ceiling / F.col("pk")).otherwise(1.0).alias("need"))

    def start():
        gain = 1.0

        def feed(i, most):
            nonlocal gain
            gain = min(1 - (1 - gain) * keep, most)
            return ((i, gain),)

        return feed, lambda: ()

    return carried(need, key, ["i"], ["i", "need"], start, "i long, gain double")


def suppress(peaks: DataFrame, key: str, min_gap: int) -> DataFrame:
    """Non-maximum suppression of ``key, i, f``: a peak within the gap of the current best joins it, and moves it if stronger;
    otherwise it starts a new one."""

    def start():
        best = None

        def feed(i, f):
            nonlocal best
            if best is None or i - best[0] > min_gap:
                out, best = ([] if best is None else [best]), (i, f)
                return out
            if f > best[1]:
                best = (i, f)
            return ()

        return feed, lambda: [best]

    return carried(peaks, key, ["i"], ["i", "f"], start, "i long, f double")


def bridge(df: DataFrame, key: str, label: str) -> DataFrame:
    """One-frame repair, left to right in place: a frame between equal neighbours takes their label, and the next
    frame sees it. Null labels stay."""

    def start():
        before, here = None, None

        def feed(i, v):
            nonlocal before, here
            out = ()
            if here is not None:
                at, cur = here
                if before is not None and before == v:
                    cur = v
                out, before = ((at, cur),), cur
            here = (i, v)
            return out

        return feed, lambda: [here]

    kind = df.schema[label].dataType.simpleString()
    return carried(df, key, ["i"], ["i", label], start, f"i long, {label} {kind}")


def greedy_pairs(near: DataFrame, key: str, a: str, b: str, distance: str) -> DataFrame:
    """One-to-one choice among candidate pairs, nearest first (then ``a``, then ``b``): ``key, a, b``. Holds the values of one
    key that are taken."""

    def start():
        left, right = set(), set()

        def feed(x, y):
            if x in left or y in right:
                return ()
            left.add(x)
            right.add(y)
            return ((x, y),)

        return feed, lambda: ()

    kinds = [near.schema[c].dataType.simpleString() for c in (a, b)]
    return carried(near, key, [distance, a, b], [a, b], start, f"{a} {kinds[0]}, {b} {kinds[1]}")


def biquads(sig: DataFrame, key: str, stages: list[tuple[tuple, tuple]]) -> DataFrame:
    """``key, i, y``: second-order filters one after the other; the state is two numbers a stage (transposed form)."""

    def start():
        state = [[0.0, 0.0] for _ in stages]

        def feed(i, v):
            for s, ((b0, b1, b2), (_, a1, a2)) in zip(state, stages):
                y = b0 * v + s[0]
                s[0], s[1] = b1 * v - a1 * y + s[1], b2 * v - a2 * y
                v = y
            return ((i, v),)

        return feed, lambda: ()

    return carried(sig, key, ["i"], ["i", "x"], start, "i long, y double")


def true_peak(sig: DataFrame, key: str, up: int = 4, length: int = 48) -> DataFrame:
    """``key, true_peak``: largest absolute value after oversampling by a windowed sinc, on whole windows of samples alone."""
    taps = length // up
    w = W.partitionBy(key).orderBy("i").rowsBetween(-(taps - 1), 0)
    s = sig.withColumn("_w", F.collect_list("x").over(w))
    peak = F.abs("x")
    for phase in range(1, up):
        h = phase_taps(phase, up, taps)
        dot = F.aggregate(F.zip_with("_w", F.array(*[F.lit(v) for v in h]), lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
        peak = F.greatest(peak, F.when(F.size("_w") == taps, F.abs(dot)).otherwise(0.0))
    return s.groupBy(key).agg(F.max(peak).alias("true_peak"))


def phase_taps(phase: int, up: int, taps: int) -> list[float]:
    """Weights of one phase for samples from the oldest to the newest: a sinc under a Hann window, of sum 1."""
    k = [j - taps / 2 + phase / up for j in range(taps)]
    sinc = [1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x) for x in k]
    h = [s * (0.5 - 0.5 * math.cos(2 * math.pi * (j + 1) / (taps + 1))) for j, s in enumerate(sinc)]
    total = sum(h)
    return [v / total for v in reversed(h)]
