"""Benchmark decontamination: a broadcast set of normalised test n-grams scans the documents' token windows.

DataFrame operators only. A document position is looked up only at aligned grams: a window of ``m``
words holds a gram of ``g`` words at some position divisible by ``m - g + 1``, so one lookup in
``m - g + 1`` words finds every window. The windows around a found gram are then verified as whole
strings against the benchmark's windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import OWN, materialize, small

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Benchmark window tables up to this many rows are broadcast (about 100 bytes each); larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, BREAK), lambda w: w != "")


def windows_of(benchmark: DataFrame, n: int) -> DataFrame:
    """``(item_id, m, key)``: each item's windows of ``n`` words; a shorter item is one window of all its words."""
    w = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where("size(w) > 0")
    w = w.withColumn("m", F.least(F.size("w"), F.lit(n)))
    at = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("at")
    return w.select("item_id", "m", "w", at).select("item_id", "m", F.array_join(F.expr("slice(w, at, m)"), " ").alias("key")).distinct()


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, only_hits: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, th`` (hash of the text), ``n_words, n_hit, items`` (ids as sorted
    strings) and ``hits`` (start and length, in words, of each occurrence). ``only_hits`` leaves out rows without any, so
    that nothing else is shuffled. Extra columns are ignored.

    A word inside any occurrence of a benchmark window counts once in ``n_hit``. Null and wordless
    texts have no words; wordless items have no window; repeated rows and null ids keep their rows;
    an empty benchmark hits nothing.
    """
    windows = materialize(windows_of(benchmark, n), "bench-windows")
    per_m = {r["m"]: r["n"] for r in windows.groupBy("m").agg(F.count("*").alias("n")).collect()}  # at most n rows
    small = sum(per_m.values()) <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda d: d)
    keyed = windows.groupBy("key").agg(F.collect_set(F.col("item_id").cast("string")).alias("of_items"), F.first("m").alias("win_m"))
    # aligned grams of every window length that occurs: (m, g, step)
    plans = [(m, g := (3 if m >= 4 else 1), m - g + 1) for m in sorted(per_m)]
    grams = None
    for m, g, _ in plans:
        one = windows.where(F.col("m") == m).select(
            F.explode(F.expr(f"transform(sequence(1, {m - g + 1}), i -> array_join(slice(split(key, ' '), i, {g}), ' '))")).alias("gram")
        ).select(F.lit(m).alias("gm"), "gram")
        grams = one if grams is None else grams.unionByName(one)
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), words_of(F.col("text")).alias("w")).withColumn("row", F.monotonically_increasing_id())
    none = "array()" if only_hits and plans else "array(named_struct('at', -1, 'gm', cast(-1 as int), 'gram', cast(null as string)))"
    probes = [none] if none != "array()" else []
    for m, g, step in plans:
        take = ", ".join(f"element_at(w, i * {step} + {k})" for k in range(1, g + 1))
        last = f"cast(floor((size(w) - {g}) / {step}) as int)"
        probes.append(
            f"if(size(w) >= {m}, transform(sequence(0, {last}), i -> named_struct('at', i * {step}, 'gm', {m}, 'gram', concat_ws(' ', {take}))), "
            "cast(array() as array<struct<at:int,gm:int,gram:string>>))"
        )
    rows = base.select("row", "doc_id", "th", F.size("w").cast("long").alias("n_words"), "w", F.inline(F.expr(f"concat({', '.join(probes)})")))
    if plans:
        known = grams.distinct().withColumn("known", F.lit(True))
        rows = rows.join(hint(known), ["gm", "gram"], "left").where("at = -1 or known")
        near = " ".join(
            f"when gm = {m} then filter(transform(sequence(greatest(at - {m - g}, 0), least(at, size(w) - {m})), "
            f"s -> named_struct('s', s, 'key', array_join(slice(w, s + 1, {m}), ' '))), x -> x.s >= 0)"
            for m, g, _ in plans
        )
        rows = rows.withColumn("c", F.expr(f"case when at = -1 then array(named_struct('s', -1, 'key', cast(null as string))) {near} end"))
        rows = rows.select("row", "doc_id", "th", "n_words", F.inline("c")).join(hint(keyed), "key", "left").where("s = -1 or of_items is not null")
        hit = F.when(F.col("s") >= 0, F.struct("s", F.col("win_m").alias("m")))
        ids = F.col("of_items")
    else:
        hit, ids = F.lit(None).cast("struct<s:int,m:int>"), F.lit(None).cast("array<string>")
    per_doc = rows.groupBy("row", "doc_id", "th", "n_words").agg(F.collect_set(hit).alias("hits"), F.collect_set(ids).alias("ids"))
    covered = F.expr("size(array_distinct(flatten(transform(hits, h -> sequence(h.s, h.s + h.m - 1)))))")
    return per_doc.select(
        "doc_id", "th", "n_words", covered.cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten("ids"))).alias("items"), F.array_sort("hits").alias("hits"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents (``mode='documents'``) or with the hit words blanked out of the text
    (``mode='spans'``: the words of each occurrence and what stands between them become one space). Extra columns pass through, whatever they are called."""
    found = scan(docs, benchmark, n, only_hits=True).where("n_hit > 0")
    place = docs.withColumn(f"{OWN}h", F.xxhash64("text"))
    on = F.col("doc_id").eqNullSafe(F.col(f"{OWN}d")) & (F.col(f"{OWN}h") == F.col(f"{OWN}t"))
    # hit documents by id and text hash: rows alike in both are hit alike, and whole rows are never a key
    if mode == "documents":
        hit = materialize(found.select(F.col("doc_id").alias(f"{OWN}d"), F.col("th").alias(f"{OWN}t")).distinct(), "bench-hit")
        return place.join(small(hit), on, "left_anti").select(*docs.columns)
    hit = found.groupBy(F.col("doc_id").alias(f"{OWN}d"), F.col("th").alias(f"{OWN}t")).agg(F.first("hits").alias(f"{OWN}hits"))
    hit = materialize(hit, "bench-hit")
    marked = place.join(hit, on, "left")
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]*"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    pieces = F.expr(f"regexp_extract_all(coalesce(text, ''), '{gap}{word}', 0)".replace("\\", "\\\\"))
    rest = F.expr(f"regexp_extract(coalesce(text, ''), '{gap}$', 0)".replace("\\", "\\\\"))
    hit = F.expr(f"array_distinct(flatten(transform({OWN}hits, h -> sequence(h.s, h.s + h.m - 1))))")
    kept = F.transform(F.col(f"{OWN}p"), lambda x, i: F.when(F.array_contains(f"{OWN}w", i), F.lit(" ")).otherwise(x))
    cleaned = F.concat(F.regexp_replace(F.array_join(kept, ""), " {2,}", " "), rest)
    out = marked.withColumns({f"{OWN}p": pieces, f"{OWN}w": hit})
    return out.withColumn("text", F.when(F.col(f"{OWN}hits").isNotNull(), cleaned).otherwise(F.col("text"))).select(*docs.columns)
