"""Line deduplication by a deletion-neighbourhood join (edit bound 1, in characters).

Two lines within one edit share a string that each gives by deleting at most one character: a
substitution leaves the same rest when both lose the same place, an insertion leaves the shorter line itself.
So each line emits its deletion variants as hashed keys, equal keys meet, and the edit distance of the
texts is verified. Of the lines that meet, the earliest stays.

Before that, an exact filter: of two lines within one edit, either the first halves or the second halves
(of the shorter one's length) are equal. Lines whose halves nobody shares have no partner and emit nothing.
Equal lines are counted as one line from the start, so copies never meet each other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from . import tokens as K
from .common import OWN, discard, materialize, settle, small

MIN_CHARS = 16


def _spots(offsets, buf, cut: int = 10):
    return K.runs(buf != cut, offsets)


def _line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per eligible line occurrence: ``doc_id, th, line, h1, h2, n`` and the half keys ``p0 p1 s0 s1``."""

    def kernel(batches):
        import pyarrow as pa

        powers = K.Powers()
        tag = [np.uint64(int(x) * 2 + 1) for x in K.SHINGLE[:4] >> np.uint64(2)]
        for batch in batches:
            raw, offsets = K.buffers(batch.column("text"))
            for lo, hi, buf, off in K.blocks(raw, offsets):
                starts, ends, doc = _spots(off, buf)
                newlines = np.zeros(len(buf) + 1, dtype=np.int64)
                np.cumsum(buf == 10, out=newlines[1:])
                line = newlines[starts] - newlines[off[doc]]
                char = np.flatnonzero((buf & 0xC0) != 0x80)  # where each character starts
                at = np.searchsorted(char, starts)
                n = np.searchsorted(char, ends) - at
                ok = n >= max(min_chars, 2)
                starts, ends, doc, line, at, n = (x[ok] for x in (starts, ends, doc, line, at, n))
                if not len(starts):
                    continue
                cum = K.prefix(buf, powers)
                char = np.append(char, len(buf))
                place = lambda k: np.where(k >= n, ends, char[np.minimum(at + k, len(char) - 1)])
                h1 = K.span_hash(cum, starts, ends, powers)
                # a second identity from the two halves' own hashes
                mid = place(n // 2)
                h2 = K.mix(K.span_hash(cum, starts, mid, powers) * K.SHINGLE[0] + K.span_hash(cum, mid, ends, powers) * K.SHINGLE[1] + n.astype(np.uint64))
                out = {"h1": h1, "h2": h2}
                for j, less in enumerate((0, 1)):  # as the shorter line of m = n characters, and as the longer of m + 1
                    m = n - less
                    size = m.astype(np.uint64)
                    out[f"p{j}"] = K.mix(K.span_hash(cum, starts, place(m // 2), powers) * tag[0] + size)
                    out[f"s{j}"] = K.mix(K.span_hash(cum, place(n - (m - m // 2)), ends, powers) * tag[1] + size * tag[2])
                rows = {k: batch.column(k).take(pa.array(doc + lo)) for k in ("doc_id", "th")}
                rows |= {"line": pa.array(line), "n": pa.array(n)} | {k: pa.array(v.view(np.int64)) for k, v in out.items()}
                yield pa.RecordBatch.from_pydict(rows)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, th long, line long, n long, h1 long, h2 long, p0 long, s0 long, p1 long, s1 long"
    return docs.select("doc_id", "th", "text").mapInArrow(kernel, schema)


def _variants(lines: DataFrame) -> DataFrame:
    """``h1, h2, v, nv, p``: hashes of each line without its p-th character, and of the line itself (p = -1)."""

    def kernel(batches):
        import pyarrow as pa

        powers = K.Powers()
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
                n = len(code)
                powers.upto(n + 1)
                cum = np.zeros(n + 1, dtype=np.uint64)
                np.cumsum((code + np.uint64(1)) * powers.up[:n], out=cum[1:])
                v = cum[:n] + (cum[n] - cum[1:]) * K.INVERSE
                v = K.mix(np.append(v, cum[n]))
                k = n + 1
                yield pa.RecordBatch.from_pydict({
                    "h1": pa.array(np.full(k, batch.column("h1")[i].as_py())), "h2": pa.array(np.full(k, batch.column("h2")[i].as_py())),
                    "v": pa.array(v.view(np.int64)), "nv": pa.array(np.append(np.full(n, n - 1, np.int32), np.int32(n)).astype(np.int32)),
                    "p": pa.array(np.append(np.arange(n, dtype=np.int32), np.int32(-1))),
                })

    return lines.select("h1", "h2", "text").mapInArrow(kernel, "h1 long, h2 long, v long, nv int, p int")


def _pick_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``h1, h2, text`` of the wanted lines ``(doc_id, th, line, h1, h2)``."""
    per_doc = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("line", "h1", "h2")).alias("want"))
    joined = docs.join(per_doc.withColumnRenamed("doc_id", "_d").withColumnRenamed("th", "_t"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")))
    got = joined.dropDuplicates(["doc_id", "th"]).select(F.split("text", "\n").alias("l"), F.explode("want").alias("w"))
    return got.select("w.h1", "w.h2", F.element_at("l", (F.col("w.line") + 1).cast("int")).alias("text"))


def _loc() -> Column:
    return F.struct("doc_id", "th", "line")


def find_duplicates(docs: DataFrame, min_chars: int = MIN_CHARS, max_edits: int = 1) -> DataFrame:
    """``doc_id, th, line, near``: the line occurrences to drop; ``docs`` has ``th``, the hash of its text.

    A line (of ``min_chars`` characters or more; shorter ones always stay) is dropped if an equal line, or a
    line within ``max_edits`` (0 or 1) edits, stands earlier: in order of doc_id (null first), then text
    hash, then line number. The earlier line counts whether or not it is dropped itself.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    occurrences = materialize(_line_keys(docs, min_chars), "lines")
    keys = ("p0", "s0", "p1", "s1")
    distinct = occurrences.groupBy("h1", "h2").agg(F.min(_loc()).alias("first"), F.count("*").alias("copies"), *[F.first(k).alias(k) for k in keys])
    distinct = materialize(distinct, "lines-distinct")
    near = None
    if max_edits:
        halves = distinct.select("h1", "h2", F.explode(F.array(*[F.struct(F.lit(k[0]).alias("side"), F.col(k).alias("key")) for k in keys])).alias("k")).select("h1", "h2", "k.side", "k.key")
        shared = halves.groupBy("side", "key").agg(F.count("*").alias("c")).where("c > 1").drop("c")
        live = halves.join(shared, ["side", "key"], "left_semi").select("h1", "h2").distinct()
        wanted = distinct.join(live, ["h1", "h2"]).select("h1", "h2", "first.*")
        texts = materialize(_pick_lines(docs, wanted), "lines-live")
        variants = materialize(_variants(texts), "lines-variants")
        settle(docs.sparkSession)
        met = variants.groupBy("v", "nv").agg(F.count("*").alias("c"), F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("v", "nv")
        first = distinct.select("h1", "h2", "first")
        rows = variants.join(met, ["v", "nv"]).join(first, ["h1", "h2"])
        who = F.struct("first", "h1", "h2")
        # a key's rows are one line and its one-character extensions, or lines that differ in one place: a few by nature
        same_place = W.partitionBy("v", "nv", "p")
        same_rest = W.partitionBy("v", "nv")
        partner = F.array_min(F.array_compact(F.array(
            F.when(F.col("p") >= 0, F.min(who).over(same_place)),
            F.when(F.col("p") >= 0, F.min(F.when(F.col("p") < 0, who)).over(same_rest)),
            F.when(F.col("p") < 0, F.min(F.when(F.col("p") >= 0, who)).over(same_rest)),
        )))
        pairs = rows.withColumn("best", partner).where(F.col("best.first") < F.col("first"))
        pairs = materialize(pairs.groupBy("h1", "h2").agg(F.min("best").alias("best")), "lines-pairs")
        discard(variants)
        other = texts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("text").alias("other"))
        near = (
            pairs.join(texts, ["h1", "h2"]).join(other, (F.col("best.h1") == F.col("g1")) & (F.col("best.h2") == F.col("g2")))
            .where(F.expr("levenshtein(text, other, 1) between 0 and 1")).select("h1", "h2", F.lit(True).alias("near"))
        )
    decided = distinct.select("h1", "h2", "first", "copies")
    decided = decided.join(near, ["h1", "h2"], "left") if near is not None else decided.withColumn("near", F.lit(None).cast("boolean"))
    decided = decided.where("copies > 1 or near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    # a table of its own: the join below then stands on two plain exchanges, which Spark can split under a hot line
    decided = materialize(decided, "lines-decided")
    discard(distinct, *([texts, pairs] if near is not None else []))
    settle(docs.sparkSession)
    decided = small(decided)
    return occurrences.select("h1", "h2", "doc_id", "th", "line").join(decided, ["h1", "h2"]).where(F.col("near") | (_loc() != F.col("first"))).select("doc_id", "th", "line", "near")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, max_edits: int = 1) -> DataFrame:
    """``docs`` with the duplicate lines taken out of ``text``, plus ``n_lines, n_exact, n_near``; one row per input row.

    Lines are parts between ``\\n``; a kept line keeps its bytes. Null text stays null with 0 lines, empty text
    stays empty. Rows with the same doc_id and text are the same document seen twice and come out alike.
    Extra columns pass through; ``n_lines``, ``n_exact``, ``n_near`` of the input are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in COUNTS])
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    found = find_duplicates(texts, min_chars, max_edits)
    drops = found.groupBy(F.col("doc_id").alias(f"{OWN}d"), F.col("th").alias(f"{OWN}t")).agg(
        F.collect_list("line").alias(f"{OWN}lines"), F.sum(F.col("near").cast("long")).alias(f"{OWN}near")
    )
    same = F.col("doc_id").eqNullSafe(F.col(f"{OWN}d")) & (F.xxhash64("text") == F.col(f"{OWN}t"))
    return _rebuild(docs.join(drops, same, "left"), docs)


COUNTS = ("n_lines", "n_exact", "n_near")


def _rebuild(joined: DataFrame, docs: DataFrame) -> DataFrame:
    names = list(docs.columns)

    def kernel(batches):
        import pyarrow as pa

        for batch in batches:
            texts, counts, exact, close = [], [], [], []
            for text, drop, near in zip(*(batch.column(c).to_pylist() for c in ("text", f"{OWN}lines", f"{OWN}near"))):
                lines = text.split("\n") if text else []
                gone = set(drop or ())
                counts.append(len(lines))
                close.append(near or 0)
                exact.append(len(gone) - close[-1])
                texts.append("\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else text)
            columns = {k: batch.column(k) for k in names} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(columns | {k: pa.array(v, pa.int64()) for k, v in zip(COUNTS, (counts, exact, close))})

    more = [T.StructField(c, T.LongType()) for c in COUNTS]
    return joined.select(*docs.columns, f"{OWN}lines", f"{OWN}near").mapInArrow(kernel, T.StructType([*docs.schema.fields, *more]))
