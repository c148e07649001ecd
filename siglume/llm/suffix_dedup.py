"""Exact substring deduplication: deep-shallow sorting of the suffixes that can repeat.

Every string of ``width`` bytes has an anchor, the least-hashed ``K`` bytes inside it (leftmost of equals), which
its content alone decides. Runs of strings with one anchor are a segment of text. A first pass counts
anchor hashes; a bitmap of those seen twice lets a second pass emit only segments that can repeat. Segments are
dealt by anchor hash, so that equal strings meet in one task, at the same offset from their anchors. There the
suffixes of the segments are sorted, up to ``width`` bytes: multikey quicksort on 8-byte characters to a shallow
depth, then blind tries (compacted tries, built level by level for all groups at once: a node compares its members with
one of them, skips to the first byte in which any differs and branches there alone) for groups that still share a long prefix. Of the suffixes in a leaf of full depth, the
earliest stays.

Segments of equal hashes are combined before the shuffle and before the sort where their bytes are equal too (all but
the earliest are repeats whatever the others say), so hashes only bring strings together and never decide. Anchors seen very often are emitted string by string under keys of their own, so copies and
common passages spread over the tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from . import tokens as K
from .common import bitmap, discard, in_bitmap, materialize, settle

WIDTH, K_BYTES, SHALLOW = 100, 32, 16
#: Anchors with at least this many occurrences are split into single strings under keys of their own, at any size of the input.
HOT = 4096
#: Strings that one sort holds (beyond one anchor's own).
SORTED_AT_ONCE = 200_000


def _load(buf: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return buf[at[:, None] + np.arange(n)]


def deep_shallow(buf: np.ndarray, starts: np.ndarray, group: np.ndarray, width: int = WIDTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the ``width``-byte strings at ``starts`` within their groups.

    Returns the order and, for each place in it, whether a string differs from the one before (or starts a
    group). ``buf`` must reach ``width`` bytes beyond the last string.
    """
    order = np.argsort(group, kind="stable")
    n = len(order)
    head = np.ones(n, dtype=bool)
    head[1:] = group[order[1:]] != group[order[:-1]]
    depth = np.zeros(n, dtype=np.int64)  # bytes known equal within the class of a place

    def active(limit_from: int, limit_to: int) -> np.ndarray:
        """Places in classes of two and more whose depth is in the range."""
        mate = ~head
        mate[:-1] |= ~head[1:]
        return np.flatnonzero(mate & (depth >= limit_from) & (depth < limit_to))

    def regroup(place: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Orders the items at ``place`` by key (class-major) and marks the new classes; returns the sorting."""
        by = np.argsort(key, kind="stable")
        order[place] = order[place][by]
        new = key[by]
        head[place[1:]] |= (new[1:] != new[:-1]) & (place[1:] == place[:-1] + 1)
        head[place[:1]] = True
        return by

    # shallow: ternary partition of each class around the word of its middle item, all classes at once
    while len(place := active(0, shallow)):
        cls = np.cumsum(head[place])
        first = np.flatnonzero(np.diff(cls, prepend=-1))
        size = np.diff(np.append(first, len(place)))
        word = _load(buf, starts[order[place]] + depth[place], 8).view(">u8").ravel().astype(np.uint64)
        pivot = np.repeat(word[first + size // 2], size)
        side = (word > pivot).astype(np.int64) + (word >= pivot)
        by = regroup(place, cls * 3 + side)
        depth[place] = depth[place] + 8 * (side[by] == 1)
    # deep: one trie node a class and round; its members agree up to the first byte in which any differs from the first
    while len(place := active(shallow, width)):
        cls = np.cumsum(head[place])
        first = np.flatnonzero(np.diff(cls, prepend=-1))
        size = np.diff(np.append(first, len(place)))
        at = starts[order[place]]
        left = width - int(depth[place].min())
        mine = _load(buf, at + depth[place], left)
        model = np.repeat(mine[first], size, axis=0)
        reach = np.minimum(width - depth[place], left)
        differ = (mine != model) & (np.arange(left) < reach[:, None])
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), reach)
        node = np.repeat(np.minimum.reduceat(common, first), size)
        full = node >= reach
        branch = buf[at + np.minimum(depth[place] + node, width - 1)].astype(np.int64)
        regroup(place, cls * 256 + np.where(full, 0, branch))
        depth[place] = np.where(full, width, depth[place] + node + 1)
    return order, head


def _segments(column, width: int, k: int):
    """Per block: bytes, rows, anchor hashes, first string start, strings, anchor offset (all within the block)."""
    powers = K.Powers()
    raw, offsets = K.buffers(column)
    span = width - k + 1
    for lo, hi, buf, off in K.blocks(raw, offsets):
        m = len(buf) - k + 1
        if len(buf) < width:
            continue
        cum = K.prefix(buf, powers)
        at = np.arange(m)
        grams = K.mix((cum[k:] - cum[:m]) * powers.down[:m])
        low = (grams & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64)
        have = 1
        while have * 2 <= span:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < span:
            low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
        anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the string that starts at each place
        size = np.diff(off)
        doc = np.repeat(np.arange(hi - lo), np.maximum(size - width + 1, 0))
        if not len(doc):
            continue
        first = np.concatenate([[0], np.cumsum(np.maximum(size - width + 1, 0))])
        start = off[:-1][doc] + (np.arange(len(doc)) - first[doc])
        mine = anchor[start]
        new = np.ones(len(start), dtype=bool)
        new[1:] = (mine[1:] != mine[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(start)))
        a = start[begin]
        yield lo, buf, off, cum, powers, doc[begin], grams[mine[begin]], a, count, mine[begin] - a


def _merge(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the half-open ranges of each row."""
    if not len(rows):
        return rows, a, b
    by = np.lexsort((a, rows))
    rows, a, b = rows[by], a[by], b[by]
    shift = np.cumsum(np.diff(rows, prepend=rows[0]) != 0) * (int(b.max()) + 1)
    top = np.maximum.accumulate(b + shift)
    new = np.ones(len(a), dtype=bool)
    new[1:] = a[1:] + shift[1:] > top[:-1]
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(a)) - 1
    return rows[begin], a[begin], top[end] - shift[begin]


def repeats(docs: DataFrame, width: int = WIDTH, k: int = K_BYTES) -> DataFrame:
    """``d, th, a, b``: byte ranges to remove. ``docs`` has ``d`` (order of documents), ``th`` (hash of the text), ``text``."""
    spark = docs.sparkSession

    def count_anchors(batches):
        import pyarrow as pa

        for batch in batches:
            for *_, ah, _, _, _ in _segments(batch.column("text"), width, k):
                u, c = np.unique(ah, return_counts=True)
                yield pa.RecordBatch.from_pydict({"ah": pa.array(u.view(np.int64)), "n": pa.array(c)})

    seen = docs.select("text").mapInArrow(count_anchors, "ah long, n long").groupBy("ah").agg(F.sum("n").alias("n"))
    seen = materialize(seen.where("n > 1"), "suffix-anchors")
    # of often-seen anchors a bitmap too: another anchor that shares a bit is split as well, everywhere alike
    sent = spark.sparkContext.broadcast((bitmap(seen, "ah"), bitmap(seen.where(F.col("n") >= HOT), "ah")))

    def emit(batches):
        import pyarrow as pa

        table, often = sent.value
        for batch in batches:
            parts = []
            d, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("d", "th"))
            for lo, buf, off, cum, powers, doc, ah, a, count, shift in _segments(batch.column("text"), width, k):
                live = in_bitmap(table, ah)
                doc, ah, a, count, shift = (x[live] for x in (doc, ah, a, count, shift))
                if len(ah):
                    split = in_bitmap(often, ah)
                    if split.any():
                        # one string a row, under a key of its own content
                        reps = np.where(split, count, 1)
                        step = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                        doc, ah, a, shift, single, count = (np.repeat(x, reps) for x in (doc, ah, a, shift, split, count))
                        a, shift = a + step, shift - step
                        count = np.where(single, 1, count)
                        ah = np.where(single, K.mix(ah + K.span_hash(cum, a, a + width, powers)), ah)
                sh = K.span_hash(cum, a, a + count + width - 1, powers)
                parts.append((doc + lo, ah.view(np.int64), sh.view(np.int64), a - off[doc], count, shift, [buf, a]))
            if not parts:
                continue
            row, ah, sh, a, count, shift = (np.concatenate([p[i] for p in parts]) for i in range(6))
            by = np.lexsort((a, th[row], d[row], shift, count, sh, ah))
            same = np.ones(len(by), dtype=bool)
            same[:1] = False
            for x in (ah, sh, count, shift):
                same[1:] &= x[by[1:]] == x[by[:-1]]
            lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))
            lead = by[lead]
            block = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            local = np.concatenate([p[6][1] for p in parts])
            content = lambda i: parts[block[i]][6][0][local[i] : local[i] + count[i] + width - 1].tobytes()
            for j in np.flatnonzero(same):  # equal hashes count only with equal bytes
                same[j] = content(by[j]) == content(lead[j])
            twin = (d[row[by]] == d[row[lead]]) & (th[row[by]] == th[row[lead]]) & (a[by] == a[lead])
            gone = by[same & ~twin]
            rows, lo_, hi_ = _merge(row[gone], a[gone], a[gone] + count[gone] + width - 1)
            kept = np.sort(by[~same])
            texts = [content(i) for i in kept]
            m, g = len(rows), len(kept)
            take = lambda x: pa.array(np.concatenate([x[rows], x[row[kept]]]))
            yield pa.RecordBatch.from_pydict({
                "d": take(d), "th": take(th), "a": pa.array(np.concatenate([lo_, a[kept]])), "b": pa.array(np.concatenate([hi_, np.full(g, -1)])),
                "ah": pa.array(np.concatenate([np.zeros(m, np.int64), ah[kept]])), "sh": pa.array(np.concatenate([np.zeros(m, np.int64), sh[kept]])),
                "count": pa.array(np.concatenate([np.zeros(m, np.int64), count[kept]]).astype(np.int32)), "shift": pa.array(np.concatenate([np.zeros(m, np.int64), shift[kept]]).astype(np.int32)),
                "seg": pa.array([None] * m + texts, pa.binary()),
            })

    found = docs.select("d", "th", "text").mapInArrow(emit, "d long, th long, a long, b long, ah long, sh long, count int, shift int, seg binary")
    found = materialize(found, "suffix-segments", "16m")  # equal segments of a batch are combined
    discard(seen, sent)
    settle(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("ah", "sh", "count", "shift", "d", "th", "a")
    dealt = found.where("b < 0").drop("b").repartition(parts, "ah").sortWithinPartitions(*order)

    def sort(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held: list = []  # segments of anchors not yet sorted: one row for each content

        def settle(ready: list):
            """Sorts the strings of the segments; yields ranges of those that also start earlier."""
            columns = [np.concatenate([h[i] for h in ready]) for i in range(7)]
            ah, d, th, a, count, shift, _ = columns
            texts = [t for h in ready for t in h[7]]
            alone = np.ones(len(ah), dtype=bool)
            alone[1:] &= ah[1:] != ah[:-1]
            alone[:-1] &= ah[1:] != ah[:-1]
            use = np.flatnonzero(~alone)
            if not len(use):
                return None
            buf = np.frombuffer(b"".join([*(texts[i] for i in use), bytes(width)]), dtype=np.uint8)
            size = count[use].astype(np.int64)
            base = np.concatenate([[0], np.cumsum(size + width - 1)])[:-1]
            seg = np.repeat(np.arange(len(use)), size)
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            anchors = np.cumsum(np.diff(ah[use], prepend=ah[use][0]) != 0)
            group = anchors[seg] * (width + 1) + (shift[use][seg] - step)
            order, head = deep_shallow(buf, base[seg] + step, group, width)
            leaf = np.cumsum(head) - 1
            s = use[seg[order]]
            begin = a[s] + step[order]
            by = np.lexsort((begin, th[s], d[s], leaf))
            first = np.ones(len(by), dtype=bool)
            first[1:] = leaf[by[1:]] != leaf[by[:-1]]
            lead = by[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]
            later = ~((d[s[by]] == d[s[lead]]) & (th[s[by]] == th[s[lead]]) & (begin[by] == begin[lead]))
            again = by[later]
            rows, lo, hi = _merge(s[again], begin[again], begin[again] + width)
            return d[rows], th[rows], lo, hi

        def ranges(d, th, lo, hi):
            return pa.RecordBatch.from_pydict({"d": pa.array(d), "th": pa.array(th), "a": pa.array(lo), "b": pa.array(hi)})

        last, bytes_of_last = None, b""
        strings = 0
        for batch in batches:
            ah, sh, count, shift, d, th, a = (batch.column(c).to_numpy() for c in ("ah", "sh", "count", "shift", "d", "th", "a"))
            same = np.ones(len(ah), dtype=bool)
            for i, x in enumerate((ah, sh, count, shift)):
                same[1:] &= x[1:] == x[:-1]
                same[:1] &= last is not None and x[0] == last[i]
            # the earliest of each content leads; the others are repeats in full, but for the same place seen twice
            lead = np.maximum.accumulate(np.where(same, -1, np.arange(len(ah))))
            seg = batch.column("seg")
            again = np.flatnonzero(same)
            if len(again):  # equal hashes count only with equal bytes
                model = lead[again]
                inside, equal = model >= 0, np.ones(len(again), dtype=bool)
                equal[inside] = pc.equal(seg.take(pa.array(again[inside])), seg.take(pa.array(model[inside]))).to_numpy(zero_copy_only=False)
                if not inside.all():
                    equal[~inside] = pc.equal(seg.take(pa.array(again[~inside])), pa.scalar(bytes_of_last, seg.type)).to_numpy(zero_copy_only=False)
                same[again[~equal]] = False
            of = lambda x, j: np.where(lead >= 0, x[np.maximum(lead, 0)], last[j] if last else 0)
            later = same & ~((d == of(d, 4)) & (th == of(th, 5)) & (a == of(a, 6)))
            if later.any():
                yield ranges(d[later], th[later], a[later], a[later] + count[later] + width - 1)
            new = np.flatnonzero(~same)
            if len(new):
                i = new[-1]
                bytes_of_last = seg[int(i)].as_py()
                last = (ah[i], sh[i], count[i], shift[i], d[i], th[i], a[i])
                held.append((ah[new], d[new], th[new], a[new], count[new], shift[new], sh[new], [seg[int(j)].as_py() for j in new]))
                strings += int(count[new].sum())
            if strings >= SORTED_AT_ONCE and held:
                # all but the last anchor are complete
                tail = held[-1]
                cut = int(np.searchsorted(tail[0], tail[0][-1])) if len(held) == 1 or tail[0][0] != tail[0][-1] else 0
                if cut or len(held) > 1 and held[-2][0][-1] != tail[0][0]:
                    done = held[:-1] + ([tuple(x[:cut] for x in tail)] if cut else [])
                    held = [tuple(x[cut:] for x in tail)]
                    strings = int(held[0][4].sum())
                    if (out := settle(done)) is not None and len(out[0]):
                        yield ranges(*out)
        if held and (out := settle(held)) is not None and len(out[0]):
            yield ranges(*out)

    sorted_out = dealt.mapInArrow(sort, "d long, th long, a long, b long")
    out = materialize(found.where("b >= 0").select("d", "th", "a", "b").unionByName(sorted_out), "suffix-ranges")
    discard(found)
    settle(spark)
    return out


def dedup_substrings(docs: DataFrame, width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked, ``kept`` (bytes; cutting
    may leave parts of characters) and ``spans`` (start and end of each removed run).

    A byte goes if a ``width``-byte string over it also starts earlier: in a document of smaller doc_id (null
    first; equal ids by text hash), or in the same document further left. Null counts as empty. Rows with the
    same doc_id and text are one document seen twice and come out alike. Extra columns are ignored. ``doc_id`` is of an
    integer type, any other raises ``TypeError``.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id isn't of an integer type")
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumns({"d": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "th": F.xxhash64("text")})
    ranges = repeats(base, width).groupBy(F.col("d").alias("_d"), F.col("th").alias("_t")).agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    joined = base.join(ranges, (F.col("d") == F.col("_d")) & (F.col("th") == F.col("_t")), "left").select("doc_id", "text", "ranges")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")}
            for text, found in zip(batch.column("text"), batch.column("ranges")):
                raw = text.as_py().encode()
                spans = []
                if found.is_valid:
                    flat = found.values.flatten()
                    a, b = (x.to_numpy() for x in flat)
                    _, a, b = _merge(np.zeros(len(a), np.int64), a, b)
                    spans = list(zip(a.tolist(), b.tolist()))
                at, parts = 0, []
                for a, b in spans:
                    parts.append(raw[at:a])
                    at = b
                kept = b"".join([*parts, raw[at:]])
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(len(raw) - len(kept))
                out["n_spans"].append(len(spans))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    out["kept"].append(kept)
                    out["spans"].append([{"a": a, "b": b} for a, b in spans])
            columns = {"doc_id": batch.column("doc_id")} | {c: pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")}
            columns["kept_sha256"] = pa.array(out["kept_sha256"], pa.string())
            if with_text:
                columns["kept"] = pa.array(out["kept"], pa.binary())
                columns["spans"] = pa.array(out["spans"], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
            yield pa.RecordBatch.from_pydict(columns)

    schema = T.StructType([docs.schema["doc_id"]]).simpleString()[7:-1].replace(":", " ", 1) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.mapInArrow(cut, schema + (", kept binary, spans array<struct<a:long,b:long>>" if with_text else ""))
