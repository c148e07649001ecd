"""Quality classifier: overlapping heuristic labellers, a label model fitted by expectation-maximisation, and a
hashed linear scorer trained on the posterior labels.

Two latent classes are modelled the same way: low quality and toxicity. Each labeller votes good, bad or
abstains; the votes of all documents are counted by pattern (at most ``3 ** labellers`` patterns, so the
driver sees a bounded table), EM over those counts estimates each labeller's accuracies and the class prior,
and each pattern's posterior is the soft label of its documents. A logistic scorer over hashed words, word
beginnings and style buckets is then trained, with an L1 penalty, on the posteriors of ``max_train``
documents (default 8,000; those of least id hash), in one task of an executor. One toxicity labeller is a lexicon
of all words that set toxic documents apart in at most ``max_labels`` labelled rows (default 20,000), which bounds
it. Votes, pattern counts and scores cover every document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from . import tokens as K
from .common import discard, materialize, settle

BITS = 18
#: Entries of the training rows that a step looks at together.
PART = 1 << 18
#: Fixed English insult words of the public-lexicon labeller.
INSULTS = "idiot moron stupid loser trash scum clown pathetic worthless disgusting".split()
QUALITY = ("symbols", "capitals", "stutter", "lines", "triples", "tails", "empty")
TOXIC = ("insults", "lexicon", "beginnings")


def _hash_word(word: str) -> int:
    buf = np.frombuffer(word.encode(), dtype=np.uint8)
    powers = K.Powers()
    return int(K.span_hash(K.prefix(buf, powers), np.array([0]), np.array([len(buf)]), powers)[0])


def _letters() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[97:123] = True
    t[128:] = True
    return t


def _walk(column, visit) -> None:
    """Calls ``visit(lo, hi, parts)`` for each block: hashed lower-case letter runs and style shares."""
    powers, letters = K.Powers(), _letters()
    raw, offsets = K.buffers(column)
    symbol = np.zeros(256, dtype=bool)
    symbol[list(b"#*$%&|<>")] = True
    for lo, hi, buf, off in K.blocks(raw, offsets):
        n = hi - lo
        low = K.LOWER[buf]
        is_letter = letters[low]
        starts, ends, doc = K.runs(is_letter, off)
        cum = K.prefix(low, powers)
        words = K.span_hash(cum, starts, ends, powers)
        heads = K.span_hash(cum, starts, np.minimum(starts + 5, ends), powers)
        long = ends - starts >= 5
        count = np.bincount(doc, minlength=n)
        some = np.maximum(count, 1)
        chars = np.maximum(K.per_text(~K.WHITE[buf], off), 1)
        upper = K.per_text((buf >= 65) & (buf <= 90), off)
        ascii_letters = np.maximum(K.per_text(is_letter & (low < 128), off), 1)
        same = np.zeros(len(words), dtype=bool)
        same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
        triples, at = K.window_hash(words, doc, 3)
        triples = K.mix(triples + doc[at].astype(np.uint64) * K.SHINGLE[4])
        order = np.argsort(triples)
        equal = np.zeros(len(triples), dtype=bool)
        equal[order[1:]] = triples[order[1:]] == triples[order[:-1]]
        w_starts, w_ends, w_doc = K.runs(~K.WHITE[buf], off)
        punct = ~is_letter & ~K.WHITE[buf] & ~((buf >= 48) & (buf <= 57))
        tail = (w_ends - w_starts >= 3) & punct[np.maximum(w_ends - 1, 0)] & punct[np.maximum(w_ends - 2, 0)] if len(w_ends) else np.zeros(0, bool)
        pieces = np.maximum(np.bincount(w_doc, minlength=n), 1)
        l_starts, l_ends, l_doc = K.runs(buf != 10, off)
        lines = K.mix(K.span_hash(cum, l_starts, l_ends, powers) + l_doc.astype(np.uint64) * K.SHINGLE[4])
        order = np.argsort(lines, kind="stable")
        twin = np.zeros(len(lines), dtype=bool)
        twin[order[1:]] = lines[order[1:]] == lines[order[:-1]]
        shares = {
            "symbols": K.per_text(symbol[buf], off) / chars,
            "capitals": upper / ascii_letters,
            "stutter": np.bincount(doc[same], minlength=n) / some,
            "lines": np.bincount(l_doc[twin], minlength=n) / np.maximum(np.bincount(l_doc, minlength=n), 1),
            "triples": np.bincount(doc[at][equal], minlength=n) / some,
            "tails": np.bincount(w_doc[tail], minlength=n) / pieces,
        }
        visit(lo, hi, {"words": words, "heads": heads, "long": long, "doc": doc, "count": count, "shares": shares})


def _hits(doc: np.ndarray, values: np.ndarray, known: np.ndarray, n: int) -> np.ndarray:
    if not len(known) or not len(values):
        return np.zeros(n, dtype=np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.bincount(doc[known[at] == values], minlength=n)


#: most that a labeller may call good documents bad
FALSE_ALARM = 0.02
#: share above which a labeller votes bad, and below which it votes good
LIMITS = {"symbols": (0.03, 0.01), "capitals": (0.5, 0.2), "stutter": (0.2, 0.05), "lines": (0.3, 0.05), "triples": (0.5, 0.15), "tails": (0.2, 0.05)}


def _votes(parts: dict, n: int, insults: np.ndarray, lexicon: np.ndarray, beginnings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vote patterns: per labeller a base-3 digit, 0 abstain, 1 good, 2 bad."""
    q = np.zeros(n, dtype=np.int64)
    for k in QUALITY[:-1]:
        bad, good = LIMITS[k]
        q = q * 3 + np.where(parts["shares"][k] > bad, 2, np.where(parts["shares"][k] < good, 1, 0))
    q = q * 3 + np.where(parts["count"] == 0, 2, 0)
    t = np.zeros(n, dtype=np.int64)
    for known, values, keep in ((insults, parts["words"], None), (lexicon, parts["words"], None), (beginnings, parts["heads"], parts["long"])):
        doc = parts["doc"] if keep is None else parts["doc"][keep]
        hit = _hits(doc, values if keep is None else values[keep], known, n)
        t = t * 3 + np.where(hit > 0, 2, np.where((parts["count"] > 0) & (len(known) > 0), 1, 0))
    return q, t


def fit_label_model(counts: dict[int, int], labellers: int, prior: float, rounds: int = 80) -> dict:
    """EM over pattern counts. Returns the share of bad, accuracies ``p[labeller][class][vote]`` and the posterior of bad per pattern.

    Votes are independent given the class. Bad documents are of several kinds that set off different
    labellers, so class 0 is good and classes 1 to ``labellers`` are the kinds of bad, each started with full
    trust in one labeller; the posterior of bad is their sum. A labeller's false alarms on good documents are
    held to ``FALSE_ALARM``; add-one smoothing keeps unanimous tables finite; no document gives no pattern.
    """
    patterns = sorted(counts)
    weight = np.array([counts[p] for p in patterns], dtype=float)
    votes = np.array([[p // 3**k % 3 for k in reversed(range(labellers))] for p in patterns], dtype=int).reshape(-1, labellers)
    kinds = labellers + 1
    p = np.tile(np.array([0.3, 0.4, 0.3]), (labellers, kinds, 1))
    p[:, 0] = (0.3, 0.69, 0.01)
    for j in range(labellers):
        p[j, j + 1] = (0.04, 0.01, 0.95)
    share = np.array([1 - prior] + [prior / labellers] * labellers)
    post = np.zeros((len(patterns), kinds))
    for _ in range(rounds if len(patterns) else 0):
        like = np.log(share) + sum(np.log(p[j][:, votes[:, j]]).T for j in range(labellers))
        post = np.exp(like - like.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        share = np.maximum((weight[:, None] * post).sum(axis=0) / weight.sum(), 1e-7)
        for j in range(labellers):
            mass = np.stack([np.bincount(votes[:, j], weights=weight * post[:, c], minlength=3) for c in range(kinds)]) + 1
            p[j] = mass / mass.sum(axis=1, keepdims=True)
        p[:, 0, 2] = np.minimum(p[:, 0, 2], FALSE_ALARM)
    return {"prior": float(1 - share[0]), "accuracy": p, "posterior": dict(zip(patterns, 1 - post[:, 0]))}


def _features(parts: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a block as (row, bucket), without repeats."""
    mask = np.uint64((1 << BITS) - 1)
    long = parts["long"]
    rows = [parts["doc"], parts["doc"][long]]
    cols = [(parts["words"] & mask).astype(np.int64), ((parts["heads"][long] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & mask).astype(np.int64)]
    for i, k in enumerate(QUALITY[:-1]):
        level = np.minimum(np.ceil(parts["shares"][k] * 20), 20).astype(np.int64)
        rows.append(np.arange(n))
        cols.append((level * 7919 + (i + 1) * 104729) % (1 << BITS))
    key = np.unique(np.concatenate(rows) << BITS | np.concatenate(cols))
    return key >> BITS, key & ((1 << BITS) - 1)


def train(cols: np.ndarray, size: np.ndarray, target: np.ndarray, penalty: float = 1e-3, rounds: int = 150) -> tuple[np.ndarray, float]:
    """L1 logistic regression by accelerated proximal gradient over binary sparse rows; soft targets. ``cols`` holds the
    rows' buckets one after the other, ``size`` their number in each row."""
    n = len(size)
    if not n or not len(cols):
        return np.zeros(1 << BITS), -5.0
    count = np.bincount(cols, minlength=1 << BITS)
    often = np.flatnonzero(count >= 5)
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[often] = np.arange(len(often))
    at = place[cols]
    row = np.repeat(np.arange(n, dtype=np.int32), size)[at >= 0]
    at = at[at >= 0]
    parts = [slice(k, k + PART) for k in range(0, len(at), PART)]  # what a step makes of the rows is bounded
    scale = np.sqrt(count[often] + 1.0)
    w = np.zeros(len(often))
    y, t = w.copy(), 1.0
    b = by = float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    rate = 4.0 * n / (scale * np.sqrt(max(1.0, size.mean())))  # diagonal steps: rare features move further
    for _ in range(rounds):
        z = np.full(n, by)
        for p in parts:
            z += np.bincount(row[p], weights=y[at[p]], minlength=n)
        r = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
        grad = np.zeros(len(often))
        for p in parts:
            grad += np.bincount(at[p], weights=r[row[p]], minlength=len(often))
        grad /= n
        step = rate / (scale * 2)
        new = y - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = by - 0.5 * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, by = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    full = np.zeros(1 << BITS)
    full[often] = w
    return full, b


def _lexicon(docs: DataFrame, labels: DataFrame, max_labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and beginning hashes seen in toxic labelled documents and (almost) never in others."""
    chosen = labels.where("doc_id is not null and toxic is not null").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    some = docs.join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id").select("toxic", "text")

    def kernel(batches):
        import pyarrow as pa

        for batch in batches:
            toxic = np.array(batch.column("toxic").to_numpy(zero_copy_only=False), dtype=np.int64)
            found: list = []

            def visit(lo, hi, parts, toxic=toxic, found=found):
                for kind, values, doc in ((0, parts["words"], parts["doc"]), (1, parts["heads"][parts["long"]], parts["doc"][parts["long"]])):
                    order = np.lexsort((values, doc))
                    v, d = values[order], doc[order]
                    first = np.ones(len(v), dtype=bool)
                    first[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
                    v, d = v[first], toxic[lo:hi][d[first]]
                    u, inv = np.unique(v, return_inverse=True)
                    found.append((kind, u, np.bincount(inv, minlength=len(u)), np.bincount(inv, weights=d, minlength=len(u)).astype(np.int64)))

            _walk(batch.column("text"), visit)
            for kind, u, n, t in found:
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(u), kind, np.int32)), "h": pa.array(u.view(np.int64)), "n": pa.array(n), "t": pa.array(t)})

    seen = materialize(some.mapInArrow(kernel, "kind int, h long, n long, t long").groupBy("kind", "h").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), "lexicon")
    # so many toxic documents that chance gives none of the words seen here that often
    share, words = chosen.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0, max(seen.count(), 1)
    least = max(4, int(np.ceil(np.log(1e-2 / words) / np.log(min(max(share, 1e-3), 0.9)))))
    best = seen.where(f"t >= {least} and t >= 0.97 * n").collect()  # words of max_labels rows at most
    discard(seen)
    pick = lambda kind: np.sort(np.array([r["h"] for r in best if r["kind"] == kind], dtype=np.int64).view(np.uint64))
    return pick(0), pick(1)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 8000, max_labels: int = 20_000) -> dict:
    """The fitted model: label models, heads (weights and bias) for quality and toxicity, lexicons."""
    docs = docs.select("doc_id", "text")
    lexicon, beginnings = _lexicon(docs, labels, max_labels)
    insults = np.sort(np.array([_hash_word(w) for w in INSULTS], dtype=np.uint64))

    def count_votes(batches):
        import pyarrow as pa

        total: dict = {}
        for batch in batches:

            def visit(lo, hi, parts, total=total):
                q, t = _votes(parts, hi - lo, insults, lexicon, beginnings)
                for kind, v in ((0, q), (1, t)):
                    for p, c in zip(*np.unique(v, return_counts=True)):
                        total[kind, int(p)] = total.get((kind, int(p)), 0) + int(c)

            _walk(batch.column("text"), visit)
        keys = sorted(total)
        yield pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _ in keys], pa.int32()), "pattern": pa.array([p for _, p in keys], pa.int64()), "n": pa.array([total[k] for k in keys], pa.int64())})

    counted = docs.select("text").mapInArrow(count_votes, "kind int, pattern long, n long").groupBy("kind", "pattern").agg(F.sum("n").alias("n")).collect()
    models = [
        fit_label_model({r["pattern"]: r["n"] for r in counted if r["kind"] == kind}, labellers, prior)
        for kind, labellers, prior in ((0, len(QUALITY), 0.2), (1, len(TOXIC), 0.1))
    ]
    total = sum(r["n"] for r in counted if r["kind"] == 0)
    share = min(1.0, 1.2 * max_train / max(total, 1))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("doc_id", "text")

    def featurise(batches):
        import pyarrow as pa

        for batch in batches:
            out: list = []

            def visit(lo, hi, parts, out=out):
                q, t = _votes(parts, hi - lo, insults, lexicon, beginnings)
                r, c = _features(parts, hi - lo)
                cuts = np.searchsorted(r, np.arange(hi - lo + 1))
                out.extend((int(q[i]), int(t[i]), c[cuts[i] : cuts[i + 1]].astype(np.int32)) for i in range(hi - lo))

            _walk(batch.column("text"), visit)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "q": pa.array([o[0] for o in out], pa.int64()),
                "t": pa.array([o[1] for o in out], pa.int64()), "f": pa.array([o[2] for o in out], pa.list_(pa.int32())),
            })

    kind = docs.schema["doc_id"].dataType.simpleString()
    posteriors = [m["posterior"] for m in models]

    def fit_heads(batches):
        import pyarrow as pa

        held = [(b.column("q").to_numpy(), b.column("t").to_numpy(), np.diff(b.column("f").offsets.to_numpy()), b.column("f").flatten().to_numpy()) for b in batches]
        for head, known in enumerate(posteriors):
            target = np.array([known[p] for h in held for p in h[head].tolist()], dtype=float)
            size = np.concatenate([h[2] for h in held]) if held else np.zeros(0, np.int64)
            full, bias = train(np.concatenate([h[3] for h in held]) if held else np.zeros(0, np.int32), size, target)
            at = np.flatnonzero(full)
            yield pa.RecordBatch.from_pydict({"head": pa.array(np.full(len(at) + 1, head, np.int32)), "at": pa.array(np.append(at, -1)), "w": pa.array(np.append(full[at], bias))})
        del held
        pa.default_memory_pool().release_unused()  # the worker process lives on

    # max_train rows at most meet in one task, which trains; 2 ** BITS weights a head at most come back
    rows = sample.mapInArrow(featurise, f"doc_id {kind}, q long, t long, f array<int>").orderBy(F.xxhash64("doc_id", F.lit(12)), "doc_id").limit(max_train)
    found = rows.select("q", "t", "f").mapInArrow(fit_heads, "head int, at long, w double").toArrow()
    head, at, w = (found.column(c).to_numpy() for c in ("head", "at", "w"))
    heads = []
    for h in range(len(models)):
        full = np.zeros(1 << BITS, dtype=np.float32)
        mine, bias = at[head == h], w[head == h]
        full[mine[mine >= 0]] = bias[mine >= 0]
        heads.append((full, float(bias[mine < 0][0]) if (mine < 0).any() else -5.0))
    settle(docs.sparkSession)
    return {"models": models, "heads": heads, "insults": insults, "lexicon": lexicon, "beginnings": beginnings}


def score(docs: DataFrame, model: dict, prefix: str = "") -> DataFrame:
    """``docs`` with ``low_quality, toxic`` (probabilities) and ``kept``, their names behind ``prefix``; wordless texts are
    rejected. One row per input row.

    Null and empty texts have no word: low quality 1. Repeated rows keep their rows; extra columns pass through, but
    columns of the input that are called like the three new ones are replaced.
    """
    names = [prefix + c for c in ("low_quality", "toxic", "kept")]
    weights = [np.ascontiguousarray(w, dtype=np.float32) for w, _ in model["heads"]]
    sent = docs.sparkSession.sparkContext.broadcast((weights, [b for _, b in model["heads"]]))  # 2 MB, fixed by BITS

    def kernel(batches):
        import pyarrow as pa

        (wq, wt), bias = sent.value
        live = (wq != 0) | (wt != 0)
        for batch in batches:
            n = batch.num_rows
            out = np.zeros((2, n))
            empty = np.zeros(n, dtype=bool)

            def visit(lo, hi, parts, out=out, empty=empty):
                mask = np.uint64((1 << BITS) - 1)
                m = hi - lo
                long = parts["long"]
                words = (parts["words"] & mask).astype(np.int64)
                heads = ((parts["heads"][long] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & mask).astype(np.int64)
                a, b = live[words], live[heads]
                rows, cols = [parts["doc"][a], parts["doc"][long][b]], [words[a], heads[b]]
                for i, k in enumerate(QUALITY[:-1]):
                    level = np.minimum(np.ceil(parts["shares"][k] * 20), 20).astype(np.int64)
                    rows.append(np.arange(m))
                    cols.append((level * 7919 + (i + 1) * 104729) % (1 << BITS))
                key = np.unique(np.concatenate(rows) << BITS | np.concatenate(cols))
                r, c = key >> BITS, key & ((1 << BITS) - 1)
                for h, w in enumerate((wq, wt)):
                    out[h, lo:hi] = np.bincount(r, weights=w[c], minlength=m) + bias[h]
                empty[lo:hi] = parts["count"] == 0

            _walk(batch.column("text"), visit)
            p = 1 / (1 + np.exp(-np.clip(out, -40, 40)))
            p[0, empty] = 1.0
            kept = (p[0] < 0.5) & (p[1] < 0.5)
            columns = {k: batch.column(k) for k in batch.schema.names}
            yield pa.RecordBatch.from_pydict(columns | dict(zip(names, (pa.array(p[0]), pa.array(p[1]), pa.array(kept)))))

    base = docs.drop(*[c for c in docs.columns if c.lower() in [x.lower() for x in names]])
    more = [T.StructField(c, t) for c, t in zip(names, (T.DoubleType(), T.DoubleType(), T.BooleanType()))]
    return base.mapInArrow(kernel, T.StructType([*base.schema.fields, *more]))


def classify(docs: DataFrame, labels: DataFrame, prefix: str = "", **bounds) -> DataFrame:
    """``score`` by a model that ``fit`` makes of the same documents and their ``labels(doc_id, toxic)``."""
    return score(docs, fit(docs, labels, **bounds), prefix)
