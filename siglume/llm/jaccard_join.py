"""Exact n-gram Jaccard join in the metric space of shingle sets.

Jaccard distance is a metric. Pivots create Voronoi-like regions: sets that share a shingle among their first
``n - ceil(t n) + l`` in a global order, rarest first, meet in a block, the block's first set is its pivot, and
all blocks of one pivot are one region. (Every pair at or above the threshold ``t`` shares ``l = n // 16`` of them,
at least one; sets whose prefix holds fewer shared shingles have no partner and go no further.) Every set goes
to each region it may have a partner in, which is how boundary sets are replicated, and learns its exact
distance to the pivot. Regions whose members aren't all connected yet are joined again around a further pivot,
over those members only whose distances to the first pivot differ by no more than the radius (triangle
inequality). Before all that, one pivot for each set of connected blocks closes most of them at the price of one
distance a set. Sets stay in open blocks only while they share enough of them with sets outside their own
component, and enter the blocks of their rarest keys alone. After ``rounds`` rounds the few sets left unconnected
are compared with all members of their region inside their window, portion by portion of a large region. No link between different sets is lost, and no pair inside an already connected
part of a region is ever formed.

Equal sets are one set from the start. Orders come from a bounded sample and change cost only, never results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import tokens as K
from .common import OWN, bitmap, discard, in_bitmap, materialize, settle, small
from .components import connected_components

#: Documents whose shingles give the global order, and shingles that the order lists (8 bytes each, broadcast).
SAMPLE, LISTED = 20_000, 250_000

#: Shingles that a task of the last comparison holds in memory at once (24 bytes each).
HELD = 2_000_000


def _shingles(column, n: int):
    """Yields ``(row, sorted distinct shingle hashes)``: lower-cased A-Z, words between ASCII white space."""
    powers = K.Powers()
    raw, offsets = K.buffers(column)
    for lo, hi, buf, off in K.blocks(raw, offsets):
        low = K.LOWER[buf]
        starts, ends, doc = K.runs(~K.WHITE[low], off)
        words = K.span_hash(K.prefix(low, powers), starts, ends, powers)
        shingle, at = K.window_hash(words, doc, n)
        cuts = np.searchsorted(doc[at], np.arange(hi - lo + 1))
        w_cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            if cuts[i + 1] > cuts[i]:
                yield lo + i, np.unique(shingle[cuts[i] : cuts[i + 1]])
            elif w_cuts[i + 1] > w_cuts[i]:
                few = words[w_cuts[i] : w_cuts[i + 1]]
                h = (few * K.SHINGLE[: len(few)]).sum(dtype=np.uint64, keepdims=True)
                yield lo + i, K.mix(h + np.array([len(few)], dtype=np.uint64) * K.SHINGLE[5])
            else:
                yield lo + i, np.zeros(0, dtype=np.uint64)


def _identity(s: np.ndarray) -> tuple[int, int]:
    a = K.mix(s + K.SHINGLE[2])
    pair = np.array([a.sum(dtype=np.uint64), np.bitwise_xor.reduce(K.mix(a * K.SHINGLE[1]))], dtype=np.uint64) if len(s) else np.zeros(2, np.uint64)
    return tuple(int(x) for x in K.mix(pair + np.uint64(len(s))).view(np.int64))


def common_keys(n: int) -> int:
    """Shingles that sets of this size share at least in their prefixes, if they link with a set no smaller."""
    return max(1, n // 16)


def _order(docs: DataFrame, n: int) -> np.ndarray:
    """Hashes of the shingles found most often in a sample of distinct texts, rarest first."""
    total = docs.count()
    share = min(1.0, SAMPLE / max(total, 1))
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    some = some.select("text", F.xxhash64("text").alias("h")).dropDuplicates(["h"]).select("text")

    def kernel(batches):
        import pyarrow as pa

        for batch in batches:
            for _, s in _shingles(batch.column("text"), n):
                yield pa.RecordBatch.from_pydict({"s": pa.array(s.view(np.int64))})

    seen = some.mapInArrow(kernel, "s long").groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    top = seen.orderBy(F.desc("c"), "s").limit(LISTED).toArrow()
    return top.column("s").to_numpy().view(np.uint64)[::-1].copy()


def _prefixes(docs: DataFrame, n: int, percent: int, listed) -> DataFrame:
    """``doc_id, th, n_shingles, k1, k2, prefix`` for each row; ``th`` is the hash of its text."""

    def kernel(batches):
        import pyarrow as pa

        known = listed.value
        by_hash = np.argsort(known)
        values = known[by_hash]
        for batch in batches:
            size, k1, k2, heads = [], [], [], []
            for _, s in _shingles(batch.column("text"), n):
                m = len(s)
                size.append(m)
                a, b = _identity(s)
                k1.append(a)
                k2.append(b)
                length = min(m, m - (percent * m + 99) // 100 + common_keys(m)) if m else 0
                if not len(values):
                    heads.append(s[:length].view(np.int64))
                    continue
                at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                common = values[at] == s
                rare = s[~common]
                if len(rare) >= length:
                    heads.append(rare[:length].view(np.int64))
                else:
                    rest = s[common][np.argsort(by_hash[at[common]], kind="stable")]
                    heads.append(np.concatenate([rare, rest])[:length].view(np.int64))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "th": batch.column("th"), "n_shingles": pa.array(size, pa.int64()), "k1": pa.array(k1, pa.int64()),
                "k2": pa.array(k2, pa.int64()), "prefix": pa.array(heads, pa.list_(pa.int64())),
            })

    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return hashed.mapInArrow(kernel, f"doc_id {kind}, th long, n_shingles long, k1 long, k2 long, prefix array<long>")


def _sets(docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """``sid, n, set`` of the wanted set ids, one row each. A bitmap lets the scan pass over most texts before anything is
    shuffled; a join removes its false positives."""
    wanted = materialize(wanted, "jaccard-wanted")
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, "sid"))

    def kernel(batches):
        import pyarrow as pa

        for batch in batches:
            ids, size, sets = [], [], []
            for _, s in _shingles(batch.column("text"), n):
                if len(s) and in_bitmap(sent.value, np.array([k := _identity(s)[0]], dtype=np.int64))[0]:
                    ids.append(k)
                    size.append(len(s))
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_pydict({"sid": pa.array(ids, pa.int64()), "n": pa.array(size, pa.int64()), "set": pa.array(sets, pa.list_(pa.int64()))})

    passed = docs.select("text").mapInArrow(kernel, "sid long, n long, set array<long>")
    out = materialize(passed.join(small(wanted), "sid", "left_semi").dropDuplicates(["sid"]), "jaccard-sets")
    discard(sent, wanted)
    return out


def _distances(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``p, x, inter, np, nx, link, d`` for pairs of set ids, as a table. Each pivot's set is sent once to each of its salts, each
    member's set once for each pivot; a task holds one pivot and one member at a time."""
    pairs = materialize(pairs.select("p", "x"), "jaccard-pairs")
    load = pairs.groupBy("p").agg(F.ceil(F.count("*") / 1000).cast("int").alias("salts"))
    members = pairs.join(load, "p").withColumn("salt", F.pmod(F.xxhash64("x"), F.col("salts")).cast("int"))
    members = sets.withColumnRenamed("sid", "x").join(small(members), "x").select("p", "salt", F.lit(1).alias("role"), "x", "n", "set")
    pivots = sets.withColumnRenamed("sid", "p").join(small(load), "p").select("p", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("p").alias("x"), "n", "set")
    rows = members.unionByName(pivots)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "p", "salt").sortWithinPartitions("p", "salt", "role")

    def kernel(batches):
        import pyarrow as pa

        pivot, of = None, np.zeros(0, np.int64)
        for batch in batches:
            out = [[], [], [], [], []]
            flat, cuts = batch.column("set").values.to_numpy(), batch.column("set").offsets.to_numpy()
            p, role, x = (batch.column(c).to_numpy() for c in ("p", "role", "x"))
            for i in range(batch.num_rows):
                s = flat[cuts[i] : cuts[i + 1]].view(np.uint64)
                if role[i] == 0:
                    pivot, of = p[i], s
                    continue
                if pivot != p[i]:
                    raise ValueError(f"the set of pivot {p[i]} is missing")
                at = np.minimum(np.searchsorted(of, s), len(of) - 1)
                for k, v in zip(out, (pivot, x[i], int((of[at] == s).sum()), len(of), len(s))):
                    k.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()) for k in out], ["p", "x", "inter", "np", "nx"])

    found = dealt.mapInArrow(kernel, "p long, x long, inter long, np long, nx long")
    union = F.col("np") + F.col("nx") - F.col("inter")
    found = found.withColumns({"link": 100 * F.col("inter") >= percent * union, "d": 1 - F.col("inter") / union})
    out = materialize(found, "jaccard-distances")
    discard(pairs)
    return out


def _wanted(keys: DataFrame, percent: int, by: str = "sid") -> DataFrame:
    """``sid, n, keys``: the keys ``(c, key)`` of each set that sets of another ``by`` have too, rarest first (``c`` sets
    have the key). Sets with fewer of them than any partner outside would share have no partner there and go."""
    blocks = keys.groupBy("key").agg(F.count("*").alias("c"), F.min(by).alias("a"), F.max(by).alias("b"))
    held = keys.join(blocks.where("a <> b").select("key", "c"), "key")
    sets = held.groupBy("sid", "n").agg(F.array_sort(F.collect_list(F.struct("c", "key"))).alias("keys"))
    return sets.where(F.size("keys") >= _least(percent))


def _least(percent: int):
    """Keys that a set of ``n`` shingles shares at least with any partner, smaller or larger."""
    return F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / 16)).cast("int")


def _blocks(keys: DataFrame, percent: int) -> DataFrame:
    """``p, x, n``: each set ``x`` in the blocks of its rarest keys, all but ``l - 1`` of them where partners share ``l`` at
    least; any two partners still meet, in the rarest key they share. ``p`` is the block's first set, itself left out."""
    sets = keys.groupBy("sid", "n").agg(F.array_sort(F.collect_list(F.struct("c", "key"))).alias("keys"))
    few = sets.select("sid", "n", F.explode(F.slice("keys", F.lit(1), F.greatest(F.lit(0), F.size("keys") - _least(percent) + 1))).alias("at"))
    few = materialize(few.select("sid", "n", "at.key"), "jaccard-members")
    first = few.groupBy("key").agg(F.min("sid").alias("p"), F.max("sid").alias("q")).where("p <> q").select("key", "p")
    out = materialize(few.join(first, "key").select("p", F.col("sid").alias("x"), "n").where("p <> x").distinct(), "jaccard-blocks")
    discard(few)
    return out


def _compare(loose: DataFrame, tagged: DataFrame, sets: DataFrame, percent: int, radius: float) -> DataFrame:
    """Links ``p, x`` between the loose members of each region and its members of other components, inside the window.

    Members are dealt in portions of ``HELD`` shingles, each with an index of its shingles in memory; loose members
    visit each portion of their region, one at a time, and no pair is formed but the links found."""
    load = tagged.join(loose.select("p").distinct(), "p", "left_semi").groupBy("p").agg(F.ceil(F.sum("n") / HELD).cast("int").alias("salts"))
    load = materialize(load, "jaccard-load")
    columns = ("p", "salt", "role", "x", "n", "d", "cx")
    held = tagged.join(load, "p").withColumns({"salt": F.pmod(F.xxhash64("x"), F.col("salts")).cast("int"), "role": F.lit(0)})
    asked = loose.join(load, "p").withColumns({"salt": F.explode(F.sequence(F.lit(0), F.col("salts") - 1)), "role": F.lit(1)})
    visits = materialize(held.select(*columns).unionByName(asked.select(*columns)), "jaccard-visits")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = visits.join(sets.select(F.col("sid").alias("x"), "set"), "x").select(*columns, "set")
    dealt = dealt.repartition(parts, "p", "salt").sortWithinPartitions("p", "salt", "role")

    def kernel(batches):
        import pyarrow as pa

        place, index, waiting = None, None, []
        for batch in batches:
            out_p, out_x = [], []
            flat, cuts = batch.column("set").values.to_numpy(), batch.column("set").offsets.to_numpy()
            p, salt, role, x, n, d, cx = (batch.column(c).to_numpy() for c in columns)
            for i in range(batch.num_rows):
                s = flat[cuts[i] : cuts[i + 1]]
                if (p[i], salt[i]) != place:
                    place, index, waiting = (p[i], salt[i]), None, []
                if role[i] == 0:
                    waiting.append((s.copy(), x[i], n[i], d[i], cx[i]))
                    continue
                if not waiting:
                    continue
                if index is None:
                    owner = np.repeat(np.arange(len(waiting)), [len(w[0]) for w in waiting])
                    every = np.concatenate([w[0] for w in waiting])
                    order = np.argsort(every)
                    index = every[order], owner[order], *(np.array([w[k] for w in waiting]) for k in range(1, 5))
                    waiting = [(w[0][:0], *w[1:]) for w in waiting]
                every, owner, ids, sizes, ds, home = index
                fit = (home != cx[i]) & (np.abs(ds - d[i]) <= radius) & (100 * sizes >= percent * n[i]) & (100 * n[i] >= percent * sizes)
                if not fit.any():
                    continue
                lo, hi = np.searchsorted(every, s), np.searchsorted(every, s, "right")
                width = hi - lo
                at = np.arange(width.sum()) + np.repeat(lo - (np.cumsum(width) - width), width)
                inter = np.bincount(owner[at], minlength=len(ids))
                hit = np.flatnonzero(fit & (100 * inter >= percent * (sizes + n[i] - inter)))
                hit = hit[np.unique(home[hit], return_index=True)[1]]  # one link for each component
                out_p += [x[i]] * len(hit)
                out_x += ids[hit].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out_p, pa.int64()), pa.array(out_x, pa.int64())], ["p", "x"])

    out = materialize(dealt.mapInArrow(kernel, "p long, x long"), "jaccard-compared")
    discard(load, visits)
    return out


def _tagged(region: DataFrame, home: DataFrame) -> DataFrame:
    """``region(p, x, ..)`` with ``cx`` and ``cp``, the components of both ends so far."""
    out = region.join(home.select(F.col("sid").alias("x"), F.col("root").alias("cx")), "x").join(home.select(F.col("sid").alias("p"), F.col("root").alias("cp")), "p")
    return materialize(out, "jaccard-labels")


def _joined(home: DataFrame, links: DataFrame) -> DataFrame:
    """``home(sid, root)`` after further links ``p, x``. Only links between components count, so their graph is small: it
    has a node for each component that grows, whatever the components hold."""
    a, b = home.select(F.col("sid").alias("p"), F.col("root").alias("v")), home.select(F.col("sid").alias("x"), F.col("root").alias("u"))
    across = materialize(links.select("p", "x").join(a, "p").join(b, "x").where("u <> v").select("u", "v").distinct(), "jaccard-across")
    if across.isEmpty():
        discard(across)
        return home
    moved = connected_components(across).where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("to"))
    out = materialize(home.join(moved, "root", "left").select("sid", F.coalesce("to", "root").alias("root")), "jaccard-home")
    discard(across, home)
    return out


def _at(keys: DataFrame, *more: str) -> DataFrame:
    return keys.select("sid", "n", *more, F.explode("keys").alias("at")).select("sid", "n", *more, "at.c", "at.key")


def link_sets(docs: DataFrame, n: int = 4, percent: int = 85, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, th, n_shingles, k1, k2`` and components ``sid, root`` of set ids (``k1``): exactly the sets that a chain
    of pairs at or above ``percent`` connects have one root. Sets that can't have a partner are absent."""
    spark = docs.sparkSession
    listed = spark.sparkContext.broadcast(_order(docs, n))
    rows = materialize(_prefixes(docs, n, percent, listed), "jaccard-rows")
    discard(listed)
    rows = rows.withColumn("rh", F.xxhash64("doc_id", "th"))
    one = rows.where("n_shingles > 0").groupBy("k1").agg(F.min("rh").alias("rh"), F.min("k2").alias("a"), F.max("k2").alias("b"))
    one = one.select(F.when(F.col("a") == F.col("b"), F.col("rh")).otherwise(F.raise_error(F.lit("two sets share a 64-bit identity"))).alias("rh"))
    # one row speaks for all equal sets; a few others may pass the bitmap, which only costs time
    one = materialize(one, "jaccard-speakers")
    speaks = spark.sparkContext.broadcast(bitmap(one, "rh"))

    def spoken(batch):
        import pyarrow as pa

        batch = batch.filter(pa.array(in_bitmap(speaks.value, batch.column("rh").to_numpy())))
        prefix = batch.column("prefix")
        cuts = prefix.offsets.to_numpy()
        return batch, prefix.values.to_numpy()[cuts[0] : cuts[-1]] if len(cuts) else np.zeros(0, np.int64), np.diff(cuts)

    def all_keys(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"key": pa.array(spoken(batch)[1], pa.int64())})

    prefixes = rows.where("n_shingles > 0").select(F.col("k1").alias("sid"), F.col("n_shingles").alias("n"), "rh", "prefix")
    shared = prefixes.mapInArrow(all_keys, "key long").groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    shared = materialize(shared, "jaccard-shared")
    sent = spark.sparkContext.broadcast(bitmap(shared, "key"))

    def sieve(batches):
        import pyarrow as pa

        for batch in batches:
            batch, flat, size = spoken(batch)
            keep = in_bitmap(sent.value, flat)
            row = np.repeat(np.arange(batch.num_rows), size)
            n = batch.column("n").to_numpy()
            least = np.maximum(1, (percent * n + 99) // 100 // 16)
            enough = np.bincount(row[keep], minlength=batch.num_rows) >= least  # fewer shared keys: no partner anywhere
            keep &= enough[row]
            row = pa.array(row[keep])
            yield pa.RecordBatch.from_pydict({"sid": batch.column("sid").take(row), "n": batch.column("n").take(row), "key": pa.array(flat[keep])})

    keys = prefixes.mapInArrow(sieve, "sid long, n long, key long").join(small(shared), "key").distinct()
    keys = materialize(_wanted(keys, percent), "jaccard-keys")
    discard(one, speaks, shared, sent)
    members = _blocks(_at(keys), percent)
    # coarse regions first: all that shared shingles connect, around one pivot each; this closes most blocks
    coarse = materialize(connected_components(members.select(F.col("p").alias("u"), F.col("x").alias("v"))), "jaccard-coarse")
    discard(members)
    settle(spark)
    whole = _sets(docs, n, coarse.select(F.col("node").alias("sid")))
    stars = _distances(coarse.where("node <> root").select(F.col("root").alias("p"), F.col("node").alias("x")), whole, percent)
    near = stars.where("link").select(F.col("x").alias("node"), F.col("p").alias("to"))  # stars already: no graph to walk
    home = materialize(coarse.join(near, "node", "left").select(F.col("node").alias("sid"), F.coalesce("to", "node").alias("root")), "jaccard-home")
    discard(coarse, stars)
    # what is left: blocks whose sets aren't all connected, and in them sets that share enough such blocks with others;
    # a set alone in its first blocks has no partner anywhere, so only fetched sets go on (other counts could make it a pivot)
    open_keys = keys.select("sid", "n", F.explode("keys.key").alias("key"))
    seen = materialize(_wanted(open_keys.join(home, "sid"), percent, by="root"), "jaccard-seen")
    left = materialize(_wanted(_at(seen).select("sid", "n", "key").join(home, "sid"), percent, by="root"), "jaccard-open")
    members = _blocks(_at(left), percent)
    discard(keys, seen, left)
    first = _distances(members, whole, percent)
    home = _joined(home, first.where("link"))
    settle(spark)
    radius = (100 - percent) / 100 + 1e-9
    region = first.select("p", "x", "d", F.col("nx").alias("n"))
    done = None  # (p, y): members that were pivots of the region already
    for turn in range(rounds + 1):
        tagged = _tagged(region, home)
        loose = tagged.where("cx <> cp")
        if done is not None:
            loose = loose.join(done.withColumnRenamed("y", "x"), ["p", "x"], "left_anti")
        if turn == rounds:
            found = _compare(loose, tagged, whole, percent, radius)
            home = _joined(home, found)
            discard(found, tagged)
            break
        chosen = materialize(loose.groupBy("p").agg(F.min("x").alias("y")), "jaccard-chosen")
        if chosen.isEmpty():
            discard(chosen, tagged)
            break
        mine = tagged.select("p", F.col("x").alias("y"), F.col("d").alias("dy"), F.col("n").alias("ny"), F.col("cx").alias("cy"))
        near = chosen.join(mine, ["p", "y"]).join(tagged.select("p", "x", "d", "n", "cx"), "p")
        near = near.where((F.col("x") != F.col("y")) & (F.col("cx") != F.col("cy")) & (F.abs(F.col("d") - F.col("dy")) <= radius))
        near = near.where((100 * F.col("n") >= percent * F.col("ny")) & (100 * F.col("ny") >= percent * F.col("n")))
        found = _distances(near.select(F.col("y").alias("p"), "x").distinct(), whole, percent)
        home = _joined(home, found.where("link"))
        discard(found, tagged)
        done = chosen if done is None else done.unionByName(chosen)
    discard(first, whole)
    settle(spark)
    return rows.drop("prefix"), home


def components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id`` (smallest doc_id that links reach, itself included).

    Shingles are ``n``-word windows of the lower-cased (A-Z) text, a text of fewer words is one shingle; texts
    without words (null, empty, white space) have none and link with nothing. Documents with equal sets link.
    Repeated rows keep their rows; null ids never are a component id unless nothing else is there; extra columns
    are ignored.
    """
    rows, home = link_sets(docs, n, percent)
    sets = rows.where("n_shingles > 0").groupBy("k1").agg(F.min("doc_id").alias("low"))
    sets = sets.join(home.select(F.col("sid").alias("k1"), "root"), "k1", "left").withColumn("root", F.coalesce("root", "k1"))
    lows = sets.where("root <> k1").groupBy("root").agg(F.min("low").alias("other"))  # only where several sets are linked
    low = sets.join(lows, "root", "left").select("k1", F.least("low", "other").alias("a"), "low", "root", "other")
    # members other than the root also need the root's own smallest id
    roots = sets.where("root = k1").join(lows.select(F.col("root").alias("k1")), "k1", "left_semi").select(F.col("k1").alias("root"), F.col("low").alias("of_root"))
    low = low.join(roots, "root", "left").select("k1", F.least("a", "of_root").alias("component"))
    return rows.join(low, "k1", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each linked group: the one of smallest doc_id (null last), then text hash.

    Documents without words link with nothing and all stay; of rows with the same doc_id and text one stays.
    """
    rows, home = link_sets(docs, n, percent)
    rows = rows.join(home.select(F.col("sid").alias("k1"), "root"), "k1", "left").withColumn("root", F.coalesce("root", "k1"))
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    chosen = rows.where("n_shingles > 0").groupBy("root").agg(F.min(who).alias("w")).select("w.doc_id", "w.th")
    chosen = chosen.unionByName(rows.where("n_shingles = 0").select("doc_id", "th").distinct())
    chosen = materialize(chosen.select(F.col("doc_id").alias(f"{OWN}d"), F.col("th").alias(f"{OWN}t")), "jaccard-kept")
    hashed = docs.withColumn(f"{OWN}h", F.xxhash64("text"))
    kept = hashed.join(chosen, F.col("doc_id").eqNullSafe(F.col(f"{OWN}d")) & (F.col(f"{OWN}h") == F.col(f"{OWN}t")), "left_semi")
    if not rows.groupBy("doc_id", "th").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", f"{OWN}h"])
    return kept.select(*docs.columns)
