"""Chains of near copies around the threshold: links must hold however regions are split."""

import random

import pytest

from siglume.llm import jaccard_join


def _brute(texts, n, percent):
    sets = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("rounds, held", [(0, 2_000_000), (0, 3_000), (2, 3_000)])
def test_chains(spark, monkeypatch, rounds, held):
    rng = random.Random(5)
    texts, words = [], [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    for _ in range(12):
        cur = [rng.choice(words) for _ in range(rng.randint(40, 220))]
        for _ in range(12):
            texts.append(" ".join(cur))
            cur = list(cur)
            for _ in range(max(1, len(cur) * rng.randint(1, 5) // 100)):
                cur[rng.randrange(len(cur))] = rng.choice(words)
            if rng.random() < 0.3:
                cur = cur[: -rng.randint(1, 12)]
        texts.append(" ".join(passage + cur))
    rng.shuffle(texts)
    monkeypatch.setattr(jaccard_join, "HELD", held)
    links = jaccard_join.link_sets
    monkeypatch.setattr(jaccard_join, "link_sets", lambda docs, n, percent: links(docs, n, percent, rounds))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in jaccard_join.components(docs, 4, 85).collect()}
    want = _brute(texts, 4, 85)
    assert len(set(want)) < len(texts) and [got[i] for i in range(len(texts))] == want


def test_alone_in_the_first_blocks(spark, monkeypatch):
    """A set alone in the blocks of its rarest keys: later counts must not make it a pivot, since its set isn't fetched."""
    texts = alone_texts()
    monkeypatch.setattr(jaccard_join, "LISTED", 0)  # keys in the order of their hashes
    distances, missing = jaccard_join._distances, []

    def watched(pairs, sets, percent):
        missing.extend(pairs.join(sets, pairs.p == sets.sid, "left_anti").collect())
        return distances(pairs, sets, percent)

    monkeypatch.setattr(jaccard_join, "_distances", watched)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.components(docs, 1, 85).collect()}
    assert not missing and [got[i] for i in range(len(texts))] == _brute(texts, 1, 85)


def alone_texts():
    import pyarrow as pa

    words = [f"x0y{i}" for i in range(4000)]
    hashes = {w: int(s[0]) for w, (_, s) in zip(words, jaccard_join._shingles(pa.array(words), 1))}
    words.sort(key=hashes.get)
    (a, b, t, u, v, v2), rest = words[:6], iter(words[50:])

    def filled(*shared):
        return [*shared, *(next(rest) for _ in range(40 - len(shared)))]

    near = filled(b, u)
    rows = [filled(a, b), filled(a, t), filled(a, t), filled(b, v, v2), filled(v, v2), near, *([*near[:-1], next(rest)] for _ in range(3))]
    return [" ".join(r) for r in rows]


def test_missing_pivot(spark):
    sets = spark.createDataFrame([(2, 2, [5, 6])], "sid long, n long, set array<long>")
    with pytest.raises(Exception, match="set of pivot 1 is missing"):
        jaccard_join._distances(spark.createDataFrame([(1, 2)], "p long, x long"), sets, 85).collect()
