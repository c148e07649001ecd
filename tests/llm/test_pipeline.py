"""The pipeline's stages: brute-force versions, nulls, repeats, empty tables and columns that clash with the operators' own."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from siglume.llm import decontaminate
from siglume.llm.common import materialize, table

NAMES = ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "bpe"]
#: Names that the operators use, or used, for columns of their own.
CLASH = (
    "key w at n_hit gram gm row known s c items hits toxic kept low_quality th dropped near n_near n_exact n_lines line first h1 h2 _h _d _t _th sid p x n "
    "root k1 rh ids n_tokens own node u v"
).split()


def test_stages(spark, sf_dir):
    assert [n for n, _ in C.STAGES] == NAMES
    docs = table(spark, sf_dir, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in C.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        after = docs.count()
        assert 0 < after <= before
        before = after
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    assert found.where("n_hit > 0").count() == 0
    last = C.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(last) == before and all(r.round_trip for r in last)


def _texts():
    r = random.Random(11)
    words = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(500)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared, item = line(12), line(30)
    out = [None, "", "  \n ", item, line(20) + " " + item[5:] + " " + line(15)]
    for k in range(8):
        base = [line(r.randint(8, 14)) for _ in range(8)]
        out += ["\n".join(base), "\n".join([*base[:3], base[3] + "x", shared, *base[4:]]), "\n".join([*base[:-1], line(9)])]
        w = line(80).split()
        out.append(" ".join(w))
        w[40] = "zz" + str(k)
        out.append(" ".join(w))
    return out, item


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    texts, item = _texts()
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[8], (None, texts[9], None, None, None)]
    sf = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in CLASH}).repartition(3)
    spark.createDataFrame([(k, k % 2, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs.write.parquet(f"{sf}/documents.parquet")
    return sf


def _lines(rows):
    """Drops a line of 16 or more characters that an earlier line equals or is one edit away from."""

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return a == b
        i = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else (a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :])

    seen, out = [], []
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        kept = []
        for x in t.split("\n") if t else []:
            if len(x) >= 16:
                if not any(near(x, y) for y in seen):
                    kept.append(x)
                seen.append(x)
            else:
                kept.append(x)
        out.append((d, "\n".join(kept) if t else t))
    return dict(out)


def test_stages_against_brute_force(spark, small):
    docs = table(spark, small, "documents")
    key = lambda r: (r.doc_id is not None, r.doc_id or 0)

    rated = materialize(C.quality(spark, docs, small), "t")
    assert rated.columns == docs.columns and {r.th for r in rated.collect()} == {"own th"}
    assert {r.doc_id for r in rated.collect()}.isdisjoint({0, 1, 2}) and rated.count() <= docs.count()

    lined = materialize(C.lines(spark, docs, small), "t")
    want = _lines([(r.doc_id, r.text) for r in docs.collect()])
    got = sorted(lined.collect(), key=key)
    before = {r.doc_id: r.text for r in docs.collect()}
    stay = {d: t for d, t in want.items() if t == before[d] or re.search(r"\S", t or "")}
    assert lined.columns == docs.columns and {r.doc_id: r.text for r in got} == stay
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.dropped == "own dropped" and r.n_near == "own n_near" for r in got)

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    rows = sorted({(r.doc_id, r.text) for r in docs.collect()}, key=lambda r: (r[0] is None, r[0] or 0))
    sets, home = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((home[i], home[j]))
                home = [a if h == b else h for h in home]
    kept = C.near_duplicates(spark, docs, small)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((rows[k][0] is None, rows[k][0] or 0) for k in range(len(rows)) if home[k] == k)
    assert {r.sid for r in got} == {"own sid"}

    item = next(r.text for r in table(spark, small, "benchmark").collect() if r.item_id == 1)
    w = item.split()
    windows = {" ".join(w[i : i + 10]) for i in range(len(w) - 9)}

    def clean(t):
        v = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        return not any(" ".join(v[i : i + 10]) in windows for i in range(len(v) - 9))

    left = C.benchmark(spark, docs, small)
    assert left.columns == docs.columns
    assert sorted(map(repr, left.collect())) == sorted(repr(r) for r in docs.collect() if clean(r.text))
    out = C.encode(spark, docs, small).collect()
    assert len(out) == docs.count() and all(r.round_trip for r in out)


def test_spans_keep_clashing_columns(spark, small):
    docs = table(spark, small, "documents")
    out = decontaminate.decontaminate(docs, table(spark, small, "benchmark"), mode="spans")
    assert out.columns == docs.columns and out.count() == docs.count()
    assert decontaminate.scan(out, table(spark, small, "benchmark")).where("n_hit > 0").count() == 0


def test_empty(spark, small, tmp_path):
    docs = table(spark, small, "documents").limit(0)
    for name, stage in C.STAGES:
        out = stage(spark, docs, small)
        assert out.count() == 0 and (name == "bpe" or out.columns == docs.columns)


def test_whole_run(spark, small):
    out = C.run(spark, small).collect()
    assert out and all(r.round_trip for r in out) and len({r.doc_id for r in out}) == len(out)
