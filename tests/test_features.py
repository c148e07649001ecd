"""Feature queries on small tables of their own, against their SQL where that has one answer."""

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from siglume.operators import tempo
from siglume.plans import feature_queries, note_queries
from siglume.plans.registry import ORACLE_SQL, QUERIES
from siglume.sources.views import sig_events


def write_events(spark, folder, rows):
    """``user_id, value`` rows in order as a table of events."""
    at = datetime.datetime(2024, 1, 1)
    rows = [(k, at + datetime.timedelta(seconds=k), u, "click", v) for k, (u, v) in enumerate(rows)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def by_sql(folder, name):
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        if (folder / f"{t}.parquet").exists():
            con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    q = con.sql(ORACLE_SQL[name])
    return [dict(zip(q.columns, r)) for r in q.fetchall()]


def plan_at_size(spark, make):
    """The plan that large tables get: no broadcast joins, reused shuffles shown."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        return make()._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_eval_rate_takes_each_mean_once(spark, monkeypatch):
    """Means half way between two roundings, off by less than a rounding of additions each time they are computed."""
    noise = F.udf(lambda v: v + random.choice((-1, 1)) * 1e-15, "double").asNondeterministic()
    sig = spark.range(600).select(F.col("id").alias("user_id"), F.lit(0).cast("long").alias("i"), noise(F.lit(0.1234565)).alias("x"))
    monkeypatch.setattr(feature_queries, "sig_events", lambda *_: sig)
    assert QUERIES["eval_rate"](spark, "").first().asDict() == {"files": 600, "missing": 200, "passed": 320, "rate": round(320 / 600, 9)}


def test_eval_join_takes_each_mean_once(spark, tmp_path, monkeypatch):
    """The same means; then a file without a mean, which differs from its reference, and one without a name, which has none."""
    d = write_events(spark, tmp_path, [(1, None), (2, 51.2), (3, 7.0), (-1, 4.0), (None, 3.0)])
    assert {(r.id, r.status) for r in QUERIES["eval_join"](spark, d).collect()} == {tuple(r.values()) for r in by_sql(tmp_path, "eval_join")}
    noise = F.udf(lambda v: v + random.choice((-1, 1)) * 1e-15, "double").asNondeterministic()
    sig = spark.range(600).select(F.col("id").alias("user_id"), F.lit(0).cast("long").alias("i"), noise(F.lit(0.1234565)).alias("x"))
    monkeypatch.setattr(note_queries, "sig_events", lambda *_: sig)
    got = QUERIES["eval_join"](spark, "").groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in got} == {"identical": 400, "missing_reference": 200}


def test_eval_rate_counts_absent_references_only(spark, tmp_path):
    """A file without a mean has a reference still; one without a name has none."""
    rows = [(1, None), (1, None), (2, 51.2), (3, 7.0), (5, 1.0), (-1, 4.0), (-5, 4.0), (None, 3.0)]
    d = write_events(spark, tmp_path, rows)
    got = [r.asDict() for r in QUERIES["eval_rate"](spark, d).collect()]
    assert got == by_sql(tmp_path, "eval_rate")
    assert got[0]["missing"] == 2 and got[0]["passed"] == 2


def test_autocorrelation_shuffles_each_sample_once(spark, sf_dir):
    plan = plan_at_size(spark, lambda: tempo.autocorrelation(sig_events(spark, sf_dir), "user_id", 3, 20, 10.0))
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_autocorrelation_of_odd_signals(spark):
    """Gaps between places, values that are null, signals too short or without variance, rows without a key."""
    rng = random.Random(5)
    rows = [(1, i, rng.random()) for i in range(60) if i % 7 != 3] + [(2, i, None if i == 9 else rng.random()) for i in range(40)]
    rows += [(3, i, rng.random()) for i in range(6)] + [(4, i, 2.0) for i in range(30)] + [(None, i, rng.random()) for i in range(30)]
    low, high = 2, 5
    got = tempo.autocorrelation(spark.createDataFrame(rows, "k long, i long, x double"), "k", low, high, 10.0).collect()
    want = {}
    for k in (1, 2):
        x = {i: v for u, i, v in rows if u == k}
        there = [v for v in x.values() if v is not None]
        mean = sum(there) / len(there)
        d = {i: v - mean for i, v in x.items() if v is not None}
        for lag in range(low, high + 1):
            s = sum(d[i] * d[i + lag] for i in d if i + lag in d)
            want[k, lag] = min(max(s * len(x) / (sum(v * v for v in d.values()) * (len(x) - lag)), 0.0), 1.0)
    assert {(r.k, r.lag) for r in got} == set(want) and len(got) == len(want)
    assert all(r.clarity == pytest.approx(want[r.k, r.lag], abs=1e-9) for r in got)


@pytest.mark.parametrize("name", ["gated_loudness", "loudness_range"])
def test_gates_shuffle_each_sample_once(spark, sf_dir, name):
    plan = plan_at_size(spark, lambda: QUERIES[name](spark, sf_dir))
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.mark.parametrize("name", ["signal_features", "verify_specs"])
def test_features_shuffle_samples_once_for_all_branches(spark, sf_dir, name):
    plan = plan_at_size(spark, lambda: QUERIES[name](spark, sf_dir))
    assert len([line for line in plan.splitlines() if "FileScan" in line and "ts#" in line]) == 1


@pytest.mark.parametrize("name", ["signal_features", "verify_specs"])
def test_features_of_odd_signals(spark, tmp_path, name):
    """Signals of one to 80 samples, some too short for a beat, and rows without a user. (The SQL divides by zero for constant ones.)"""
    rng = random.Random(3)
    rows = [(u, round(rng.uniform(0, 512), 2)) for u, n in ((1, 1), (2, 4), (3, 21), (4, 22), (5, 30), (6, 80), (None, 45)) for _ in range(n)]
    d = write_events(spark, tmp_path, rows)
    spark.createDataFrame([(s, rng.random(), rng.random()) for s in (1, 4, 6, 6, 7, None)], "l_suppkey long, l_discount double, l_tax double").write.parquet(f"{d}/lineitem.parquet")
    order = lambda r: str((r.get("spec_id"), r["user_id"]))
    got, want = sorted((r.asDict() for r in QUERIES[name](spark, d).collect()), key=order), sorted(by_sql(tmp_path, name), key=order)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == {k: pytest.approx(v, abs=2e-6) if isinstance(v, float) else v for k, v in b.items()}
