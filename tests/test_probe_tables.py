"""Reports, timelines, beats, cuts, transcription and comparison over packed tables."""

import json

import numpy as np
import pytest

from siglume.operators import kernels, probe
from siglume.sources import wav

SR = 8_000


@pytest.fixture(scope="module")
def packed(spark):
    t = np.arange(2 * SR) / SR
    a = (0.5 * np.sin(2 * np.pi * 440 * t)).astype(np.float32)
    b = np.concatenate([a[:SR], np.zeros(SR, np.float32)])
    rows = [(n, SR, 1, k, k * 4000, x[k * 4000 : (k + 1) * 4000].tolist()) for n, x in (("a", a), ("b", b)) for k in range(4)]
    return spark.createDataFrame(rows, wav.PACKED).repartition(3)


def test_reports_and_compare(spark, packed):
    reports = probe.probe(packed)
    got = {r.signal_id: json.loads(r.report) for r in reports.collect()}
    assert got["a"]["pitch"]["median_f0_hz"] == pytest.approx(440, rel=3e-3) and got["b"]["silence"]["trailing_ms"] == pytest.approx(1000, abs=60)
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "zz")], "a string, b string")
    assert {(r.a, r.b): r.status for r in probe.compare_pairs(reports, pairs).collect()} == {("a", "a"): "identical", ("a", "b"): "differs", ("b", "zz"): "missing_reference"}


def test_cut_prunes_and_shifts(packed):
    got = {r.signal_id: len(r.x) for r in probe.cut(packed, 0.25, 1.6).groupBy("signal_id").agg({"samples": "collect_list"}).selectExpr("signal_id", "flatten(`collect_list(samples)`) x").collect()}
    assert got == {"a": round(1.6 * SR) - round(0.25 * SR), "b": round(1.6 * SR) - round(0.25 * SR)}
    assert probe.cut(packed, 0.25, 1.6).agg({"start_frame": "min"}).first()[0] == 0


def test_timeline_notes_beats(packed):
    rows = {(r.signal_id, r["index"]): r for r in probe.timeline(packed, 500).collect()}
    assert len(rows) == 8 and rows["b", 3].silent and rows["b", 3].rms_db is None and not rows["a", 3].silent
    assert rows["a", 1].midi == 69 and rows["a", 1].mid > 0.9
    notes = [r for r in probe.transcribe(packed).collect() if r.signal_id == "a"]
    assert [r.midi for r in notes] == [69]
    assert probe.beats(packed).count() == 0
    with pytest.raises(ValueError):
        kernels.timeline(np.zeros(10), SR, 0.5)
    assert kernels.timeline(np.zeros(0), SR) == []


def test_files(spark, packed, tmp_path):
    for r in wav.wav_files(packed, "16").collect():
        (tmp_path / f"{r.signal_id}.wav").write_bytes(bytes(r.wav))
    back = wav.read_audio(spark, str(tmp_path))
    assert back.selectExpr("sum(size(samples))").first()[0] == 4 * SR
    kinds = spark.read.format("binaryFile").load(str(tmp_path)).select(wav.sniff(__import__("pyspark").sql.functions.col("content")).alias("k")).distinct().collect()
    assert [k.k for k in kinds] == ["wav"]
