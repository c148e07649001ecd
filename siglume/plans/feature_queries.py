"""Whole-signal features: filtered loudness, true peak, pitch, harmony buckets, timelines, comparison, schedules, rendering."""

from __future__ import annotations

import math

from pyspark.sql import Window as W, functions as F

from siglume.functions.scalars import lin_to_db
from siglume.operators import digests, kernels, levels, onsets, schedule, sequences, sequential, spectral, tempo
from siglume.plans.catalog import ORACLE_SQL, query, rounded
from siglume.plans.level_queries import DB, NMS
from siglume.plans.note_queries import SEGS, STEPS
from siglume.plans.spectral_queries import HZ, PC
from siglume.sources.views import frame_bins, notes, runs, sig_daily, sig_events, table, with_views

LIVE = "CASE WHEN {0} > 0 THEN -0.691 + 10 * log10({0}) END"
PICKED = with_views("sig", recursive=True) + NMS
(SB, SA), (HB, HA) = kernels.k_weighting(8_000)
FILTERED = f""", flt AS (SELECT user_id, i, {SB[0]!r} * x AS u, {SB[1]!r} * x - {SA[1]!r} * ({SB[0]!r} * x) AS s1, {SB[2]!r} * x - {SA[2]!r} * ({SB[0]!r} * x) AS s2,
{HB[0]!r} * ({SB[0]!r} * x) AS y, {HB[1]!r} * ({SB[0]!r} * x) - {HA[1]!r} * ({HB[0]!r} * ({SB[0]!r} * x)) AS h1, {HB[2]!r} * ({SB[0]!r} * x) - {HA[2]!r} * ({HB[0]!r} * ({SB[0]!r} * x)) AS h2 FROM sig WHERE i = 0
UNION ALL SELECT user_id, i, u, {SB[1]!r} * x - {SA[1]!r} * u + s2, {SB[2]!r} * x - {SA[2]!r} * u, y, {HB[1]!r} * u - {HA[1]!r} * y + h2, {HB[2]!r} * u - {HA[2]!r} * y FROM (
SELECT *, {HB[0]!r} * u + h1 AS y FROM (SELECT n.user_id, n.i, n.x, {SB[0]!r} * n.x + f.s1 AS u, f.s2, f.h1, f.h2 FROM flt f JOIN sig n ON n.user_id = f.user_id AND n.i = f.i + 1)))"""


def _filtered(spark, sf_dir):
    return sequential.biquads(sig_events(spark, sf_dir), "user_id", kernels.k_weighting(8_000))


@query(with_views("sig", recursive=True) + FILTERED + "SELECT user_id, i, round(y, 6) AS y FROM flt")
def k_weighting(spark, sf_dir):
    """Samples through the two loudness filters (ITU-R BS.1770) at 8 kHz."""
    return rounded(_filtered(spark, sf_dir))


@query(with_views("sig", recursive=True) + FILTERED + f""", p AS (SELECT user_id, i, CASE WHEN i >= 3 THEN avg(y * y) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS m,
CASE WHEN i >= 29 THEN avg(y * y) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) END AS s FROM flt)
SELECT user_id, round(max({LIVE.format('m')}), 5) AS momentary_max, round(max({LIVE.format('s')}), 5) AS short_term_max FROM p GROUP BY 1""")
def loudness_maxima(spark, sf_dir):
    """Largest momentary and short-term loudness of the filtered samples."""
    y = _filtered(spark, sf_dir).withColumnRenamed("y", "x")
    p = y.withColumns({"m": levels.rolling_power(y, "user_id", 4), "s": levels.rolling_power(y, "user_id", 30)})
    return rounded(p.groupBy("user_id").agg(F.max(levels.loudness(F.col("m"))).alias("momentary_max"), F.max(levels.loudness(F.col("s"))).alias("short_term_max")), places=5)


TAPS = ", ".join(f"({p}, {j}, {v!r})" for p in range(1, 4) for j, v in enumerate(sequential.phase_taps(p, 4, 12)))


@query(with_views("sig") + f""", taps(p, j, h) AS (VALUES {TAPS}), c AS (SELECT a.user_id, a.i, p, sum(b.x * h) AS v FROM sig a JOIN sig b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 11 AND a.i JOIN taps ON j = b.i - a.i + 11 WHERE a.i >= 11 GROUP BY 1, 2, 3),
t AS (SELECT user_id, max(abs(v)) AS t FROM c GROUP BY 1), s AS (SELECT user_id, max(abs(x)) AS s FROM sig GROUP BY 1)
SELECT user_id, round(greatest(s, coalesce(t, 0)), 9) AS true_peak, greatest(s, coalesce(t, 0)) > 1 AS over FROM s LEFT JOIN t USING (user_id)""")
def true_peak(spark, sf_dir):
    """Peak between the samples, oversampled four times, and whether it lies above full scale."""
    t = sequential.true_peak(sig_events(spark, sf_dir), "user_id")
    return t.select("user_id", F.round("true_peak", 9).alias("true_peak"), (F.col("true_peak") > 1).alias("over"))


@query(with_views("sig") + "SELECT user_id, round(count(*) FILTER (x > 0.4) / count(*), 9) AS voiced_ratio, round(median(110 + x * 700) FILTER (x > 0.4), 6) AS median_f0 FROM sig GROUP BY 1")
def pitch_summary(spark, sf_dir):
    f0 = F.when(F.col("x") > 0.4, 110 + F.col("x") * 700)
    return sig_events(spark, sf_dir).groupBy("user_id").agg(F.round(F.count(f0) / F.count("*"), 9).alias("voiced_ratio"), F.round(F.median(f0), 6).alias("median_f0"))


SEGMENTS = f""", seg AS (SELECT user_id, i // 4 AS seg, count(*) AS n, {DB.format('sqrt(avg(x * x))')} AS db, {DB.format('max(abs(x))')} AS pk, median(110 + x * 700) FILTER (x > 0.4) AS f0 FROM sig GROUP BY 1, 2),
ons AS (SELECT user_id, i // 4 AS seg, count(*) AS c FROM picked GROUP BY 1, 2), tl AS (SELECT s.*, coalesce(c, 0) AS onsets, coalesce(db <= -17, true) AS silent FROM seg s LEFT JOIN ons USING (user_id, seg))"""


def _timeline(spark, sf_dir):
    sig = sig_events(spark, sf_dir)
    f0 = sig.select("user_id", "i", F.when(F.col("x") > 0.4, 110 + F.col("x") * 700).alias("f0"))
    return digests.timeline(sig, onsets.onsets(sig, "user_id", scale=1.5, min_gap=3), f0, "user_id", 4, floor_db=-17.0)


@query(PICKED + SEGMENTS + "SELECT user_id, seg, n, round(db, 6) AS rms_db, round(pk, 6) AS peak_db, silent, onsets, round(f0, 6) AS f0 FROM tl")
def segment_detail(spark, sf_dir):
    """Timeline windows with levels, onset counts and the median pitch of their voiced hops."""
    return rounded(_timeline(spark, sf_dir))


DIGEST = SEGMENTS + """, w AS (SELECT user_id, CASE WHEN count(*) > 10 THEN CAST(ceil(count(*) / 10.0) AS BIGINT) ELSE 1 END AS w FROM tl GROUP BY 1),
row AS (SELECT user_id, seg // w AS line, min(seg) AS first, max(seg) AS last, max(db) AS db, max(pk) AS pk, CAST(sum(onsets) AS BIGINT) AS onsets, bool_and(silent) AS silent, median(f0) AS f0 FROM tl JOIN w USING (user_id) GROUP BY 1, 2),
isl AS (SELECT *, line - row_number() OVER (PARTITION BY user_id, silent ORDER BY line) AS g FROM row), len AS (SELECT *, count(*) OVER (PARTITION BY user_id, silent, g) AS run FROM isl)"""


@query(PICKED + DIGEST + """ SELECT user_id, min(first) AS first, max(last) AS last, CASE WHEN any_value(silent AND run >= 3) THEN NULL ELSE round(max(db), 6) END AS rms_db,
CAST(sum(onsets) AS BIGINT) AS onsets, round(CASE WHEN any_value(silent AND run >= 3) THEN NULL ELSE max(f0) END, 6) AS f0, any_value(silent) AS silent, any_value(silent AND run >= 3) AS collapsed
FROM len GROUP BY user_id, CASE WHEN silent AND run >= 3 THEN -1 - g ELSE line END, silent AND run >= 3""")
def digest_timeline(spark, sf_dir):
    """Display rows: windows merged to at most ten a signal, then silent runs of three rows and more in one."""
    return rounded(digests.display_rows(_timeline(spark, sf_dir), "user_id", most=10, least=3))


@query(with_views("bins") + f"SELECT frame // 10 AS bucket, {PC} AS pc, round(sum(m), 6) AS c FROM bins WHERE {HZ} BETWEEN 55 AND 5000 GROUP BY 1, 2")
def chroma_buckets(spark, sf_dir):
    """Chroma added up over buckets of ten frames, before chords are labelled."""
    b = frame_bins(spark, sf_dir).withColumn("bucket", F.floor(F.col("frame") / 10))
    return rounded(spectral.chroma(b, (F.col("bin") + 1) * 60.0, key="bucket"))


@query(with_views("runs") + """, lab AS (SELECT user_id, i, CASE WHEN label <> 'click' THEN label END AS label FROM runs), isl AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, label ORDER BY i) AS g FROM lab),
r AS (SELECT user_id, label, min(i) AS start, max(i) + 1 AS stop FROM isl GROUP BY user_id, label, g),
f AS (SELECT user_id, start, stop, CASE WHEN label IS NOT NULL AND stop - start < 2 THEN coalesce(last_value(label IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
first_value(label IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY start ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), label) ELSE label END AS label FROM r),
t AS (SELECT *, CASE WHEN lag(label) OVER w IS NOT DISTINCT FROM label AND lag(start) OVER w IS NOT NULL THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY user_id ORDER BY start)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start) AS b FROM t)
SELECT user_id, label, min(start) AS start, max(stop) AS stop FROM b WHERE label IS NOT NULL GROUP BY user_id, b, label""")
def smoothed_runs(spark, sf_dir):
    """Runs of one frame take their neighbour's label; then equal neighbours are one run. Clicks are unlabelled frames."""
    r = runs(spark, sf_dir).withColumn("label", F.when(F.col("label") != "click", F.col("label")))
    w = W.partitionBy("user_id").orderBy("i")
    change = F.when(F.lag("label").over(w).eqNullSafe(F.col("label")) & F.lag("i").over(w).isNotNull(), 0).otherwise(1)
    g = r.withColumn("new", change).withColumn("g", F.sum("new").over(w))
    islands = g.groupBy("user_id", "g", "label").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop")).drop("g")
    return sequences.smooth_runs(islands, "user_id", "label", 2)


@query(PICKED + SEGMENTS + """, d AS (SELECT a.user_id AS a, a.seg, b.db - a.db AS d FROM tl a JOIN tl b ON b.user_id = a.user_id + 1 AND a.seg = b.seg WHERE a.n = 4 AND b.n = 4)
SELECT a, a + 1 AS b, count(*) AS segments, round(max(abs(d)), 6) AS worst, arg_min(seg, (-round(abs(d), 9), seg)) FILTER (d IS NOT NULL) AS worst_at, round(avg(d), 6) AS mean FROM d GROUP BY 1""")
def segment_delta(spark, sf_dir):
    """Level differences of two signals window by window: the worst, the first place of it and the mean."""
    t = _timeline(spark, sf_dir).where("n = 4").select("user_id", "seg", "rms_db")
    return rounded(digests.segment_delta(t, t.withColumn("user_id", F.col("user_id") - 1), "user_id").withColumnRenamed("user_id", "a").withColumn("b", F.col("a") + 1))


MATCHED = """, a AS (SELECT user_id, i * 100.0 AS ta FROM picked), b AS (SELECT user_id - 1 AS user_id, i * 100.0 + 50 AS tb FROM picked),
cand AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(ta - tb), ta, tb) AS k FROM a JOIN b USING (user_id) WHERE abs(ta - tb) <= 150),
mw AS (SELECT user_id, k, [ta] AS las, [tb] AS lbs, true AS took, ta, tb FROM cand WHERE k = 1 UNION ALL
SELECT c.user_id, c.k, CASE WHEN free THEN list_append(las, c.ta) ELSE las END, CASE WHEN free THEN list_append(lbs, c.tb) ELSE lbs END, free, c.ta, c.tb
FROM (SELECT c.*, w.las, w.lbs, NOT list_contains(w.las, c.ta) AND NOT list_contains(w.lbs, c.tb) AS free FROM mw w JOIN cand c ON c.user_id = w.user_id AND c.k = w.k + 1) c),
pairs AS (SELECT user_id, ta, tb FROM mw WHERE took)"""
ORACLE_SQL["onset_match"] = PICKED + MATCHED + "SELECT user_id, CAST(ta AS DOUBLE) AS ta, CAST(tb AS DOUBLE) AS tb FROM pairs"


def _two_sides(spark, sf_dir):
    o = onsets.onsets(sig_events(spark, sf_dir), "user_id", scale=1.5, min_gap=3).select("user_id", (F.col("i") * 100.0).alias("t"))
    return o, o.select((F.col("user_id") - 1).alias("user_id"), (F.col("t") + 50.0).alias("t"))


@query(PICKED + MATCHED + """SELECT user_id, 'a' AS side, CAST(ta AS DOUBLE) AS t FROM a WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.user_id = a.user_id AND p.ta = a.ta)
UNION ALL SELECT user_id, 'b', CAST(tb AS DOUBLE) FROM b WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.user_id = b.user_id AND p.tb = b.tb)""")
def unmatched_onsets(spark, sf_dir):
    a, b = _two_sides(spark, sf_dir)
    return sequences.unmatched(a, b, sequences.match_onsets(a, b, "user_id", 150.0), "user_id")


ORACLE_SQL["beat_grid"] = with_views("daily", recursive=True) + """, sd AS (SELECT stddev_pop(x) AS sd FROM daily), env AS (SELECT list(x / sd ORDER BY i) AS xs FROM daily, sd),
dp AS (SELECT 0 AS t, [xs[1]] AS sc, [-1] AS bk FROM env UNION ALL SELECT t + 1, list_append(sc, xs[t + 2] + CASE WHEN coalesce(list_max(cand), -1) > 0 THEN list_max(cand) ELSE 0 END),
list_append(bk, CASE WHEN coalesce(list_max(cand), -1) > 0 THEN CAST(greatest(0, t + 1 - 14) + list_position(cand, list_max(cand)) - 1 AS INTEGER) ELSE -1 END)
FROM (SELECT t, sc, bk, xs, list_transform(range(greatest(0, t + 1 - 14), t + 1 - 4 + 1), lambda tau: sc[tau + 1] - 400 * pow(ln((t + 1 - tau) / 7.0), 2)) AS cand FROM dp, env WHERE t + 1 < len(xs))),
fin AS (SELECT sc, bk FROM dp ORDER BY t DESC LIMIT 1), path AS (SELECT CAST(list_position(sc, list_max(sc)) - 1 AS INTEGER) AS pos, 0 AS k FROM fin UNION ALL SELECT bk[pos + 1], k + 1 FROM path, fin WHERE bk[pos + 1] >= 0)
SELECT row_number() OVER (ORDER BY k DESC) - 1 AS beat, CAST(pos AS BIGINT) AS i FROM path"""


@query(with_views("notes") + "SELECT track, max(onset + dur) AS end_tick, count(*) AS n, count(DISTINCT midi) AS pitches FROM notes GROUP BY 1")
def score_extent(spark, sf_dir):
    """Last tick of each track's notes, and its distinct pitches."""
    return notes(spark, sf_dir).groupBy("track").agg(F.max(F.col("onset") + F.col("dur")).alias("end_tick"), F.count("*").alias("n"), F.countDistinct("midi").alias("pitches"))


@query(with_views("sig") + """, c AS (SELECT user_id AS id, round(avg(x), 6) AS m FROM sig GROUP BY 1), ref AS (SELECT id, CASE WHEN id % 5 = 0 THEN m + 1 ELSE m END AS m FROM c WHERE id % 3 <> 0)
SELECT count(*) AS files, count(*) FILTER (r.id IS NULL) AS missing, count(*) FILTER (c.m = r.m) AS passed, round(count(*) FILTER (c.m = r.m) / count(*), 9) AS rate FROM c LEFT JOIN ref r USING (id)""")
def eval_rate(spark, sf_dir):
    """Share of files that agree with their reference; a missing reference is no pass. References are made of the files' own means,
    so both stand in one row: a mean computed twice could add in another order and round the other way."""
    c = sig_events(spark, sf_dir).groupBy(F.col("user_id").alias("id")).agg(F.round(F.avg("x"), 6).alias("m"))
    there = F.coalesce(F.col("id") % 3 != 0, F.lit(False))
    c = c.select("m", there.alias("there"), F.when(there, F.when(F.col("id") % 5 == 0, F.col("m") + 1).otherwise(F.col("m"))).alias("r"))
    passed = F.count_if(F.col("m") == F.col("r"))
    return c.agg(F.count("*").alias("files"), F.count_if(~F.col("there")).alias("missing"), passed.alias("passed"), F.round(passed / F.count("*"), 9).alias("rate"))


@query("""WITH t AS (SELECT user_id AS track, event_id % 20 * 480 AS tick, event_id AS k, 60 + event_id % 120 AS bpm FROM events), l AS (SELECT track, tick, arg_max(bpm, k) AS bpm FROM t GROUP BY 1, 2)
SELECT track, tick, bpm, CAST(floor(60000000000.0 / bpm + 0.5) AS BIGINT) AS npq FROM l""")
def tempo_upsert(spark, sf_dir):
    """One tempo a tick: the last call wins."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), (F.pmod("event_id", F.lit(20)) * 480).alias("tick"), F.col("event_id").alias("k"), (60 + F.pmod("event_id", F.lit(120))).alias("bpm"))
    return schedule.upsert(e, ["track", "tick"], "k", ["bpm"]).withColumn("npq", F.floor(F.lit(60000000000.0) / F.col("bpm") + 0.5))


@query(with_views("notes") + SEGS + """, evs AS (SELECT track, note, midi, vel, onset AS tick, true AS on_ FROM notes UNION ALL SELECT track, note, midi, vel, onset + dur, false FROM notes),
s AS (SELECT track, note, midi, vel, on_, CAST(anchor + (2 * CAST(tick - s AS HUGEINT) * npq * 48000 + 480000000000) // 960000000000 AS BIGINT) AS sample FROM evs JOIN seg ON tick >= s AND (nx IS NULL OR tick < nx))
SELECT track, note, midi, on_ AS starts, sample, sample // 64 AS block, sample % 64 AS offs, row_number() OVER (PARTITION BY track ORDER BY sample, on_, midi, note) - 1 AS place FROM s""")
def event_schedule(spark, sf_dir):
    """Notes as note-on and note-off events in samples, split into blocks of 64; at one sample ends come before starts, then
    lower pitches."""
    n = notes(spark, sf_dir).select("track", "note", "midi", "onset", "dur")
    return schedule.events(n, "track", STEPS, 480, 48_000, 64)


@query(with_views("notes") + """, v AS (SELECT track, midi, vel, onset / 960.0 AS a, dur / 960.0 AS d FROM notes WHERE note < 40), s AS (SELECT track, midi, vel, a, d, CAST(k AS BIGINT) AS k FROM v, LATERAL (SELECT unnest(range(CAST(ceil(a * 50) AS BIGINT), CAST(ceil((a + d + 0.15) * 50) AS BIGINT))) AS k)),
e AS (SELECT track, k, k / 50.0 - a AS t, d, vel, 440 * pow(2.0, (midi - 69) / 12.0) AS hz FROM s),
y AS (SELECT track, k, sin(2 * pi() * hz * t) * 0.3 * pow(vel / 127, 2) * CASE WHEN t < d THEN CASE WHEN t < 0.005 THEN t / 0.005 WHEN t < 0.005 + 0.05 THEN 1 - (1 - 0.85) * (t - 0.005) / 0.05 ELSE 0.85 END
ELSE CASE WHEN d < 0.005 THEN d / 0.005 WHEN d < 0.005 + 0.05 THEN 1 - (1 - 0.85) * (d - 0.005) / 0.05 ELSE 0.85 END * greatest(1 - (t - d) / 0.15, 0) END AS y FROM e)
SELECT track, k, round(sum(y), 6) AS y FROM y GROUP BY 1, 2""")
def render_sines(spark, sf_dir):
    """The first 40 notes of each track as enveloped sines, mixed sample by sample at 50 Hz."""
    n = notes(spark, sf_dir).where("note < 40").select("track", "midi", "vel", (F.col("onset") / 960).alias("start_s"), (F.col("dur") / 960).alias("seconds"))
    return rounded(schedule.mix_sines(n, "track", 50))


@query(with_views("sig", recursive=True) + """, ld AS (SELECT user_id, i, x * pow(10.0, 3 / 20.0) AS x FROM sig), need AS (SELECT user_id, i, x, CASE WHEN max(abs(x)) OVER w > 0.8 THEN 0.8 / max(abs(x)) OVER w ELSE 1 END AS need FROM ld WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
g AS (SELECT user_id, i, x, least(1.0, need) AS gain FROM need WHERE i = 0 UNION ALL SELECT n.user_id, n.i, n.x, least(1 - (1 - g.gain) * 0.9, n.need) FROM g JOIN need n ON n.user_id = g.user_id AND n.i = g.i + 1)
SELECT user_id, i, round(x * gain, 6) AS y FROM g""".replace("3 / 20.0", "3.0 / 20"))
def master_bus(spark, sf_dir):
    """Three decibels of gain into the limiter."""
    return rounded(schedule.master(sig_events(spark, sf_dir), "user_id", 3.0, ceiling=0.8, lookahead=5, keep=0.9))


@query("""WITH t AS (SELECT event_id, user_id AS track, ['sine','organ','custom','theremin'][event_id % 4 + 1] AS preset FROM events), p(preset, polyphony) AS (VALUES ('sine', 16), ('organ', 16), ('kick', 0))
SELECT event_id, track, t.preset, CAST(polyphony AS BIGINT) AS polyphony, CASE WHEN t.preset = 'custom' THEN 'own patch' WHEN polyphony IS NULL THEN 'unknown preset' ELSE 'catalog' END AS status FROM t LEFT JOIN p USING (preset)""")
def track_patches(spark, sf_dir):
    """Each track's patch from the preset catalog; custom tracks bring their own."""
    names = F.array(*[F.lit(v) for v in ("sine", "organ", "custom", "theremin")])
    t = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("track"), F.element_at(names, (F.pmod("event_id", F.lit(4)) + 1).cast("int")).alias("preset"))
    catalog = spark.createDataFrame([("sine", 16), ("organ", 16), ("kick", 0)], "preset string, polyphony long")
    return schedule.with_patch(t, catalog).select("event_id", "track", "preset", "polyphony", "status")


@query(with_views("runs") + """, l AS (SELECT user_id, label, i FROM runs), c AS (SELECT user_id, count(*) AS n, list(label ORDER BY i) AS v FROM l GROUP BY 1)
SELECT user_id, array_to_string(v[1:16], ' ') || CASE WHEN n > 16 THEN ' +' || CAST(n - 16 AS VARCHAR) ELSE '' END AS line FROM c""")
def capped_lines(spark, sf_dir):
    """The first sixteen entries of a list as one line, and how many more there are."""
    return digests.capped_line(runs(spark, sf_dir), "user_id", "label", 16)


VERDICT = with_views("sig") + f""", r AS (SELECT user_id AS id, count(*) * 10.0 AS ms, {DB.format('sqrt(avg(x*x))')} AS db, median(110 + x * 700) FILTER (x > 0.9) AS f0, count(*) FILTER (x > 0.95) AS hits, CAST(floor(avg(x) * 200) AS BIGINT) % 12 AS tonic,
md5(string_agg(CAST(CAST(round(x * 51200) AS BIGINT) AS VARCHAR), ',' ORDER BY i)) AS h FROM sig GROUP BY 1), q AS (SELECT * FROM r UNION ALL SELECT id + 100000, ms, db, f0, hits, tonic, h FROM r WHERE id % 7 = 0)"""


@query(VERDICT + """SELECT a.id AS a, b.id AS b, a.h = b.h AS identical, CASE WHEN a.h = b.h THEN 'identical' ELSE coalesce(nullif(concat_ws(',', CASE WHEN abs(b.ms - a.ms) > 1 THEN 'duration' END,
CASE WHEN (a.db IS NULL) <> (b.db IS NULL) OR coalesce(abs(b.db - a.db), 0) > 0.1 THEN 'loudness' END, CASE WHEN a.hits <> b.hits THEN 'onsets' END,
CASE WHEN (a.f0 IS NULL) <> (b.f0 IS NULL) OR coalesce(abs(1200 * log2(b.f0 / a.f0)), 0) > 5 THEN 'pitch' END, CASE WHEN a.tonic <> b.tonic THEN 'key' END), ''), 'tier2') END AS verdict
FROM q a JOIN q b ON b.id = a.id + 1 OR b.id = a.id + 100000""")
def compare_verdict(spark, sf_dir):
    """Verdicts of pairs over all five dimensions; identical means equal samples, told by a digest of them."""
    s = sig_events(spark, sf_dir)
    r = s.groupBy(F.col("user_id").alias("id")).agg(
        (F.count("*") * 10.0).alias("ms"), lin_to_db(F.sqrt(F.avg(F.col("x") * F.col("x")))).alias("db"), F.median(F.when(F.col("x") > 0.9, 110 + F.col("x") * 700)).alias("f0"),
        F.count_if(F.col("x") > 0.95).alias("hits"), F.pmod(F.floor(F.avg("x") * 200), F.lit(12)).alias("tonic"), digests.samples_digest("x", 51200).alias("h"),
    )
    q = r.unionByName(r.where("id % 7 = 0").withColumn("id", F.col("id") + 100_000))
    pairs = q.select(F.col("id").alias("a"), F.explode(F.array(F.col("id") + 1, F.col("id") + 100_000)).alias("b"))
    return digests.verdicts(q, pairs)


@query(with_views("sig") + f""", f AS (SELECT user_id, i, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x FROM sig), s AS (SELECT user_id, count(*) AS n, max(abs(x)) AS pk, sqrt(avg(x * x)) AS rms, count(*) FILTER (abs(x) >= 1) AS clipped FROM f GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS signal_id, n AS samples, round(n / 8.0, 6) AS duration_ms, round({DB.format('pk')}, 5) AS sample_peak, clipped, CASE WHEN coalesce({DB.format('rms')} > -60, false) THEN CAST(0 AS DOUBLE) ELSE round(n / 8.0, 6) END AS leading_ms FROM s WHERE n < 400""")
def probe_fields(spark, sf_dir):
    """Fields of the whole-signal report, read back from its JSON: signals shorter than one silence window."""
    from siglume.operators import probe
    from siglume.sources import wav

    r = probe.probe(wav.pack(sig_events(spark, sf_dir), "user_id", 8_000))
    shape = "struct<source:struct<samples:bigint,duration_ms:double>,loudness:struct<sample_peak:double>,clipping:struct<clipped_samples:bigint>,silence:struct<leading_ms:double>>"
    j = r.select("signal_id", F.from_json("report", shape).alias("r")).where("r.source.samples < 400")
    return j.select(
        "signal_id", F.col("r.source.samples").alias("samples"), F.round("r.source.duration_ms", 6).alias("duration_ms"), F.round("r.loudness.sample_peak", 5).alias("sample_peak"),
        F.col("r.clipping.clipped_samples").alias("clipped"), F.round("r.silence.leading_ms", 6).alias("leading_ms"),
    )
