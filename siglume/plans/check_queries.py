"""Checks of authored specs: of whole signals by their features, and of tracks by their notes and samples."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from siglume.functions.scalars import lin_to_db
from siglume.operators import levels, onsets, tempo, verify
from siglume.plans.catalog import query
from siglume.plans.level_queries import DB, GATED, NMS
from siglume.sources.views import sig_events, sig_stereo, with_views

LOW, HIGH, RATE = 3, 20, 10.0
#: One spec of each kind for each user: kind, a, b and ratio as functions of the user, the same in both languages.
VALUE_SPECS = [
    ("integrated_lufs", "-6.0", "0.4"), ("true_peak_below", "-0.2", "0.0"), ("lra_below", "2.5", "0.0"), ("tempo_is", "100.0", "20.0"), ("has_clear_rhythm", "1.0", "0.0"),
    ("grid_alignment_at_least", "0.5", "0.0"), ("stereo_width_within", "0.1", "0.25"), ("section_count", "8.0", "11.0"), ("loudness_is_nice", "1.0", "0.0"),
]
SPEC_SQL = ", ".join(f"({k}, '{kind}', {a}, {b})" for k, (kind, a, b) in enumerate(VALUE_SPECS))

BEATS = """, beats AS (SELECT user_id, CAST(k AS DOUBLE) * 500 AS t FROM (SELECT user_id, max(i) AS m FROM sig GROUP BY 1), LATERAL (SELECT unnest(range(1, m // 5)) AS k)),
on_ AS (SELECT user_id, i * 100.0 + (i * 37 % 40) AS t FROM picked), nb AS (SELECT *, lead(t) OVER w AS nx, lag(t) OVER w AS pv FROM beats WINDOW w AS (PARTITION BY user_id ORDER BY t)),
sp AS (SELECT user_id, t AS a, nx AS b, false AS last FROM nb WHERE nx IS NOT NULL UNION ALL SELECT user_id, t, 2*t - pv, true FROM nb WHERE nx IS NULL AND pv IS NOT NULL UNION ALL SELECT user_id, 2*t - nx, t, false FROM nb WHERE pv IS NULL AND nx IS NOT NULL),
h AS (SELECT o.user_id, o.t, s, (o.t - a) / ((b - a) / s) AS pos, (b - a) / s AS sub FROM on_ o JOIN sp ON o.user_id = sp.user_id AND o.t >= a AND (o.t < b OR (last AND o.t = b)) CROSS JOIN (VALUES (4), (3)) v(s)),
grid AS (SELECT user_id, s, count(*) FILTER (abs(pos - round(pos)) * sub <= greatest(0.15 * sub, 10)) AS aligned FROM h GROUP BY 1, 2),
best AS (SELECT user_id, coalesce(max(aligned) FILTER (s = 4), 0) AS four, coalesce(max(aligned) FILTER (s = 3), 0) AS three FROM grid GROUP BY 1),
hits AS (SELECT user_id, count(*) AS n FROM picked GROUP BY 1),
rhythm AS (SELECT h.user_id, h.n, greatest(four, three) / h.n AS alignment, CASE WHEN three > four THEN 'triplet' ELSE 'straight' END AS kind FROM hits h LEFT JOIN best USING (user_id))"""
TEMPO = f""", st AS (SELECT user_id AS k, avg(x) AS mean, count(*) AS n FROM sig GROUP BY 1), cc AS (SELECT user_id AS k, i, st.n, x - mean AS d FROM sig JOIN st ON st.k = sig.user_id WHERE st.n > {HIGH} + 1), pw AS (SELECT k, sum(d * d) AS ac0 FROM cc GROUP BY 1),
raw AS (SELECT a.k, lag, any_value(a.n) AS n, sum(a.d * b.d) AS s FROM cc a, range({LOW}, {HIGH + 1}) t(lag), cc b WHERE a.k = b.k AND b.i = a.i + lag GROUP BY 1, 2),
ac AS (SELECT k, lag, least(greatest(s * n / (ac0 * (n - lag)), 0), 1) AS c, least(greatest(s * n / (ac0 * (n - lag)), 0), 1) * exp(-0.5 * pow(log2({RATE} * 60 / lag / 120) / 1.3, 2)) AS w FROM raw JOIN pw USING (k)),
bpm AS (SELECT k AS user_id, {RATE} * 60 / arg_min(lag, (-w, lag)) AS bpm, arg_min(c, (-w, lag)) AS clarity FROM ac WHERE w > 0 GROUP BY 1)"""
STEREO = """, wd AS (SELECT signal_id AS user_id, CASE WHEN m + d > 0 THEN d / (m + d) ELSE 0 END AS width FROM (SELECT signal_id, sqrt(avg((l+r)/2*(l+r)/2)) AS m, sqrt(avg((l-r)/2*(l-r)/2)) AS d FROM stereo GROUP BY 1))"""


def _gated(name, rows, gate):
    """The gating SQL with table names of its own."""
    return re.sub(r"\b(p|b|g|live)(?= AS \(|\.\*| b JOIN| USING|$)|(?<=FROM )(p|b)\b(?! g)|(?<=JOIN )g\b", lambda m: name + m.group(), GATED.format(rows=rows, gate=gate))


LIVE = "CASE WHEN {0} > 0 THEN -0.691 + 10 * log10({0}) END"
FEATURES = f"""{_gated('mo_', 3, 10)}{_gated('st_', 29, 20)}, lu AS (SELECT user_id, {LIVE.format('avg(p)')} AS lufs FROM mo_live GROUP BY 1),
lr AS (SELECT user_id, quantile_cont({LIVE.format('p')}, 0.95) - quantile_cont({LIVE.format('p')}, 0.1) AS lra FROM st_live GROUP BY 1),
feat AS (SELECT u.user_id, lufs, u.pk AS true_peak, lra, bpm, CASE WHEN coalesce(clarity, 0) >= 0.1 AND coalesce(rhythm.n, 0) / (u.n / 10.0) >= 0.5 AND coalesce(alignment, 0) >= 0.7 THEN 1.0 ELSE 0.0 END AS clear, alignment, width,
CAST(least(coalesce(rhythm.n, 0), 11) + 1 AS DOUBLE) AS sections, rhythm.kind AS grid, coalesce(rhythm.n, 0) / (u.n / 10.0) AS rate, clarity
FROM (SELECT user_id, {DB.format('max(abs(x))')} AS pk, count(*) AS n FROM sig GROUP BY 1) u LEFT JOIN lu USING (user_id) LEFT JOIN lr USING (user_id) LEFT JOIN bpm USING (user_id) LEFT JOIN rhythm USING (user_id) LEFT JOIN wd USING (user_id))"""
BASE = with_views("sig", "stereo", recursive=True) + NMS + BEATS + TEMPO + STEREO + FEATURES


def _onsets(spark, sf_dir):
    # rows without a user match nothing; without them all branches of a plan read the same shuffled rows
    return onsets.onsets(sig_events(spark, sf_dir).where("user_id is not null"), "user_id", scale=1.5, min_gap=3)


def features(spark, sf_dir):
    """One row a signal: loudness, peak, range, tempo, rhythm, width, sections."""
    sig = sig_events(spark, sf_dir)
    base = sig.groupBy("user_id").agg(lin_to_db(F.max(F.abs("x"))).alias("true_peak"), F.count("*").alias("n")).withColumn("m", F.col("n") - 1)  # places count from 0
    ac = tempo.autocorrelation(sig, "user_id", LOW, HIGH, RATE).where("weighted > 0")
    best = ac.groupBy("user_id").agg(F.min_by(F.struct("lag", "clarity"), F.struct(-F.col("weighted"), "lag")).alias("b"))
    bpm = best.select("user_id", (RATE * 60 / F.col("b.lag")).alias("bpm"), F.col("b.clarity").alias("clarity"))
    hits = _onsets(spark, sf_dir).select("user_id", (F.col("i") * 100.0 + F.pmod(F.col("i") * 37, F.lit(40))).alias("t"))
    beats = base.where("floor(m / 5) > 1").select("user_id", F.explode(F.sequence(F.lit(1), F.floor(F.col("m") / 5) - 1)).alias("k")).select("user_id", (F.col("k") * 500.0).alias("t"))
    grid = tempo.grid_choice(tempo.grid_points(hits, beats, "user_id"), "user_id")
    count = hits.groupBy("user_id").agg(F.count("*").alias("hits"))
    width = levels.stereo_image(sig_stereo(spark, sf_dir), "signal_id").select(F.col("signal_id").alias("user_id"), "width")
    out = base.join(levels.gated_loudness(sig, "user_id").drop("blocks"), "user_id", "left").join(levels.loudness_range(sig, "user_id"), "user_id", "left")
    out = out.join(bpm, "user_id", "left").join(count, "user_id", "left").join(grid, "user_id", "left").join(width, "user_id", "left")
    out = out.withColumns({"alignment": F.greatest("four", "three") / F.col("hits"), "rate": F.coalesce("hits", F.lit(0)) / (F.col("n") / 10)})
    out = out.withColumn("grid", F.when(F.col("hits").isNotNull(), F.coalesce("grid", F.lit("straight"))))  # onsets without a beat fit no triplets
    clear = (F.coalesce("clarity", F.lit(0.0)) >= 0.1) & (F.col("rate") >= 0.5) & (F.coalesce("alignment", F.lit(0.0)) >= 0.7)
    return out.select("user_id", "lufs", "true_peak", "lra", "bpm", clear.cast("double").alias("clear"), "alignment", "width", (F.least(F.coalesce("hits", F.lit(0)), F.lit(11)) + 1).cast("double").alias("sections"), "grid", "rate", "clarity")


@query(BASE + f""", spec(k, kind, a, b) AS (VALUES {SPEC_SQL}), s AS (SELECT u.user_id * 100 + k AS spec_id, CASE WHEN u.user_id % 10 = 3 THEN u.user_id + 1000000 ELSE u.user_id END AS user_id, kind, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b FROM (SELECT DISTINCT user_id FROM sig) u, spec),
v AS (SELECT s.spec_id, s.user_id, s.kind, s.a, s.b, f.user_id IS NOT NULL AS there, CASE s.kind WHEN 'integrated_lufs' THEN lufs WHEN 'true_peak_below' THEN true_peak WHEN 'lra_below' THEN lra WHEN 'tempo_is' THEN bpm WHEN 'has_clear_rhythm' THEN clear
WHEN 'grid_alignment_at_least' THEN alignment WHEN 'stereo_width_within' THEN width WHEN 'section_count' THEN sections END AS v FROM s LEFT JOIN feat f USING (user_id))
SELECT spec_id, user_id, kind, there AND CASE kind WHEN 'integrated_lufs' THEN coalesce(abs(v - a) <= b, false) WHEN 'true_peak_below' THEN coalesce(v <= a, true) WHEN 'lra_below' THEN coalesce(v <= a, true) WHEN 'tempo_is' THEN coalesce(abs(v - a) <= b, false)
WHEN 'has_clear_rhythm' THEN coalesce(v = a, false) WHEN 'grid_alignment_at_least' THEN coalesce(v >= a, false) WHEN 'stereo_width_within' THEN coalesce(v BETWEEN a AND b, false) WHEN 'section_count' THEN coalesce(v BETWEEN a AND b, false) ELSE false END AS passed,
round(v, 6) AS actual, CASE WHEN kind = 'loudness_is_nice' THEN 'unknown kind' WHEN NOT there THEN 'unknown track' WHEN v IS NULL THEN 'undefined' END AS detail FROM v""")
def verify_specs(spark, sf_dir):
    """Specs of every kind that looks at one value, dispatched in one pass; unknown kinds and tracks fail."""
    users = sig_events(spark, sf_dir).select("user_id").distinct()
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for k, (kind, a, b) in enumerate(VALUE_SPECS)])
    key = F.when(F.pmod("user_id", F.lit(10)) == 3, F.col("user_id") + 1_000_000).otherwise(F.col("user_id"))
    specs = users.select("user_id", F.inline(rows)).select((F.col("user_id") * 100 + F.col("k")).alias("spec_id"), key.alias("user_id"), "kind", "a", "b")
    return verify.check_values(specs, features(spark, sf_dir), "user_id").withColumn("actual", F.round("actual", 6))


@query(BASE + "SELECT user_id, round(lufs, 6) AS lufs, round(lra, 6) AS lra, round(bpm, 6) AS bpm, round(clarity, 6) AS clarity, round(rate, 6) AS rate, round(alignment, 6) AS alignment, grid, clear = 1 AS clear, round(width, 6) AS width FROM feat")
def signal_features(spark, sf_dir):
    """The feature row of each signal: loudness, tempo, the rhythm's grid (triplets only where they fit more onsets) and clearness."""
    f = features(spark, sf_dir)
    return f.select("user_id", *[F.round(c, 6).alias(c) for c in ("lufs", "lra", "bpm", "clarity", "rate", "alignment", "width")], "grid", (F.col("clear") == 1).alias("clear"))


TRACKS = with_views("sig", recursive=True) + NMS + f""", u AS (SELECT user_id, count(*) AS n FROM sig GROUP BY 1),
ton AS (SELECT user_id * 10 AS spec_id, min(abs(i * 100.0 - (user_id % 7 * 500 + 250))) AS actual FROM u LEFT JOIN picked USING (user_id) GROUP BY user_id),
nt AS (SELECT user_id, k AS note, k * 4 AS s0, k * 4 + 1 + k % 4 AS s1, 60 + user_id % 12 AS midi FROM u, LATERAL (SELECT unnest(range(0, n // 4)) AS k)),
nf AS (SELECT nt.user_id, note, any_value(midi) AS midi, median(110 + x * 700) FILTER (x > 0.4) AS f0 FROM nt LEFT JOIN sig ON sig.user_id = nt.user_id AND i * 25.0 >= s0 * 25.0 + 15 AND i * 25.0 < s1 * 25.0 WHERE (s1 - s0) * 25 >= 60 GROUP BY 1, 2),
nc AS (SELECT user_id, abs(1200 * log2(f0 / (440 * pow(2.0, (midi - 69) / 12.0)))) AS c FROM nf),
pit AS (SELECT user_id * 10 + 1 AS spec_id, max(c) AS actual, count(nc.user_id) FILTER (c IS NULL) AS without, count(nc.user_id) AS notes FROM u LEFT JOIN nc USING (user_id) GROUP BY user_id),
pr AS (SELECT user_id, i, x, lag(x) OVER (PARTITION BY user_id ORDER BY i) AS p FROM sig), jm AS (SELECT user_id, max(abs(x - p)) AS w FROM pr WHERE p IS NOT NULL AND (abs(x) >= 0.05 OR abs(p) >= 0.05) AND NOT (i % 16 <= 1 OR i % 16 = 15) GROUP BY 1),
jmp AS (SELECT user_id * 10 + 2 AS spec_id, w AS actual FROM u LEFT JOIN jm USING (user_id)),
starts AS (SELECT user_id, n, CAST(s AS BIGINT) AS s FROM u, LATERAL (SELECT unnest(range(0, n, 2)) AS s) WHERE s = 0 OR s - 2 + 10 < n),
hp AS (SELECT a.user_id, a.s, sqrt(avg(x * x)) AS rms FROM starts a JOIN sig b ON a.user_id = b.user_id AND b.i >= a.s AND b.i < a.s + 10 GROUP BY 1, 2),
tl AS (SELECT user_id * 10 + 3 AS spec_id, {DB.format('max(rms) FILTER (s >= 40)')} AS actual FROM u LEFT JOIN hp USING (user_id) GROUP BY user_id),
br AS (SELECT user_id, median(110 + x * 700) FILTER (i * 100.0 >= 0 AND i * 100.0 < 1000) AS a, median(110 + x * 700) FILTER (i * 100.0 >= 3000 AND i * 100.0 < 4000) AS b FROM sig WHERE x > 0.1 GROUP BY 1)
SELECT spec_id, 'onset_at' AS kind, coalesce(actual <= 300, false) AS passed, round(actual, 6) AS actual FROM ton
UNION ALL SELECT spec_id, 'pitch_matches_score', coalesce(actual <= 900, false) AND without = 0, round(actual, 5) FROM pit
UNION ALL SELECT spec_id, 'no_discontinuity', coalesce(actual <= 0.8, true), round(actual, 12) FROM jmp
UNION ALL SELECT spec_id, 'silent_after', coalesce(actual < -5.0, true), round(actual, 6) FROM tl
UNION ALL SELECT u.user_id * 10 + 4, 'brightness_rises', coalesce(b >= a * 1.05, false), round(b / a, 6) FROM u LEFT JOIN br USING (user_id)
UNION ALL SELECT u.user_id * 10 + 5, 'brightness_falls', coalesce(a >= b * 1.05, false), round(b / a, 6) FROM u LEFT JOIN br USING (user_id)"""


@query(TRACKS)
def verify_track_specs(spark, sf_dir):
    """Specs that look at a track: nearest onsets, notes' pitch, guarded jumps, the tail's silence and brightness."""
    sig = sig_events(spark, sf_dir)
    size = sig.groupBy("user_id").agg(F.count("*").alias("n"))
    spec = lambda k, kind, a, b, ratio=0.0: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), a.cast("double").alias("a"), F.lit(b).alias("b"), F.lit(ratio).alias("ratio"))
    u = F.col("user_id")
    rows = F.array(
        spec(0, "onset_at", F.pmod(u, F.lit(7)) * 500 + 250, 300.0), spec(1, "pitch_matches_score", F.lit(900.0), 0.0), spec(2, "no_discontinuity", F.lit(0.8), 0.0),
        spec(3, "silent_after", F.lit(40.0), -5.0), spec(4, "brightness_rises", F.lit(0.0), 4000.0, 1.05), spec(5, "brightness_falls", F.lit(0.0), 4000.0, 1.05),
    )
    specs = size.select("user_id", F.inline(rows)).withColumn("spec_id", u * 10 + F.col("k"))
    hits = _onsets(spark, sf_dir).select("user_id", (F.col("i") * 100.0).alias("t"))
    k = F.col("note")
    notes = size.where("n >= 4").select("user_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 4) - 1)).alias("note"))
    notes = notes.select("user_id", "note", (k * 100.0).alias("on_ms"), ((k * 4 + 1 + F.pmod(k, F.lit(4))) * 25.0).alias("off_ms"), (60 + F.pmod(u, F.lit(12))).alias("midi"))
    f0 = sig.select("user_id", "i", F.when(F.col("x") > 0.4, 110 + F.col("x") * 700).alias("f0"))
    edges = size.select("user_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 16) + 1)).alias("e")).select("user_id", (F.col("e") * 16).alias("at"))
    curve = sig.where("x > 0.1").select("user_id", (F.col("i") * 100.0).alias("t"), (110 + F.col("x") * 700).alias("hz"))
    tail = levels.hops(sig, "user_id", 10, 2)
    parts = [
        ("onset_at", verify.check_onsets(specs, hits, "user_id"), 6), ("pitch_matches_score", verify.check_pitch(specs, notes, f0, "user_id", 25.0), 5),
        ("no_discontinuity", verify.check_jumps(specs, verify.guarded_jumps(sig, edges, "user_id", 1, 0.05), "user_id"), 12), ("silent_after", verify.check_tail(specs, tail, "user_id"), 6),
    ]
    out = verify.check_brightness(specs, curve, "user_id").join(specs.select("spec_id", "kind"), "spec_id").select("spec_id", "kind", "passed", F.round("actual", 6).alias("actual"))
    for kind, rows, places in parts:
        out = out.unionByName(rows.select("spec_id", F.lit(kind).alias("kind"), "passed", F.round("actual", places).alias("actual")))
    return out
