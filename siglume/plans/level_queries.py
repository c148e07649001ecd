"""Levels, onsets and runs over the event signals."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from siglume.functions.scalars import lin_to_db, velocity_from_peak
from siglume.operators import levels, onsets
from siglume.plans.catalog import query, rounded
from siglume.sources.views import sig_events, sig_stereo, with_views

#: Samples are multiples of 1/51200: differences and half differences of them are whole at this place, so no rounding can part.
EXACT = 12
DB = "CASE WHEN {0} > 0 THEN 20 * log10({0}) END"


@query(with_views("sig") + f"""
SELECT user_id, i // 16 AS seg, count(*) AS n, round({DB.format('sqrt(avg(x * x))')}, 6) AS rms_db, round({DB.format('max(abs(x))')}, 6) AS peak_db
FROM sig GROUP BY 1, 2""")
def segment_timeline(spark, sf_dir):
    return rounded(levels.segments(sig_events(spark, sf_dir), "user_id", 16).drop("silent"))


@query(with_views("sig") + f"""
SELECT user_id, i // 8 AS seg, coalesce({DB.format('sqrt(avg(x * x))')} <= -9, true) AS silent FROM sig GROUP BY 1, 2""")
def segment_silence_flags(spark, sf_dir):
    return levels.segments(sig_events(spark, sf_dir), "user_id", 8, floor_db=-9.0).select("user_id", "seg", "silent")


@query(with_views("sig") + f""", size AS (SELECT user_id, max(i) + 1 AS n FROM sig GROUP BY 1),
starts AS (SELECT user_id, n, CAST(s AS BIGINT) AS s FROM size, LATERAL (SELECT unnest(range(0, n, 2)) AS s) WHERE s = 0 OR s - 2 + 10 < n),
h AS (SELECT a.user_id, a.n, a.s, sqrt(avg(x * x)) AS rms FROM starts a JOIN sig b ON a.user_id = b.user_id AND b.i >= a.s AND b.i < a.s + 10 GROUP BY 1, 2, 3),
m AS (SELECT *, coalesce({DB.format('rms')} > -5.5, false) AS audible FROM h)
SELECT user_id, coalesce(min(s) FILTER (audible), n) AS leading, coalesce(n - max(least(s + 10, n)) FILTER (audible), n) AS trailing,
max(least(s + 10, n)) FILTER (audible) - 1 AS last_audible FROM m GROUP BY user_id, n""")
def hop_silence_bounds(spark, sf_dir):
    return levels.silence(sig_events(spark, sf_dir), "user_id", 10, 2, -5.5)


@query(with_views("sig") + "SELECT user_id, count(*) FILTER (abs(x) >= 0.9) AS clipped, round(max(abs(x)), 12) AS peak FROM sig GROUP BY 1")
def clip_count(spark, sf_dir):
    return rounded(levels.clipping(sig_events(spark, sf_dir), "user_id", 0.9), places=EXACT)


@query(with_views("stereo") + """, s AS (SELECT signal_id, count(*) AS n, sum(l) AS sl, sum(r) AS sr, sum(l*l) AS ll, sum(r*r) AS rr, sum(l*r) AS lr,
sqrt(avg((l+r)/2*(l+r)/2)) AS m, sqrt(avg((l-r)/2*(l-r)/2)) AS d FROM stereo GROUP BY 1),
v AS (SELECT *, ll/n - (sl/n)*(sl/n) AS vl, rr/n - (sr/n)*(sr/n) AS vr, lr/n - sl*sr/(n*n) AS c, sqrt(ll/n) AS rl, sqrt(rr/n) AS r2 FROM s)
SELECT signal_id, round(CASE WHEN m + d > 0 THEN d / (m + d) ELSE 0 END, 6) AS width,
round(CASE WHEN vl > 1e-12 AND vr > 1e-12 THEN least(greatest(c / sqrt(vl * vr), -1), 1) END, 6) AS correlation,
round(CASE WHEN rl + r2 > 0 THEN least(greatest((r2 - rl) / (rl + r2), -1), 1) END, 6) AS balance FROM v""")
def stereo_image(spark, sf_dir):
    return rounded(levels.stereo_image(sig_stereo(spark, sf_dir), "signal_id"))


FLUX = """, flux AS (SELECT user_id, i, x, greatest(coalesce(x - lag(x) OVER (PARTITION BY user_id ORDER BY i), 0), 0) AS f FROM sig)"""


@query(with_views("sig") + FLUX + "SELECT user_id, i, round(f, 12) AS f FROM flux")
def positive_flux(spark, sf_dir):
    return rounded(onsets.flux(sig_events(spark, sf_dir), "user_id").select("user_id", "i", "f"), places=EXACT)


PEAKS = FLUX + """, near AS (SELECT *, list(f) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS w FROM flux),
med AS (SELECT *, list_sort(w)[len(w) // 2 + 1] AS med FROM near),
thr AS (SELECT *, med + 1.5 * list_sort(list_transform(w, lambda v: abs(v - med)))[len(w) // 2 + 1] + 1e-6 AS thr,
lag(f) OVER (PARTITION BY user_id ORDER BY i) AS p, lead(f) OVER (PARTITION BY user_id ORDER BY i) AS n FROM med),
peaks AS (SELECT user_id, i, f, thr FROM thr WHERE f > thr AND f >= p AND f > n)"""


@query(with_views("sig") + PEAKS + "SELECT user_id, i, round(f, 12) AS f, round(thr, 12) AS thr FROM peaks")
def onset_detect(spark, sf_dir):
    found = onsets.peaks(onsets.with_threshold(onsets.flux(sig_events(spark, sf_dir), "user_id"), "user_id", scale=1.5), "user_id")
    return rounded(found.select("user_id", "i", "f", "thr"), places=EXACT)


NMS = PEAKS + """, ranked AS (SELECT user_id, i, f, row_number() OVER (PARTITION BY user_id ORDER BY i) AS k FROM peaks),
walk AS (SELECT user_id, k, i AS bi, f AS bf, 1 AS grp FROM ranked WHERE k = 1
UNION ALL SELECT r.user_id, r.k, CASE WHEN r.i - w.bi <= 3 AND r.f <= w.bf THEN w.bi ELSE r.i END, CASE WHEN r.i - w.bi <= 3 AND r.f <= w.bf THEN w.bf ELSE r.f END,
CASE WHEN r.i - w.bi <= 3 THEN w.grp ELSE w.grp + 1 END FROM walk w JOIN ranked r ON r.user_id = w.user_id AND r.k = w.k + 1),
picked AS (SELECT user_id, arg_max(bi, k) AS i, arg_max(bf, k) AS f FROM walk GROUP BY user_id, grp)"""


@query(with_views("sig", recursive=True) + NMS + "SELECT user_id, i, round(f, 12) AS f FROM picked")
def onset_nms(spark, sf_dir):
    return rounded(onsets.onsets(sig_events(spark, sf_dir), "user_id", scale=1.5, min_gap=3), places=EXACT)


@query(with_views("sig", recursive=True) + NMS + """SELECT s.user_id, coalesce(p.c, 0) AS n_onsets, round(coalesce(p.c, 0) / s.n, 6) AS rate
FROM (SELECT user_id, count(*) AS n FROM sig GROUP BY 1) s LEFT JOIN (SELECT user_id, count(*) AS c FROM picked GROUP BY 1) p USING (user_id)""")
def onset_rate(spark, sf_dir):
    sig = sig_events(spark, sf_dir)
    found = onsets.onsets(sig, "user_id", scale=1.5, min_gap=3).groupBy("user_id").agg(F.count("*").alias("c"))
    out = sig.groupBy("user_id").agg(F.count("*").alias("n")).join(found, "user_id", "left").withColumn("n_onsets", F.coalesce("c", F.lit(0)))
    return rounded(out.select("user_id", "n_onsets", (F.col("n_onsets") / F.col("n")).alias("rate")))


LOUD = "CASE WHEN {0} > 0 THEN -0.691 + 10 * log10({0}) END"
ROLL = "CASE WHEN i >= {1} THEN avg(x * x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN {1} PRECEDING AND CURRENT ROW) END AS {0}"


@query(with_views("sig") + f", p AS (SELECT user_id, i, {ROLL.format('a', 3)}, {ROLL.format('b', 29)} FROM sig) "
       f"SELECT user_id, i, round({LOUD.format('a')}, 6) AS momentary, round({LOUD.format('b')}, 6) AS short_term FROM p")
def rolling_loudness(spark, sf_dir):
    s = sig_events(spark, sf_dir)
    cols = {"momentary": levels.rolling_power(s, "user_id", 4), "short_term": levels.rolling_power(s, "user_id", 30)}
    s = s.withColumns(cols)
    return rounded(s.select("user_id", "i", *[levels.loudness(F.col(c)).alias(c) for c in cols]))


GATED = f""", p AS (SELECT user_id, i, {ROLL.format('p', '{rows}')} FROM sig), b AS (SELECT * FROM p WHERE {LOUD.format('p')} > -70),
g AS (SELECT user_id, {LOUD.format('avg(p)')} - {{gate}} AS gate FROM b GROUP BY 1), live AS (SELECT b.* FROM b JOIN g USING (user_id) WHERE {LOUD.format('p')} > gate)"""


@query(with_views("sig") + GATED.format(rows=3, gate=10) + f"SELECT user_id, round({LOUD.format('avg(p)')}, 6) AS lufs, count(*) AS blocks FROM live GROUP BY 1")
def gated_loudness(spark, sf_dir):
    return rounded(levels.gated_loudness(sig_events(spark, sf_dir), "user_id"))


@query(with_views("sig") + GATED.format(rows=29, gate=20) + f"SELECT user_id, round(quantile_cont({LOUD.format('p')}, 0.95) - quantile_cont({LOUD.format('p')}, 0.1), 6) AS lra FROM live GROUP BY 1")
def loudness_range(spark, sf_dir):
    return rounded(levels.loudness_range(sig_events(spark, sf_dir), "user_id"))


@query(with_views("sig") + f"""SELECT user_id, i // 16 AS seg, round({DB.format('max(abs(x))')}, 6) AS peak_db,
coalesce(CAST(round(1 + least(greatest(({DB.format('max(abs(x))')} + 48) / 48, 0), 1) * 126) AS BIGINT), 1) AS vel FROM sig GROUP BY 1, 2""")
def velocity_from_peak_windows(spark, sf_dir):
    out = sig_events(spark, sf_dir).groupBy("user_id", F.floor(F.col("i") / 16).alias("seg")).agg(lin_to_db(F.max(F.abs("x"))).alias("peak_db"))
    return rounded(out.withColumn("vel", velocity_from_peak(F.col("peak_db"))))


@query(with_views("sig") + """, d AS (SELECT user_id, i, x, abs(x - lag(x) OVER (PARTITION BY user_id ORDER BY i)) AS jump, lag(x) OVER (PARTITION BY user_id ORDER BY i) AS p FROM sig)
SELECT user_id, count(*) FILTER (jump > 0.85 AND (abs(x) >= 0.01 OR abs(p) >= 0.01)) AS violations, arg_min(i, (-jump, i)) AS worst_at, round(max(jump), 12) AS worst FROM d WHERE jump IS NOT NULL GROUP BY 1""")
def discontinuity_check(spark, sf_dir):
    p = F.lag("x").over(W.partitionBy("user_id").orderBy("i"))
    d = sig_events(spark, sf_dir).withColumn("p", p).withColumn("jump", F.abs(F.col("x") - F.col("p"))).where("jump is not null")
    loud = (F.abs("x") >= 0.01) | (F.abs("p") >= 0.01)
    return rounded(d.groupBy("user_id").agg(
        F.count_if((F.col("jump") > 0.85) & loud).alias("violations"), F.min_by("i", F.struct(-F.col("jump"), "i")).alias("worst_at"), F.max("jump").alias("worst")
    ), places=EXACT)


@query(with_views("sig") + f""", s AS (SELECT user_id, max(i) AS last FROM sig GROUP BY 1), t AS (SELECT g.user_id, {DB.format('sqrt(avg(x * x))')} AS db FROM sig g JOIN s USING (user_id) WHERE i > last - 5 GROUP BY 1)
SELECT user_id, round(db, 6) AS tail_db, coalesce(db < -8, true) AS passed FROM t""")
def silent_after(spark, sf_dir):
    s = sig_events(spark, sf_dir)
    last = F.max("i").over(W.partitionBy("user_id"))
    t = s.withColumn("last", last).where(F.col("i") > F.col("last") - 5).groupBy("user_id").agg(lin_to_db(F.sqrt(F.avg(F.col("x") * F.col("x")))).alias("tail_db"))
    return rounded(t.withColumn("passed", F.coalesce(F.col("tail_db") < -8, F.lit(True))))


@query(with_views("sig") + """, b AS (SELECT user_id, i, x, x - lag(x) OVER (PARTITION BY user_id ORDER BY i) AS d FROM sig WHERE i % 4 = 0),
e AS (SELECT user_id, CASE WHEN arg_max(x, i) >= arg_min(x, i) THEN 'up' ELSE 'down' END AS dir FROM b GROUP BY 1)
SELECT e.user_id, dir AS direction, count(*) FILTER (CASE WHEN dir = 'up' THEN d < 0 ELSE d > 0 END) AS violations FROM b JOIN e USING (user_id) GROUP BY 1, 2""")
def monotone_check(spark, sf_dir):
    b = sig_events(spark, sf_dir).where(F.pmod("i", F.lit(4)) == 0)
    b = b.withColumn("d", F.col("x") - F.lag("x").over(W.partitionBy("user_id").orderBy("i")))
    out = b.groupBy("user_id").agg(
        F.when(F.max_by("x", "i") >= F.min_by("x", "i"), "up").otherwise("down").alias("direction"), F.count_if(F.col("d") < 0).alias("down"), F.count_if(F.col("d") > 0).alias("up")
    )
    return out.select("user_id", "direction", F.when(F.col("direction") == "up", F.col("down")).otherwise(F.col("up")).alias("violations"))


@query(with_views("sig") + f""", s AS (SELECT user_id, i // 4 AS seg, {DB.format('sqrt(avg(x * x))')} AS db, max(abs(x)) AS pk, count(*) AS n FROM sig GROUP BY 1, 2),
c AS (SELECT user_id, CAST(ceil(count(*) / 8.0) AS BIGINT) AS step FROM s GROUP BY 1)
SELECT s.user_id, seg // step AS line, round(max(db), 6) AS rms_db, round(max({DB.format('pk')}), 6) AS peak_db, CAST(sum(n) AS BIGINT) AS n, bool_and(coalesce(db <= -12, true)) AS silent
FROM s JOIN c USING (user_id) GROUP BY 1, 2""")
def digest_rows(spark, sf_dir):
    s = levels.segments(sig_events(spark, sf_dir), "user_id", 4, floor_db=-12.0)
    step = F.ceil(F.count("*").over(W.partitionBy("user_id")) / 8)
    s = s.withColumn("line", F.floor(F.col("seg") / step))
    return rounded(s.groupBy("user_id", "line").agg(F.max("rms_db").alias("rms_db"), F.max("peak_db").alias("peak_db"), F.sum("n").alias("n"), F.bool_and("silent").alias("silent")))


@query(with_views("sig", recursive=True) + """, need AS (SELECT user_id, i, CASE WHEN max(x) OVER w > 0.6 THEN 0.6 / max(x) OVER w ELSE 1 END AS need FROM sig WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
g AS (SELECT user_id, i, least(1.0, need) AS gain FROM need WHERE i = 0
UNION ALL SELECT n.user_id, n.i, least(1 - (1 - g.gain) * 0.8, n.need) FROM g JOIN need n ON n.user_id = g.user_id AND n.i = g.i + 1)
SELECT user_id, i, round(gain, 6) AS gain FROM g""")
def limiter_gain(spark, sf_dir):
    """Brick-wall limiter: forward maximum, then a gain that recovers by a factor each sample."""
    from siglume.operators.sequential import limiter

    return rounded(limiter(sig_events(spark, sf_dir), "user_id", ceiling=0.6, lookahead=3, keep=0.8))
