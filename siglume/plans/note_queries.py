"""Tempo, rhythm, time base, notes, lints, comparison, checks and windows."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from siglume.functions.scalars import bar_beat, cents_off, midi_to_hz, nearest_midi, note_name, snap_anchored
from siglume.operators import levels, onsets, sequences, tempo, timebase
from siglume.plans.catalog import query, rounded
from siglume.plans.level_queries import DB, NMS
from siglume.sources.views import notes, runs, sig_daily, sig_events, sig_frames, table, with_views

LOW, HIGH, RATE = 5, 30, 10.0
AC = """, st AS (SELECT avg(x) AS mean, count(*) AS n FROM env), c AS (SELECT i, n, x - mean AS d FROM env, st), p AS (SELECT sum(d * d) AS ac0 FROM c),
raw AS (SELECT lag, any_value(a.n) AS n, sum(a.d * b.d) AS s FROM c a, range(5, 31) t(lag), c b WHERE b.i = a.i + lag GROUP BY 1),
ac AS (SELECT lag, least(greatest(s * n / (ac0 * (n - lag)), 0), 1) AS clarity, least(greatest(s * n / (ac0 * (n - lag)), 0), 1) * exp(-0.5 * pow(log2(10.0 * 60 / lag / 120) / 1.3, 2)) AS weighted FROM raw, p)"""


def _ac(spark, sf_dir):
    return tempo.autocorrelation(sig_daily(spark, sf_dir).withColumn("k", F.lit(0)), "k", LOW, HIGH, RATE)


@query(with_views("daily") + ", env AS (SELECT * FROM daily)" + AC + "SELECT lag, round(clarity, 6) AS clarity, round(weighted, 6) AS weighted FROM ac")
def autocorr_tempo(spark, sf_dir):
    return rounded(_ac(spark, sf_dir).drop("k"))


@query(with_views("daily", recursive=True) + ", env AS (SELECT * FROM daily)" + AC + """, nb AS (SELECT *, lag(weighted) OVER (ORDER BY lag) AS p1, lead(weighted) OVER (ORDER BY lag) AS n1 FROM ac),
best AS (SELECT lag, clarity FROM ac ORDER BY weighted DESC, lag LIMIT 1),
mx AS (SELECT lag, clarity, row_number() OVER (ORDER BY weighted DESC, lag) AS k FROM nb WHERE weighted > 0 AND (p1 IS NULL OR weighted >= p1) AND (n1 IS NULL OR weighted > n1)),
walk AS (SELECT CAST(0 AS BIGINT) AS k, [lag] AS lags, [clarity] AS cl FROM best
UNION ALL SELECT m.k, CASE WHEN len(w.lags) < 3 AND len(list_filter(w.lags, lambda a: abs(m.lag - a) / a <= 0.1)) = 0 THEN list_append(w.lags, m.lag) ELSE w.lags END,
CASE WHEN len(w.lags) < 3 AND len(list_filter(w.lags, lambda a: abs(m.lag - a) / a <= 0.1)) = 0 THEN list_append(w.cl, m.clarity) ELSE w.cl END FROM walk w JOIN mx m ON m.k = w.k + 1),
fin AS (SELECT * FROM walk ORDER BY k DESC LIMIT 1)
SELECT CAST(r - 1 AS BIGINT) AS rank, lags[r] AS lag, round(cl[r], 6) AS clarity FROM fin, range(1, 4) t(r) WHERE r <= len(lags)""")
def tempo_candidates(spark, sf_dir):
    return rounded(tempo.candidates(_ac(spark, sf_dir), "k").drop("k"))


@query(with_views("daily") + f""", n AS (SELECT count(*) AS n, least(4, count(*) // {HIGH + 2}) AS ch FROM daily), src AS (SELECT -1 AS k, i, x FROM daily UNION ALL SELECT i // (n // ch), i % (n // ch), x FROM daily, n WHERE i < ch * (n // ch)),
st AS (SELECT k, avg(x) AS mean, count(*) AS n FROM src GROUP BY 1), c AS (SELECT k, i, st.n, x - mean AS d FROM src JOIN st USING (k)), p AS (SELECT k, sum(d * d) AS ac0 FROM c GROUP BY 1),
raw AS (SELECT a.k, lag, any_value(a.n) AS n, sum(a.d * b.d) AS s FROM c a, range({LOW}, {HIGH + 1}) t(lag), c b WHERE a.k = b.k AND b.i = a.i + lag GROUP BY 1, 2),
ac AS (SELECT k, lag, least(greatest(s * n / (ac0 * (n - lag)), 0), 1) * exp(-0.5 * pow(log2(10.0 * 60 / lag / 120) / 1.3, 2)) AS w FROM raw JOIN p USING (k)),
b AS (SELECT k, arg_min(lag, (-w, lag)) AS lag FROM ac WHERE w > 0 GROUP BY 1), g AS (SELECT lag AS whole FROM b WHERE k = -1)
SELECT round(count(*) FILTER (abs(lag*0.25-whole) <= 0.05*whole OR abs(lag*0.5-whole) <= 0.05*whole OR abs(lag-whole) <= 0.05*whole OR abs(lag*2.0-whole) <= 0.05*whole OR abs(lag*4.0-whole) <= 0.05*whole) / any_value(ch), 6) AS stability FROM b, g, n WHERE k >= 0""")
def tempo_stability(spark, sf_dir):
    env = sig_daily(spark, sf_dir)
    return rounded(tempo.stability(env, env.count(), LOW, HIGH, RATE))


@query()
def beat_grid(spark, sf_dir):
    return tempo.beat_grid(sig_daily(spark, sf_dir).withColumn("k", F.lit(0)), "k", 7).drop("k")


@query(with_views("daily") + "SELECT CAST(i % 4 AS BIGINT) AS phase, round(sum(x), 5) AS strength, row_number() OVER (ORDER BY sum(x) DESC, i % 4) = 1 AS downbeat FROM daily GROUP BY i % 4")
def downbeat_phase(spark, sf_dir):
    s = sig_daily(spark, sf_dir).groupBy(F.pmod("i", F.lit(4)).alias("phase")).agg(F.sum("x").alias("strength"))
    return rounded(s.withColumn("downbeat", F.row_number().over(W.orderBy(F.desc("strength"), "phase")) == 1), places=5)


@query(with_views("sig", recursive=True) + NMS + """, beats AS (SELECT user_id, CAST(k AS DOUBLE) * 500 AS t FROM (SELECT user_id, max(i) AS m FROM sig GROUP BY 1), LATERAL (SELECT unnest(range(1, m // 5)) AS k)),
on_ AS (SELECT user_id, i * 100.0 + (i * 37 % 40) AS t FROM picked), nb AS (SELECT *, lead(t) OVER w AS nx, lag(t) OVER w AS pv FROM beats WINDOW w AS (PARTITION BY user_id ORDER BY t)),
sp AS (SELECT user_id, t AS a, nx AS b, false AS last FROM nb WHERE nx IS NOT NULL UNION ALL SELECT user_id, t, 2*t - pv, true FROM nb WHERE nx IS NULL AND pv IS NOT NULL UNION ALL SELECT user_id, 2*t - nx, t, false FROM nb WHERE pv IS NULL AND nx IS NOT NULL),
h AS (SELECT o.user_id, o.t, s, (o.t - a) / ((b - a) / s) AS pos, (b - a) / s AS sub FROM on_ o JOIN sp ON o.user_id = sp.user_id AND o.t >= a AND (o.t < b OR (last AND o.t = b)) CROSS JOIN (VALUES (4), (3)) v(s)),
g AS (SELECT user_id, CAST(s AS INTEGER) AS subdivisions, abs(pos - round(pos)) * sub <= greatest(0.15 * sub, 10) AS ok, CAST(round(pos) AS BIGINT) % s <> 0 AS off FROM h)
SELECT user_id, subdivisions, count(*) FILTER (ok) AS aligned, count(*) FILTER (ok AND off) AS offbeat FROM g GROUP BY 1, 2""")
def rhythm_grid(spark, sf_dir):
    sig = sig_events(spark, sf_dir)
    beats = sig.groupBy("user_id").agg(F.max("i").alias("m")).where("floor(m / 5) > 1")
    beats = beats.select("user_id", F.explode(F.sequence(F.lit(1), F.floor(F.col("m") / 5) - 1)).alias("b")).select("user_id", (F.col("b").cast("double") * 500).alias("t"))
    found = onsets.onsets(sig, "user_id", scale=1.5, min_gap=3).select("user_id", (F.col("i") * 100.0 + F.pmod(F.col("i") * 37, F.lit(40))).alias("t"))
    g = tempo.grid_points(found, beats, "user_id")
    return g.groupBy("user_id", "subdivisions").agg(F.count_if("aligned").alias("aligned"), F.count_if("offbeat").alias("offbeat"))


ISL = "SELECT user_id, label, min(i) AS start, max(i) + 1 AS stop, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY user_id, label ORDER BY i) AS g FROM {0} WHERE label IS NOT NULL) GROUP BY user_id, label, g"


@query(with_views("runs") + ISL.format("runs"))
def label_runs(spark, sf_dir):
    return sequences.islands(runs(spark, sf_dir), "user_id", "label")


@query(with_views("runs", recursive=True) + """, nx AS (SELECT *, lead(label) OVER (PARTITION BY user_id ORDER BY i) AS nxt FROM runs), walk AS (SELECT user_id, i, label FROM nx WHERE i = 0
UNION ALL SELECT n.user_id, n.i, CASE WHEN w.label = n.nxt THEN w.label ELSE n.label END FROM walk w JOIN nx n ON n.user_id = w.user_id AND n.i = w.i + 1) """ + ISL.format("walk"))
def melody_runs(spark, sf_dir):
    """Runs after the one-frame repair."""
    return sequences.islands(sequences.bridge(runs(spark, sf_dir), "user_id", "label"), "user_id", "label")


@query(with_views("sig") + """, v AS (SELECT user_id, i, CASE WHEN x > 0.4 THEN 110 + x * 700 END AS f0 FROM sig),
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM v WHERE f0 IS NOT NULL), r AS (SELECT user_id, min(i) AS start, max(i) + 1 AS stop, median(f0) AS f0 FROM g GROUP BY user_id, g)
SELECT user_id, start, stop, round(f0, 5) AS f0, CAST(round(69 + 12 * log2(f0 / 440)) AS BIGINT) AS midi FROM r""")
def voiced_runs(spark, sf_dir):
    v = sig_events(spark, sf_dir).where("x > 0.4").withColumn("f0", 110 + F.col("x") * 700)
    g = v.withColumn("g", F.col("i") - F.row_number().over(W.partitionBy("user_id").orderBy("i")))
    r = g.groupBy("user_id", "g").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop"), F.median("f0").alias("f0")).drop("g")
    return rounded(r.withColumn("midi", nearest_midi(F.col("f0"))), places=5)


@query(with_views("frames") + """, d AS (SELECT frame, tau, sum(pow(v[j] - v[j + tau], 2)) AS d FROM frames, range(1, 33) a(tau), range(1, 65) b(j) WHERE j + tau <= 64 GROUP BY 1, 2),
c AS (SELECT frame, tau, CASE WHEN sum(d) OVER w > 0 THEN d * tau / sum(d) OVER w ELSE 1 END AS c FROM d WINDOW w AS (PARTITION BY frame ORDER BY tau)), n AS (SELECT *, lead(c) OVER (PARTITION BY frame ORDER BY tau) AS nx FROM c),
f AS (SELECT frame, min(tau) AS first FROM n WHERE tau >= 2 AND tau < 32 AND c < 0.8 GROUP BY 1)
SELECT f.frame, min(tau) AS tau, round(arg_min(c, tau), 6) AS cmndf FROM f JOIN n ON n.frame = f.frame AND tau >= first AND (nx IS NULL OR nx >= c) GROUP BY 1""")
def yin_f0(spark, sf_dir):
    """Lag of the first dip of the normalised difference function, walked down to its local minimum."""
    f = sig_frames(spark, sf_dir)
    tau = f.select("frame", "v", F.explode(F.sequence(F.lit(1), F.lit(32))).alias("tau"))
    pair = F.zip_with(F.expr("slice(v, 1, 64 - tau)"), F.expr("slice(v, tau + 1, 64 - tau)"), lambda a, b: (a - b) * (a - b))
    d = tau.select("frame", F.col("tau").cast("long").alias("tau"), F.aggregate(pair, F.lit(0.0), lambda s, x: s + x).alias("d"))
    w = W.partitionBy("frame").orderBy("tau")
    run = F.sum("d").over(w)
    c = d.withColumn("c", F.when(run > 0, F.col("d") * F.col("tau") / run).otherwise(1.0))
    c = c.withColumns({"nx": F.lead("c").over(w), "first": F.min(F.when((F.col("tau").between(2, 31)) & (F.col("c") < 0.8), F.col("tau"))).over(W.partitionBy("frame"))})
    dip = c.where((F.col("tau") >= F.col("first")) & (F.col("nx").isNull() | (F.col("nx") >= F.col("c"))))
    return rounded(dip.groupBy("frame").agg(F.min("tau").alias("tau"), F.min_by("c", "tau").alias("cmndf")))


STEPS = [(0, 500_000_000), (3840, 428_571_429), (9600, 612_244_898)]
SEGS = ", seg(s, nx, npq, anchor) AS (VALUES " + ", ".join(f"({a}, {'NULL' if b is None else b}, {c}, {d})" for a, b, c, d in timebase.tempo_segments(STEPS, 480, 48_000)) + ")"


@query(with_views("notes") + SEGS + """SELECT track, note, onset, CAST(anchor + (2 * CAST(onset - s AS HUGEINT) * npq * 48000 + 480000000000) // 960000000000 AS BIGINT) AS sample FROM notes JOIN seg ON onset >= s AND (nx IS NULL OR onset < nx)""")
def tick_to_sample(spark, sf_dir):
    n = notes(spark, sf_dir).select("track", "note", "onset")
    return timebase.tick_to_sample(n, timebase.segment_table(spark, STEPS, 480, 48_000), "onset", 480, 48_000)


@query(with_views("notes") + SEGS + """, q AS (SELECT track, note, onset * 97 AS sample FROM notes), z AS (SELECT *, lead(anchor) OVER (ORDER BY s) AS na FROM seg)
SELECT track, note, sample, CAST(least(s + CAST(sample - anchor AS HUGEINT) * 480000000000 // (CAST(npq AS HUGEINT) * 48000), coalesce(nx - 1, 9223372036854775807)) AS BIGINT) AS tick FROM q JOIN z ON sample >= anchor AND (na IS NULL OR sample < na)""")
def sample_to_tick(spark, sf_dir):
    n = notes(spark, sf_dir).select("track", "note", (F.col("onset") * 97).alias("sample"))
    return timebase.sample_to_tick(n, timebase.segment_table(spark, STEPS, 480, 48_000), "sample", 480, 48_000)


@query(with_views("notes") + "SELECT track, note, onset // 1440 + 1 AS bar, onset % 1440 // 480 + 1 AS beat, onset % 480 AS tick FROM notes")
def bar_beat_position(spark, sf_dir):
    bar, beat, tick = bar_beat(F.col("onset"), 480, 3, 4)
    return notes(spark, sf_dir).select("track", "note", bar.alias("bar"), beat.alias("beat"), tick.alias("tick"))


@query(with_views("notes") + "SELECT DISTINCT midi, ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][midi % 12 + 1] || CAST(midi // 12 - 1 AS VARCHAR) AS name, round(440 * pow(2.0, (midi - 69) / 12.0), 5) AS hz FROM notes")
def note_names(spark, sf_dir):
    return rounded(notes(spark, sf_dir).select("midi").distinct().select("midi", note_name(F.col("midi")).alias("name"), midi_to_hz(F.col("midi")).alias("hz")), places=5)


@query(with_views("notes") + ", h AS (SELECT track, note, 100 + x * 900 AS hz FROM notes), m AS (SELECT *, CAST(round(69 + 12 * log2(hz / 440)) AS BIGINT) AS midi FROM h) SELECT track, note, midi, round(1200 * log2(hz / (440 * pow(2.0, (midi - 69) / 12.0))), 5) AS cents FROM m")
def cents_off_pitch(spark, sf_dir):
    h = notes(spark, sf_dir).select("track", "note", (100 + F.col("x") * 900).alias("hz")).withColumn("midi", nearest_midi(F.col("hz")))
    return rounded(h.select("track", "note", "midi", cents_off(F.col("hz"), F.col("midi")).alias("cents")), places=5)


@query(with_views("notes") + ", p AS (SELECT *, lag(onset + dur) OVER (PARTITION BY track ORDER BY onset, note) AS prev_end FROM notes) SELECT track, note, onset, prev_end FROM p WHERE onset < prev_end")
def mono_overlap_lint(spark, sf_dir):
    return sequences.overlaps(notes(spark, sf_dir), "track").select("track", "note", "onset", "prev_end")


CATALOG = [("cutoff_hz", 40.0, 18000.0), ("gain", 0.0, 4.0), ("pan", -1.0, 1.0)]
CAT_SQL = ", cat(param, lo, hi) AS (VALUES " + ", ".join(f"('{p}', {a}, {b})" for p, a, b in CATALOG) + ")"
AUTO_SQL = ", auto AS (SELECT event_id, ['cutoff_hz','gain','pan','warmth','custom'][event_id % 5 + 1] AS param, value / 100 - 1 AS v FROM events)"


def _auto(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in ("cutoff_hz", "gain", "pan", "warmth", "custom")])
    return table(spark, sf_dir, "events").select("event_id", F.element_at(names, (F.pmod("event_id", F.lit(5)) + 1).cast("int")).alias("param"), (F.col("value") / 100 - 1).alias("v"))


def _catalog(spark):
    return F.broadcast(spark.createDataFrame(CATALOG, "param string, lo double, hi double"))  # three rows


@query("WITH " + (AUTO_SQL + CAT_SQL)[2:] + " SELECT event_id, param, round(v, 6) AS v FROM auto JOIN cat USING (param) WHERE v < lo OR v > hi")
def param_range_lint(spark, sf_dir):
    return rounded(_auto(spark, sf_dir).join(_catalog(spark), "param").where((F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi"))).select("event_id", "param", "v"))


@query("WITH " + (AUTO_SQL + CAT_SQL)[2:] + " SELECT param, count(*) AS n, min(event_id) AS first FROM auto WHERE param <> 'custom' AND param NOT IN (SELECT param FROM cat) GROUP BY 1")
def unknown_preset_lint(spark, sf_dir):
    a = _auto(spark, sf_dir).where("param <> 'custom'").join(_catalog(spark), "param", "left_anti")
    return a.groupBy("param").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query(with_views("notes") + """, a AS (SELECT track, min(onset) AS anchor FROM notes GROUP BY 1), q AS (SELECT n.track, note, anchor, onset - anchor AS d, greatest(dur, 120) AS dur FROM notes n JOIN a USING (track))
SELECT track, note, anchor + d - d % 120 + CASE WHEN d % 120 * 2 >= 120 THEN 120 ELSE 0 END AS onset, dur FROM q""")
def quantize_notes(spark, sf_dir):
    n = notes(spark, sf_dir).withColumn("anchor", F.min("onset").over(W.partitionBy("track")))
    return n.select("track", "note", snap_anchored(F.col("onset"), 120, F.col("anchor")).alias("onset"), F.greatest("dur", F.lit(120)).alias("dur"))


@query(with_views("notes") + """, q AS (SELECT track, onset // 480 * 480 AS onset, dur, midi, vel FROM notes), r AS (SELECT *, row_number() OVER (PARTITION BY track, onset ORDER BY midi, dur, vel) AS k FROM q)
SELECT track, onset, least(dur, coalesce(lead(onset) OVER (PARTITION BY track ORDER BY onset) - onset, dur)) AS dur, midi, vel FROM r WHERE k = 1""")
def overlap_repair(spark, sf_dir):
    n = notes(spark, sf_dir).withColumn("onset", F.floor(F.col("onset") / 480) * 480)
    return sequences.repair_overlaps(n, "track")


PAIR = """, rep AS (SELECT user_id AS id, CAST(count(*) * 10 AS DOUBLE) AS duration, CASE WHEN sqrt(avg(x*x)) > 0 THEN 20 * log10(sqrt(avg(x*x))) END AS db, median(110 + x * 700) AS f0 FROM sig GROUP BY 1)
SELECT a.id AS a, b.id AS b, round(b.duration - a.duration, 6) AS d_duration, round(b.db - a.db, 6) AS d_db, round(1200 * log2(b.f0 / a.f0), 5) AS d_cents,
coalesce(nullif(concat_ws(',', CASE WHEN abs(b.duration - a.duration) > 1 THEN 'duration' END, CASE WHEN abs(b.db - a.db) > 0.1 THEN 'loudness' END, CASE WHEN abs(1200 * log2(b.f0 / a.f0)) > 5 THEN 'pitch' END), ''), 'tier2') AS verdict
FROM rep a JOIN rep b ON b.id = a.id + 1"""


def _reports(spark, sf_dir):
    s = sig_events(spark, sf_dir)
    rms = F.sqrt(F.avg(F.col("x") * F.col("x")))
    return s.groupBy(F.col("user_id").alias("id")).agg((F.count("*") * 10.0).alias("duration"), F.when(rms > 0, 20 * F.log10(rms)).alias("db"), F.median(110 + F.col("x") * 700).alias("f0"))


@query(with_views("sig") + PAIR)
def compare_report(spark, sf_dir):
    """Reports of neighbouring signals: deltas (b - a) and the verdict in fixed order of dimensions."""
    r = _reports(spark, sf_dir)
    a, b = r.select(*[F.col(c).alias(c + "_a") for c in r.columns]), r.select(*[F.col(c).alias(c + "_b") for c in r.columns])
    p = a.join(b, F.col("id_b") == F.col("id_a") + 1)
    dd, db, dc = F.col("duration_b") - F.col("duration_a"), F.col("db_b") - F.col("db_a"), 1200 * F.log2(F.col("f0_b") / F.col("f0_a"))
    why = F.concat_ws(",", F.when(F.abs(dd) > 1, "duration"), F.when(F.abs(db) > 0.1, "loudness"), F.when(F.abs(dc) > 5, "pitch"))
    out = p.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.round(dd, 6).alias("d_duration"), F.round(db, 6).alias("d_db"), F.round(dc, 5).alias("d_cents"), F.when(why == "", "tier2").otherwise(why).alias("verdict"))
    return out


@query(with_views("sig") + """, c AS (SELECT user_id AS id, round(avg(x), 6) AS m FROM sig GROUP BY 1), ref AS (SELECT * FROM c WHERE id % 3 <> 0)
SELECT c.id, CASE WHEN r.id IS NULL THEN 'missing_reference' WHEN c.m = r.m THEN 'identical' ELSE 'differs' END AS status FROM c LEFT JOIN ref r USING (id)""")
def eval_join(spark, sf_dir):
    c = sig_events(spark, sf_dir).groupBy(F.col("user_id").alias("id")).agg(F.round(F.avg("x"), 6).alias("m"))
    # references are the files' own means: both stand in one row, since a mean computed twice could round the other way
    there = F.coalesce(F.col("id") % 3 != 0, F.lit(False))
    return c.withColumn("r", F.when(there, F.col("m"))).select("id", F.when(~there, "missing_reference").when(F.col("m") == F.col("r"), "identical").otherwise("differs").alias("status"))


@query(with_views("sig") + f""", v AS (SELECT user_id, {DB.format('sqrt(avg(x*x))')} AS db, max(abs(x)) AS pk, count(*) AS n FROM sig GROUP BY 1), checks AS (
SELECT user_id, 'level_within' AS kind, coalesce(abs(db + 5.5) <= 0.5, false) AS passed, round(db, 4) AS actual FROM v UNION ALL SELECT user_id, 'peak_below', coalesce(pk <= 0.95, true), round(pk, 4) FROM v
UNION ALL SELECT user_id, 'length_at_least', n >= 60, CAST(n AS DOUBLE) FROM v) SELECT *, bool_and(passed) OVER (PARTITION BY user_id) AS all_passed FROM checks""")
def verify_report(spark, sf_dir):
    from siglume.operators.verify import run_checks

    return run_checks(sig_events(spark, sf_dir), "user_id", [("level_within", -5.5, 0.5), ("peak_below", 0.95, 0.0), ("length_at_least", 60.0, 0.0)])


@query()
def onset_match(spark, sf_dir):
    """Onsets of neighbouring users matched one to one within 150 ms."""
    o = onsets.onsets(sig_events(spark, sf_dir), "user_id", scale=1.5, min_gap=3).select("user_id", (F.col("i") * 100.0).alias("t"))
    return sequences.match_onsets(o, o.select((F.col("user_id") - 1).alias("user_id"), (F.col("t") + 50.0).alias("t")), "user_id", 150.0)


@query("SELECT label, CAST(j - 1 AS BIGINT) AS i, round(sum(CAST(embedding[j] AS DOUBLE)), 5) AS mix FROM embeddings, range(1, 65) t(j) GROUP BY 1, 2")
def mix_sum(spark, sf_dir):
    f = sig_frames(spark, sf_dir).select("label", "frame", F.posexplode("v").alias("i", "x"))
    per = f.groupBy("label", "i").agg(F.sort_array(F.collect_list(F.struct("frame", "x"))).alias("s"))  # summed in stem order
    return rounded(per.select("label", F.col("i").cast("long").alias("i"), F.aggregate("s", F.lit(0.0), lambda a, v: a + v["x"]).alias("mix")), places=5)


@query("SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rounded(e.select("user_id", F.col("w.start").alias("start"), "n", "total"), places=4)


@query("""WITH d AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM d) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("start"), "n")


@query(with_views("sig") + "SELECT CAST(user_id AS VARCHAR) AS signal_id, i, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 6) AS x FROM sig")
def pcm_roundtrip(spark, sf_dir):
    """Signals as packed PCM, as WAV bytes, and back."""
    from siglume.sources import wav

    return rounded(wav.unwav(wav.wav_files(wav.pack(sig_events(spark, sf_dir), "user_id", 48_000))))


@query()
def probe_reports(spark, sf_dir):
    """Whole-signal reports (JSON) of the users' signals at 8 kHz."""
    from siglume.operators import probe
    from siglume.sources import wav

    return probe.probe(wav.pack(sig_events(spark, sf_dir), "user_id", 8_000))


@query(with_views("notes") + "SELECT CAST(track AS VARCHAR) AS track, CAST(midi AS INTEGER) AS pitch, count(*) AS n, CAST(sum(dur) AS BIGINT) AS ticks FROM (SELECT track, midi, least(dur, coalesce(lead(onset) OVER (PARTITION BY track ORDER BY onset) - onset, dur)) AS dur FROM (SELECT track, onset, min(midi) AS midi, min(dur) AS dur FROM notes GROUP BY 1, 2)) GROUP BY 1, 2")
def midi_roundtrip(spark, sf_dir):
    """Repaired notes written as one MIDI file a track and read again."""
    from siglume.sources import midi

    n = notes(spark, sf_dir).groupBy("track", "onset").agg(F.min("midi").alias("midi"), F.min("dur").alias("dur"))
    n = n.withColumn("vel", F.lit(64))
    fixed = sequences.repair_overlaps(n, "track")

    def kernel(f):
        import pandas as pd

        rows = sorted(zip(f["onset"].tolist(), f["dur"].tolist(), f["midi"].tolist(), f["vel"].tolist()))
        raw = midi.write(480, [(0, 120.0)], (4, 4), [{"name": str(f["track"].iloc[0]), "preset": "sine", "notes": rows}])
        return pd.DataFrame(midi.note_rows("", raw), columns=["path", "track", "preset", "at", "dur", "pitch", "vel"])

    back = fixed.select("track", "onset", F.coalesce("dur", F.lit(0)).alias("dur"), "midi", "vel").groupBy("track").applyInPandas(kernel, midi.NOTES)
    return back.groupBy("track", "pitch").agg(F.count("*").alias("n"), F.sum("dur").alias("ticks"))
