"""Scalar functions over the tables: levels, pitch and duration texts, time base, envelopes, noise, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from siglume.functions import scalars as S
from siglume.plans.catalog import query, rounded
from siglume.sources.views import notes, sig_events, table, with_views


@query(with_views("sig") + """SELECT user_id, i, round(CASE WHEN x - 0.5 > 0 THEN 20 * log10(x - 0.5) ELSE -999 END, 6) AS db_floor,
round(pow(10.0, -40 * x / 20), 9) AS gain FROM sig""")
def level_conversions(spark, sf_dir):
    """Levels that end at minus infinity (shown as -999), and back from dB to linear."""
    inf = S.lin_to_db_inf(F.col("x") - 0.5)
    s = sig_events(spark, sf_dir).select("user_id", "i", F.round(F.when(inf == float("-inf"), -999.0).otherwise(inf), 6).alias("db_floor"), F.round(S.db_to_lin(-40 * F.col("x")), 9).alias("gain"))
    return s


@query(with_views("sig") + """SELECT user_id, i, round(2595 * log10(1 + (20 + x * 8000) / 700), 6) AS mel, round(700 * (pow(10.0, (x * 2000) / 2595) - 1), 5) AS hz FROM sig""")
def mel_scale(spark, sf_dir):
    hz = 20 + F.col("x") * 8000
    return sig_events(spark, sf_dir).select("user_id", "i", F.round(S.hz_to_mel(hz), 6).alias("mel"), F.round(S.mel_to_hz(F.col("x") * 2000), 5).alias("hz"))


PITCH = "['C','D','E','F','G','A','B','c','d','H','x'][event_id % 11 + 1] || ['','#','b','##'][event_id % 4 + 1] || CAST(event_id % 13 - 2 AS VARCHAR)"


def _pick(values, column):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(column, F.lit(len(values))) + 1).cast("int"))


@query(f"""WITH t AS (SELECT event_id, {PITCH} AS s FROM events), p AS (SELECT event_id, s, upper(regexp_extract(s, '^([A-Ga-g])([#b]?)(-?[0-9]+)$', 1)) AS l,
regexp_extract(s, '^([A-Ga-g])([#b]?)(-?[0-9]+)$', 2) AS a, TRY_CAST(regexp_extract(s, '^([A-Ga-g])([#b]?)(-?[0-9]+)$', 3) AS INTEGER) AS o FROM t),
m AS (SELECT event_id, s, (o + 1) * 12 + CASE l WHEN 'C' THEN 0 WHEN 'D' THEN 2 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'G' THEN 7 WHEN 'A' THEN 9 WHEN 'B' THEN 11 END + CASE a WHEN '#' THEN 1 WHEN 'b' THEN -1 ELSE 0 END AS v FROM p)
SELECT event_id, s, CASE WHEN v BETWEEN 0 AND 127 THEN v END AS midi FROM m""")
def pitch_parse(spark, sf_dir):
    e = F.col("event_id")
    text = F.concat(_pick("C D E F G A B c d H x".split(), e), _pick(["", "#", "b", "##"], e), (F.pmod(e, F.lit(13)) - 2).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("s")).select("event_id", "s", S.parse_pitch(F.col("s")).alias("midi"))


@query("""WITH t AS (SELECT event_id, CAST(event_id % 5 AS VARCHAR) || '/' || [1,2,3,4,8,16,32,64,7][event_id % 9 + 1] || ['','.','t','x'][event_id % 4 + 1] AS s FROM events),
p AS (SELECT event_id, s, TRY_CAST(regexp_extract(s, '^([0-9]+)/([0-9]+)([.t]?)$', 1) AS BIGINT) AS n, TRY_CAST(regexp_extract(s, '^([0-9]+)/([0-9]+)([.t]?)$', 2) AS BIGINT) AS d, regexp_extract(s, '^([0-9]+)/([0-9]+)([.t]?)$', 3) AS m FROM t),
q AS (SELECT event_id, s, 1920 * n * CASE m WHEN '.' THEN 3 WHEN 't' THEN 2 ELSE 1 END AS a, d * CASE m WHEN '.' THEN 2 WHEN 't' THEN 3 ELSE 1 END AS b FROM p)
SELECT event_id, s, CASE WHEN a > 0 AND a % b = 0 THEN a // b END AS ticks FROM q""")
def duration_parse(spark, sf_dir):
    e = F.col("event_id")
    text = F.concat(F.pmod(e, F.lit(5)).cast("string"), F.lit("/"), _pick([str(v) for v in (1, 2, 3, 4, 8, 16, 32, 64, 7)], e), _pick(["", ".", "t", "x"], e))
    return table(spark, sf_dir, "events").select("event_id", text.alias("s")).select("event_id", "s", S.parse_duration(F.col("s"), 480).cast("long").alias("ticks"))


@query(with_views("notes") + """, p AS (SELECT track, note, 1 + note % 40 AS bar, 1 + note % 5 AS beat, note % 97 AS rest FROM notes)
SELECT track, note, CASE WHEN beat <= 3 THEN (bar - 1) * 1440 + (beat - 1) * 480 + rest END AS tick FROM p""")
def position_to_tick(spark, sf_dir):
    """Bar, beat and rest to ticks under 3/4; a beat beyond the signature is undefined."""
    bar, beat, rest = 1 + F.pmod("note", F.lit(40)), 1 + F.pmod("note", F.lit(5)), F.pmod("note", F.lit(97))
    return notes(spark, sf_dir).select("track", "note", S.position_tick(bar, beat, rest, 480, 3, 4).alias("tick"))


@query(with_views("notes") + "SELECT track, note, CAST(dur // gcd(dur, 1920) AS VARCHAR) || '/' || CAST(1920 // gcd(dur, 1920) AS VARCHAR) AS fraction FROM notes")
def fraction_text(spark, sf_dir):
    return notes(spark, sf_dir).select("track", "note", S.fraction_of_whole(F.col("dur"), 480).alias("fraction"))


@query(with_views("notes") + """, q AS (SELECT track, note, onset / 7.0 - 20 AS ms FROM notes)
SELECT track, note, CASE WHEN ms >= 0 THEN CAST(floor(ms / (60000.0 / (120 * 480)) + 0.5) AS BIGINT) END AS ticks,
onset - onset % 120 + CASE WHEN onset % 120 * 2 >= 120 THEN 120 ELSE 0 END AS snapped, dur AS unsnapped FROM q JOIN notes USING (track, note)""")
def ms_and_snap(spark, sf_dir):
    n = notes(spark, sf_dir)
    ms = F.col("onset") / 7.0 - 20
    return n.select("track", "note", S.ms_to_ticks(ms, F.lit(60000.0 / (120 * 480))).alias("ticks"), S.snap(F.col("onset"), 120).alias("snapped"), S.snap(F.col("dur"), 0).alias("unsnapped"))


@query(with_views("notes") + """SELECT track, note, round(pow(vel / 127, 2), 9) AS amp, round(CASE WHEN t < 0 THEN 0 WHEN t < 0.4 THEN CASE WHEN t < 0.1 THEN t / 0.1 WHEN t < 0.1 + 0.2 THEN 1 - (1 - 0.6) * (t - 0.1) / 0.2 ELSE 0.6 END
ELSE 0.6 * greatest(1 - (t - 0.4) / 0.25, 0) END, 9) AS env FROM (SELECT *, x * 0.8 - 0.05 AS t FROM notes)""")
def velocity_and_envelope(spark, sf_dir):
    n = notes(spark, sf_dir).withColumn("t", F.col("x") * 0.8 - 0.05)
    env = S.adsr(F.col("t"), F.lit(0.4), 0.1, 0.2, 0.6, 0.25)
    return n.select("track", "note", F.round(S.velocity_amp(F.col("vel")), 9).alias("amp"), F.round(env, 9).alias("env"))


def _crng(seed: str, index: str) -> str:
    """The generator as DuckDB SQL over unsigned 64-bit numbers."""
    times = lambda v, by: f"CAST((CAST({v} AS UHUGEINT) * {by}) % 18446744073709551616 AS UBIGINT)"
    return f"""list_reduce([xor(CAST({seed} AS UBIGINT), {times(index, S.GOLDEN)}), CAST(30 AS UBIGINT), CAST(27 AS UBIGINT), CAST(31 AS UBIGINT)], lambda z, k: CASE
WHEN k = 30 THEN {times(f"xor(CAST((CAST(z AS UHUGEINT) + {S.GOLDEN}) % 18446744073709551616 AS UBIGINT), CAST((CAST(z AS UHUGEINT) + {S.GOLDEN}) % 18446744073709551616 AS UBIGINT) >> 30)", S.MIX_A)}
WHEN k = 27 THEN {times("xor(z, z >> 27)", S.MIX_B)} ELSE xor(z, z >> 31) END)"""


@query(f"""WITH n AS (SELECT event_id, {_crng('user_id', 'event_id')} AS z, {_crng(_crng(f"xor(CAST({S.NOTE_STREAM} AS UBIGINT), CAST(user_id AS UBIGINT))", 'event_id'), '0')} AS s FROM events)
SELECT event_id, CAST(z >> 40 AS BIGINT) AS bits, round(CAST(z >> 40 AS BIGINT) / 8388608.0 - 1, 12) AS noise, CAST(s >> 1 AS BIGINT) AS stream FROM n""")
def counter_noise(spark, sf_dir):
    """White noise from a counter: each value depends on the seed and its index alone; and the streams of notes."""
    e, bits = table(spark, sf_dir, "events"), S.counter_bits(F.col("user_id"), F.col("event_id"))
    stream = F.shiftrightunsigned(S.note_seed(F.col("user_id"), F.col("event_id")), 1)
    return e.select("event_id", F.shiftrightunsigned(bits, 40).alias("bits"), F.round(S.counter_noise(F.col("user_id"), F.col("event_id")), 12).alias("noise"), stream.alias("stream"))


@query(with_views("sig") + """SELECT user_id, i, round((i * 256 + 512) / 48000.0 * 1000, 6) AS centre_ms, least((i * 256 + 512) // 4800, 9) AS bucket, least(CAST(floor((i * 256 + 512) / 48000.0 * 1000 / 250) AS BIGINT), 11) AS nominal FROM sig""")
def frame_buckets(spark, sf_dir):
    """Centres of hopped frames, and their windows by sample and by nominal time; the last window takes what lies beyond."""
    at = F.col("i") * 256 + 512
    return sig_events(spark, sf_dir).select("user_id", "i", F.round(S.frame_centre_ms(F.col("i"), 256, 1024, 48_000), 6).alias("centre_ms"), S.bucket_of_sample(at, 4800, 10).alias("bucket"), S.bucket_of_time(S.frame_centre_ms(F.col("i"), 256, 1024, 48_000), 250.0, 12).alias("nominal"))


@query(with_views("sig") + """, b AS (SELECT user_id, i, i * 100.0 + 30 AS t FROM sig), g AS (SELECT user_id, i, CAST(floor((t - 50 + 1e-6) / 400) AS BIGINT) AS k, t FROM b)
SELECT user_id, i, CASE WHEN k >= 0 THEN k // 3 + 1 END AS bar, CASE WHEN k >= 0 THEN k % 3 + 1 END AS beat FROM g""")
def bar_beat_at_time(spark, sf_dir):
    """Bar and beat in force at a time, on beats every 400 ms from 50 ms on, three to the bar."""
    bar, beat = S.bar_beat_at(F.col("i") * 100.0 + 30, 50.0, 400.0, 3)
    return sig_events(spark, sf_dir).select("user_id", "i", bar.alias("bar"), beat.alias("beat"))


@query("""WITH n AS (SELECT c_custkey AS id, 'track ' || CAST(c_nationkey AS VARCHAR) AS name FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS k FROM n)
SELECT id, name || CASE WHEN k > 1 THEN '_' || CAST(k AS VARCHAR) ELSE '' END AS name FROM k""")
def unique_names(spark, sf_dir):
    """Later bearers of a name get its count as a suffix."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("track "), F.col("c_nationkey").cast("string")).alias("name"))
    return S.unique_names(c, "name", "id")


@query("SELECT doc_id, md5(base64(encode(text))) AS h FROM documents WHERE text IS NOT NULL")
def base64_text(spark, sf_dir):
    """Base64 of whole texts on one line (shown by digest)."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(S.base64_line(F.encode("text", "UTF-8"))).alias("h"))


@query(with_views("sig") + """, v AS (SELECT user_id, i, x * 20000 AS hz FROM sig), r AS (SELECT *, CASE WHEN hz BETWEEN 20 AND 16000 THEN least(127, CAST(floor((2595 * log10(1 + hz / 700) - 2595 * log10(1 + 20 / 700)) / ((2595 * log10(1 + 16000 / 700) - 2595 * log10(1 + 20 / 700))) * 128) AS BIGINT)) END AS band FROM v)
SELECT user_id, i, band, 127 - band AS row, least((CAST(i AS BIGINT) * 100 + 128) // 256, 40) AS frame FROM r""".replace("1 + 20 / 700", "1 + 20.0 / 700").replace("1 + 16000 / 700", "1 + 16000.0 / 700"))
def image_band(spark, sf_dir):
    """The mel band of a frequency among 128 from 20 Hz to 16 kHz, its row in an image whose top is the highest, and the frame of
    a sample; frequencies beyond the axis have no band."""
    band = S.mel_band(F.col("x") * 20000, 128, 20.0, 16000.0)
    return sig_events(spark, sf_dir).select("user_id", "i", band.alias("band"), (127 - band).alias("row"), S.nearest_frame(F.col("i") * 100, 256, 41).alias("frame"))


@query("""SELECT l_suppkey AS signal_id, CAST(l_orderkey AS BIGINT) AS o, CAST(l_linenumber AS BIGINT) AS n, round(l_extendedprice / 100000 * cos((l_discount * 10 - 0.5 + 1) * pi() / 4) * pow(10.0, -6.0 / 20), 8) AS l,
round(l_extendedprice / 100000 * sin((l_discount * 10 - 0.5 + 1) * pi() / 4) * pow(10.0, -6.0 / 20), 8) AS r, round((l_discount + l_tax) / 2, 8) AS mono FROM lineitem""")
def pan_gain_downmix(spark, sf_dir):
    """Gain and constant-power pan of a mono source, and the mean of two channels."""
    left, right = S.pan_gains(F.col("l_discount") * 10 - 0.5)
    gain = S.db_to_lin(F.lit(-6.0))
    t = table(spark, sf_dir, "lineitem")
    x = F.col("l_extendedprice") / 100000
    return t.select(F.col("l_suppkey").alias("signal_id"), F.col("l_orderkey").cast("long").alias("o"), F.col("l_linenumber").cast("long").alias("n"), F.round(x * left * gain, 8).alias("l"), F.round(x * right * gain, 8).alias("r"), F.round(S.downmix("l_discount", "l_tax"), 8).alias("mono"))
