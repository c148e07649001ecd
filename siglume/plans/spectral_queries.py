"""Spectral, harmony, timbre and structure queries over the embedding frames."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from siglume.functions.scalars import upper_mad, upper_median
from siglume.operators import spectral
from siglume.operators.onsets import peaks
from siglume.operators.sequential import suppress
from siglume.plans.catalog import query, rounded
from siglume.sources.views import frame_bins, sig_frames, with_views

DFT = """, w AS (SELECT frame, CAST(j - 1 AS BIGINT) AS j, v[j] * (0.5 - 0.5 * cos(2 * pi() * (j - 1) / 63)) AS x FROM frames, range(1, 65) t(j))
SELECT frame, b AS bin, round(sqrt(pow(sum(x * cos(2 * pi() * b * j / 64)), 2) + pow(sum(x * sin(2 * pi() * b * j / 64)), 2)), 5) AS mag FROM w, range(0, 33) s(b) GROUP BY 1, 2"""


@query(with_views("frames") + DFT)
def stft_dft(spark, sf_dir):
    return rounded(spectral.dft_magnitudes(sig_frames(spark, sf_dir), 64), places=5)


@query(with_views("frames") + DFT)
def stft_fft(spark, sf_dir):
    return rounded(spectral.fft_magnitudes(sig_frames(spark, sf_dir)), places=5)


@query(with_views("bins") + """, s AS (SELECT frame, sum(CASE WHEN bin < 10 THEN m*m ELSE 0 END) AS low, sum(CASE WHEN bin BETWEEN 10 AND 40 THEN m*m ELSE 0 END) AS mid, sum(CASE WHEN bin > 40 THEN m*m ELSE 0 END) AS high FROM bins GROUP BY 1)
SELECT frame, round(coalesce(low / nullif(low + mid + high, 0), 0), 6) AS low, round(coalesce(mid / nullif(low + mid + high, 0), 0), 6) AS mid, round(coalesce(high / nullif(low + mid + high, 0), 0), 6) AS high FROM s""")
def band_energy(spark, sf_dir):
    return rounded(spectral.band_fractions(frame_bins(spark, sf_dir), (10, 40)))


@query(with_views("bins") + "SELECT frame, round(CASE WHEN sum(m) > 1e-9 THEN sum(m * bin * 375.0) / sum(m) END, 5) AS centroid FROM bins GROUP BY 1")
def spectral_centroid(spark, sf_dir):
    return rounded(spectral.centroid(frame_bins(spark, sf_dir), F.col("bin") * 375.0), places=5)


@query(with_views("bins") + """, f AS (SELECT frame, bin, m, m - lag(m) OVER (PARTITION BY bin ORDER BY frame) AS d FROM bins)
SELECT frame, round(sum(greatest(coalesce(d, 0), 0)), 6) AS flux FROM f GROUP BY 1""")
def spectral_flux(spark, sf_dir):
    v = F.transform("v", lambda x: F.abs(x))
    f = sig_frames(spark, sf_dir).select("frame", v.alias("m"))
    f = f.join(f.select((F.col("frame") + 1).alias("frame"), F.col("m").alias("p")), "frame", "left")  # a lag without one sorted task
    rise = F.aggregate(F.zip_with("m", "p", lambda a, b: F.greatest(a - b, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return rounded(f.select("frame", F.coalesce(rise, F.lit(0.0)).alias("flux")))


HZ = "(bin + 1) * 60.0"
PC = f"CAST(((CAST(round(69 + 12 * log2({HZ} / 440)) AS BIGINT) % 12) + 12) % 12 AS BIGINT)"
CHROMA = f", pcs AS (SELECT frame, {PC} AS pc, sum(m) AS c FROM bins WHERE {HZ} BETWEEN 55 AND 5000 GROUP BY 1, 2)"


def _hz():
    return (F.col("bin") + 1) * 60.0


@query(with_views("bins") + CHROMA + "SELECT frame, pc, round(c, 6) AS c FROM pcs")
def chroma(spark, sf_dir):
    return rounded(spectral.chroma(frame_bins(spark, sf_dir), _hz()))


def _values(rows):
    return ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)


KEYS = _values([(t, m, k, p[(k - t) % 12]) for t in range(12) for m, p in ((0, spectral.MAJOR), (1, spectral.MINOR)) for k in range(12)])
KEY = f""", keys(tonic, mode, pc, w) AS (VALUES {KEYS}), full12 AS (SELECT g.{{key}}, pc, coalesce(c, 0) AS c FROM (SELECT DISTINCT {{key}} FROM src) g CROSS JOIN (SELECT DISTINCT pc FROM keys) k LEFT JOIN src USING ({{key}}, pc)),
r AS (SELECT {{key}}, tonic, mode, (sum(c*w) - sum(c)*sum(w)/12) / nullif(sqrt(greatest(sum(c*c) - sum(c)*sum(c)/12, 0) * (sum(w*w) - sum(w)*sum(w)/12)), 0) AS r FROM full12 JOIN keys USING (pc) GROUP BY 1, 2, 3),
best AS (SELECT {{key}}, tonic, mode, round(coalesce(r, 0), 9) AS r, row_number() OVER (PARTITION BY {{key}} ORDER BY round(coalesce(r, 0), 9) DESC, tonic, mode) AS k FROM r)
SELECT {{key}}, CAST(tonic AS BIGINT) AS tonic, CAST(mode AS BIGINT) AS mode, round(r, 6) AS confidence FROM best WHERE k = 1"""


@query(with_views("bins") + CHROMA + ", src AS (SELECT * FROM pcs)" + KEY.format(key="frame"))
def key_estimate(spark, sf_dir):
    return rounded(spectral.key_estimate(spectral.vectors(spectral.chroma(frame_bins(spark, sf_dir), _hz()), "frame"), "frame"))


@query(with_views("bins") + f", src AS (SELECT frame // 25 AS section, {PC} AS pc, sum(m) AS c FROM bins WHERE {HZ} BETWEEN 55 AND 5000 GROUP BY 1, 2)" + KEY.format(key="section"))
def section_keys(spark, sf_dir):
    b = frame_bins(spark, sf_dir).withColumn("section", F.floor(F.col("frame") / 25))
    return rounded(spectral.key_estimate(spectral.vectors(spectral.chroma(b, _hz(), key="section"), "section"), "section"))


SHAPES = _values([(q, i, root, len(t), k, 1 if (k - root) % 12 in t else 0) for i, (q, t) in enumerate(spectral.CHORDS) for root in range(12) for k in range(12)])
LABELS = f""", shapes(quality, q_ord, root, tones, pc, s) AS (VALUES {SHAPES}), pcs12 AS (SELECT g.frame, k.pc, coalesce(c, 0) AS c FROM (SELECT DISTINCT frame FROM pcs) g CROSS JOIN (SELECT DISTINCT pc FROM shapes) k LEFT JOIN pcs USING (frame, pc)),
top AS (SELECT frame, max(c) AS top, sqrt(sum(c*c)) AS norm FROM pcs12 GROUP BY 1),
fit AS (SELECT frame, quality, q_ord, root, tones, round(sum(c*s) / (any_value(norm) * sqrt(tones)), 9) AS cosine, bool_and(s = 0 OR c >= 0.4 * top) AS there, any_value(top) AS top FROM pcs12 JOIN top USING (frame) JOIN shapes USING (pc) WHERE norm > 0 GROUP BY 1, 2, 3, 4, 5),
good AS (SELECT *, max(cosine) OVER (PARTITION BY frame) AS best FROM fit WHERE there AND top > 0 AND cosine >= 0.6),
pick AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY tones, cosine DESC, q_ord, root) AS k FROM good WHERE cosine >= best - 0.06),
labels AS (SELECT frame, CAST(root AS BIGINT) AS root, quality, cosine FROM pick WHERE k = 1)"""


@query(with_views("bins") + CHROMA + LABELS + "SELECT frame, root, quality, round(cosine, 6) AS cosine FROM labels")
def chord_labels(spark, sf_dir):
    return rounded(spectral.chord_labels(spectral.vectors(spectral.chroma(frame_bins(spark, sf_dir), _hz()), "frame"), "frame"))


@query(with_views("bins") + CHROMA + LABELS + """, isl AS (SELECT *, frame - row_number() OVER (PARTITION BY root, quality ORDER BY frame) AS g FROM labels)
SELECT root, quality, min(frame) AS start, max(frame) + 1 AS stop, count(*) AS n, round(avg(cosine), 6) AS cosine FROM isl GROUP BY root, quality, g""")
def chord_spans(spark, sf_dir):
    l = spectral.chord_labels(spectral.vectors(spectral.chroma(frame_bins(spark, sf_dir), _hz()), "frame"), "frame")
    g = l.withColumn("g", F.col("frame") - F.row_number().over(W.partitionBy("root", "quality").orderBy("frame")))
    out = g.groupBy("root", "quality", "g").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("stop"), F.count("*").alias("n"), F.avg("cosine").alias("cosine"))
    return rounded(out.drop("g"))


@query(with_views("bins") + CHROMA + LABELS + "SELECT round(count(l.frame) / count(*), 6) AS coverage FROM (SELECT DISTINCT frame FROM bins) b LEFT JOIN labels l USING (frame)")
def chord_coverage(spark, sf_dir):
    b = frame_bins(spark, sf_dir)
    l = spectral.chord_labels(spectral.vectors(spectral.chroma(b, _hz()), "frame"), "frame").select("frame", F.lit(1).alias("one"))
    return rounded(sig_frames(spark, sf_dir).select("frame").join(l, "frame", "left").agg((F.count("one") / F.count("*")).alias("coverage")))


MEL = _values(spectral.mel_table(26, 64, 48000.0))
DCT = _values(spectral.dct_table(26, 13))
CEPSTRA = f""", mel(band, bin, w) AS (VALUES {MEL}), dct(c, band, k) AS (VALUES {DCT}),
power AS (SELECT frame, band, sum(w * m * m) AS p FROM bins JOIN mel USING (bin) GROUP BY 1, 2),
grid AS (SELECT f.frame, b.band, coalesce(p, 0) AS p FROM (SELECT DISTINCT frame FROM bins) f CROSS JOIN range(0, 26) b(band) LEFT JOIN power USING (frame, band)),
logs AS (SELECT frame, band, ln(greatest(p, max(p) OVER (PARTITION BY frame) * 1e-8, 1e-10)) AS l FROM grid),
cep AS (SELECT frame, c, sum(k * l) AS v FROM logs JOIN dct USING (band) GROUP BY 1, 2)"""


@query(with_views("bins") + CEPSTRA + """, l AS (SELECT DISTINCT frame, label FROM bins) SELECT label, CAST(c AS INTEGER) AS c, round(avg(v), 5) AS mean, round(sqrt(greatest(avg(v*v) - avg(v)*avg(v), 0)), 5) AS std FROM cep JOIN l USING (frame) GROUP BY 1, 2""")
def mfcc_digest(spark, sf_dir):
    c = spectral.cepstra(frame_bins(spark, sf_dir)).join(sig_frames(spark, sf_dir).select("frame", "label"), "frame")
    out = c.groupBy("label", "c").agg(F.avg("v").alias("mean"), F.sqrt(F.greatest(F.avg(F.col("v") * F.col("v")) - F.avg("v") * F.avg("v"), F.lit(0.0))).alias("std"))
    return rounded(out, places=5)


@query(with_views("bins") + CEPSTRA + """, l AS (SELECT DISTINCT frame, label FROM bins), m AS (SELECT label, c, avg(v) AS m FROM cep JOIN l USING (frame) GROUP BY 1, 2)
SELECT a.label AS a, b.label AS b, round(sqrt(sum((a.m - b.m) * (a.m - b.m))), 5) AS distance FROM m a JOIN m b ON a.c = b.c AND a.label < b.label WHERE a.c >= 1 GROUP BY 1, 2""")
def timbre_distance(spark, sf_dir):
    c = spectral.cepstra(frame_bins(spark, sf_dir)).where("c >= 1").join(sig_frames(spark, sf_dir).select("frame", "label"), "frame")
    m = c.groupBy("label", "c").agg(F.avg("v").alias("m"))
    a, b = m.select(F.col("label").alias("a"), "c", F.col("m").alias("x")), m.select(F.col("label").alias("b"), "c", F.col("m").alias("y"))
    return rounded(a.join(b, "c").where("a < b").groupBy("a", "b").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2)).alias("distance")), places=5)


SIM = """, nrm AS (SELECT frame, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM frames),
sim AS (SELECT a.frame AS i, b.frame AS j, CASE WHEN a.n > 0 AND b.n > 0 THEN least(greatest(list_dot_product(a.v, b.v) / (a.n * b.n), 0), 1) ELSE 0 END AS sim FROM nrm a JOIN nrm b ON b.frame >= a.frame AND b.frame <= a.frame + 16)"""
KERNEL = _values([(u, v, w if u == v else 2 * w) for u, v, w in spectral.checkerboard(8, 4.0) if v >= u])
NOV = SIM + f""", kern(u, v, w) AS (VALUES {KERNEL}), size AS (SELECT count(*) AS n FROM frames),
nov AS (SELECT i - u AS t, sum(w * sim) AS nov FROM sim JOIN kern ON j - i = v - u, size WHERE i - u >= 8 AND i - u <= n - 8 GROUP BY 1)"""


@query(with_views("frames") + SIM + "SELECT i, j, round(sim, 6) AS sim FROM sim")
def self_similarity_band(spark, sf_dir):
    return rounded(spectral.self_similarity(sig_frames(spark, sf_dir), 16))


def _novelty(spark, sf_dir):
    frames = sig_frames(spark, sf_dir)
    return spectral.novelty(spectral.self_similarity(frames, 16), frames.count())


@query(with_views("frames") + NOV + "SELECT CAST(t AS BIGINT) AS t, round(nov, 5) AS nov FROM nov")
def novelty_curve(spark, sf_dir):
    return rounded(_novelty(spark, sf_dir).withColumn("t", F.col("t").cast("long")), places=5)


@query("WITH RECURSIVE " + with_views("frames")[5:] + NOV + """, l AS (SELECT list_sort(list(nov)) AS w FROM nov), m AS (SELECT w, w[len(w) // 2 + 1] AS med FROM l),
th AS (SELECT med + 1.5 * list_sort(list_transform(w, lambda v: abs(v - med)))[len(w) // 2 + 1] AS thr FROM m),
nb AS (SELECT t, nov, lag(nov) OVER (ORDER BY t) AS p, lead(nov) OVER (ORDER BY t) AS n FROM nov),
pk AS (SELECT t, nov, row_number() OVER (ORDER BY t) AS k FROM nb, th WHERE nov > thr AND nov >= p AND nov > n),
walk AS (SELECT k, t AS b, nov AS f, 1 AS g FROM pk WHERE k = 1 UNION ALL SELECT r.k, CASE WHEN r.t - w.b <= 4 AND r.nov <= w.f THEN w.b ELSE r.t END,
CASE WHEN r.t - w.b <= 4 AND r.nov <= w.f THEN w.f ELSE r.nov END, CASE WHEN r.t - w.b <= 4 THEN w.g ELSE w.g + 1 END FROM walk w JOIN pk r ON r.k = w.k + 1),
pick AS (SELECT arg_max(b, k) AS t, arg_max(f, k) AS f FROM walk GROUP BY g), best AS (SELECT *, row_number() OVER (ORDER BY f DESC, t) AS r FROM pick)
SELECT CAST(t AS BIGINT) AS boundary, round(f, 5) AS nov FROM best WHERE r <= 11""")
def section_bounds(spark, sf_dir):
    """At most 12 sections: the strongest 11 boundaries after suppression, by a global threshold."""
    nov = _novelty(spark, sf_dir).select(F.lit(0).alias("k"), F.col("t").cast("long").alias("i"), F.col("nov").alias("f"))
    whole = nov.groupBy("k").agg(F.collect_list("f").alias("w")).withColumn("med", upper_median(F.col("w")))
    thr = whole.select("k", (F.col("med") + 1.5 * upper_mad(F.col("w"), F.col("med"))).alias("thr"))
    found = peaks(nov.join(F.broadcast(thr), "k"), "k")
    picked = suppress(found, "k", 4)
    ranked = picked.withColumn("r", F.row_number().over(W.orderBy(F.desc("f"), "i"))).where("r <= 11")
    return rounded(ranked.select(F.col("i").alias("boundary"), F.col("f").alias("nov")), places=5)
